"""Filters, screening scores and screening metrics over paper tables (paper_id, title, abstract, year, ...)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Titles, beginnings and types of items that are no research. Fixed values.
NO_RESEARCH_TITLES = ("front matter", "back matter", "index", "copyright", "preface", "foreword", "acknowledgments", "concluding remarks", "table of contents", "cover", "errata", "erratum", "corrigendum")
NO_RESEARCH_BEGINNINGS = ("review for ", "review of ms", "review of manuscript", "referee report", "reviewer comment", "disclosure")
NO_RESEARCH_TYPES = ("reference-entry", "dictionary-entry", "book-entry", "encyclopedia-entry")
#: Share of the query's weight that a paper's terms must carry, and terms at least.
MASS, TERMS = 0.45, 2


def _text() -> Column:
    return X.record_text(F.col("title"), F.col("abstract"))


def year_filter(papers: DataFrame, since: int | None = None, until: int | None = None, open_access: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """A missing year passes the upper bound and fails the lower."""
    keep = F.lit(True)
    if since is not None:
        keep &= F.coalesce("year", F.lit(0)) >= since
    if until is not None:
        keep &= F.coalesce("year", F.lit(9999)) <= until
    if open_access:
        keep &= F.coalesce("is_open_access", F.lit(False))
    if kinds:
        keep &= F.exists(F.array(*map(F.lit, kinds)), lambda k: F.lower(F.coalesce("type", F.lit(""))).contains(k))
    return papers.where(keep)


def since(papers: DataFrame, date: str) -> DataFrame:
    """Papers of a date (YYYY-MM-DD) or later: by the full date, a bare year, or the year column."""
    full, bare = F.try_to_date(F.substring("publication_date", 1, 10), "yyyy-MM-dd"), F.when(F.col("publication_date").rlike("^\\d{4}$"), F.col("publication_date").cast("int"))
    year = int(date[:4])
    return papers.where(F.when(bare.isNotNull(), bare >= year).when(full.isNotNull(), full >= F.to_date(F.lit(date))).otherwise(F.coalesce(F.col("year") >= year, F.lit(False))))


def with_abstract(papers: DataFrame, least: int = 50) -> DataFrame:
    return papers.where(F.length(X.text_or_empty(F.col("abstract"))) > least)


def matched_terms(papers: DataFrame, terms: dict[str, list[str]], id_col: str = "paper_id") -> DataFrame:
    """(id, term) for each term of which a paper has a form."""
    forms = F.array(*(F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, f)).alias("forms")) for t, f in terms.items()))
    pairs = papers.select(F.col(id_col).alias("id"), _text().alias("text"), F.explode(forms).alias("t"))
    return pairs.where(F.exists("t.forms", lambda f: F.col("text").contains(f))).select("id", F.col("t.term").alias("term"))


def cooccurrence(papers: DataFrame, query: str, id_col: str = "paper_id") -> DataFrame:
    """Papers whose matched query terms carry enough of the query's inverse-frequency weight, at least two of them and one of
    the two weightiest.

    Terms that no paper has say nothing and are dropped, as are those of one paper when two others have more. A query of one
    term, or with one term left, keeps all; with none left, none. Term frequencies are one small aggregate.
    """
    terms = {t: X.surface_forms(t) for t in X.key_terms(query)}
    if len(terms) <= 1:
        return papers
    matched = matched_terms(papers, terms, id_col)
    n = papers.count()
    df = {r.term: r.n for r in matched.groupBy("term").agg(F.count("*").alias("n")).collect()}
    sure = sum(v >= 2 for v in df.values())
    weight = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in terms if df.get(t, 0) > 1 or (df.get(t, 0) == 1 and sure < 2)}
    if not weight:
        return papers.limit(0)
    if len(weight) == 1:
        return papers
    head = sorted(weight, key=lambda t: -weight[t])[:2]
    value = F.create_map(*(F.lit(x) for t in weight for x in (t, weight[t])))
    hits = matched.where(F.col("term").isin(*weight)).groupBy("id").agg(F.sum(value[F.col("term")]).alias("mass"), F.count("*").alias("n"), F.max(F.col("term").isin(*head)).alias("head"))
    keep = hits.where((F.col("mass") >= MASS * sum(weight.values())) & (F.col("n") >= TERMS) & F.col("head"))
    return papers.join(keep.select(F.col("id").alias(id_col)), id_col, "left_semi")


def domain_gate(papers: DataFrame, tokens: list[str]) -> DataFrame:
    """Papers with a fifth of the query's tokens, two at least."""
    if not tokens:
        return papers
    need = max(2, math.ceil(len(tokens) / 5))
    return papers.where(sum((_text().contains(t).cast("int") for t in tokens[1:]), _text().contains(tokens[0]).cast("int")) >= need)


def overlap_gate(papers: DataFrame, tokens: list[str]) -> DataFrame:
    """Papers with one of the tokens, or a word one edit from it."""
    if not tokens:
        return papers
    held = F.array(*map(F.lit, tokens))
    near = F.exists(X.words(_text()), lambda w: F.exists(held, lambda t: X.within_one_edit(t, w)))
    return papers.where(F.exists(held, lambda t: _text().contains(t)) | near)


#: Endings that make one family of words, the longest taken off once. Fixed values.
ENDINGS = (
    "metry meter metric metrics metries logy logical logies logic graphy graphic graphs tion tional tions sion sional sions ment mental ments "
    "ance ant ancy ence ent ency ity ities ic ical ics al ally er ers ery or ors ory ive ively ivity ous ously osity"
).split()


def word_root(word: str, least: int = 5) -> str:
    cut = max((len(e) for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= least), default=0)
    return word[: len(word) - cut]


def term_match(term: str, hay: Column, aliases: list[str] | None = None) -> Column:
    """Whether folded text has a term: as a part, as an alias, as a word of the same root, compound or beginning, or one edit
    away for terms of seven letters on."""
    found = hay.contains(term)
    for alias in aliases or []:
        found |= hay.contains(alias)
    t = re.sub("[^a-z]", "", term)
    if len(t) < 5:
        return found
    root = word_root(t)

    def family(w: Column) -> Column:
        # Roots have five letters at least, so words with a root in common begin alike: one test stands for all of these.
        plain = F.replace(w, F.lit("-"), F.lit(""))
        near = (plain.contains(t) | F.lit(t).contains(plain)) & (F.abs(F.length(plain) - len(t)) <= 14)
        if len(root) >= 6:
            near |= plain.contains(root)
        return (F.length(plain) >= 5) & ((F.substring(plain, 1, 5) == t[:5]) | near)

    found |= F.exists(F.regexp_extract_all(hay, F.lit("([a-z][a-z\\-]+)"), F.lit(1)), family)
    if len(t) >= 7:
        found |= F.exists(F.split(hay, "[^a-z]+"), lambda w: (F.length(w) >= 6) & (F.abs(F.length(w) - len(t)) <= 1) & X.within_one_edit(F.lit(t), w))
    return found


def term_coverage(papers: DataFrame, terms: list[str], coordinated: tuple[str, ...] = (), aliases: dict[str, list[str]] | None = None, least: int = 2) -> DataFrame:
    """Adds ``matched`` and ``kept``. Kept: enough distinct terms, and a primary one (the first, or any of a coordinated pair)
    or all but one. A primary that no paper matches asks for nothing."""
    need = min(least, len(terms))
    if not need:
        return papers.withColumns({"matched": F.array().cast("array<string>"), "kept": F.lit(True)})
    hay = X.fold(_text())
    marked = papers.withColumn("__hay", hay)
    flags = F.array_compact(F.array(*(F.when(term_match(t, F.col("__hay"), (aliases or {}).get(t)), F.lit(t)) for t in terms)))
    marked = marked.withColumn("matched", flags).drop("__hay")
    primary = {terms[0], *(t for t in coordinated if t in terms)}
    seen = {r.t for r in marked.select(F.explode("matched").alias("t")).distinct().collect()}
    primary &= seen
    hits = F.size("matched")
    hit = F.arrays_overlap("matched", F.array(*map(F.lit, sorted(primary)))) if primary else F.lit(True)
    strong = hits >= max(need + 1, len(terms) - 1)
    return marked.withColumn("kept", (hits >= need) & (F.lit(len(terms) < 2) | hit | strong))


def coverage(papers: DataFrame, entities: list[str]) -> DataFrame:
    """(entity, n): papers that mention each, in one aggregate."""
    if not entities:
        return papers.sparkSession.createDataFrame([], "entity string, n long")
    hay = papers.select(X.fold(_text()).alias("hay"))
    counts = hay.agg(*(F.count_if(term_match(e, F.col("hay"))).alias(f"c{k}") for k, e in enumerate(entities)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(e).alias("entity"), F.col(f"c{k}").alias("n")) for k, e in enumerate(entities)))))


def insufficient(covered: dict[str, int], discovered: int, excluded: int, final: int, distinctive: int = 8) -> bool:
    """Whether a corpus cannot answer: under half of the distinctive entities supported; without such, none supported and all
    or over four fifths rejected."""
    if not covered or discovered <= 0:
        return False
    long = [e for e in covered if len(e) >= distinctive]
    if long:
        return 2 * sum(covered[e] > 0 for e in long) < len(long)
    return not any(covered.values()) and (final == 0 or excluded / max(1, discovered + excluded) > 0.8)


def keyword_idf(papers: DataFrame, words: list[str]) -> dict[str, float]:
    """Inverse document frequencies of keywords over a corpus: one aggregate row."""
    row = papers.agg(F.count("*").alias("n"), *(F.count_if(_text().contains(w.lower())).alias(f"c{k}") for k, w in enumerate(words))).first()
    return {w.lower(): math.log((max(row.n, 1) + 1) / (row[f"c{k}"] + 1)) + 1 for k, w in enumerate(words)}


def keyword_screen(papers: DataFrame, include: list[str], exclude: list[str], idf: dict[str, float] | None = None, upper: float = 1.0, lower: float = -1.0) -> DataFrame:
    """Adds ``score`` = weights of the included words found - twice those of the excluded, the words found, and
    ``recommendation``: include, exclude or borderline. Without ``idf`` all weigh 1."""
    idf = idf or {}

    def found(words: list[str]) -> Column:
        if not words:
            return F.array().cast("array<struct<w:string,v:double>>")
        return F.array_compact(F.array(*(F.when(_text().contains(w.lower()), F.struct(F.lit(w).alias("w"), F.lit(float(idf.get(w.lower(), 1.0))).alias("v"))) for w in words)))

    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["v"])
    out = papers.withColumns({"__in": found(include), "__out": found(exclude)})
    out = out.withColumn("score", total(F.col("__in")) - 2 * total(F.col("__out")))
    names = {"matched_include": F.transform("__in", lambda x: x["w"]), "matched_exclude": F.transform("__out", lambda x: x["w"])}
    return out.withColumns(names).drop("__in", "__out").withColumn("recommendation", bucket(F.col("score"), upper, lower))


def bucket(score: Column, upper: float = 1.0, lower: float = -1.0) -> Column:
    return F.when(score >= upper, "include").when(score <= lower, "exclude").otherwise("borderline")


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for unequal lengths."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def embedding_screen(papers: DataFrame, vector: str, query: list[float], include: list[list[float]], exclude: list[list[float]], upper: float = 1.0, lower: float = -1.0) -> DataFrame:
    """Likeness to the query, plus what included vectors exceed 0.4 by, less twice what excluded ones exceed 0.5 by."""
    lit = lambda v: F.array(*(F.lit(float(x)) for x in v))
    score = F.greatest(dot(F.col(vector), lit(query)), F.lit(0.0))
    for v in include:
        score += F.greatest(dot(F.col(vector), lit(v)) - 0.4, F.lit(0.0))
    for v in exclude:
        score -= 2 * F.greatest(dot(F.col(vector), lit(v)) - 0.5, F.lit(0.0))
    return papers.withColumn("score", score).withColumn("recommendation", bucket(F.col("score"), upper, lower))


def content_gate() -> Column:
    """Why an item is no research, or null: its title, its beginning, its type, or a title of a word or two without abstract.

    A beginning counts with its last space, even where nothing follows it.
    """
    whole = X.text_or_empty(F.col("title"))
    title, first = F.trim(whole), F.lower(F.ltrim(whole))
    low = F.lower(title)
    begins = first.startswith(NO_RESEARCH_BEGINNINGS[0])
    for b in NO_RESEARCH_BEGINNINGS[1:]:
        begins |= first.startswith(b)
    short = (F.size(F.split(title, "\\s+")) <= 2) & (F.length(title) < 30) & (F.length(F.trim(X.text_or_empty(F.col("abstract")))) < 100) & ~title.rlike("[0-9]")
    return (
        F.when(low.isin(*NO_RESEARCH_TITLES), "title").when(begins, "peer review").when(low.contains("review for ") & low.contains("supplemental"), "supplement")
        .when(F.lower(X.text_or_empty(F.col("type"))).isin(*NO_RESEARCH_TYPES), "type").when(short, "bare title")
    )


def majority(votes: DataFrame, by: str = "paper_id") -> DataFrame:
    """(id, relevant): more than half of the distinct judges say so; a judge's last vote counts."""
    last = votes.groupBy(by, "judge").agg(F.max_by("relevant", "voted_at").alias("relevant"))
    return last.groupBy(by).agg((2 * F.count_if("relevant") > F.count("*")).alias("relevant"))


def last_labels(labels: DataFrame, key: str = "doi", order: str = "at") -> DataFrame:
    """The last valid label of each key, keys and labels trimmed and lower-cased."""
    rows = labels.select(F.lower(F.trim(key)).alias(key), F.lower(F.trim("label")).alias("label"), order).where(F.col("label").isin("include", "exclude", "maybe") & (F.col(key) != ""))
    return rows.groupBy(key).agg(F.max_by("label", order).alias("label"))


def confusion(judged: DataFrame, predicted: str = "included", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and what follows; rows without a label and those labelled maybe are counted apart. Empty denominators
    give 0, and no kappa."""
    p, t, f = F.col(predicted), F.col(label) == "include", F.col(label) == "exclude"
    c = judged.groupBy(*(by or [])).agg(F.count_if(p & t).alias("tp"), F.count_if(p & f).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & f).alias("tn"), F.count_if(F.col(label) == "maybe").alias("maybe"), F.count_if(F.col(label).isNull()).alias("unlabeled"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = c.withColumns({"precision": zero(F.try_divide("tp", F.expr("tp + fp"))), "recall": zero(F.try_divide("tp", F.expr("tp + fn")))})
    out = out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    return out.withColumn("kappa", kappa("tp", "fp", "fn", "tn"))


def kappa(tp: str, fp: str, fn: str, tn: str) -> Column:
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    n = a + b + c + d
    chance = F.try_divide((a + b) * (a + c) + (c + d) * (b + d), n * n)
    return F.when((n > 0) & (chance != 1), F.try_divide(F.try_divide(a + d, n) - chance, 1 - chance))


def work_saved(ranked: DataFrame, position: str = "position", relevant: str = "relevant", share: float = 0.95) -> DataFrame:
    """(wss, n_to, recall_at_10): the share of the list not read when ``share`` of the relevant are found, where that is, and
    the share found in the first tenth.

    The running count is taken over counts of position ranges first, so that no task orders the whole list.
    """
    totals = ranked.agg(F.count("*").alias("n"), F.count_if(relevant).alias("r"))
    step = 4096
    blocks = ranked.groupBy(F.floor((F.col(position) - 1) / step).alias("block")).agg(F.count_if(relevant).alias("hits"))
    before = blocks.withColumn("before", F.coalesce(F.sum("hits").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = ranked.where(relevant).withColumn("block", F.floor((F.col(position) - 1) / step)).join(before, "block")
    seen = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy(position))
    reached = inside.withColumn("seen", seen).crossJoin(F.broadcast(totals)).where(F.col("seen") >= share * F.col("r")).agg(F.min(position).alias("n_to"))
    top = ranked.crossJoin(F.broadcast(totals)).where(F.col(position) <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))).agg(F.count_if(relevant).alias("early"))
    out = totals.crossJoin(reached).crossJoin(top).withColumn("n_to", F.coalesce("n_to", "n"))
    return out.select((1 - F.col("n_to") / F.col("n")).alias("wss"), "n_to", F.try_divide("early", "r").alias("recall_at_10"))


def random_baseline(judged: DataFrame, id_col: str = "paper_id", relevant: str = "relevant", seeds: str | None = None, draws: int = 5, seed: int = 42, share: float = 0.95, digits: int = 3) -> DataFrame:
    """(draw, n, n_relevant, n_to, wss, recall_at_10) of ``draws`` random orders: what a ranking has to beat. Seeds, if any, come first.

    Orders follow the MD5 of seed, draw and id, so that reruns agree. Rows are counted by the first ``digits`` hexadecimal digits;
    only the block in which the share is reached and that in which the first tenth ends are put in order, each about one in
    16**digits rows. Null flags are false; null ids are one empty id; rows of one id are neighbours, the relevant first. Without
    relevant rows the whole list is read and there is no recall. An empty table gives an empty one.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    rows = judged.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), flag(relevant).alias("hit"), flag(seeds).alias("first"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), "id")))
    rows = rows.withColumn("block", F.conv(F.left("h", F.lit(digits)), 16, 10).cast("int") - F.when(F.col("first"), 16**digits).otherwise(0))
    before, whole = W.partitionBy("draw").orderBy("block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("draw")
    blocks = rows.groupBy("draw", "block").agg(F.count("*").alias("k"), F.count_if("hit").alias("hits")).select(
        "draw", "block", "k", "hits", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"),
        F.sum("k").over(whole).alias("n"), F.sum("hits").over(whole).alias("n_relevant"),
    )
    goal, tenth = F.lit(share) * F.col("n_relevant"), F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    reached = (F.col("hits_before") < goal) & (goal <= F.col("hits_before") + F.col("hits"))
    edges = blocks.where(reached | ((F.col("rows_before") < tenth) & (tenth <= F.col("rows_before") + F.col("k"))))  # two a draw at most
    order = W.partitionBy("draw", "block").orderBy("h", "id", F.desc("hit"))
    inside = rows.join(F.broadcast(edges), ["draw", "block"])
    at, seen = F.col("rows_before") + F.row_number().over(order), F.col("hits_before") + F.sum(F.col("hit").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    found = inside.select("draw", "n", "n_relevant", at.alias("at"), seen.alias("seen"), goal.alias("goal"), tenth.alias("tenth"))
    out = found.groupBy("draw", "n", "n_relevant").agg(F.min(F.when((F.col("goal") > 0) & (F.col("seen") >= F.col("goal")), F.col("at"))).alias("n_to"), F.max(F.when(F.col("at") == F.col("tenth"), F.col("seen"))).alias("early"))
    n_to = F.coalesce("n_to", "n")
    return out.select("draw", "n", "n_relevant", n_to.alias("n_to"), (1 - n_to / F.col("n")).alias("wss"), F.try_divide("early", "n_relevant").alias("recall_at_10"))


def stopping(labels: DataFrame, total: int, order: str = "position", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """After each review: the posterior share of includes, the relevant left to expect, and whether either stop rule holds."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = labels.withColumns({"reviewed": F.count("*").over(w), "found": F.sum((F.col(label) == "include").cast("int")).over(w)})
    out = out.withColumn("posterior", (F.col("found") + 1) / (F.col("reviewed") + 2))
    left = F.greatest(F.lit(total) - F.col("reviewed"), F.lit(0)) * F.col("posterior")
    return out.withColumns({"expected_left": left, "stop_remaining": left <= 1.0, "stop_next": 100 * F.col("posterior") < 1.0})


def recall_curve(queue: DataFrame, rank: str = "rank", p: str = "p_include", every: int = 10) -> DataFrame:
    """(reviewed, predicted_includes, p_found) at every tenth rank and the last: counts of rank ranges, then a running sum."""
    blocks = queue.groupBy(F.ceil(F.col(rank) / every).alias("block")).agg(F.max(rank).alias("reviewed"), F.count_if(F.col(p) >= 0.5).alias("hits"))
    w = W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    total = blocks.agg(F.greatest(F.sum("hits"), F.lit(1)).alias("total"))
    return blocks.withColumn("predicted_includes", F.sum("hits").over(w)).crossJoin(F.broadcast(total)).select("reviewed", "predicted_includes", (F.col("predicted_includes") / F.col("total")).alias("p_found"))


def counts(screened: DataFrame, by: str = "recommendation") -> DataFrame:
    return screened.groupBy(by).agg(F.count("*").alias("n"))


def prisma(screened: DataFrame) -> DataFrame:
    """One row: identified, included, excluded, borderline, eligible."""
    r = F.col("recommendation")
    return screened.agg(F.count("*").alias("identified"), *(F.count_if(r == k).alias(k) for k in ("include", "exclude", "borderline")), F.count_if(r.isin("include", "borderline")).alias("eligible"))


def active_learning(features: DataFrame, labels: DataFrame, id_col: str = "paper_id", least_include: int = 5, least_exclude: int = 2) -> DataFrame:
    """Unlabelled papers ranked by a linear classifier of class-balanced labels: (id, p_include, rank).

    ``features``: id and a vector column ``features``. Needs so many labels of either class.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import vector_to_array

    known = features.join(labels.where(F.col("label").isin("include", "exclude")), id_col).withColumn("y", (F.col("label") == "include").cast("double"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if n.get(1.0, 0) < least_include or n.get(0.0, 0) < least_exclude:
        raise ValueError("too few labels of a class")
    total = sum(n.values())
    weight = F.when(F.col("y") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0]))
    model = LinearSVC(featuresCol="features", labelCol="y", weightCol="weight", maxIter=50, regParam=0.01).fit(known.withColumn("weight", weight))
    queue = model.transform(features.join(labels.select(id_col).distinct(), id_col, "left_anti"))
    decision = vector_to_array("rawPrediction")[1]
    scored = queue.select(id_col, F.round(1 / (1 + F.exp(-decision)), 4).alias("p_include"))
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("p_include"), id_col)))


def stage_audit(decisions: DataFrame) -> DataFrame:
    """(stage, decision, n) and the most frequent reason."""
    return decisions.groupBy("stage", "decision").agg(F.count("*").alias("n"), F.mode("reason", True).alias("reason"))
