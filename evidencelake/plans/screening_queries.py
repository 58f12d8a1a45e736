"""Filters, screening and screening metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking, screening
from .papers import PAPERS_SQL, papers
from .registry import query, table

#: A query whose words the synthetic English has.
QUESTION = "thing there that with eren thaon"


@query("year_filter", f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE coalesce(year, 0) >= 2000 AND coalesce(year, 9999) <= 2015 AND contains(lower(type), 'article')")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.year_filter(papers(spark, sf_dir), 2000, 2015, kinds=["article"]).select("paper_id")


@query("since_filter", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE >= DATE '1995-06-01' ELSE year(o_orderdate) >= 1995 END")
def since_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    date = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, y.cast("string")).otherwise("")
    return screening.since(table(spark, sf_dir, "orders").select("o_orderkey", date.alias("publication_date"), y.alias("year")), "1995-06-01").select("o_orderkey")


@query("with_abstract", f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE length(coalesce(abstract, '')) > 50")
def with_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.with_abstract(papers(spark, sf_dir)).select("paper_id")


_TERMS = {t: X.surface_forms(t) for t in X.key_terms(QUESTION)}
_HITS = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{f}')" for f in forms) + f" THEN 1 ELSE 0 END AS h{k}" for k, forms in enumerate(_TERMS.values()))
_N = len(_TERMS)


@query("cooccurrence_filter", f"""WITH {PAPERS_SQL}, x AS (SELECT paper_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM papers), h AS (SELECT paper_id, {_HITS} FROM x),
l AS (SELECT paper_id, unnest([{', '.join(str(k) for k in range(_N))}]) AS k, unnest([{', '.join(f'h{k}' for k in range(_N))}]) AS hit FROM h), d AS (SELECT k, sum(hit) AS df, (SELECT count(*) FROM papers) AS n FROM l GROUP BY k),
s AS (SELECT k, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM d WHERE df > 1 OR (df = 1 AND (SELECT count(*) FROM d WHERE df >= 2) < 2)), o AS (SELECT k, idf, row_number() OVER (ORDER BY idf DESC, k) AS r FROM s)
SELECT paper_id FROM l JOIN o USING (k) WHERE hit = 1 GROUP BY paper_id HAVING sum(idf) >= 0.45 * (SELECT sum(idf) FROM s) AND count(*) >= 2 AND min(r) <= 2""")
def cooccurrence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.cooccurrence(papers(spark, sf_dir), QUESTION).select("paper_id")


@query("domain_gate", f"WITH {PAPERS_SQL}, x AS (SELECT paper_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM papers) SELECT paper_id FROM x WHERE contains(t, 'thing')::INT + contains(t, 'there')::INT + contains(t, 'eren')::INT + contains(t, 'zzz')::INT >= 2")
def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.domain_gate(papers(spark, sf_dir), ["thing", "there", "eren", "zzz"]).select("paper_id")


@query("overlap_gate", f"WITH {PAPERS_SQL}, x AS (SELECT paper_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM papers) SELECT paper_id FROM x WHERE contains(t, 'thionea') OR len(list_filter(list_distinct(regexp_extract_all(t, '[a-z0-9]+')), lambda w: damerau_levenshtein(w, 'thionea') <= 1)) > 0")
def overlap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.overlap_gate(papers(spark, sf_dir), ["thionea"]).select("paper_id")


@query("term_coverage")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.term_coverage(papers(spark, sf_dir), ["thionea", "erenan", "ciónmente"]).select("paper_id", "matched", "kept")


@query("entity_coverage")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.coverage(papers(spark, sf_dir), ["thing", "erenan", "schaft"])


_IN, _OUT = ("thing", "eren"), ("worthless", "schaft")
_KEYS = ", ".join(f"(SELECT ln((count(*) + 1.0) / (count(*) FILTER (contains(t, '{w}')) + 1)) + 1 FROM x) AS w{k}" for k, w in enumerate((*_IN, *_OUT)))


@query("keyword_screening", f"""WITH {PAPERS_SQL}, x AS (SELECT paper_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM papers), w AS (SELECT {_KEYS}),
s AS (SELECT paper_id, contains(t, 'thing')::INT * w0 + contains(t, 'eren')::INT * w1 - 2 * (contains(t, 'worthless')::INT * w2 + contains(t, 'schaft')::INT * w3) AS s FROM x, w)
SELECT paper_id, round(s, 6) AS score, CASE WHEN s >= 1 THEN 'include' WHEN s <= -1 THEN 'exclude' ELSE 'borderline' END AS recommendation FROM s""")
def keyword_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    out = screening.keyword_screen(p, list(_IN), list(_OUT), screening.keyword_idf(p, [*_IN, *_OUT]))
    return out.select("paper_id", F.round("score", 6).alias("score"), "recommendation")


@query("prisma_counts", f"""WITH {PAPERS_SQL}, r AS (SELECT CASE WHEN paper_id % 3 = 0 THEN 'include' WHEN paper_id % 3 = 1 THEN 'exclude' ELSE 'borderline' END AS r FROM papers)
SELECT count(*) AS identified, count(*) FILTER (r = 'include') AS include, count(*) FILTER (r = 'exclude') AS exclude, count(*) FILTER (r = 'borderline') AS borderline, count(*) FILTER (r <> 'exclude') AS eligible FROM r""")
def prisma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.element_at(F.array(*map(F.lit, ("include", "exclude", "borderline"))), (F.col("paper_id") % 3 + 1).cast("int"))
    return screening.prisma(papers(spark, sf_dir).withColumn("recommendation", r))


@query("embedding_screening", """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings), q AS (SELECT v FROM n WHERE vec_id = 0), i AS (SELECT v FROM n WHERE vec_id = 1), e AS (SELECT v FROM n WHERE vec_id = 2)
SELECT vec_id, round(greatest(list_dot_product(n.v, q.v), 0) + greatest(list_dot_product(n.v, i.v) - 0.4, 0) - 2 * greatest(list_dot_product(n.v, e.v) - 0.5, 0), 5) AS score FROM n, q, i, e""")
def embedding_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", screening.unit(F.col("embedding")).alias("v"))
    q, i, e = ([float(x) for x in v.where(F.col("vec_id") == k).first().v] for k in (0, 1, 2))
    return screening.embedding_screen(v, "v", q, [i], [e]).select("vec_id", F.round("score", 5).alias("score"))


@query("content_gate", f"""WITH {PAPERS_SQL}, x AS (SELECT paper_id, CASE WHEN paper_id % 9 = 0 THEN 'Front matter' WHEN paper_id % 9 = 1 THEN 'Review for ' || title WHEN paper_id % 9 = 2 THEN 'Basalt' ELSE title || ' and more words here' END AS title, CASE WHEN paper_id % 9 = 2 THEN '' ELSE abstract END AS abstract FROM papers)
SELECT paper_id, CASE WHEN paper_id % 9 = 0 THEN 'title' WHEN paper_id % 9 = 1 THEN 'peer review' WHEN paper_id % 9 = 2 THEN 'bare title' END AS reason FROM x""")
def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, title = F.col("paper_id") % 9, F.coalesce("title", F.lit(""))
    p = papers(spark, sf_dir).withColumns({"title": F.when(m == 0, "Front matter").when(m == 1, F.concat(F.lit("Review for "), title)).when(m == 2, "Basalt").otherwise(F.concat(title, F.lit(" and more words here"))), "abstract": F.when(m == 2, "").otherwise(F.col("abstract"))})
    return p.select("paper_id", screening.content_gate().alias("reason"))


@query("judge_votes", "WITH v AS (SELECT user_id, event_type, max_by(event_id % 3 = 0, event_id) AS r FROM events GROUP BY ALL) SELECT user_id AS paper_id, 2 * count(*) FILTER (r) > count(*) AS relevant FROM v GROUP BY 1")
def judge_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("judge"), (F.col("event_id") % 3 == 0).alias("relevant"), F.col("event_id").alias("voted_at"))
    return screening.majority(votes)


@query("last_labels", "SELECT user_id::VARCHAR AS doi, max_by(CASE event_id % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' ELSE 'maybe' END, event_id) AS label FROM events WHERE event_id % 4 <> 3 GROUP BY 1")
def last_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_id") % 4 == 3, "unknown").otherwise(F.element_at(F.array(*map(F.lit, ("Include ", "EXCLUDE", "maybe"))), (F.col("event_id") % 3 + 1).cast("int")))
    return screening.last_labels(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doi"), label.alias("label"), F.col("event_id").alias("at")))


_CONFUSION = """j AS (SELECT d.lang, d.n_chars > 800 AS p, l.quality AS y FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT lang, count(*) FILTER (p AND y = 1) AS tp, count(*) FILTER (p AND y = 0) AS fp, count(*) FILTER (NOT p AND y = 1) AS fn, count(*) FILTER (NOT p AND y = 0) AS tn, count(*) FILTER (y IS NULL) AS unlabeled FROM j GROUP BY 1)"""


@query("screening_metrics", f"""WITH {_CONFUSION}, m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS re, (tp + fp + fn + tn)::DOUBLE AS n FROM c), k AS (SELECT *, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n * n) AS pe FROM m)
SELECT lang, tp, fp, fn, tn, 0::BIGINT AS maybe, unlabeled, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa FROM k""")
def screening_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 800).alias("included"))
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("label")), "doc_id", "left")
    out = screening.confusion(j, by=["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "kappa")})


@query("work_saved", "WITH r AS (SELECT row_number() OVER (ORDER BY quality DESC, doc_id) AS p, doc_id % 4 = 0 AS rel FROM labels), s AS (SELECT p, rel, sum(rel::INT) OVER (ORDER BY p) AS seen, sum(rel::INT) OVER () AS n_rel, count(*) OVER () AS n FROM r) SELECT round(1 - min(p) FILTER (rel AND seen >= 0.95 * n_rel)::DOUBLE / any_value(n), 6) AS wss, min(p) FILTER (rel AND seen >= 0.95 * n_rel) AS n_to, round((count(*) FILTER (rel AND p <= greatest(1, n // 10)))::DOUBLE / any_value(n_rel), 6) AS recall_at_10 FROM s")
def work_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").select(F.row_number().over(W.orderBy(F.desc("quality"), "doc_id")).cast("long").alias("position"), (F.col("doc_id") % 4 == 0).alias("relevant"))
    return screening.work_saved(r).select(F.round("wss", 6).alias("wss"), "n_to", F.round("recall_at_10", 6).alias("recall_at_10"))


@query("random_baseline", """WITH r AS (SELECT draw, coalesce(quality = 1, false) AS rel, row_number() OVER (PARTITION BY draw ORDER BY doc_id % 20 <> 0, md5('42:' || draw || ':' || doc_id), quality DESC) AS p FROM labels, range(1, 6) t(draw)),
s AS (SELECT draw, p, rel, sum(rel::INT) OVER (PARTITION BY draw ORDER BY p) AS seen, sum(rel::INT) OVER (PARTITION BY draw) AS k, count(*) OVER (PARTITION BY draw) AS n FROM r)
SELECT draw::INT AS draw, any_value(n) AS n, any_value(k)::BIGINT AS n_relevant, min(p) FILTER (seen >= 0.95::DOUBLE * k) AS n_to, round(1 - min(p) FILTER (seen >= 0.95::DOUBLE * k)::DOUBLE / any_value(n), 6) AS wss, round((count(*) FILTER (rel AND p <= greatest(1, n // 10)))::DOUBLE / any_value(k), 6) AS recall_at_10 FROM s GROUP BY 1""")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in five random orders; ids that 20 divides have been screened."""
    j = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"), (F.col("doc_id") % 20 == 0).alias("screened"))
    out = screening.random_baseline(j, "doc_id", seeds="screened")
    return out.withColumns({c: F.round(c, 6) for c in ("wss", "recall_at_10")})


@query("stopping_rule", "SELECT user_id, event_id, count(*) OVER w AS reviewed, round((sum((event_id % 5 = 0)::INT) OVER w + 1.0) / (count(*) OVER w + 2), 6) AS posterior FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def stopping_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, "include").otherwise("exclude").alias("label"))
    return screening.stopping(rows, 100, "event_id", by=["user_id"]).select("user_id", "event_id", "reviewed", F.round("posterior", 6).alias("posterior"))


@query("recall_curve", "WITH q AS (SELECT row_number() OVER (ORDER BY doc_id) AS rank, (doc_id % 10) / 10.0 AS p FROM labels), b AS (SELECT ceil(rank / 10.0) AS b, max(rank) AS reviewed, count(*) FILTER (p >= 0.5) AS h FROM q GROUP BY 1) SELECT reviewed, (sum(h) OVER (ORDER BY b))::BIGINT AS predicted_includes, round((sum(h) OVER (ORDER BY b))::DOUBLE / greatest(sum(h) OVER (), 1), 6) AS p_found FROM b")
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "labels").select(F.row_number().over(W.orderBy("doc_id")).cast("long").alias("rank"), (F.col("doc_id") % 10 / 10).alias("p_include"))
    return screening.recall_curve(q).withColumn("p_found", F.round("p_found", 6))


@query("stage_audit", "SELECT event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'include' ELSE 'exclude' END AS decision, count(*) AS n, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS reason FROM events GROUP BY 1, 2, 4")
def stage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    return screening.stage_audit(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(even, "include").otherwise("exclude").alias("decision"), F.when(even, "even").otherwise("odd").alias("reason")))


@query("active_learning")
def active_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), "label")
    seeds = e.where("paper_id % 5 = 0").select("paper_id", F.when(F.col("label") < 3, "include").otherwise("exclude").alias("label"))
    return screening.active_learning(e.select("paper_id", "features"), seeds)


@query("topic_boost", f"WITH {PAPERS_SQL} SELECT paper_id, round((CASE WHEN contains(lower(abstract), 'thing') THEN 1.5::DOUBLE ELSE 1 END) * (CASE WHEN contains(lower(abstract), 'eren') THEN 1.2 ELSE 1 END), 6) AS boost FROM papers WHERE NOT contains(lower(abstract), 'worthless')")
def topic_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates as rows of factors: a product over those that fit; excluded ones drop the paper."""
    factors = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(f).alias("f")) for w, f in (("thing", 1.5), ("eren", 1.2))))
    low = F.lower("abstract")
    p = papers(spark, sf_dir).where(~F.exists(F.array(F.lit("worthless")), lambda w: low.contains(w)))
    return p.select("paper_id", F.round(F.aggregate(factors, F.lit(1.0), lambda a, x: a * F.when(low.contains(x["w"]), x["f"]).otherwise(1.0)), 6).alias("boost"))


@query("topical_filter")
def topical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers over the likeness bar, or of the better half."""
    p = papers(spark, sf_dir)
    s = ranking.query_likeness(p, QUESTION)
    n = p.count()
    kept = s.withColumn("r", F.row_number().over(W.orderBy(F.desc("semantic"), "id")))
    return kept.where((F.col("semantic") >= 0.05) | (F.col("r") <= math.ceil(n / 2))).select("id", F.round("semantic", 6).alias("semantic"))
