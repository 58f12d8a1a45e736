"""Ranking signals, vectors, term networks, and the discovery flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import neighbours, ranking, screening
from ..scratch import Scratch
from .papers import PAPERS_SQL, papers
from .record_queries import discovery_papers
from .registry import query, table
from .screening_queries import QUESTION

AS_OF = 2025


@query("discovery_flow")
def discovery_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain gate, weight-of-terms filter, six signals, relevance floor, diversity caps."""
    scratch = Scratch(spark, "discovery")
    gated = screening.domain_gate(discovery_papers(spark, sf_dir), ["thing", "there", "that", "with", "eren", "thaon"])
    gated = scratch.keep(screening.cooccurrence(gated, QUESTION), "gated")  # each signal reads it
    semantic = ranking.query_likeness(gated, QUESTION).select(F.col("id").cast("long").alias("paper_id"), "semantic")
    facet = ranking.facets(gated, ["thing", "there", "eren", "thaon"]).withColumnRenamed("id", "paper_id")
    cites = ranking.citation_influence(gated, AS_OF).withColumnRenamed("id", "paper_id")
    signals = gated.join(semantic, "paper_id").join(facet, "paper_id").join(cites, "paper_id")
    signals = signals.withColumns({"recency": ranking.recency(F.col("year"), AS_OF), "venue_score": F.lit(0.5)}).withColumn("network", F.lit(0.0))
    scored = ranking.combine(signals.withColumn("__v", F.col("venue")).drop("venue").withColumnRenamed("venue_score", "venue"))
    scored = scratch.keep(scored.drop("abstract"), "scored")  # the floor and the caps read it several times
    best = ranking.diversify(ranking.relevance_floor(scored), 30, AS_OF)
    return best.select("rank", "paper_id", F.round("combined", 6).alias("combined"), F.round("semantic", 6).alias("semantic"), F.round("facet", 6).alias("facet"), "first_author", "venue_key", "year")


_GRAMS = "list_filter(regexp_extract_all(b, '[a-z0-9_]{2,}'), lambda w: true)"


@query("tfidf_likeness", f"""WITH {PAPERS_SQL}, d AS (SELECT paper_id::VARCHAR AS id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS b FROM papers UNION ALL SELECT 'q', '{QUESTION}'), w AS (SELECT id, {_GRAMS} AS w FROM d),
t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM w), f AS (SELECT id, t, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM d), g AS (SELECT t, count(*) AS df FROM f GROUP BY 1),
r AS (SELECT id, t, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS r FROM f JOIN g USING (t), n WHERE df <= 0.95 * n), l AS (SELECT id, sqrt(sum(r * r)) AS l FROM r GROUP BY 1), x AS (SELECT id, t, r / l AS v FROM r JOIN l USING (id)), q AS (SELECT t, v FROM x WHERE id = 'q')
SELECT d.id, round(least(coalesce(s, 0), 1), 6) AS semantic FROM d LEFT JOIN (SELECT x.id, sum(x.v * q.v) AS s FROM x JOIN q USING (t) WHERE x.id <> 'q' GROUP BY 1) s ON s.id = d.id WHERE d.id <> 'q'""")
def tfidf_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.query_likeness(papers(spark, sf_dir), QUESTION).withColumn("semantic", F.round("semantic", 6))


_TOK = ("thing", "there", "eren", "thaon")


@query("query_facets", f"""WITH {PAPERS_SQL}, x AS (SELECT paper_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM papers), i AS (SELECT {', '.join(f"ln((count(*) + 1.0) / (count(*) FILTER (contains(t, '{w}')) + 1)) + 1 AS i{k}" for k, w in enumerate(_TOK))} FROM x)
SELECT paper_id AS id, round(({' + '.join(f"contains(t, '{w}')::INT * i{k}" for k, w in enumerate(_TOK))}) / ({' + '.join(f'i{k}' for k in range(len(_TOK)))}), 6) AS facet FROM x, i""")
def query_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.facets(papers(spark, sf_dir), list(_TOK)).withColumn("facet", F.round("facet", 6))


@query("citation_influence", f"""WITH {PAPERS_SQL}, r AS (SELECT paper_id, 0.7 * ln(1 + citation_count) + 0.3 * ln(1 + citation_count / greatest(1, {AS_OF} - coalesce(year, {AS_OF}))::DOUBLE) AS r FROM papers) SELECT paper_id AS id, round(r / max(r) OVER (), 6) AS citation FROM r""")
def citation_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.citation_influence(papers(spark, sf_dir), AS_OF).withColumn("citation", F.round("citation", 6))


@query("recency_venue", f"""WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN {AS_OF} - coalesce(year, {AS_OF}) <= 3 THEN 1.0 WHEN {AS_OF} - coalesce(year, {AS_OF}) <= 10 THEN 0.7 ELSE 0.5 END::DOUBLE AS recency, round(CASE WHEN citation_count > 400 THEN least(ln(1 + citation_count) / ln(601), 1) WHEN contains(venue, 'src1') THEN 0.9 ELSE 0.5 END, 6)::DOUBLE AS venue FROM papers""")
def recency_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.when(F.col("citation_count") > 400, F.col("citation_count"))
    return papers(spark, sf_dir).select("paper_id", ranking.recency(F.col("year"), AS_OF).alias("recency"), F.round(ranking.venue_quality(F.col("venue"), h, ["src1"]), 6).alias("venue"))


@query("embedding_cosine", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS likeness FROM embeddings, q")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(ranking.cosine(F.col("embedding"), F.col("q")), 5).alias("likeness"))


_UNIT = "n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings)"


@query("centroid_classes", f"""WITH {_UNIT}, d AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM n WHERE vec_id % 5 = 0), c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM d GROUP BY ALL) GROUP BY 1),
s AS (SELECT vec_id, c.label, list_cosine_similarity(v, c) AS s FROM n, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) AS r FROM s) SELECT vec_id AS id, CASE WHEN s >= 0.15 THEN label END AS label, round(s, 5) AS likeness FROM b WHERE r = 1""")
def centroid_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    centres = ranking.centroids(e.where("vec_id % 5 = 0"), "label", "embedding")
    return ranking.nearest_centroid(e, centres, "vec_id", "embedding", "label").withColumn("likeness", F.round("likeness", 5))


@query("pooled_vectors", f"""WITH {_UNIT}, d AS (SELECT vec_id // 5 AS id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM n), m AS (SELECT id, i, avg(x) AS x FROM d GROUP BY ALL), l AS (SELECT id, sqrt(sum(x * x)) AS l FROM m GROUP BY 1) SELECT id, round(max(CASE WHEN i = 1 THEN x / l END), 5) AS first, round(max(x / l), 5) AS greatest FROM m JOIN l USING (id) GROUP BY 1""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("doc"), "embedding")
    v = ranking.pooled_vectors(chunks, "doc", "embedding")
    return v.select("id", F.round(F.col("vector")[0], 5).alias("first"), F.round(F.array_max("vector"), 5).alias("greatest"))


@query("term_strength", f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9\\-]{{3,}}'), lambda w: w NOT IN ({', '.join(f"'{s}'" for s in X.STOP_WORDS)})) AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), f AS (SELECT term FROM t GROUP BY 1 HAVING count(*) >= 2), h AS (SELECT item_id, term FROM t WHERE term IN (SELECT term FROM f)), o AS (SELECT item_id, count(*) - 1 AS o FROM h GROUP BY 1)
SELECT term, sum(o)::BIGINT AS strength FROM h JOIN o USING (item_id) GROUP BY 1""")
def term_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cooccurring_terms(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), X.STOP_WORDS)


@query("change_point", """WITH s AS (SELECT row_number() OVER (ORDER BY s_acctbal DESC) AS i, s_acctbal AS x, count(*) OVER () AS n, sum(s_acctbal) OVER (ORDER BY s_acctbal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head, sum(s_acctbal) OVER () AS total FROM supplier),
v AS (SELECT x, i, (i - 1) * (n - i + 1) * power(head / (i - 1) - (total - head) / (n - i + 1), 2) AS v FROM s WHERE i > 1) SELECT arg_max(x, v) AS cutoff FROM v""")
def change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.change_point(table(spark, sf_dir, "supplier"), "s_acctbal")


@query("terms_without_extensions", "SELECT DISTINCT a.w AS term FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) b WHERE starts_with(a.w, b.w) AND length(b.w) < length(a.w))")
def terms_without_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.words(F.col("text"), "[a-z]+")).alias("term")).distinct()
    return ranking.without_extensions(words)


@query("trim_ranked", f"WITH {PAPERS_SQL} SELECT paper_id FROM papers ORDER BY length(coalesce(abstract, '')) > 50 DESC, citation_count DESC, paper_id LIMIT 50")
def trim_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.trim_ranked(papers(spark, sf_dir), 50, score="citation_count").select("paper_id")


@query("term_expansion", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, list_cosine_similarity(q.e, r.e) AS c FROM v q, v r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query, neighbour, rank::INT AS rank, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) AS rank FROM s) WHERE rank <= 5""")
def term_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id divides by 50 asks all vectors for its five nearest."""
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(spark, e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 6))
