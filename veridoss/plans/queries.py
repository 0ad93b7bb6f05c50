"""Queries over the supplied tables, each an operator bound to columns, and their SQL twins.

Reviews are orders (entity: customer, rating: priority digit) or documents (entity: source);
packed lists are built from lineitem flags; vectors are the embeddings table by label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.functions import scalars as S
from veridoss.functions.claims import segment
from veridoss.operators import aggregates as A
from veridoss.operators import chunking as C
from veridoss.operators import relational as R
from veridoss.operators import temporal as T
from veridoss.operators import validation as V
from veridoss.operators import vectors as X
from veridoss.plans.linkage import clusters_sql, sizes_sql
from veridoss.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401

WINDOWS = {"last_90_days": 90, "last_180_days": 180, "last_365_days": 365}
CUTOFF = "1998-01-01"
THRESHOLD = 0.30
SPECS = [("noun", ["the", "and"]), ("prep", ["of", "in", "to"]), ("other", ["is", "was"])]
TERMS = {"negative": ["worthless", "pathetic", "scum"], "disruption": ["moron"], "security": ["clown"], "accessibility": ["password"], "hygiene": ["licen"]}


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"), F.substring("o_orderpriority", 1, 1).cast("double").alias("rating"), F.col("o_orderstatus").alias("method"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a packed list of line flags and of flag:score pairs."""
    li = table(spark, sf_dir, "lineitem").withColumn("f", F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("a"), F.concat(F.col("l_returnflag"), F.lit(":"), F.when(F.col("l_returnflag") == "R", "-1.5").when(F.col("l_returnflag") == "A", "0.5").when(F.col("l_linenumber") > 3, "oops").otherwise("0")).alias("s")))
    lists = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("f")).alias("x")).select("id", F.concat_ws(";", F.transform("x", lambda v: v["a"])).alias("aspects"), F.concat_ws(";", F.transform("x", lambda v: v["s"])).alias("sentiment"))
    return reviews(spark, sf_dir).join(lists, "id")


_REVIEWS = "SELECT o_custkey AS entity, o_orderkey AS id, o_orderdate AS d, CAST(substr(o_orderpriority,1,1) AS DOUBLE) AS rating, o_orderstatus AS method FROM orders"
_FLAGS = f"SELECT r.*, f.aspects, f.sentiment FROM ({_REVIEWS}) r JOIN (SELECT l_orderkey AS id, string_agg(l_returnflag || l_linestatus, ';' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS aspects, string_agg(l_returnflag || ':' || CASE WHEN l_returnflag='R' THEN '-1.5' WHEN l_returnflag='A' THEN '0.5' WHEN l_linenumber>3 THEN 'oops' ELSE '0' END, ';' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS sentiment FROM lineitem GROUP BY 1) f USING (id)"

def round4(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


@query(f"SELECT entity, count(*) AS review_count, strftime(min(d), '%Y-%m-%d') AS minimum_date, strftime(max(d), '%Y-%m-%d') AS maximum_date, round(avg(rating), 4) AS mean_rating FROM ({_REVIEWS}) GROUP BY 1")
def entity_summary(spark, sf):
    return round4(A.entity_summary(reviews(spark, sf), "entity", "d", "rating"), "mean_rating")


def _windows_sql(days: dict[str, int]) -> str:
    parts = ", ".join(f"count(*) FILTER (d >= a - INTERVAL {n} DAY) AS {k}, count(*) FILTER (d < a - INTERVAL {n} DAY) AS before_{k}" for k, n in days.items())
    return f"SELECT entity, strftime(max(a), '%Y-%m-%d') AS anchor_date, {parts} FROM (SELECT *, max(d) OVER (PARTITION BY entity) AS a FROM ({_REVIEWS})) GROUP BY 1"


@query(_windows_sql(WINDOWS))
def anchored_windows(spark, sf):
    return T.anchored_windows(reviews(spark, sf), "entity", "d", WINDOWS)


def flagship(spark, sf):
    """Summary, distribution and anchored windows of each entity in one row."""
    r = reviews(spark, sf)
    return A.entity_summary(r, "entity", "d", "rating").join(T.distribution_map(r, ["entity"], "rating", "rating_distribution", False), "entity").join(T.anchored_windows(r, "entity", "d", WINDOWS), "entity")


def _period_sql(label: str) -> str:
    score = "try_cast(trim(regexp_extract(t, ':([^:]*)$', 1)) AS DOUBLE)"
    return f"WITH r AS (SELECT *, {label} AS period FROM ({_FLAGS})), s AS (SELECT id, {score} AS v FROM (SELECT id, unnest(string_split(sentiment, ';')) AS t FROM r) WHERE contains(t, ':')), p AS (SELECT id, count(*) FILTER (v > 0) AS pos, count(*) FILTER (v < 0) AS neg, count(*) FILTER (v = 0) AS neu FROM s GROUP BY 1) SELECT entity, period, count(*) AS review_count, round(avg(rating), 4) AS mean_rating, CAST(sum(coalesce(pos,0)) AS BIGINT) AS positive, CAST(sum(coalesce(neg,0)) AS BIGINT) AS negative, CAST(sum(coalesce(neu,0)) AS BIGINT) AS neutral FROM r LEFT JOIN p USING (id) GROUP BY 1, 2"


@query(_period_sql("CAST(year(d) AS VARCHAR)"))
def by_year(spark, sf):
    return round4(T.period_summary(flags(spark, sf), "entity", "d", "rating", "sentiment", "year"), "mean_rating")


@query(_period_sql("year(d)::VARCHAR || 'Q' || quarter(d)::VARCHAR"))
def by_quarter(spark, sf):
    return round4(T.period_summary(flags(spark, sf), "entity", "d", "rating", "sentiment", "quarter"), "mean_rating")


@query(f"SELECT entity, coalesce(CAST(rating AS VARCHAR), 'nan') AS value, count(*) AS n FROM ({_REVIEWS}) GROUP BY 1, 2")
def rating_distribution(spark, sf):
    return T.distribution(reviews(spark, sf), ["entity"], "rating")


_FIXED = ", ".join(f"count(*) FILTER (d <= c AND d > c - INTERVAL {n} DAY) AS {k}_rows, count(DISTINCT id) FILTER (d <= c AND d > c - INTERVAL {n} DAY) AS {k}_ids" for k, n in WINDOWS.items())


@query(f"SELECT entity, {_FIXED}, count(*) FILTER (d <= c - INTERVAL 365 DAY) AS earlier_rows, count(DISTINCT id) FILTER (d <= c - INTERVAL 365 DAY) AS earlier_ids FROM (SELECT *, TIMESTAMP '{CUTOFF}' AS c FROM ({_REVIEWS})) GROUP BY 1")
def fixed_cutoff_windows(spark, sf):
    return T.fixed_windows(reviews(spark, sf), "entity", "d", "id", CUTOFF, WINDOWS)


@query(f"SELECT entity, strftime(min(d), '%Y-%m-%d') AS minimum_date, strftime(max(d), '%Y-%m-%d') AS maximum_date, count(DISTINCT year(d)) AS active_years, count(DISTINCT year(d)*4+quarter(d)) AS active_quarters, count(*) AS review_count FROM ({_REVIEWS}) GROUP BY 1")
def coverage(spark, sf):
    return T.coverage(reviews(spark, sf), "entity", "d")


@query(f"SELECT entity, strftime(d, '%Y-%m-%d') AS date, gap_days FROM (SELECT entity, d, CAST(floor((epoch_us(d) - epoch_us(lag(d) OVER (PARTITION BY entity ORDER BY d))) / 86400000000.0) AS BIGINT) AS gap_days FROM (SELECT DISTINCT entity, d FROM ({_REVIEWS}))) WHERE gap_days > 0")
def date_gaps(spark, sf):
    return T.date_gaps(reviews(spark, sf), "entity", "d").select("entity", F.date_format("d", "yyyy-MM-dd").alias("date"), "gap_days")


_ASPECT = f"SELECT entity, d, unnest(string_split(aspects, ';')) AS aspect FROM ({_FLAGS})"


@query(f"SELECT entity, aspect, count(*) AS mentions, strftime(min(d), '%Y-%m-%d') AS first_date, strftime(max(d), '%Y-%m-%d') AS latest_date, array_to_string(list_sort(list(DISTINCT year(d))), ',') AS active_years, count(DISTINCT year(d)) AS active_period_count FROM ({_ASPECT}) WHERE aspect <> '' GROUP BY 1, 2")
def aspect_rollup(spark, sf):
    return T.aspect_rollup(flags(spark, sf), "entity", "aspects", "d").withColumn("active_years", F.concat_ws(",", F.transform("active_years", lambda y: y.cast("string"))))


@query(f"WITH a AS (SELECT entity, year(d) AS year, aspect FROM ({_ASPECT}) WHERE aspect <> ''), y AS (SELECT DISTINCT entity, year(d) AS year FROM ({_FLAGS})), n AS (SELECT DISTINCT entity, aspect FROM a), c AS (SELECT entity, year, aspect, count(*) AS k FROM a GROUP BY 1, 2, 3) SELECT y.entity, CAST(y.year AS INTEGER) AS year, n.aspect, coalesce(c.k, 0) AS mentions FROM y JOIN n USING (entity) LEFT JOIN c ON c.entity=y.entity AND c.year=y.year AND c.aspect=n.aspect")
def aspect_year_dense(spark, sf):
    return T.aspect_years(flags(spark, sf), "entity", "aspects", "d")


@query(f"SELECT id, CASE WHEN n=0 THEN 'unknown' WHEN neg>0 AND pos>0 THEN 'mixed' WHEN s>0 THEN 'positive' WHEN s<0 THEN 'negative' ELSE 'neutral' END AS sentiment_class FROM (SELECT id, count(v) AS n, count(*) FILTER (v<0) AS neg, count(*) FILTER (v>0) AS pos, sum(v) AS s FROM (SELECT id, try_cast(regexp_extract(t, ':([^:]*)$', 1) AS DOUBLE) AS v FROM (SELECT id, unnest(string_split(sentiment, ';')) AS t FROM ({_FLAGS}))) GROUP BY 1)")
def sentiment_classes(spark, sf):
    return flags(spark, sf).select("id", S.sentiment_class(F.col("sentiment")).alias("sentiment_class"))


@query(f"SELECT entity, method, n, round(n / t, 6) AS share FROM (SELECT entity, method, count(*) AS n, sum(count(*)) OVER (PARTITION BY entity) AS t FROM ({_REVIEWS}) GROUP BY 1, 2)")
def method_summary(spark, sf):
    return A.method_summary(reviews(spark, sf), "entity", "method")


@query(f"SELECT entity, mode FROM (SELECT entity, rating AS mode, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, rating) AS r FROM ({_REVIEWS}) GROUP BY 1, 2) WHERE r = 1")
def mode_rating(spark, sf):
    return R.mode(reviews(spark, sf), ["entity"], "rating")


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def text_sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.sha256_text(F.col("text")).alias("text_sha256"))


@query("SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE copies > 1")
def exact_duplicates(spark, sf):
    return R.exact_duplicates(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "copies")


@query(f"SELECT entity, n, rank_hash, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(n) OVER (ORDER BY rank_hash, entity) AS running FROM (SELECT CAST(entity AS VARCHAR) AS entity, count(*) AS n, sha256('20260812:' || CAST(entity AS VARCHAR)) AS rank_hash FROM ({_REVIEWS}) GROUP BY 1)) WHERE running - n < 1000")
def stable_sample(spark, sf):
    return R.sample_entities(reviews(spark, sf), "entity", 1000, 20260812)


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'F'")
def rebase_positions(spark, sf):
    return R.renumber(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), "id")


@query("SELECT coalesce(min(o_orderkey), 0) = 0 AS from_zero, max(o_orderkey) = count(*) - 1 AS to_end, count(DISTINCT o_orderkey) = count(*) AS each_once FROM orders")
def contiguity(spark, sf):
    return R.contiguous(table(spark, sf, "orders"), "o_orderkey")


def _dedup_sql(direction: str) -> str:
    return f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {direction}, event_id {direction}) AS r FROM events) WHERE r = 1"


@query(_dedup_sql("DESC"))
def dedup_last(spark, sf):
    return R.dedup(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(_dedup_sql("ASC"))
def dedup_first(spark, sf):
    return R.dedup(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).drop("ts")


@query("SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_one_to_one(spark, sf):
    return R.join_one_to_one(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"]).na.fill(-1, ["quality", "toxic"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, sf):
    return R.semi(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf):
    return R.anti(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id AS id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_difference(spark, sf):
    return R.id_differences(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND d.v IS NOT DISTINCT FROM l.v) AS matching, count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND d.v IS DISTINCT FROM l.v) AS mismatching, count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only FROM (SELECT doc_id, doc_id % 2 AS v FROM documents) d FULL JOIN (SELECT doc_id, quality AS v FROM labels) l ON d.doc_id = l.doc_id")
def membership_diff(spark, sf):
    return R.membership_differences(table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).alias("v")), table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id", "v")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', length(text), doc_id) AS rank FROM documents) WHERE rank <= 3")
def topk_representatives(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "lang", F.length("text").alias("n"))
    return R.top_k(d, ["source"], [F.col("lang") != "en", F.col("n"), F.col("doc_id")], 3).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT CAST(a.label AS VARCHAR) AS label, count(b.vec_id) AS pairs FROM u a LEFT JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD} GROUP BY 1")
def pair_similarity_count(spark, sf):
    return X.pair_counts(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", THRESHOLD)


@query(clusters_sql("complete", THRESHOLD))
def complete_linkage(spark, sf):
    return X.cluster(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", THRESHOLD, "complete")


@query(clusters_sql("average", THRESHOLD, "'%s:issue_%05d', e"))
def average_linkage(spark, sf):
    return X.cluster(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", THRESHOLD, "average", "%s:issue_%05d")


_METHODS = " UNION ALL ".join(f"SELECT '{k}' AS spec, n AS s FROM ({sizes_sql(k, THRESHOLD)})" for k in ("complete", "single"))


@query(f"SELECT spec, count(*) AS clusters, round(count(*) FILTER (s = 1) / sum(s), 6) AS singleton_share, max(s) AS largest, count(*) FILTER (s > 50) AS over_50, count(*) FILTER (s > 100) AS over_100 FROM ({_METHODS}) GROUP BY 1")
def grouping_methods(spark, sf):
    e = table(spark, sf, "embeddings")
    both = [X.cluster(e, "label", "vec_id", "embedding", THRESHOLD, k).withColumn("spec", F.lit(k)) for k in ("complete", "single")]
    return A.grouping_comparison(both[0].unionByName(both[1]), "spec", "label", "cluster_id")


@query(f"SELECT label, count(*) AS cluster_count, CAST(sum(n) AS BIGINT) AS review_count, count(*) FILTER (n = 1) AS singleton_cluster_count, round(count(*) FILTER (n = 1) / count(*), 6) AS singleton_share_of_clusters, round(count(*) FILTER (n = 1) / sum(n), 6) AS singleton_share_of_reviews, max(n) AS largest_cluster_size FROM ({sizes_sql('complete', THRESHOLD)}) GROUP BY 1")
def cluster_diagnostics(spark, sf):
    return A.cluster_sizes(complete_linkage(spark, sf), "label", "cluster_id")


@query("WITH RECURSIVE i AS (SELECT conv_id, turn, greatest(1, floor(length(text)/3.6))::BIGINT + 4 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY lpad(turn::VARCHAR, 6, '0'), lpad(turn::VARCHAR, 6, '0')) AS k FROM conversations), r AS (SELECT conv_id, turn, n, k, n AS used, 1::BIGINT AS chunk_no FROM i WHERE k = 1 UNION ALL SELECT i.conv_id, i.turn, i.n, i.k, CASE WHEN r.used + i.n > 60 THEN i.n ELSE r.used + i.n END, CASE WHEN r.used + i.n > 60 THEN r.chunk_no + 1 ELSE r.chunk_no END FROM r JOIN i ON i.conv_id = r.conv_id AND i.k = r.k + 1) SELECT conv_id, chunk_no, count(*) AS review_count, CAST(sum(n) AS BIGINT) AS cost, printf('%03d_of_%03d', chunk_no, max(max(chunk_no)) OVER (PARTITION BY conv_id)) AS chunk_id FROM r GROUP BY 1, 2")
def chunk_plan(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("t"), S.token_estimate(F.col("text")).alias("n"))
    plan = C.chunk_plan(C.assign_chunks(c.withColumn("i", F.col("t")), "conv_id", "t", "i", "n", 60), "conv_id", "t")
    return plan.select("conv_id", "chunk_no", "review_count", "cost", "chunk_id")


@query("WITH RECURSIVE i AS (SELECT lang, n_chars // 7 + 4 AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 90, CAST(doc_id AS VARCHAR)) AS k FROM documents), r AS (SELECT lang, n, k, n AS used, 1::BIGINT AS chunk_no FROM i WHERE k = 1 UNION ALL SELECT i.lang, i.n, i.k, CASE WHEN r.used + i.n > 1500 THEN i.n ELSE r.used + i.n END, CASE WHEN r.used + i.n > 1500 THEN r.chunk_no + 1 ELSE r.chunk_no END FROM r JOIN i ON i.lang = r.lang AND i.k = r.k + 1) SELECT lang, chunk_no, count(*) AS review_count, CAST(sum(n) AS BIGINT) AS cost, max(max(chunk_no)) OVER (PARTITION BY lang) AS chunks FROM r GROUP BY 1, 2")
def chunks_of_long_entities(spark, sf):
    """Chunks of entities too long for one row, by pointers over tables."""
    d = table(spark, sf, "documents").select("lang", F.format_string("%02d", F.col("doc_id") % 90).alias("d"), F.col("doc_id").cast("string").alias("i"), F.floor(F.col("n_chars") / 7).alias("n"))
    got = C.assign_chunks(d, "lang", "d", "i", "n", 1500, items=100)
    return got.groupBy("lang", "chunk_no", "chunks").agg(F.count("*").alias("review_count"), F.sum("cost").alias("cost"))


@query("SELECT v.value, count(d.doc_id) AS n FROM (SELECT unnest(['de','en','es','fr','it','pt']) AS value) v LEFT JOIN documents d ON d.lang = v.value GROUP BY 1")
def fixed_domain(spark, sf):
    return A.fixed_domain(table(spark, sf, "documents"), "lang", ["de", "en", "es", "fr", "it", "pt"])


@query("WITH c AS (SELECT DISTINCT source AS s, doc_id + 7 AS id FROM documents), r AS (SELECT source AS s, doc_id AS id FROM documents), g AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.s = c.s AND r.id = c.id)) SELECT s AS source, count(*) AS n_absent, array_to_string(list_sort(list(id))[1:5], ',') AS absent FROM g GROUP BY 1")
def citation_check(spark, sf):
    from veridoss.operators.assess import absent_citations

    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"))
    cited = d.groupBy("source").agg(F.collect_list(F.col("id") + 7).alias("ids"))
    return absent_citations(cited, d, "source", "ids", "id", 5).withColumn("absent", F.concat_ws(",", F.transform("absent", lambda x: x.cast("string"))))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k")).where("k IS NOT NULL")


_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
_CASE = " ".join(f"WHEN regexp_matches(lower(text), '(^|[^{_WORD}])({'|'.join(a)})($|[^{_WORD}])') THEN '{n}'" for n, a in SPECS)


@query(f"SELECT item_id, CASE {_CASE} END AS category FROM benchmark")
def canonical_category(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.canonical_category(F.col("text"), SPECS).alias("category"))


@query("SELECT o_orderkey AS id, CASE WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}') THEN 'day' WHEN regexp_matches(v, '^\\d{4}-\\d{2}') THEN 'month' ELSE 'unknown' END AS precision FROM (SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, CAST(o_orderkey % 3 * 3 + 4 AS INTEGER)) AS v FROM orders)")
def date_precision(spark, sf):
    v = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), (F.col("o_orderkey") % 3 * 3 + 4).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.date_precision(v).alias("precision"))


@query("SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) || '_' || substr(sha256(url), 1, 12) AS stem FROM pages")
def slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.slug(F.col("url")).alias("stem"))


@query("SELECT doc_id, CAST(greatest(1, floor(length(text) / 3.6)) AS BIGINT) AS tokens, CAST(round_even(length(text) / 4.0, 0) AS BIGINT) AS quarter FROM documents")
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"), S.token_estimate_quarter(F.length("text")).alias("quarter"))


def _has(key: str) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS[key]) + ")"


@query(f"WITH c AS (SELECT source AS entity, doc_id AS id, text, lang, source || ':' || lang || ':' || CAST(n_chars // 400 AS VARCHAR) AS cluster, CAST(doc_id % 5 + 1 AS DOUBLE) AS rating FROM documents), n AS (SELECT cluster, count(*) AS k FROM c GROUP BY 1), m AS (SELECT entity, rating AS mode FROM (SELECT entity, rating, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, rating) AS r FROM c GROUP BY 1, 2) WHERE r = 1) SELECT id, retrieval_reason FROM (SELECT id, concat_ws(';', CASE WHEN k = 1 AND {_has('negative')} THEN 'rare_negative_claim' END, CASE WHEN k <= 3 AND {_has('negative')} THEN 'low_frequency_negative_claim' END, CASE WHEN {_has('disruption')} THEN 'possible_major_disruption_language' END, CASE WHEN {_has('security')} THEN 'security_related_topic' END, CASE WHEN {_has('accessibility')} THEN 'accessibility_related_topic' END, CASE WHEN {_has('hygiene')} THEN 'hygiene_related_topic' END, CASE WHEN k <= 3 AND abs(rating - mode) >= 2 THEN 'contradictory_to_dominant_rating_pattern' END) AS retrieval_reason FROM c JOIN n USING (cluster) JOIN m USING (entity)) WHERE retrieval_reason <> ''")
def rare_register(spark, sf):
    d = table(spark, sf, "documents")
    c = d.select(F.col("source").alias("entity"), F.col("doc_id").alias("id"), "text", F.concat_ws(":", "source", "lang", F.floor(F.col("n_chars") / 400).cast("string")).alias("cluster"), (F.col("doc_id") % 5 + 1).cast("double").alias("rating"))
    return A.rare_register(c, "cluster", "entity", "id", "text", "rating", TERMS).select("id", "retrieval_reason")


@query("SELECT CASE WHEN o_orderstatus IN ('F') THEN 'first' WHEN o_orderpriority LIKE '1%' THEN 'second' ELSE 'third' END AS status, o_orderkey AS id FROM orders")
def precedence(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    return R.precedence(o.select("id"), o.where("o_orderstatus = 'F'"), o.where("o_orderpriority LIKE '1%'"), "id", ("first", "second", "third"))


def _bad(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS \"check\", (SELECT count(*) FROM ({rows})) AS n_bad, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS i FROM ({rows}) ORDER BY i LIMIT 5)), '') AS examples"


@query(" UNION ALL ".join((_bad("text_blank", "SELECT doc_id FROM documents WHERE trim(text) = ''"), _bad("id_repeats", "SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1"), _bad("outside", "SELECT doc_id FROM documents WHERE n_chars NOT BETWEEN 50 AND 5000"))))
def validation_report(spark, sf):
    d = table(spark, sf, "documents")
    many = d.groupBy("doc_id").agg(F.count("*").alias("n"))
    checks = [V.check(d, "text_blank", S.blank(F.col("text")), "doc_id"), V.check(many, "id_repeats", F.col("n") > 1, "doc_id"), V.check(d, "outside", ~F.col("n_chars").between(50, 5000), "doc_id")]
    return V.report(checks).select("check", "n_bad", F.concat_ws(",", "examples").alias("examples"))


@query("SELECT source AS entity, low_rated, kept AS low_rated_kept, drops AS clusters_that_drop, lost AS low_rated_dropped FROM (SELECT source, CAST(sum(low) AS BIGINT) AS low_rated, CAST(sum(kept) AS BIGINT) AS kept, count(*) FILTER (n > r) AS drops, CAST(sum(CASE WHEN n > r THEN greatest(0, low - kept) ELSE 0 END) AS BIGINT) AS lost FROM (SELECT source, lang, count(*) AS n, count(*) FILTER (rank <= 3) AS r, count(*) FILTER (doc_id % 5 + 1 <= 2) AS low, count(*) FILTER (doc_id % 5 + 1 <= 2 AND rank <= 3) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS rank FROM documents) GROUP BY 1, 2) GROUP BY 1)")
def low_rating_retention(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars")
    ids = R.top_k(d, ["source", "lang"], [F.col("n_chars"), F.col("doc_id")], 3).select("doc_id", F.lit(True).alias("c"))
    rows = d.join(ids, "doc_id", "left").select(F.col("source").alias("entity"), "lang", (F.col("doc_id") % 5 + 1).cast("double").alias("rating"), F.coalesce("c", F.lit(False)).alias("chosen"))
    return A.low_rating_retention(rows, "entity", "lang", "rating", "chosen")


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLAIMS = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:[.!?]+(?:\s|$)|$)') AS s FROM documents), u AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM t),
p AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) - length(t) AS a FROM u), b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS si, a + length(t) - length(ltrim(t, {_SPACE})) AS a, trim(t, {_SPACE}) AS body FROM p WHERE trim(t, {_SPACE}) <> ''),
f AS (SELECT *, regexp_matches(lower(body), '(^|[^{_WORD}])(so|therefore|because|thus|hence)($|[^{_WORD}])') AS cause, regexp_extract(body, '(?i),\s*(but|although|however)\s+') AS gap, regexp_extract_all(body, ';\s+') AS stops FROM b),
c AS (SELECT doc_id, si, 0 AS ci, a, body AS t, '' AS term, 'whole_sentence' AS kind FROM f WHERE cause OR (gap = '' AND len(stops) = 0)
UNION ALL SELECT doc_id, si, 0, a, rtrim(left(body, strpos(body, gap) - 1), {_SPACE}), lower(trim(ltrim(gap, ','), {_SPACE})), 'contrast_left' FROM f WHERE NOT cause AND gap <> ''
UNION ALL SELECT doc_id, si, 1, a + strpos(body, gap) - 1 + length(gap), substr(body, strpos(body, gap) + length(gap)), lower(trim(ltrim(gap, ','), {_SPACE})), 'contrast_right' FROM f WHERE NOT cause AND gap <> ''
UNION ALL SELECT doc_id, si, row_number() OVER (PARTITION BY doc_id, si ORDER BY k) - 1, a + before, rtrim(t, {_SPACE}), ';', 'semicolon_part' FROM (SELECT *, sum(length(t) + length(coalesce(gap_, ''))) OVER (PARTITION BY doc_id, si ORDER BY k) - length(t) - length(coalesce(gap_, '')) AS before FROM (SELECT doc_id, si, a, unnest(string_split_regex(body, ';\s+')) AS t, unnest(list_append(stops, NULL)) AS gap_, generate_subscripts(list_append(stops, NULL), 1) AS k FROM f WHERE NOT cause AND gap = '' AND len(stops) > 0)) WHERE rtrim(t, {_SPACE}) <> '')
SELECT doc_id, doc_id AS input_row_position, printf('REVIEWS:r%06d:c%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY si, ci) - 1) AS claim_id, si AS sentence_index, ci AS claim_index, sha256(t) AS claim_text_sha256, CAST(a AS BIGINT) AS source_text_start, CAST(a + length(t) AS BIGINT) AS source_text_end, term AS linking_term, kind AS link_type, 'month' AS date_precision FROM c"""


@query(_CLAIMS)
def claim_segments(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("review_text"), F.col("doc_id").alias("input_row_position"), F.lit("2020-01").alias("review_date"))
    return segment(d).drop("review_text", "claim_text", "review_date")


# the other registered queries, which use what stands above
from veridoss.plans import evidence, files  # noqa: E402, F401
