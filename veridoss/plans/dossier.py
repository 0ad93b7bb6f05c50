"""Evidence documents per entity: one lineage from features and vectors to nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoss.config import Settings
from veridoss.functions.scalars import packed, to_date
from veridoss.operators.aggregates import duplicate_summary, method_summary
from veridoss.operators.relational import join_one_to_one
from veridoss.operators.temporal import distribution_map, temporal_document
from veridoss.operators.vectors import centroid_stats, cluster, cluster_shared, ranked
from veridoss.schemas import DOCUMENT, RECORD, SCHEMA_VERSION
from veridoss.sources.workspace import kept


def clustered(features: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """Features with vectors and new cluster ids; entities whose clustering failed are left to ``failures``."""
    rows = features.drop("semantic_cluster_id").join(vectors.select("review_id", "embedding"), "review_id")
    ids = cluster(rows, "hotel_id", "review_id", "embedding", settings.similarity_threshold, settings.grouping_method.removesuffix("_linkage"), date="review_date")
    good = ids.where("error IS NULL").select("review_id", F.col("cluster_id").alias("semantic_cluster_id"))
    return rows.join(good, "review_id")


def shared_labels(rows: DataFrame, vectors: DataFrame, settings: Settings, key: str) -> DataFrame:
    """(hotel_id, key, semantic_cluster_id, centroid_similarity, minimum_pairwise_similarity) of rows that name vectors by key.

    Features that are joined with these need no vectors: ``parts`` takes both similarities as they are.
    """
    ids = cluster_shared(rows, vectors, "hotel_id", "review_id", key, "embedding", settings.similarity_threshold, settings.grouping_method.removesuffix("_linkage"), date="review_date")
    return ids.where("error IS NULL").select("hotel_id", key, F.col("cluster_id").alias("semantic_cluster_id"), "centroid_similarity", "minimum_pairwise_similarity")


def failures(features: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """Entities that could not be clustered, with the reason."""
    rows = features.join(vectors.select("review_id", "embedding"), "review_id")
    return cluster(rows, "hotel_id", "review_id", "embedding", settings.similarity_threshold, settings.grouping_method.removesuffix("_linkage"), date="review_date").where("error IS NOT NULL").select("hotel_id", "error").distinct()


def with_frozen_clusters(features: DataFrame, vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """The same rows on clusters made earlier: nothing is clustered again."""
    rows = features.drop("semantic_cluster_id").join(vectors.select("review_id", "embedding"), "review_id")
    return join_one_to_one(rows, clusters.select("review_id", "semantic_cluster_id"), ["review_id"], required=True)


def record(columns: list[str]) -> Column:
    """A record's fields in the format's order; a column that the table lacks is null."""
    return F.struct(*[F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in RECORD])


def full(rows: DataFrame, settings: Settings, provenance: dict[str, str] | None = None) -> DataFrame:
    """One nested row per entity with the format's fields: metadata, temporal summaries, clusters, records and notes.

    An entity with a single row, or whose rows have no dated one, says so in warnings.
    """
    return nested(*parts(rows, settings, provenance))


def nested(heads: DataFrame, records: DataFrame) -> DataFrame:
    """Full documents of their parts: an entity's records, in order of date and id, stand in its row."""
    e = "hotel_id"
    inside = records.groupBy(e).agg(F.transform(F.sort_array(F.collect_list(F.struct("r.review_date", "r.review_id", "r"))), lambda x: x["r"]).alias("review_evidence_records"))
    return heads.join(inside, e).select(*DOCUMENT)


def _clusters(rows: DataFrame, most: int) -> DataFrame:
    """One row per cluster of an entity: counts, similarities, dates, aspects, representatives and distributions.

    Windows of a cluster's rows, and of its rows with a value, need them together only once: they are shuffled by cluster.
    """
    e, c = "hotel_id", "semantic_cluster_id"
    marked = F.coalesce("duplicate_group_id", F.lit("")) != ""
    found = ranked(rows.where(F.col(e).isNotNull() & F.col(c).isNotNull()), e, c, "centroid_similarity", "absa_method", "review_text", "review_id")
    text = {v: F.col(v).cast("string") for v in ("review_id", "absa_method", "rating")}
    text["absa_method"] = F.coalesce(text["absa_method"], F.lit("nan"))
    for name, value in text.items():
        w = Window.partitionBy(e, c, value)
        found = found.withColumn(f"__{name}", F.when(F.row_number().over(w.orderBy("rank")) == 1, F.struct(value.alias("value"), F.count("*").over(w).alias("n"))))
    counted = lambda value, test: F.map_from_entries(F.array_sort(F.collect_list(F.when(test, F.col(f"__{value}")))))
    return found.groupBy(e, c).agg(
        F.count_if(F.col("__review_id").isNotNull() & F.col("review_id").isNotNull()).alias("unique_review_count"),
        F.count_if(marked).alias("possible_duplicate_count"),
        F.struct(F.avg("centroid_similarity").alias("mean_to_centroid"), F.min("centroid_similarity").alias("minimum_to_centroid"), F.max("centroid_similarity").alias("maximum_to_centroid"), F.min("minimum_pairwise_similarity").alias("minimum_pairwise_similarity")).alias("internal_similarity_summary"),
        F.min("review_date").alias("earliest_date"),
        F.max("review_date").alias("latest_date"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(packed(F.col("absa_aspect")))))).alias("aspect_distribution"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "review_id")))), lambda x: x["review_id"]).alias("representative_review_ids"),
        counted("absa_method", F.lit(True)).alias("absa_method_distribution"),
        F.when(F.count("rating") > 0, counted("rating", F.col("rating").isNotNull())).alias("rating_distribution"),
    )


def parts(rows: DataFrame, settings: Settings, provenance: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Full documents in two tables: (all fields but the records), and (entity, r) with a record a row.

    rows have a vector each, or both similarities of ``shared_labels``. What needs no whole document is told from these, so that no task holds an entity's texts.
    """
    e, c = "hotel_id", "semantic_cluster_id"
    if "centroid_similarity" not in rows.columns:
        stats = centroid_stats(rows, e, c, "review_id", "embedding")
        rows = rows.join(stats.select("review_id", "centroid_similarity", "minimum_pairwise_similarity"), "review_id").drop("embedding")
    rows = kept(rows.withColumn("__d", to_date(F.col("review_date"))), "rows")  # a dozen aggregates read them
    each = _clusters(rows, settings.representatives_per_cluster)
    inner = each.groupBy(e).agg(F.sort_array(F.collect_list(F.struct(c, "unique_review_count", "possible_duplicate_count", "internal_similarity_summary", "earliest_date", "latest_date", "aspect_distribution", "representative_review_ids", F.to_json("absa_method_distribution").alias("absa_method_distribution"), F.to_json("rating_distribution").alias("rating_distribution"), F.lit("not_established").alias("independence_claim")))).alias("semantic_clusters"))
    records = rows.where(F.col(e).isNotNull()).select(e, record(rows.columns).alias("r"))
    meta = rows.groupBy(e).agg(F.count("*").alias("review_count"), F.min("review_date").alias("minimum_review_date"), F.max("review_date").alias("maximum_review_date"), F.avg("rating").alias("raw_mean_rating"))
    absa = method_summary(rows, e, "absa_method").groupBy(e).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", F.struct("n", "share"))))).alias("absa_evidence"))
    meta = meta.join(duplicate_summary(rows, e, "duplicate_group_id"), e).join(distribution_map(rows, [e], "rating", "rating_distribution", False), e, "left")
    meta = meta.select(e, F.struct("review_count", "minimum_review_date", "maximum_review_date", "raw_mean_rating", "rating_distribution", F.struct("duplicate_rows", "duplicate_groups", "exact_reuse_rows").alias("duplicate_summary")).alias("hotel_metadata"))
    time = temporal_document(rows, e, "__d", "rating", "absa_sentiment", "absa_aspect", dict(settings.windows), settings.polarity_mode)
    time = time.select(e, F.struct(*[x for x in time.columns if x != e]).alias("temporal_summaries"))
    notes = F.struct(F.lit(settings.grouping_method).alias("cluster_method"), F.lit(settings.similarity_threshold).alias("cluster_threshold"), F.lit(settings.representatives_per_cluster).alias("representatives_per_cluster"), F.lit(True).alias("clustering_is_deterministic"))
    origin = F.create_map(*[F.lit(x) for kv in (provenance or {}).items() for x in kv]) if provenance else F.create_map().cast("map<string,string>")
    lacking = rows.groupBy(e).agg(F.array_compact(F.array(F.when(F.count("*") == 1, "single_record"), F.when(F.count("__d") == 0, "no_dated_record"))).alias("warnings"))
    both = meta.join(time, e).join(inner, e).join(absa, e).join(lacking, e)
    both = both.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "dataset_namespace": F.lit(settings.dataset_namespace), "methodology_notes": notes, "provenance": origin})
    return both.select(*[c for c in DOCUMENT if c != "review_evidence_records"]), records


def _chosen(heads: DataFrame, most: int) -> DataFrame:
    """(hotel_id, k, n, review_id): each cluster's place and its first representatives; a cluster without any has one row of nulls."""
    k = heads.select("hotel_id", F.posexplode("semantic_clusters").alias("k", "c"))
    return k.select("hotel_id", "k", F.posexplode_outer(F.slice("c.representative_review_ids", 1, most)).alias("n", "review_id"))


def chosen_records(heads: DataFrame, records: DataFrame, most: int = 3) -> DataFrame:
    """(hotel_id, k, n, r): the n-th representative of an entity's k-th cluster with its record, a row each; what compact documents hold beside their heads."""
    here = records.select("hotel_id", F.col("r.review_id").alias("review_id"), "r")
    return _chosen(heads, most).join(here, ["hotel_id", "review_id"], "left").select("hotel_id", "k", "n", "r")


def compact_parts(heads: DataFrame, records: DataFrame, most: int = 3) -> DataFrame:
    """The documents of ``compact``, of a document's parts: representatives are joined with records, no entity's records are gathered."""
    found = chosen_records(heads, records, most).groupBy("hotel_id", "k").agg(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("n", "r")))).alias("x"))
    held = found.groupBy(F.col("hotel_id").alias("__of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]["r"]).alias("__held"))
    clusters = F.transform("semantic_clusters", lambda c, i: c.withField("representative_reviews", F.get("__held", i)))
    return heads.join(held, F.col("hotel_id") == F.col("__of"), "left").withColumn("semantic_clusters", clusters).drop("__of", "__held")


def compact(documents: DataFrame, most: int = 3) -> DataFrame:
    """Documents without their records, each cluster with at most ``most`` representative records.

    Representatives' ids are joined with the places of an entity's records; only ids and places are shuffled
    for that. A document then takes its records by place.
    """
    chosen = _chosen(documents, most)
    placed = documents.select("hotel_id", F.posexplode(F.col("review_evidence_records.review_id")).alias("place", "review_id"))
    found = chosen.join(placed, ["hotel_id", "review_id"], "left").groupBy("hotel_id", "k").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("n", "place")))).alias("x"))
    places = found.groupBy(F.col("hotel_id").alias("__of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]["place"]).alias("__places"))
    docs = documents.join(places, F.col("hotel_id") == F.col("__of"), "left")
    records = F.col("review_evidence_records")
    clusters = F.transform("semantic_clusters", lambda c, i: c.withField("representative_reviews", F.transform(F.get("__places", i), lambda p: F.get(records, p))))
    return docs.withColumn("semantic_clusters", clusters).drop("review_evidence_records", "__of", "__places")


def compaction_report(full_docs: DataFrame, compact_docs: DataFrame) -> DataFrame:
    """Per entity: bytes of both forms, their ratio, embedded characters and a quarter of them as tokens."""
    size = lambda df, name: df.select("hotel_id", F.octet_length(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias(name))
    texts = F.flatten(F.transform("semantic_clusters", lambda k: F.transform(k["representative_reviews"], lambda r: F.coalesce(F.length(r["review_text"]), F.lit(0)))))
    chars = compact_docs.select("hotel_id", F.size(texts).alias("embedded_reviews"), F.aggregate(texts, F.lit(0), lambda a, x: a + x).alias("embedded_characters"))
    both = size(full_docs, "full_bytes").join(size(compact_docs, "compact_bytes"), "hotel_id").join(chars, "hotel_id")
    return both.withColumns({"compact_share_of_full": F.round(F.col("compact_bytes") / F.col("full_bytes"), 6), "approx_tokens": F.floor(F.col("embedded_characters") / 4)})


def compaction_of_parts(heads: DataFrame, records: DataFrame, most: int = 3) -> DataFrame:
    """The rows of ``compaction_report`` of a document's parts.

    A document's bytes are those of its head with empty arrays and of what stands in these, with commas between; records are
    measured where they are read, so that only sizes are shuffled.
    """
    json = lambda c: F.octet_length(F.to_json(c, {"ignoreNullFields": "false"})).cast("long")
    commas = lambda n: F.greatest(n - 1, F.lit(0))
    none = F.array().cast("array<string>")
    each = records.select("hotel_id", F.col("r.review_id").alias("review_id"), json(F.col("r")).alias("b"), F.coalesce(F.length("r.review_text"), F.lit(0)).cast("long").alias("n_chars"))
    inside = each.groupBy("hotel_id").agg((F.sum("b") + commas(F.count("*"))).alias("__records"))
    chosen = _chosen(heads, most).join(each, ["hotel_id", "review_id"], "left")
    per = chosen.groupBy("hotel_id", "k").agg(F.count("b").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))
    shown = per.groupBy("hotel_id").agg(F.sum("n").alias("__n"), F.sum("n_chars").alias("__chars"), F.sum(F.col("b") + commas(F.col("n"))).alias("__shown"))
    empty = F.transform("semantic_clusters", lambda c: c.withField("representative_reviews", none))
    rest = [c for c in heads.columns if c != "semantic_clusters"]
    sizes = heads.select("hotel_id", json(F.struct(*heads.columns, none.alias("review_evidence_records"))).alias("f"), json(F.struct(*rest, empty.alias("semantic_clusters"))).alias("c"))
    both = sizes.join(inside, "hotel_id").join(shown, "hotel_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = both.select("hotel_id", (F.col("f") + F.col("__records")).alias("full_bytes"), (F.col("c") + zero("__shown")).alias("compact_bytes"), zero("__n").alias("embedded_reviews"), zero("__chars").alias("embedded_characters"))
    return both.withColumns({"compact_share_of_full": F.round(F.col("compact_bytes") / F.col("full_bytes"), 6), "approx_tokens": F.floor(F.col("embedded_characters") / 4)})


def large_clusters(documents: DataFrame, threshold: float, least: int = 10, most: int = 10) -> DataFrame:
    """The largest clusters of each entity and whether they hold the linkage bound."""
    from veridoss.operators.relational import top_k

    k = documents.select("hotel_id", F.explode("semantic_clusters").alias("k")).select("hotel_id", "k.*").where(F.col("unique_review_count") >= least)
    low = F.col("internal_similarity_summary.minimum_pairwise_similarity")
    return top_k(k, ["hotel_id"], [F.desc("unique_review_count"), F.col("semantic_cluster_id")], most).select("hotel_id", "semantic_cluster_id", "unique_review_count", F.round(low, 6).alias("minimum_pairwise_similarity"), (low + 1e-6 >= threshold).alias("meets_complete_linkage_threshold"), F.round(low - threshold, 6).alias("threshold_margin"))


def traceability(documents: DataFrame) -> DataFrame:
    """Per entity: representatives, those that name no record, and those of another cluster."""
    reps = documents.select("hotel_id", F.explode("semantic_clusters").alias("k")).select("hotel_id", F.col("k.semantic_cluster_id").alias("c"), F.explode("k.representative_review_ids").alias("review_id"))
    recs = documents.select("hotel_id", F.explode("review_evidence_records").alias("r")).select("hotel_id", "r.review_id", F.col("r.semantic_cluster_id").alias("rc"), F.lit(True).alias("found"))
    return reps.join(recs, ["hotel_id", "review_id"], "left").groupBy("hotel_id").agg(F.count("*").alias("representative_count"), F.count_if(F.col("found").isNull()).alias("unresolved"), F.count_if(F.col("rc") != F.col("c")).alias("misassigned"))


def all_diagnostics(per_entity: DataFrame) -> DataFrame:
    """One row over the rows of ``aggregates.cluster_sizes``: sums, shares of the sums, the largest cluster."""
    one, n, k = F.sum("singleton_cluster_count"), F.sum("review_count"), F.sum("cluster_count")
    return per_entity.agg(F.count("*").alias("entities"), k.alias("cluster_count"), n.alias("review_count"), one.alias("singleton_cluster_count"), F.round(one / k, 6).alias("singleton_share_of_clusters"), F.round(one / n, 6).alias("singleton_share_of_reviews"), F.max("largest_cluster_size").alias("largest_cluster_size"))
