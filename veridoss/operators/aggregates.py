"""Group summaries, fixed-domain distributions, rare-case register, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoss.functions.scalars import contains_any, packed
from veridoss.operators.relational import mode


def entity_summary(df: DataFrame, entity: str, date: str, rating: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count("*").alias("review_count"), F.date_format(F.min(date), "yyyy-MM-dd").alias("minimum_date"), F.date_format(F.max(date), "yyyy-MM-dd").alias("maximum_date"), F.avg(rating).alias("mean_rating"))


def method_summary(df: DataFrame, entity: str, method: str) -> DataFrame:
    """Counts and shares by method per entity."""
    n = df.groupBy(entity, F.col(method).alias("method")).agg(F.count("*").alias("n"))
    total = n.groupBy(entity).agg(F.sum("n").alias("t"))
    return n.join(total, entity).select(entity, "method", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def duplicate_summary(df: DataFrame, entity: str, group: str, reuse: str | None = None) -> DataFrame:
    marked = F.coalesce(F.col(group).cast("string"), F.lit("")) != ""
    again = F.coalesce(F.col(reuse), F.lit(False)) if reuse and reuse in df.columns else F.lit(False)
    return df.groupBy(entity).agg(F.count_if(marked).alias("duplicate_rows"), F.count_distinct(F.when(marked, F.col(group))).alias("duplicate_groups"), F.count_if(again).alias("exact_reuse_rows"))


def cluster_summary(df: DataFrame, entity: str, cluster: str, id_: str, date: str, group: str, aspects: str, reuse: str | None = None) -> DataFrame:
    """Per cluster: distinct ids, duplicates, reuse, dates and the sorted set of aspects."""
    marked = F.coalesce(F.col(group).cast("string"), F.lit("")) != ""
    again = F.coalesce(F.col(reuse), F.lit(False)) if reuse and reuse in df.columns else F.lit(False)
    return df.groupBy(entity, cluster).agg(F.count_distinct(id_).alias("unique_review_count"), F.count_if(marked).alias("possible_duplicate_count"), F.count_if(again).alias("exact_reuse_review_count"), F.min(date).alias("earliest_date"), F.max(date).alias("latest_date"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(packed(F.col(aspects)))))).alias("aspect_distribution"))


def cluster_sizes(df: DataFrame, entity: str, cluster: str) -> DataFrame:
    """Per entity: clusters, rows, singletons and their shares, the largest size."""
    sizes = df.groupBy(entity, cluster).agg(F.count("*").alias("s"))
    one = F.count_if(F.col("s") == 1)
    return sizes.groupBy(entity).agg(F.count("*").alias("cluster_count"), F.sum("s").alias("review_count"), one.alias("singleton_cluster_count"), F.round(one / F.count("*"), 6).alias("singleton_share_of_clusters"), F.round(one / F.sum("s"), 6).alias("singleton_share_of_reviews"), F.max("s").alias("largest_cluster_size"))


def size_histogram(df: DataFrame, entity: str, cluster: str) -> DataFrame:
    return df.groupBy(entity, cluster).agg(F.count("*").alias("size")).groupBy(entity, "size").agg(F.count("*").alias("n"))


def low_rating_retention(df: DataFrame, entity: str, cluster: str, rating: str, chosen: str, low: float = 2.0) -> DataFrame:
    """Low-rated rows, those chosen as representatives, and those dropped from clusters that lose members."""
    is_low = F.col(rating) <= low
    each = df.groupBy(entity, cluster).agg(F.count("*").alias("n"), F.count_if(F.col(chosen)).alias("r"), F.count_if(is_low).alias("low"), F.count_if(is_low & F.col(chosen)).alias("kept"))
    lost = F.when(F.col("n") > F.col("r"), F.greatest(F.lit(0), F.col("low") - F.col("kept"))).otherwise(0)
    return each.groupBy(entity).agg(F.sum("low").alias("low_rated"), F.sum("kept").alias("low_rated_kept"), F.count_if(F.col("n") > F.col("r")).alias("clusters_that_drop"), F.sum(lost).alias("low_rated_dropped"))


def fixed_domain(df: DataFrame, value: str, domain: Sequence[str]) -> DataFrame:
    """Counts for every value of the domain, zeros included."""
    names = df.sparkSession.createDataFrame([(x,) for x in domain], "value string")
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def rare_register(claims: DataFrame, cluster: str, entity: str, id_: str, text: str, rating: str, terms: Mapping[str, Sequence[str]], most: int = 3) -> DataFrame:
    """Claims with at least one reason to be kept: lexicon hits, small clusters, unusual ratings.

    An id is kept once, from its first cluster and text in order.
    """
    sizes = claims.groupBy(cluster).agg(F.count("*").alias("__n"))
    usual = mode(claims, [entity], rating)
    means = claims.groupBy(entity).agg(F.avg(rating).alias("__mean"))
    rows = claims.join(sizes, cluster).join(usual, entity, "left").join(means, entity, "left")
    small, negative = F.col("__n") <= most, contains_any(F.col(text), terms.get("negative", ()))
    odd = F.abs(F.col(rating) - F.coalesce(F.col("mode"), F.col("__mean"))) >= 2
    reasons: list[tuple[str, Column]] = [("rare_negative_claim", (F.col("__n") == 1) & negative), ("low_frequency_negative_claim", small & negative)]
    reasons += [(name, contains_any(F.col(text), terms.get(key, ()))) for key, name in (("disruption", "possible_major_disruption_language"), ("security", "security_related_topic"), ("accessibility", "accessibility_related_topic"), ("hygiene", "hygiene_related_topic"))]
    reasons.append(("contradictory_to_dominant_rating_pattern", small & odd))
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in reasons]))
    return rows.withColumn("retrieval_reason", F.concat_ws(";", found)).where("retrieval_reason <> ''").select(entity, id_, F.col(text), F.col(rating), "retrieval_reason", cluster).groupBy(id_).agg(F.min_by(F.struct(entity, text, rating, "retrieval_reason", cluster), F.struct(F.col(cluster), F.col(text), F.col("retrieval_reason"))).alias("__r")).select("__r." + entity, id_, "__r." + text, "__r." + rating, "__r.retrieval_reason", "__r." + cluster)


def method_coverage(claims: DataFrame, review: str, method: str) -> DataFrame:
    """Review- and claim-level coverage by method, in percent."""
    one = claims.select(review, method).dropDuplicates([review])
    pct = lambda m: F.round(100 * F.count_if(F.col(method) == m) / F.greatest(F.count("*"), F.lit(1)), 4)
    a = one.agg(F.count("*").alias("total_reviews"), pct("deberta_absa").alias("real_pct"), pct("distilled_proxy").alias("proxy_pct"), pct("none").alias("missing_pct"))
    return a.crossJoin(claims.agg(F.count("*").alias("total_claims"), F.count_if(F.col(method) == "deberta_absa").alias("real_claims")))  # one row each


def grouping_comparison(labelled: DataFrame, spec: str, entity: str, cluster: str) -> DataFrame:
    """For each grouping method: clusters, singleton share of rows, largest, and how many exceed 50 and 100."""
    sizes = labelled.groupBy(spec, entity, cluster).agg(F.count("*").alias("s"))
    return sizes.groupBy(spec).agg(F.count("*").alias("clusters"), F.round(F.count_if(F.col("s") == 1) / F.sum("s"), 6).alias("singleton_share"), F.max("s").alias("largest"), F.count_if(F.col("s") > 50).alias("over_50"), F.count_if(F.col("s") > 100).alias("over_100"))


def usage_cost(df: DataFrame, entity: str, prices: Mapping[str, float]) -> DataFrame:
    """Sums of usage counters per entity and their cost, prices per million."""
    cost = sum((F.sum(c) * p for c, p in prices.items()), F.lit(0.0)) / 1e6
    return df.groupBy(entity).agg(*[F.sum(c).alias(c) for c in prices], F.round(cost, 6).alias("cost"))
