"""Period summaries, anchored windows, coverage, gaps and aspect roll-ups per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoss.functions.scalars import packed, packed_labels, packed_scores, quarter_label, year_label


def distribution(df: DataFrame, keys: list[str], value: str, keep_null: bool = True) -> DataFrame:
    """(keys, value as text, n): counts of each value; nulls count as "nan" or are left out."""
    df = df if keep_null else df.where(F.col(value).isNotNull())
    return df.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("nan")).alias("value")).agg(F.count("*").alias("n"))


def distribution_map(df: DataFrame, keys: list[str], value: str, name: str, keep_null: bool = True) -> DataFrame:
    """The same as one map per key, in order of value."""
    d = distribution(df, keys, value, keep_null)
    return d.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))


def polarity(sentiment: str, mode: str = "numeric") -> list[Column]:
    """Counts of positive, negative and neutral scores over all rows of a group."""
    scores = (packed_scores if mode == "numeric" else packed_labels)(F.col(sentiment))
    count = lambda f: F.coalesce(F.sum(F.size(F.filter(scores, f))), F.lit(0)).cast("long")
    return [count(lambda s: s > 0).alias("positive"), count(lambda s: s < 0).alias("negative"), count(lambda s: s == 0).alias("neutral")]


def period_summary(df: DataFrame, entity: str, date: str, rating: str, sentiment: str | None = None, period: str = "year", mode: str = "numeric") -> DataFrame:
    """Per entity and year or quarter: rows, mean rating and polarity. An unknown date is "NaT"."""
    label = (year_label if period == "year" else quarter_label)(F.col(date))
    extra = polarity(sentiment, mode) if sentiment else []
    return df.groupBy(entity, label.alias("period")).agg(F.count("*").alias("review_count"), F.avg(rating).alias("mean_rating"), *extra)


def anchored_windows(df: DataFrame, entity: str, date: str, windows: dict[str, int]) -> DataFrame:
    """Rows on or after, and before, the entity's last date less each number of days.

    Two map-side-combined aggregates, by day and then by entity, in place of a window over
    all of an entity's rows, so a hot entity shuffles one row a day.
    """
    days = df.where(F.col(date).isNotNull()).groupBy(entity, F.col(date).alias("d")).agg(F.count("*").alias("n"))
    last = days.groupBy(entity).agg(F.max("d").alias("anchor"))
    both = days.join(last, entity)
    aggs = []
    for name, size in windows.items():
        inside = F.col("d") >= F.col("anchor") - F.expr(f"INTERVAL {int(size)} DAYS")
        aggs += [F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("long").alias(name), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("long").alias(f"before_{name}")]
    return both.groupBy(entity).agg(F.date_format(F.max("anchor"), "yyyy-MM-dd").alias("anchor_date"), *aggs)


def fixed_windows(df: DataFrame, entity: str, date: str, id_: str, cutoff: str, windows: dict[str, int]) -> DataFrame:
    """Rows and distinct ids in (cutoff - n days, cutoff], for each n, and earlier than the longest."""
    end = F.lit(cutoff).cast("timestamp")
    aggs = []
    for name, size in windows.items():
        inside = (F.col(date) <= end) & (F.col(date) > end - F.expr(f"INTERVAL {int(size)} DAYS"))
        aggs += [F.count_if(inside).alias(f"{name}_rows"), F.count_distinct(F.when(inside, F.col(id_))).alias(f"{name}_ids")]
    early = F.col(date) <= end - F.expr(f"INTERVAL {max(windows.values())} DAYS")
    return df.groupBy(entity).agg(*aggs, F.count_if(early).alias("earlier_rows"), F.count_distinct(F.when(early, F.col(id_))).alias("earlier_ids"))


def coverage(df: DataFrame, entity: str, date: str) -> DataFrame:
    return df.groupBy(entity).agg(F.date_format(F.min(date), "yyyy-MM-dd").alias("minimum_date"), F.date_format(F.max(date), "yyyy-MM-dd").alias("maximum_date"), F.count_distinct(F.year(date)).alias("active_years"), F.count_distinct(F.year(date) * 4 + F.quarter(date)).alias("active_quarters"), F.count("*").alias("review_count"))


def date_gaps(df: DataFrame, entity: str, date: str) -> DataFrame:
    """One row per positive gap in whole days between an entity's dates in order.

    Equal dates give no gap, so distinct dates are enough and are formed before the shuffle.
    """
    d = df.where(F.col(date).isNotNull()).select(entity, F.col(date).alias("d")).distinct()
    w = Window.partitionBy(entity).orderBy("d")
    gap = F.floor((F.unix_micros(F.col("d").cast("timestamp")) - F.unix_micros(F.lag("d").over(w).cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
    return d.select(entity, F.col("d"), gap.alias("gap_days")).where("gap_days > 0")


def aspect_rollup(df: DataFrame, entity: str, aspects: str, date: str) -> DataFrame:
    """Per entity and aspect: mentions, first and last date, active years. Repeats count."""
    rows = df.select(entity, F.explode(packed(F.col(aspects))).alias("aspect"), F.col(date).alias("d"))
    return rows.groupBy(entity, "aspect").agg(F.count("*").alias("mentions"), F.date_format(F.min("d"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("latest_date"), F.array_sort(F.collect_set(F.year("d"))).alias("active_years"), F.count_distinct(F.year("d")).alias("active_period_count"))


def aspect_years(df: DataFrame, entity: str, aspects: str, date: str) -> DataFrame:
    """Mentions for every (year, aspect) of an entity, zero where there is none.

    The years and aspects of an entity are joined on the entity, after both were made distinct.
    """
    years = df.where(F.col(date).isNotNull()).select(entity, F.year(date).alias("year")).distinct()
    rows = df.select(entity, F.year(date).alias("year"), F.explode(packed(F.col(aspects))).alias("aspect"))
    counts = rows.groupBy(entity, "year", "aspect").agg(F.count("*").alias("n"))
    names = counts.select(entity, "aspect").distinct()
    return years.join(names, entity).join(counts, [entity, "year", "aspect"], "left").select(entity, "year", "aspect", F.coalesce("n", F.lit(0)).cast("long").alias("mentions"))


def temporal_document(df: DataFrame, entity: str, date: str, rating: str, sentiment: str, aspects: str, windows: dict[str, int], mode: str = "numeric") -> DataFrame:
    """All of the above as one nested row per entity."""
    def periods(kind: str) -> DataFrame:
        key = f"by_{kind}"
        base = period_summary(df, entity, date, rating, sentiment, kind, mode)
        label = (year_label if kind == "year" else quarter_label)(F.col(date))
        dist = distribution_map(df.withColumn("period", label), [entity, "period"], rating, "rating_distribution")
        item = F.struct("period", "review_count", "mean_rating", "rating_distribution", F.struct("positive", "negative", "neutral").alias("absa_polarity_counts"))
        return base.join(dist, [entity, "period"]).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col("period").alias("k"), F.to_json(item).alias("v")))).alias("x")).select(entity, F.transform("x", lambda x: x["v"]).alias(key))

    window = anchored_windows(df, entity, date, windows)
    window = window.select(entity, F.create_map(*[x for n, d in windows.items() for x in (F.lit(n), F.struct(F.lit(d).alias("days"), F.col(n).alias("review_count"), F.col(f"before_{n}").alias("historical_review_count"), "anchor_date"))]).alias("configured_windows"))
    gaps = date_gaps(df, entity, date).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("d", "gap_days"))).alias("g")).select(entity, F.transform("g", lambda g: g["gap_days"]).alias("date_gap_days"))
    cover = coverage(df, entity, date).join(gaps, entity, "left").select(entity, F.struct("minimum_date", "maximum_date", F.col("active_years").alias("active_year_count"), F.col("active_quarters").alias("active_quarter_count"), "review_count", F.coalesce("date_gap_days", F.array().cast("array<bigint>")).alias("date_gap_days")).alias("coverage"))
    roll = aspect_rollup(df, entity, aspects, date).groupBy(entity).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("aspect", F.struct("mentions", "first_date", "latest_date", "active_years", "active_period_count"))))).alias("aspects"))
    dense = aspect_years(df, entity, aspects, date).groupBy(entity, "year").agg(F.sort_array(F.collect_list(F.struct("aspect", "mentions"))).alias("m"))
    dense = dense.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string").alias("y"), "m"))).alias("x"))
    dense = dense.select(entity, F.map_from_entries(F.transform("x", lambda x: F.struct(x["y"], F.map_from_entries(x["m"])))).alias("aspect_counts_by_year"))
    out = periods("year").join(periods("quarter"), entity).join(cover, entity)
    for more in (window, roll, dense):
        out = out.join(more, entity, "left")
    return out
