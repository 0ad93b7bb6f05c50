"""Checked joins, ranking, deduplication, set operations and deterministic sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], required: bool = False) -> DataFrame:
    """A left join that fails while it runs if a key repeats on the right, or, if required, has no match.

    The check is part of the plan: the right side is grouped by key, which the join needs
    partitioned that way in any case; no second pass is made.
    """
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("__r"))
    joined = left.join(once, keys, "left")
    fine = F.coalesce(F.col("__n"), F.lit(0 if required else 1)) == 1
    guard = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit(f"{keys}: a key repeats or has no match")).cast("boolean"))
    return joined.where(guard).select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in rest])


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side's name; empty if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right_only")))


def membership_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: ids that agree, differ, or stand on one side only."""
    both = a.select(key, F.col(value).alias("va"), F.lit(True).alias("ia")).join(b.select(key, F.col(value).alias("vb"), F.lit(True).alias("ib")), key, "full_outer")
    here = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    return both.agg(F.count_if(here & F.col("va").eqNullSafe(F.col("vb"))).alias("matching"), F.count_if(here & ~F.col("va").eqNullSafe(F.col("vb"))).alias("mismatching"), F.count_if(F.col("ib").isNull()).alias("left_only"), F.count_if(F.col("ia").isNull()).alias("right_only"))


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: ids on both sides and on one, and for each field the number of shared ids where the sides differ."""
    both = a.select(key, F.lit(True).alias("ia"), *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(key, F.lit(True).alias("ib"), *[F.col(f).alias(f"b_{f}") for f in fields]), key, "full_outer")
    here = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    return both.agg(F.count_if(here).alias("compared"), F.count_if(F.col("ib").isNull()).alias("left_only"), F.count_if(F.col("ia").isNull()).alias("right_only"), *[F.count_if(here & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f) for f in fields])


def in_given_order(wanted: DataFrame, rows: DataFrame, key: str, position: str) -> DataFrame:
    """The rows of wanted's keys with their positions there; fails if a key has no row or several."""
    return join_one_to_one(wanted.select(key, position), rows, [key], required=True)


def lookup(df: DataFrame, lists: DataFrame, key: str, value: str) -> DataFrame:
    """df with the array that lists holds for its key, empty where it holds none."""
    found = lists.select(key, F.col(value).alias("__v"))
    kind = dict(lists.dtypes)[value]
    return df.join(found, key, "left").withColumn(value, F.coalesce("__v", F.array().cast(kind))).drop("__v")


def count_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of rows in two tables differ, with both numbers."""
    left, right = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((a, "left_rows"), (b, "right_rows")))
    both = left.join(right, key, "full_outer").na.fill(0, ["left_rows", "right_rows"])
    return both.where("left_rows <> right_rows")


def first_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of the first keys in order, all of each."""
    return semi(df, df.select(key).distinct().orderBy(key).limit(most), key)


def varied(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keys in which one of the columns has more than one value."""
    several = [F.count_distinct(v) > 1 for v in values]
    test = several[0]
    for more in several[1:]:
        test = test | more
    return df.groupBy(key).agg(test.alias("__t")).where("__t").select(key)


def ordered_lists(df: DataFrame, key: str, order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Per key: the values of columns as JSON arrays, in order; values: result name to column."""
    item = F.struct(*order, *[F.col(c).alias(f"__{n}") for n, c in values.items()])
    lists = df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("__x"))
    return lists.select(key, F.size("__x").cast("long").alias("n"), *[F.to_json(F.col(f"__x.__{n}")).alias(n) for n in values])


def absent_ids(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct ids of part whole lacks, and whether part is a subset."""
    return anti(part.select(key).distinct(), whole, key).agg(F.count("*").alias("n_absent"), (F.count("*") == 0).alias("is_subset"))


def position_mismatches(a: DataFrame, b: DataFrame, position: str, id_: str) -> DataFrame:
    """Positions at which two tables do not hold the same id: order compared through its column."""
    both = a.select(position, F.col(id_).alias("ida")).join(b.select(position, F.col(id_).alias("idb")), position, "full_outer")
    return both.where(~F.col("ida").eqNullSafe(F.col("idb")))


def order_faults(a: DataFrame, b: DataFrame, position: str, id_: str, width: int = 100_000) -> DataFrame:
    """``position_mismatches`` without a full join: ranges of positions whose digests agree are not compared by row.

    A digest adds up hashes of (position, id), two of them for each row, so it depends on order and holds for
    repeated positions; one row a range is joined. Rows are shuffled in ranges that differ alone. Positions are whole numbers;
    rows without one form a range of their own.
    """
    span = lambda: F.floor(F.col(position) / width)
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), position, F.col(id_).cast("string")).cast("decimal(38,0)"))

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(span().alias("__r")).agg(F.struct(F.count("*"), total(1), total(2)).alias(name))

    one, two = digest(a, "__x"), digest(b, "__y").withColumnRenamed("__r", "__q")
    bad = one.join(two, F.col("__r").eqNullSafe(F.col("__q")), "full_outer").where(~F.col("__x").eqNullSafe(F.col("__y"))).select(F.coalesce("__r", "__q").alias("__bad"))
    mine = lambda df: df.join(bad, span().eqNullSafe(F.col("__bad")), "left_semi")
    return position_mismatches(mine(a), mine(b), position, id_)


def contiguous(df: DataFrame, position: str) -> DataFrame:
    """One row: whether positions are 0..n-1, each once."""
    return df.agg((F.coalesce(F.min(position), F.lit(0)) == 0).alias("from_zero"), (F.coalesce(F.max(position), F.lit(-1)) == F.count("*") - 1).alias("to_end"), (F.count_distinct(position) == F.count("*")).alias("each_once"))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order (reverse the order to keep the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def exact_duplicates(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text occurs more than once; texts are compared by hash, so none is shuffled twice."""
    keyed = df.withColumn("__h", F.sha2(text, 256))
    many = keyed.groupBy("__h").agg(F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(many, "__h").drop("__h")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """At most k rows per key; Spark keeps k rows per key in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The commonest value of each key, the smallest of several; null where all are null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"))


def stable_rank(entity: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), entity.cast("string")), 256)


def sample_entities(df: DataFrame, entity: str, target: int, seed: int) -> DataFrame:
    """Whole entities in hash order until at least target rows are reached; fails if there are fewer.

    The running sum over entities is taken in two steps - totals of hash ranges, then within
    the ranges - so no task sees all entities.
    """
    if target <= 0:
        raise ValueError("target must be positive")
    counts = df.groupBy(F.col(entity).cast("string").alias(entity)).agg(F.count("*").alias("n")).withColumn("rank_hash", stable_rank(F.col(entity), seed)).withColumn("__p", F.substring("rank_hash", 1, 3))
    totals = counts.groupBy("__p").agg(F.sum("n").alias("t"))  # 4096 rows at most
    before = totals.select("__p", (F.sum("t").over(Window.orderBy("__p")) - F.col("t")).alias("__before"))
    inside = F.sum("n").over(Window.partitionBy("__p").orderBy("rank_hash", entity))
    ran = counts.join(F.broadcast(before), "__p").withColumn("running", inside + F.col("__before"))
    whole = F.broadcast(totals.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("__all")))
    guard = F.when(F.col("__all") >= target, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the input holds fewer rows than the target: "), F.col("__all").cast("string"))).cast("boolean"))
    return ran.join(whole, F.lit(True)).where(guard).where(F.col("running") - F.col("n") < target).select(entity, "n", "rank_hash", "running")


def renumber(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Consecutive numbers from 0 by a column of distinct numbers: ranges are sorted in
    parallel and their sizes added up, so no task sees all rows."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    held = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    placed = df.withColumn("__p", F.size(F.filter(held, lambda b: b <= F.col(order))))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # n rows
    w = Window.partitionBy("__p").orderBy(order)
    return placed.withColumn("__r", F.row_number().over(w)).join(F.broadcast(before), "__p").withColumn(name, (F.col("__r") - 1 + F.col("__b")).cast("long")).drop("__p", "__r", "__b")


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def reference_codes(df: DataFrame, id_: str, prefix: str, within: str | None = None) -> DataFrame:
    """Ids with codes such as r0001 by their order, within each group where one is named.

    Without a group, numbers come from ``renumber``: ids must be numbers then, and no task sees all.
    """
    if within is None:
        return renumber(df.select(id_).distinct(), id_, "__n").select(id_, F.format_string(f"{prefix}%04d", F.col("__n") + 1).alias("code"))
    return df.select(within, id_).distinct().withColumn("code", F.format_string(f"{prefix}%04d", F.row_number().over(Window.partitionBy(within).orderBy(id_))))


def precedence(ids: DataFrame, first: DataFrame, second: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """Each id with the first name if it is in first, the second if in second, else the third."""
    a = first.select(key).distinct().withColumn("__a", F.lit(True))
    b = second.select(key).distinct().withColumn("__b", F.lit(True))
    return ids.join(a, key, "left").join(b, key, "left").withColumn("status", F.when(F.col("__a"), names[0]).when(F.col("__b"), names[1]).otherwise(names[2])).drop("__a", "__b")
