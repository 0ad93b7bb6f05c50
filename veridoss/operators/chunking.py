"""Chronological chunks under a token budget, without Python on the executors.

The chunk that an item begins ends before the item in whose part of the running sum the budget runs out. So each
item points to the one that would begin the next chunk, and the chunks of an entity are the items that the
first one's pointers reach. Up to ITEMS items, an entity's are followed in one fold; beyond that, over tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoss.functions.scalars import token_estimate
from veridoss.sources.workspace import kept

ITEMS = 20_000
BROADCAST = 100_000  # entities over ITEMS whose names are broadcast; more are joined by key

# The fields of a review that a model is shown.
FIELDS = ("review_id", "review_date", "rating", "review_text", "duplicate_group_id", "semantic_cluster_id", "absa_aspect", "absa_sentiment", "absa_confidence", "absa_method", "absa_reusable_status")


def compact_review(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.struct(*fields)


def effective_budget(budget: int, least: int = 20_000, reserve: int = 8_000) -> int:
    return max(least, budget - reserve)


def assign_chunks(df: DataFrame, entity: str, date: str, id_: str, tokens: str, budget: int, items: int = ITEMS) -> DataFrame:
    """(entity, id, date, cost, chunk_no, chunks): items in order of date and id, a new chunk where one would not fit."""
    rows = df.select(F.col(entity).alias("e"), F.coalesce(F.col(date).cast("string"), F.lit("")).alias("d"), F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("i"), (F.col(tokens) + 4).cast("long").alias("n"))
    large = kept(rows.groupBy("e").count().where((F.col("count") > items) & F.col("e").isNotNull()).select(F.col("e").alias("__of")), "large")
    few = large.limit(BROADCAST + 1).count()
    if not few:
        got = fold_chunks(rows, budget)
    else:
        marked = F.broadcast(large) if few <= BROADCAST else large
        same = F.col("e") == F.col("__of")
        got = fold_chunks(rows.join(marked, same, "left_anti"), budget).unionByName(linked_chunks(rows.join(marked, same, "left_semi"), budget))
    return got.select(F.col("e").alias(entity), F.col("i").alias(id_), F.col("d").alias(date), F.col("n").alias("cost"), "chunk_no", "chunks")


def fold_chunks(rows: DataFrame, budget: int) -> DataFrame:
    """Chunks of (e, d, i, n) by a fold over an entity's sorted items, numbers and ids only."""
    lists = rows.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("d", "i", "n"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("seen"), F.array().cast("array<bigint>").alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["seen"] == 0) | (acc["used"] + x["n"] > budget)
        # one entry a chunk, not an item: the array is copied only where a chunk begins
        return F.struct(F.when(new, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), (acc["seen"] + 1).alias("seen"), F.when(new, F.concat(acc["cuts"], F.array(acc["seen"]))).otherwise(acc["cuts"]).alias("cuts"))

    cut = lists.withColumn("cuts", F.aggregate("items", start, step, lambda acc: acc["cuts"]))
    ends = F.transform("cuts", lambda c, k: F.struct(c.alias("from"), F.coalesce(F.get("cuts", k + 1), F.size("items").cast("long")).alias("to"), (k + 1).cast("long").alias("no")))
    parts = cut.select("e", "items", F.size("cuts").cast("long").alias("chunks"), F.explode(ends).alias("c"))
    return parts.select("e", "chunks", F.col("c.no").alias("chunk_no"), F.explode(F.slice("items", (F.col("c.from") + 1).cast("int"), (F.col("c.to") - F.col("c.from")).cast("int"))).alias("z")).select("e", "z.d", "z.i", "z.n", "chunk_no", "chunks")


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (e, p, k, ...) with the running sum of value by k within e: within a range p, and from the ranges before."""
    inside = F.sum(value).over(Window.partitionBy("e", "p").orderBy("k"))
    total = rows.groupBy("e", "p").agg(F.sum(value).alias("t"))
    before = total.select("e", "p", (F.sum("t").over(Window.partitionBy("e").orderBy("p")) - F.col("t")).alias("b"))
    return rows.withColumn("s", inside).join(before, ["e", "p"]).withColumn(name, F.col("s") + F.col("b")).drop("s", "b")


def linked_chunks(rows: DataFrame, budget: int) -> DataFrame:
    """The same over tables: ranges of sorted items, a pointer an item, and pointer doubling from each first item."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = kept(rows.repartitionByRange(n, "e", "d", "i", "n").withColumn("p", F.spark_partition_id()), "ranges")
    inside = placed.withColumns({"k": F.row_number().over(Window.partitionBy("e", "p").orderBy("d", "i", "n")).cast("long"), "one": F.lit(1).cast("long")})
    items = kept(_running(_running(inside, "one", "place").drop("one"), "n", "upto").withColumn("from", F.col("upto") - F.col("n")), "items")
    # items share the line of running sums among them; the one at from + budget begins the next chunk, or else the item after
    bucket = lambda x: F.floor(x / budget)
    parts = items.select("e", "place", "from", "upto", F.explode(F.sequence(bucket(F.col("from")), bucket(F.col("upto") - 1))).alias("g"))
    points = parts.select("e", "g", F.greatest("from", F.col("g") * budget).alias("at"), F.lit(0).alias("asks"), "place", "upto")
    asks = items.select("e", bucket(F.col("from") + budget).alias("g"), (F.col("from") + budget).alias("at"), F.lit(1).alias("asks"), "place", "upto")
    last = F.last(F.when(F.col("asks") == 0, F.struct("place", "upto")), ignorenulls=True).over(Window.partitionBy("e", "g").orderBy("at", "asks"))
    found = points.unionByName(asks).withColumn("to", last).where("asks = 1 AND at < to.upto")  # else all that follow fit
    jump = kept(found.select("e", F.col("place").alias("of"), F.greatest("to.place", F.col("place") + 1).alias("to")), "pointers")
    jump = kept(jump.join(items.select("e", F.col("place").alias("to")), ["e", "to"], "left_semi").select("e", "of", "to"), "pointers")
    begun, seen = kept(items.where("place = 1").select("e", "place"), "begun"), 0
    while (now := begun.count()) > seen:  # as many rounds as the number of chunks has binary digits
        seen = now
        reached = begun.join(jump, (begun["e"] == jump["e"]) & (begun["place"] == jump["of"])).select(begun["e"], jump["to"].alias("place"))
        begun = kept(begun.unionByName(reached).distinct(), "begun")
        beyond = jump.select(F.col("e"), F.col("of").alias("to"), F.col("to").alias("far"))
        jump = kept(jump.join(beyond, ["e", "to"]).select("e", "of", F.col("far").alias("to")), "pointers")
    marked = items.join(begun.withColumn("new", F.lit(1).cast("long")), ["e", "place"], "left").fillna(0, ["new"])
    chunks = begun.groupBy("e").agg(F.count("*").alias("chunks"))
    return _running(marked, "new", "chunk_no").join(chunks, "e").select("e", "d", "i", "n", "chunk_no", "chunks")


def chunk_plan(assigned: DataFrame, entity: str, date: str) -> DataFrame:
    """One row per chunk: label, date range, rows and cost."""
    label = F.format_string("%03d_of_%03d", F.col("chunk_no"), F.col("chunks"))
    return assigned.groupBy(entity, "chunk_no", "chunks").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("review_count"), F.sum("cost").alias("cost")).withColumn("chunk_id", label)


def build_chunks(records: DataFrame, entity: str, budget: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Chunks with their reviews nested, costs estimated from each review's JSON."""
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    costed = records.withColumn("__t", token_estimate(body))
    at = assign_chunks(costed, entity, "review_date", "review_id", "__t", effective_budget(budget)).select(entity, "review_id", "chunk_no", "chunks")
    rows = records.join(at, [entity, "review_id"])
    nested = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("review_date", F.lit("")).alias("d"), F.col("review_id").alias("i"), F.struct(*fields).alias("r")))), lambda x: x["r"])
    return rows.groupBy(entity, "chunk_no", "chunks").agg(F.count("*").alias("review_count"), F.struct(F.min("review_date").alias("start"), F.max("review_date").alias("end")).alias("chunk_date_range"), nested.alias("reviews")).select(entity, F.format_string("%03d_of_%03d", "chunk_no", "chunks").alias("chunk_id"), "chunk_date_range", "review_count", "reviews")


def plan_totals(plan: DataFrame, entity: str) -> DataFrame:
    per = plan.groupBy(entity).agg(F.count("*").alias("chunks"), F.sum("review_count").alias("reviews"))
    return per.agg(F.count("*").alias("entities"), F.sum("chunks").alias("chunk_calls"), F.sum("reviews").alias("reviews"), F.max("chunks").alias("most_chunks"), (F.sum("chunks") + F.count("*")).alias("planned_calls"))
