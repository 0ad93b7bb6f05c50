"""Connected components within entities, over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoss.sources.workspace import kept


def components(edges: DataFrame, entity: str = "e", a: str = "u", b: str = "v", most_rounds: int = 100) -> DataFrame:
    """(entity, id, component) of every id on an edge within an entity; the component is its smallest id.

    Each round an id takes the least label around it, and then that label's own label. A round's labels are a
    table, so lineage stays short; the driver gets the number of changes.
    """
    ends = edges.select(F.col(entity).alias("e"), F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = kept(ends.select("e", F.inline(ways)).distinct(), "edges")  # edges are made once: made again they may be others
    label = kept(both.groupBy("e", F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("c")), "labels")
    for _ in range(most_rounds):
        around = both.join(label.withColumnRenamed("id", "v"), ["e", "v"]).groupBy("e", F.col("u").alias("id")).agg(F.min("c").alias("m"))
        lower = label.join(around, ["e", "id"]).select("e", "id", "c", F.least("c", "m").alias("m"))
        beyond = lower.select("e", F.col("id").alias("m"), F.col("m").alias("far"))
        label = kept(lower.join(beyond, ["e", "m"]).select("e", "id", F.least("m", "far").alias("c"), (F.least("m", "far") != F.col("c")).alias("changed")), "labels")
        if not label.where("changed").limit(1).count():
            return label.select(F.col("e").alias(entity), "id", F.col("c").alias("component"))
        label = label.drop("changed")
    raise RuntimeError("components did not settle")
