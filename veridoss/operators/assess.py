"""Ledgers and assessments checked against their source records, and mapped to display values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = "ABCDEFGH"


def evidence_ids(*arrays: str) -> Column:
    """All review ids of arrays of evidence items."""
    return F.concat(*[F.flatten(F.transform(F.coalesce(F.col(a), F.array().cast("array<struct<summary:string,review_ids:array<string>,recurrence:string>>")), lambda x: F.coalesce(x["review_ids"], F.array().cast("array<string>")))) for a in arrays])


def absent_citations(cited: DataFrame, records: DataFrame, entity: str, ids: str, id_: str, most: int = 30) -> DataFrame:
    """Per entity: cited ids that its records do not hold, the first few in order."""
    rows = cited.select(entity, F.explode(ids).alias(id_)).distinct()
    gone = rows.join(records.select(entity, id_), [entity, id_], "left_anti")
    return gone.groupBy(entity).agg(F.count("*").alias("n_absent"), F.slice(F.sort_array(F.collect_set(id_)), 1, most).alias("absent"))


def preflight(records: DataFrame, declared: DataFrame, entity: str, id_: str, text: str, text_hash: str) -> DataFrame:
    """Per entity: declared and actual counts, distinct ids, texts whose hash differs, and whether all is well."""
    got = records.groupBy(entity).agg(F.count("*").alias("n"), F.count_distinct(id_).alias("ids"), F.count_if(~F.sha2(F.col(text), 256).eqNullSafe(F.col(text_hash))).alias("bad_hashes"))
    both = declared.select(entity, "review_count").join(got, entity, "full_outer")
    return both.withColumn("ok", F.coalesce((F.col("review_count") == F.col("n")) & (F.col("n") == F.col("ids")) & (F.col("bad_hashes") == 0), F.lit(False)))


def check_ledgers(ledgers: DataFrame, chunks: DataFrame, entity: str) -> DataFrame:
    """Ledgers with an array of errors: identity, count and citations outside their chunk."""
    held = chunks.select(entity, "chunk_id", F.col("review_count").alias("__n"), F.transform("reviews", lambda r: r["review_id"]).alias("__ids"))
    both = ledgers.join(held, [entity, "chunk_id"], "left").withColumn("__cited", F.array_distinct(evidence_ids("positive_evidence", "concern_evidence")))
    absent = F.array_except("__cited", F.coalesce("__ids", F.array().cast("array<string>")))
    errors = F.array_compact(F.array(F.when(F.col("__n").isNull(), "no such chunk"), F.when(F.col("review_count") != F.col("__n"), "review_count differs"), F.when(F.size(absent) > 0, F.concat(F.lit("cited ids absent: "), F.concat_ws(",", F.slice(F.array_sort(absent), 1, 30))))))
    return both.withColumn("errors", errors).drop("__n", "__ids", "__cited")


def check_assessments(final: DataFrame, records: DataFrame, entity: str, labels: Mapping[str, str]) -> DataFrame:
    """Assessments with arrays of errors and warnings.

    Recurrence above C0 needs two concern ids, F to H need C2 or C3, C2 and C3 need two dates;
    one month only, or relevance P3, are warnings. Citations are exploded and joined, so no
    record table is gathered per entity.
    """
    wide = final.withColumns({"__all": F.array_distinct(F.concat(F.coalesce("material_evidence_ids", F.array().cast("array<string>")), evidence_ids("positive_evidence", "concern_evidence"))), "__concern": F.array_distinct(evidence_ids("concern_evidence"))})
    strong = F.array_distinct(F.flatten(F.transform(F.filter("concern_evidence", lambda x: x["recurrence"].isin("C2", "C3")), lambda x: x["review_ids"])))
    wide = wide.withColumn("__strong", F.coalesce(strong, F.array().cast("array<string>")))
    source = records.select(entity, "review_id", "review_date")
    cited = wide.select(entity, F.explode("__all").alias("review_id")).join(source.withColumn("__in", F.lit(True)), [entity, "review_id"], "left").groupBy(entity).agg(F.count_if(F.col("__in").isNull()).alias("__absent"))
    dates = wide.select(entity, F.explode("__strong").alias("review_id")).join(source, [entity, "review_id"]).where("review_date IS NOT NULL AND review_date <> ''").groupBy(entity).agg(F.count_distinct("review_date").alias("__dates"), F.count_distinct(F.substring("review_date", 1, 7)).alias("__months"))
    counts = records.groupBy(entity).agg(F.count("*").alias("__n"))
    both = wide.join(counts, entity, "left").join(cited, entity, "left").join(dates, entity, "left").na.fill(0, ["__absent", "__dates", "__months"])
    label = F.coalesce(*[F.when(F.col("band") == b, t) for b, t in labels.items()])
    rec = F.col("recurrence_level")
    errors = F.array_compact(F.array(
        F.when(F.col("__n").isNull(), "no source records"),
        F.when(F.col("evidence_review_count") != F.col("__n"), "evidence_review_count differs"),
        F.when(F.col("__absent") > 0, "cited ids absent"),
        F.when(~label.eqNullSafe(F.col("band_label")), "band label differs"),
        F.when(rec.isin("C1", "C2", "C3") & (F.size("__concern") < 2), "recurrence without two concern ids"),
        F.when(F.col("band").isin("F", "G", "H") & ~rec.isin("C2", "C3"), "band needs C2 or C3"),
        F.when(rec.isin("C2", "C3") & (F.col("__dates") < 2), "recurrence without two dates"),
    ))
    warnings = F.array_compact(F.array(F.when(rec.isin("C2", "C3") & (F.col("__dates") >= 2) & (F.col("__months") < 2), "one month only"), F.when(F.col("property_relevance_status") == "P3", "relevance P3")))
    return both.withColumns({"errors": errors, "warnings": warnings}).drop("__all", "__concern", "__strong", "__n", "__absent", "__dates", "__months")


def display_values(df: DataFrame, anchors: Mapping[tuple[str, str], float], band: str = "band", position: str = "band_position", name: str = "display_value") -> DataFrame:
    """A value for each (band, position) from a small fixed table."""
    table = df.sparkSession.createDataFrame([(b, p, v) for (b, p), v in anchors.items()], f"`{band}` string, `{position}` string, `{name}` double")
    return df.join(F.broadcast(table), [band, position], "left")
