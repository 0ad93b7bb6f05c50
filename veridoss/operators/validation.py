"""Checks as rows (check, n_bad, examples); a report is one union, a failure one raise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoss.functions.scalars import below, blank, close, finite, missing, to_date, tokens_forbidden

METHOD_STATUS = {"deberta_absa": ("REAL",), "distilled_proxy": ("PROXY",), "none": ("UNKNOWN", "NO_RESULT")}


class ValidationFailure(ValueError):
    """A check found bad rows."""


def tallies(each: DataFrame, id_: str, counts: dict[str, Column], examples: int = 5) -> DataFrame:
    """A row a check: the sum of its count over the rows of each, and the first few ids in order, as texts, where it is above 0.

    each is an aggregate by id: sums and ids are then told from one exchange, and a query without the examples makes none of them.
    The ids are cut to a few before they leave a task.
    """
    from pyspark.sql import Window

    names = list(counts)
    sums = each.agg(*[F.coalesce(F.sum(counts[k]), F.lit(0)).alias(f"c{i}") for i, k in enumerate(names)])
    total = sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("n_bad")) for i, k in enumerate(names)])))
    found = each.select(F.col(id_).cast("string").alias("__id"), F.explode(F.array_compact(F.array(*[F.when(counts[k] > 0, F.lit(k)) for k in names]))).alias("__of"))
    place = F.dense_rank().over(Window.partitionBy("__of").orderBy(F.asc_nulls_last("__id")))
    top = found.withColumn("__r", place).where(F.col("__r") <= examples).groupBy("__of").agg(F.sort_array(F.collect_set("__id")).alias("__few"))
    return total.join(top, F.col("check") == F.col("__of"), "left").select("check", "n_bad", F.coalesce("__few", F.array().cast("array<string>")).alias("examples"))


def check(df: DataFrame, name: str, bad: Column, id_: str, examples: int = 5) -> DataFrame:
    """How many rows are bad, with the first few ids in order as texts."""
    each = df.where(bad).select(F.col(id_).alias("__id")).groupBy("__id").agg(F.count("*").alias("__n"))
    return tallies(each, "__id", {name: F.col("__n")}, examples)


def key_checks(df: DataFrame, id_: str, table: str) -> list[DataFrame]:
    many = df.groupBy(id_).agg(F.count("*").alias("n"))
    return [check(df, f"{table}_id_missing", missing(F.col(id_)), id_), check(many, f"{table}_id_repeats", F.col("n") > 1, id_)]


def review_checks(df: DataFrame, id_: str, text: str, date: str, rating: str, text_hash: str | None = None) -> list[DataFrame]:
    value = F.col(rating).try_cast("double")
    out = [check(df, "text_blank", blank(F.col(text)), id_), check(df, "date_unparsed", to_date(F.col(date)).isNull(), id_), check(df, "rating_outside_1_to_5", ~F.coalesce(value.between(1, 5), F.lit(False)), id_)]
    if text_hash:
        out.append(check(df, "text_hash_differs", ~F.sha2(F.col(text), 256).eqNullSafe(F.col(text_hash)), id_))
    return out


def agreement_checks(a: DataFrame, b: DataFrame, id_: str, exact: Sequence[str] = (), near: Sequence[str] = ()) -> list[DataFrame]:
    """Fields that must be the same, or numbers that must be close, in two tables by id; and the ids."""
    fields = [*exact, *near]
    both = a.select(id_, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("ia")).join(b.select(id_, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("ib")), id_, "full_outer")
    out = [check(both, "ids_on_one_side", F.col("ia").isNull() | F.col("ib").isNull(), id_)]
    here = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    out += [check(both, f"{f}_differs", here & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), id_) for f in exact]
    return out + [check(both, f"{f}_differs", here & ~F.coalesce(close(F.col(f"a_{f}"), F.col(f"b_{f}")), F.lit(False)), id_) for f in near]


def method_checks(df: DataFrame, id_: str, method: str, status: str, statuses: dict[str, tuple[str, ...]] = METHOD_STATUS) -> list[DataFrame]:
    fits = F.lit(False)
    for m, allowed in statuses.items():
        fits = fits | ((F.col(method) == m) & F.col(status).isin(*allowed))
    return [check(df, "method_unknown", ~F.coalesce(F.col(method).isin(*statuses), F.lit(False)), id_), check(df, "status_contradicts_method", ~F.coalesce(fits, F.lit(False)), id_)]


def vector_checks(df: DataFrame, id_: str, vector: str) -> list[DataFrame]:
    sizes = df.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"))
    return [check(df, "vector_not_finite", ~F.coalesce(finite(F.col(vector)), F.lit(False)), id_), sizes.select(F.lit("vector_sizes_differ").alias("check"), (F.col("lo") != F.col("hi")).cast("long").alias("n_bad"), F.array().cast("array<string>").alias("examples"))]


def namespace_checks(df: DataFrame, id_: str, namespace: str, forbidden: Sequence[str]) -> list[DataFrame]:
    return [check(df, "forbidden_token", tokens_forbidden(F.col(namespace), forbidden), id_)]


def column_check(df: DataFrame, required: Sequence[str], name: str = "columns_missing") -> DataFrame:
    lacking = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([(name, len(lacking), lacking)], "check string, n_bad long, examples array<string>")


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).withColumn("ok", F.coalesce(F.col("n_bad"), F.lit(0)) == 0)


def require(checks: DataFrame) -> None:
    """Raise with every failed check; the report has one row a check."""
    if bad := [f"{r['check']}: {r['n_bad']} {list(r['examples'])}" for r in checks.where(~F.col("ok")).collect()]:
        raise ValidationFailure("; ".join(bad))


def cluster_output_checks(records: DataFrame, chosen: DataFrame, id_: str, cluster: str) -> list[DataFrame]:
    """Each id once; each representative stands in the cluster that names it."""
    pairs = chosen.select(id_, F.col(cluster).alias("c")).join(records.select(id_, F.col(cluster).alias("r"), F.lit(True).alias("found")), id_, "left")
    return [*key_checks(records, id_, "records"), check(records, "no_cluster", F.col(cluster).isNull(), id_), check(pairs, "representative_unresolved", F.col("found").isNull(), id_), check(pairs, "representative_misassigned", F.col("r").isNotNull() & (F.col("r") != F.col("c")), id_)]


def package_checks(claims: DataFrame, reviews: DataFrame, vectors: DataFrame, chosen: DataFrame, compact: DataFrame, rare: DataFrame, estimates: DataFrame, dimension: int, most_tokens: int = 25_000) -> list[DataFrame]:
    """A whole claim package as one set of checks; every table is laid together by its key, none is held anywhere.

    claims: claim_id, review_id, claim_text, claim_text_sha256, cluster_id. reviews: review_id. vectors: claim_id,
    embedding. chosen (representatives): claim_id, cluster_id. compact and rare: claim_id. estimates: entity and
    token_estimate. Ids and hashes agree; claims and reviews cover each other; each claim has one vector of the
    dimension; a representative stands in the cluster that names it; a compact document shows claims that exist,
    and all the rare ones; no document is over its budget.

    Claims are grouped with representatives by id and cluster, then with the other tables by id, and once with reviews:
    all checks on ids are sums over these. A null id is that of no other table.
    """
    one, none = F.lit(1), F.lit(0)
    pairs = claims.select("claim_id", "cluster_id", one.alias("n"), none.alias("chosen")).unionByName(chosen.select("claim_id", "cluster_id", none.alias("n"), one.alias("chosen"))).groupBy("claim_id", "cluster_id").agg(F.sum("n").alias("n"), F.max("chosen").alias("chosen"))
    stray = (F.col("chosen") == 1) & ((F.col("n") == 0) | F.col("claim_id").isNull() | F.col("cluster_id").isNull())
    rows = pairs.select("claim_id", "n", stray.cast("int").alias("stray"), F.when(F.col("n") > 0, 1).otherwise(0).alias("held"))
    for df, bit in ((vectors, 2), (compact, 4), (rare, 8)):
        rows = rows.unionByName(df.select("claim_id", none.alias("n"), none.alias("stray"), F.lit(bit).alias("held")))
    by_claim = rows.groupBy("claim_id").agg(F.sum("n").alias("n"), F.sum("stray").alias("stray"), F.bit_or("held").alias("held"))
    by_review = claims.select("review_id", one.alias("held")).unionByName(reviews.select("review_id", F.lit(2).alias("held"))).groupBy("review_id").agg(F.bit_or("held").alias("held"))

    def lacking(a: int, b: int, id_: str) -> Column:
        held = F.col("held")
        return ((held.bitwiseAND(a) != 0) & ((held.bitwiseAND(b) == 0) | F.col(id_).isNull())).cast("int")

    on_claims = {
        "claims_id_missing": F.when(missing(F.col("claim_id")), F.col("n")).otherwise(0),
        "claims_id_repeats": (F.col("n") > 1).cast("int"),
        "claim_without_vector": lacking(1, 2, "claim_id"),
        "vector_of_no_claim": lacking(2, 1, "claim_id"),
        "representative_misassigned": F.col("stray"),
        "compact_claim_unknown": lacking(4, 1, "claim_id"),
        "rare_claim_not_shown": lacking(8, 4, "claim_id"),
    }
    return [
        tallies(by_claim, "claim_id", on_claims),
        tallies(by_review, "review_id", {"claims_of_no_review": lacking(1, 2, "review_id"), "review_without_claims": lacking(2, 1, "review_id")}),
        check(claims, "claim_hash_differs", ~F.sha2(F.coalesce("claim_text", F.lit("")), 256).eqNullSafe(F.col("claim_text_sha256")), "claim_id"),
        check(vectors, "vector_of_other_size", ~F.coalesce((F.size("embedding") == dimension) & finite(F.col("embedding")), F.lit(False)), "claim_id"),
        check(estimates, "over_budget", F.coalesce(F.col("token_estimate"), F.lit(0)) > most_tokens, estimates.columns[0]),
    ]


def count_checks(counts: dict[str, DataFrame], declared: int | None = None) -> DataFrame:
    """One check: whether all tables have the same number of rows, and the declared one; examples say which have what."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).withColumn("t", F.lit(name)) for name, df in counts.items()])
    want = F.lit(declared) if declared is not None else F.max("n")
    wrong = (F.min("n") != F.max("n")) | (F.max("n") != want)
    return rows.agg(wrong.cast("long").alias("n_bad"), F.sort_array(F.collect_list(F.concat_ws("=", "t", F.col("n").cast("string")))).alias("examples")).select(F.lit("row_counts_differ").alias("check"), "n_bad", "examples")


def shape_checks(df: DataFrame, name: str, required: Sequence[str], forbidden: Sequence[str] = ()) -> list[DataFrame]:
    """Whether a table has the required columns, and none of its keys, nested ones included, is a forbidden word."""
    found = sorted(set(nested_keys(df.schema)) & set(forbidden))
    return [column_check(df, required, f"{name}_keys_missing"), df.sparkSession.createDataFrame([(f"{name}_keys_forbidden", len(found), found)], "check string, n_bad long, examples array<string>")]


def nested_keys(kind) -> list[str]:
    """Field names of a schema at any depth."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in [f.name, *nested_keys(f.dataType)]]
    if isinstance(kind, ArrayType):
        return nested_keys(kind.elementType)
    return nested_keys(kind.valueType) if isinstance(kind, MapType) else []


def file_checks(spark, folder: str, names: Sequence[str]) -> DataFrame:
    """One check: which of a folder's files are missing, asked of whatever store the folder is in."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lacking = [n for n in names if not fs.exists(jvm.org.apache.hadoop.fs.Path(root, n))]
    return spark.createDataFrame([("files_missing", len(lacking), lacking)], "check string, n_bad long, examples array<string>")


def missing_files(spark, folder: str, wanted: DataFrame, path: str = "path") -> DataFrame:
    """Rows of wanted whose path, relative to the folder, names no file below it. The folder is listed; no file is opened.

    A file of no bytes counts as missing, as does a null path.
    """
    here = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return wanted.join(here.select(below("path", folder).alias(path)).distinct(), path, "left_anti")


def map_checks(clusters: DataFrame, sample: DataFrame, id_: str) -> list[DataFrame]:
    """A frozen cluster map has each of the sample's ids once and no other."""
    both = clusters.select(id_, F.lit(1).alias("a")).distinct().join(sample.select(id_, F.lit(1).alias("b")).distinct(), id_, "full_outer")
    return [*key_checks(clusters, id_, "map"), check(both, "map_ids_differ", F.col("a").isNull() | F.col("b").isNull(), id_)]


def sample_report(df: DataFrame, text: str, aspects: str, confidence: str, date: str, rating: str, group: str) -> DataFrame:
    """One row on a sample: filled columns, dates, mean rating, rows with repeated texts and rows in a duplicate group."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    again = df.groupBy(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("exact_duplicate_text_rows"))
    whole = df.agg(F.count("*").alias("rows"), F.count_if(filled(aspects)).alias("with_aspects"), F.count(confidence).alias("with_confidence"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.round(F.avg(rating), 4).alias("mean_rating"), F.count_if(filled(group)).alias("duplicate_group_rows"))
    return whole.crossJoin(again)  # one row each


def verdict(failed: Column, warned: Column) -> Column:
    return F.when(failed, "FAIL").when(warned, "PASS WITH WARNINGS").otherwise("PASS")
