"""Sources: Parquet with declared schemas, JSON folders, CSV manifests, archives, signed definitions."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import asdict
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.config import Settings, laid_over, parse_yaml
from veridoss.operators.absa import specs_of
from veridoss.schemas import ALIASES, FEATURES, MAPPING, REVIEWS


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEWS).parquet(path)


def mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPING).parquet(path)


def features(spark: SparkSession, path: str, entities: Sequence[str] | None = None, schema: str = FEATURES) -> DataFrame:
    """Features with aliases added where absent; a list of entities is pushed down to the scan."""
    df = spark.read.schema(schema).parquet(path)
    if entities is not None:
        df = df.where(F.col("hotel_id").isin(list(entities)))
    return df.withColumns({new: F.col(old) for old, new in ALIASES.items() if old in df.columns and new not in df.columns})


def embeddings(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """(review_id, position, embedding) from an npz archive's emb and review_id, read once in one task.

    The archive is one compressed file and cannot be split; convert it to Parquet once.
    """

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if lacking := {"emb", "review_id", "method"} - set(z.files):
                        raise ValueError(f"the archive lacks {sorted(lacking)}")
                    if method and str(z["method"]) != method:
                        raise ValueError(f"embedding method is {z['method']}, not {method}")
                    ids, vectors = z["review_id"].astype(str), z["emb"].astype("float32")
                    if len(ids) != len(vectors):
                        raise ValueError("ids and vectors differ in number")
                    for at in range(0, len(ids), 10_000):
                        yield pd.DataFrame({"review_id": ids[at : at + 10_000], "position": range(at, min(at + 10_000, len(ids))), "embedding": list(vectors[at : at + 10_000])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "review_id string, position long, embedding array<float>")


def packed_embeddings(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """(review_id, row, embedding) of archives written by ``writers.npz``, each unpacked where it is read."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if method and str(z["method"]) != method:
                        raise ValueError(f"embedding method is {z['method']}, not {method}")
                    ids, vectors = z["review_id"], z["emb"]
                for at in range(0, len(ids), 10_000):
                    yield pd.DataFrame({"review_id": ids[at : at + 10_000], "row": range(at, min(at + 10_000, len(ids))), "embedding": list(vectors[at : at + 10_000])})

    return spark.read.parquet(path).select("content").mapInPandas(load, "review_id string, row long, embedding array<float>")


def in_order(vectors: DataFrame, expected: DataFrame, id_: str, position: str) -> DataFrame:
    """vectors, failing while they are read if an id stands at another position than expected, or at none."""
    want = expected.select(F.col(id_), F.col(position).alias("__want"))
    both = vectors.join(want, id_, "full_outer")
    fine = F.col(position).eqNullSafe(F.col("__want"))
    guard = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("out of order: "), F.coalesce(F.col(id_), F.lit("?")))).cast("boolean"))
    return both.where(guard).drop("__want")


def with_row_numbers(df: DataFrame, order: str, name: str = "input_row_position") -> DataFrame:
    """Rows numbered from 0 in order of a column of distinct numbers, made once when a table is taken in."""
    from veridoss.operators.relational import renumber

    return renumber(df, order, name)


def export_columns(df: DataFrame, candidates: dict[str, Sequence[str]], defaults: dict[str, object]) -> DataFrame:
    """The first present of each column's candidate names, or its default; a column with neither is an error."""
    out = []
    for name, names in candidates.items():
        found = next((n for n in names if n in df.columns), None)
        if found is None and name not in defaults:
            raise ValueError(f"none of {list(names)} is present for {name}")
        out.append((F.col(found) if found else F.lit(defaults[name])).alias(name))
    return df.select(*out)


def npz_shape(path: str, member: str = "emb.npy") -> tuple[int, ...]:
    """An array's shape from its header alone."""
    from numpy.lib import format as npy

    with zipfile.ZipFile(path) as z, z.open(member) as f:
        version = npy.read_magic(f)
        return (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)[0]


def gather(df: DataFrame, vectors: DataFrame, row: str) -> DataFrame:
    """Vectors by row number: a join, whatever the order of either side."""
    return df.join(vectors.select(F.col("position").alias(row), "embedding"), row, "left")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every JSON document below a folder or glob, one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def cluster_map(docs: DataFrame) -> DataFrame:
    """(review_id, hotel_id, semantic_cluster_id) of the records nested in dossiers."""
    return docs.select("hotel_id", F.explode("review_evidence_records").alias("r")).select("r.review_id", "hotel_id", "r.semantic_cluster_id")


def zipped_json(spark: SparkSession, path: str, schema: str, names: Sequence[str] | None = None) -> DataFrame:
    """(name, document) for the JSON members of zip archives below a path."""
    return unzipped(spark.read.format("binaryFile").load(path), "content", schema, names)


def unzipped(archives: DataFrame, content: str, schema: str, names: Sequence[str] | None = None) -> DataFrame:
    """(name, document) for the JSON members of zip archives in a column, unpacked where they are read."""
    wanted = None if names is None else set(names)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for body in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(".json") and (wanted is None or name in wanted):
                            yield pd.DataFrame({"name": [name], "body": [z.read(name).decode("utf-8")]})

    rows = archives.select(F.col(content).alias("content")).mapInPandas(unpack, "name string, body string")
    return rows.select("name", F.from_json("body", schema).alias("document"))


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Parts of a checkpoint folder with the part number from the file name."""
    df = spark.read.parquet(path)
    return df.withColumn("part_no", F.regexp_extract(F.input_file_name(), r"(\d+)[^/]*$", 1).try_cast("long"))


def hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, sha256 string, size_bytes long").option("header", True).csv(path)


def matched_requests(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Each requested id with the table's own id where it is known by that very text, else null."""
    return requests.select(key).distinct().join(known.select(key, F.col(key).alias("matched")).distinct(), key, "left")


def id_list(spark: SparkSession, path: str, column: str = "hotel_id") -> DataFrame:
    """Requested ids from a CSV with a header or a text file of one id a line, each once."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.text(path).withColumnRenamed("value", column)
    return df.select(F.trim(F.col(column)).alias(column)).where(F.col(column) != "").distinct()


def canonical_digest(payload: dict) -> str:
    """SHA-256 of the payload as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def sample_definition(path: str, key: str = "sample_definition_sha256") -> dict:
    """A definition whose own digest must hold."""
    return verified(Path(path).read_bytes(), key)


def verified(body: bytes, key: str = "sample_definition_sha256") -> dict:
    """The definition in a file's bytes; an error if it is no JSON object or does not match its own digest."""
    payload = json.loads(body.decode("utf-8"))
    if not isinstance(payload, dict):
        raise ValueError("the sample definition is no JSON object")
    stated = payload.pop(key, None)
    if stated != canonical_digest(payload):
        raise ValueError("the sample definition does not match its digest")
    return payload | {key: stated}


def signed_definitions(spark: SparkSession, path: str, schema: str, key: str = "sample_definition_sha256") -> DataFrame:
    """(file, definition, fault) for every file below a folder: the definition under the schema, or null and what is wrong.

    A file of no bytes has no row.
    """

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    body, fault = json.dumps(verified(content, key)), None
                except ValueError as e:
                    body, fault = None, "the sample definition is no JSON" if isinstance(e, (UnicodeDecodeError, json.JSONDecodeError)) else str(e)
                yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]], "body": pd.Series([body], dtype=object), "fault": pd.Series([fault], dtype=object)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(check, "file string, body string, fault string")
    return rows.select("file", F.from_json("body", schema).alias("definition"), "fault")


SETTINGS = "dataset_namespace string, grouping_method string, similarity_threshold double, random_seed long, representatives_per_cluster int, require_verified boolean, windows array<struct<name:string,days:int>>, allowed_methods array<string>, forbidden_tokens array<string>, polarity_mode string"
SPECS = "array<struct<canonical:string,aliases:array<string>>>"


def settings_files(spark: SparkSession, path: str, base: Settings = Settings()) -> DataFrame:
    """(file, settings, specs, fault) for every YAML file below a folder, read in tasks.

    settings are base with the file's keys laid over it; specs are the file's aspects with aliases each once and in
    order, null where it names none. A file that is no mapping, or has unknown keys, has a fault in place of both.
    A file of no bytes has no row.
    """

    def parse(content: bytes, name: str) -> dict:
        found = parse_yaml(content.decode("utf-8"), name)
        specs = specs_of(found) if "aspects" in found else None
        s = laid_over(base, {k: v for k, v in found.items() if k != "aspects"})
        values = asdict(s) | {"windows": [{"name": n, "days": d} for n, d in s.windows]}
        return {"settings": values, "specs": None if specs is None else [{"canonical": c, "aliases": a} for c, a in specs]}

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            for path_, content in zip(frame["path"], frame["content"], strict=True):
                name = path_.rsplit("/", 1)[-1]
                try:
                    body, fault = json.dumps(parse(content, name)), None
                except yaml.YAMLError:
                    body, fault = None, f"{name} is no YAML"
                except (ValueError, TypeError, KeyError) as e:
                    body, fault = None, str(e)
                yield pd.DataFrame({"file": [name], "body": pd.Series([body], dtype=object), "fault": pd.Series([fault], dtype=object)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(load, "file string, body string, fault string")
    d = F.from_json("body", f"settings struct<{','.join(x.strip().replace(' ', ':', 1) for x in SETTINGS.split(', '))}>, specs {SPECS}")
    return rows.select("file", d.alias("d"), "fault").select("file", "d.settings", "d.specs", "fault")
