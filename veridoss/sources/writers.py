"""Sinks: nested JSON per entity, manifests, signed definitions, canonical JSON lines, reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.functions.scalars import below, slug
from veridoss.sources.readers import canonical_digest
from veridoss.sources.workspace import kept


def entity_json(df: DataFrame, entity: str, path: str) -> None:
    """One folder per entity's file stem holding its document as a line of JSON, nulls kept."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    df.select(slug(F.col(entity)).alias("stem"), body.alias("value")).write.mode("overwrite").partitionBy("stem").text(path)


def json_lines(df: DataFrame, order: str, path: str) -> None:
    """Sorted JSON lines in as many files as ranges; files in name order hold the rows in order."""
    df.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def checkpoint_part(df: DataFrame, path: str, number: int) -> None:
    df.withColumn("batch_no", F.lit(number)).write.mode("append").parquet(path)


def manifest(spark: SparkSession, folder: str, exclude: str | None = None) -> DataFrame:
    """(path, sha256, size_bytes) of every file below a folder, hashed where it is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = df.select(below("path", folder).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    return rows.where(~F.col("path").rlike(exclude)) if exclude else rows


def verify_manifest(actual: DataFrame, stated: DataFrame) -> DataFrame:
    """Files that are missing or whose hash differs; empty if all is well."""
    both = stated.select("path", F.col("sha256").alias("stated")).join(actual.select("path", F.col("sha256").alias("actual")), "path", "left")
    return both.where(~F.col("stated").eqNullSafe(F.col("actual"))).withColumn("fault", F.when(F.col("actual").isNull(), "missing").otherwise("differs"))


def small_json(path: str, payload: dict) -> None:
    """A small driver-side report, written beside and renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, sort_keys=True, ensure_ascii=False)
    os.replace(name, target)


def signed_definition(path: str, payload: dict, key: str = "sample_definition_sha256") -> dict:
    out = payload | {key: canonical_digest(payload)}
    small_json(path, out)
    return out


def _stem(name: str) -> Column:
    """A column's file-name stem; none begins with a sign by which readers pass files over."""
    return F.regexp_replace(slug(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))), "^(?=[_.])", "x")


def signed(df: DataFrame, name: str, key: str = "sample_definition_sha256") -> DataFrame:
    """(name, content): each row as a JSON file under its own digest, for ``files``.

    The definition holds the columns beside name, nulls included; its digest is that of ``canonical_digest``.
    A null name counts as an empty one; rows of the same name give the same file name, and the last one written stays.
    """
    import pandas as pd

    def sign(frames):
        for frame in frames:
            made = [json.loads(b) for b in frame["body"]]
            made = [json.dumps(p | {key: canonical_digest(p)}, indent=2, sort_keys=True, ensure_ascii=False).encode() for p in made]
            yield pd.DataFrame({"name": frame["name"], "content": made})

    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]), {"ignoreNullFields": "false"})
    return df.select(F.concat(_stem(name), F.lit(".json")).alias("name"), body.alias("body")).mapInPandas(sign, "name string, content binary")


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """A small report as Markdown; refuses more rows than a report can hold."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def npz(df: DataFrame, path: str, id_: str, vector: str, method: str, shard_rows: int = 100_000, packed: bool = True) -> None:
    """Vectors as npz archives (emb float32, review_id, method), one a range of ids, each below a folder of its part.

    An archive is made in the task that holds its rows; ranges keep it to about shard_rows. Rows of archives that
    are not packed can be read by range (``archives.npz_rows``), once ``files`` has made files of them.
    """
    import io

    import numpy as np
    import pandas as pd

    def pack(frames):
        held = pd.concat(list(frames), ignore_index=True)
        if len(held):
            out = io.BytesIO()
            (np.savez_compressed if packed else np.savez)(out, emb=np.stack(held["v"].map(np.asarray)).astype("float32"), review_id=held["i"].to_numpy(str), method=np.array(method))
            yield pd.DataFrame({"content": [out.getvalue()], "first": [held["i"].iloc[0]]})

    n = max(1, -(-df.count() // shard_rows))
    rows = df.select(F.col(id_).cast("string").alias("i"), F.col(vector).alias("v"), F.col(id_).alias("__o")).repartitionByRange(n, "__o").sortWithinPartitions("__o").drop("__o")
    rows.mapInPandas(pack, "content binary, first string").write.parquet(path)


def files(df: DataFrame, name: str, content: str, path: str) -> DataFrame:
    """Each row's content as a file below a shared path; (name, size) of them, once all are written.

    A task writes beside the file and renames, so that a lost task leaves no half of one and a second try replaces the first.
    """
    import pandas as pd

    from veridoss.sources.archives import put

    def write(frames):
        for frame in frames:
            for n, body in zip(frame["n"], frame["c"], strict=True):
                put(f"{path}/{n}", body)
                yield pd.DataFrame({"name": [n], "size": [len(body)]})

    done = df.select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(write, "name string, size long")
    return kept(done, "written")


def csv_and_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """The same rows as Parquet and as CSV with a header, the CSV in a folder for each value of ``by``."""
    df.write.parquet(f"{path}/parquet")
    out = df.write.option("header", True).option("quote", '"').option("escape", '"')
    (out.partitionBy(by) if by else out).csv(f"{path}/csv")


def packages(df: DataFrame, path: str, group: str, name: str, body: str, most_bytes: int = 64 << 20) -> None:
    """Zip archives of (name, body) members, one or more for each value of ``group``.

    Members are dealt to archives by running size within the group's hash ranges, so that no task holds a group:
    an archive takes members until most_bytes are reached.
    """
    import io
    import zipfile

    import pandas as pd

    def pack(frames):
        parts: dict[str, list] = {}  # bytes taken in, the archive's buffer, the archive: members are packed as they come

        def close(key):
            _, out, z = parts.pop(key)
            z.close()
            return pd.DataFrame({"package": [key], "content": [out.getvalue()]})

        for frame in frames:
            for g, n, b in frame.itertuples(index=False):
                if g not in parts:
                    out = io.BytesIO()
                    parts[g] = [0, out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)]
                held = parts[g]
                held[0] += len(b)
                held[2].writestr(n, b)
                if held[0] > most_bytes:
                    yield close(g)
        for key in list(parts):
            yield close(key)

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(name).alias("n"), F.col(body).alias("b"))
    rows.repartition("g", F.pmod(F.xxhash64("n"), F.lit(8))).mapInPandas(pack, "package string, content binary").write.parquet(path)


def manifest_csv(rows: DataFrame, path: str) -> None:
    """A manifest's rows in order of path, as CSV with a header."""
    rows.select("path", "sha256", "size_bytes").repartitionByRange(1, "path").sortWithinPartitions("path").write.option("header", True).csv(path)


def run_summary(path: str, title: str, facts: dict, tables: dict[str, DataFrame]) -> None:
    """A run's facts as JSON and, with small tables, as Markdown beside it."""
    small_json(f"{path}.json", facts)
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in sorted(facts.items()))]
    for name, df in tables.items():
        lines += ["", f"## {name}", "", markdown_table(df)]
    Path(f"{path}.md").write_text("\n".join(lines), encoding="utf-8")


def reports(facts: DataFrame, rows: DataFrame, key: str, title: str = "Run", most: int = 1_000) -> DataFrame:
    """(name, content): for each row of facts a JSON file and a Markdown file with the key's rows as a table, for ``files``.

    Facts are all columns, the key among them, in order of their names; table rows are in order of their columns. A key with more than
    ``most`` rows is an error, raised before any rows are gathered. A key without rows has an empty table; rows of a key
    without facts are left out. Null cells are empty; bars and line breaks in cells are escaped. Null keys are a key.
    """
    if (long := rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).head()) is not None:
        raise ValueError(f"too many rows for a report: {long[0]!r}")
    names, given = [c for c in rows.columns if c != key], sorted(facts.columns)

    def cell(c) -> Column:
        return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")

    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(r[c]) for c in names]), F.lit(" |"))
    tables = rows.groupBy(F.col(f"`{key}`").alias("__k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*names))), line).alias("__lines"))
    both = facts.join(tables, F.col(f"`{key}`").eqNullSafe(F.col("__k")), "left")
    head = [F.lit(f"# {title}"), F.lit(""), *[F.concat(F.lit(f"- {c}: "), cell(F.col(f"`{c}`"))) for c in given], F.lit("")]
    head += [F.lit(f"| {' | '.join(names)} |"), F.lit("|" + " --- |" * len(names))]
    text = F.concat(F.concat_ws("\n", F.concat(F.array(*head), F.coalesce("__lines", F.array().cast("array<string>")))), F.lit("\n"))
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in given]), {"ignoreNullFields": "false"})
    stem = _stem(key)
    pair = F.array(F.struct(F.concat(stem, F.lit(".json")).alias("name"), body.alias("text")), F.struct(F.concat(stem, F.lit(".md")).alias("name"), text.alias("text")))
    return both.select(F.explode(pair).alias("f")).select("f.name", F.encode("f.text", "UTF-8").alias("content"))


def document_pair(documents: DataFrame, compact: DataFrame, entity: str, path: str) -> None:
    """Full and compact documents as rows (stem, body), one JSON line each, in two tables under the same stems."""
    for name, df in (("full", documents), ("compact", compact)):
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        df.select(slug(F.col(entity)).alias("stem"), body.alias("value")).write.parquet(f"{path}/{name}")
