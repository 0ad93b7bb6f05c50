"""Aspect results: entity normalisation, inference with fallback, refresh joins and coverage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoss.config import read_yaml
from veridoss.functions.scalars import blank, canonical_category, clean_term, sentiment_of_label
from veridoss.operators.relational import dedup, join_one_to_one
from veridoss.schemas import ASPECTS, PREDICTIONS

Specs = Sequence[tuple[str, Sequence[str]]]
_LOADED: dict[str, Runtime] = {}  # models of this process, by name
SOURCE = ("absa_aspect", "absa_sentiment", "absa_confidence", "absa_method", "absa_reusable_status")


@dataclass
class Runtime:
    """A loaded model: entities for a batch of texts, the labels of its classifier, names and revisions of its parts."""

    provider: Callable[[list[str]], list[list[dict]]]
    labels: Sequence[str]
    revisions: dict[str, str] = field(default_factory=dict)


@dataclass
class Lazy:
    """A model that each worker loads when it first needs it, and keeps for its later batches and tasks.

    Only the function that loads it is sent. Its labels are checked before its first use; a model that does not
    load, or whose labels do not tell the needed ones, fails the run: it is no fault of a row.
    """

    name: str
    load: Callable[[], Runtime]
    needed: Sequence[str] = ("positive", "negative", "neutral")

    def get(self) -> Runtime:
        return loaded(self.name, self.load, self.needed)


def loaded(name: str, load: Callable[[], Runtime], needed: Sequence[str]) -> Runtime:
    """The model of that name in this process, loaded and checked on the first call."""
    if name not in _LOADED:
        made = load()
        checked_labels(made.labels, needed)
        _LOADED[name] = made
    return _LOADED[name]


def load_specs(path: str) -> list[tuple[str, list[str]]]:
    """Categories with their aliases, each alias once, in order."""
    return specs_of(read_yaml(path))


def specs_of(found: dict) -> list[tuple[str, list[str]]]:
    return [(str(x["canonical"]), list(dict.fromkeys([str(a) for a in x.get("aliases") or []]))) for x in found["aspects"]]


def normalise_entities(df: DataFrame, id_: str, text: str, entities: str, specs: Specs) -> DataFrame:
    """Extracted entities as one array of aspect structs per row, in order and each (term, span) once."""
    rows = df.select(id_, F.col(text).alias("__t"), F.posexplode(entities).alias("p", "e"))
    rows = rows.withColumns({"raw": clean_term(F.col("e.word")), "sentiment": sentiment_of_label(F.col("e.entity_group"))})
    rows = rows.where(F.contains(F.lower("e.entity_group"), F.lit("asp")) & F.col("sentiment").isNotNull() & (F.col("raw") != ""))
    at = F.expr("nullif(coalesce(nullif(instr(__t, raw), 0), instr(lower(__t), lower(raw))), 0)")
    known = F.col("e.start").isNotNull() & F.col("e.end").isNotNull()
    rows = rows.withColumn("a", F.when(known, F.col("e.start")).otherwise(at - 1)).withColumn("b", F.when(known, F.col("e.end")).otherwise(at - 1 + F.length("raw"))).where("a IS NOT NULL")
    rows = dedup(rows.withColumn("low", F.lower("raw")), [id_, "low", "a", "b"], [F.col("p")])
    none = F.lit(None)
    aspect = F.struct(F.col("raw").alias("raw_aspect"), canonical_category(F.col("raw"), specs).alias("canonical_aspect"), F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"), F.col("e.entity_group").alias("extractor_label"), F.coalesce("e.score", F.lit(0.0)).alias("aspect_extraction_score"), "sentiment", F.lit("end2end_extractor_label").alias("sentiment_source"), none.cast("double").alias("sentiment_score"), none.cast("map<string,double>").alias("sentiment_scores"))
    lists = rows.groupBy(id_).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("p"), F.to_json(aspect, {"ignoreNullFields": "false"}).alias("x")))), lambda v: v["x"]).alias("j"))
    arrays = lists.select(id_, F.from_json(F.concat(F.lit("["), F.concat_ws(",", "j"), F.lit("]")), ASPECTS).alias("aspects"))
    return df.select(id_).join(arrays, id_, "left").select(id_, F.coalesce("aspects", F.array().cast(ASPECTS)).alias("aspects"))


def prediction_rows(aspects: DataFrame, id_: str = "review_id") -> DataFrame:
    """One prediction row per array of aspects."""
    a = F.col("aspects")
    term = lambda f: F.concat_ws(";", F.transform(a, f))
    return aspects.select(
        F.col(id_).cast("string").alias("review_id"),
        F.lit("deberta_absa").alias("absa_method"),
        term(lambda x: x["raw_aspect"]).alias("absa_aspect"),
        term(lambda x: F.concat_ws(":", x["raw_aspect"], x["sentiment"])).alias("absa_sentiment"),
        F.lit(None).cast("double").alias("absa_confidence"),
        F.when(F.size(a) > 0, "success_with_aspects").otherwise("success_no_aspects").alias("inference_status"),
        F.lit("").alias("error_message"),
        F.to_json(a, {"ignoreNullFields": "false"}).alias("absa_aspect_predictions_json"),
        F.concat_ws(";", F.filter(F.transform(a, lambda x: x["canonical_aspect"]), lambda x: x.isNotNull())).alias("absa_canonical_aspect"),
        F.size(a).cast("long").alias("extracted_aspect_count"),
        F.size(F.filter(a, lambda x: x["aspect_extraction_score"].isNotNull())).cast("long").alias("aspect_score_count"),
        F.size(F.filter(a, lambda x: x["sentiment_score"].isNotNull())).cast("long").alias("sentiment_score_count"),
    )


def infer(df: DataFrame, id_: str, text: str, provider: Callable[[list[str]], list[list[dict]]] | Lazy, batch: int = 32) -> DataFrame:
    """(id, entities JSON, status, error) by a provider of entities for a batch of texts.

    A batch that fails is tried again row by row; a blank text or a failing row is a row with its
    status, never a failed task. The provider is made for each worker by pickling, a Lazy one by loading it once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider.get().provider if isinstance(provider, Lazy) else provider
        for frame in frames:
            out = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                live = [(i, t) for i, t in zip(part["i"], part["t"], strict=True) if t and t.strip()]
                out += [(i, None, "failed_blank_text", "the text is blank") for i, t in zip(part["i"], part["t"], strict=True) if not (t and t.strip())]
                try:
                    out += [(i, json.dumps(e), "success", "") for (i, _), e in zip(live, ask([t for _, t in live]), strict=True)]
                except Exception:
                    for i, t in live:
                        try:
                            out.append((i, json.dumps(ask([t])[0]), "success", ""))
                        except Exception as error:
                            out.append((i, None, "failed_model", str(error)[:500]))
            yield pd.DataFrame(out, columns=["id", "entities", "status", "error"])

    return df.select(F.col(id_).cast("string").alias("i"), F.col(text).alias("t")).mapInPandas(run, "id string, entities string, status string, error string").withColumnRenamed("id", id_)


def pending(df: DataFrame, done: DataFrame, id_: str, recompute: bool = False) -> DataFrame:
    """Rows without a successful result yet."""
    return df if recompute else df.join(done.where(F.col("inference_status").startswith("success")).select(id_), id_, "left_anti")


def latest(results: DataFrame, id_: str, batch: str, row: str) -> DataFrame:
    """The last result of each id by batch and row."""
    return dedup(results, [id_], [F.desc(batch), F.desc(row)])


def refresh_features(features: DataFrame, predictions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Features with new aspect results and frozen clusters; the old columns stay as source_*.

    A row whose inference failed gets method none and status NO_RESULT: an old proxy result never survives.
    """
    old = [c for c in SOURCE if c in features.columns]
    renamed = features.withColumnsRenamed({c: f"source_{c}" for c in old}).drop("semantic_cluster_id", "cluster_id")
    both = join_one_to_one(renamed, predictions, ["review_id"])
    both = join_one_to_one(both, clusters.select("review_id", "semantic_cluster_id"), ["review_id"], required=True)
    good = F.coalesce(F.col("inference_status").startswith("success"), F.lit(False))
    return both.withColumns({"absa_method": F.when(good, "deberta_absa").otherwise("none"), "absa_reusable_status": F.when(good, "REAL").otherwise("NO_RESULT")})


def explode_predictions(predictions: DataFrame) -> DataFrame:
    """One row per aspect; JSON that does not parse gives none."""
    return predictions.select("review_id", "absa_method", F.posexplode(F.from_json(F.coalesce("absa_aspect_predictions_json", F.lit("[]")), ASPECTS)).alias("aspect_index", "a")).select("review_id", "absa_method", "aspect_index", "a.*")


def refine_low_scores(aspects: Column, score: float = 0.8) -> Column:
    """Aspects whose extraction score asks for a second classifier."""
    return F.filter(aspects, lambda x: x["aspect_extraction_score"] < score)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the largest is taken off first."""
    e = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def labelled(logits: Column, labels: Sequence[str]) -> Column:
    """The best label of an array of logits, the first of several, with its score and all scores by label."""
    p = softmax(logits)
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_position(p, F.array_max(p)).cast("int")
    return F.struct(F.element_at(names, best).alias("label"), F.array_max(p).alias("score"), F.map_from_arrays(names, p).alias("scores"))


def refined(aspects: DataFrame, id_: str, scores: DataFrame, score: float = 0.8) -> DataFrame:
    """Exploded aspects (id, aspect_index, ...) below the score take sentiment and score from a second classifier's rows.

    scores has id, aspect_index, label and score; an aspect without one keeps its own. Both stay traceable: the
    source of each aspect's sentiment is named.
    """
    second = scores.select(id_, "aspect_index", F.col("label").alias("__l"), F.col("score").alias("__s"))
    both = aspects.join(second, [id_, "aspect_index"], "left")
    use = (F.col("aspect_extraction_score") < score) & F.col("__l").isNotNull()
    return both.withColumns({"sentiment": F.when(use, F.col("__l")).otherwise(F.col("sentiment")), "sentiment_source": F.when(use, "second_classifier").otherwise(F.col("sentiment_source")), "sentiment_score": F.when(use, F.col("__s")).otherwise(F.col("sentiment_score"))}).drop("__l", "__s")


def resumed(spark, df: DataFrame, path: str, id_: str, work: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """Results of work on every row of df, kept in numbered checkpoint parts below path; what is done is not done again.

    Rows are dealt to parts by hash of their id. A part is one write, so a run that stops keeps the parts
    before. The last result of an id wins; an id without any is an error.
    """
    from veridoss.sources.writers import checkpoint_part

    def done() -> DataFrame | None:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return spark.read.parquet(path) if fs.exists(root) else None

    for k in range(parts):
        rows, before = df.where(F.pmod(F.xxhash64(id_), F.lit(parts)) == k), done()
        todo = rows if before is None else pending(rows, before, id_)
        checkpoint_part(work(todo), path, k)
    last = latest(done(), id_, "batch_no", "inference_status").drop("batch_no")
    joined = join_one_to_one(df.select(id_), last, [id_], required=True)
    return joined


def embedded(df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], name: str = "embedding", batch: int = 256) -> DataFrame:
    """df with a vector of each text by a provider of vectors for a batch of texts, one call a batch; a null text counts as empty."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([[float(x) for x in v] for at in range(0, len(texts), batch) for v in provider(texts[at : at + batch])])

    return df.withColumn(name, F.pandas_udf(run, "array<float>")(F.col(text)))


def checked_labels(found: Sequence[str], needed: Sequence[str] = ("positive", "negative", "neutral")) -> list[str]:
    """A model's labels in lower case, each of the needed ones in exactly one of them; else an error."""
    low = [str(x).lower() for x in found]
    if bad := [n for n in needed if sum(n in x for x in low) != 1]:
        raise ValueError(f"the model's labels {list(found)} do not tell {bad}")
    return low


def environment(models: dict[str, str]) -> dict[str, str]:
    """Versions of Python, of the libraries at hand and the named models, for a provenance record."""
    import platform
    from importlib import metadata

    out = {"python": platform.python_version(), **{f"model_{k}": v for k, v in models.items()}}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "absent"
    return out


def runtime_environments(df: DataFrame, group: str, model: Lazy) -> DataFrame:
    """Provenance of a run: for each group the rows, and the environments of the workers that would infer them.

    A task sends one row a group with its model's revisions, labels and library versions; more than one
    environment in a group means that executors do not agree.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for frame in frames:
            for g, n in frame["g"].value_counts(dropna=False).items():
                g = None if pd.isna(g) else g
                seen[g] = seen.get(g, 0) + int(n)
                if len(seen) >= 10_000:
                    yield rows(seen)
                    seen = {}
        if seen:
            yield rows(seen)

    def rows(seen: dict) -> pd.DataFrame:
        held = model.get()
        said = json.dumps(environment(held.revisions) | {"labels": ";".join(checked_labels(held.labels, model.needed))}, sort_keys=True)
        return pd.DataFrame({"g": list(seen), "n": list(seen.values()), "e": said})

    sent = df.select(F.col(group).cast("string").alias("g")).mapInPandas(run, "g string, n long, e string")
    return sent.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("rows"), F.sort_array(F.collect_set("e")).alias("environments"))


def inference_report(predictions: DataFrame) -> DataFrame:
    """One row: counts by status, terms, coverage in percent and a verdict."""
    failed = F.count_if(F.col("inference_status").startswith("failed"))
    good = F.count_if(F.col("inference_status").startswith("success"))
    return predictions.agg(F.count("*").alias("rows"), good.alias("ok"), failed.alias("failed"), F.count_if(F.col("inference_status") == "success_no_aspects").alias("without_aspects"), F.sum("extracted_aspect_count").alias("terms"), F.round(100 * good / F.greatest(F.count("*"), F.lit(1)), 4).alias("coverage_pct")).withColumn("verdict", F.when(F.col("ok") == 0, "FAIL").when(F.col("failed") > 0, "PASS WITH WARNINGS").otherwise("PASS"))


def failure_rows(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Prediction rows for blank texts."""
    empty = {f.split(" ")[0]: f.split(" ")[1] for f in PREDICTIONS.split(", ")}
    fixed = {"review_id": F.col(id_).cast("string"), "absa_method": F.lit("none"), "inference_status": F.lit("failed_blank_text"), "error_message": F.lit("the text is blank"), "absa_aspect_predictions_json": F.lit("[]")}
    return df.where(blank(F.col(text))).select(*[fixed.get(c, F.lit(0) if k == "long" else F.lit("") if k == "string" else F.lit(None)).cast(k).alias(c) for c, k in empty.items()])
