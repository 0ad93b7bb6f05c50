"""Model calls with retries, and the two-stage flow from chunks to checked assessments.

The model is an injected function from a JSON payload to a JSON response; nothing here reaches a network.
"""

from __future__ import annotations

import json
import random
import re
import subprocess
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoss.functions.scalars import model_json
from veridoss.operators.assess import check_assessments, check_ledgers, display_values

RESPONSE = "output_text string, output array<struct<type:string, content:array<struct<type:string, text:string, refusal:string>>>>, usage struct<input_tokens:long, output_tokens:long, input_tokens_details:struct<cached_tokens:long>>"
CALLED = "response string, error string, attempts int"
MOST_DELAY = 60.0


def response_text(parsed: Column) -> Column:
    """The text of a parsed response: output_text if present, else its message parts joined by newlines; null if none."""
    messages = F.filter(parsed["output"], lambda x: x["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string,refusal:string>>"))))
    texts = F.transform(F.filter(parts, lambda x: (x["type"] == "output_text") & x["text"].isNotNull()), lambda x: x["text"])
    refused = F.exists(parts, lambda x: x["type"] == "refusal")
    return F.coalesce(parsed["output_text"], F.when(~refused & (F.size(texts) > 0), F.array_join(texts, "\n")))


def usage(parsed: Column) -> Column:
    """Counters of one response; missing ones are 0."""
    u = parsed["usage"]
    zero = F.lit(0).cast("long")
    return F.struct(F.coalesce(u["input_tokens"], zero).alias("input_tokens"), F.coalesce(u["output_tokens"], zero).alias("output_tokens"), F.coalesce(u["input_tokens_details"]["cached_tokens"], zero).alias("cached_input_tokens"), F.lit(1).cast("long").alias("requests"))


def logged_tokens(log: Column) -> Column:
    """The number after "tokens used" in a log, commas dropped; null if there is none."""
    found = F.regexp_extract(log, r"(?i)tokens used\s+([\d,]+)", 1)
    return F.regexp_replace(found, ",", "").try_cast("long")


def usage_price(u: Column, uncached: float, cached: float, output: float) -> Column:
    """Cost at prices per million tokens; cached input is not charged twice."""
    fresh = F.greatest(F.lit(0), u["input_tokens"] - u["cached_input_tokens"])
    return (fresh * uncached + u["cached_input_tokens"] * cached + u["output_tokens"] * output) / 1e6


class Refused(Exception):
    """What a model raises for an answer with a status code."""

    def __init__(self, status: int, text: str = "") -> None:
        super().__init__(f"status {status}: {text}")
        self.status = status


def worth_retrying(error: Exception) -> bool:
    """Whether another try may help: lost connections, and codes that mean busy, slow or broken for now."""
    status = getattr(error, "status", None)
    return isinstance(error, (ConnectionError, TimeoutError)) if status is None else status in (408, 409, 429) or 500 <= status < 600


def has_fields(answer: str, required: Sequence[str]) -> bool:
    """Whether a model's JSON answer is an object with the required fields."""
    found = json.loads(answer)
    return isinstance(found, dict) and all(k in found for k in required)


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def schema_faults(value, schema: Mapping, at: str = "$") -> list[str]:
    """Where a JSON value departs from a schema: types, required and further properties, enumerations, bounds, items.

    The keywords are type (one or several), enum, properties, required, additionalProperties (false or a schema),
    items, minItems, maxItems, minimum, maximum, minLength and pattern; all levels are looked at.
    """
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    whole = isinstance(value, float) and value.is_integer()
    is_a = lambda k: (isinstance(value, KINDS[k]) or k == "integer" and whole) and (not isinstance(value, bool) or k == "boolean")
    if kinds and not any(is_a(k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        out.append(f"{at}: not among the allowed values")
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in known:
                out += schema_faults(v, known[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: not a property")
            elif isinstance(more, Mapping):
                out += schema_faults(v, more, f"{at}.{k}")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: {len(value)} items")
        if "items" in schema:
            out += [x for i, v in enumerate(value) for x in schema_faults(v, schema["items"], f"{at}[{i}]")]
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: not of the form asked for")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: out of bounds")
    return out


def by_command(command: list[str], seconds: float = 600.0) -> Callable[[str], str]:
    """A model that is a program: the payload goes to its standard input, the answer comes from its output."""

    def model(payload: str) -> str:
        done = subprocess.run(command, input=payload, capture_output=True, text=True, timeout=seconds, check=False)
        if done.returncode:
            raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-500:]}")
        return done.stdout

    return model


def prompt_for(instructions: str, payload: str) -> str:
    """Instructions, the demand for nothing but JSON, and the payload."""
    return f"{instructions}\n\nAnswer with one JSON object of the given shape and nothing else.\n\nINPUT JSON:\n{payload}"


def by_program(command: list[str], instructions: str, seconds: float = 900.0) -> Callable[[str], str]:
    """A model that is a program: it reads a prompt, writes its answer to its output and a log to its error output.

    What lies outside the answer's outermost braces is dropped. The answer gets "_usage" with the number that the
    log names as tokens used (null: none). A program that ends badly, or answers no object, is an error with the
    end of its log.
    """

    def model(payload: str) -> str:
        done = subprocess.run(command, input=prompt_for(instructions, payload), capture_output=True, text=True, timeout=seconds, check=False)
        if done.returncode:
            raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-500:].strip()}")
        found = json.loads(done.stdout[max(0, done.stdout.find("{")) : done.stdout.rfind("}") + 1])
        used = re.search(r"(?i)tokens used\s+([\d,]+)", done.stderr)
        return json.dumps(found | {"_usage": {"tokens_used": int(used[1].replace(",", "")) if used else None}})

    return model


def call(df: DataFrame, key: list[str], payload: str, model: Callable[[str], str], retries: int = 4, wait: float = 1.0, required: Sequence[str] = (), schema: Mapping | None = None) -> DataFrame:
    """key columns with response, error and attempts; a row that fails keeps its error and stops no other.

    Waits wait * 2**attempt plus a random part, at most MOST_DELAY seconds, after errors that another try may
    mend; others end the row at once. An answer must be JSON with the required fields and, where a schema is given,
    agree with it at every level; one that is not is asked for again. A null payload is not sent. Rows are dealt evenly
    to tasks first: calls cost far more than rows, and a table read may have them in few parts.
    """

    def one(text: str | None) -> tuple[str | None, str | None, int]:
        if text is None:
            return None, "no payload", 0
        for attempt in range(retries + 1):
            try:
                got = model(text)
                if required and not has_fields(got, required):
                    raise json.JSONDecodeError("a required field is missing", got[:100], 0)
                found = json.loads(got)
                if schema is not None and (faults := schema_faults(found, schema)):
                    raise json.JSONDecodeError("; ".join(faults[:5]), got[:100], 0)
                return got, None, attempt + 1
            except Exception as error:
                said = f"{type(error).__name__}: {error}"[:1000]
                if not (worth_retrying(error) or isinstance(error, json.JSONDecodeError)):
                    return None, said, attempt + 1
            if attempt < retries and wait > 0:
                time.sleep(min(MOST_DELAY, wait * (2**attempt + random.random())))
        return None, said, retries + 1

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([one(None if x is None or x != x else x) for x in frame[payload]], columns=["response", "error", "attempts"], index=frame.index)
            yield pd.concat([frame[key], out], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema.fields)
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.select(*key, payload).repartition(tasks).mapInPandas(work, f"{kept}, {CALLED}")


def entity_context(documents: DataFrame, ledgers: DataFrame, entity: str) -> DataFrame:
    """(entity, payload): a document's header columns with its ledgers in chunk order, as JSON."""
    fields = [c for c in ("schema_version", "dataset_namespace", "hotel_metadata", "temporal_summaries", "warnings", "methodology_notes") if c in documents.columns]
    rest = [c for c in ledgers.columns if c not in (entity, "chunk_id", "errors")]
    gathered = ledgers.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("chunk_id", *rest))).alias("evidence_ledgers"))
    both = documents.select(entity, *fields).join(gathered, entity, "left")
    return both.select(entity, F.to_json(F.struct(entity, *fields, "evidence_ledgers"), {"ignoreNullFields": "false"}).alias("payload"))


def answers(called: DataFrame, key: list[str], schema: str) -> DataFrame:
    """Key columns, the parsed answer's fields and usage; rows without a parsable answer are left to failures()."""
    parsed = called.withColumn("__r", F.from_json("response", RESPONSE)).withColumn("__a", model_json(response_text(F.col("__r")), schema))
    return parsed.where("__a IS NOT NULL").select(*key, "__a.*", usage(F.col("__r")).alias("usage"))


def failures(called: DataFrame, answered: DataFrame, key: list[str], stage: str) -> DataFrame:
    """(key, stage, error) of calls that failed or whose answer could not be read."""
    bad = called.join(answered.select(*key), key, "left_anti")
    return bad.select(*key, F.lit(stage).alias("stage"), F.coalesce("error", F.lit("no readable answer")).alias("error"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0)


def complete(ledgers: DataFrame, chunks: DataFrame, entity: str) -> DataFrame:
    """Ledgers of entities of which every chunk has one: no entity is judged on part of its rows."""
    lost = chunks.select(entity, "chunk_id").join(ledgers.select(entity, "chunk_id"), [entity, "chunk_id"], "left_anti").select(entity).distinct()
    return ledgers.join(lost, entity, "left_anti")


def checked_ledgers(answered: DataFrame, chunks: DataFrame, entity: str) -> DataFrame:
    """Accepted ledgers of complete entities."""
    return complete(accepted(check_ledgers(answered, chunks, entity)), chunks, entity)


def finished(answered: DataFrame, records: DataFrame, entity: str, labels: Mapping[str, str], anchors: Mapping[tuple[str, str], float]) -> DataFrame:
    """Accepted assessments with their display values."""
    return display_values(accepted(check_assessments(answered, records, entity, labels)), anchors)


def still_open(entities: DataFrame, done: DataFrame | None, entity: str) -> DataFrame:
    """Entities without an accepted assessment yet: what a resumed run has to do."""
    return entities if done is None else entities.join(done.select(entity).distinct(), entity, "left_anti")


def run_entities(chunks: DataFrame, documents: DataFrame, records: DataFrame, entity: str, first: Callable[[str], str], second: Callable[[str], str], schemas: tuple[str, str], labels: Mapping[str, str], anchors: Mapping[tuple[str, str], float], done: DataFrame | None = None) -> DataFrame:
    """The two-stage flow for every entity still open: ledgers of its chunks, then its assessment.

    first answers a chunk's payload with a ledger, second an entity's context with an assessment; schemas are
    the types of their answers. What is rejected at either stage is left to the next run.
    """
    todo = still_open(chunks.select(entity).distinct(), done, entity)
    mine = chunks.join(todo, entity, "left_semi")
    asked = mine.select(entity, "chunk_id", F.to_json(F.struct(*mine.columns), {"ignoreNullFields": "false"}).alias("payload"))
    ledgers = checked_ledgers(answers(call(asked, [entity, "chunk_id"], "payload", first), [entity, "chunk_id"], schemas[0]).drop("usage"), mine, entity)
    context = entity_context(documents.join(ledgers.select(entity).distinct(), entity, "left_semi"), ledgers, entity)
    return finished(answers(call(context, [entity], "payload", second), [entity], schemas[1]).drop("usage"), records, entity, labels, anchors)


def tally(outcomes: DataFrame, status: str) -> DataFrame:
    """How many outcomes there are of each status."""
    return outcomes.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def completion(attempted: DataFrame, done: DataFrame, entity: str) -> DataFrame:
    """One row: attempted, completed, failed and the percentage completed."""
    both = attempted.select(entity).distinct().join(done.select(entity, F.lit(True).alias("__ok")).distinct(), entity, "left")
    n, ok = F.count("*"), F.count_if(F.coalesce("__ok", F.lit(False)))
    return both.agg(n.alias("attempted"), ok.alias("completed"), (n - ok).alias("failed"), F.coalesce(F.round(100 * F.try_divide(ok, n), 2), F.lit(0.0)).alias("percentage"))
