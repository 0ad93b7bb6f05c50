import json
import sys

import pytest
from pyspark.sql import functions as F

from veridoss.operators import workflow as W


def test_calls_answers_and_failures(spark):
    def answer(text):
        return json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": text}]}], "usage": {"input_tokens": 10, "output_tokens": 2, "input_tokens_details": {"cached_tokens": 4}}})

    def model(payload):
        if payload == "bad":
            raise RuntimeError("refused")
        if payload == "busy":
            raise W.Refused(503, "busy")
        return "no json" if payload == "odd" else answer("junk" if payload == "junk" else 'so: {"v": 3} end')

    df = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "odd"), ("d", None), ("e", "junk"), ("f", "busy")], "k string, p string")
    called = W.call(df, ["k"], "p", model, retries=2, wait=0.0).cache()
    rows = {r.k: r for r in called.collect()}
    assert rows["a"].attempts == 1 and rows["a"].error is None
    assert rows["b"].attempts == 1 and "refused" in rows["b"].error  # another try would not help
    assert rows["f"].attempts == 3 and "503" in rows["f"].error
    assert rows["c"].error.startswith("JSONDecodeError") and rows["d"].error == "no payload"
    got = W.answers(called, ["k"], "v int").cache()
    assert [(r.k, r.v, r.usage.cached_input_tokens, r.usage.requests) for r in got.collect()] == [("a", 3, 4, 1)]
    price = got.select(W.usage_price(F.col("usage"), 1e6, 1e5, 10.0).alias("x")).first().x
    assert abs(price - (6 + 0.4 + 2e-5)) < 1e-9
    assert {r.k: r.stage for r in W.failures(called, got, ["k"], "ledger").collect()} == dict.fromkeys("bcdef", "ledger")
    assert W.completion(df, got, "k").first().asDict() == {"attempted": 6, "completed": 1, "failed": 5, "percentage": 16.67}
    assert W.completion(df.limit(0), got, "k").first().percentage == 0.0


def test_response_text_and_logs(spark):
    raw = [json.dumps({"output_text": "x"}), json.dumps({"output": [{"type": "message", "content": [{"type": "refusal", "refusal": "no"}]}]}), json.dumps({"output": []})]
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(F.from_json("r", W.RESPONSE).alias("p"))
    assert [r[0] for r in df.select(W.response_text(F.col("p"))).collect()] == ["x", None, None]
    logs = spark.createDataFrame([("Tokens used  12,345",), ("none",)], "l string")
    assert [r[0] for r in logs.select(W.logged_tokens(F.col("l"))).collect()] == [12345, None]


def test_context_and_completeness(spark):
    docs = spark.createDataFrame([("h", "v1"), ("g", "v1")], "hotel_id string, schema_version string")
    ledgers = spark.createDataFrame([("h", "002_of_002", 2), ("h", "001_of_002", 1), ("g", "001_of_002", 1)], "hotel_id string, chunk_id string, n int")
    payload = {r.hotel_id: json.loads(r.payload) for r in W.entity_context(docs, ledgers, "hotel_id").collect()}
    assert [x["n"] for x in payload["h"]["evidence_ledgers"]] == [1, 2] and payload["g"]["schema_version"] == "v1"
    chunks = spark.createDataFrame([(h, f"00{i}_of_002") for h in "hg" for i in (1, 2)], "hotel_id string, chunk_id string")
    assert {r.hotel_id for r in W.complete(ledgers, chunks, "hotel_id").collect()} == {"h"}


def test_commands_and_required_fields(spark):
    import sys

    echo = W.by_command([sys.executable, "-c", "import sys; print(sys.stdin.read().upper())"])
    df = spark.createDataFrame([("a", '{"v": 1}'), ("b", '{"w": 1}')], "k string, p string")
    rows = {r.k: r for r in W.call(df, ["k"], "p", echo, retries=1, wait=0.0, required=["V"]).collect()}
    assert rows["a"].response.strip() == '{"V": 1}' and rows["b"].attempts == 2 and "required" in rows["b"].error
    broken = W.by_command([sys.executable, "-c", "raise SystemExit(3)"])
    assert W.call(df, ["k"], "p", broken, retries=1, wait=0.0).first().error.startswith("RuntimeError")


def test_program_with_usage_and_log():
    prompt = W.prompt_for("Judge.", '{"a":1}')
    assert prompt.startswith("Judge.\n") and prompt.endswith('INPUT JSON:\n{"a":1}')
    code = "import sys; n = len(sys.stdin.read()); print('so:', '{\"n\": %d}' % n, 'end'); print('Tokens used\\n 12,345', file=sys.stderr)"
    assert json.loads(W.by_program([sys.executable, "-c", code], "Judge.")('{"a":1}')) == {"n": len(prompt), "_usage": {"tokens_used": 12345}}
    silent = W.by_program([sys.executable, "-c", "print('{}')"], "Judge.")
    assert json.loads(silent("{}")) == {"_usage": {"tokens_used": None}}
    with pytest.raises(RuntimeError, match="ended with 4: gone"):
        W.by_program([sys.executable, "-c", "import sys; print('gone', file=sys.stderr); sys.exit(4)"], "Judge.")("{}")
    with pytest.raises(json.JSONDecodeError):
        W.by_program([sys.executable, "-c", "print('no braces')"], "Judge.")("{}")


def test_a_lazy_model_is_loaded_once_a_worker_and_checked(spark, tmp_path):
    from veridoss.operators import absa

    def load():
        import os
        import uuid

        (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return absa.Runtime(lambda texts: [[{"word": t}] for t in texts], ["POSITIVE", "NEGATIVE", "NEUTRAL"], {"m": "r7"})

    df = spark.range(200).selectExpr("id", "CASE WHEN id = 7 THEN ' ' WHEN id = 8 THEN NULL ELSE concat('t', id) END AS t", "id % 3 AS g").repartition(6)
    model = absa.Lazy(f"once-{tmp_path.name}", load)
    for _ in range(2):
        got = absa.infer(df, "id", "t", model, batch=5).groupBy("status").count().collect()
        assert {r.status: r["count"] for r in got} == {"success": 198, "failed_blank_text": 2}
    where = absa.runtime_environments(df, "g", model).collect()
    assert sorted((r.g, r.rows, len(r.environments)) for r in where) == [("0", 67, 1), ("1", 67, 1), ("2", 66, 1)]
    assert json.loads(where[0].environments[0])["model_m"] == "r7"
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers))
    wrong = absa.Lazy(f"wrong-{tmp_path.name}", lambda: absa.Runtime(lambda texts: [[] for _ in texts], ["LABEL_0", "LABEL_1"]))
    with pytest.raises(Exception, match="do not tell"):
        absa.infer(df, "id", "t", wrong).count()
    assert absa.runtime_environments(df.limit(0), "g", model).count() == 0


def test_the_counting_program_starts_no_others():
    """Without a search path it can start no other program; starting some took most of a call's time."""
    import subprocess

    from veridoss.plans.evidence import _COUNTER

    for text, n in (("a\nb\n\n", 5), ("é\n x", 5), ("", 0)):
        done = subprocess.run(["/bin/sh", *_COUNTER[1:]], input=text, capture_output=True, text=True, check=True, env={"PATH": "/none"})
        assert f'"bytes": {n}}}' in done.stdout and done.stderr == f"tokens used 1,{n % 900 + 100}\n"
    assert subprocess.run(["/bin/sh", *_COUNTER[1:]], input='{"id":13,"chars":2}', capture_output=True, text=True, env={"PATH": "/none"}).returncode == 3


def test_calls_are_dealt_to_tasks_and_do_not_sleep_without_a_wait(spark):
    def model(payload):
        import time

        def never(_):
            raise AssertionError("slept")

        state = model.__dict__
        if "sleep" not in state:
            state["sleep"], state["n"], time.sleep = time.sleep, 0, never
        state["n"] += 1
        if state["n"] == 3:  # the last try
            time.sleep = state.pop("sleep")
        return "no JSON"

    df = spark.range(40).coalesce(1).selectExpr("id", "'{}' AS payload")
    got = W.call(df, ["id"], "payload", model, retries=2, wait=0.0)
    assert {r.attempts for r in got.collect()} == {3}
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_packages_hold_members_packed(spark, tmp_path, monkeypatch):
    """Before an archive is full its task holds what is packed, not the members' texts."""
    import io
    import tracemalloc
    import zipfile

    import pandas as pd
    from pyspark.sql import DataFrame

    from veridoss.sources import writers

    found = []
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda df, work, schema: found.append(work) or df)
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda df, work, schema: found.append(work) or df)
    writers.packages(spark.createDataFrame([("g", "n", "b")], "g string, n string, b string"), str(tmp_path / "p"), "g", "n", "b")
    frames = (pd.DataFrame({"g": ["en"], "n": [f"{k}.json"], "b": [f"{k % 7} " * 500_000]}) for k in range(40))
    tracemalloc.start()
    got = list(found[0](frames))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x["package"][0] for x in got] == ["en"] and most < 15e6
    with zipfile.ZipFile(io.BytesIO(got[0]["content"][0])) as z:
        assert len(z.namelist()) == 40 and z.read("9.json") == b"2 " * 500_000
