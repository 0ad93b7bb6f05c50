"""op10 and op6 on books, equal rows, long texts full of secrets and clashing names."""

import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veridoss.llm import op6_secrets as secrets
from veridoss.llm import op10_packing as packing
from veridoss.llm.queries import tokenizer_path


def whole(rows, window):
    """Every sequence is gapless from 0 and at most a window long."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(by)


def test_op10_books_pass_through_and_equal_rows_spread(spark):
    path = tokenizer_path("word_bpe_49k.json")
    book = "the house by the river was small and green. " * 60_000
    rows = spark.createDataFrame([(1, book), (2, "one line")], "doc_id long, text string").unionByName(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    out = packing.pack(spark, rows, path, window=64, group=1_000).withColumn("task", F.spark_partition_id()).cache()
    got = out.collect()
    mine = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start)
    assert [r.start for r in mine] == [64 * i for i in range(len(mine))] and sum(r.length for r in mine) == mine[0].doc_tokens > 500_000
    assert len({r.sequence_id for r in mine if r.length == 64}) == sum(r.length == 64 for r in mine)
    n = whole(got, 64)
    assert n <= mine[0].doc_tokens / 64 + 20_000 / 64 + 25
    tasks = Counter(r.task for r in got if r.doc_id is None)
    assert sum(tasks.values()) == 20_000 and len(tasks) >= 18 and max(tasks.values()) < 1_600
    out.unpersist()


def test_op10_clashing_names(spark, clash):
    path = tokenizer_path("word_bpe_49k.json")
    odd = clash.withColumn("place", F.lit("x")).withColumn("sequence_id", F.lit("x")).withColumn("a.b", F.lit(1))
    got = packing.pack(spark, odd, path)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() == 12
    assert packing.pack(spark, odd.limit(0), path).count() == 0


def plain_candidates(text, base):
    return [c for c in secrets.candidates(text, []) if not any(a < c[1] and c[0] < b for a, b, _ in base)]


def test_op6_candidates_beside_many_base_spans():
    import random

    rng = random.Random(6)
    kinds = ["token = abcdef1234567", "AKIA" + "B2" * 10, "0123456789abcdef" * 2, "".join(rng.choices("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/", k=40)), "words and", "password: x"]
    for _ in range(200):
        text = rng.choice((" ", "", "-")).join(rng.choices(kinds, k=rng.randint(0, 30)))
        base = secrets.base_spans(text)
        assert secrets.candidates(text, base) == plain_candidates(text, base)
    long = "token = abcdef1234567 Zk3+x9QpL0aWmR7vTyB2 " * 20_000
    start = time.time()
    assert len(secrets.candidates(long, secrets.base_spans(long))) == 20_000 and time.time() - start < 30


def test_op6_clashing_names(spark, clash):
    odd = clash.withColumn("base", F.lit("kept")).withColumn("runs", F.lit("kept")).withColumn("a.b", F.lit("kept"))
    odd = odd.unionByName(odd.limit(1).withColumn("text", F.lit("say token = abcdef1234567 now")).withColumn("doc_id", F.lit(77).cast("long")))
    out = secrets.redact(spark, odd)
    assert out.columns == odd.columns and out.where("`a.b` = 'kept' AND base = 'kept' AND runs = 'kept'").count() == 13
    assert out.where("doc_id = 77").first().text == "say <secret> now"
    assert secrets.find_secrets(spark, odd).where("n_assign = 1").count() == 1
