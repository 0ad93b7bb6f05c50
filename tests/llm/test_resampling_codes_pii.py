"""op11 to op13 against plain versions, and on odd, empty, hot and clashing input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoss.llm import op11_resampling as resampling
from veridoss.llm import op12_va_codes as codes
from veridoss.llm import op13_pii as pii

# --- op11


def plain_features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(rows, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for _, text in rows:
        for f in plain_features(text)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in plain_features(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out, able = [], []
    for doc, text in rows:
        words, feats = plain_features(text)
        weight = sum(gain[bucket(f)] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(feats), weight, score, None])
        if len(words) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("nodes,block,piece", [(1 << 20, 1 << 17, 1 << 20), (300, 50, 64)])
def test_op11_equals_the_plain_draw(spark, monkeypatch, nodes, block, piece):
    rng = random.Random(11)
    vocabulary = ["Über", "a", "B2", "the", "été", "x-y", "of", "zz,", " nb", "_", "Q" * 90]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 5, 20, 400)))) for _ in range(120)] + [None, "", "...", "one"]
    rows = [(rng.choice((k, k, 7)), t) for k, t in enumerate(texts)] + [(None, texts[3]), (None, texts[3]), (5, texts[4]), (5, texts[4])]
    target = [" ".join(rng.choices(vocabulary[:4], k=30)) for _ in range(5)] + [None]
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "PIECE", piece)
    gains = resampling.log_gains(totals(rows), totals([(0, t) for t in target]))
    assert walked(rows, gains) == plain_in_order(rows, target)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resample(spark, docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=40)
    assert rows_of(got) == plain_resample(rows, target, 40, 20)


def plain_in_order(rows, target):
    gains = resampling.log_gains(plain_totals(rows), plain_totals([(0, t) for t in target]))
    feats = [plain_features(text)[1] for _, text in rows]
    return [(len(f), sum(int(gains[zlib.crc32(x.encode()) % 10_000]) for x in f) // max(1, len(f))) for f in feats]


def plain_totals(rows):
    out = np.zeros(10_000, np.int64)
    for _, text in rows:
        for f in plain_features(text)[1]:
            out[zlib.crc32(f.encode()) % 10_000] += 1
    return out


def totals(rows):
    """Through tries of the size that is set, in this process."""
    import pyarrow as pa

    trie, out = resampling.WordTrie(), np.zeros(10_000, np.int64)
    for words, text, carried in resampling.blocks(pa.array([t for _, t in rows], pa.string())):
        trie.add(words, text, carried)
        if trie.full():
            out += trie.totals()
            trie.clear()
    return out + trie.totals()


def walked(rows, gains):
    import pyarrow as pa

    trie, n, total = resampling.WordTrie(gains), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for words, text, carried in resampling.blocks(pa.array([t for _, t in rows], pa.string())):
        of, gain = trie.walk(words, text, carried)
        np.add.at(n, of, 1)
        np.add.at(total, of, gain)
        if trie.full():
            trie.clear()
    return [(int(a), int(b) // max(1, int(a))) for a, b in zip(n, total)]


def test_op11_reads_a_very_long_text_whole(spark):
    long = "alpha beta " * 600_000 + "w" * 3_000_000
    got = resampling.weights(spark.createDataFrame([(1, long)], "doc_id long, text string"), np.zeros(10_000, np.int64)).first()
    assert got.n_features == 2 * 1_200_001 - 1 and got.weight == 0


def test_op11_spreads_copies_of_one_row(spark):
    hot = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three " * 10).alias("text"))
    docs = hot.unionByName(spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("four five " * 12), F.col("id").cast("string")).alias("text")))
    out = resampling.resample(spark, docs, docs.limit(0)).cache()
    assert sorted(r[0] for r in out.where("rank IS NOT NULL").select("rank").collect()) == list(range(1, 12_501))
    assert out.count() == 50_000 and out.where("rank = 1").first().score == out.agg(F.max("score")).first()[0]
    out.unpersist()


def test_op11_empty_and_clashing_names(spark, clash):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(spark, none, none).count() == 0
    out = resampling.resample(spark, clash, clash)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and out.count() == clash.count()
    named = spark.createDataFrame([(1, "a b", 5)], "`doc.id` long, `te``xt` string, id int")
    assert resampling.resample(spark, named, none, id_col="doc.id", text_col="te`xt").first().n_features == 3


# --- op12


def plain_codes(rows, parts=8, entries=16, rounds=6):
    fine = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in fine), default=0) // parts) * parts
    fine = [(i, v + [0] * (width - len(v)), label) for i, v, label in fine]
    d = width // parts
    cut = lambda v: [v[p * d : p * d + d] for p in range(parts)]
    book = [[cut(v)[p] for _, v, _ in sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda a, p: min((far(a, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        sums = {}
        for _, v, _ in fine:
            for p, a in enumerate(cut(v)):
                sums.setdefault((p, best(a, p)[1]), []).append(a)
        for (p, k), members in sums.items():
            book[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out, by = [], {}
    for i, v, label in fine:
        found = [best(a, p) for p, a in enumerate(cut(v))]
        error = sum(f for f, _ in found)
        by[label] = by.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(error, codes.MOST), label))
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(by[label], codes.MOST), digest) for i, c, e, label in out), key=str)


def got_codes(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return sorted((tuple(r) for r in codes.compress(spark, df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_op12_equals_the_plain_version(spark):
    rng = random.Random(12)
    rows = [(k, [round(rng.gauss(0, 1), 2) for _ in range(16)], rng.choice((0, 1, None))) for k in range(120)]
    rows += [(200, None, 1), (201, [1.0] * 15 + [None], 0), (202, [float("nan")] * 16, 0), (203, [float("inf")] + [0.0] * 15, None), (None, rows[0][1], 1), (3, rows[4][1], 0), (3, rows[4][1], 0)]
    assert got_codes(spark, rows, "double") == plain_codes(rows)


@pytest.mark.parametrize("rows", [
    [(1, [0.5] * 8, 1), (2, [0.25] * 8, None)],
    [(k, [float(k % 3)] * (k % 11), k % 2) for k in range(40)],
    [(k, [], 0) for k in range(3)],
    [(k, [float(k)] * 16, 0) for k in range(40)] + [(99, [1e30] * 16, 0), (98, [-3e37] * 16, 1)],
])
def test_op12_odd_vectors(spark, rows):
    assert got_codes(spark, rows, "double") == plain_codes(rows)


def test_op12_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4096, (16, 8))
    book = np.floor(centres).astype(np.int64)
    x = np.floor(centres[rng.integers(0, 16, 5000)] + rng.normal(0, 300, (5000, 8))).astype(np.int64)
    file = codes.CellFile(book)
    exact = ((x[:, None] - book[None]) ** 2).sum(2)
    lower, upper = file.bounds(x)
    assert (lower <= exact).all() and (exact <= upper).all()
    code, far, computed = file.nearest(x)
    assert (code == exact.argmin(1)).all() and (far == exact.min(1)).all() and computed < exact.size / 3


def test_op12_empty_and_clashing_names(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.compress(spark, none).count() == 0
    assert codes.compress(spark, spark.createDataFrame([(1, None, 2)], none.schema)).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 8, "x", 9, 9)], "id long, v array<double>, of string, code int, error int")
    assert codes.compress(spark, odd, id_col="id", vector_col="v", label_col="of").first().code == "00" * 8


# --- op13


def plain_base(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_op13_base_spans_equal_plain_matches():
    rng = random.Random(13)
    for _ in range(20_000):
        text = "".join(rng.choices(rng.choice(("a@.-", "a@. b", "12.", "1234567890 -", "+12 ()-.", "a1.@+ -é", "0123456789.", "4 -0")), k=rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.fixture(scope="module")
def model():
    return pii.Model().fit(["the quick fox runs over old stones", "Ein Satz steht hier, mit Wörtern und so"] * 4, 3000)


def test_op13_held_out_accuracy(model):
    rng, right, of, wrong, harmless = random.Random(999), 0, 0, 0, 0
    for _ in range(2000):
        text, a, b, kind = pii.example(rng, ["a line of words that no model has seen", "encore une phrase avec des mots"])
        base = pii.base_spans(text)
        got = pii.added_spans(text, base, model)
        if kind is None:
            harmless += 1
            wrong += bool(got)
        elif not any(x < b and a < y for _, x, y in base):
            of += 1
            right += (pii.KINDS.index(kind), a, b) in got
    assert right / of > 0.85 and wrong / harmless < 0.03


def test_op13_spans_of_whole_texts(spark, model):
    texts = ["mail anna.meier [at] example [dot] com now", "call (555) 234-9876 today", "just words, page 12 of 90", None, "", "x" * 10_000 + " a@b.co " + "7" * 3_000, "ip 10.0.0.1 or 4111 1111 1111 1111 +1 (555) 123-4567", "ip 10.0.0.1 or 4111 1111 1111 1111 +1 (555) 123-4567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("extra")).repartition(3)
    got = {r.doc_id: r for r in pii.find_personal(spark, df, model).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        base = plain_base(text or "")
        named = ",".join(f"{pii.KINDS[i]}:{a}:{b}" for i, a, b in base)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(i == j for i, _, _ in base) for j in range(4))
        assert got[k].base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        spans = [s for s in got[k].spans.split(",") if s]
        assert set(named.split(",")) - {""} <= set(spans) and len(spans) == len(base) + got[k].n_added
        taken = sorted((a, b) for _, a, b in base)
        added = sorted(tuple(map(int, s.split(":")[1:])) for s in spans if s not in named.split(","))
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:])) and not any(a < d and c < b for a, b in added for c, d in taken)
    assert got[0].spans == f"email:{texts[0].index('anna')}:{texts[0].index(' now')}" and got[1].n_added == 1
    assert got[2].spans == "" == got[3].spans == got[4].spans and got[6].spans == got[7].spans


def test_op13_redacts_and_keeps_columns(spark, model, clash):
    df = spark.createDataFrame([(1, "write a@b.co or +1 (555) 123-4567.", "k"), (2, None, "k")], "doc_id long, text string, `od.d` string")
    out = {r.doc_id: r for r in pii.redact(spark, df, model).collect()}
    assert out[1].text == "write <email> or <phone>." and out[2].text is None and out[1]["od.d"] == "k"
    assert pii.redact(spark, clash, model).columns == clash.columns and pii.find_personal(spark, clash.limit(0), model).count() == 0
    assert pii.find_personal(spark, df.limit(0)).count() == 0


def test_op13_time_follows_length():
    import time

    for text in ("a" * 400_000, "1" * 400_000, "+1" + " " * 400_000, "a@" * 200_000, "1." * 100_000, "1 " * 100_000):
        start = time.time()
        pii.base_spans(text)
        pii.proposals(text)
        assert time.time() - start < 5
