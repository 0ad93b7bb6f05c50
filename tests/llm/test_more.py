"""Plain versions of the operators' results, and the cases that once went wrong."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridoss.llm import op1_language_id, op2_fingerprints, op3_mixing, op5_ngram_join, op7_mpeg_ts, op8_licenses


# --- op1


def corpus(spark):
    rng = random.Random(3)
    vocab = {"en": "the of and water house river green small".split(), "fr": "le des une eau maison fleuve vert petit".split(), "xx": "zug qwert ylop vrum".split()}
    rows = [(i, " ".join(rng.choices(vocab[x], k=rng.randint(4, 60))), x if i % 5 else None, f"h{i % 7}.{'a' if i % 2 else 'b'}.{['fr', 'com'][i % 2]}") for i, x in enumerate(rng.choice(["en", "en", "fr", "xx"]) for _ in range(120))]
    rows += [(200, None, "en", "h1.a.com"), (201, "", None, None), (202, "12 34", "fr", "h1.a.com"), (203, "the of and", "en", None), (203, "the of and", "en", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, host string").repartition(3)


def plain_language(rows):
    """The whole fusion, row by row, with Python's own numbers."""
    o = op1_language_id

    def grams(text):
        x = [int(o._FOLD[b]) for b in (text or "").encode()]
        return Counter((((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF) >> 16 for a, b, c in zip(x, x[1:], x[2:]))

    model = {}
    for _, text, lang, _ in rows:
        if lang and text is not None:
            model.setdefault(lang, Counter()).update(grams(text))
    langs = sorted(model)
    total = {x: sum(model[x].values()) for x in langs}

    def like(text, said):
        g, out = grams(text), []
        n = sum(g.values())
        for x in langs:
            own = g if said == x else Counter()
            out.append(sum(c * (math.log(model[x][k] - own[k] + 0.1) - math.log(total[x] - sum(own.values()) + 0.1 * 65536)) for k, c in g.items()) / 3)
        return [*out, n * -10.0 / 3]

    likes = [like(t, said) for _, t, said, _ in rows]
    letters = [any(int(o._FOLD[b]) != 32 for b in (t or "").encode()) for _, t, _, _ in rows]
    votes = [(max(range(len(langs) + 1), key=lambda j: (q[j], -j)) if ok else len(langs)) for q, ok in zip(likes, letters)]
    votes = [v if v < len(langs) else None for v in votes]
    agree = sum(v is not None and langs[v] == said for v, (_, _, said, _) in zip(votes, rows))
    stated = sum(v is not None and said in langs for v, (_, _, said, _) in zip(votes, rows))
    trust = min(0.99, max(1 / len(langs), (agree + 1) / (stated + 2)))
    keys = lambda h: (h.rsplit(".", 1)[1] if "." in h else None, ".".join(h.split(".")[-2:]), h)
    tally = [Counter(), Counter(), Counter()]
    for v, (_, _, _, h) in zip(votes, rows):
        if v is not None and h:
            for t, k in zip(tally, keys(h)):
                t[k, v] += 1
    out = []
    for q, v, ok, (_, _, said, h) in zip(likes, votes, letters, rows):
        z = list(q)
        if said in langs:
            for j, x in enumerate(langs):
                z[j] += math.log(trust if x == said else (1 - trust) / (len(langs) - 1))
        if h:
            p = [votes.count(j) - (v == j) + 1.0 for j in range(len(langs))]
            p = [x / sum(p) for x in p]
            usual = o.SUFFIX_LANGUAGE.get(keys(h)[0])
            if usual in langs:
                p = [x / 2 + (x_ == usual) / 2 for x, x_ in zip(p, langs)]
            for t, k, w in zip(tally, keys(h), (o.SUFFIX_WEIGHT, o.DOMAIN_WEIGHT, o.HOST_WEIGHT)):
                c = [t[k, j] - (v == j) for j in range(len(langs))]
                p = [(a + w * b) / (sum(c) + w) for a, b in zip(c, p)]
            z = [a + math.log(b) for a, b in zip(z, p)] + z[-1:]
        top = max(z)
        share = [math.exp(a - top) for a in z]
        best = share.index(max(share))
        sure = share[best] / sum(share)
        out.append(([*langs, "und"][best] if ok and best < len(langs) and sure >= 0.5 else "und", sure if ok else 0.0))
    return out


def test_op1_equals_the_plain_fusion(spark):
    rows, df = corpus(spark)
    model = op1_language_id.train(df, "text", "lang")
    assert model.languages == ["en", "fr", "xx"]
    got = op1_language_id.identify(spark, df, model, "text", F.col("lang"), F.col("host")).collect()
    want = Counter((i, t, n, round(c, 5)) for (i, t, _, _), (n, c) in zip(rows, plain_language(rows)))
    assert Counter((r.doc_id, r.text, r.identified_lang, round(r.confidence, 5)) for r in got) == want


def test_op1_has_no_cap_on_languages_and_takes_long_texts(spark):
    rng = random.Random(1)
    vocab = {f"{a}{b}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for a in "abcdef" for b in "uvwxyz"}
    rows = [(n, " ".join(rng.choices(w, k=60)), n) for n, w in vocab.items() for _ in range(4)]
    rows.append(("au", " ".join(rng.choices(vocab["au"], k=100_000)), None))
    df = spark.createDataFrame(rows, "want string, text string, lang string").repartition(3)
    model = op1_language_id.train(df, "text", "lang")
    assert len(model.languages) == 36
    got = op1_language_id.identify(spark, df, model, "text", F.col("lang"), returned=["want"]).collect()
    assert len(got) == len(rows) and all(r.want == r.identified_lang for r in got)


def test_op1_prior_follows_the_hierarchy():
    world = np.array([50.0, 50.0])
    p = lambda s, d, h, tail=None, own=None: np.exp(op1_language_id.log_prior(["en", "fr"], world, (s, d, h), tail, own))
    assert p([(1, 900)], [(1, 100)], [(1, 90), (0, 10)])[1] > 0.8  # the host speaks
    assert p([(0, 900)], [(1, 400)], [])[1] > 0.7  # an unseen host follows its domain
    assert p([(0, 900)], [], [])[0] > 0.9  # an unseen domain its suffix
    assert p([], [], [], "fr")[1] > 0.7 and abs(p(None, [], [])[0] - 0.5) < 1e-9
    assert abs(p(None, [(1, 1)], [(1, 1)], None, 1)[1] - 50 / 101) < 1e-9  # the only vote is the row's own
    assert all(abs(x.sum() - 1) < 1e-9 for x in (p([(1, 3)], [(1, 2)], [(1, 1)], "fr", 1),))


def test_op1_clashing_names(spark, clash):
    model = op1_language_id.train(clash, "text", "lang")
    out = op1_language_id.identify(spark, clash, model, "text", F.col("lang"), F.col("source"))
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.where("identified_lang = 'en' AND __text = 'kept' AND cut = 'kept'").count() == 12


# --- op2


def plain_lanes(spark, text):
    phrases = [p for p in re.split(r"\n+|(?<=[^\w\s])\s+", text) if p]  # the fixture holds no underscore
    lines = text.split("\n")
    hashed = lambda xs, seed: [r.h & (1 << 64) - 1 for r in spark.createDataFrame([(x,) for x in xs], "x string").select(F.xxhash64(F.lit(seed), "x").alias("h")).collect()] if xs else []
    dense = [sum(h & (1 << 62) - 1 for h in hashed(lines, j)) % (1 << 62) for j in range(4)]
    bits = [[sum(h >> b & 1 for h in hashed(phrases, 100 + j)) for b in range(64)] for j in range(2)]
    return dense, bits, len(phrases)


@pytest.mark.parametrize("text", ["", "One. Two, three! four\nfive six.\n\nseven", "a, " * 700, "tail\n" * 300 + "end."])
def test_op2_lanes_equal_plain_sums(spark, text):
    got = op2_fingerprints.fingerprint(spark.createDataFrame([(text,)], "text string")).first().fingerprint
    dense, bits, n = plain_lanes(spark, text)
    assert got[:4] == dense and got[-1] == n
    for j in range(2):
        for k in range(8):
            for i in range(4):
                word = got[4 + 32 * j + 4 * k + i]
                assert (word & (1 << 30) - 1, word >> 32) == (bits[j][k + 8 * i], bits[j][k + 8 * (i + 4)])


def test_op2_likeness_of_very_many_phrases(spark):
    df = spark.createDataFrame([(2, "x! " * 1_100_000), (1, "x! " * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in op2_fingerprints.fingerprint_edits(spark, df).collect()}
    assert got[2].near_next > 0.999 and got[1].near_next > 0.999


def test_op2_edits_equal_plain_ones(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab c.\n!é𝄞", k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in op2_fingerprints.fingerprint_edits(spark, df).collect()}
    prints = {}
    n = len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i - 1) % n] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(t, set()).add(got[i].fingerprint)
        prints.setdefault(edited, set()).add(got[i].edited_fingerprint)
        assert (got[i].near_edited == 1.0) == (got[i].fingerprint == got[i].edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    assert op2_fingerprints.fingerprint_edits(spark, df.limit(0)).count() == 0


def test_op2_likeness_estimates_the_cosine(spark):
    rng = random.Random(4)
    base = [f"phrase {i}." for i in range(400)]
    rows = []
    for k, share in enumerate((0.9, 0.5, 0.1)):
        other = [p if rng.random() < share else f"new {k} {i}." for i, p in enumerate(base)]
        rows.append((share, " ".join(base), " ".join(other)))
    df = op2_fingerprints.fingerprint(op2_fingerprints.fingerprint(spark.createDataFrame(rows, "share double, a string, b string"), "a", "x"), "b", "y")
    df = df.withColumns({"x_norm": op2_fingerprints.norm(F.col("x")), "y_norm": op2_fingerprints.norm(F.col("y"))})
    for r in df.select("share", op2_fingerprints.likeness("x", "y").alias("l")).collect():
        assert abs(r.l - r.share) < 0.25


def test_op2_clashing_names(clash):
    out = op2_fingerprints.fingerprint(clash)
    assert out.columns.count("fingerprint") == 1 and out.where("cut = 'kept'").count() == 12


# --- op3


@pytest.mark.parametrize("share,epochs", [(0.37, 1), (1.3, 2)])
def test_op3_takes_the_exact_prefix(spark, share, epochs):
    """Of each leaf the rows in hash order whose running sum is within the rest, and no other."""
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(0, 40), rng.choice(["en", "fr", None]), "hot" if i % 3 == 0 else f"s{rng.randint(0, 60)}") for i in range(1500)]
    rows += [(7, "again", "en", "hot"), (None, "no id", "en", "hot"), (None, "no id either", "en", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    out = op3_mixing.mix_sources(spark, df, F.lit("d"), share, epochs)
    got = Counter((r.lang, r.source, r.epoch, r.doc_id, r.text) for r in out.collect())
    tok = lambda t: math.ceil(len(t.encode()) / 4) + 1
    leaves = {}
    for i, t, lang, source in rows:
        leaves.setdefault((lang, source), []).append((i, t))
    size = {k: sum(tok(t) for _, t in v) for k, v in leaves.items()}
    langs = sorted({k[0] for k in leaves}, key=str)
    of = lambda x: sum(n for k, n in size.items() if k[0] == x)
    total = share * sum(size.values())
    budget = {}
    for x, b in zip(langs, op3_mixing.fill_exact(min(total, epochs * sum(size.values())), [of(x) * epochs for x in langs], [of(x) ** 0.7 for x in langs])):
        ks = [k for k in leaves if k[0] == x]
        budget |= dict(zip(ks, op3_mixing.fill_exact(b, [size[k] * epochs for k in ks], [size[k] ** 0.5 for k in ks])))
    hashes = {(r.e, r.doc_id): r.h for e in range(epochs + 1) for r in df.select("doc_id", F.lit(e).alias("e"), F.xxhash64(F.lit(17), F.lit(e), F.col("doc_id").cast("string")).alias("h")).collect()}
    want = Counter()
    for k, docs in leaves.items():
        whole = int(budget[k] / size[k] + 1e-9)
        for e in range(whole):
            want.update((*k, e, i, t) for i, t in docs)
        rest, run = max(0.0, budget[k] - whole * size[k]), 0
        by = {}
        for i, t in docs:
            by.setdefault(hashes[whole, i], []).append((i, t))
        for h in sorted(by):
            run += sum(tok(t) for _, t in by[h])
            if run > rest:
                break
            want.update((*k, whole, i, t) for i, t in by[h])
    assert got == want


def test_op3_many_sources_fill_as_the_plain_rule(spark):
    rng = random.Random(6)
    rows = [("d", "en", f"s{i}", rng.choice([1, 5, 9, 100, 10_000]) * rng.randint(1, 30)) for i in range(900)] + [("d", None, None, 17)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    for share in (0.05, 0.6, 1.4, 3.0):
        total = share * sum(r[3] for r in rows)
        plan = op3_mixing.plan_leaves(spark, leaves, total, 2, None, (0.7, 0.7, 0.5)).collect()
        by = {k: sum(r[3] for r in rows if r[1] == k) for k in ("en", None)}
        top = dict(zip(by, op3_mixing.fill_exact(min(total, 2 * sum(by.values())), [2 * n for n in by.values()], [n**0.7 for n in by.values()])))
        for lang in by:
            mine = [r for r in rows if r[1] == lang]
            want = dict(zip((r[2] for r in mine), op3_mixing.fill_exact(top[lang], [2 * r[3] for r in mine], [r[3] ** 0.5 for r in mine])))
            got = {r.source: r.budget for r in plan if r.lang == lang}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_op3_clashing_names(spark, clash):
    out = op3_mixing.mix_sources(spark, clash, F.col("source"), share=5.0, epochs=1)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.where("epoch = 0 AND whole = 'kept' AND cut = 'kept' AND __p = 'kept' AND mix_tokens > 1").count() == 12


# --- op8


@pytest.fixture(scope="module")
def licences():
    rng = random.Random(1)
    vocab = ["river", "house", "of", "the", "and", "mit", "stone", "walked", "slowly", "0", "under", "in"]
    return op8_licenses.train(([" ".join(rng.choices(vocab, k=20)) for _ in range(600)], ["Permission was refused by the clerk.", "The licence fee rose again in spring."] * 20))


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
NOTICES = [("Available under GPLv3.", "gpl"), ("This file is under the GNU GPL v2.", "gpl"), ("Code: MIT / X11. Text: CC BY 4.0", "cc-by,mit"), ("river\n\n" + MIT.replace(", free", ",\nfree").replace("this software", "this\nsoftware") + "\n\nstone", "mit"), (MIT, "mit"), ("The driver's license was renewed.", ""), ("", ""), (None, ""), ("river stone " * 5000 + "\nLicensed under the Apache License, Version 2.0.\n" + "house " * 9000, "apache"), ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "cc-by-nc,mit")]


def test_op8_finds_notices_in_any_form(spark, licences):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(NOTICES + NOTICES[:1])], "doc_id long, text string, families string")
    got = {r.doc_id: r for r in op8_licenses.license_report(df, licences).collect()}
    assert [got[i].families for i in range(len(NOTICES))] == [w for _, w in NOTICES]
    assert got[0].asDict() | {"doc_id": 0} == got[len(NOTICES)].asDict() | {"doc_id": 0}
    assert op8_licenses.license_report(df.limit(0), licences).count() == 0


def test_op8_shortcut_is_exact(spark, licences):
    """Units, classes, templates and verdicts recomputed without any shortcut."""
    rng = random.Random(8)
    bits = [t for _, t in op8_licenses.notices()] + op8_licenses.GENERAL + ["river of the house", "mit stone", "GNU", "public", "version 2 of the river"]
    texts = [rng.choice(["\n", " ", "\n\n", "\n \t\n"]).join(rng.choices(bits, k=rng.randint(1, 4))) for _ in range(150)]
    got = {r.doc_id: [(p.at, p.family, round(p.probability, 4)) for p in r.paragraphs] for r in op8_licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licences).collect()}
    shapes = op8_licenses.templates()
    for i, text in enumerate(texts):
        want = []
        for b, block in enumerate(re.split(r"\n[ \t\r]*\n[ \t\n\x0B\f\r]*", text)):
            lines, parts = block.split("\n"), re.split(r"\n|(?<=[.;!?])\s+", block)
            units = [(str(b), block)] + ([(f"{b}.{j}", x) for j, x in enumerate(lines)] if len(lines) > 1 else []) + ([(f"{b}/{j}", x) for j, x in enumerate(parts)] if len(parts) > len(lines) else [])
            for at, unit in units:
                p = licences.probabilities(unit)
                f = max(p, key=p.get)
                if f != "unknown":
                    g = set(op8_licenses.ngrams(unit))
                    sure = p[f] >= licences.least and any(len(g.intersection(t["g"])) >= t["need"] for t in shapes if t["f"] == f)
                    want.append((at, f if sure else "unknown", round(p[f], 4)))
        assert [(a, f) for a, f, _ in got[i]] == [(a, f) for a, f, _ in want]
        assert all(abs(x[2] - y[2]) < 2e-4 for x, y in zip(got[i], want))


# --- op7


def plain_parse(data):
    """Payload, time stamps and access points, byte by byte, sharing nothing with the operator."""
    pmt = es = None
    pts, access, pes, out = [], [], b"", b""

    def close():
        nonlocal out
        if pes:
            assert pes[:3] == b"\x00\x00\x01" and int.from_bytes(pes[4:6], "big") == len(pes) - 6
            t = int.from_bytes(pes[9:14], "big")
            pts.append((t >> 33 & 7) << 30 | (t >> 17 & 0x7FFF) << 15 | t >> 1 & 0x7FFF)
            out += pes[9 + pes[8] :]

    for i in range(0, len(data), 188):
        p = data[i : i + 188]
        pid, at = int.from_bytes(p[1:3], "big") & 0x1FFF, 4
        if p[3] & 0x20:
            at += 1 + p[4]
            if p[4] and p[5] & 0x40 and pid == es:
                access.append(i)
        if pid == 0:
            pmt = int.from_bytes(p[at + 1 + 10 : at + 1 + 12], "big") & 0x1FFF
        elif pid == pmt:
            es = int.from_bytes(p[at + 1 + 13 : at + 1 + 15], "big") & 0x1FFF
        elif pid == es:
            if p[1] & 0x40:
                close()
                pes = b""
            pes += p[at:]
    close()
    return out, pts, access


@pytest.mark.parametrize("size", [576, 4608, 4609 * 576 // 576, 200_000])
def test_op7_other_parser_agrees(size):
    payload = random.Random(size).randbytes(size)
    data = op7_mpeg_ts.mux(payload)
    s = op7_mpeg_ts.demux(data)
    assert plain_parse(data) == (payload, s.pts, s.access_points) and s.payload == payload


def section(table, ident, body):
    return op7_mpeg_ts._section(table, ident, body)


def packet(pid, cc, body, begins=False, adaptation=b""):
    """One packet; a short body is filled up by the adaptation field."""
    room = 184 - len(body)
    field = b""
    if room or adaptation:
        inner = (adaptation or b"\0").ljust(room - 1, b"\xff") if room > 1 else b""
        field = bytes([len(inner)]) + inner
    out = bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | cc & 15]) + field + body
    assert len(out) == 188
    return out


def packets(pid, cc, body, adaptation=b""):
    out, at = [], 0
    while at < len(body):
        room = 184 if out or not adaptation else 183 - len(adaptation)
        out.append(packet(pid, cc, body[at : at + room], not out, b"" if out else adaptation))
        at += room
        cc += 1
    return out, cc


def test_op7_takes_what_other_writers_do():
    data = random.Random(1).randbytes(900)
    programs = b"".join(n.to_bytes(2, "big") + (0xE300 + n).to_bytes(2, "big") for n in range(2, 90)) + b"\0\1\xe1\0"
    pat, _ = packets(0, 3, b"\0" + section(0, 7, programs))  # over several packets
    pmt, _ = packets(0x100, 3, (b"\0" + section(2, 1, b"\xe1\x23\xf0\x02\x09\x00" + b"\x1b\xe1\x23\xf0\x00")).ljust(184, b"\xff"))
    one, cc = packets(0x123, 5, b"\0\0\1\xe0\0\0\x80\x00\x00" + data[:500])  # a video stream may leave the length open
    two, _ = packets(0x123, cc + 7, b"\0\0\1\xe0" + (400 + 3).to_bytes(2, "big") + b"\x80\x00\x00" + data[500:] + b"\xff" * 7, b"\x80")  # a jump that the flag tells
    idle = bytes([0x47, 0x01, 0x23, 0x20 | one[1][3] & 15, 183, 0]) + b"\xff" * 182  # no payload, no count
    null = packet(0x1FFF, 9, b"\0" * 184)
    stream = [null, pat[0], null, *pat[1:], *pmt, *one[:2], one[1], idle, *one[2:], null, null, *two]
    assert len(pat) == 3 - (len(pat) == 2) and len(pat) > 1
    s = op7_mpeg_ts.demux(b"".join(stream))
    assert (s.continuity_errors, s.damaged, len(s.programs), s.streams) == (0, 0, 89, {0x123: 0x1B})
    assert s.payload == data
    assert op7_mpeg_ts.demux(b"".join([*stream, two[-1], two[-1]])).continuity_errors == 1  # a second repeat is none


def test_op7_table_is_written_and_clashing_names_give_way(spark, clash):
    got = op7_mpeg_ts.media_digests(spark, clash)
    assert "Scan parquet" in got._jdf.queryExecution().executedPlan().toString() or "FileScan" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 12
    media = op7_mpeg_ts.media_column(clash).withColumns({"Packets": F.lit("old"), "payload": F.lit("old")})
    out = op7_mpeg_ts.parse_media(media)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.where("packets > 0 AND damaged = 0").count() == 12


# --- op5


def plain_components(texts, k, pct):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    sets = [shingle(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(x) for x in sets]


@pytest.mark.parametrize("hot,k,pct", [(2_000, 3, 90), (3, 2, 80), (1, 1, 70)])
def test_op5_equals_brute_force_with_and_without_hot_shingles(spark, hot, k, pct):
    """Few words make shingles common; low hot bounds send them through longer chains."""
    rng = random.Random(hot)
    vocab = [f"w{i}" for i in range(14)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 14))) for _ in range(150)]
    for t in rng.sample(texts, 60):
        w = t.split()
        w.insert(rng.randrange(len(w) + 1), rng.choice(vocab))
        texts.append(" ".join(w))
    texts += [None, "", " \n", "W1 w2", "w1 W2"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(3)
    want, sizes = plain_components(texts, k, pct)
    got = {r.doc_id: r for r in op5_ngram_join.jaccard_components(spark, df, k, pct, hot=hot).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want and [got[i].n_shingles for i in range(len(texts))] == sizes


def test_op5_one_shingle_in_very_many_unrelated_texts(spark):
    """The chain of shingles keeps the number of pairs far below the square of the group."""
    n = 10_000
    rows = spark.range(n).select(F.col("id").alias("token_id"), F.lit(7).cast("long").alias("token"))
    open_ = rows.select("token", F.col("token_id").alias("id"), F.lit(20).alias("n"), F.lit(0).alias("pos"), F.lit(0).alias("band"), F.col("token_id").alias("component"))
    # positions 1.. hold shingles of the text's own, but for two texts that share all
    own = F.when(F.col("id") >= n - 2, F.lit(n)).otherwise(F.col("id"))
    prefixes = open_.select("id", F.concat(F.array(F.lit(7).cast("long")), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: own * 10 + i)).alias("prefix"))
    got = op5_ngram_join._across(spark, open_, prefixes, 80).collect()
    assert [(r.a, r.b) for r in got] == [(n - 2, n - 1)]


def test_op1_model_in_files_and_pieces_give_the_same(spark, monkeypatch):
    """A model too large to send lies in files, and rows are scored in small pieces; labels by the hundred."""
    o = op1_language_id
    labels = [a + b for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    rows = [(i, f"{x} {x}{x[::-1]} word{x} {x}ing {x}est of {x}" * 3, x, f"h{i % 7}.example.{x}") for i, x in enumerate(labels * 2)]
    rows += [(9000, None, "aa", None), (9001, "", None, "h1.example.aa"), (9002, "123", "zz", "x")]
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string")
    seen = lambda m: sorted(map(tuple, o.identify(spark, df, m, "text", F.col("lang"), F.col("host"), returned=["id"]).collect()))
    held = o.train(df, "text", "lang")
    want = seen(held)
    monkeypatch.setattr(o, "MODEL_BYTES", 0)
    monkeypatch.setattr(o, "BROADCAST_VOTES", 0)
    filed = o.train(df, "text", "lang")
    assert filed.files and not filed.grams and filed.languages == held.languages and filed.totals == held.totals
    for j in (0, 5, len(held.languages) - 1):
        assert (held.table(j)[0] == filed.table(j)[0]).all()
    again = seen(filed)
    assert [r[:3] for r in again] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(again, want, strict=True))
    batches = iter([pa.RecordBatch.from_pydict({"x": list(range(9))}), pa.RecordBatch.from_pydict({"x": pa.array([], pa.int64())})])
    cut = list(o._pieces(batches, o.CELLS // 2 - 1))
    assert [b.num_rows for b in cut] == [2, 2, 2, 2, 1, 0] and [v for b in cut for v in b.column(0).to_pylist()] == list(range(9))


def test_trie_memory_of_a_block(spark, monkeypatch):
    """What a block of tokens takes while it is scored, and a part while it is added up, is a few arrays, not dozens."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from veridoss.llm import op9_trie_lm as lm

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 20_000, 5_000))) for i in range(60)]
    trie = lm.train(spark, spark.createDataFrame(rows, "id long, text string"), 3, parts=2)
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    ((_, words, at),) = lm._blocks(iter([batch]), False)
    known, base = trie.vocabulary.look_up(words)
    monkeypatch.setattr(lm, "STEP", 1 << 14, raising=False)
    tracemalloc.start()
    trie.log_probs(known, base, at[:-1])
    block = tracemalloc.get_traced_memory()[1] / 8 / len(words)
    tracemalloc.stop()
    assert block < 20, block
    n = 200_000
    pairs = [rng.integers(0, 1_000, n), rng.integers(0, 1_000, n), np.zeros(n, np.int64), np.ones(n, np.int64)]
    want = {}
    for c, v in zip(*(x.tolist() for x in pairs[:2]), strict=True):
        want[c, v] = want.get((c, v), 0) + 1
    context, value, _, count = lm._fold_pairs(pairs)
    assert not pairs  # given up while they are added
    assert {(c, v): k for c, v, k in zip(context.tolist(), value.tolist(), count.tolist(), strict=True)} == want
