import hashlib
import json
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoss.config import Settings, load_settings
from veridoss.functions import scalars as S
from veridoss.functions.claims import segment
from veridoss.operators import absa, assess, chunking, relational, temporal, validation, vectors
from veridoss.plans import dossier
from veridoss.sources import readers, writers


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 16))
    rows, vecs = [], []
    for h in ("h1", "h2"):
        for i in range(12):
            text = f"Text {h} number {i}."
            rid = f"{h}r{i:04d}"
            rows.append((rid, h, f"20{15 + i // 6}-{1 + i % 6 * 2:02d}-01", float(i % 5 + 1), text, "", "room;staff" if i % 2 else "", "room:0.5;staff:-0.4" if i % 2 else "", None, "deberta_absa" if i % 4 == 0 else "distilled_proxy", "REAL" if i % 4 == 0 else "PROXY", i))
            v = centres[i % 3] + 0.02 * rng.normal(size=16)
            vecs.append((rid, [float(x) for x in v / np.linalg.norm(v)]))
    f = spark.createDataFrame(rows, "review_id string, hotel_id string, review_date string, rating double, review_text string, duplicate_group_id string, absa_aspect string, absa_sentiment string, absa_confidence double, absa_method string, absa_reusable_status string, input_row_position long").withColumn("text_sha256", F.sha2("review_text", 256))
    return f.cache(), spark.createDataFrame(vecs, "review_id string, embedding array<double>").cache()


def brute_complete(x, cut):
    groups = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(groups) > 1:
        best = min((max(d[a, b] for a in p for b in q), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if not best[0] < cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_complete_linkage_equals_brute_force(seed):
    x = vectors.unit(np.random.default_rng(seed).normal(size=(40, 4)))
    labels = vectors.cluster_labels(x, 0.7, "complete")
    got = {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)}
    assert got == brute_complete(x, 1 - 0.7)


def test_no_chaining_and_zero_vector():
    a, c = np.array([1.0, 0]), np.array([0, 1.0])
    x = np.stack([a, vectors.unit((a + c)[None])[0], c])
    assert len(set(vectors.cluster_labels(x, 0.70, "complete"))) == 2
    assert len(set(vectors.cluster_labels(x, 0.70, "single"))) == 1
    with pytest.raises(ValueError):
        vectors.cluster_labels(np.zeros((1, 2)), 0.8, "complete")


def test_dossier_round(spark, sample):
    f, v = sample
    rows = dossier.clustered(f, v, Settings())
    full = dossier.full(rows, Settings()).cache()
    got = {r.hotel_id: r for r in full.collect()}
    assert set(got) == {"h1", "h2"}
    one = got["h1"]
    assert one.hotel_metadata.review_count == 12 and len(one.semantic_clusters) == 3
    assert sum(c.unique_review_count for c in one.semantic_clusters) == 12
    assert all(len(c.representative_review_ids) == 3 for c in one.semantic_clusters)
    small = dossier.compact(full)
    c = small.where("hotel_id = 'h1'").first().semantic_clusters[0]
    assert [r.review_id for r in c.representative_reviews] == list(c.representative_review_ids)
    trace = dossier.traceability(full).collect()
    assert all(t.unresolved == 0 and t.misassigned == 0 for t in trace)
    assert dossier.compaction_report(full, small).count() == 2
    again = dossier.full(dossier.with_frozen_clusters(f, v, rows.select("review_id", "semantic_cluster_id")), Settings())
    assert again.count() == 2
    assert dossier.large_clusters(full, 0.8, least=2).count() == 6


def test_windows_partition_rows(spark, sample):
    f, _ = sample
    out = temporal.anchored_windows(f.withColumn("d", S.to_date(F.col("review_date"))), "hotel_id", "d", {"w": 365}).collect()
    assert all(r.w + r.before_w == 12 for r in out)


def test_unparsed_dates_form_a_period(spark):
    df = spark.createDataFrame([("a", "2020-01-05", 1.0), ("a", "junk", 2.0)], "e string, t string, r double").withColumn("d", S.to_date(F.col("t")))
    assert {r.period for r in temporal.period_summary(df, "e", "d", "r").collect()} == {"2020", "NaT"}


def test_packed_grammar(spark):
    df = spark.createDataFrame([("a:0.5;b:-1;c;d:x;e:1_000;f:nan",), (None,), ("",)], "s string")
    got = [r[0] for r in df.select(S.packed_scores(F.col("s"))).collect()]
    assert got == [[0.5, -1.0, 0.0], [], []]
    assert [r[0] for r in df.select(S.sentiment_class(F.col("s"))).collect()] == ["mixed", "unknown", "unknown"]


def test_sampling_is_a_prefix(spark):
    df = spark.createDataFrame([(f"h{i}",) for i in range(60) for _ in range(10 + i % 7)], "h string")
    got = relational.sample_entities(df, "h", 100, 20260812)
    rows = sorted(got.collect(), key=lambda r: r.rank_hash)
    assert sum(r.n for r in rows) >= 100 > sum(r.n for r in rows[:-1])
    with pytest.raises(Exception, match="fewer rows"):
        relational.sample_entities(df, "h", 10**6, 1).collect()
    with pytest.raises(ValueError):
        relational.sample_entities(df, "h", 0, 1)


def test_one_to_one_join_guards(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert relational.join_one_to_one(a, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"]).count() == 2
    with pytest.raises(Exception, match="repeats"):
        relational.join_one_to_one(a, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"]).collect()
    with pytest.raises(Exception, match="no match"):
        relational.join_one_to_one(a, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], True).collect()


def test_validation(spark, sample):
    f, v = sample
    checks = validation.review_checks(f, "review_id", "review_text", "review_date", "rating", "text_sha256") + validation.key_checks(f, "review_id", "features") + validation.method_checks(f, "review_id", "absa_method", "absa_reusable_status") + validation.vector_checks(v, "review_id", "embedding")
    validation.require(validation.report(checks))
    bad = f.withColumn("review_text", F.when(F.col("input_row_position") == 1, "other").otherwise(F.col("review_text")))
    with pytest.raises(validation.ValidationFailure, match="text_hash_differs"):
        validation.require(validation.report(validation.review_checks(bad, "review_id", "review_text", "review_date", "rating", "text_sha256")))


def test_package_checks_group_each_table_once(spark, tmp_path):
    rng = random.Random(3)
    some = lambda: rng.choice([None, *range(1, 40)])
    sha = hashlib.sha256(b"t").hexdigest()
    claims = [(some(), some(), "t", rng.choice([sha, sha, "", None]), rng.choice([None, 1, 2])) for _ in range(60)]
    reviews, compact, rare = ([(some(),) for _ in range(n)] for n in (30, 30, 20))
    vectors = [(some(), rng.choice([[0.5, 0.5], [0.5, 0.5], [0.5], [float("nan"), 0.5], None])) for _ in range(40)]
    chosen = [(some(), rng.choice([None, 1, 2])) for _ in range(30)]
    estimates = [("a", 5), ("b", None), ("c", 30_000)]
    c, v, k, r = ([x[0] for x in rows] for rows in (claims, vectors, compact, rare))
    of, held = [x[1] for x in claims], [x[0] for x in reviews]
    places = {(x[0], x[4]) for x in claims}
    lacking = lambda a, b: [x for x in set(a) if x is None or x not in b]
    bad = {
        "claims_id_missing": [x for x in c if x is None],
        "claims_id_repeats": [x for x, n in Counter(c).items() if n > 1],
        "claim_hash_differs": [x[0] for x in claims if x[3] != sha],
        "claims_of_no_review": lacking(of, held),
        "review_without_claims": lacking(held, of),
        "claim_without_vector": lacking(c, v),
        "vector_of_no_claim": lacking(v, c),
        "vector_of_other_size": [x for x, e in vectors if e != [0.5, 0.5]],
        "representative_misassigned": [x[0] for x in set(chosen) if None in x or x not in places],
        "compact_claim_unknown": lacking(k, c),
        "rare_claim_not_shown": lacking(r, k),
        "over_budget": ["c"],
    }
    assert all(bad.values()) and any(None in x for x in bad.values())
    kinds = {"claims": "claim_id long, review_id long, claim_text string, claim_text_sha256 string, cluster_id long", "reviews": "review_id long", "vectors": "claim_id long, embedding array<double>", "chosen": "claim_id long, cluster_id long", "compact": "claim_id long", "rare": "claim_id long", "estimates": "entity string, token_estimate long"}
    tables = []
    for (name, kind), rows in zip(kinds.items(), (claims, reviews, vectors, chosen, compact, rare, estimates), strict=True):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    whole = validation.report(validation.package_checks(*tables, 2))
    few = lambda x: sorted({str(i) for i in x if i is not None})[:5]
    assert {x["check"]: (x.n_bad, x.examples, x.ok) for x in whole.collect()} == {name: (len(x), few(x), False) for name, x in bad.items()}
    counts = whole.select("check", "n_bad", "ok")
    assert {x["check"]: x.n_bad for x in counts.collect()} == {name: len(x) for name, x in bad.items()}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    read = [x for x in plan.splitlines() if "Relation [" in x]
    assert sum("claim_text_sha256" in x for x in read) == 3 and sum("embedding" in x for x in read) == 2 and len(read) == 10
    assert "Window" not in plan and "Join" not in plan


def test_check_tells_sum_and_examples_from_one_exchange(spark):
    df = spark.range(400).select((F.col("id") % 100).alias("k")).unionAll(spark.createDataFrame([(None,)] * 3, "k long"))
    got = validation.check(df, "odd", F.coalesce(F.col("k") % 2 == 1, F.lit(True)), "k")
    assert [tuple(x) for x in got.collect()] == [("odd", 203, ["1", "11", "13", "15", "17"])]
    assert "Reused" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in validation.check(df, "none", F.lit(False), "k").collect()] == [("none", 0, [])]


def plain_claims(text):
    """(sentence, claim, start, stop, term, kind), one sentence after another, in plain Python."""
    out, si, at = [], 0, 0
    trim = lambda a, b: (a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip()))
    for end in [*(m.end() for m in re.finditer(r"[.!?]+(?=\s|$)", text)), len(text)]:
        a, b, at = *trim(at, end), end
        if a >= b:
            continue
        body = text[a:b]
        turn = re.search(r",\s*(but|although|however)\s+", body, re.I)
        stops = [*re.finditer(r";\s+", body)]
        if re.search(r"\b(so|therefore|because|thus|hence)\b", body, re.I) or not (turn or stops):
            found = [(a, b, "", "whole_sentence")]
        elif turn:
            found = [(*trim(a, a + turn.start()), turn[1].lower(), "contrast_left"), (*trim(a + turn.end(), b), turn[1].lower(), "contrast_right")]
        else:
            edges = [a, *(a + e for m in stops for e in m.span()), b]
            found = [(*trim(x, y), ";", "semicolon_part") for x, y in zip(edges[::2], edges[1::2])]
            found = [x for x in found if x[0] < x[1]]
        out += [(si, i, *x) for i, x in enumerate(found)]
        si += 1
    return out


def test_claims_equal_plain_ones(spark):
    import random

    rng = random.Random(2)
    bits = ["Nice room", ", but ", ",However ", "; ", ";", ". ", "! ", "?!\n", "... ", " so ", "because", "é\u00e4 ", "\U0001d11e", " ", "\t", "x.y", ", although", " fine", "\u00a0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)] + ["", None, "no end", "Nice room, but noisy street. Ok; fine; good!", "It was late, but fine because of rain."]
    df = spark.createDataFrame([(i, t, "2020-01") for i, t in enumerate(texts)], "input_row_position long, review_text string, review_date string")
    got = {}
    for r in segment(df).collect():
        assert r.claim_text == texts[r.input_row_position][r.source_text_start : r.source_text_end]
        got.setdefault(r.input_row_position, []).append((r.claim_id, r.sentence_index, r.claim_index, r.source_text_start, r.source_text_end, r.linking_term, r.link_type))
    for i, t in enumerate(texts):
        assert [x[1:] for x in sorted(got.get(i, []))] == plain_claims(t or ""), t
        assert [x[0] for x in sorted(got.get(i, []))] == [f"REVIEWS:r{i:06d}:c{k:03d}" for k in range(len(got.get(i, [])))]


def test_chunks(spark, sample):
    f, _ = sample
    chunks = chunking.build_chunks(f.withColumn("semantic_cluster_id", F.lit("c")), "hotel_id", 28_000)
    got = chunks.collect()
    assert sum(r.review_count for r in got) == 24 and all(r.chunk_id == "001_of_001" for r in got)
    dates = [x.review_date for x in got[0].reviews]
    assert dates == sorted(dates)


def test_entities_and_refresh(spark, sample):
    f, _ = sample
    ents = [("r1", "The Room was great", [("ASP-Positive", "Room.", None, None, 0.9), ("ASP-Positive", "room", 4, 8, 0.7), ("O", "was", 9, 12, 0.1)]), ("r2", "none", [])]
    df = spark.createDataFrame(ents, "review_id string, text string, e array<struct<entity_group:string,word:string,start:int,end:int,score:double>>")
    got = {r.review_id: r for r in absa.prediction_rows(absa.normalise_entities(df, "review_id", "text", "e", [("room", ["room", "rooms"])])).collect()}
    assert got["r1"].absa_aspect == "Room" and got["r1"].absa_canonical_aspect == "room" and got["r1"].extracted_aspect_count == 1
    assert got["r2"].inference_status == "success_no_aspects"
    preds = absa.prediction_rows(absa.normalise_entities(df, "review_id", "text", "e", []))
    assert absa.explode_predictions(preds).count() == 1
    feats = spark.createDataFrame([("r1", "p", "distilled_proxy", "PROXY"), ("r2", "p", "distilled_proxy", "PROXY"), ("r3", "p", "distilled_proxy", "PROXY")], "review_id string, absa_aspect string, absa_method string, absa_reusable_status string")
    clusters = spark.createDataFrame([(x, "c") for x in ("r1", "r2", "r3")], "review_id string, semantic_cluster_id string")
    out = {r.review_id: r for r in absa.refresh_features(feats, preds.drop("absa_method"), clusters).collect()}
    assert out["r3"].absa_method == "none" and out["r3"].absa_reusable_status == "NO_RESULT" and out["r1"].absa_method == "deberta_absa"
    assert out["r1"].source_absa_method == "distilled_proxy"


def provider(texts):
    if any("bad" in t for t in texts):
        raise RuntimeError("no")
    return [[{"word": t.split()[0]}] for t in texts]


def test_inference_falls_back_by_row(spark):
    df = spark.createDataFrame([("1", "good one"), ("2", "bad one"), ("3", " "), ("4", None)], "review_id string, t string")
    assert {r.review_id: r.status for r in absa.infer(df, "review_id", "t", lambda texts: [[{"word": t}] if "bad" not in t else 1 / 0 for t in texts]).collect()} == {"1": "success", "2": "failed_model", "3": "failed_blank_text", "4": "failed_blank_text"}


def test_assessment_rules(spark, sample):
    f, _ = sample
    ev = lambda ids, rec: [("s", ids, rec)]
    schema = "hotel_id string, evidence_review_count long, band string, band_label string, band_position string, recurrence_level string, property_relevance_status string, material_evidence_ids array<string>, positive_evidence array<struct<summary:string,review_ids:array<string>,recurrence:string>>, concern_evidence array<struct<summary:string,review_ids:array<string>,recurrence:string>>"
    rows = [("h1", 12, "F", "low", "upper", "C1", "P3", ["nope"], [], ev(["h1r0000"], "C1")), ("h2", 12, "A", "top", "upper", "C2", "P1", [], [], ev(["h2r0000", "h2r0006"], "C2"))]
    got = {r.hotel_id: r for r in assess.check_assessments(spark.createDataFrame(rows, schema), f, "hotel_id", {"A": "top", "F": "low"}).collect()}
    assert set(got["h1"].errors) == {"cited ids absent", "recurrence without two concern ids", "band needs C2 or C3"} and got["h1"].warnings == ["relevance P3"]
    assert got["h2"].errors == [] and got["h2"].warnings == []
    shown = assess.display_values(spark.createDataFrame(rows, schema), {("F", "upper"): 3.4, ("A", "upper"): 5.0}).collect()
    assert {r.hotel_id: r.display_value for r in shown} == {"h1": 3.4, "h2": 5.0}


def test_sources_and_sinks(spark, sample, tmp_path):
    f, v = sample
    np.savez(tmp_path / "e.npz", emb=np.eye(3, dtype="float32"), review_id=np.array(["a", "b", "c"]), method=np.array("m"))
    assert readers.npz_shape(str(tmp_path / "e.npz")) == (3, 3)
    assert readers.embeddings(spark, str(tmp_path / "e.npz"), "m").count() == 3
    writers.entity_json(f.groupBy("hotel_id").count(), "hotel_id", str(tmp_path / "out"))
    m = writers.manifest(spark, str(tmp_path / "out")).cache()
    assert m.count() >= 2 and writers.verify_manifest(m, m).count() == 0
    assert writers.verify_manifest(m, m.withColumn("sha256", F.lit("x"))).count() == m.count()
    d = writers.signed_definition(str(tmp_path / "s.json"), {"hotel_ids": ["a"]})
    assert readers.sample_definition(str(tmp_path / "s.json")) == d
    (tmp_path / "s.json").write_text(json.dumps(d | {"hotel_ids": ["b"]}))
    with pytest.raises(ValueError):
        readers.sample_definition(str(tmp_path / "s.json"))
    (tmp_path / "c.yaml").write_text("similarity_threshold: 0.9\n")
    assert load_settings(str(tmp_path / "c.yaml")).similarity_threshold == 0.9


def test_stream(spark, tmp_path):
    from veridoss.streaming import incremental as inc

    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-06-01 00:00:00", 2.0), (1, "2025-01-01 00:00:00", 3.0)], "u long, t string, v double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    q = inc.write_available(inc.summaries(inc.read_stream(spark, str(tmp_path / "in"), "u long, v double, ts timestamp"), "u", "ts", "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def plain_diverse(rows, most):
    """The choice one row after another, in plain Python."""
    rows = sorted(rows, key=lambda r: (r["review_date"], r["claim_id"]))
    reviews, picked, used = len({r["review_id"] for r in rows}), {}, set()

    def offer(r, why):
        if len(picked) < most and r["claim_id"] not in picked and not (r["review_id"] in used and reviews > len(picked)):
            picked[r["claim_id"]] = why
            used.add(r["review_id"])

    near = lambda r: (-r["centroid_similarity"], -len(r["claim_text"]), r["claim_id"])
    if len(rows) > 1:
        offer(rows[0], "earliest_temporal_coverage")
        offer(next(r for r in rows if r["review_date"] == rows[-1]["review_date"]), "latest_temporal_coverage")
        offer(rows[len(rows) // 2], "middle_temporal_coverage")
        for value in sorted({r["rating"] for r in rows}):
            offer(min((r for r in rows if r["rating"] == value), key=near), f"rating_diversity_{value}")
        for value in ("positive", "negative", "mixed"):
            if some := [r for r in rows if r["sentiment_class"] == value]:
                offer(min(some, key=near), f"sentiment_variation_{value}")
    for r in sorted(rows, key=lambda r: (-r["centroid_similarity"], -len(r["claim_text"]), r["absa_method"], r["claim_id"])):
        offer(r, "centroid_proximity_with_deterministic_tiebreaks")
    return list(picked.items())


@pytest.mark.parametrize("most", [1, 4, 9, 14])
def test_diverse_representatives_equal_a_plain_choice(spark, most):
    import random

    from veridoss.operators.vectors import diverse_representatives

    rng, rows = random.Random(most), []
    for c in range(25):
        for i in range(rng.randint(1, 14)):
            rows.append({"e": "h", "c": f"k{c}", "claim_id": f"c{c:02d}{i:02d}", "review_id": f"r{rng.randint(0, rng.choice([1, 4, 12]))}", "review_date": f"2020-01-{rng.randint(1, 9):02d}", "rating": float(rng.randint(1, 4)), "sentiment_class": rng.choice(["positive", "negative", "mixed", "neutral"]), "centroid_similarity": rng.randint(1, 5) / 8, "claim_text": "x" * rng.randint(0, 3), "absa_method": rng.choice("ab")})
    got = {}
    for r in diverse_representatives(spark.createDataFrame(rows), "e", "c", most).collect():
        got.setdefault(r.c, []).append((r.selection_rank, r.claim_id, r.selection_reason))
    for c in {r["c"] for r in rows}:
        assert [x[1:] for x in sorted(got[c])] == plain_diverse([r for r in rows if r["c"] == c], most)


def test_rows_are_clustered_in_order_of_date(spark):
    """Ties go to the earlier row: b joins a or c, whichever comes first by date."""
    from veridoss.operators.vectors import cluster

    rows = [("h", "a", "2020-03-01", [1.0, 0.0]), ("h", "b", "2020-02-01", [0.8, 0.6]), ("h", "c", "2020-01-01", [0.28, 0.96])]
    df = spark.createDataFrame(rows, "e string, i string, d string, v array<double>")
    by_id = {r.i: r.cluster_id for r in cluster(df, "e", "i", "v", 0.75).collect()}
    by_date = {r.i: r.cluster_id for r in cluster(df, "e", "i", "v", 0.75, date="d").collect()}
    assert by_id["a"] == by_id["b"] != by_id["c"] and by_date["b"] == by_date["c"] != by_date["a"]


def test_settings_read_the_format_keys(tmp_path):
    from veridoss.config import load_settings, resolved

    path = tmp_path / "s.yaml"
    path.write_text("semantic_grouping_method: single_linkage\nrequire_minilm_verified: false\nallowed_absa_methods: [none]\nrandom_seed: 7\n")
    s = load_settings(str(path))
    assert (s.grouping_method, s.require_verified, s.allowed_methods, s.random_seed) == ("single_linkage", False, ("none",), 7)
    path.write_text("colour: red\n")
    with pytest.raises(ValueError):
        load_settings(str(path))
    assert resolved(str(path), "x/y") == tmp_path / "x" / "y"


def test_shared_parts_of_model_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    from veridoss.operators import absa

    assert absa.checked_labels(["Positive", "NEGATIVE", "Neutral"]) == ["positive", "negative", "neutral"]
    with pytest.raises(ValueError):
        absa.checked_labels(["LABEL_0", "LABEL_1", "LABEL_2"])
    assert {"python", "pyspark", "model_x"} <= set(absa.environment({"x": "1"}))
    df = spark.createDataFrame([("a",), ("b",)], "review_id string")
    fails = df.select("review_id", F.when(F.col("review_id") == "a", "success").otherwise("failed").alias("inference_status"))
    first = absa.resumed(spark, df, str(tmp_path / "p"), "review_id", lambda rows: rows.join(fails, "review_id"), 2)
    assert {r.review_id: r.inference_status for r in first.collect()} == {"a": "success", "b": "failed"}
    again = absa.resumed(spark, df, str(tmp_path / "p"), "review_id", lambda rows: rows.withColumn("inference_status", F.lit("success")), 2)
    assert {r.review_id: r.inference_status for r in again.collect()} == {"a": "success", "b": "success"}


def test_claims_of_very_long_texts(spark):
    """Doubling a text must not do more than double the time; sums of offsets hold over many steps."""
    import time

    took = {}
    for n in (1_000, 25_000, 50_000):
        text = "Good room, but small; nice staff; fine. " * n + "a; " * n
        start = time.time()
        got = segment(spark.createDataFrame([(text, 1, "2020-01-01")], "review_text string, input_row_position long, review_date string"))
        rows = got.agg(F.count("*").alias("n"), F.max("source_text_end").alias("end"), F.count_if(F.expr("substring(review_text, source_text_start + 1, 1) = substring(claim_text, 1, 1)")).alias("same") if n == 1_000 else F.lit(0).alias("same")).first()
        took[n] = time.time() - start
        assert rows.n == 3 * n and rows.end == len(text) - 1
        assert n > 1_000 or rows.same == rows.n
    assert took[50_000] < 4 * took[25_000] + 2


@pytest.mark.parametrize("kind", ["complete", "average", "single"])
def test_large_entities_in_blocks_equal_one_task(spark, kind):
    """Blocks of 16 rows: pairs of blocks, components over tables, links a component; copies, errors and small entities beside them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 8))
    x = centres[rng.integers(0, 9, 160)] + rng.normal(size=(160, 8)) * 0.45
    x[50:60] = x[40]
    rows = [("a" if k < 110 else "b", f"r{k:04d}", f"2020-01-{k % 27 + 1:02d}", x[k].tolist()) for k in range(160)]
    rows += [("z", f"z{k}", "2020-01-01", [0.0] * 8) for k in range(30)] + [("q", "q1", None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "e string, i string, d string, v array<double>")
    one, many = ({r.i: (r.cluster_id, r.error) for r in vectors.cluster(df, "e", "i", "v", 0.7, kind, date="d", block=b).collect()} for b in (2048, 16))
    assert one == many and len(one) == len(rows) and {e for c, e in many.values() if c is None} == {"a vector has no length"}


def test_sparse_and_chained_linkage_equal_the_matrix():
    rng = np.random.default_rng(6)
    x = vectors.unit(rng.normal(size=(12, 6))[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6)) * 0.4)
    as_sets = lambda label: {frozenset(np.flatnonzero(label == k)) for k in np.unique(label)}
    weight = rng.integers(1, 4, 400)
    for cut in (0.1, 0.3, 0.6):
        assert (vectors.sparse_complete(x, cut) == vectors.linkage(x, cut, "complete")).all()
        assert as_sets(vectors.chained_average(x, weight, cut)) == as_sets(vectors.linkage(x, cut, "average", weight))


@pytest.mark.parametrize("kind", ["complete", "average"])
def test_vectors_that_entities_share_are_compared_once(spark, kind, monkeypatch):
    """40 entities over the same 60 vectors: blocks of the vectors meet, not blocks of each entity's rows."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5, 8))[rng.integers(0, 5, 60)] + rng.normal(size=(60, 8)) * 0.45
    rows = [(f"e{e:02d}", f"r{e:02d}{k:02d}", x[k].tolist()) for e in range(40) for k in range(60) if (e * 7 + k) % 5]
    df = spark.createDataFrame(rows, "e string, i string, v array<double>")
    want = {r.i: r.cluster_id for r in vectors.cluster(df, "e", "i", "v", 0.7, kind).collect()}
    met, plain = [], vectors.with_blocks
    monkeypatch.setattr(vectors, "with_blocks", lambda r, *a: met.append(r.count()) or plain(r, *a))
    assert {r.i: r.cluster_id for r in vectors.cluster(df, "e", "i", "v", 0.7, kind, block=16).collect()} == want
    assert met == [60] and len(set(want.values())) > 80


def test_complete_linkage_holds_a_bounded_number_of_pairs():
    """All 4.5 million pairs of 3,000 rows lie below the cut; holding each took some 300 bytes."""
    import tracemalloc

    rng = np.random.default_rng(8)
    x = vectors.unit(rng.normal(size=8) + rng.normal(size=(3_000, 8)) * 0.3)
    tracemalloc.start()
    got = vectors.sparse_complete(x, 0.9, 60_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == vectors.linkage(x, 0.9, "complete")).all() and most < 600e6
    few = vectors.unit(rng.normal(size=(5, 6))[rng.integers(0, 5, 300)] + rng.normal(size=(300, 6)) * 0.5)
    for cut, entries in ((0.2, 1), (0.6, 1), (0.6, 6_000), (1.5, 1)):
        assert (vectors.sparse_complete(few, cut, entries) == vectors.linkage(few, cut, "complete")).all()


def test_statistics_of_large_groups_in_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if k < 70 else "b", f"r{k}", rng.normal(size=5).tolist()) for k in range(100)]
    df = spark.createDataFrame(rows, "e string, i string, v array<double>").withColumn("c", F.lit("x"))
    plain = vectors.unit(np.array([r[2] for r in rows[:70]])) @ vectors.unit(np.array([r[2] for r in rows[:70]])).T
    for block in (2048, 16):
        pairs = {r.e: r.pairs for r in vectors.pair_counts(df, "e", "i", "v", -0.1, block).collect()}
        assert pairs["a"] == (np.triu(plain >= -0.1, 1)).sum()
        stats = {r.i: r for r in vectors.centroid_stats(df, "e", "c", "i", "v", block).collect()}
        assert len(stats) == 100 and abs(stats["r3"].minimum_pairwise_similarity - (plain + 3 * np.eye(70)).min()) < 1e-9
        assert abs(stats["r3"].mean_pairwise_similarity - (plain.sum() - 70) / (70 * 69)) < 1e-9


def test_compact_takes_records_in_linear_time(spark):
    import time

    took = {}
    for n in (4_000, 16_000):
        docs = spark.range(1).select(
            F.lit("h").alias("hotel_id"),
            F.expr(f"transform(sequence(1, {n}), i -> struct(concat('c', i) AS semantic_cluster_id, array(concat('r', i), 'none', concat('r', i % 7 + 1)) AS representative_review_ids))").alias("semantic_clusters"),
            F.expr(f"transform(sequence(1, {n}), i -> struct(concat('r', i) AS review_id, concat('text ', i) AS review_text))").alias("review_evidence_records"),
        )
        docs = docs.union(spark.createDataFrame([("empty", [], [])], docs.schema))
        start = time.time()
        out = {r.hotel_id: r for r in dossier.compact(docs).collect()}
        took[n] = time.time() - start
        assert out["empty"].semantic_clusters == [] and "review_evidence_records" not in out["h"]
        assert [[x.review_id for x in c.representative_reviews] for c in out["h"].semantic_clusters] == [[f"r{i}", f"r{i % 7 + 1}"] for i in range(1, n + 1)]
    assert took[16_000] < 10 * took[4_000] + 2


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_by_pointers_equal_the_fold(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("abc"[k % 3 if k > 20 else 0], f"{rng.integers(0, 50):02d}" if rng.random() < 0.9 else None, f"i{rng.integers(0, 400):03d}", int(rng.choice([0, 1, 5, 30, 200]))) for k in range(500)] + [("one", "01", "i", 9)]
    df = spark.createDataFrame(rows, "e string, d string, i string, n long")
    names = ["e", "d", "i", "cost", "chunk_no", "chunks"]
    fold, linked = (sorted(tuple(r) for r in chunking.assign_chunks(df, "e", "d", "i", "n", 60, items=most).select(*names).collect()) for most in (10_000, 20))
    assert fold == linked and len(fold) == len(rows)


def test_chunks_of_a_million_items(spark):
    df = spark.range(1_000_000).select(F.lit("e").alias("e"), F.lit("").alias("d"), F.format_string("%07d", "id").alias("i"), (F.col("id") * 37 % 211).alias("n"))
    got = chunking.assign_chunks(df, "e", "d", "i", "n", 100_000)
    per = got.groupBy("chunk_no").agg(F.sum("cost").alias("c"), F.count("*").alias("n")).orderBy("chunk_no").collect()
    assert sum(r.n for r in per) == 1_000_000 and [r.chunk_no for r in per] == list(range(1, len(per) + 1))
    assert all(100_000 - 214 < r.c <= 100_000 for r in per[:-1])


def test_schema_faults_at_every_level():
    from veridoss.operators.workflow import schema_faults

    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "maxItems": 2, "items": {"type": ["integer", "null"], "minimum": 0}}, "b": {"enum": ["x", 1]}, "c": {"type": "object", "additionalProperties": {"type": "string", "pattern": "^k"}}, "d": {"type": "number"}}}
    assert schema_faults({"a": [1, None], "b": 1, "c": {"z": "k"}, "d": 0.5}, schema) == [] == schema_faults({"a": [2.0]}, schema)
    for value, where in (([], "$: not object"), ({}, "$.a: missing"), ({"a": [1, 2, 3]}, "$.a: 3 items"), ({"a": [True]}, "$.a[0]: not integer or null"), ({"a": [-1]}, "$.a[0]: out of bounds"), ({"a": [], "b": True}, "$.b: not among the allowed values"), ({"a": [], "c": {"z": "q"}}, "$.c.z: not of the form asked for"), ({"a": [], "e": 1}, "$.e: not a property"), ({"a": [1.5], "d": "1"}, "$.a[0]: not integer or null")):
        assert where in schema_faults(value, schema)


def test_wrong_answers_at_depth_are_asked_for_again(spark):
    from veridoss.operators.workflow import call

    said = {}

    def model(payload):
        said[payload] = said.get(payload, 0) + 1
        return json.dumps({"a": [{"b": "x" if said[payload] == 1 and payload != "p2" else 1}]})

    schema = {"properties": {"a": {"items": {"properties": {"b": {"type": "integer"}}}}}}
    df = spark.createDataFrame([("p1",), ("p2",), (None,)], "p string").coalesce(1).withColumn("k", F.coalesce("p", F.lit("none")))
    got = {r.k: r for r in call(df, ["k"], "p", model, wait=0.0, schema=schema).collect()}
    assert got["p1"].attempts == 2 and got["p2"].attempts == 1 and got["none"].error == "no payload"


def test_order_faults_read_differing_ranges_alone(spark):
    a = spark.range(10_000).select(F.col("id").alias("p"), F.col("id").cast("string").alias("i"))
    b = a.withColumn("i", F.when(F.col("p").isin(5, 6), F.lit("x")).otherwise(F.col("i"))).where("p <> 7777").unionByName(a.where("p = 9000")).unionByName(spark.createDataFrame([(None, "n")], "p long, i string"))
    got, want = (sorted((str(r) for r in f(a, b, "p", "i").collect())) for f in (relational.order_faults, relational.position_mismatches))
    assert got == want and len(want) == 4
    assert relational.order_faults(a, a.repartition(3), "p", "i").count() == 0 and relational.order_faults(a.limit(0), a.limit(0), "p", "i").count() == 0


def test_archives_are_read_by_ranges(spark, tmp_path):
    import zipfile

    from veridoss.sources import archives

    x, ids = np.arange(3_000, dtype="float32").reshape(1_000, 3), np.array([f"r{k}" for k in range(1_000)])
    (tmp_path / "n").mkdir()
    np.savez(tmp_path / "n" / "one.npz", emb=x, review_id=ids, method=np.array("m"))
    np.savez_compressed(tmp_path / "n" / "two.npz", emb=x[:10].astype("float64"), review_id=ids[:10], method=np.array("m"))
    df = archives.npz_rows(spark, f"file://{tmp_path}/n/one.npz", "m", 100)
    assert df.rdd.getNumPartitions() == 10 and df.select(F.spark_partition_id()).distinct().count() == 10
    assert sorted((r.position, r.review_id, list(r.embedding)) for r in df.collect()) == [(k, f"r{k}", x[k].tolist()) for k in range(1_000)]
    assert archives.npz_rows(spark, str(tmp_path / "n"), "m", 100).count() == 1_010
    shapes = {(r.file.rsplit("/", 1)[1], r.member): list(r["shape"]) for r in archives.npz_headers(spark, str(tmp_path / "n")).collect()}
    assert shapes["one.npz", "emb"] == [1000, 3] and shapes["two.npz", "review_id"] == [10] and shapes["one.npz", "method"] == []
    with open(tmp_path / "n" / "one.npz", "r+b") as f:  # the header is enough for shapes: vectors may be damaged
        f.seek(archives.array_header(str(tmp_path / "n" / "one.npz"), "emb.npy").at + 4_000)
        f.write(b"\0" * 400)
    assert archives.array_header(str(tmp_path / "n" / "one.npz"), "emb.npy").shape == (1000, 3)
    with pytest.raises(Exception, match="not other"):
        archives.npz_rows(spark, str(tmp_path / "n"), "other").count()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for k in range(200):
            z.writestr(f"d/{k}.json", json.dumps({"k": k, "pad": "x" * 500}), zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.writestr("readme.txt", "no")
    got = archives.zip_members(spark, str(tmp_path / "z.zip"), ".json", 5_000)
    assert got.rdd.getNumPartitions() > 5
    assert sorted(json.loads(bytes(r.content))["k"] for r in got.collect()) == list(range(200))


def test_a_stream_that_is_stopped_does_no_row_twice(spark, tmp_path):
    from veridoss.streaming.resumed import infer_stream

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(40).select(F.col("id").cast("string").alias("i")).repartition(4).write.parquet(source)
    calls = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            calls.add(len(frame))
            yield frame

    done, stop = [], [2]

    def work(batch):
        if len(done) == stop[0]:
            raise RuntimeError("stopped")
        done.append(1)
        return batch.mapInPandas(count, "i string")

    with pytest.raises(Exception, match="stopped"):
        infer_stream(spark, source, "i string", work, out, 1)
    stop[0] = 99
    got = infer_stream(spark, source, "i string", work, out, 1)
    assert sorted(int(r.i) for r in got.collect()) == list(range(40)) and calls.value == 40
    spark.range(40, 50).select(F.col("id").cast("string").alias("i")).write.mode("append").parquet(source)
    assert infer_stream(spark, source, "i string", work, out, 1).count() == 50 and calls.value == 50


def test_signed_definitions_of_many_entities(spark, tmp_path):
    df = spark.createDataFrame([("a b", 3, None, ["x", "é"]), ("c", 0, 1.5, []), (None, 1, 2.0, None)], "e string, n long, r double, l array<string>")
    writers.files(writers.signed(df, "e"), "name", "content", str(tmp_path / "d"))
    for name, body in {"none.json": b"[1]", "bad.json": b"{", "bytes.json": b"\xff", "unsigned.json": b'{"n": 1}'}.items():
        (tmp_path / "d" / name).write_bytes(body)
    one = next((tmp_path / "d").glob("c_*.json"))
    one.write_text(one.read_text().replace('"n": 0', '"n": 5'))
    got = {r.file.split("_")[0]: (r.definition, r.fault) for r in readers.signed_definitions(spark, str(tmp_path / "d"), "n long, r double, l array<string>").collect()}
    assert got["a"][0].n == 3 and got["a"][0].l == ["x", "é"] and got["a"][1] is None and got["x"][0].n == 1
    assert all(got[k][0] is None and "match" in got[k][1] for k in ("c", "unsigned.json"))
    assert "object" in got["none.json"][1] and "no JSON" in got["bad.json"][1] and "no JSON" in got["bytes.json"][1]
    for f in (tmp_path / "d").glob("a_*.json"):  # what tasks sign, the driver's own reader takes
        assert readers.sample_definition(str(f))["n"] == 3
    assert writers.files(writers.signed(df.limit(0), "e"), "name", "content", str(tmp_path / "none")).count() == 0


def test_settings_files_with_faults(spark, tmp_path):
    bodies = {"a.yaml": "representatives_per_cluster: 5\naspects:\n  - canonical: staff\n    aliases: [host, staff, host]\n  - canonical: food\n", "b.yaml": "colour: red\n", "c.yaml": "- 1\n", "d.yaml": "# none\n", "e.yaml": "random_seed: [1]\n", "f.yaml": "a: [\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    got = {r.file: r for r in readers.settings_files(spark, str(tmp_path)).collect()}
    assert got["a.yaml"].settings.representatives_per_cluster == 5 and [(s.canonical, s.aliases) for s in got["a.yaml"].specs] == [("staff", ["host", "staff"]), ("food", [])]
    assert got["d.yaml"].settings.similarity_threshold == Settings().similarity_threshold and got["d.yaml"].specs is None
    assert [w.name for w in got["d.yaml"].settings.windows] == [n for n, _ in Settings().windows]
    assert all(got[k].fault and got[k].settings is None for k in ("b.yaml", "c.yaml", "e.yaml", "f.yaml"))


def test_reports_by_key(spark):
    facts = spark.createDataFrame([("a", 1), (None, 2), ("empty", None)], "k string, n long")
    rows = spark.createDataFrame([("a", "y|z", 1), ("a", None, 2), (None, "p\nq", 3), ("other", "o", 4)], "k string, s string, m long")
    got = {bytes(r.content).decode() for r in writers.reports(facts, rows, "k").collect()}
    assert '{"k":"a","n":1}' in got and '{"k":null,"n":2}' in got and len(got) == 6
    assert "# Run\n\n- k: a\n- n: 1\n\n| s | m |\n| --- | --- |\n|  | 2 |\n| y\\|z | 1 |\n" in got
    assert "# Run\n\n- k: \n- n: 2\n\n| s | m |\n| --- | --- |\n| p q | 3 |\n" in got
    assert "# Run\n\n- k: empty\n- n: \n\n| s | m |\n| --- | --- |\n" in got
    with pytest.raises(ValueError):
        writers.reports(facts, rows, "k", most=1)


def test_missing_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("{}")
    (tmp_path / "a" / "z.json").write_text("")
    wanted = spark.createDataFrame([("a/x.json",), ("a/y.json",), ("b/x.json",), ("a/z.json",), (None,)], "path string")
    assert {r.path for r in validation.missing_files(spark, str(tmp_path), wanted).collect()} == {"a/y.json", "a/z.json", "b/x.json", None}


def test_compaction_of_parts(spark, sample):
    """Sizes told from a document's parts are those of whole documents, to the byte; no task gathers an entity's texts for them."""
    f, v = sample
    rows = dossier.clustered(f, v, Settings())
    heads, records = dossier.parts(rows, Settings(), {"table": "t"})
    whole = dossier.nested(heads, records).cache()
    small = dossier.compact(whole)
    got = dossier.compaction_of_parts(heads, records)
    assert sorted(map(str, got.collect())) == sorted(map(str, dossier.compaction_report(whole, small).select(*got.columns).collect()))
    shown = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).collect())
    assert shown(dossier.compact_parts(heads, records)) == shown(small)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(review_date" not in plan


def test_document_pair_shuffles_ids(spark):
    """Documents that are read back are parsed before they are matched by stem: the join moves ids, not texts."""
    from veridoss.plans.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    plan = QUERIES["document_pair"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("from_json")


def test_edges_are_made_once(spark):
    """Edges that would differ if made again, as a forest does that follows the order of shuffled rows: both ways of an edge come from one of them."""
    import random

    import pandas as pd

    from veridoss.operators.graphs import components

    def stars(frames):
        for pdf in frames:
            for e in pdf["id"]:
                hub = random.SystemRandom().randrange(6)
                yield pd.DataFrame({"e": [str(e)] * 5, "u": [str(k) for k in range(6) if k != hub], "v": [str(hub)] * 5})

    got = components(spark.range(40).mapInPandas(stars, "e string, u string, v string"))
    assert {(r.e, r.id, r.component) for r in got.collect()} == {(str(e), str(k), "0") for e in range(40) for k in range(6)}


@pytest.mark.parametrize("kind", ["complete", "average", "single"])
@pytest.mark.parametrize("block", [2048, 16])
def test_rows_that_name_vectors_by_key(spark, kind, block):
    """The same clusters and statistics as rows with their vectors, also for equal vectors under two keys and for entities with errors."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 50)] + rng.normal(size=(50, 8)) * 0.45
    x[40:43], x[49] = x[7], 0.0
    keys = spark.createDataFrame([(k, x[k].tolist()) for k in range(50)], "k long, v array<double>")
    rows = [(f"e{e}", f"r{e}{n:03d}", f"2020-01-{(n * 7 + e) % 27 + 1:02d}", int(k)) for e in range(5) for n, k in enumerate(rng.integers(0, 49, 60))]
    rows += [("z", "z1", "2020-01-01", 49), ("z", "z2", "2020-01-01", 3), ("e1", "gone", "2020-01-01", 99), (None, "none", "2020-01-01", 1)]
    df = spark.createDataFrame(rows, "e string, i string, d string, k long")
    whole = df.where("e IS NOT NULL").join(keys, "k")
    want = {r.i: (r.cluster_id, r.error) for r in vectors.cluster(whole, "e", "i", "v", 0.7, kind, date="d").collect()}
    shared = df.join(vectors.cluster_shared(df, keys, "e", "i", "k", "v", 0.7, kind, date="d", block=block), ["e", "k"])
    got = {r.i: r for r in shared.collect()}
    assert {i: (r.cluster_id, r.error) for i, r in got.items()} == want and got["z1"].error == "a vector has no length"
    labelled = whole.join(spark.createDataFrame([(i, c) for i, (c, error) in want.items() if not error], "i string, c string"), "i")
    for r in vectors.centroid_stats(labelled, "e", "c", "i", "v").collect():
        for c in ("centroid_similarity", "minimum_pairwise_similarity", "mean_pairwise_similarity"):
            a, b = getattr(r, c), getattr(got[r.i], c)
            assert a is b is None or abs(a - b) < 1e-9


def test_layer_one_shuffles_no_vectors_with_rows(spark, tmp_path, monkeypatch):
    """No table that is kept has both a row's text, or id, and its vector."""
    from veridoss.plans import dossier as D
    from veridoss.plans.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    seen = []
    for module in (vectors, D):
        monkeypatch.setattr(module, "kept", lambda df, name, plain=module.kept: seen.append((name, df.columns)) or plain(df, name))
    QUERIES["layer_one"](spark, "/root/testdata/sf0.001")
    assert {"points", "rows", "keys"} <= {n for n, _ in seen}
    assert [n for n, c in seen if {"v", "embedding"} & set(c)] == ["keys"]
