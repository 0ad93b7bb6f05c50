"""The stages of the corpus pipeline on odd tables: nulls, empty and repeated texts, no rows, clashing names."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epoch string, whole string, confidence string, component_id string"
EN = "the river ran past the old stone house and then on to the sea with a quiet sound that nobody in the village ever heard twice "
FR = "la rivière passait devant la vieille maison de pierre puis allait vers la mer avec un bruit que personne au village ne connaissait "


def table(spark):
    rows = []
    for i in range(24):
        body, lang = (EN, "en") if i % 2 else (FR, "fr")
        text = f"{body} {i} " + " ".join(f"{lang}{i}x{k}" for k in range(30))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(100, rows[1][1], "en", "s1", rows[1][4]), (3, rows[3][1], "en", "s0", rows[3][4])]  # a copy, and a repeated row
    rows += [(101, None, None, None, None), (102, "", "en", "s0", 0), (None, EN * 2 + "lonely", "en", None, 9), (103, "12 34 !!", "en", "s1", 8), (104, EN + " password = hunter2hunter2 " + "unusual " * 3, "en", "s2", 9)]
    return spark.createDataFrame([(*r, "kept", "kept", "kept", "kept") for r in rows], SCHEMA).repartition(3)


def test_stages_handle_odd_rows(spark):
    docs = table(spark)
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language_id"](spark, docs, "").cache()
    assert known.columns == docs.columns and known.where("confidence = 'kept' AND whole = 'kept'").count() == known.count()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in known.collect())
    assert [x[1] for x in ids if not x[0]] == sorted([*range(24), 3, 100, 104]) and sum(x[0] for x in ids) == 1
    single = stage["ngram_jaccard_join"](spark, known, "").cache()
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == [*range(24), 104] and single.where("doc_id IS NULL").count() == 1
    clean = stage["secret_scan"](spark, single, "").cache()
    assert clean.count() == single.count() and "hunter2" not in clean.where("doc_id = 104").first().text
    assert clean.where("doc_id < 24").exceptAll(single.where("doc_id < 24")).count() == 0
    mixed = stage["source_mixing"](spark, clean, "").cache()
    assert mixed.columns == docs.columns and 0 < mixed.count() < clean.count() and mixed.where("epoch = 'kept'").count() == mixed.count()
    packed = stage["packing"](spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()} and all(r.length > 0 for r in packed)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, name):
    docs = table(spark).limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
