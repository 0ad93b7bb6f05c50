"""The queries of the operators over the documents, pages, benchmark and embeddings tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm import op1_language_id as language
from veridoss.llm import op2_fingerprints as fingerprints
from veridoss.llm import op3_mixing as mixing
from veridoss.llm import op4_records as records
from veridoss.llm import op5_ngram_join as join
from veridoss.llm import op6_secrets as secrets
from veridoss.llm import op7_mpeg_ts as media
from veridoss.llm import op8_licenses as licenses
from veridoss.llm import op9_trie_lm as lm
from veridoss.llm import op10_packing as packing
from veridoss.llm import op11_resampling as resampling
from veridoss.llm import op12_va_codes as codes
from veridoss.llm import op13_pii as pii
from veridoss.llm.shared import bounded_batches

TARGETS = {"web": 0.5, "books": 0.3, "forums": 0.2}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def domain_of(source: Column) -> Column:
    """The domain a source belongs to in these queries: one of TARGETS' names, by checksum."""
    return F.element_at(F.array(*[F.lit(x) for x in TARGETS]), (F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(len(TARGETS))) + 1).cast("int"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs, "text", "lang")
    out = language.identify(spark, docs.select("doc_id", "text", "lang", "source"), model, "text", F.col("lang"), F.col("source"), returned=["doc_id", "lang"])
    return out.select("doc_id", F.col("lang").alias("declared_lang"), "text_lang", "identified_lang", F.round("confidence", 6).alias("confidence"), (F.col("identified_lang") == "und").alias("rejected"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where markup, address suffix and host are all present."""
    model = language.train(documents(spark, sf_dir), "text", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = language.identify(spark, pages, model, language.html_text(F.col("html")), language.declared_in_markup(F.col("html")), language.host_of(F.col("url")), returned=["page_id"])
    return out.select("page_id", "text_lang", "identified_lang", F.round("confidence", 6).alias("confidence"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(spark, documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(spark, documents(spark, sf_dir), domain_of(F.col("source")), share=0.8, epochs=2, targets=TARGETS)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", "epoch", "mix_tokens", "mix_order")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = records.write_records(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return records.read_records(spark, shards)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.jaccard_components(spark, documents(spark, sf_dir), k=3, threshold_pct=90).select("doc_id", "n_shingles", "component_id", "class_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spark, documents(spark, sf_dir))


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(spark, documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = licenses.train(licenses.negative_lines(docs))
    return licenses.license_report(docs, model)


def op9_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(spark, documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(spark, documents(spark, sf_dir))


# Companions: the columns of a query that SQL can express, taken from the operator's own result.


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2: lengths, digests of edited texts, and how many texts share a fingerprint (as many as are equal)."""
    out = op2_fingerprints(spark, sf_dir)
    same = out.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    return out.join(same, "fingerprint").select("doc_id", "n_chars", "edited_sha256", "copies", ((F.col("near_edited") == 1) == (F.col("fingerprint") == F.col("edited_fingerprint"))).alias("alike_if_equal"))


def mixing_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3: the budget of each (domain, language, source), out of which its rows are chosen."""
    t = mixing.estimated_tokens(F.col("text"))
    docs = documents(spark, sf_dir).select(domain_of(F.col("source")).alias("domain"), "lang", "source", t.alias("t"))
    leaves = docs.groupBy("domain", "lang", "source").agg(F.sum("t").alias("tokens"))
    total = 0.8 * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    plan = mixing.plan_leaves(spark, leaves, total, 2, TARGETS, (0.7, 0.7, 0.5))
    return plan.select("domain", "lang", "source", "tokens", F.round("budget", 2).alias("budget"), "whole")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6: how many base spans of each kind."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7: sizes and digests of what is read back."""
    return op7_transport_stream(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8: families, which in this corpus follow from five notices that stand as lines of their own."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "families")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9: all but the model's score."""
    return op9_trie_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


# SQL twins. A-Z alone are lowered; the five white-space bytes and the space separate words.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split_regex({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_JACCARD = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
k AS MATERIALIZED (SELECT min(doc_id) AS doc_id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s), t AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS t FROM k),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)), r AS (SELECT doc_id AS id, doc_id AS low FROM k UNION SELECT e.a, r.low FROM e JOIN r ON r.id = e.b WHERE r.low < e.a),
m AS (SELECT id, min(low) AS low FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(k.doc_id, s.doc_id) AS class_id, coalesce(m.low, s.doc_id) AS component_id FROM s LEFT JOIN k ON k.s = s.s LEFT JOIN m ON m.id = k.doc_id"""
_NEXT = "SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_EDITED = f"SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(nxt, length(t) // 2)) AS edited_sha256, count(*) OVER (PARTITION BY t) AS copies, true AS alike_if_equal FROM ({_NEXT})"
_ANY_CASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
_ASSIGN = _ANY_CASE + """["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = f"SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 6)) AS n_assign, len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents"
_PAYLOAD = "SELECT doc_id, n AS n_bytes, n + k AS payload_bytes, sha256(encode(t) || unhex(repeat('FF', k))) AS payload_sha256 FROM (SELECT doc_id, t, n, CASE WHEN n = 0 THEN 576 ELSE (576 - n % 576) % 576 END AS k FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents))"
# The notices that stand in this corpus.
_LINES = {"apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "mit": "Released under the MIT License.", "proprietary": "All rights reserved."}
_FAMILIES = "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(text, '{t}') THEN '{f}' END" for f, t in _LINES.items()) + ") AS families FROM documents"
# crc32 by shifts: one byte after another, eight bits each
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"
_CRC = _CRC_OF.format("CAST(doc_id AS VARCHAR)")
_BASE = f"""WITH d AS MATERIALIZED (SELECT doc_id, ({_CRC}) % 10 = 0 AS held_out, list_append({_WORDS}, chr(0)) AS w FROM documents), t AS MATERIALIZED (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT t.doc_id, any_value(t.held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)))), 3) AS base_score FROM t LEFT JOIN c ON c.w = t.w CROSS JOIN n GROUP BY 1"""


def _fill_sql(rows: str, parent: str, key: str) -> str:
    """Children (parent, key, cap, w, budget) with their parts: full ones in order of cap over w, the rest in proportion."""
    by = f"PARTITION BY {parent}"
    placed = f"SELECT *, cap / w AS r, (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({by} ORDER BY cap / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM ({rows})"
    return f"SELECT * EXCLUDE (budget, r, lev, cap, w), CASE WHEN r <= lev THEN cap ELSE least(cap, w * arg_min(lev, r) FILTER (r > lev) OVER ({by})) END AS budget FROM ({placed})"


_NAMES = "[" + ", ".join(f"'{x}'" for x in TARGETS) + "]"
_WEIGHT = "CASE domain " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in TARGETS.items()) + " END::DOUBLE"
_LEAVES = f"SELECT {_NAMES}[({_CRC_OF.format('source')}) % {len(TARGETS)} + 1] AS domain, lang, source, CAST(sum(ceil(octet_length(encode(coalesce(text, ''))) / 4.0) + 1) AS BIGINT) AS tokens FROM documents GROUP BY ALL"
_TOP = _fill_sql(f"SELECT domain, 1 AS one, sum(tokens) * 2.0::DOUBLE AS cap, {_WEIGHT} AS w, 0.8::DOUBLE * (SELECT sum(tokens) FROM leaf) AS budget FROM leaf GROUP BY domain", "one", "domain")
_MIDDLE = _fill_sql("SELECT domain, lang, sum(tokens) * 2.0::DOUBLE AS cap, sum(tokens) ** 0.7::DOUBLE AS w, any_value(top.budget) AS budget FROM leaf JOIN top USING (domain) GROUP BY domain, lang", "domain", "lang")
_LAST = _fill_sql("SELECT domain, lang, source, tokens, tokens * 2.0::DOUBLE AS cap, tokens ** 0.5::DOUBLE AS w, middle.budget FROM leaf JOIN middle USING (domain, lang)", "domain, lang", "source")
_BUDGETS = f"WITH leaf AS MATERIALIZED ({_LEAVES}), top AS MATERIALIZED ({_TOP}), middle AS MATERIALIZED ({_MIDDLE}) SELECT domain, lang, source, tokens, round(budget, 2) AS budget, CAST(floor(budget / tokens + 1e-9) AS INTEGER) AS whole FROM ({_LAST})"


# Of op11: words of bytes beyond ASCII, letters and digits; CRC-32 over UTF-8 bytes by a table of 256 entries.
_GAIN_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BYTES = "list_transform(range(CAST(length(hex(encode(f))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
_RESAMPLED = f"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS tab),
d AS MATERIALIZED (SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, {_GAIN_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, 0, {_GAIN_WORDS} FROM benchmark),
f AS MATERIALIZED (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 10000 AS b FROM (SELECT DISTINCT f FROM f) CROSS JOIN tab),
n AS MATERIALIZED (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (f) GROUP BY b),
g AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS BIGINT) AS g FROM n),
w AS MATERIALIZED (SELECT r, count(*) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY r),
v AS (SELECT d.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('7:' || d.id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r) WHERE side = 0),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM v), y AS (SELECT *, CASE WHEN n_features >= 39 THEN row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) END AS rk FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN rk <= 25 * (SELECT count(*) FROM x WHERE n_features >= 39) // 100 THEN rk END AS rank FROM y"""
_CODES = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, vec_id, (i - 1) // (len(embedding) // 8) AS part, (i - 1) % (len(embedding) // 8) AS pos, CAST(floor(4096 * embedding[i]::DOUBLE) AS BIGINT) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
c0 AS MATERIALIZED (SELECT part, n - 1 AS entry, pos, x AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) AS n FROM v) USING (r) WHERE n <= 16),
""" + "".join(f"""a{k} AS MATERIALIZED (SELECT r, part, min(d * 16 + entry) % 16 AS entry, min(d) AS d FROM (SELECT r, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{k} LEFT JOIN (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r, part) GROUP BY ALL) USING (part, entry, pos)),
""" for k in range(6)) + """a6 AS MATERIALIZED (SELECT r, part, min(d * 16 + entry) % 16 AS entry, min(d) AS d FROM (SELECT r, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c6 USING (part, pos) GROUP BY ALL) GROUP BY ALL),
e AS (SELECT r, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c6) AS codebooks_sha256 FROM v JOIN e USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_fingerprints, op3_source_mixing, op4_token_records, op5_ngram_join, op6_secret_scan, op7_transport_stream, op8_license_scan, op9_trie_scores, op10_packing, op11_importance_resampling, op12_va_codes, op13_pii_spans, langid_pages, edited_texts, mixing_budgets, secret_counts, media_payloads, license_families, lm_base_scores)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL over all columns where SQL can, and over those of the companions; tests hold the rest against plain versions."""
    return {"op5_ngram_join": _JACCARD, "edited_texts": _EDITED, "mixing_budgets": _BUDGETS, "secret_counts": _SECRETS, "media_payloads": _PAYLOAD, "license_families": _FAMILIES, "lm_base_scores": _BASE, "op11_importance_resampling": _RESAMPLED, "op12_va_codes": _CODES}
