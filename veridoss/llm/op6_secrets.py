"""Secret scans: fixed kinds, and a battery of randomness tests under false-discovery control.

Kinds assign, access and hex come from patterns. Any other unbroken run of at least MIN_RUN
characters of a known encoding is a candidate: its narrowest encoding (digits, hex, base32,
base64, ...) is inferred, and three tests measure how far it is from even, independent draws:

- chi-squared uniformity over the encoding's alphabet,
- runs above and below the alphabet's middle,
- serial correlation of neighbours.

The null hypothesis of a candidate is "written text": under it the chi-squared statistic has a
noncentral distribution whose noncentrality grows with length, so its lower tail is a p-value
that is small only if the run is much evener than text of that length would be. The other two
tests must not contradict randomness (Fisher's combination above RANDOM_LEVEL). Candidates are
ranked by p-value within strata of encoding and length, over all rows, and Benjamini-Hochberg
sets each stratum's threshold at rate FDR. The threshold table has a fixed size: strata x BINS.

Defined results. Null or empty text: no span; ``redact`` leaves it as it is. Spans count code points, end
exclusive. Base spans always stay; a candidate that overlaps one is dropped, as is a shorter overlapping
candidate. Very long texts are read whole, in time that follows their length. Spans that start together go in
the order of the kinds; candidates with the same p-value are all accepted or all not. Repeated rows each get
their result. Empty table: empty result. Extra columns are ignored by ``find_secrets``, whatever their names,
and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.shared import keep, named, trimmed

FDR = 0.01
RANDOM_LEVEL = 0.001
MIN_RUN = 20
BINS = 120  # of minus log10 p, five to a unit
LENGTHS = (20, 28, 36, 48, 64, 96, 160)  # lower ends of length strata
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)

# Alphabets, narrowest first, each in its usual order.
ALPHABETS = {
    "digits": "0123456789",
    "hex_lower": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36_lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
_SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}


def infer_encoding(run: str) -> str | None:
    have = set(run.rstrip("="))
    return next((name for name, letters in _SETS.items() if have <= letters), None)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    return 1 - normal_cdf(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def noncentral_cdf(x: float, k: float, lam: float) -> float:
    """Lower tail of noncentral chi-squared by the power-transformed normal approximation."""
    if x <= 0:
        return 0.0
    mean, var2 = k + lam, k + 2 * lam
    h = 1 - 2 / 3 * mean * (k + 3 * lam) / var2**2
    p = var2 / mean**2
    m = (h - 1) * (1 - 3 * h)
    z = ((x / mean) ** h - (1 + h * p * (h - 1 - (2 - h) * m * p / 2))) / (h * math.sqrt(2 * p) * (1 + m * p / 2))
    return normal_cdf(z)


def battery(run: str, encoding: str) -> tuple[float, float, float, float]:
    """(p under text, and under randomness: chi-squared, runs, serial correlation)."""
    place = _PLACES[encoding]
    x = [place[c] for c in run.rstrip("=")]
    n, size = len(x), len(ALPHABETS[encoding])
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(c * c for c in counts.values()) * size / n - n
    # written text of n letters: about as uneven as English, whose sum of squared shares is 0.066;
    # digits in text, too, mostly come as years, sequences or repeats
    text_squares = max(0.066, 1.9 / size)
    effect = (text_squares * size - 1) * n
    p_text = noncentral_cdf(max(chi, 1e-9), size - 1, effect)
    p_chi = chi2_sf(chi, size - 1)
    high = [v >= size / 2 for v in x]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * ups * downs / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * normal_cdf(-abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    mid = sum(x) / n
    spread = sum((v - mid) ** 2 for v in x)
    r = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / spread if spread else 1.0
    p_serial = 2 * normal_cdf(-abs(r + 1 / n) * math.sqrt(n))
    return p_text, p_chi, p_runs, p_serial


def fisher(ps: list[float]) -> float:
    return chi2_sf(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of runs outside the base spans that pass for random."""
    out = []
    i = far = 0  # both lists go from left to right: far is the furthest end of base spans begun before a run's end
    for m in _RUN.finditer(text):
        run = m.group()
        while i < len(base) and base[i][0] < m.end():
            far = max(far, base[i][1])
            i += 1
        if far > m.start():
            continue
        encoding = infer_encoding(run)
        if encoding is None or len(run.rstrip("=")) < MIN_RUN:
            continue
        p_text, p_chi, p_runs, p_serial = battery(run, encoding)
        if fisher([p_chi, p_runs, p_serial]) < RANDOM_LEVEL:
            p_text = 1.0
        stratum = list(ALPHABETS).index(encoding) * len(LENGTHS) + max(0, bisect_right(LENGTHS, len(run)) - 1)
        out.append((m.start(), m.end(), stratum, min(BINS, int(-5 * math.log10(max(p_text, 1e-30))))))
    return out


SCAN = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,stop:int,kind:string>>, runs array<struct<start:int,stop:int,stratum:int,bin:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
_CAND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())]))


def _scan_text(text: str) -> tuple:
    base = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
    counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return *counts, hashlib.sha256(joined.encode()).hexdigest(), [{"start": a, "stop": b, "kind": k} for a, b, k in base], [dict(zip(("start", "stop", "stratum", "bin"), c, strict=True)) for c in candidates(text, base)]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and tested runs of each whole text; narrow, and small beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPAN, _CAND]
        for batch in batches:
            found = [_scan_text(t or "") for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"])

    return docs.select(named(id_col).cast("long").alias("id"), named(text_col)).mapInArrow(trimmed(run), SCAN)


def thresholds(scanned: DataFrame, rate: float = FDR) -> dict[int, int]:
    """For each stratum the lowest bin whose candidates are discoveries at the rate (step-up).

    A bin's candidates all count with its largest p-value, so the rate is not exceeded.
    """
    rows = scanned.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.bin").count().collect()  # strata x BINS at most
    by: dict[int, np.ndarray] = {}
    for r in rows:
        by.setdefault(r["stratum"], np.zeros(BINS + 1, np.int64))[r["bin"]] += r["count"]
    out = {}
    for stratum, counts in by.items():
        total, above = counts.sum(), 0
        for b in range(BINS, 0, -1):
            above += counts[b]
            if counts[b] and 10 ** (-b / 5) <= rate * above / total:
                out[stratum] = b
    return out


def accepted(scanned: DataFrame, limits: dict[int, int]) -> DataFrame:
    """scanned with found: accepted runs as spans of kind random, and spans: all of them."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<int,int>")
    fine = F.filter("runs", lambda r: F.coalesce(r["bin"] >= table[r["stratum"]], F.lit(False)))
    found = F.transform(fine, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), F.lit("random").alias("kind")))
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    return scanned.withColumn("found", found).withColumn("spans", F.array_sort(F.transform(F.concat("base", "found"), order)))


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """One row per row of docs: counts and digest of base spans, and all spans as text."""
    scanned = keep(spark, scan(docs, id_col, text_col), "scanned")
    out = accepted(scanned, thresholds(scanned, rate))
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size("found").cast("long").alias("n_random"))


def redact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "<secret>", rate: float = FDR) -> DataFrame:
    """docs with every span replaced by mark; rows, order of columns and types stay.

    Candidates are found anew in the text rather than joined by id, so no text is shuffled
    and repeated ids do no harm. n_chars follows the new text.
    """
    limits = thresholds(scan(docs, id_col, text_col), rate)
    names, at = docs.columns, docs.columns.index(text_col)
    slots = [f"c{i}" for i in range(len(names))]  # whatever signs are in the names
    plain = docs.toDF(*slots)
    to = names.index(chars_col) if chars_col in names else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        more = [(a, b, "random") for a, b, s, p in candidates(text, base) if p >= limits.get(s, BINS + 1)]
        if not base and not more:
            return text
        out, done = [], 0
        for a, b, _ in sorted(base + more):
            if b <= done:
                continue
            if a >= done:
                out += [text[done:a], mark]
            done = b
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [clean(t) for t in columns[at].to_pylist()]
            if to is not None:
                columns[to] = pa.array([n if t is None or t == old else len(t) for t, old, n in zip(texts, columns[at].to_pylist(), columns[to].to_pylist(), strict=True)], columns[to].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=slots)

    return plain.mapInArrow(trimmed(run), plain.schema).toDF(*names)
