"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraphs (lines), each read as
phrases (cut at white space after a sign). A paragraph maps to a
wide vector and the fingerprint is the lane-wise sum of these vectors modulo powers of two:

- DENSE lanes add 62-bit hashes of whole paragraphs modulo 2**62: they decide equality;
- SPARSE * WORDS words hold two lanes each; a lane counts, modulo 2**30, the phrases whose hash
  has a given bit set. Twice the count less the number of phrases is a sum of signs, so the
  cosine of two such vectors estimates the share of phrases in common. A phrase takes two bytes
  at least, with the sign that ends it, and a text fewer than 2**31, so no lane of a single text wraps;
- the last element counts phrases modulo 2**62.

Being sums, fingerprints do not depend on the order of paragraphs, and one paragraph can be
inserted or deleted by ``add`` and ``subtract`` without reading the rest of the text.

Lanes are summed in two steps: CHUNK hashes at a time in eight narrow lanes a word, then those
sums in wide lanes, so a phrase costs eight additions a hash rather than one for every word.

Defined results. Null text counts as empty; an empty text has one empty paragraph and no
phrase. Rows that repeat an id follow one another by text; null ids come last. Very long texts
are read whole. Sums wrap, they never overflow. An empty table gives an empty result. Extra columns
are ignored by ``fingerprint_edits``; ``fingerprint`` keeps them, and its result replaces an input
column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoss.llm.shared import fresh, id_buckets, named

DENSE = 4
SPARSE = 2
WORDS = 32  # of two lanes each, for one hash
CHUNK = 127  # the most that a narrow lane of eight bits takes without touching the sign
_NARROW = 0x0101010101010101
_PAIR = 0xFF | 0xFF << 32
_LANE = (1 << 30) - 1
_LANES = _LANE | _LANE << 32
_GUARD = 1 << 30 | 1 << 62
_WIDE = (1 << 62) - 1
PHRASES = r"\n+|(?<=[^\p{L}\p{N}\s])\s+"


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _hashes(parts: str, seed: int) -> Column:
    return F.transform(F.col(parts), lambda p: F.xxhash64(F.lit(seed), p))


def _chunks(name: str) -> Column:
    """Slices of CHUNK hashes. They must be a column: an expression in the lambda would be made anew for each slice."""
    hashes = F.col(name)
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(hashes, i, CHUNK))


def with_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the arrays that ``lanes`` folds, in steps, so that each is made once."""
    lines = F.split(F.col(text), "\n")
    parts = F.filter(F.split(F.col(text), PHRASES), lambda p: p != "")
    df = df.withColumns({f"{out}_l": lines, f"{out}_p": parts})
    made = {f"{out}_d{j}": _hashes(f"{out}_l", j) for j in range(DENSE)}
    made |= {f"{out}_h{j}": _hashes(f"{out}_p", 100 + j) for j in range(SPARSE)}
    df = df.withColumns(made | {f"{out}_n": F.size(f"{out}_p").cast("long")}).drop(f"{out}_l", f"{out}_p")
    df = df.withColumns({f"{out}_h{j}": _chunks(f"{out}_h{j}") for j in range(SPARSE)})
    narrow = lambda k: lambda chunk: F.aggregate(chunk, _long(0), lambda a, x: a + F.shiftright(x, k).bitwiseAND(_long(_NARROW)))
    return df.withColumns({f"{out}_s{j}_{k}": F.transform(F.col(f"{out}_h{j}"), narrow(k)) for j in range(SPARSE) for k in range(8)})


def lanes(out: str) -> Column:
    """The fingerprint as array<long>, from the arrays of ``with_hashes``."""
    dense = [F.aggregate(F.col(f"{out}_d{j}"), _long(0), lambda a, x: (a + x.bitwiseAND(_long(_WIDE))).bitwiseAND(_long(_WIDE))) for j in range(DENSE)]
    wide = lambda sums, shift: F.aggregate(F.col(sums), _long(0), lambda a, x: a + F.shiftright(x, shift).bitwiseAND(_long(_PAIR)))
    sparse = [wide(f"{out}_s{j}_{k}", 8 * i) for j in range(SPARSE) for k in range(8) for i in range(4)]
    return F.array(*dense, *sparse, F.col(f"{out}_n"))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of both multisets together."""
    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p, i: F.when((i >= DENSE) & (i < DENSE + SPARSE * WORDS), (p.x + p.y).bitwiseAND(_long(_LANES))).otherwise((p.x + p.y).bitwiseAND(_long(_WIDE))))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of what is left of a once the paragraphs of b are deleted."""
    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p, i: F.when((i >= DENSE) & (i < DENSE + SPARSE * WORDS), (p.x.bitwiseOR(_long(_GUARD)) - p.y).bitwiseAND(_long(_LANES))).otherwise((p.x - p.y).bitwiseAND(_long(_WIDE))))


def to_text(fp: Column) -> Column:
    """Hexadecimal digits, 16 for each element."""
    return F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")))


def _signed(word: Column, count: Column) -> list[Column]:
    return [(2 * F.shiftright(word, 32 * j).bitwiseAND(_long(_LANE)) - count).cast("double") for j in range(2)]


def _dot(a: Column, b: Column) -> Column:
    words = F.zip_with(F.slice(a, DENSE + 1, SPARSE * WORDS), F.slice(b, DENSE + 1, SPARSE * WORDS), lambda x, y: sum((p * q for p, q in zip(_signed(x, F.element_at(a, -1)), _signed(y, F.element_at(b, -1)), strict=True)), F.lit(0.0)))
    return F.aggregate(words, F.lit(0.0), lambda s, x: s + x)


def likeness(a: str, b: str) -> Column:
    """Between 0 and 1, of two fingerprint columns: 1 for equal ones, else the cosine of signs."""
    x, y = F.col(a), F.col(b)
    top, norm = _dot(x, y), F.sqrt(F.col(f"{a}_norm") * F.col(f"{b}_norm"))
    return F.when(x == y, 1.0).when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), top / norm)))


def norm(fp: Column) -> Column:
    return _dot(fp, fp)


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with a column of fingerprints (array<long>); one narrow pass, no shuffle."""
    names = [c for c in df.columns if c.lower() != out.lower()]
    tmp = fresh([*df.columns, out], "fp")[0]
    while any(c.lower().startswith(tmp.lower()) for c in df.columns):
        tmp = f"_{tmp}"
    got = with_hashes(df.withColumn(f"{tmp}_t", F.coalesce(named(text_col), F.lit(""))), f"{tmp}_t", tmp)
    return got.select(*[named(c) for c in names], lanes(tmp).alias(out))


def next_in_order(spark: SparkSession, df: DataFrame, id_col: str, tie: str, carry: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with the carried columns of the next row by descending id, the last with the first's.

    One shuffle: rows go to buckets of consecutive ids, and the first row of each bucket also
    to the bucket before it. Only bucket bounds (a fixed number) are read by the driver.
    """
    key = F.coalesce(F.col(id_col).cast("long"), _long(-(1 << 63)))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket, size = id_buckets(df, key, n)
    placed = df.withColumn("__b", bucket)
    tops = {r["__b"]: r["m"] for r in df.select(key.alias("__k"), bucket.alias("__b")).groupBy("__b").agg(F.max("__k").alias("m")).collect()}
    used = sorted(tops)
    before = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    top, to = (F.array(*[_long(d.get(b, 0)) for b in range(size)]) for d in (tops, before))
    first = key == F.get(top, F.col("__b"))
    wraps = F.col("__b") == F.lit(used[-1] if used else 0)
    once = F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("g")))
    again = F.array(F.struct(F.get(to, F.col("__b")).cast("int").alias("b"), F.when(wraps, 2).otherwise(1).alias("g")))
    spread = placed.withColumn("__at", F.explode(F.when(first, F.concat(once, again)).otherwise(once))).withColumns({"__to": F.col("__at.b"), "__g": F.col("__at.g")}).drop("__b", "__at")
    # one bucket a task: placed by number, as hashed numbers would share tasks and leave others idle
    dealt = spread.repartitionById(size, F.col("__to"))
    w = Window.partitionBy("__to").orderBy("__g", F.col(id_col).desc_nulls_last(), F.col(tie))
    return dealt.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in carry}).where("__g = 0").drop("__to", "__g")


def fingerprint_edits(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses.

    Edited: the last half of the code points (rounded down) gives way to as many first code
    points of the next document by descending id. One row per row of docs.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = fingerprint(base, "text", "fp")
    paired = next_in_order(spark, made, "id", "text", ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("n", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).drop("text", "next_text")
    both = fingerprint(edited, "edited", "efp").drop("edited")
    both = both.withColumns({f"{c}_norm": norm(F.col(c)) for c in ("fp", "efp", "next_fp")})
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", to_text(F.col("fp")).alias("fingerprint"), to_text(F.col("efp")).alias("edited_fingerprint"), likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
