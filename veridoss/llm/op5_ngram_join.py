"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Plan: (1) one pass counts shingles into an array of hashed counters, whose size follows the number
of rows - any global order is right for prefix filtering, this one puts rare shingles first; (2) one
pass makes each text's set, its signature, its prefix of rarest shingles and its counts of shingles
in ranges of the global order; (3) texts with equal sets fold into a class; (4) classes that share a
prefix shingle are linked, first to one centre per shingle and length band (a linear number of
pairs), then - only across groups that are not yet connected - pairwise with the positional filter;
where a shingle is in very many open prefixes, its classes must share a second (and a third) shingle
of a prefix longer by one (two) before they are paired; (5) the suffix filter bounds the Hamming
distance of what follows the common shingle in the global order, range by range; (6) each surviving
pair is verified once, on whole sets rebuilt from the texts; (7) components by large-star/small-star.

A pair is never verified twice and never skipped unless its two ends are already connected.

Defined results. Null or empty text, or only white space: an empty set, linked with nothing,
component_id is its own id. A null id: row kept, component null. Rows that repeat an id count
as one document, which links with whatever one of its texts links with. Equal sets: one class, whose id
is the smallest. Very long texts are read whole, in slices. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.components import connected_components
from veridoss.llm.shared import keep, maybe_broadcast, sum_counters, trimmed, utf8
from veridoss.llm.tokens import release
from veridoss.llm.words import U, hashed, mix, shingles

COUNTER_BITS = (20, 24)  # least and most; between, four counters a row
BLOCKS = 64
STAR_ROUNDS = 1
BINS = 32  # ranges of the global order in the suffix filter
DEPTH = 3  # shingles that classes share at most before they are paired
HOT = 2_000  # open postings of a shingle from which a further one is asked for


def _rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    release()
    for batch in batches:
        for lo, hi, words, at in hashed(*utf8(batch.column(1))):
            for i in range(lo, hi):
                yield batch, i, shingles(words[at[i - lo] : at[i - lo + 1]], k)


def shingle_counters(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """How many texts hold a shingle of each of 2**bits hash values, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, pending, held = np.zeros(1 << bits, np.uint32), [], 0
        mask = U((1 << bits) - 1)
        for _, _, s in _rows(batches, k):
            pending.append(s & mask)
            held += len(s)
            if held > 1 << 20:
                total += np.bincount(np.concatenate(pending).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                pending, held = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        blocks = total.reshape(BLOCKS, -1)
        some = [i for i in range(BLOCKS) if blocks[i].any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "salt": pa.array([TaskContext.get().partitionId() % 32] * len(some), pa.int32()), "counts": pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())})

    return sum_counters(docs.mapInArrow(trimmed(count), "block int, salt int, counts binary"), "block", "counts", "uint32", 1 << bits)


def _ranks(freq: np.ndarray) -> np.ndarray:
    """Each counter's place in the global order: rare ones first, equal ones by number."""
    out = np.empty(len(freq), np.uint32)
    out[np.argsort(freq, kind="stable")] = np.arange(len(freq), dtype=np.uint32)
    return out


def _sets(docs: DataFrame, k: int, pct: int, counters: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(_ranks(counters))  # at most 2**24 numbers, whatever the input
    bits = len(counters).bit_length() - 1
    schema = "id long, n int, sig0 long, sig1 long, prefix array<long>, bins binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, mask = held.value, U(len(held.value) - 1)
        out: dict[str, list] = {c: [] for c in ("id", "n", "sig0", "sig1", "prefix", "bins")}
        current = None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["sig0"], pa.int64()), pa.array(out["sig1"], pa.int64()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["bins"], pa.binary())], names=list(out))
            for v in out.values():
                v.clear()
            return batch

        ids: list = []
        for batch, i, s in _rows(batches, k):
            if batch is not current:
                current, ids = batch, batch.column(0).to_pylist()
            n = len(s)
            size = n - -(-pct * n // 100) + DEPTH if n else 0
            rank = ranks[s & mask]
            order = np.lexsort((s, rank))[:size]
            out["id"].append(ids[i])
            out["n"].append(n)
            out["sig0"].append(int(np.add.reduce(mix(s)).astype(np.int64)) if n else 0)
            out["sig1"].append(int(np.add.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5))).astype(np.int64)) if n else 0)
            out["prefix"].append(s[order].view(np.int64))
            out["bins"].append(np.bincount(rank >> np.uint32(bits - 5), minlength=BINS).astype("<u4").tobytes())
            if len(out["id"]) >= 2000:
                yield flush()
        if out["id"]:
            yield flush()

    return docs.mapInArrow(trimmed(make), schema)


def _may_link(x: str, y: str, pct: int, depth: int = 1) -> Column:
    """Length and positional filters for two postings of one chain of depth shingles.

    A link needs an overlap of at least ceil(pct * (nx + ny) / (100 + pct)). Whatever stands in a
    set's order before the first common shingle is missing from the other set, so that shingle's
    position is at most n less the overlap needed, in both sets; the d-th common one may stand d - 1
    later.
    """
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    need = F.ceil(F.lit(pct) * (nx + ny) / F.lit(100.0 + pct))
    last = F.lit(depth - 1)
    return (100 * F.least(nx, ny) >= pct * F.greatest(nx, ny)) & (F.col(f"{x}pos") <= nx - need + last) & (F.col(f"{y}pos") <= ny - need + last)


def _suffix_filter(pairs: DataFrame, reps: DataFrame, pct: int) -> DataFrame:
    """Drop pairs whose suffixes differ by more than the threshold allows; pairs: (a, b, pa, pb).

    pa and pb are the positions of one common shingle in the two sets. Ranges of the global order
    split what follows it in both sets alike, so the Hamming distance is at least the difference of
    the positions and the sum over ranges of the differences of counts; for a link it is at most
    nx + ny - 2 * least overlap. Counts after a position are had from counts of the whole set, as the
    shingles up to it fill the lowest ranges.
    """
    light = reps.select("id", "n", "bins")
    both = pairs.join(light.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba")), "a").join(light.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb")), "b")

    def after(blobs: list[bytes], at: np.ndarray) -> np.ndarray:
        counts = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, BINS).astype(np.int64)
        return np.clip(np.cumsum(counts, 1) - (at + 1)[:, None], 0, counts)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            na, nb, at_a, at_b = (x.column(c).to_numpy().astype(np.int64) for c in ("na", "nb", "pa", "pb"))
            left, right = after(x.column("ba").to_pylist(), at_a), after(x.column("bb").to_pylist(), at_b)
            need = -(-pct * (na + nb) // (100 + pct))
            good = np.abs(at_a - at_b) + np.abs(left - right).sum(1) <= na + nb - 2 * need
            yield x.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "pa", "pb", "na", "nb", "ba", "bb").mapInArrow(trimmed(test), "a long, b long")


def _block_pairs(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with the number of blocks of their key, as left and right sides of every pair (one, two) of blocks."""
    own = level.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "id"), "blocks").cast("int"))
    left = own.withColumn("one", F.col("own")).withColumn("two", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    right = own.withColumn("two", F.col("own")).withColumn("one", F.explode(F.sequence(F.lit(0), F.col("own"))))
    return left.drop("own", "blocks"), right.drop("own", "blocks")


def _across(spark: SparkSession, open_: DataFrame, prefixes: DataFrame, pct: int, hot: int = HOT) -> DataFrame:
    """(a, b, pa, pb) of classes in different components that share a prefix shingle and may link.

    A shingle of more than ``hot`` open postings is extended: links have a second common shingle, later in
    the order, within a prefix longer by one, so only classes that share both are paired; likewise a
    third. Postings that are still more than ``hot`` for a key are dealt into blocks, and pairs of
    blocks are joined, so that no task takes a key's pairs alone. pa and pb are the positions of the last shared one.
    """
    columns = ["key", "id", "n", "pos", "component"]
    level, out = open_.select(F.xxhash64("token").alias("key"), "id", "n", "pos", "component"), None
    for depth in range(1, DEPTH + 1):
        level = keep(spark, level, "open")
        counts = keep(spark, level.groupBy("key").count().where(F.col("count") > hot), "hot")
        many = counts.select("key")
        some = level.join(maybe_broadcast(many, 100_000), "key", "left_anti").withColumns({"one": F.lit(0), "two": F.lit(0)})
        x, y = some, some
        if depth == DEPTH:
            left, right = _block_pairs(level.join(maybe_broadcast(counts, 100_000), "key").withColumn("blocks", F.ceil(F.col("count") / hot).cast("int")).drop("count"))
            x, y = some.unionByName(left), some.unionByName(right)
        x, y = x.alias("x"), y.alias("y")
        # within a block each pair is met twice, and across two blocks once
        meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.one") == F.col("y.one")) & (F.col("x.two") == F.col("y.two"))
        once = (F.col("x.one") < F.col("x.two")) | (F.col("x.id") < F.col("y.id"))
        found = x.join(y, meet & once & (F.col("x.id") != F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _may_link("x.", "y.", pct, depth))
        first = F.col("x.id") < F.col("y.id")
        found = found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(first, F.col("x.pos")).otherwise(F.col("y.pos")).alias("pa"), F.when(first, F.col("y.pos")).otherwise(F.col("x.pos")).alias("pb"))
        out = found if out is None else out.unionByName(found)
        if depth == DEPTH or not many.limit(1).count():
            break
        size = F.col("n") - F.ceil(F.lit(pct) * F.col("n") / F.lit(100.0)).cast("int") + 1 + depth  # of a prefix longer by depth
        wider = level.join(maybe_broadcast(many, 100_000), "key", "left_semi").join(prefixes, "id")
        level = wider.select("key", "id", "n", "component", F.col("pos").alias("before"), F.posexplode(F.slice("prefix", 1, size)).alias("pos", "token")).where("pos > before").withColumn("key", F.xxhash64("key", "token")).select(*columns)
        both = level.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        level = level.join(both, "key", "left_semi")
    return out.groupBy("a", "b").agg(F.min(F.struct("pa", "pb")).alias("p")).select("a", "b", "p.pa", "p.pb")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, pct: int, broadcast_ids: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= pct * union, on sets of whole texts."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.join(maybe_broadcast(wanted, broadcast_ids), "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def of(column: pa.Array) -> list[np.ndarray]:
            out = []
            for text in column.to_pylist():
                got = known.get(text)
                if got is None:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    words = [w for _, _, w, _ in hashed(raw, np.array([0, len(raw)]))]
                    got = shingles(np.concatenate(words), k)
                    if len(known) > 256:
                        known.clear()
                    known[text] = got
                out.append(got)
            return out

        for x in batches:
            good = []
            for p, q in zip(of(x.column("ta")), of(x.column("tb")), strict=True):
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(len(p) > 0 and len(q) > 0 and 100 * common >= pct * (len(p) + len(q) - common))
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(trimmed(test), "a long, b long").distinct()


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, threshold_pct: int = 80, id_col: str = "doc_id", text_col: str = "text", counter_bits: int | None = None, broadcast_ids: int = 500_000, hot: int = HOT) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (smallest id with an equal set), component_id.

    Two texts link when 100 * |A n B| >= threshold_pct * |A u B| for their sets of k-word
    shingles; component_id is the smallest id reachable over links. See the module's notes
    for nulls, ties and empty input. hot: see ``_across``. broadcast_ids bounds a broadcast of candidate ids
    (8 bytes each); above it the same join is shuffled.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pct = threshold_pct
    least, most = COUNTER_BITS
    counters = shingle_counters(docs, k, counter_bits or min(most, max(least, docs.count().bit_length() + 2)))
    sets = keep(spark, _sets(docs, k, pct, counters), "sets")
    usable = sets.where("n > 0 AND id IS NOT NULL")
    classes = keep(spark, usable.groupBy("sig0", "sig1", "n").agg(F.min("id").alias("rep")), "classes")
    reps = keep(spark, usable.join(classes.select("sig0", "sig1", "n", F.col("rep").alias("id")), ["sig0", "sig1", "n", "id"], "left_semi").select("id", "n", "prefix", "bins"), "reps")

    # the first DEPTH - 1 shingles fewer: those serve hot shingles only
    short = F.slice("prefix", 1, F.col("n") - F.ceil(F.lit(pct) * F.col("n") / F.lit(100.0)).cast("int") + 1)
    flat = reps.select("id", "n", F.posexplode(short).alias("pos", "token"))
    often = flat.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / pct))).cast("int")
    postings = keep(spark, flat.join(often, "token").withColumn("band", band), "postings")

    # stars: each posting meets one centre per shingle and length band, another one each round
    links, tried, parts, open_ = None, None, None, postings.withColumn("component", F.col("id"))
    for r in range(STAR_ROUNDS):
        by = F.col("id") if r == 0 else F.xxhash64(F.lit(r), "id")
        centres = open_.groupBy("token", "band").agg(F.min_by(F.struct("id", "n", "pos", "component"), by).alias("c"))
        stars = (
            open_.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
            .join(centres, ["token", "band"])
            .where((F.col("component") != F.col("c.component")) & _may_link("", "c.", pct))
            .select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"), F.when(F.col("id") < F.col("c.id"), F.struct(F.col("pos").alias("pa"), F.col("c.pos").alias("pb"))).otherwise(F.struct(F.col("c.pos").alias("pa"), F.col("pos").alias("pb"))).alias("p"))
            .groupBy("a", "b")
            .agg(F.min("p").alias("p"))
            .select("a", "b", "p.pa", "p.pb")
        )
        stars = keep(spark, stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "stars")
        found = keep(spark, _verify(keep(spark, _suffix_filter(stars, reps, pct), "survivors"), docs, k, pct, broadcast_ids), "links")
        tried = stars.select("a", "b") if tried is None else tried.unionByName(stars.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        parts = connected_components(spark, links)
        labelled = postings.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")).select("token", "id", "n", "pos", "band", "component")
        mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
        open_ = keep(spark, labelled.join(mixed, "token", "left_semi"), "open")
        if not open_.limit(1).count():
            break
    cross = _across(spark, open_, reps.select("id", "prefix"), pct, hot).join(tried, ["a", "b"], "left_anti")
    left = keep(spark, _suffix_filter(keep(spark, cross, "cross"), reps, pct), "survivors")
    more = _verify(left, docs, k, pct, broadcast_ids)
    final = connected_components(spark, links.unionByName(more))

    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("sig0", "sig1", "n", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("id", "n", "sig0", "sig1").join(named, ["sig0", "sig1", "n"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


def keep_one_per_component(spark: SparkSession, docs: DataFrame, k: int = 5, threshold_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its near-duplicates: of each component the row with the smallest id stays.

    A repeated id counts as a copy too: one of its rows stays, the one with the smallest
    hash of its columns. Rows with a null id cannot be linked and all stay.
    """
    found = keep(spark, jaccard_components(spark, docs, k, threshold_pct, id_col, text_col), "found")
    repeats = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    gone = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    alive = docs.join(gone, id_col, "left_anti")
    if not repeats.limit(1).count():
        return alive
    many = alive.join(repeats, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("kept")).select("kept.*")
    return alive.join(repeats, id_col, "left_anti").unionByName(many)
