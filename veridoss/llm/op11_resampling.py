"""Target-distribution importance resampling over partition-local word tries.

Features are runs of one or two words, hashed to buckets by CRC-32. Texts become like the target
set by drawing without replacement: a text's weight is the mean log-ratio of target to source share
over its features' buckets, and Gumbel noise from its id turns the highest sums into a weighted draw.

Each task keeps a trie of the words it reads: children of the root are words, their children the
words that follow. A node holds how often its feature came and the CRC state of the path to it, so a
child's bucket continues its parent's state over one more word and no feature is put together as text.
First, nodes fold into bucket totals, a fixed number a task, which Spark adds up. Then texts
are scored by walking the trie's paths, each node with the gain of its bucket attached. A trie that
reaches NODES nodes is folded and begun anew; the sums are the same, so memory stays bounded.

The draw takes no sort of all rows: scores are whole numbers within a range that the formulas bound,
so the driver reads how many rows each has, finds the cut, and a row's rank is the number of rows above
its score and its place among the equal ones.

Defined results. Null and empty texts have no feature, weight 0, and cannot be drawn. Very long texts are
read whole, a piece at a time. A null id counts as an empty text in the noise and comes after other
ids on ties. Rows equal in all results stand next to one another in the ranking, each with a rank of its
own. An empty table gives an empty result; an empty target set has no features. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoss.llm.shared import bounded_batches, keep, named, trimmed, utf8

BUCKETS = 10_000
NODES = 1 << 20
BLOCK = 1 << 17  # words
PIECE = 1 << 20  # bytes
PERCENT = 25
LEAST_WORDS = 20
SEED = 7

# letters a-z (A-Z lowered), digits and all bytes beyond ASCII belong to words
_SIGNS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class _Numbers(dict):
    """Words by number; a new word gets the next one."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class WordTrie:
    """Words, and words after words: counts, CRC states and, if gains are given, gains."""

    def __init__(self, gains: np.ndarray | None = None) -> None:
        self.gains = gains
        self.clear()

    def clear(self) -> None:
        self.numbers, self.after = _Numbers(), []  # after: each word as the edge to it, behind a space
        self.state, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.edges, self.deep_state, self.deep_count = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.state) + len(self.edges) > NODES

    def first(self, words: list[bytes]) -> np.ndarray:
        """Nodes of words below the root, made where they are new."""
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if new := self.numbers.new:
            self.state = np.append(self.state, np.fromiter(map(zlib.crc32, new), np.uint32, len(new)))
            self.count = np.append(self.count, np.zeros(len(new), np.int64))
            self.after += [b" " + w for w in new]
            self.numbers.new = []
        return found

    def second(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node of each different pair, which of them each pair is, how often it came)."""
        different, which, often = np.unique(parent << 32 | child, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.edges, different)
        known = np.zeros(len(different), bool)
        inside = at < len(self.edges)
        known[inside] = self.edges[at[inside]] == different[inside]
        new = different[~known]
        if len(new):
            begun = self.state[new >> 32].tolist()
            states = np.fromiter(map(zlib.crc32, map(self.after.__getitem__, (new & 0xFFFFFFFF).tolist()), begun), np.uint32, len(new))
            self.edges = np.insert(self.edges, at[~known], new)
            self.deep_state = np.insert(self.deep_state, at[~known], states)
            self.deep_count = np.insert(self.deep_count, at[~known], 0)
            at = np.searchsorted(self.edges, different)
        return at, which, often

    def add(self, words: list[bytes], text: np.ndarray, carried: int) -> None:
        """Count the features of a block; the first ``carried`` words were counted before."""
        node = self.first(words)
        self.count += np.bincount(node[carried:], minlength=len(self.count))
        same = text[1:] == text[:-1]
        at, _, often = self.second(node[:-1][same], node[1:][same])
        self.deep_count[at] += often

    def totals(self) -> np.ndarray:
        """The nodes' counts by bucket."""
        out = np.zeros(BUCKETS, np.int64)
        np.add.at(out, self.state % BUCKETS, self.count)
        np.add.at(out, self.deep_state % BUCKETS, self.deep_count)
        return out

    def walk(self, words: list[bytes], text: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, gain) of each feature of a block."""
        node = self.first(words)
        same = text[1:] == text[:-1]
        at, which, _ = self.second(node[:-1][same], node[1:][same])
        one, two = self.gains[self.state % BUCKETS][node[carried:]], self.gains[self.deep_state[at] % BUCKETS][which]
        return np.concatenate([text[carried:], text[1:][same]]), np.concatenate([one, two])


def _pieces(body: bytes) -> Iterator[bytes]:
    """A text a piece at a time, cut before a space."""
    at = 0
    while len(body) - at > PIECE:
        cut = body.rfind(b" ", at + 1, at + PIECE)
        if cut < 0:
            cut = body.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield body[at:cut]
        at = cut
    yield body[at:]


def blocks(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Words of many texts, the number of each word's text, and how many words are here only as a parent.

    A text that goes on in the next block leaves its last word there.
    """
    data, offsets = utf8(texts)
    words: list[bytes] = []
    held: list[tuple[int, int]] = []
    carried = 0
    for k in range(len(offsets) - 1):
        for piece in _pieces(data[offsets[k] : offsets[k + 1]].tobytes().translate(_SIGNS)):
            got = piece.split()
            if not got:
                continue
            words += got
            held.append((k, len(got)))
            if len(words) >= BLOCK:
                yield words, _spread(held), carried
                words, held, carried = words[-1:], [(k, 1)], 1
    if len(words) > carried:
        yield words, _spread(held), carried


def _spread(held: list[tuple[int, int]]) -> np.ndarray:
    return np.repeat([k for k, _ in held], [n for _, n in held])


def bucket_totals(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; the driver gets one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = WordTrie(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, text, carried in blocks(batch.column(0)):
                trie.add(words, text, carried)
                if trie.full():
                    out += trie.totals()
                    trie.clear()
        out += trie.totals()
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used], pa.int64())], names=["bucket", "n"])

    rows = docs.select(named(text_col).alias("text")).mapInArrow(trimmed(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of smoothed shares, floored, by bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(gains)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for words, text, carried in blocks(batch.column(1)):
                of, gain = trie.walk(words, text, carried)
                np.add.at(n, of, 1)
                np.add.at(total, of, gain)
                if trie.full():
                    trie.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "n_features", "weight"])

    return docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).mapInArrow(trimmed(score), "id long, n_features long, weight long")


def noised(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with score: weight and floored Gumbel noise, in thousandths, from the id's hash."""
    word = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((word + 0.5) / 4294967296.0))))


def ranked(spark: SparkSession, scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (id, n_features, weight, score) with the rank of drawn rows."""
    able = F.col("n_features") >= 2 * least_words - 1
    # scores are whole numbers from a range that does not grow with the rows
    levels = sorted(((r["score"], r["count"]) for r in scored.where(able).groupBy("score").count().collect()), reverse=True)
    most = sum(n for _, n in levels) * percent // 100
    above, before = [], 0
    for score, n in levels:
        if before >= most:
            break
        above.append((score, before))
        before += n
    if not above:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cut = above[-1][0]
    near = able & (F.col("score") >= cut)
    # equal rows are counted first, so that many copies of one row are no task's burden to sort
    once = scored.where(near).groupBy("score", "id", "n_features", "weight").count()
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features")
    placed = once.withColumn("upto", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(F.broadcast(spark.createDataFrame(above, "score long, before long")), "score")
    each = placed.withColumn("place", F.explode(F.sequence(F.col("upto") - F.col("count") + 1, F.col("upto")))).withColumn("rank", F.col("before") + F.col("place"))
    names = [*scored.columns, "rank"]
    drawn = each.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).select(*names)
    return drawn.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs with its features, weight, score and, if drawn, rank."""
    bounded_batches(spark)
    gains = log_gains(bucket_totals(docs, text_col), bucket_totals(target, target_col))
    scored = keep(spark, noised(weights(docs, gains, id_col, text_col), seed), "scores")
    return ranked(spark, scored, percent, least_words).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
