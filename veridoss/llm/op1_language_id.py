"""Language identification by Bayesian evidence fusion.

For each language the log posterior adds

- the text's likelihood: a naive Bayes model over hashed byte trigrams, tempered because
  neighbouring trigrams overlap;
- the declared (markup) language: a reliability learned by grouped aggregation;
- the address prior: votes by host, smoothed towards the host's domain, that towards the address
  suffix (with a fixed table of country suffixes), and that towards the whole corpus, all counted
  by grouped aggregation.

No evidence is used twice. A labelled row's own trigrams are taken out of its language's counts
before it is scored, and its own vote is taken out of the host, domain, suffix and corpus counts
before they make its prior. A background class of evenly spread trigrams competes with the
languages. A row is rejected ("und") if the background wins, no language reaches min_confidence,
or there is no letter.

Every well-formed label (two or three letters) is a language, every host, domain and suffix is
counted, and counts cover all rows. The model is sparse: six bytes for each trigram that a language
was seen with, so rare languages cost little; tables are spread out one language at a time. It is sent
to the workers only if it is measured to take MODEL_BYTES at most; a larger one lies in the shared folder,
a file a language, written by tasks and mapped by workers, and only the files' names pass the driver.
Rows are scored in pieces of CELLS scores, so memory does not follow the number of languages. Address
counts are broadcast only if counted to be few; otherwise the same join is shuffled, where adaptive
execution splits a hot host.

Defined results. Null or empty text, or text without letters: rejected with confidence 0. Null
declared language or host: no evidence of that kind. Ties go to the first language in alphabetical
order. Repeated rows are counted as often as they occur and get equal results. Very long texts are
read whole, in blocks of BLOCK bytes. Empty table: empty result. Extra columns pass through; an
input column named like a result column gives way to it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.op9_trie_lm import map_arrays, write_arrays
from veridoss.llm.shared import fresh, keep, named, new_path, trimmed, utf8
from veridoss.llm.tokens import release

BITS = 16
SIZE = 1 << BITS
BLOCK = 1 << 18  # bytes of text handled at once
PSEUDO = 0.1  # added to each trigram count
BACKGROUND = -10.0  # natural log of a trigram's probability in no language
TEMPER = 1 / 3
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 50.0
SUFFIX_WEIGHT = 50.0
BROADCAST_HOSTS = 100_000
BROADCAST_VOTES = 1_000_000  # over all hosts that are broadcast
MODEL_BYTES = 64 << 20  # of a model that is sent to the workers
CELLS = 1 << 20  # scores (rows x languages) held at once
HELD_TABLES = 16  # languages whose tables a worker keeps spread out
RESULT = ("identified_lang", "text_lang", "confidence")

# Languages usual under country suffixes.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "uk": "en", "us": "en", "au": "en", "ie": "en", "pl": "pl", "se": "sv", "dk": "da", "fi": "fi", "cz": "cs", "ru": "ru"}

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class TextModel:
    """Languages in alphabetical order; for each the trigram hashes seen and their counts, held or in a file."""

    languages: list[str]
    grams: list[np.ndarray]  # uint16, ascending
    counts: list[np.ndarray]  # uint32
    totals: list[int]
    files: list[str] = field(default_factory=list)  # in place of grams and counts
    _held: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_held": {}}

    def table(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed counts of language j by trigram hash, and their logarithms."""
        if j not in self._held:
            if len(self._held) >= HELD_TABLES:
                self._held.pop(next(iter(self._held)))
            c = np.full(SIZE, PSEUDO, np.float32)
            if self.files:
                seen = map_arrays(self.files[j])[0]
                c[seen["grams"]] += seen["counts"]
            else:
                c[self.grams[j]] += self.counts[j]
            self._held[j] = c, np.log(c)
        return self._held[j]


def _trigrams(data: np.ndarray) -> np.ndarray:
    x = _FOLD[data]
    if len(x) < 3:
        return np.zeros(0, np.int32)
    return (((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - BITS)).astype(np.int32)


def _counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, trigram, count) of the distinct trigrams of each row, rows from 0.

    Rows are taken together up to BLOCK bytes; a longer one is alone and read block by block.
    """
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, min(int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1, lo + (1 << 14)))
        if offsets[hi] - offsets[lo] > BLOCK:
            own = np.zeros(SIZE, np.int64)
            for at in range(int(offsets[lo]), int(offsets[hi]), BLOCK):
                own += np.bincount(_trigrams(data[at : min(at + BLOCK + 2, offsets[hi])]), minlength=SIZE)
            gram = np.flatnonzero(own)
            yield lo, hi, np.zeros(len(gram), np.int32), gram, own[gram]
        else:
            grams = _trigrams(data[offsets[lo] : offsets[hi]])
            at = offsets[lo : hi + 1] - offsets[lo]
            row = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(at))[: len(grams)]
            inside = np.arange(len(grams)) < (at[1:] - 2)[row]
            keys = np.sort((row << BITS | grams)[inside])
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            yield lo, hi, keys[first] >> BITS, keys[first] & (SIZE - 1), np.diff(np.concatenate((first, [len(keys)])))
        lo = hi


def train(labelled: DataFrame, text_col: str, label_col: str) -> TextModel:
    """Trigram counts of all labelled rows, by well-formed label; one row a language reaches the driver."""
    rows = labelled.select(F.lower(F.col(label_col)).alias("label"), F.col(text_col).alias("text")).where(F.col("label").rlike("^[a-z]{2,3}$") & F.col("text").isNotNull())
    most = 32  # labels a task holds before it sends them on

    def packed(label: list[str], salt: list[int], tables: list[np.ndarray]) -> dict:
        return {"label": pa.array(label, pa.string()), "salt": pa.array(salt, pa.int32()), "counts": pa.array([zlib.compress(t.tobytes(), 1) for t in tables], pa.binary())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        part, seen = TaskContext.get().partitionId() % 32, {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for lo, hi, row, gram, n in _counted(*utf8(batch.column(1))):
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                by: dict[str, list[int]] = {}
                for i, x in enumerate(labels[lo:hi]):
                    by.setdefault(x, []).append(i)
                for x, mine in by.items():
                    if x not in seen and len(seen) >= most:
                        yield pa.RecordBatch.from_pydict(packed(list(seen), [part] * len(seen), list(seen.values())))
                        seen.clear()
                    at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in mine])
                    table = seen.setdefault(x, np.zeros(SIZE, np.uint64))
                    table += np.bincount(gram[at], n[at], SIZE).astype(np.uint64)
        if seen:
            yield pa.RecordBatch.from_pydict(packed(list(seen), [part] * len(seen), list(seen.values())))

    def total(batches: Iterator[pa.RecordBatch]) -> tuple[str, np.ndarray]:
        label, out = "", np.zeros(SIZE, np.uint64)
        for batch in batches:
            for said, x in zip(batch.column("label"), batch.column("counts"), strict=True):
                label = said.as_py()
                out += np.frombuffer(zlib.decompress(x.as_py()), np.uint64)
        return label, out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, table = total(batches)
        yield pa.RecordBatch.from_pydict(packed([label], [0], [table]))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, table = total(batches)
        gram = np.flatnonzero(table)
        counts = np.minimum(table[gram], 0xFFFFFFFF).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"label": [label], "grams": [gram.astype(np.uint16).tobytes()], "counts": [counts.tobytes()], "total": [int(table.sum())]})

    spark = labelled.sparkSession
    schema = "label string, salt int, counts binary"
    sums = rows.mapInArrow(trimmed(count), schema).groupBy("label", "salt").applyInArrow(add, schema)
    sums = keep(spark, sums.groupBy("label").applyInArrow(sparse, "label string, grams binary, counts binary, total long"), "languages")
    size = sums.agg(F.sum(F.length("grams") + F.length("counts"))).first()[0] or 0
    if size > MODEL_BYTES:
        return _in_files(sums, new_path(spark, "model"))
    model = TextModel([], [], [], [])
    for r in sums.orderBy("label").toLocalIterator():  # MODEL_BYTES at most
        model.languages.append(r.label)
        model.grams.append(np.frombuffer(r.grams, np.uint16))
        model.counts.append(np.frombuffer(r.counts, np.uint32))
        model.totals.append(r.total)
    return model


def _in_files(sums: DataFrame, path: str) -> TextModel:
    """A model whose tables are written by tasks, a file a language; the driver gets names and totals (two or three letters: 18,252 at most)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, grams, counts, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = f"{path}/{label}-{uuid.uuid4().hex[:8]}"  # each attempt writes its own
                write_arrays(file, {"grams": np.frombuffer(grams, np.uint16), "counts": np.frombuffer(counts, np.uint32)})
                yield pa.RecordBatch.from_pydict({"label": [label], "file": [file], "total": [n]})

    found = sorted(sums.select("label", "grams", "counts", "total").mapInArrow(write, "label string, file string, total long").collect())
    return TextModel([r.label for r in found], [], [], [r.total for r in found], [r.file for r in found])


def _pieces(batches: Iterator[pa.RecordBatch], languages: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none needs more than CELLS scores."""
    most = max(1, CELLS // (languages + 1))
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), most):
            yield batch.slice(at, most)


def _scores(model: TextModel, data: np.ndarray, offsets: np.ndarray, declared: list[str | None]) -> np.ndarray:
    """Rows x (languages + background): tempered log likelihoods, a row's own counts left out."""
    place = {x: i for i, x in enumerate(model.languages)}
    label = np.array([place.get(x, -1) for x in declared], np.int64)
    out = np.zeros((len(offsets) - 1, len(model.languages) + 1))
    for lo, hi, row, gram, n in _counted(data, offsets):
        begin = np.searchsorted(row, np.arange(hi - lo))
        some = np.flatnonzero(np.diff(np.concatenate((begin, [len(row)]))))  # rows with a trigram
        if not len(some):
            continue
        cuts, at = begin[some], some + lo
        size = np.add.reduceat(n, cuts).astype(float)
        for j, total in enumerate(model.totals):
            counts, logs = model.table(j)
            out[at, j] = np.add.reduceat(logs[gram] * n, cuts) - size * np.log(total + PSEUDO * SIZE)
            if (own := label[at] == j).any():
                less = np.log(np.maximum(counts[gram] - n, PSEUDO)) * n
                left = np.maximum(total - size, 0) + PSEUDO * SIZE
                out[at[own], j] = (np.add.reduceat(less, cuts) - size * np.log(left))[own]
        out[at, -1] = size * BACKGROUND
    return out * TEMPER


def _has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    for i in range(len(out)):
        for at in range(int(offsets[i]), int(offsets[i + 1]), BLOCK):
            if (_FOLD[data[at : min(at + BLOCK, offsets[i + 1])]] != 32).any():
                out[i] = True
                break
    return out


def registered_domain(host: Column) -> Column:
    """The last two labels of a host name; a name without a dot is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def evidence_counts(spark: SparkSession, rows: DataFrame, model: TextModel) -> DataFrame:
    """(host, declared, lang, n): how often the text alone says lang (null: no language); summed per task first."""
    held = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model, seen = held.value, {}

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(seen.values()), pa.int64())], names=["host", "declared", "lang", "n"])
            seen.clear()
            return out

        for batch in _pieces(batches, len(model.languages)):
            hosts, declared = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for host, said, vote in zip(hosts, declared, _votes(model, *utf8(batch.column(0)), declared)[1], strict=True):
                key = host, said, None if vote is None else model.languages[vote]
                seen[key] = seen.get(key, 0) + 1
            if len(seen) > 50_000:
                yield flush()
        if seen:
            yield flush()

    return rows.select("text", "host", "declared").mapInArrow(trimmed(count), "host string, declared string, lang string, n long").groupBy("host", "declared", "lang").agg(F.sum("n").alias("n"))


def _votes(model: TextModel, data: np.ndarray, offsets: np.ndarray, declared: list[str | None]) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Log likelihoods, the language that the text alone says (None: none) and whether it has letters."""
    like = _scores(model, data, offsets, declared)
    fine = _has_letters(data, offsets)
    best = like.argmax(1) if len(like) else np.zeros(0, np.int64)
    return like, [int(b) if ok and b < len(model.languages) else None for b, ok in zip(best, fine, strict=True)], fine


def address_counts(counts: DataFrame) -> DataFrame:
    """(host, by_host, by_domain, by_suffix): votes as arrays of (language, n)."""
    base = counts.where("host IS NOT NULL").groupBy("host", "lang").agg(F.sum("n").alias("n"))

    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        # a struct a language at most; votes for no language only keep the key
        return df.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n")))).alias(name))

    keyed = base.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    hosts = packed(base, "host", "by_host").withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    domains = packed(keyed.groupBy("domain", "lang").agg(F.sum("n").alias("n")), "domain", "by_domain")
    suffixes = packed(keyed.where("suffix IS NOT NULL").groupBy("suffix", "lang").agg(F.sum("n").alias("n")), "suffix", "by_suffix")
    return hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left").select("host", "by_host", "by_domain", "by_suffix")


def log_prior(languages: list[str], world: np.ndarray, levels: tuple, tail: str | None, vote: int | None) -> np.ndarray:
    """Log of the hierarchical prior, from the corpus down to the host, less the row's own vote.

    levels: votes by suffix, domain and host, each a list of (place, n) or None (no such level).
    """
    own = np.zeros(len(languages))
    if vote is not None:
        own[vote] = 1
    p = np.maximum(world - own, 0) + 1.0
    p /= p.sum()
    usual = SUFFIX_LANGUAGE.get(tail or "")
    if usual in languages:
        p *= 0.5
        p[languages.index(usual)] += 0.5
    for votes, weight in zip(levels, (SUFFIX_WEIGHT, DOMAIN_WEIGHT, HOST_WEIGHT), strict=True):
        if votes is None:
            continue
        c = np.zeros(len(languages))
        for i, n in votes:
            c[i] = n
        c = np.maximum(c - own, 0)
        p = (c + weight * p) / (c.sum() + weight)
    return np.log(p)


def identify(spark: SparkSession, rows: DataFrame, model: TextModel, text: Column | str, declared: Column | None = None, host: Column | None = None, min_confidence: float = 0.5, returned: list[str] | None = None) -> DataFrame:
    """rows with identified_lang ("und" if rejected), text_lang and confidence added.

    text is a column's name or an expression. returned: the columns of rows to give back, all by
    default; leave the text out where it is not needed, it then never comes back from Python.
    """
    none = F.lit(None).cast("string")
    names = [c for c in (rows.columns if returned is None else returned) if c.lower() not in RESULT]
    langs = model.languages
    if not langs:  # nothing was learned: every row is rejected
        return rows.select(*[named(c) for c in names], F.lit("und").alias("identified_lang"), none.alias("text_lang"), F.lit(0.0).alias("confidence"))
    declared = none if declared is None else F.nullif(F.regexp_extract(F.lower(declared), "^([a-z]{2,3})", 1), F.lit(""))
    host = none if host is None else F.nullif(F.lower(host), F.lit(""))
    body, said, at = fresh(names, "text", "declared", "host")
    carried = isinstance(text, str) and text in names
    shown = text if carried else body
    extra = [] if carried else [(text if isinstance(text, Column) else named(text)).alias(body)]
    used = rows.select(*[named(c) for c in names], *extra, declared.alias(said), host.alias(at))
    counts = keep(spark, evidence_counts(spark, used.select(named(shown).alias("text"), named(at).alias("host"), named(said).alias("declared")), model), "evidence")
    agree, stated = (x or 0 for x in counts.where(F.col("declared").isin(langs) & F.col("lang").isNotNull()).agg(F.sum(F.when(F.col("declared") == F.col("lang"), F.col("n"))), F.sum("n")).first())
    trust = min(0.99, max(1 / max(2, len(langs)), (agree + 1.0) / (stated + 2.0)))
    place = {x: i for i, x in enumerate(langs)}
    world = np.zeros(len(langs))
    for r in counts.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).collect():  # a row a language
        world[place[r.lang]] = r.n
    packs = fresh([*names, body, said, at], "key", "by_host", "by_domain", "by_suffix")
    address = keep(spark, address_counts(counts), "hosts").toDF(*packs)
    votes = sum((F.coalesce(F.size(named(p)), F.lit(0)) for p in packs[1:]), F.lit(0))
    hosts, cells = address.agg(F.count("*"), F.sum(votes)).first()
    if hosts <= BROADCAST_HOSTS and (cells or 0) <= BROADCAST_VOTES:
        address = F.broadcast(address)
    held = spark.sparkContext.broadcast((model, world, trust))
    joined = used.join(address, named(at) == named(packs[0]), "left").drop(packs[0])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[named(c) for c in names]).schema.fields)
    schema += ", " * bool(schema) + "identified_lang string, text_lang string, confidence double"

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model, world, trust = held.value
        langs, priors = model.languages, {}
        place = {x: i for i, x in enumerate(langs)}
        other = np.log((1 - trust) / max(1, len(langs) - 1))
        for batch in _pieces(batches, len(langs)):
            n = batch.num_rows
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            said_, hosts = get(said).to_pylist(), get(at).to_pylist()
            like, votes, fine = _votes(model, *utf8(get(shown)), said_)
            log = like.copy()
            levels = [get(c) for c in (packs[3], packs[2], packs[1])]
            for i, (declared, host, vote) in enumerate(zip(said_, hosts, votes, strict=True)):
                if declared in place:
                    log[i, :-1] += other
                    log[i, place[declared]] += np.log(trust) - other
                if host is not None:
                    if (host, vote) not in priors:
                        if len(priors) > min(4096, CELLS // len(langs)):
                            priors.clear()
                        found = [x[i].as_py() for x in levels]
                        tail = host.rsplit(".", 1)[1] if "." in host else None
                        priors[host, vote] = log_prior(langs, world, tuple(None if f is None else [(place[v["lang"]], v["n"]) for v in f] for f in found), tail, vote)
                    log[i, :-1] += priors[host, vote]
            if n:
                share = np.exp(log - log.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best, alone = share.argmax(1), like.argmax(1)
                sure = share[np.arange(n), best]
            else:
                best = alone = np.zeros(0, np.int64)
                sure = np.zeros(0)
            good = fine & (best < len(langs)) & (sure >= min_confidence)
            name = [*langs, "und"]
            extra = [pa.array([name[b] if ok else "und" for b, ok in zip(best, good, strict=True)], pa.string()), pa.array([name[a] for a in alone], pa.string()), pa.array(np.where(fine, sure, 0.0))]
            yield pa.RecordBatch.from_arrays([*(get(c) for c in names), *extra], names=[*names, *RESULT])

    return joined.mapInArrow(trimmed(fuse), schema)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags give way to spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[#\w]+;", " ")


def declared_in_markup(html: Column) -> Column:
    """The lang attribute of the html element; empty if there is none."""
    return F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)


