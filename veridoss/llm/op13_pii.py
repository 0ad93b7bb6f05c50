"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

Four base kinds come from patterns and always stay. Beside them, generators with high recall propose
overlapping spans: anything around an at sign or its spelled-out forms, runs of neighbouring digit
groups, colon-separated hexadecimal groups, and letters with digits behind them. A span gets
features of its form (lengths, groups, signs, check sums) and of its context (neighbouring
characters, cue words on either side). Gradient-boosted trees give a score for each kind; isotonic
regression on examples held out from the trees makes it a probability, and each kind's threshold is the
lowest one at which the held-out examples reach PRECISION. Of overlapping spans that pass, the likeliest
stays, then the longest, then the first.

The trees learn from examples made by rule: forms of personal data, and of numbers and addresses that are
none, set into a bounded sample of the corpus's own lines. SAMPLE lines at most are read, chosen by the
hash of their text; all else covers every whole text. Fitting takes a few seconds in the driver.

Defined results. Null and empty texts have no span. Offsets count code points, ends are exclusive. Very long
texts are read whole, in time that grows with their length. A proposed span that touches a base span is
dropped. Rows that repeat each get their result; equal texts have equal spans. An empty table gives an empty
result, and its model is fitted without lines around the examples. Extra columns are ignored by
``find_personal``; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.shared import bounded_batches, named, trimmed

# The kinds, base ones first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "id")
SAMPLE = 2_000  # lines of the corpus around the examples
EXAMPLES = 6_000
PRECISION = 0.98
BLOCK = 4096  # proposed spans judged at once
WINDOW = 32  # characters of context on either side
SEED = 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs so that a long word is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at + 1)
        if tail and at > done:
            start = at
            while start > done:  # a step at a time back to where the local part begins
                step = min(256, start - done)
                found = _LOCAL.match(text[start - step : start][::-1]).end()
                start -= found
                if found < step:
                    break
            if start < at:
                yield start, tail.end()
                done = tail.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- generators

_GROUP = re.compile(r"(?<![0-9])[0-9]++")
_GLUE = re.compile(r"[\x20().\-/]{1,3}")
_SPELLED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?:\s?(@|\(at\)|\[at\]|\{at\})\s?|\sat\s)[\w-]{1,63}", re.IGNORECASE)
_DOTTED = re.compile(r"\s?(?:(\.)|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[\w-]{2,63}(?!\w)", re.IGNORECASE)
_SPELLS = re.compile(r"@|\bat\b|\(at\)|\[at\]|\{at\}", re.IGNORECASE)
_COLONS = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_LETTERS = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){2,8}(?![A-Za-z0-9])")
LABELS = 4  # further parts of a host's name
GROUPS = 5  # digit groups of one span: no form of any kind has more


def proposals(text: str) -> list[tuple[int, int]]:
    """Spans, overlapping ones too, that may hold personal data; a bounded number for each place in the text."""
    out: set[tuple[int, int]] = set()
    if _SPELLS.search(text):
        for m in _SPELLED.finditer(text):
            plain, end = m.group(1) is None, m.end()
            for _ in range(LABELS):
                dot = _DOTTED.match(text, end)
                if not dot or plain and dot.group(1):  # "at home. Then" is plain prose
                    break
                end = dot.end()
                out.add((m.start(), end))
    if _DIGIT.search(text):
        spans = [m.span() for m in _GROUP.finditer(text)]
        for i, (start, _) in enumerate(spans):
            n = 0
            for j in range(i, min(len(spans), i + GROUPS)):
                if j > i and not _GLUE.fullmatch(text, spans[j - 1][1], spans[j][0]):
                    break
                n += spans[j][1] - spans[j][0]
                if n > 19:
                    break
                if n >= 7:
                    out.add((start - (start > 0 and text[start - 1] in "+("), spans[j][1]))
        out.update(m.span() for m in _LETTERS.finditer(text))
    if ":" in text:
        out.update(m.span() for m in _COLONS.finditer(text))
    return sorted(out)


# --- features

# Cue words in lower case, by what they speak for.
CUES = (
    ("mail", "write to", "contact", "correo", "courriel", "e-mail"),
    ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "handy", "móvil"),
    ("card", "visa", "master", "amex", "karte", "carte", "tarjeta", "cvv", "exp"),
    ("account", "konto", "compte", "cuenta", "customer", "member", "acct", "kunden"),
    ("iban", "bic", "swift", "bank", "banque", "banco"),
    ("ssn", "social", "passport", "tax id", "national", "licence no", "ausweis"),
    ("ip", "host", "server", "address", "from", "login", "client"),
    ("version", "release", "build", "v.", "section", "chapter", "page", "fig", "table", "rfc"),
    ("isbn", "issn", "doi", "order", "invoice", "item", "part", "sku", "serial", "model"),
    ("price", "total", "usd", "eur", "$", "€", "£", "cost", "sum", "size", "bytes", "kb", "mb"),
    ("hash", "commit", "sha", "md5", "uuid", "key", "token", "seed", "checksum"),
    ("date", "time", "year", "since", "until", "born", "copyright", "utc"),
    ("latitude", "longitude", "coordinates", "pi", "=", "+", "*", "sum of", "equals"),
)
_SIGN_SETS = ("-", ".", " ", "/", "(", ":", "@")


def features(text: str, start: int, end: int) -> list[float]:
    """Form and context of a span, as numbers."""
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    letters = sum(c.isalpha() for c in span)
    left, right = text[max(0, start - WINDOW) : start].lower(), text[end : end + WINDOW // 2].lower()
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    iban = re.sub(r"\s", "", span)
    form = [
        len(span), len(digits), letters, sum(c.isupper() for c in span), len(groups), groups[0], groups[-1], max(groups), min(groups),
        float(len(set(groups)) == 1), float(len(digits) >= 12 and luhn(digits)), len(set(digits)), float(digits[:1] in "3456" and digits != ""),
        float(digits[:2] in ("19", "20")), float(digits.startswith("0")), float(span[:1] == "("), float(span[:1] == "+"),
        float(iban.isalnum() and iban.isascii() and iban[:2].isalpha() and 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1),
        float("dot" in span.lower()), float(bool(re.search(r"\.(?:com|org|net|edu|gov|io|[a-z]{2})\Z", span.lower()))),
    ]
    # a part of a longer row of digit groups has more of it beyond a sign
    more = [float(bool(re.search(r"[0-9][\x20().\-/]{1,3}\Z", left))), float(bool(re.match(r"[\x20().\-/]{1,3}[0-9]", right)))]
    sides = [float(c.isalnum()) for c in (before, after)] + [float(c in "-_/.:=#") for c in (before, after)] + [float(after.isspace() or after in ".,;!?)"), float(before in "$€£")]
    return form + more + [span.count(c) for c in _SIGN_SETS] + sides + [float(sum(w in left for w in words)) for words in CUES] + [float(any(w in right for w in words)) for words in CUES]


# --- trees


class Trees:
    """Gradient-boosted regression trees under logistic loss, one score a row."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.4, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (feature, limit) of inner nodes in heap order; leaves

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        at = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)  # v <= c[k] iff at <= k
        width = max(2, max(len(c) for c in cuts) + 1)
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(cuts, at, width, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._leaf_values(tree, x)
        return self

    def _grow(self, cuts: list[np.ndarray], at: np.ndarray, width: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One tree, a level at a time: sums by node, feature and bin give every cut's gain at once."""
        inner, f = (1 << self.depth) - 1, at.shape[1]
        feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(g), np.int64)
        column, rows = np.arange(f), np.arange(len(g))
        real = np.arange(width - 1) < np.array([len(c) for c in cuts])[:, None]
        gs, hs = np.repeat(g, f), np.repeat(h, f)
        for level in range(self.depth):
            first, nodes = (1 << level) - 1, 1 << level
            cell = (((node - first)[:, None] * f + column) * width + at).ravel()
            left_g, left_h = (np.bincount(cell, v, nodes * f * width).reshape(nodes, f, width).cumsum(2) for v in (gs, hs))
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            lg, lh = left_g[..., :-1], left_h[..., :-1]
            gain = lg**2 / (lh + self.ridge) + (all_g - lg) ** 2 / (all_h - lh + self.ridge) - all_g**2 / (all_h + self.ridge)
            gain = np.where(real, gain, -1).reshape(nodes, -1)
            best = gain.argmax(1)
            for n in np.flatnonzero(gain[np.arange(nodes), best] > 1e-9):  # in others, all rows go left
                k, c = divmod(int(best[n]), width - 1)
                feature[first + n], limit[first + n] = k, cuts[k][c]
            cut_at = np.where(np.isinf(limit[node]), width, best[node - first] % (width - 1))
            node = 2 * node + 1 + (at[rows, feature[node]] > cut_at)
        leaf = node - inner
        leaves = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
        return feature, limit, leaves

    def _leaf_values(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, limit, leaves = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        return leaves[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            out += self._leaf_values(tree, x)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the best rising step function, by pooling neighbours that fall."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum, rows, lowest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1][0] += top[0]
            pools[-1][1] += top[1]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Model:
    """Per kind: trees, calibration and the least probability that is accepted."""

    def __init__(self, seed: int = SEED) -> None:
        self.seed, self.parts = seed, {}

    def fit(self, lines: list[str], examples: int = EXAMPLES, precision: float = PRECISION) -> Model:
        rng = random.Random(self.seed)
        x, kind, held = [], [], []
        for n in range(examples):
            text, start, end, label = example(rng, lines)
            for a, b in proposals(text):
                if a < end and start < b:  # others are the sample line's own and not known to be either
                    right = label is not None and (a, b) == (start, end)
                    if not right and label is not None and rng.random() < 0.5:
                        continue
                    x.append(features(text, a, b))
                    kind.append(KINDS.index(label) if right else -1)
                    held.append(n % 3 == 0)
        xs, kinds, out = np.array(x, float), np.array(kind), np.array(held)
        for k, name in enumerate(KINDS):
            if name == "card" or not (kinds == k).any():  # numbers that fail the check digit are accounts
                continue
            trees = Trees().fit(xs[~out], (kinds[~out] == k).astype(float))
            y, score = (kinds[out] == k).astype(float), trees.score(xs[out])
            steps, chance = isotonic(score, y)
            p = chance[np.clip(np.searchsorted(steps, score, "right") - 1, 0, None)]
            fine = [c for c in np.unique(chance) if c > 0 and y[p >= c].mean() >= precision]
            if fine:
                self.parts[k] = trees, steps, chance, float(min(fine))
        return self

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind or -1, probability) of each row: the likeliest kind of those above their threshold."""
        best, chance = np.full(len(x), -1), np.zeros(len(x))
        for k, (trees, steps, chances, least) in self.parts.items():
            p = chances[np.clip(np.searchsorted(steps, trees.score(x), "right") - 1, 0, None)]
            better = (p >= least) & (p > chance)
            best[better], chance[better] = k, p[better]
        return best, chance


# --- examples

_NAMES = ("anna.meier", "j.smith", "k_olsen", "maria99", "li.wei", "p.o.brien", "sales", "info", "r.garcia", "t-nguyen")
_HOSTS = ("example", "mail-host", "web", "uni-city", "corp", "posta", "inbox", "acme")
_ENDS = ("com", "org", "net", "de", "fr", "es", "io", "edu")


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _iban(rng: random.Random) -> str:
    country, body = rng.choice(("DE", "FR", "ES", "GB", "NL", "CH", "IT")), _number(rng, rng.choice((14, 16, 18, 20)))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    whole = f"{country}{check:02d}{body}"
    return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def _personal(rng: random.Random) -> tuple[str, str, str]:
    """(kind, text, words that may stand before it)."""
    kind = rng.choice(("email", "email", "phone", "phone", "ip", "account", "account", "iban", "id"))
    n, name, host, end = lambda k: _number(rng, k), rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_ENDS)
    area, mid = f"{rng.randint(201, 989)}", f"{rng.randint(200, 999)}"
    if kind == "email":
        a, d = rng.choice(((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("@", "."), (" @ ", "."), ("(at)", "."), (" (at) ", " (dot) ")))
        return kind, f"{name}{a}{host}{d}{end}", rng.choice(("mail ", "e-mail: ", "contact ", "write to ", ""))
    if kind == "phone":
        form = rng.choice((f"({area}) {mid}-{n(4)}", f"{area}-{mid}-{n(4)}", f"{area}.{mid}.{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"0{n(2)}/{n(7)}", f"{area} {mid} {n(4)}", f"00{n(2)} {n(3)} {n(6)}"))
        return kind, form, rng.choice(("phone: ", "tel ", "call ", "mobile ", "fax ", "tel. ", ""))
    if kind == "ip":
        form = ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8)) if rng.random() < 0.5 else f"2001:db8::{rng.randint(1, 65535):x}:{rng.randint(1, 65535):x}"
        return kind, form, rng.choice(("from ", "host ", "client ", "ip ", ""))
    if kind == "account":
        long = n(16) if rng.random() < 0.7 else n(rng.choice((13, 14, 15, 17, 18, 19)))
        form = long if rng.random() < 0.6 else rng.choice((" ", "-")).join(long[i : i + 4] for i in range(0, len(long), 4))
        return kind, form, rng.choice(("card ", "account ", "account no. ", "customer ", "visa ", "konto ", "", ""))
    if kind == "iban":
        return kind, _iban(rng), rng.choice(("iban ", "IBAN: ", "bank ", "", ""))
    form = rng.choice((f"{mid}-{n(2)}-{n(4)}", f"{rng.choice('CXKP')}{n(2)}{rng.choice('ABCX')}{n(4)}{rng.choice('KLM')}{n(2)}"))
    return kind, form, rng.choice(("ssn ", "social security ", "passport ", "national id ", ""))


def _harmless(rng: random.Random) -> tuple[str, str]:
    """(text, words before it) of what only looks like personal data."""
    n, r = lambda k: _number(rng, k), rng.randint
    date = f"{r(1900, 2030)}-{r(1, 12):02d}-{r(1, 28):02d}"
    return rng.choice((
        (f"{date} {r(0, 23):02d}:{r(0, 59):02d}:{r(0, 59):02d}", "on "), (f"{r(1, 28):02d}/{r(1, 12):02d}/{r(1900, 2030)}", "date "), (f"{date}", "since "), (f"{r(1900, 1999)}-{r(2000, 2030)}", "years "),
        (f"{r(1, 9)}.{r(0, 20)}.{r(0, 99)}.{r(256, 9999)}{r(10, 99)}", "version "), (f"{n(7)}.{n(2)}", "$"), (f"{r(1, 999)},{n(3)},{n(3)}", "total "), (f"{r(1, 999)} {n(3)} {n(3)}", "price "),
        (f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", "isbn "), (f"{n(8)}", "order "), (f"{n(10)}", "item "), (f"{n(12)}", "serial "), (f"{n(9)}", "invoice "), (f"0.{n(16)}", "pi "), (f"{r(1, 90)}.{n(7)}", "latitude "),
        (f"{n(8)}-{n(4)}-4{n(3)}-8{n(3)}-{n(12)}", "uuid "), (f"{r(10**11, 10**13)}", "time "), (f"16{n(8)}", "timestamp "), (f"{n(4)}x{n(4)}", "size "), (f"{n(13)}f{n(5)}a{n(9)}", "hash "), (f"a{n(16)}c", "commit "),
        (f"{r(0, 23):02d}:{r(0, 59):02d}:{r(0, 59):02d}", "at "), ("aa:bb:cc:dd:ee", "key "), ("std::f", "call "), (f"user at {rng.choice(_HOSTS)} dot product", ""), (f"look at {rng.choice(_HOSTS)}. {rng.choice(('Then', 'We', 'So'))}", ""),
        (f"{rng.choice('ABFG')}{n(2)} {n(4)} {n(3)}", "part "), (f"RF{n(2)}{rng.choice('ABCD')}{n(4)}", "model "), (f"{n(3)}/{n(3)}/{n(2)}", "page "), (f"{r(1, 999)}+{n(7)}", "= "), (f"#{n(8)}", "ticket "), (f"{n(7)}", "sum "), (f"{n(24)}", "seed "),
        (f"{n(3)}.{n(3)}.{n(3)}", "rfc "), (f"{n(4)} {n(4)}", "table "), (f"@{rng.choice(_NAMES)} 2.0", ""),
    ))


def example(rng: random.Random, lines: list[str]) -> tuple[str, int, int, str | None]:
    """(text, start, end, kind or None for harmless): a form within a line of the corpus."""
    line = rng.choice(lines) if lines else ""
    words = line.split(" ")
    cut = rng.randint(0, len(words))
    left, right = " ".join(words[:cut]), " ".join(words[cut:])
    if rng.random() < 0.55:
        kind, form, cue = _personal(rng)
    else:
        kind, (form, cue) = None, _harmless(rng)
    if rng.random() < 0.4:
        cue = ""
    before = f"{left} {cue}" if left else cue
    after = rng.choice((" ", ". ", ", ", "! ", "")) + right if right else rng.choice(("", "."))
    if after[:1].isalnum():
        after = " " + after
    return before + form + after, len(before), len(before) + len(form), kind


def sample_lines(docs: DataFrame, text_col: str = "text", most: int = SAMPLE) -> list[str]:
    """At most ``most`` lines of up to 200 characters without digits or at signs, chosen by hash.

    The hash thins lines first, by a share that follows their number, so few are sorted.
    """
    lines = docs.select(F.explode(F.split(named(text_col), "\n")).alias("line")).where("length(line) BETWEEN 20 AND 200 AND NOT line RLIKE '[0-9@]'")
    mark = F.xxhash64("line")
    n = lines.count()
    if not n:
        return []
    share = min(1.0, 20 * most / n)
    thin = lines.where((mark >= F.lit(-(2**63)).cast("long")) & (mark <= F.lit(int(min(2**63 - 1, -(2**63) + share * 2**64))).cast("long")))
    return [r["line"] for r in thin.distinct().orderBy(mark, "line").limit(most).collect()]


def train(docs: DataFrame, text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """A model on examples within lines of docs."""
    return Model().fit(sample_lines(docs, text_col), examples)


# --- selection


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Accepted spans that touch neither a base span nor a likelier one."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], []
    for _, b in taken:  # base spans of different kinds may overlap: the furthest end so far
        ends.append(max(b, ends[-1] if ends else 0))
    free = [(a, b) for a, b in proposals(text) if not (i := bisect_left(starts, b)) or ends[i - 1] <= a]
    good = []
    for at in range(0, len(free), BLOCK):
        part = free[at : at + BLOCK]
        kind, chance = model.judge(np.array([features(text, a, b) for a, b in part], float))
        good += [(-float(c), a - b, a, int(k)) for k, c, (a, b) in zip(kind, chance, part, strict=True) if k >= 0]
    out: list[tuple[int, int, int]] = []
    begun: list[int] = []  # of what was accepted, in order
    stop: dict[int, int] = {}
    for _, size, a, k in sorted(good):
        b = a - size
        i = bisect_left(begun, b)
        if i and stop[begun[i - 1]] > a:
            continue
        begun.insert(i, a)
        stop[a] = b
        out.append((k, a, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal(spark: SparkSession, docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts and digest of base spans, all spans as text, and how many were added."""
    bounded_batches(spark)
    model = model or train(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                added = added_spans(text or "", base, model)
                out.append((*[sum(k == i for k, _, _ in base) for i in range(4)], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).mapInArrow(trimmed(run), FOUND)
    return rows.withColumnRenamed("id", id_col)


def redact(spark: SparkSession, docs: DataFrame, model: Model | None = None, text_col: str = "text", mark: str = "<%s>") -> DataFrame:
    """docs with every span replaced by its kind's mark; rows, columns and types stay, and a null text stays null."""
    bounded_batches(spark)
    model = model or train(docs, text_col)
    names, at = docs.columns, docs.columns.index(text_col)
    slots = [f"c{i}" for i in range(len(names))]  # whatever signs are in the names
    plain = docs.toDF(*slots)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, done = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in base + added_spans(text, base, model)):
            if a >= done:
                out += [text[done:a], mark % KINDS[k]]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=slots)

    return plain.mapInArrow(trimmed(run), plain.schema).toDF(*names)
