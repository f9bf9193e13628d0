"""Toxicity scoring behind a noisy-channel deobfuscator.

Every token that can be read in more than one way (with symbols, digits, doubled or accented
letters in it), and every run of single characters set apart by spaces, becomes a character
lattice: every observed character may stand for a letter at a channel cost, or for nothing, and a
space between characters may end a word. A Viterbi search under a character trigram model finds the
likeliest reading, which joins the text's tokens. The score is a logistic model over the tokens and
token beginnings that mark toxic text.

The character model counts every word of the corpus into 28^3 cells, so what is collected has
a fixed size. Features and weights are fitted on about SAMPLE_ROWS labelled documents at most
(a documented bound, chosen by a hash of the id). Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, held_once, held_out, labelled_sample, tidy

SAMPLE_ROWS = 6000
FEATURES = 512
LEAST_DOCS = 5
PREFIXES = (4, 5, 6, 7)
KEPT = 200_000
#: Back-pointers are kept for so many characters of a token, and found again from a checkpoint before that.
SEGMENT = 512
#: Bytes counted at once.
PIECE = 1 << 19

#: Letters that a symbol or digit is commonly written for, and their channel costs.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = ".-_~'`^,:;/\\=\"​‌‍­﻿"
WILD = "*#%&?"
LETTER, LOOKS_LIKE, DROPPED, UNKNOWN, REPEATED, DOUBLED, PADDING, WORD_END = 0.0, 1.5, 0.7, 4.0, 0.7, 4.0, 9.0, 3.0

SYMBOLS = 28  # word edge, a-z, any other letter
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S(?!\S)){2,}")
_DOUBLED = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1\1+")
_QUOTES = ".,;:?\"'()[]{}"
_EDGES = ".,;:!?\"'()[]{}<>*#%&$|~`-_=+/\\"

def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else SYMBOLS - 1


# by byte: letters of ASCII in lower case 1 to 26, first bytes beyond ASCII the last symbol, all else an edge
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[0xC0:] = SYMBOLS - 1


def cells_of(data: np.ndarray) -> np.ndarray:
    """Trigram cells of the letter runs in bytes; a run starts after two edges, however near the one before is."""
    s = _CODE[data[(data & 0xC0) != 0x80]]
    a, b, c = s[:-2], s[1:-1], s[2:]
    return (np.where(b == 0, 0, a) * SYMBOLS + b) * SYMBOLS + c


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the letter runs of every text of docs(text): SYMBOLS^3 cells."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data = np.frombuffer(b"  " + b" ".join(t.as_py() or b"" for t in batch.column(0)) + b" ", np.uint8)
            for at in range(0, len(data) - 2, PIECE):
                total += np.bincount(cells_of(data[at : at + PIECE + 2]), minlength=SYMBOLS**3)
        total[0] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "cell bigint, n bigint")
    table = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def letter_costs(counts: np.ndarray) -> list:
    """-log p(c | a, b), interpolated with the shorter contexts."""
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (counts + 10 * p2) / (counts.sum(axis=2, keepdims=True) + 10)
    return (-np.log(p3)).tolist()


def _options(c: str, again: bool, run: bool) -> list[tuple[str, int, float]]:
    return [(x, symbol(x) if x not in ("", " ") else 0, cost) for x, cost in _letters(c, again, run)]


def _letters(c: str, again: bool, run: bool) -> list[tuple[str, float]]:
    """What a character may stand for; again: it repeats the one before, run: it is one of three or more."""
    if c.isalpha():
        base = unicodedata.normalize("NFKD", c)[:1]
        options = [(c, LETTER)] + ([(base, LOOKS_LIKE / 2)] if base != c and base.isalpha() else [])
        return options + ([("", REPEATED if run else DOUBLED)] if again else [])
    if c in LEET:
        return [(x, LOOKS_LIKE) for x in LEET[c]] + [("", REPEATED if run and again else PADDING)]
    if c in WILD:
        return [(x, UNKNOWN) for x in "abcdefghijklmnopqrstuvwxyz"] + [("", LOOKS_LIKE)]
    if c.isspace():
        return [("", DROPPED), (" ", WORD_END)]
    return [("", DROPPED if c in SEPARATORS else LOOKS_LIKE)]


_made: dict[tuple[str, bool, int], list[tuple[str, int, float]]] = {}


def lattice(token: str) -> list[list[tuple[str, int, float]]]:
    """For each character the letters it may stand for, with symbols and costs; '' means it is dropped, ' ' that a word ends."""
    token = token.lower()
    runs = bytearray(len(token))
    for m in _RUN.finditer(token):
        runs[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    if len(_made) > 10_000:
        _made.clear()
    out, before = [], ""
    for c, run in zip(token, runs):
        key = (c, c == before, run)
        if (o := _made.get(key)) is None:
            o = _made[key] = _options(c, c == before, bool(run))
        out.append(o)
        before = c
    return out


class Letters:
    """The character model: costs of a symbol after two others, and the least cost of a symbol anywhere."""

    def __init__(self, costs: list):
        self.costs = costs
        self.least = np.array(costs).min(axis=(0, 1)).tolist()


def _bounds(options: list, model: Letters) -> list[float]:
    """What a state after each character may cost at most to be part of the best reading."""
    costs, least = model.costs, model.least
    rest = [least[0]] * (len(options) + 1)
    low = {id(o): min(cost + (least[k] if x and x != " " else 0.0) for x, k, cost in o) for o in options}
    for i in range(len(options) - 1, -1, -1):
        rest[i] = rest[i + 1] + low[id(options[i])]

    def cost_of(dropping: bool) -> float:
        a = b = 0
        total = 0.0
        for o in options:
            x, k, cost = next((y for y in o if not y[0]), o[0]) if dropping and o[0][2] != LETTER else o[0]
            total += cost
            if x == " ":
                total, a, b = total + (costs[a][b][0] if a or b else 0.0), 0, 0
            elif x:
                total, a, b = total + costs[a][b][k], b, k
        return total + costs[a][b][0]

    known = min(cost_of(False), cost_of(True)) + 1e-6
    return [known - r for r in rest[1:]]


def decode(token: str, model: Letters) -> str:
    """Likeliest reading of a token: Viterbi over (last two symbols) states of its lattice.

    Readings that end in the same two symbols merge, as the rest costs them the same. A state is
    left out only if its cost and the least that the rest can cost pass the cost of a reading
    already known (every character for its first letter, or only the letters), so the result is
    the best reading. Back-pointers are held for SEGMENT characters at a time: the costs at
    the begin of every segment are kept, and the pointers found again from there, last segment first.
    """
    options, costs, n = lattice(token), model.costs, len(token)
    most = [math.inf] * n
    if any(len(o) > 4 for o in options):  # a wild character: the bound pays
        most = _bounds(options, model)

    def forward(states: dict, begin: int, steps: list) -> dict:
        for i in range(begin, min(begin + SEGMENT, n)):
            best: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            limit = most[i]
            for state, cost in states.items():
                a, b = state
                after = costs[a][b]
                for letter, k, channel in options[i]:
                    if not letter:
                        new, total = state, cost + channel
                    elif letter == " ":
                        new, total = (0, 0), cost + channel + (after[0] if a or b else 0.0)
                    else:
                        new, total = (b, k), cost + channel + after[k]
                    if total <= limit and total < best.get(new, math.inf):
                        best[new] = total
                        came[new] = (state, letter)
            states = best
            steps.append(came)
        return states

    marks, states, steps = [], {(0, 0): 0.0}, []
    begins = range(0, n, SEGMENT)
    for begin in begins:
        marks.append(states)
        steps = []
        states = forward(states, begin, steps)
    state = min(states, key=lambda s: (states[s] + costs[s[0]][s[1]][0], s))
    back: list[str] = []
    for k in range(len(marks) - 1, -1, -1):
        if k < len(marks) - 1:
            steps = []
            forward(marks[k], begins[k], steps)
        for came in reversed(steps):
            state, letter = came[state]
            back.append(letter)
    return "".join(reversed(back))


class Reader:
    """Tokens of texts with their restored readings, and the features of each."""

    def __init__(self, costs: list, chosen: dict[str, int] | None = None):
        self.letters, self.chosen = Letters(costs), chosen
        self.kept: dict[str, list] = {}
        #: A word with another beginning than any chosen feature has none of them.
        self.heads = None if chosen is None else {x[:3] for x in chosen}

    def restored(self, token: str) -> list[str]:
        """The token without its edges, and the words of its likeliest reading.

        Letters of ASCII of which none is doubled can only be read as they stand, and what has
        neither a letter nor a character that is written for one holds no word.
        """
        core = token.strip(_QUOTES).rstrip("!").strip(_QUOTES).lower()
        if core.isascii() and core.isalpha() and not _DOUBLED.search(core):
            return [core]
        plain = token.strip(_EDGES).lower()
        out = [plain] if plain else []
        if any(c.isalpha() or c in LEET for c in core):
            out += [x for x in decode(core, self.letters).split() if x != plain]
        return out

    def features(self, token: str) -> list:
        """Names of a token's features, or the indexes of the chosen ones; kept for tokens of up to 64 characters."""
        words, heads = self.restored(token), self.heads
        if heads is not None:
            words = [w for w in words if w[:3] in heads]
        got: list = []
        if words:
            names = []
            for word in words:
                names.append(word)
                names += [word[:n] + "…" for n in PREFIXES if len(word) > n]
            names = list(dict.fromkeys(names))
            got = names if self.chosen is None else [self.chosen[x] for x in names if x in self.chosen]
        if len(token) <= 64:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[token] = got
        return got

    def count(self, text: str) -> Counter:
        """Features of a whole text and how often they stand in it."""
        out: Counter = Counter()
        get = self.kept.get
        for token, n in Counter(text.split()).items():
            if (got := get(token)) is None:
                got = self.features(token)
            for f in got:
                out[f] += n
        for m in _SPACED.finditer(text):
            for f in self.features(m.group(0)):
                out[f] += 1
        return out

    def vector(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.chosen or {}))
        for f, n in self.count(text).items():
            out[f] = n
        return np.log1p(out)


def _features_by_label(rows: DataFrame, costs: list) -> DataFrame:
    """(feature, d1, d0): in how many toxic and other sample documents each feature stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs)
        sums = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[int(y > 0)].update(reader.count((text.as_py() or b"").decode("utf-8", "replace")).keys())
        # a feature of other documents alone can't be chosen; its count matters only beside a toxic one elsewhere
        names = list(sums[0].keys() | sums[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([sums[1][x] for x in part], pa.int64()), pa.array([sums[0][x] for x in part], pa.int64())], ["feature", "d1", "d0"]
            )

    return rows.mapInArrow(tidy(run), "feature string, d1 bigint, d0 bigint").groupBy("feature").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))


def choose_features(rows: DataFrame, costs: list, n1: int, n0: int) -> list[str]:
    """The FEATURES likeliest marks of toxic text, by the log-likelihood ratio of their document counts."""
    total = F.col("d1") + F.col("d0")

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen * (n1 + n0) / (total * of))).otherwise(0.0)

    counted = _features_by_label(rows, costs).where((F.col("d1") >= LEAST_DOCS) & (F.col("d1") * n0 > F.col("d0") * n1))
    ranked = counted.withColumn("g", part(F.col("d1"), n1) + part(F.col("d0"), n0)).where(F.col("g") > 6)
    return [r.feature for r in ranked.orderBy(F.desc("g"), "feature").limit(FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame, *, mod: int = 4, rem: int = 2, sample_rows: int = SAMPLE_ROWS) -> tuple:
    """(letter costs, chosen features, weights, intercept).

    Without labelled rows outside the held-out fold, or with one label only, every text scores
    that label's smoothed rate.
    """
    bounded_batches(docs.sparkSession)
    costs = letter_costs(letter_counts(docs))
    rows = labelled_sample(docs, labels, "toxic", mod, rem, sample_rows).select(F.col("text").cast("binary").alias("text"), "y")
    tally = {int(r.y > 0): r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = tally.get(1, 0), tally.get(0, 0)
    rate = math.log((n1 + 1) / (n0 + 1))
    if not n1 or not n0:
        return costs, [], np.zeros(0), rate
    chosen = choose_features(rows, costs, n1, n0)
    index = {x: i for i, x in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs, index)
        for batch in batches:
            x = [reader.vector((t.as_py() or b"").decode("utf-8", "replace")).astype(np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.binary())], ["y", "x"])

    got = rows.mapInArrow(tidy(run), "y int, x binary").toArrow()
    pairs = sorted(zip((int(v > 0) for v in got.column(0).to_pylist()), (b.as_py() for b in got.column(1)), strict=True))
    y = np.array([p[0] for p in pairs], float)
    x = np.array([np.frombuffer(p[1], np.float32) for p in pairs], float).reshape(len(y), len(chosen))
    return costs, chosen, *_logistic_fit(x, y, rate)


def _logistic_fit(x: np.ndarray, y: np.ndarray, start: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam with non-negative weights: a mark never speaks for a text."""
    theta = np.append(np.zeros(x.shape[1]), start)
    x = np.column_stack([x, np.ones(len(y))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    ridge = np.append(np.full(x.shape[1] - 1, 2e-4), 0.0)
    for step in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (y - p) / len(y) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0.0)
    return theta[:-1], float(theta[-1])


def toxicity_of(spark, model: tuple):
    """A Column function: text -> probability that the text is toxic."""
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    bounded_batches(spark)

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        def load() -> tuple:
            costs, chosen, weights, bias = shared.value
            return Reader(costs, {x: i for i, x in enumerate(chosen)}), weights.tolist(), bias

        reader, weights, bias = held_once(key, load)
        out = []
        for t in text.to_pylist():
            z = bias
            if t and weights:
                z += sum(weights[f] * math.log1p(n) for f, n in reader.count(t.decode("utf-8", "replace")).items())
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.array(out, pa.float64())

    return lambda text: rate(text.cast("binary"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every row of docs(doc_id, text), learnt from labels(doc_id, toxic).

    Returns doc_id, held_out, score and predicted (1 if score >= 0.3). A null or empty text
    scores the model's base rate. Repeated rows give repeated results; other columns are ignored.
    """
    score = toxicity_of(docs.sparkSession, fit(docs, labels))
    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
