"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of consecutive documents inside one task. Its words are numbered by the
benchmark's vocabulary and only stretches that could hold a phrase go into the index: every
adjacent pair of a phrase is an adjacent pair of the benchmark, so a maximal stretch of such
pairs that is as long as the shortest phrase holds every occurrence, and nothing else is
dropped. The index is the Burrows-Wheeler transform of those stretches with a wavelet matrix
for ranks and a suffix-array sample. All phrases are searched backwards at once, occurrences
are located by walking to the next sampled suffix, and their word spans are merged.

Nothing is shuffled and no document leaves its task. The benchmark is read once, in blocks of
BLOCK_WINDOWS windows (a longer item is spread over blocks), each broadcast on its own. A task
searches a shard for one block after the other and holds one block at a time, so memory stays
bounded however large the benchmark is; a shard's text is bounded in words and bytes, and a
longer document is indexed in sections that overlap by a window.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, free_name, held_once, tidy

WINDOW = 10
BLOCK_WINDOWS = 200_000
SHARD_WORDS = 500_000
SHARD_BYTES = 4 << 20
SAMPLE = 8
#: Bytes of a text whose words are numbered at once.
PIECE = 1 << 20
#: Words are runs of anything but ASCII other than letters and digits; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PAIRS = 1 << 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def numbers_of(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words (0: not in the vocabulary), and a closing 0."""
    folded, parts, at = text.translate(_FOLD), [], 0
    while at < len(folded):
        to = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        to = len(folded) if to < 0 else to
        words = folded[at:to].split()
        parts.append(np.fromiter((vocabulary.get(w, 0) for w in words), np.int32, len(words)))
        at = to
    return np.concatenate([*parts, np.zeros(1, np.int32)])


@dataclass
class Phrases:
    """The windows of one benchmark block, numbered by its vocabulary (0: any other word)."""

    vocabulary: dict[bytes, int]
    names: list[str]  # item ids
    windows: list[np.ndarray]  # one matrix per window length
    owners: list[tuple[np.ndarray, np.ndarray]]  # for each matrix: (window, item) numbers, sorted by window
    shortest: int
    longest: int

    @classmethod
    def of(cls, rows: Iterable[tuple[str | None, list[bytes]]], window: int) -> Phrases:
        """rows: (item, words), the words of an item or of a part of one."""
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, words in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
            if len(ids):
                size = min(window, len(ids))
                own = -1 if item is None else names.setdefault(item, len(names))
                by_length.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), own))
        sizes, windows, owners = sorted(by_length), [], []
        for n in sizes:
            matrix, where = np.unique(np.vstack([m for m, _ in by_length[n]]), axis=0, return_inverse=True)
            item = np.concatenate([np.full(len(m), own, np.int64) for m, own in by_length[n]])
            known = item >= 0  # an item without an id counts, but is not listed
            both = np.unique(where.ravel()[known] * max(len(names), 1) + item[known])
            windows.append(matrix)
            owners.append((both // max(len(names), 1), both % max(len(names), 1)))
        return cls(vocabulary, list(names), windows, owners, sizes[0] if sizes else 0, sizes[-1] if sizes else 0)

    def pairs(self) -> np.ndarray:
        """Bitmap of the hashes of adjacent pairs; a false hit only enlarges the index."""
        out = np.zeros(_PAIRS, bool)
        for m in self.windows:
            if m.shape[1] > 1:
                out[_pair(m[:, :-1], m[:, 1:])] = True
        return out

    def items(self, which: int, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in window, item number) of every owner of the given windows of a matrix."""
        of, item = self.owners[which]
        low, high = np.searchsorted(of, window, "left"), np.searchsorted(of, window, "right")
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.repeat(np.arange(len(window)), count), item[at]


def blocks_of(rows: Iterable[tuple[str | None, bytes | None]], window: int, block_windows: int) -> Iterator[Phrases]:
    """The benchmark in blocks; an item with more windows goes to several, in parts that overlap by a window less a word."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for item, text in rows:
        words = words_of(text or b"")
        for at in range(0, max(1, len(words) - window + 1), block_windows):
            part = words[at : at + block_windows + window - 1]
            if size and size + len(part) > block_windows + window:
                yield Phrases.of(held, window)
                held, size = [], 0
            held.append((item, part))
            size += len(part)
    yield Phrases.of(held, window)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA6B) & (_PAIRS - 1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the end of the text sorts before any symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        k = key[order]
        fresh[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        if fresh[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = fresh, step * 2


class FmIndex:
    """Index of an integer text. The text gets an end symbol -1, the smallest of all."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        t = np.append(text.astype(np.int64) + 1, 0)
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.n = len(t)
        count = np.bincount(t)
        self.below = np.concatenate(([0], np.cumsum(count)))  # symbols smaller than c
        # wavelet matrix: per bit from the top, ranks of ones, and where the ones begin
        self.bits = max(1, int(t.max()).bit_length())
        self.ones, self.zeros = [], []
        row = bwt.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            one = (row >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(one))).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            row = np.concatenate((row[one == 0], row[one == 1]))
        self.marked = sa % sample == 0
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = sa[self.marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before a position."""
        begin = np.zeros_like(at)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbol >> b) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
        return at - begin

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[at + 1] - ones[at]
            out = out * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals of equally long phrases, one per row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j] + 1
            known = c < len(self.below) - 1
            c = np.where(known, c, 0)
            a = self.below[c] + self.rank(c, low[live])
            b = self.below[c] + self.rank(c, high[live])
            b = np.where(known, b, a)
            low[live], high[live] = a, np.maximum(a, b)
            live = live[b > a]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out = np.zeros_like(rows)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            done = self.marked[rows[todo]]
            at = todo[done]
            out[at] = self.samples[self.mark_rank[rows[at]]] + steps
            todo = todo[~done]
            c = self.symbol(rows[todo])
            rows[todo] = self.below[c] + self.rank(c, rows[todo])
            steps += 1
        return out


def find_phrases(ids: np.ndarray, phrases: Phrases, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(which matrix, window number, position) of every occurrence in one shard's word numbers.

    Documents are separated by a 0.
    """
    if not phrases.shortest or not len(ids):
        return
    known = ids > 0
    if phrases.shortest == 1:
        keep = known
    else:
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        joined[at] = pairs[_pair(ids[at], ids[at + 1])]
        # runs of joined pairs that are long enough for the shortest phrase
        edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= phrases.shortest - 1
        mark = np.zeros(len(ids) + 2, np.int64)
        mark[begin[long]] += 1
        mark[end[long] + 1] -= 1
        keep = np.cumsum(mark)[: len(ids)] > 0
    where = np.flatnonzero(keep)
    if not len(where):
        return
    # a 0 between stretches that do not touch
    gap = np.flatnonzero(np.diff(where) > 1) + 1
    text, place = np.insert(ids[where], gap, 0), np.insert(where, gap, -1)
    index = FmIndex(text)
    here = np.zeros(_PAIRS, bool)
    here[_pair(text[:-1], text[1:])] = True
    for k, windows in enumerate(phrases.windows):
        # a window with a pair that does not stand in the text cannot either
        near = np.flatnonzero(here[_pair(windows[:, :-1], windows[:, 1:])].all(axis=1))
        low, high = index.search(windows[near].astype(np.int64))
        count = high - low
        total = int(count.sum())
        if total:
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
            yield k, np.repeat(near, count), place[index.locate(rows)]


def _search(texts: list[bytes | None], phrases: Phrases, pairs: np.ndarray, hit: list[np.ndarray] | None, items: list[set[str]]) -> list[np.ndarray]:
    """For each text, which of its words stand in a window (added to hit); items gets the windows' items."""
    ids = [numbers_of(t or b"", phrases.vocabulary) for t in texts]
    size = np.array([len(x) for x in ids])
    begin = np.cumsum(size) - size
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    del ids
    edge = np.zeros(len(flat) + 1, np.int32)
    over = max(phrases.longest - 1, 0)
    for at in range(0, len(flat), SHARD_WORDS):
        for k, window, where in find_phrases(flat[at : at + SHARD_WORDS + over], phrases, pairs):
            np.add.at(edge, where + at, 1)
            np.add.at(edge, where + at + phrases.windows[k].shape[1], -1)
            doc = np.searchsorted(begin, where + at, "right") - 1
            met = np.unique(doc * len(phrases.windows[k]) + window)
            which, item = phrases.items(k, met % len(phrases.windows[k]))
            for d, i in zip((met[which] // len(phrases.windows[k])).tolist(), item.tolist()):
                items[d].add(phrases.names[i])
    mask = np.cumsum(edge[:-1]) > 0
    out = [mask[b : b + n - 1] for b, n in zip(begin.tolist(), size.tolist())]
    return out if hit is None else [a | b for a, b in zip(hit, out)]


def _scan(blocks: list, key: str, answer):
    """Search for every block in shards of the incoming rows; answer(batch, masks, items) makes the result of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(at: int) -> tuple:
            shared = blocks[at]
            got = held_once((key, at), lambda: (shared.value, shared.value.pairs()))
            shared.__dict__.pop("_value", None)  # the broadcast's own reference: one block at a time
            return got

        def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [t for batch in held for t in batch.column("text").to_pylist()]
            items: list[set[str]] = [set() for _ in texts]
            hit = None
            for block in range(len(blocks)):
                hit = _search(texts, *load(block), hit, items)
            at = 0
            for batch in held:
                yield answer(batch, hit[at : at + batch.num_rows], items[at : at + batch.num_rows])
                at += batch.num_rows

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= SHARD_BYTES:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return run
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words that are hit, as begin and end."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]  # folding keeps positions
    out, begin = [], 0
    for a, b in spans:
        out.append(text[begin : at[a][0]])
        begin = at[b - 1][1]
    return b"".join([*out, text[begin:]])


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> list:
    """Broadcasts of the benchmark's blocks; the driver holds one block and one partition of the benchmark at a time."""
    sc = benchmark.sparkSession.sparkContext
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    rows = ((r[0], bytes(r[1]) if r[1] is not None else None) for r in bench.toLocalIterator())
    return [sc.broadcast(p) for p in blocks_of(rows, window, block_windows)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Words of docs(doc_id, text) that stand in a window of benchmark(item_id, text).

    Returns doc_id, n_words, spans (array of word ranges begin..end) and items (array of the ids,
    as strings, whose windows occur). A window is `window` consecutive words of an item; a shorter
    item with words is one window. Null and word-free texts have no words and no hits. Items with
    a null id count as hits but are not listed; an id given twice is listed once. Documents of any
    length are searched whole. Repeated rows and null ids have results like any other; other
    columns are ignored; an empty table gives no rows, an empty benchmark no hits.
    """
    bounded_batches(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_windows)

    def answer(batch: pa.RecordBatch, masks: list[np.ndarray], items: list[set[str]]) -> pa.RecordBatch:
        cols = [
            batch.column("doc_id"),
            pa.array([len(m) for m in masks], pa.int64()),
            pa.array([[{"begin": a, "end": b} for a, b in spans_of(m)] for m in masks], SPANS),
            pa.array([sorted(s) for s in items], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, spans array<struct<begin bigint, end bigint>>, items array<string>"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_scan(blocks, uuid.uuid4().hex, answer)), schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return find_contamination(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with the contaminated spans cut out of text, and n_chars, if there is one, counted anew.

    Works row by row with the other columns alongside, so no join is needed and repeated ids stay
    apart. Texts without a hit are passed on unchanged, nulls included. An empty table gives no
    rows, an empty benchmark leaves all texts as they are; texts of any length are searched whole.
    """
    bounded_batches(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_windows)
    others = [c for c in docs.columns if c != "text"]
    row = free_name(docs.columns, "row")

    def answer(batch: pa.RecordBatch, masks: list[np.ndarray], items: list[set[str]]) -> pa.RecordBatch:
        clean = batch.column("text")
        if any(m.any() for m in masks):
            clean = pa.array([remove_spans(t, spans_of(m)) if t else t for t, m in zip(clean.to_pylist(), masks)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(row), clean], [row, "text"])

    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias(free_name(others, "pad"))).alias(row), F.col("text").cast("binary").alias("text"))
    found = carried.mapInArrow(tidy(_scan(blocks, uuid.uuid4().hex, answer)), carried.schema)
    clean = F.col("text").cast("string")
    new = {"text": clean.alias("text"), "n_chars": F.length(clean).cast("bigint").alias("n_chars")}
    return found.select(*(new.get(c, F.col(f"`{row}`").getField(c).alias(c)) for c in docs.columns))
