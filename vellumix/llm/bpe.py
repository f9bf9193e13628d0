"""Byte-level BPE: encode whole texts by merge ranks and decode ids back to bytes.

Pre-tokens are merged with a hierarchical-bitmap rank queue. One bucket per merge rank
holds the linked-list positions whose pair has that rank; two levels of 256-bit words
mark non-empty buckets, so find-first-set at each level yields the lowest rank in constant
time (vocabularies of up to 65,536 ids; more only widens the top word). A merge changes at most two neighbouring pairs; entries they leave behind are skipped
when popped because the position's current rank differs. The cost is linear in the pre-token
length, so a megabyte without a break is fine.

Pre-tokens that are not known yet lie side by side in one linked list (GROUP bytes of them, or one
longer one), with no pair across their borders. They are independent, so one queue serves
all, and a step that finds the lowest rank is shared by every pre-token that has it: of pre-tokens up to
SHORT bytes it takes the whole bucket as arrays, of longer ones a position at a time.

Nulls encode as the empty text; invalid UTF-8 is replaced before encoding. Empty texts have no
ids, texts of any length are encoded whole, an empty table gives no rows. Repeated rows
give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from array import array
from collections.abc import Iterable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, held_once, tidy

BIT = [1 << i for i in range(256)]
#: Bytes of results that a worker keeps for words and for pre-tokens each (keys, values and table together, about).
KEPT_BYTES = 128 << 20
ENTRY_BYTES = 240
LONGEST_KEPT = 64
#: Bytes of a pre-token up to which its merges are made together with those of others.
SHORT = 256
#: Bytes of new pre-tokens that share one queue.
GROUP = 1 << 18
#: Characters of texts (or one longer text) that are encoded at once.
TEXT_CHARS = 1 << 21
#: Fixed value: the pattern of which it is known that no match runs from a non-space into a space.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Min-queue of (rank, positions): a two-level bitmap of 256-bit words over one bucket per rank.

    ``ByteBpe.merge`` is its one user and works on the fields directly, as a Python call for
    each of its steps would cost more than the step.
    """

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // 256 + 1)
        self.top = 0
        self.buckets: dict[int, np.ndarray | list[int]] = {}

    def fill(self, rank: np.ndarray) -> None:
        """Enter every position with a rank; each bucket is in descending order."""
        at = np.flatnonzero(rank >= 0)[::-1]
        at = at[np.argsort(rank[at], kind="stable")]
        edge = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, edge) if len(at) else ():
            r = int(rank[part[0]])
            self.buckets[r] = part
            self.words[r >> 8] |= BIT[r & 255]
            self.top |= 1 << (r >> 8)


class PairRanks:
    """Ranks of pairs of symbols for whole arrays: the sparse matrix of pairs with its rows laid into each other."""

    def __init__(self, ranks: dict[bytes, int], symbols: dict[bytes, int], width: int):
        rows: dict[int, dict[int, int]] = {}
        get = symbols.get
        for whole, rank in ranks.items():
            for k in range(1, len(whole)):
                if (a := get(whole[:k])) is not None and (b := get(whole[k:])) is not None:
                    rows.setdefault(a, {})[b] = rank
        room = 8 * sum(map(len, rows.values())) + 1
        self.start = np.zeros(width, np.int64)
        self.owner, self.ranks = np.full(room + width, -1, np.int32), np.full(room + width, -1, np.int32)
        taken = bytearray(room + width)
        rng = random.Random(0)
        for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            # an eighth of the places is taken at most, and long rows go first
            at = rng.randrange(room)
            while any(taken[at + b] for b in row):
                at = rng.randrange(room)
            self.start[a] = at
            for b, rank in row.items():
                taken[at + b] = 1
                self.owner[at + b] = a
                self.ranks[at + b] = rank

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        place = self.start[left]
        place += right
        return np.where(self.owner[place] == left, self.ranks[place], -1)


class ByteBpe:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept_bytes: int = KEPT_BYTES):
        self.most = kept_bytes // ENTRY_BYTES
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.can_cut = pattern == SPLIT_PATTERN
        self.near_space = re.compile(r" \s|\s ").search
        self.lone_space = re.compile(r"(?<!\s) (?!\s)").split
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.vocab[v] = k
        self.queue = RankQueue(len(self.vocab))
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # a byte without a rank has a symbol of its own, so that pairs with it can be looked up
        self.symbol = np.where(self.single < 0, np.arange(256) + len(self.vocab), self.single)
        self.border = len(self.vocab) + 256  # the symbol between pre-tokens
        self.pair_ranks = PairRanks(ranks, {**{bytes([b]): int(v) for b, v in enumerate(self.symbol)}, **ranks}, self.border + 1)
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.words: dict[str, bytes] = {}  # ids of a word behind a space
        self.tokens: dict[str, bytes] = {}  # ids of a pre-token

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, as little-endian unsigned 32-bit integers."""
        short = [p for p in pieces if len(p) <= SHORT]
        if len(short) == len(pieces):
            return self._merge_short(short)
        some, others = iter(self._merge_short(short)), iter(self._merge_long([p for p in pieces if len(p) > SHORT]))
        return [next(some if len(p) <= SHORT else others) for p in pieces]

    def _merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """As merge, for many short pre-tokens: a step takes the lowest rank's whole bucket at once.

        Of each pre-token it takes the first position and leaves the others in the bucket. So every
        pre-token has its merges in their order, also if one of them opens a lower rank or its own again.
        """
        data = b"".join(pieces)
        n = len(data)
        if not n:
            return [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.double[raw[:-1] << 8 | raw[1:]]
        pair[end[end > 0] - 1] = -1
        # a border before each pre-token and behind the last one, so that every byte has neighbours
        own = np.repeat(np.arange(len(pieces)), size + 1)
        byte = np.arange(n) + np.repeat(np.arange(1, len(pieces) + 1), size)
        n += len(pieces) + 1
        ids, now = np.full(n, self.border, np.int64), np.full(n, -1, np.int64)
        ids[byte], now[byte] = self.symbol[raw], pair
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        queue, ranks, bit = self.queue, self.pair_ranks, BIT
        queue.fill(now)
        words, buckets, top = queue.words, queue.buckets, queue.top
        later: dict[int, list[int]] = {}  # positions entered since, by rank
        while top:
            # find first set: the lowest rank with a non-empty bucket
            high = top & -top
            a = high.bit_length() - 1
            word = words[a]
            low = word & -word
            rank = (a << 8) + low.bit_length() - 1
            at = buckets.pop(rank, None)
            if (more := later.pop(rank, None)) is not None:
                more = np.array(more)
                at = more if at is None else np.concatenate((at, more))
            at = at[now[at] == rank]  # the others are stale
            waiting = 0
            if len(at) > 1:
                at.sort()
                of = own[at]
                again = of[1:] == of[:-1]
                if waiting := np.count_nonzero(again):
                    buckets[rank] = at[1:][again]
                    at = np.concatenate((at[:1], at[1:][~again]))
            if not waiting:
                words[a] ^= low
                if not words[a]:
                    top ^= high
                if not len(at):
                    continue
            gap = nxt[at]
            to = nxt[gap]
            nxt[at] = to
            prv[to] = at
            now[gap] = -2
            ids[at] = rank
            start = np.concatenate((prv[at], at))
            new = ranks(ids[start], ids[nxt[start]])
            now[start] = new
            ranked = new >= 0
            for i, r in zip(start[ranked].tolist(), new[ranked].tolist()):
                if (b := later.get(r)) is None:
                    later[r] = [i]
                    words[r >> 8] |= bit[r & 255]
                    top |= 1 << (r >> 8)
                else:
                    b.append(i)
        queue.top = 0
        left = byte[now[byte] > -2]
        ids = ids[left]
        out = np.where(ids < len(self.vocab), ids, -1).astype("<u4").tobytes()
        cut = (4 * np.searchsorted(left, end + np.arange(1, len(pieces) + 1))).tolist()
        return [out[x:y] for x, y in zip([0, *cut], cut)]

    def _merge_long(self, pieces: list[bytes]) -> list[bytes]:
        """As merge, one position after another, as a long pre-token may have thousands of one rank."""
        data = b"".join(pieces)
        n = len(data)
        if not n:
            return [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        pair = np.full(n + 1, -1, np.int64)
        pair[: n - 1] = self.double[raw[:-1] << 8 | raw[1:]]
        pair[end[end > 0] - 1] = -1
        first = np.zeros(n + 1, np.uint8)  # where a pre-token starts, and the end
        first[end] = 1
        first[0] = 1
        queue, get, bit = self.queue, self.ranks.get, BIT
        queue.fill(pair)
        for r, part in queue.buckets.items():
            queue.buckets[r] = part.tolist()
        words, buckets, top = queue.words, queue.buckets, queue.top
        # boxed numbers are quicker, but too large for a pre-token of many megabytes
        held = list if n < 4 * GROUP else lambda x: array("q", x)
        now, first = held(pair.tolist()) if held is list else array("q", pair.tobytes()), first.tobytes()
        nxt, prv = held(range(1, n + 2)), held(range(-1, n))
        ids = self.single[raw]
        ids = ids.tolist() if held is list else array("q", ids.tobytes())
        gone = bytearray(n)
        late: set[int] = set()  # ranks that got a position out of order
        while top:
            # find first set: the lowest rank with a non-empty bucket
            high = top & -top
            a = high.bit_length() - 1
            word = words[a]
            low = word & -word
            rank = (a << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if rank in late:
                late.discard(rank)
                bucket.sort(reverse=True)
            while bucket:
                i = bucket.pop()
                if now[i] != rank:  # stale
                    continue
                lower = False
                j = nxt[i]
                nxt[i] = k = nxt[j]
                prv[k] = i
                now[j] = -1
                gone[j] = 1
                ids[i] = rank
                r = None if first[k] else get(data[i : nxt[k]])
                if r is None:
                    now[i] = -1
                else:
                    now[i] = r
                    if (b := buckets.get(r)) is None:
                        buckets[r] = [i]
                        words[r >> 8] |= bit[r & 255]
                        top |= 1 << (r >> 8)
                    else:
                        b.append(i)
                        if r != rank:
                            late.add(r)
                    lower = r < rank
                if not first[i]:
                    p = prv[i]
                    r = get(data[p:k])
                    if r is None:
                        now[p] = -1
                    else:
                        now[p] = r
                        if (b := buckets.get(r)) is None:
                            buckets[r] = [p]
                            words[r >> 8] |= bit[r & 255]
                            top |= 1 << (r >> 8)
                        else:
                            b.append(p)
                            if r != rank:
                                late.add(r)
                        lower = lower or r < rank
                if lower:  # what is left of this rank waits
                    break
            if not bucket:
                del buckets[rank]
                words[a] ^= low
                if not words[a]:
                    top ^= high
        queue.top = 0
        alive = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
        out = np.array(ids, np.int64)[alive].astype("<u4").tobytes()
        cut = (4 * np.searchsorted(alive, end)).tolist()
        return [out[x:y] for x, y in zip([0, *cut], cut)]

    def _learn(self, known: dict[str, bytes], tokens: Iterable[str], lead: bytes) -> None:
        """Enter the ids of the pre-tokens lead + token that known does not have yet."""
        ranks = self.ranks
        names, group, size = [], [], 0
        for token in tokens:
            raw = lead + token.encode()
            if (whole := ranks.get(raw)) is not None:
                known[token] = whole.to_bytes(4, "little")
                continue
            names.append(token)
            group.append(raw)
            size += len(raw)
            if size >= GROUP:
                known.update(zip(names, self.merge(group)))
                names, group, size = [], [], 0
        known.update(zip(names, self.merge(group)))

    def _cut(self, text: str) -> list[str] | None:
        """The text cut at spaces that stand alone between other characters; None if it can't be."""
        if not self.can_cut:
            return None
        if self.near_space(text) or text[:1] == " " or text[-1:] == " ":
            return self.lone_space(text)
        return text.split(" ")

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, some texts at a time."""
        at = size = 0
        for to, text in enumerate(texts, 1):
            size += len(text)
            if size >= TEXT_CHARS or to == len(texts):
                yield from self._encode(texts[at:to])
                at, size = to, 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers.

        No match of SPLIT_PATTERN runs from a non-space into a space, so a text is cut before
        each space that stands alone and each word behind one looked up whole; a word of letters
        is one pre-token with its space, and the ASCII punctuation behind it another. With any other pattern, texts are matched in one go.
        """
        words, tokens, find = self.words, self.tokens, self.find
        cut = [self._cut(t) for t in texts]
        heads = [find(t if c is None else c.pop(0)) for t, c in zip(texts, cut)]
        seen: set[str] = set().union(*(c for c in cut if c))
        letters, found = set(), {}
        for w in seen.difference(words):
            if w.isalpha():
                letters.add(w)
            elif (core := w.rstrip(punctuation)).isalpha():
                found[w] = (" " + core, w[len(core) :])
            else:
                found[w] = find(" " + w)
        other = set()
        for own in found.values():
            if own[0][0] == " " and len(own[0]) > 1:
                letters.add(own[0][1:])
                other.update(own[1:])
            else:
                other.update(own)
        for own in heads:
            other.update(own)
        self._learn(words, letters.difference(words), b" ")
        self._learn(tokens, other.difference(tokens), b"")
        for w, own in found.items():
            if own[0][0] == " " and len(own[0]) > 1:
                words[w] = b"".join([words[own[0][1:]], *map(tokens.__getitem__, own[1:])])
            else:
                words[w] = b"".join(map(tokens.__getitem__, own))
        out = [b"".join([*map(tokens.__getitem__, h), *map(words.__getitem__, c or ())]) for h, c in zip(heads, cut)]
        self._shrink(seen | letters, other)
        return out

    def _shrink(self, seen: set[str], other: set[str]) -> None:
        """Keep the tables within their bytes: what was not met just now goes first, and long keys always."""
        for table, met in ((self.words, seen), (self.tokens, other)):
            for long in [w for w in met if len(w) > LONGEST_KEPT]:
                table.pop(long, None)
            if len(table) > self.most:
                left = {w: table[w] for w in met if w in table} if len(met) < self.most // 2 else {}
                table.clear()
                table.update(left)

    def encode(self, text: str) -> bytes:
        return self._encode([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, array("I", ids)))


def bpe_roundtrip(docs: DataFrame, vocabulary: str, pattern: str, *, with_ids: bool = False, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """Encode and decode every text of docs(doc_id, text).

    vocabulary is a rank file on the driver; it has a fixed size (under 1 MB) and is broadcast.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids
    (array<int>). One pass without a shuffle. kept_bytes bounds each of a worker's two tables of
    known words; it changes the time, not the result.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))
    name = (vocabulary, pattern, kept_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_once(name, lambda: ByteBpe(shared.value, pattern, kept_bytes))
        sha = hashlib.sha256
        for batch in batches:
            counts, digests, decoded, ids = [], [], [], []
            for got in codec.encode_all([raw.decode("utf-8", "replace") if raw else "" for raw in batch.column(1).to_pylist()]):
                counts.append(len(got) // 4)
                digests.append(sha(got).hexdigest())
                decoded.append(sha(codec.decode(got)).hexdigest())
                if with_ids:
                    ids.append(list(array("I", got)))
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), schema)
