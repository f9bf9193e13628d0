"""SimHash fingerprints and near-duplicate classes by sharded BK-trees.

Fingerprints of distinct texts are compared, never rows. Two fingerprints at most RADIUS = 3
bits apart agree on at least one of four 16-bit blocks (up to six bits: on two of eight 8-bit
blocks, 28 masks), so every fingerprint enters one shard per mask, named by its masked bits,
and each shard gets a BK-tree (children keyed by integer Hamming distance to the parent). A
query follows only the edges whose key lies within the radius of its distance to the node.
Shards are co-located with their queries by that key instead of being broadcast: the trees
grow with the corpus, so no broadcast bound could be proven. A shard of more than HOT_SHARD
fingerprints is split again by radius + 1 blocks of the bits left, by the same argument, so
that hot shards are spread out and nothing is lost.

All trees of one task are built and searched together, level by level, in numpy. Each task
keeps only a forest of links (fingerprint -> representative of its local class); the forests
are joined into global classes by distributed label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, cut_lineage, heavy_keys, look_up, tidy

RADIUS = 3
HOT_SHARD = 4096
#: Fingerprints of whole shards gathered before their trees are built together.
FOREST_ROWS = 200_000
#: (query, node) pairs looked at in one numpy step.
FRONTIER = 1_000_000


def simhash(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint of the word shingles of a text, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        begin = (end - size)[: 1 - shingle].tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip(begin, end[shingle - 1 :].tolist(), strict=True)]
    return simhash_of(hashes)


def simhash_of(hashes) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.uint64)
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of docs(doc_id, text); a null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t.as_py() or b"", shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp bigint")


class Forest:
    """BK-trees of many shards: rows are sorted by shard, the first row of a shard is its root."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        roots = np.flatnonzero(first)
        self.fp, self.root = fp, np.repeat(roots, np.diff(np.append(roots, n)))
        rows = np.flatnonzero(~first)
        node = self.root[rows]
        keys, kids = [], []
        while len(rows):
            edge = node * 65 + np.bitwise_count(fp[rows] ^ fp[node])
            order = np.argsort(edge, kind="stable")
            rows, edge = rows[order], edge[order]
            lead = np.ones(len(edge), bool)
            lead[1:] = edge[1:] != edge[:-1]
            at = np.flatnonzero(lead)
            keys.append(edge[at])
            kids.append(rows[at])
            # the first row of each edge is the child; the others go on from there
            node = np.repeat(rows[at], np.diff(np.append(at, len(edge))))[~lead]
            rows = rows[~lead]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.kids = np.concatenate(kids) if kids else np.empty(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.kids = self.keys[order], self.kids[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different rows of a shard within the radius, in pieces of bounded size."""
        n = len(self.fp)
        todo = [(np.arange(a, min(a + FRONTIER, n)), self.root[a : a + FRONTIER]) for a in range(0, n, FRONTIER)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            hit = (far <= radius) & (query != node)
            yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0), "left")
            count = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), "right") - low
            # a dense node may have many children per query: cut so that a step stays bounded
            for a, b in _cuts(count, FRONTIER):
                c = count[a:b]
                total = int(c.sum())
                if total:
                    at = np.repeat(low[a:b] - (np.cumsum(c) - c), c) + np.arange(total)
                    todo.append((np.repeat(query[a:b], c), self.kids[at]))

    def classes(self, radius: int) -> np.ndarray:
        """For each row, the smallest row it is linked to, directly or not."""
        parent = np.arange(len(self.fp))

        def roots(x: np.ndarray) -> np.ndarray:
            x = parent[x]
            while not np.array_equal(up := parent[x], x):
                x = up
            return x

        for query, node in self.links(radius):
            a, b = roots(query), roots(node)
            low, high = np.minimum(a, b), np.maximum(a, b)
            keep = low != high
            pairs = np.unique(low[keep] * len(parent) + high[keep])
            for p in pairs.tolist():
                x, y = divmod(p, len(parent))
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
        return roots(np.arange(len(parent)))


def _cuts(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose counts sum to about most."""
    group = np.cumsum(count) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(count)], strict=True)


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            best = Forest(shard, fp.view(np.uint64)).classes(radius)
            linked = np.flatnonzero(best != np.arange(len(best)))
            return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[best[linked]])], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= FOREST_ROWS:
                shard, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if cut:
                    yield found(shard[:cut], fp[:cut])
                held, rows = [(shard[cut:], fp[cut:])], len(shard) - cut
        if rows:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _blocks(bits: list[int], n: int) -> list[int]:
    """The given bit positions in n masks of near equal size."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def _masks(radius: int) -> tuple[list[int], list[list[int]]]:
    """Bit masks such that fingerprints within the radius agree under at least one of them.

    Up to three differing bits leave one of four 16-bit blocks untouched; up to six leave two of
    eight 8-bit blocks. The second list refines each mask by radius + 1 blocks of the other bits,
    of which one is untouched too.
    """
    assert radius <= 6, "masks of 16 bits prove the search only up to six differing bits"
    n, agree = (4, 1) if radius <= 3 else (8, 2)
    masks = [sum(c) for c in combinations(_blocks(list(range(64)), n), agree)]
    return masks, [[m | x for x in _blocks([b for b in range(64) if not m >> b & 1], radius + 1)] for m in masks]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(fps: DataFrame, radius: int) -> DataFrame:
    """(u, v): a forest of links between distinct fingerprints, from all shards.

    A shard's key is a hash of the mask's number and the masked bits; should two shards share
    a key they only share a tree.
    """
    spark = fps.sparkSession
    masks, finer = _masks(radius)
    table = F.array(*(F.lit(_long(m)) for m in masks))
    refined = F.array(*(F.array(*(F.lit(_long(m)) for m in own)) for own in finer))
    shards = fps.select("fp", F.posexplode(table).alias("mask", "bits")).select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("bits"))).alias("key"))
    # masks x 2^16 keys exist at all, so the hot ones can be broadcast at any corpus size
    hot = F.broadcast(shards.groupBy("key").count().where(F.col("count") > HOT_SHARD).select("key"))
    cold = shards.join(hot, "key", "left_anti").select("key", "fp")
    again = shards.join(hot, "key", "left_semi").select("fp", "mask", F.posexplode(F.element_at(refined, F.col("mask") + 1)).alias("block", "bits"))
    split = again.select(F.xxhash64("mask", "block", F.col("fp").bitwiseAND(F.col("bits"))).alias("key"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cold.unionByName(split).repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(_search(radius)), "u bigint, v bigint").distinct()


def _propagate(links: DataFrame) -> DataFrame:
    """(fp, root): the smallest node reachable over the links, for every node in them.

    A round takes the least label of all neighbours, then that label's own label. Once neighbours
    lower no label any more, every class has a single one, which is its least node's.
    """
    edges = cut_lineage(links.select("u", "v").union(links.select("v", "u")).distinct())
    heavy = heavy_keys(edges, "v")
    label = cut_lineage(edges.groupBy(F.col("u").alias("fp")).agg(F.min("v").alias("near")).select("fp", F.least("fp", "near").alias("root")))
    while True:
        label = _jumped(label)
        near = look_up(edges, label.select(F.col("fp").alias("v"), "root"), "v", heavy=heavy).groupBy(F.col("u").alias("fp")).agg(F.min("root").alias("near"))
        met = cut_lineage(label.join(near, "fp", "left").select("fp", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        if met.where(F.col("was") != F.col("root")).isEmpty():
            return label
        label = met.select("fp", "root")


def _jumped(label: DataFrame) -> DataFrame:
    """label(fp, root), each root replaced by its own root."""
    own = label.select(F.col("fp").alias("root"), F.col("root").alias("up"))
    return cut_lineage(look_up(label, own, "root", outer=True).select("fp", F.least("root", "up").alias("root")))


def _tops(parents: DataFrame) -> DataFrame:
    """(fp, root): the top of every node of a forest given by parents(fp, root), where root < fp.

    Tops themselves have no row. Every pass halves what is left of the paths.
    """
    label = cut_lineage(parents)
    while not label.join(label.select(F.col("fp").alias("root")), "root", "left_semi").isEmpty():
        label = _jumped(label)
    return label


def simhash_components(docs: DataFrame, *, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and near-duplicate class of every row of docs(doc_id, text).

    Returns doc_id, fingerprint (16 hex digits), component_id: the smallest non-null doc_id
    of the class (null if the class has none). A null or empty text has fingerprint zero and
    is linked like any other. Repeated rows are kept and share their class; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, shingle))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = _propagate(_links(fps.select("fp"), radius))
    named = fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(look_up(named, least, "root").select("fp", "component_id"))
    return look_up(rows, classes, "fp").select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
