"""Near-duplicate classes by exact Jaccard similarity of word shingles.

Two texts are linked if their sets of shingle hashes have a Jaccard similarity of LEAST or more;
classes are the connected components. Every link is verified on the whole sets. Candidates are the
pairs that operator 7's BK-trees find within RADIUS bits of their SimHashes (of the same shingles),
and, as texts at a similarity of 0.8 mostly differ in more bits than any tree can search, the
buckets of MinHash: a text enters one bucket for each of BANDS bands of BAND_ROWS minima, and only
texts that share a bucket are compared. A pair at similarity s shares none with probability
(1 - s^BAND_ROWS)^BANDS, which is 5e-7 at 0.8 and less above.

Distinct texts are compared, never rows. In each bucket the text with the least number is compared
with all others first; of what is left, only pairs that are in different classes so far are
compared. Of these, a pair is left out if its parity sketches prove it too unlike: a sketch has the
parity of the shingles that hash to each of PARITY_BITS bits, so two sketches never differ in more
bits than their sets do in shingles. A bucket's pairs are looked at in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, cut_lineage, free_name, look_up, tidy
from .simhash import RADIUS, _links, _propagate, _tops, simhash_of

SHINGLE = 5
#: Least Jaccard similarity of linked texts, as a fraction.
LEAST = (4, 5)
BANDS, BAND_ROWS = 48, 6
PARITY_BITS = 512
#: Shingles whose minima are taken in one numpy step.
STEP = 512
#: Up to so many texts are looked up by broadcast.
MOST_BROADCAST = 200_000
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None]
_TIMES = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None] | np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def key_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(width + 1) - 1
    size = min(size, len(words))
    begin = (end - width)[: len(words) - size + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(begin, end[size - 1 :].tolist(), strict=True)], np.uint64))


def buckets(hashes: np.ndarray) -> list[int]:
    """Bucket of each band as a signed number; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[None, at : at + STEP] ^ _XOR) * _TIMES).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def parity(hashes: np.ndarray) -> bytes:
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n, fp, buckets) of every row: n distinct shingles, fp their SimHash, key the digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, fps, found = [], [], [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                hashes = shingles(words, size)
                keys.append(key_of(words))
                n.append(len(hashes))
                fps.append(simhash_of(hashes))
                found.append(buckets(hashes))
            arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n", "fp", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, key binary, n bigint, fp bigint, buckets array<bigint>")


def _key(text):
    @F.arrow_udf("binary")
    def key(text: pa.Array) -> pa.Array:
        return pa.array([key_of(words_of(t)) for t in text.to_pylist()], pa.binary())

    return key(text.cast("binary"))


def _array(column: pa.Array) -> np.ndarray:
    """The column's values; parity sketches as rows of words."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)
    return column.to_numpy()


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, from batches sorted by their first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        part = [_array(c) for c in batch.columns]
        if not len(part[0]):
            continue
        held.append(part)
        if held[0][0][0] == part[0][-1]:
            continue  # a single bucket so far
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        yield [c[:cut] for c in columns]
        held = [[c[cut:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with two texts or more."""
    for bucket, node, n in _by_bucket(batches):
        same = bucket[1:] == bucket[:-1]
        keep = np.append(same, False) | np.append(False, same)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (bucket, node, n)], ["bucket", "id", "n"])


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of a bucket in different classes (root_u, root_v) that may be alike, but for those with the first text."""
    up, down = LEAST
    for bucket, node, n, root, odd in _by_bucket(batches):
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        found, rows = [], 0
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            for i in range(a + 1, b - 1):
                m = n[i + 1 : b]
                fits = i + 1 + np.flatnonzero((root[i + 1 : b] != root[i]) & (m * down >= n[i] * up) & (n[i] * down >= m * up))
                # similarity up/down leaves (down - up) / (down + up) of both sizes together to differ
                apart = np.bitwise_count(odd[fits] ^ odd[i]).sum(axis=1, dtype=np.int64)
                v = fits[apart * (down + up) <= (n[fits] + n[i]) * (down - up)]
                found.append((np.full(len(v), node[i]), node[v], np.full(len(v), root[i]), root[v]))
                rows += len(v)
                if rows > 100_000:
                    yield _pair_batch(found)
                    found, rows = [], 0
        if rows:
            yield _pair_batch(found)


def _pair_batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["u", "v", "root_u", "root_v"])


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, hashes, odd) of the texts with the keys of wanted(id, key)."""
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    found = docs.select("text").withColumn("key", _key(F.col("text"))).join(wanted, "key").select("id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(t.as_py()), size) for t in batch.column(1)]
            arrays = [batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "hashes", "odd"])

    return cut_lineage(found.dropDuplicates(["id"]).mapInArrow(tidy(run), "id bigint, hashes array<bigint>, odd binary"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of pairs(u, v, ...) whose sets have the least similarity."""
    up, down = LEAST
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("y")), "v")
    sizes = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
    return cut_lineage(sizes.where(F.col("shared") * down >= (F.size("x") + F.size("y") - F.col("shared")) * up).select(pairs.columns))


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """(u, v): texts of one SimHash with the first of them, and firsts whose SimHashes lie within the radius."""
    first = cut_lineage(texts.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("k")))
    same = look_up(texts.where("n > 0").select("fp", F.col("id").alias("v")), first.where("k > 1").select("fp", F.col("id").alias("u")), "fp").select("u", "v")
    near = _links(first.select("fp"), RADIUS)
    near = near.join(first.select(F.col("fp").alias("u"), F.col("id").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("id").alias("b")), "v")
    return same.where("u <> v").unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _merged(root: DataFrame, more: DataFrame) -> DataFrame:
    """root(id, root), a row for each text but the classes' least ones, after links(root_u, root_v) between classes."""
    if more.isEmpty():
        return root
    classes = _propagate(more.select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))).where("fp <> root")
    moved = look_up(root, classes.select(F.col("fp").alias("root"), F.col("root").alias("to")), "root", outer=True)
    return cut_lineage(moved.select("id", F.coalesce("to", "root").alias("root")).union(classes.select("fp", "root")))


def jaccard_classes(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, root) of every row of docs(doc_id, text): the digest of its words and its class.

    Texts with the same words, A-Z lower-cased, have the same key; null, empty and blank texts are
    such texts. Repeated rows and null ids are kept, other columns are ignored, texts of any length
    are read whole, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    up, down = LEAST
    rows = cut_lineage(_sketches(docs, shingle))
    texts = cut_lineage(rows.dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("id"), "key", "n", "fp", "buckets"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(F.explode("buckets").alias("bucket"), "id", "n").repartition(parts, "bucket").sortWithinPartitions("bucket", "id")
    members = cut_lineage(dealt.mapInArrow(tidy(_crowded), "bucket bigint, id bigint, n bigint"))
    close = cut_lineage(_simhash_pairs(texts))
    wanted = members.select("id").union(close.select("u")).union(close.select("v")).distinct()
    sets = _sets(docs, texts.select("id", "key").join(wanted, "id"), shingle)

    first = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"))
    star = members.join(first, "bucket").where((F.col("id") != F.col("c.id")) & (F.col("n") * down >= F.col("c.n") * up) & (F.col("c.n") * down >= F.col("n") * up))
    pairs = star.select(F.col("c.id").alias("u"), F.col("id").alias("v")).union(close.select(F.least("u", "v"), F.greatest("u", "v")))
    pairs = cut_lineage(pairs.distinct())
    # each text with the least of its partners first; of the other pairs, only those still in different classes
    tried = cut_lineage(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    links = _verified(tried, sets)
    # every text of these links has one partner, and that comes before it
    root = _tops(links.select(F.col("v").alias("fp"), F.col("u").alias("root"))).withColumnRenamed("fp", "id")
    for side in ("u", "v"):
        own = root.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = look_up(pairs, own, side, outer=True).withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    root = _merged(root, _verified(pairs.where("root_u <> root_v").select("u", "v", "root_u", "root_v").join(tried, ["u", "v"], "left_anti"), sets))

    placed = members.join(root, "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high and size > 2")
    left = placed.join(open_.select("bucket"), "bucket").join(sets.select("id", "odd"), "id").select("bucket", "id", "n", "root", "odd").repartition(parts, "bucket").sortWithinPartitions("bucket", "id")
    root = _merged(root, _verified(left.mapInArrow(tidy(_open_pairs), "u bigint, v bigint, root_u bigint, root_v bigint").distinct(), sets))
    named = texts.select("id", "key").join(root, "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    return look_up(rows.select("doc_id", "key"), named, "key")


def keep_one_of_each(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """docs without all but one row of every near-duplicate class.

    The row with the smallest doc_id stays (null only in a class without any id); of rows that
    share it, the one with the smallest key, and of those any (they have the same words). An empty
    table stays empty; other columns, whatever their names, are carried along.
    """
    classes = jaccard_classes(docs, shingle=shingle)
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    # ids are compared inside a struct, where nulls are equal
    id_, key = free_name(docs.columns, "id_"), free_name(docs.columns, "key_")
    keep = least.select(F.struct(F.col("m.doc_id").alias("id")).alias(id_), F.col("m.key").alias(key))
    marked = docs.withColumn(id_, F.struct(F.col("doc_id").alias("id"))).withColumn(key, _key(F.col("text")))
    return marked.join(keep, [id_, key], "left_semi").dropDuplicates([id_, key]).drop(id_, key)
