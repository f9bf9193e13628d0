"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of shard sums. The two with the largest spread are combined in
opposite order (the largest sum of one joins the smallest of the other) until one is left.

Groups of equal texts are never cut: a group of more than a shard's fair share makes its shard the
largest one, and the method fills up the others around it. Groups of more than one HEAVY-th of all
bytes or rows (so at most 2 x HEAVY of them) are partitioned first, on the driver. The others are
dealt by hash into blocks of about BLOCK groups. Each block is partitioned in its own task,
starting from its part of the sums so far, so that it fills up what these leave uneven; nothing
but block-sized lists is ever in one place.

Blocks do not know each other, so no group may be large for its block: those of more than one
PART-th of a block's share of a shard are taken out and go first, in larger blocks of their own,
and so on until the rest is one block. That leaves shards x PART groups of each block at most
(one in 13 groups), so a billion groups need five rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut_lineage

SHARDS = 24
HEAVY = 1000
BLOCK = 2_500
PART = 8
#: The blocks are dealt to at most so many tasks; a number that Spark chose could leave all blocks to one.
MOST_TASKS = 10_000


def differencing(sizes: Iterable[int], shards: int, start: list[float] | None = None, turn: int = 0) -> list[int]:
    """Shard of every item, by the differencing method.

    start holds sums that the shards have already; shard numbers are then those of start. Ties
    are broken by position, the first free shard being number turn.
    """
    base = start or [0] * shards
    labels = [(turn + k) % shards for k in range(shards)]
    # bins are kept by descending sum as (sum, items); an item is an index, the shard's own sum is ~shard
    partials = [(-(max(base) - min(base)), -1, sorted(((base[k], [~k]) for k in labels), key=lambda b: -b[0]))]
    partials += [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(partials)
    made = len(partials)
    while len(partials) > 1:
        a, b = heapq.heappop(partials)[2], heapq.heappop(partials)[2]
        # a short list stands for one with empty bins at its end
        a, b = a + [(0, [])] * (shards - len(a)), b + [(0, [])] * (shards - len(b))
        joined = []
        for (x, xs), (y, ys) in zip(a, reversed(b)):
            if len(xs) < len(ys):
                xs, ys = ys, xs
            joined.append((x + y, xs + ys if not xs or not ys else _extend(xs, ys)))
        joined.sort(key=lambda bin: -bin[0])
        made += 1
        heapq.heappush(partials, (-(joined[0][0] - joined[-1][0]), made, joined))
    out = [0] * (made + 1)
    for _, items in partials[0][2]:
        shard = next(~i for i in items if i < 0)
        for i in items:
            if i >= 0:
                out[i] = shard
    return out


def _extend(xs: list[int], ys: list[int]) -> list[int]:
    xs.extend(ys)
    return xs


def _block_partitioner(shards: int, sums: list[int], level_bytes: int):
    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        rows = sorted(zip(batch.column("bytes").to_pylist(), batch.column("key").to_pylist()), reverse=True)
        total = sum(r[0] for r in rows)
        seed = [s * total / max(level_bytes, 1) for s in sums]
        at = differencing([r[0] for r in rows], shards, seed, key[0].as_py() % shards)
        return pa.table({"key": pa.array([r[1] for r in rows], pa.binary()), "shard": pa.array(at[: len(rows)], pa.int32()), "bytes": pa.array([r[0] for r in rows], pa.int64())})

    return run


def _deal(light: DataFrame, shards: int, sums: list[int]) -> DataFrame:
    """(key, shard) of every group of light(key, bytes), starting from the shards' sums."""
    levels, floor = [], -1
    while True:
        level = light.where(F.col("bytes") > floor)
        all_ = level.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        blocks = max(1, -(-all_.n // BLOCK))
        edge = all_.bytes // (blocks * shards * PART)
        # groups of one size cannot be told apart by the edge; they are small enough or stay
        if blocks == 1 or edge <= floor:
            levels.append((level, blocks))
            break
        levels.append((level.where(F.col("bytes") <= edge), blocks))
        floor = edge
    sums, parts = list(sums), []
    for level, blocks in reversed(levels):
        total = level.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().bytes
        if not total:
            continue
        level = level.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        dealt = level.repartitionByRange(min(blocks, MOST_TASKS), "block").groupBy("block").applyInArrow(_block_partitioner(shards, list(sums), total), "key binary, shard int, bytes bigint")
        dealt = cut_lineage(dealt)
        for r in dealt.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
            sums[r.shard] += r.bytes
        parts.append(dealt.select("key", "shard"))
    out = parts[0] if parts else light.select("key", F.lit(0).alias("shard"))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row of docs(doc_id, text), shard byte counts being near equal.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Equal texts are in one shard; null
    and empty texts are different groups. Ties of size go by the text's digest, so shards do not
    depend on how the rows are partitioned; slots follow the input's order. Slots are gapless from 0 in
    each shard. Null and repeated ids are rows like any other, other columns are ignored, and an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(F.when(F.col("text").isNull(), F.lit(b"\x00null")).otherwise(text), 256)).alias("key"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    all_ = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    is_heavy = (F.col("bytes") * HEAVY > all_.bytes) | (F.col("n") * HEAVY > all_.n)
    heavy = sorted(groups.where(is_heavy).select("key", "bytes").collect(), key=lambda r: (-r.bytes, bytes(r.key)))  # at most 2 * HEAVY rows
    at = differencing([r.bytes for r in heavy], shards)
    sums = [0] * shards
    for r, s in zip(heavy, at):
        sums[s] += r.bytes
    spark = docs.sparkSession
    placed = F.broadcast(spark.createDataFrame([(bytes(r.key), s) for r, s in zip(heavy, at)], "key binary, shard int"))

    dealt = _deal(groups.where(~is_heavy).select("key", "bytes"), shards, sums)

    keep = ["doc_id", "size", "text_crc32", "at"]
    put = rows.join(placed, "key").select(*keep, "shard")
    put = put.unionByName(rows.join(placed, "key", "left_anti").join(dealt, "key").select(*keep, "shard"))
    return _slots(cut_lineage(put))


def _slots(rows: DataFrame) -> DataFrame:
    """Slots by running counts over (shard, part), a part being the input partition that a row came from."""
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    return rows.withColumn("inside", inside).join(firsts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
