"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of text that a Python worker gets at once, if the session does not say otherwise.
ARROW_ROWS = 1024
ARROW_BYTES = 8 << 20
#: A key is heavy if it has more than one in HEAVY of all rows, so there are fewer than HEAVY heavy keys.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes: texts can be long, and a worker holds one batch at a time.

    A bound that the session has been given already stays as it is.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) in (None, "10000", "-1", str(2**31 - 1), f"{2**31 - 1}b"):
            spark.conf.set(name, str(most))


_held: dict = {}


def give_back() -> None:
    """Return freed memory to the system; workers outlive tasks, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_once(key: object, make):
    """make(), kept in this worker process until another key is asked for.

    One value at a time: workers are reused by whatever runs next, and models or tables of
    operators that have ended must not add up in them.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def tidy(run):
    """run, a function from batches to batches, that gives memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir, read from the session.

    Where it is unset, a session on this machine alone gets a temporary folder; any other raises,
    as executors on other machines could not read what one of them writes there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="vellumix-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written copy."""
    checkpoint_folder(df.sparkSession)
    written = df.checkpoint(eager=True)
    free_shuffles(df.sparkSession)
    return written


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver look for plans that nothing uses any more, so that their shuffle files go.

    Spark removes a shuffle when the driver's heap no longer holds its plan, which it learns from
    a collection only; a driver that allocates little would keep the files of every round.
    """
    spark.sparkContext._jvm.System.gc()


def free_name(taken: list[str], stem: str) -> str:
    """A column name that no column has, whatever its case."""
    names = {c.lower() for c in taken}
    return next(n for n in (stem + "_" * k for k in range(1, len(names) + 2)) if n.lower() not in names)


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """Keys that more than one in HEAVY rows share (fewer than HEAVY keys), as a column key; None if there are none."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= HEAVY)
    most = counts.orderBy(F.desc("__n")).limit(HEAVY).collect()
    if not most:
        return None
    total = rows.count()
    found = [(r[key],) for r in most if r["__n"] * HEAVY > total]
    kind = StructType([StructField(key, rows.schema[key].dataType)])
    return rows.sparkSession.createDataFrame(found, kind) if found else None


def look_up(rows: DataFrame, entries: DataFrame, key: str, *, outer: bool = False, heavy: DataFrame | None | bool = True) -> DataFrame:
    """rows joined with entries, which has one row for each key, so that no task gets a hot key.

    Keys that many rows share are looked up by broadcast (there are fewer than HEAVY of them, and
    entries has a bounded width), all others by a join on the key. A null key finds nothing. heavy
    are the heavy keys, if known.
    """
    kind = "left" if outer else "inner"
    heavy = heavy_keys(rows, key) if heavy is True else heavy
    if heavy is None:
        return rows.join(entries, key, kind)
    few = F.broadcast(heavy)
    hot = rows.join(few, key, "left_semi").join(F.broadcast(entries.join(few, key, "left_semi")), key, kind)
    return hot.unionByName(rows.join(few, key, "left_anti").join(entries.join(few, key, "left_anti"), key, kind))


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def held_out(doc_id: Column | str, mod: int, rem: int) -> Column:
    """Whether the row's fold is rem; a null id is never held out."""
    return F.coalesce(fold(doc_id, mod) == F.lit(rem), F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rem: int, max_rows: int) -> DataFrame:
    """(text, y) of at most about max_rows labelled documents outside the held-out fold.

    Labels are sampled by a hash threshold, so the sample is the same at every partitioning
    and its expected size never passes max_rows; that bound is what allows the broadcast. Should
    documents repeat ids, the rows found are thinned by a hash of their texts in the same way.
    Rows with a null id or label are left out; an id labelled twice gives two rows.
    """
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where(
        F.col("_id").isNotNull() & F.col("y").isNotNull() & ~held_out("_id", mod, rem)
    )
    span = 2**62

    def thinned(rows: DataFrame, n: int, key: str) -> DataFrame:
        return rows.where(F.xxhash64(key).bitwiseAND(F.lit(span - 1)) < F.lit(int(max_rows / n * span)))

    n = lab.count()
    if n > max_rows:
        lab = thinned(lab, n, "_id").limit(2 * max_rows)
    found = cut_lineage(docs.select(F.col("doc_id").alias("_id"), F.col("text")).join(F.broadcast(lab), "_id").select("text", "y"))
    n = found.count()
    return found if n <= 2 * max_rows else thinned(found, n, "text").limit(2 * max_rows)
