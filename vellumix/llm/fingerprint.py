"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range. Sketches
made with the same fraction can be merged by union, and the overlap of two sketches estimates
containment and Jaccard similarity however different the documents' sizes are, because the
same hashes are kept on both sides and nothing else is: the sketch of a short text may be empty.

Shingles are SHINGLE consecutive words, lower-cased, words being runs of anything but ASCII
white space; a text of fewer words is one shingle, one without words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut_lineage

SHINGLE = 5
#: One of so many shingle hashes is kept.
SCALE = 4
#: An id of more than one in HOT rows is spread over SALTS tasks; there are fewer than HOT such ids.
HOT, SALTS = 1000, 64


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda that names an array expression would compute it anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct 63-bit shingle hashes below 2^63 / scale; a null text counts as an empty one."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _sketch_of_hashes(hashes, shingle, scale))


def _sketch_of_hashes(hashes: Column, shingle: int, scale: int) -> Column:
    # word hashes are mixed by position, so a shingle costs a few multiplications and no string
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - F.lit(shingle), F.lit(0)))
    mixed = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(k)) for k in range(shingle)]).bitwiseAND(F.lit((1 << 63) - 1)))

    low = F.array_sort(F.array_distinct(F.filter(mixed, lambda h: h < F.lit((1 << 63) // scale))))
    return F.when(F.size(hashes) > 0, low).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of two documents' shingles."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for two empty sketches, 0 if only one is."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) > 0, shared / F.size(a)).when(F.size(b) > 0, F.lit(0.0)).otherwise(F.lit(1.0))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(1.0))


def to_text(sketch: Column) -> Column:
    """The sketch as lowercase hex, 16 digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending order of the distinct ids of ids(doc_id); the last is followed by the first.

    Ids are cut into ranges by a range exchange and ordered inside each range; only each range's
    first id (as many rows as there are partitions) is ordered globally. A null id is the lowest.
    The ranged ids are written once, since both uses must see the same ranges.
    """
    ranged = cut_lineage(ids.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    inner = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    inner = inner.withColumn("last", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("doc_id"))) == 1)
    edges = ranged.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first"))
    order = Window.orderBy("part")
    ahead = edges.withColumn("following", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    following = F.broadcast(ahead.select("part", "following"))
    return inner.join(following, "part").select("doc_id", F.when(F.col("last"), F.col("following.doc_id")).otherwise(F.col("next_id")).alias("next_id"))


def fingerprint_edits(docs: DataFrame, *, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Sketch of every text of docs(doc_id, text), of its edited text, and their likeness.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many (or
    all) of the next document's, in ascending doc_id; the last is followed by the first. near_edited
    and near_next are the estimated Jaccard similarities to the edited and the next text.
    A null text is empty. Of rows with a repeated id, the one whose needed first half is least, and
    of those the one with the least sketch, is the next document of their predecessor; each row has a result. A null id comes first.
    Other columns are ignored, an empty table gives no rows.

    held_in_next is the estimated share of the text's shingles that the next text has too
    (containment, for texts of very unequal size). Likeness and containment of two empty sketches is 1.

    Each text moves to its id once, and only the part that its predecessor needs moves again. Rows
    of an id that many share (a null among them) are spread by a hash of their texts.
    """
    # ids are compared inside a struct, where nulls are equal; a null-safe join would shuffle anew after the aggregation
    key = lambda c: F.struct(F.col(c).alias("id"))
    rows = docs.select(key("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = cut_lineage(rows.groupBy("key").agg(F.max(F.length("text")).alias("widest"), F.count("*").alias("k")))
    total = sizes.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first().n
    hot = sizes.where((F.col("k") > SALTS) & (F.col("k") * HOT > total)).select("key", F.lit(SALTS).alias("salts"))
    # both sides of the last join read the same columns of the same plan, so that Spark deals the texts out once
    on, spread = ["key"], lambda one_per_key: one_per_key
    if not hot.isEmpty():
        few, on = F.broadcast(cut_lineage(hot)), ["key", "salt"]
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("text"), F.col("salts"))).otherwise(0).cast("int")
        rows = rows.join(few, "key", "left").select("key", salt.alias("salt"), "text")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        spread = lambda one_per_key: one_per_key.join(few, "key", "left").withColumn("salt", every).drop("salts")

    before = successors(docs).select(key("next_id").alias("key"), key("doc_id").alias("from"))
    before = before.join(sizes.select(F.col("key").alias("from"), "widest"), "from")
    heads = rows.join(spread(before), on)
    heads = heads.select("from", F.struct(F.expr("substring(text, 1, widest div 2)").alias("head"), sketch(F.col("text"), shingle, scale).alias("next_sketch")).alias("n"))
    both = rows.join(spread(heads.groupBy(F.col("from").alias("key")).agg(F.min("n").alias("n"))), on)
    n = F.length("text").cast("long")
    both = both.select(F.col("key.id").alias("doc_id"), "text", "n", n.alias("n_chars"), F.expr("substring(text, 1, length(text) - length(text) div 2) || substring(n.head, 1, length(text) div 2)").alias("edited"))
    out = both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), shingle, scale).alias("s"), sketch(F.col("edited"), shingle, scale).alias("e"), F.col("n.next_sketch").alias("x"),
    )
    made = F.array(F.struct(F.col("s"), F.col("e"), F.col("x")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        # one pass through a lambda keeps each sketch from being computed once for every use
        F.inline(F.transform(made, lambda r: F.struct(
            to_text(r["s"]).alias("fingerprint"), to_text(r["e"]).alias("edited_fingerprint"),
            similarity(r["s"], r["e"]).alias("near_edited"), similarity(r["s"], r["x"]).alias("near_next"),
            containment(r["s"], r["x"]).alias("held_in_next"),
        ))),
    )
