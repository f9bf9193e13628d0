"""Reading a document's parts by element id, and citing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumix.functions.text import citation


def read_and_cite(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, id, uri, content, cited) of every outline row.

    outline is (doc_id, ord, id, up), up being the ids of the citable ancestors, and blocks (doc_id,
    block_no, text, ids). content has the blocks that carry the id of an element in the subtree,
    parted by blank lines; cited is the first block with the element's own id. Both are null without
    such blocks. An element meets its ancestors by their ids, so the work grows with depth, not with
    the square of a document.
    """
    tree = outline.select("doc_id", F.explode(F.concat("up", F.array("id"))).alias("id"), F.col("id").alias("in_id")).distinct()
    shown = blocks.select("doc_id", "block_no", "text", F.explode("ids").alias("in_id"))
    hits = tree.join(shown, ["doc_id", "in_id"]).groupBy("doc_id", "id", "block_no").agg(F.any_value("text").alias("text"), F.max(F.col("in_id") == F.col("id")).alias("own"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n")
    got = hits.groupBy("doc_id", "id").agg(text.alias("content"), F.min_by("text", F.when(F.col("own"), F.col("block_no"))).alias("cited"))
    uri = citation(F.col("doc_id").cast("string"), F.col("id"))
    return outline.join(got, ["doc_id", "id"], "left").select("doc_id", "id", uri.alias("uri"), "content", "cited")


def outline_tree(outline: DataFrame) -> DataFrame:
    """outline(doc_id, ord, id, parent) with depth and the number of children; an orphan is a root, as are rows without a parent."""
    known = outline.select("doc_id", F.col("id").alias("parent")).distinct()
    kids = outline.groupBy("doc_id", F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    rooted = outline.join(known.withColumn("has", F.lit(True)), ["doc_id", "parent"], "left").withColumn("root", F.col("has").isNull()).drop("has")
    return rooted.join(kids, ["doc_id", "id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def open_summary(nodes: DataFrame, blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, elements, blocks, sections): how many citable elements and blocks a document has, and its top headings and sections in order."""
    count = outline.groupBy("doc_id").agg(F.count("*").alias("elements"))
    n = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    top = outline.where("parent is null and title is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("sections"))
    docs = nodes.select("doc_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = docs.join(count, "doc_id", "left").join(n, "doc_id", "left").join(top, "doc_id", "left")
    return out.select("doc_id", zero("elements"), zero("blocks"), F.coalesce("sections", F.array().cast("array<string>")).alias("sections"))
