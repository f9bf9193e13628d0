"""Digests of packaged files, their verification, and package structure checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumix.functions.text import is_package_path

def digests(files: DataFrame) -> DataFrame:
    """(doc_id, path, digest) of files(doc_id, path, bytes)."""
    return files.select("doc_id", "path", F.sha2("bytes", 256).alias("digest"))


def compare_digests(computed: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc_id, path, have, want, outcome) where the two sides of (doc_id, path, digest) differ: missing-digest, mismatch or missing-file."""
    a = computed.select("doc_id", "path", F.col("digest").alias("have"))
    b = declared.select("doc_id", "path", F.col("digest").alias("want"))
    outcome = F.when(F.col("want").isNull(), "missing-digest").when(F.col("have").isNull(), "missing-file").when(F.col("have") != F.col("want"), "mismatch")
    return a.join(b, ["doc_id", "path"], "full_outer").select("doc_id", "path", "have", "want", outcome.alias("outcome")).where("outcome is not null")


def bad_paths(files: DataFrame) -> DataFrame:
    """(doc_id, path, reason) of malformed and of repeated paths."""
    n = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("path"))
    reason = F.when(~is_package_path(F.col("path")), "syntax").when(n > 1, "duplicate")
    return files.select("doc_id", "path", reason.alias("reason")).where("reason is not null")


def aggregate_report(report: DataFrame) -> DataFrame:
    """(doc_id, seq, line): equal lines of report(doc_id, seq, line) once, with their number, in first-seen order."""
    g = report.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return g.select("doc_id", "seq", F.when(F.col("n") > 1, F.concat("line", F.format_string(" (×%d)", "n"))).otherwise(F.col("line")).alias("line"))


def split_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, text, ids): blocks of docs(doc_id, markdown), an anchorless block having its predecessor's ids.

    Blocks are parted by blank lines; ids are the {#…} anchors of a block. Everything stays within
    one document's row until the last window, which is over doc_id.
    """
    text = F.regexp_replace("markdown", r"\n\z", "")
    rows = docs.where(~F.col("markdown").isin("", "\n")).select("doc_id", F.posexplode(F.split(text, r"\n\n")).alias("block_no", "text"))
    rows = rows.withColumn("own", F.regexp_extract_all("text", F.lit(r"\{#([a-z]+-[a-z0-9-]*)\}"), 1))
    before = Window.partitionBy("doc_id").orderBy("block_no")
    ids = F.coalesce(F.last(F.when(F.size("own") > 0, F.col("own")), ignorenulls=True).over(before), F.array().cast("array<string>"))
    return rows.select("doc_id", "block_no", "text", ids.alias("ids"))
