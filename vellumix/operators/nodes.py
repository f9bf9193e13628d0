"""Relational operators over the node table: outline, landmark, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumix.sources.html import CITABLE


def attr(name: str) -> Column:
    """First value of an attribute, else null."""
    return F.get(F.filter(F.col("attrs"), lambda a: a["name"] == name), F.lit(0))["value"]


def outline(nodes: DataFrame, with_up: bool = False) -> DataFrame:
    """(doc_id, ord, id, type, level, title, parent) of the citable elements of the article with an id.

    ord counts in document order from 0, parent is the nearest citable ancestor's id. Both and the
    title come from the parse pass, so this is a filter. with_up adds the ids of all citable ancestors, outermost first.
    """
    kinds = F.create_map(*[F.lit(x) for kv in CITABLE.items() for x in kv])
    kind = F.coalesce(F.try_element_at(kinds, F.col("tag")), F.lit("list-item"))
    level = F.when(kind == "heading", F.substring("tag", 2, 1).cast("int"))
    up = [F.col("cited_up").alias("up")] if with_up else []
    parent = F.try_element_at("cited_up", F.lit(-1))
    return nodes.where("ord is not null").select("doc_id", "ord", attr("id").alias("id"), kind.alias("type"), level.alias("level"), "title", parent.alias("parent"), *up)


def landmark(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, post_end, label) of the main content: main, else role="main", else article; the first of its kind below body."""
    role = F.coalesce(attr("role") == "main", F.lit(False))
    rank = F.when(F.col("tag") == "main", 0).when(role, 1).when(F.col("tag") == "article", 2)
    rows = nodes.where(F.col("xpath").startswith("html/body/") & (F.col("kind") == "element")).withColumn("rank", rank).where("rank is not null")
    best = rows.groupBy("doc_id").agg(F.min(F.struct("rank", "pre", "post_end")).alias("b"))
    label = F.element_at(F.array(F.lit("main"), F.lit('role="main"'), F.lit("article")), F.col("b.rank") + 1)
    return best.select("doc_id", "b.pre", "b.post_end", label.alias("label"))
