"""Typed datasets of packages, their cells as rows, and the tables that must show them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from pyspark.sql.window import Window

from vellumix.functions import schemas
from vellumix.functions.text import is_date, number_text

_CELL = StructType().add("row_no", IntegerType()).add("col_no", IntegerType()).add("name", "string").add("type", "string").add("raw", "string")
PARSED = StructType().add("columns", "boolean").add("cells", ArrayType(_CELL)).add("short_rows", ArrayType(IntegerType())).add("n_rows", IntegerType()).add("problem", "string")
#: Fixed value: largest whole number of a double.
MOST_WHOLE = 2**53 - 1


@F.arrow_udf(PARSED)
def _parse(data: pa.Array, declared: pa.Array) -> pa.Array:
    def one(raw: bytes | None, columns: list[dict]) -> dict:
        try:
            value = schemas.load(raw or b"")
        except ValueError as e:
            return {"problem": f"not valid UTF-8 JSON ({e})"}
        if not isinstance(value, dict) or not isinstance(value.get("columns"), list) or not isinstance(value.get("rows"), list):
            return {"problem": 'a dataset file is { "columns": […], "rows": […] }'}
        told = [(c["name"], c["type"]) for c in columns]
        same = [(c.get("name"), c.get("type")) if isinstance(c, dict) else None for c in value["columns"]] == told
        cells, short = [], []
        for r, row in enumerate(value["rows"], 1):
            if not isinstance(row, list) or len(row) != len(told):
                short.append(r)
                continue
            cells += [
                {"row_no": r, "col_no": c, "name": name, "type": kind, "raw": json.dumps(x, ensure_ascii=False, separators=(",", ":"))} for c, ((name, kind), x) in enumerate(zip(told, row), 1)
            ]
        return {"columns": same, "cells": cells, "short_rows": short, "n_rows": len(value["rows"])}

    shape = pa.struct([
        ("columns", pa.bool_()), ("cells", pa.list_(pa.struct([("row_no", pa.int32()), ("col_no", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("raw", pa.string())]))),
        ("short_rows", pa.list_(pa.int32())), ("n_rows", pa.int32()), ("problem", pa.string()),
    ])
    return pa.array([one(d, c) for d, c in zip(data.to_pylist(), declared.to_pylist())], shape)


def parse_datasets(files: DataFrame) -> DataFrame:
    """(doc_id, path, parsed) of files(doc_id, path, bytes, columns array<struct<name,type>>), columns being declared."""
    return files.select("doc_id", "path", "columns", _parse("bytes", "columns").alias("parsed"))


def cells(parsed: DataFrame) -> DataFrame:
    """(doc_id, path, row_no, col_no, name, type, raw, valid): every cell as JSON text, and whether it is of its type."""
    rows = parsed.select("doc_id", "path", F.inline("parsed.cells"))
    return rows.withColumn("valid", cell_matches(F.col("raw"), F.col("type")))


def cell_matches(raw: Column, kind: Column) -> Column:
    """Whether a JSON text is a value of a column type; null is a value of each."""
    is_text, is_number = raw.startswith('"'), raw.rlike(r"\A-?[0-9]")
    value = F.when(is_number, raw.try_cast("double"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= F.lit(1.7976931348623157e308))
    whole = finite & (F.floor(value) == value) & (F.abs(value) <= F.lit(float(MOST_WHOLE)))
    fits = (
        F.when(kind == "string", is_text).when(kind == "integer", whole).when(kind == "number", finite)
        .when(kind == "boolean", raw.isin("true", "false")).when(kind == "date", is_text & is_date(F.regexp_replace(raw, r'\A"|"\z', "")))
    )
    return F.coalesce((raw == "null") | fits, F.lit(False))


def canonical_text(raw: Column) -> Column:
    """The text that a bound table shows for a JSON value: strings bare, numbers in shortest form, null empty.

    Whole numbers that a double holds exactly and short decimals stay in SQL; the rest takes the number formatter.
    """
    plain = raw.rlike(r"\A-?[1-9][0-9]{0,14}\z|\A0\z")
    text = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    number = F.when(raw.rlike(r"\A-?[0-9]") & ~plain, raw.try_cast("double"))
    return F.when(raw == "null", "").when(raw.isin("true", "false") | plain, raw).when(text.isNotNull(), text).otherwise(number_text(number))


def dataset_problems(parsed: DataFrame) -> DataFrame:
    """(doc_id, path, rank, spec, message): what is wrong with dataset files; a file without a row here is valid."""
    say = lambda rank, spec, message: F.struct(F.lit(rank).alias("rank"), F.lit(spec).alias("spec"), message.alias("message"))
    p = F.col("parsed")
    kind = "struct<rank:int,spec:string,message:string>"
    names = F.transform("columns", lambda c: c["name"])
    short = F.transform(F.coalesce(p["short_rows"], F.array().cast("array<int>")), lambda r: say(3, "§5.1.3", F.concat(F.lit("row "), r.cast("string"), F.lit(" must have exactly one cell per column"))).cast(kind))
    first = F.array_compact(F.array(
        F.when(p["problem"].isNotNull(), say(0, "§5.1", p["problem"])).cast(kind),
        F.when(~p["columns"], say(1, "§5.1.1", F.lit("columns differ from the schema declared in the manifest"))).cast(kind),
        F.when(p["columns"].isNotNull() & (F.size(F.array_distinct(names)) < F.size(names)), say(2, "§5.1.2", F.lit("column names must be unique"))).cast(kind),
    ))
    found = parsed.select("doc_id", "path", F.inline(F.concat(first, short)))
    message = F.concat(F.lit("row "), F.col("row_no").cast("string"), F.lit(', column "'), "name", F.lit('": '), "raw", F.lit(" is not a valid "), "type")
    bad = cells(parsed).where("not valid").select("doc_id", "path", F.lit(4).alias("rank"), F.lit("§5.1.4").alias("spec"), message.alias("message"))
    return found.unionByName(bad)


def bound_tables(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, post_end, table_path, path) of the tables that name a dataset."""
    bound = F.get(F.filter("attrs", lambda a: a["name"] == "data-wdf-dataset"), F.lit(0))["value"]
    return nodes.where("tag = 'table'").select("doc_id", "pre", "post_end", F.col("xpath").alias("table_path"), bound.alias("path")).where("path is not null")


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, table, part, row_no, col_no, text) of the cells of tables; part is thead or tbody, row_no counts in it."""
    el = nodes.where("kind = 'element'").select("doc_id", "pre", "parent", "tag", "tag_idx", "elem_idx", "content")
    rows = el.where("tag = 'tr'").select("doc_id", F.col("pre").alias("tr"), F.col("parent").alias("part_pre"), F.col("tag_idx").alias("row_no"))
    parts = el.where("tag in ('thead', 'tbody') and tag_idx = 1").select("doc_id", F.col("pre").alias("part_pre"), F.col("tag").alias("part"), F.col("parent").alias("table"))
    own = el.where("tag in ('th', 'td')").select("doc_id", F.col("parent").alias("tr"), F.col("elem_idx").alias("col_no"), F.col("content").alias("text"))
    return own.join(rows, ["doc_id", "tr"]).join(parts, ["doc_id", "part_pre"]).select("doc_id", "table", "part", "row_no", "col_no", "text")


def correspondence(nodes: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, table_path, rank, spec, message) where bound tables do not show their datasets.

    parsed are the datasets, of which those without a problem count. Header cells are compared with column
    names, body cells with the canonical text of the values by position, unless the numbers of rows differ.
    """
    tables = bound_tables(nodes)
    broken = dataset_problems(parsed).select("doc_id", "path").distinct()
    sound = parsed.join(broken, ["doc_id", "path"], "left_anti")
    undeclared = tables.join(parsed.select("doc_id", "path"), ["doc_id", "path"], "left_anti")
    not_declared = undeclared.select("doc_id", "table_path", F.lit(0).alias("rank"), F.lit("§6.5.1").alias("spec"), F.concat(F.lit('data-wdf-dataset "'), "path", F.lit('" is not declared in the manifest datasets')).alias("message"))
    pairs = tables.join(sound.select("doc_id", "path", "columns", F.col("parsed.n_rows").alias("n_rows"), F.col("parsed.cells").alias("cells")), ["doc_id", "path"])
    shown = table_cells(nodes).withColumnRenamed("table", "pre")
    rows = nodes.where("tag = 'tr' and parent_tag = 'tbody'").groupBy("doc_id", F.col("parent").alias("body")).agg(F.count("*").alias("k"))
    bodies = nodes.where("tag = 'tbody' and tag_idx = 1").select("doc_id", F.col("pre").alias("body"), F.col("parent").alias("pre"))
    bodies = bodies.join(rows, ["doc_id", "body"], "left").select("doc_id", "pre", "k")
    head = shown.where("part = 'thead' and row_no = 1").groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("h"))
    state = pairs.join(head, ["doc_id", "pre"], "left").join(bodies, ["doc_id", "pre"], "left")
    state = state.withColumn("h", F.transform(F.coalesce("h", F.array().cast("array<struct<col_no:int,text:string>>")), lambda x: x["text"])).withColumn("k", F.coalesce("k", F.lit(0)))
    say = lambda rank, spec, *parts: F.struct(F.lit(rank).alias("rank"), F.lit(spec).alias("spec"), F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("message"))
    same_width = F.size("h") == F.size("columns")
    names = F.transform("columns", lambda c, i: F.when(same_width & (F.get("h", i) != c["name"]), say(2, "§6.5.3", "header cell ", i + 1, ' is "', F.get("h", i), '", expected column name "', c["name"], '"')))
    wide = F.when(~same_width, say(1, "§6.5.3", "header has ", F.size("h"), " cells, dataset has ", F.size("columns"), " columns"))
    long = F.when(F.col("k") != F.col("n_rows"), say(3, "§6.5.4", "table body has ", F.col("k"), " rows, dataset has ", F.col("n_rows")))
    heads = state.select("doc_id", "table_path", F.inline(F.array_compact(F.concat(F.array(wide), names, F.array(long)))))
    values = state.where("k = n_rows").select("doc_id", "pre", "table_path", F.inline("cells")).withColumn("want", canonical_text(F.col("raw")))
    body = shown.where("part = 'tbody'").select("doc_id", "pre", "row_no", "col_no", "text")
    wrong = values.join(body, ["doc_id", "pre", "row_no", "col_no"], "left").where(~F.col("text").eqNullSafe(F.col("want")))
    message = F.concat(
        F.lit("row "), F.col("row_no").cast("string"), F.lit(", cell "), F.col("col_no").cast("string"), F.lit(': table shows "'), F.coalesce("text", F.lit("")),
        F.lit('", canonical rendering of '), "raw", F.lit(' is "'), "want", F.lit('"'),
    )
    bad = wrong.select("doc_id", "table_path", F.lit(4).alias("rank"), F.lit("§6.5.4").alias("spec"), message.alias("message"))
    return not_declared.unionByName(heads).unionByName(bad)


def capped_assets(refs: DataFrame, *, most: int = 50, most_bytes: int = 5 << 20, most_total: int = 20 << 20) -> DataFrame:
    """(doc_id, seq, src, state) of refs(doc_id, seq, src, digest, size): which images of a document are packaged.

    In first-seen order of src; one that is missing (size null), too large or beyond the total is refused and
    does not use up the budget; one with the content of an accepted one is the same asset. A fold over the
    document's list, as a running sum would charge for what is refused.
    """
    one = refs.groupBy("doc_id", "src").agg(F.min_by(F.struct("seq", "src", "digest", "size"), "seq").alias("r"))
    rows = one.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    begin = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<string>").alias("have"), F.array().cast("array<struct<seq:int,src:string,state:string>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        known = F.array_contains(acc["have"], r["digest"])
        state = (
            F.when(r["size"].isNull(), "missing").when(F.coalesce(known, F.lit(False)), "shared").when(F.size(acc["have"]) >= most, "too many")
            .when(r["size"] > most_bytes, "too large").when(acc["total"] + r["size"] > most_total, "beyond total").otherwise("accepted")
        )
        took = state == "accepted"
        return F.struct(
            (acc["total"] + F.when(took, r["size"]).otherwise(0)).cast("bigint").alias("total"),
            F.when(took, F.concat(acc["have"], F.array(r["digest"]))).otherwise(acc["have"]).alias("have"),
            F.concat(acc["out"], F.array(F.struct(r["seq"].cast("int").alias("seq"), r["src"].alias("src"), state.alias("state")))).alias("out"),
        )

    return rows.select("doc_id", F.inline(F.aggregate("rows", begin, step)["out"]))


def body_size(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, size) of paragraphs(doc_id, size, text): the size of most of the text; of equals the smaller."""
    w = paragraphs.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("w"))
    return w.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("size"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the number of their key among the document's keys in first-seen order, from 1."""
    first = rows.groupBy("doc_id", key).agg(F.min(order).alias("first"))
    n = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))
    return rows.join(first.select("doc_id", key, n.alias("k")), ["doc_id", key])
