"""Packages as rows: reading and writing archives, structure, digests and the state of verification.

A package is (doc_id, bytes); files is (doc_id, path, bytes). An archive is opened in one Arrow
pass, its structure checked there in the archive's own order (only the first problem counts, and a
package with one is not looked at further). Everything after that is relational over files.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window

from vellumix.functions import schemas
from vellumix.operators.integrity import compare_digests
from vellumix.operators.markdown import article_markdown
from vellumix.sources.html import rows_of
from vellumix.sources.tree import parse_document

#: Places and names in a package.
REQUIRED = ["manifest.json", "content/index.html", "ai/content.md", "ai/outline.json", "integrity/hashes.json"]
DIRECTORIES = ("content", "data", "ai", "ext", "integrity")
UNLISTED = ("content/index.html", "content/styles.css")
SEGMENT, EXTENSION = r"[A-Za-z0-9][A-Za-z0-9._-]*", "[a-z][a-z0-9-]*"
HASHES = "integrity/hashes.json"
#: An archive with more entries or more bytes when unpacked is refused.
MOST_ENTRIES, MOST_BYTES = 10_000, 512 << 20

PROBLEM = "struct<spec:string,path:string,message:string>"
OPENED = f"doc_id {{id}}, problem {PROBLEM}, manifest string, files array<struct<path:string,bytes:binary>>"


class Refused(Exception):
    def __init__(self, spec: str, path: str | None, message: str):
        self.args = (spec, path, message)


def unpack(data: bytes) -> dict[str, bytes]:
    """Path -> content in archive order; raises Refused at the first entry that must not be there."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, EOFError) as e:
        raise Refused("§3.1", None, f"not a readable ZIP archive ({e})") from e
    entries = archive.infolist()
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_BYTES:
        raise Refused("§3.1", None, f"archive is larger than {MOST_ENTRIES} entries or {MOST_BYTES} bytes")
    out: dict[str, bytes] = {}
    for e in entries:
        if e.filename.endswith("/"):
            raise Refused("§3.1.4", e.filename, "archive must not contain directory entries")
        if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or e.flag_bits & 1:
            raise Refused("§3.1.1", e.filename, f"unsupported compression method {e.compress_type}" if not e.flag_bits & 1 else "encrypted entry")
        if e.filename in out:
            raise Refused("§3.1.3", e.filename, "duplicate entry name in archive")
        try:
            out[e.filename] = archive.read(e)
        except (zipfile.BadZipFile, ValueError, EOFError, OSError) as x:
            raise Refused("§3.1", e.filename, f"not a readable ZIP archive ({x})") from x
    return out


def manifest_of(data: bytes) -> dict:
    if data.startswith(b"\xef\xbb\xbf"):
        raise Refused("§2", None, "manifest.json must not begin with a byte order mark")
    try:
        value = schemas.load(data)
    except ValueError as e:
        raise Refused("§4", None, f"manifest.json is not valid UTF-8 JSON ({e})") from e
    if wrong := schemas.problems("manifest", value):
        raise Refused("§4", None, f"manifest.json does not conform to the manifest schema ({'; '.join(wrong)})")
    return value


def check_structure(files: dict[str, bytes]) -> dict:
    """The manifest of a sound file set; raises Refused at the first problem, in the specification's order."""
    for path in files:
        parts = path.split("/")
        if not all(re.fullmatch(SEGMENT, p) for p in parts):
            raise Refused("§3.2.1", path, "invalid package path")
        if path != "manifest.json" and (len(parts) < 2 or parts[0] not in DIRECTORIES):
            raise Refused("§3.2.3", path, "file outside the permitted package locations")
        if parts[0] == "integrity" and path != HASHES:
            raise Refused("§3.3.3", path, "integrity/ may contain only hashes.json")
    for path in REQUIRED:
        if path not in files:
            raise Refused("§3.3.1", path, "missing required package file")
    manifest = manifest_of(files["manifest.json"])
    listed = {label: [x["path"] for x in manifest.get(f"{label}s", [])] for label in ("resource", "dataset")}
    for label, paths in listed.items():
        for k, path in enumerate(paths):
            if path in paths[:k]:
                raise Refused("§4.1.1", path, f"duplicate {label} listing")
            if path not in files:
                raise Refused("§4.1.1", path, f"{label} listing references a file not in the package")
    for path in files:
        if path.startswith("content/") and path not in UNLISTED and path not in listed["resource"]:
            raise Refused("§3.3.4", path, "content file not listed in manifest resources")
        if path.startswith("data/") and path not in listed["dataset"]:
            raise Refused("§3.3.4", path, "data file not listed in manifest datasets")
    for path in listed["resource"]:
        if not path.startswith("content/") or path in UNLISTED:
            raise Refused("§4.1", path, "resources may list only additional files under content/")
    declared, found = [e["name"] for e in manifest.get("extensions", [])], set()
    for path in (p for p in files if p.startswith("ext/")):
        parts = path.split("/")
        if len(parts) < 3 or not re.fullmatch(EXTENSION, parts[1]):
            raise Refused("§10.2", path, "extension files must live under ext/<name>/")
        found.add(parts[1])
        if parts[1] not in declared:
            raise Refused("§10.2", path, "extension files present but not declared in the manifest")
    for name in dict.fromkeys(declared):
        if not re.fullmatch(EXTENSION, name):
            raise Refused("§10.1", name, "invalid extension name")
        if name not in found:
            raise Refused("§10.2", name, "extension declared in the manifest but has no files")
    return manifest


def open_packages(packages: DataFrame) -> DataFrame:
    """(doc_id, problem, manifest, files) of packages(doc_id, bytes).

    problem is the first structural one, and then manifest and files are null; null bytes are no
    archive. Rows that share an id are packages of their own.
    """
    kind = packages.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("path", pa.string()), ("bytes", pa.binary())]))
    wrong = pa.struct([("spec", pa.string()), ("path", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a package at a time: each may be large
                problem = manifest = files = None
                try:
                    got = unpack(batch.column(1)[k].as_py() or b"")
                    check_structure(got)
                    manifest = got["manifest.json"].decode()
                    files = [{"path": p, "bytes": b} for p, b in got.items()]
                except Refused as e:
                    problem = dict(zip(("spec", "path", "message"), e.args))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([problem], wrong), pa.array([manifest], pa.string()), pa.array([files], shape)], ["doc_id", "problem", "manifest", "files"]
                )

    return packages.select("doc_id", "bytes").mapInArrow(run, OPENED.format(id=kind))


def files_of(opened: DataFrame) -> DataFrame:
    return opened.select("doc_id", F.inline("files"))


def pack(files: dict[str, bytes]) -> bytes:
    """The canonical archive: manifest first, the rest by code point, fixed times and compression."""
    check_structure(files)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path in ["manifest.json", *sorted(p for p in files if p != "manifest.json")]:
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.create_system, info.external_attr = zipfile.ZIP_DEFLATED, 0, 0
            z.writestr(info, files[path], compresslevel=6)
    return out.getvalue()


def outline_rows(html: str) -> list[dict]:
    """The outline of a document with the fields of its JSON form, in their order."""
    out = []
    for r in rows_of(parse_document(html)):
        if r.get("ord") is not None:
            kind = {"li": "list-item", "p": "paragraph"}.get(r["tag"], "heading" if re.fullmatch("h[1-6]", r["tag"]) else r["tag"])
            own = {"id": next(a["value"] for a in r["attrs"] if a["name"] == "id"), "type": kind}
            if kind == "heading":
                own["level"] = int(r["tag"][1])
            if r["title"] is not None:
                own["title"] = r["title"]
            out.append(own | {"parent": r["cited_up"][-1] if r["cited_up"] else None})
    return out


def pretty(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def hashes_json(files: dict[str, bytes]) -> str:
    return pretty({"algorithm": "sha256", "files": {p: hashlib.sha256(files[p]).hexdigest() for p in sorted(files) if p != HASHES}})


def build(source: dict[str, bytes]) -> dict[str, bytes]:
    """A whole file set from manifest, content, data and extensions; derived files are made anew."""
    files = {p: b for p, b in source.items() if p == "manifest.json" or p.split("/")[0] in ("content", "data", "ext")}
    html = files["content/index.html"].decode()
    files["ai/content.md"] = article_markdown(parse_document(html).html).encode()
    files["ai/outline.json"] = pretty(outline_rows(html)).encode()
    files[HASHES] = hashes_json(files).encode()
    return files


def build_packages(sources: DataFrame) -> DataFrame:
    """(doc_id, bytes) of sources(doc_id, files array<struct<path,bytes>>): the canonical archives.

    A source whose files make no sound package fails the job, as writing it would.
    """

    @F.arrow_udf("binary")
    def packed(files: pa.Array) -> pa.Array:
        return pa.array([None if f is None else pack(build({x["path"]: x["bytes"] for x in f})) for f in files.to_pylist()], pa.binary())

    return sources.select("doc_id", packed("files").alias("bytes"))


def serialize_outline(outline: DataFrame) -> DataFrame:
    """(doc_id, json) of outline(doc_id, ord, id, type, level, title, parent): the canonical JSON."""

    @F.arrow_udf("string")
    def written(rows: pa.Array) -> pa.Array:
        drop = ("level", "title")
        return pa.array([pretty([{k: v for k, v in r.items() if k != "ord" and (v is not None or k not in drop)} for r in own]) for own in rows.to_pylist()], pa.string())

    rows = outline.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "type", "level", "title", "parent"))).alias("rows"))
    return rows.select("doc_id", written("rows").alias("json"))


@F.arrow_udf(StructType().add("markdown", "string").add("outline", "string"))
def extraction(html: pa.Array) -> pa.Array:
    """The derived Markdown and outline of an entry document."""
    out = []
    for x in html:
        raw = (x.as_py() or b"").decode("utf-8", "replace")
        out.append({"markdown": article_markdown(parse_document(raw).html), "outline": pretty(outline_rows(raw))})
    return pa.array(out, pa.struct([("markdown", pa.string()), ("outline", pa.string())]))


@F.arrow_udf(ArrayType(StructType().add("path", "string").add("digest", "string")))
def declared_digests(data: pa.Array) -> pa.Array:
    """Digests of a hashes file; null if it does not conform."""

    def one(raw: bytes | None) -> list | None:
        try:
            value = schemas.load(raw or b"")
        except ValueError:
            return None
        return None if schemas.problems("hashes", value) else [{"path": p, "digest": d} for p, d in value["files"].items()]

    return pa.array([one(x.as_py()) for x in data], pa.list_(pa.struct([("path", pa.string()), ("digest", pa.string())])))


@F.arrow_udf(ArrayType(StringType()))
def schema_problems(schema: pa.Array, data: pa.Array) -> pa.Array:
    """What is wrong with a metadata file under a schema (manifest, outline, hashes, capture, pagination)."""

    def one(name: str, raw: bytes | None) -> list[str]:
        try:
            return schemas.problems(name, schemas.load(raw or b""))
        except ValueError as e:
            return [f"/ not valid UTF-8 JSON ({e})"]

    return pa.array([one(n, x) for n, x in zip(schema.to_pylist(), data.to_pylist())], pa.list_(pa.string()))


def verify(files: DataFrame) -> DataFrame:
    """(doc_id, integrity, determinism, verified, problems) of every document of files(doc_id, path, bytes).

    integrity: hashes.json conforms and its digests are those of all other files, as one full outer
    join; determinism: the derived files are what the entry document gives. problems holds
    (spec, path, message) in the order digests, derived files.
    """
    wrong = lambda spec, path, message: F.struct(F.lit(spec).alias("spec"), path.alias("path"), message.alias("message"))
    told = files.where(F.col("path") == HASHES).select("doc_id", declared_digests("bytes").alias("d"))
    declared = told.where("d is not null").select("doc_id", F.inline("d"))
    computed = files.where(F.col("path") != HASHES).select("doc_id", "path", F.sha2("bytes", 256).alias("digest"))
    readable = told.where("d is not null").select("doc_id")
    outcome = compare_digests(computed.join(readable, "doc_id", "left_semi"), declared)
    spec = F.when(F.col("outcome") == "mismatch", "§8.2").otherwise("§8.1")
    message = (
        F.when(F.col("outcome") == "missing-digest", "file present in the package but missing from integrity/hashes.json")
        .when(F.col("outcome") == "missing-file", "listed in integrity/hashes.json but not present in the package")
        .otherwise(F.concat(F.lit("digest mismatch: hashes.json declares "), "want", F.lit(", actual is "), "have"))
    )
    rank = F.when(F.col("outcome") == "missing-file", 1).otherwise(0)
    by_digest = outcome.select("doc_id", rank.alias("rank"), "path", F.struct(spec.alias("spec"), "path", message.alias("message")).alias("p"))

    is_one = lambda path: F.max(F.when(F.col("path") == path, F.col("bytes")))
    state = files.groupBy("doc_id").agg(
        is_one("content/index.html").alias("entry"), is_one("ai/content.md").alias("md"), is_one("ai/outline.json").alias("outline"), F.max(F.col("path") == HASHES).alias("has_hashes")
    )
    state = state.join(told.select("doc_id", F.col("d").isNotNull().alias("readable")), "doc_id", "left").withColumn("x", F.when(F.col("entry").isNotNull(), extraction("entry")))
    whole = F.col("entry").isNotNull() & F.col("md").isNotNull() & F.col("outline").isNotNull()
    md = whole & ~F.coalesce(F.col("md").cast("string") == F.col("x.markdown"), F.lit(False))
    outline = whole & ~F.coalesce(F.col("outline").cast("string") == F.col("x.outline"), F.lit(False))
    others = F.array_compact(F.array(
        F.when(~F.col("has_hashes"), wrong("§3.3.1", F.lit(HASHES), F.lit("missing hash manifest"))),
        F.when(F.col("has_hashes") & ~F.coalesce("readable", F.lit(False)), wrong("§8.1", F.lit(HASHES), F.lit("does not conform to the hashes schema"))),
    ))
    late = F.array_compact(F.array(
        F.when(~whole, wrong("§3.3.1", F.lit("content/index.html"), F.lit("missing files required for the determinism check"))),
        F.when(md, wrong("§7.1.1", F.lit("ai/content.md"), F.lit("not byte-identical to the canonical extraction of the entry document"))),
        F.when(outline, wrong("§7.1.2", F.lit("ai/outline.json"), F.lit("not byte-identical to the canonical outline of the entry document"))),
    ))
    state = state.select("doc_id", others.alias("early"), late.alias("late"))
    found = by_digest.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "p"))), lambda x: x["p"]).alias("ps"))
    out = state.join(found, "doc_id", "left").withColumn("ps", F.coalesce("ps", F.array().cast(f"array<{PROBLEM}>")))
    integrity, determinism = (F.size("early") + F.size("ps")) == 0, F.size("late") == 0
    return out.select("doc_id", integrity.alias("integrity"), determinism.alias("determinism"), (integrity & determinism).alias("verified"), F.concat("early", "ps", "late").alias("problems"))


def missing_files(packages: DataFrame, files: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(doc_id, path) of required files that a document of packages(doc_id) lacks, packages without any file included."""
    have = files.groupBy("doc_id").agg(F.collect_set(F.when(F.col("path").isin(required or REQUIRED), F.col("path"))).alias("have"))
    want = F.array(*[F.lit(p) for p in (required or REQUIRED)])
    none = F.array().cast("array<string>")
    return packages.select("doc_id").join(have, "doc_id", "left").select("doc_id", F.explode(F.array_except(want, F.coalesce("have", none))).alias("path"))


def listing_problems(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, path, outcome) where the listed(doc_id, kind, path) and the actual optional files differ.

    kind is resource or dataset. Outcomes: duplicate (listed again), missing (listed, no file) and
    unlisted (a file under content/ or data/ that no listing has): one full outer join.
    """
    kind = F.when(F.col("path").startswith("content/") & ~F.col("path").isin(*UNLISTED), "resource").when(F.col("path").startswith("data/"), "dataset")
    there = files.select("doc_id", kind.alias("kind"), "path", F.lit(True).alias("there")).where("kind is not null").distinct()
    named = listed.groupBy("doc_id", "kind", "path").agg(F.count("*").alias("n"))
    both = named.join(there, ["doc_id", "kind", "path"], "full_outer")
    outcomes = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate"), F.when(F.col("there").isNull(), "missing"), F.when(F.col("n").isNull(), "unlisted")))
    return both.select("doc_id", "kind", "path", F.explode(outcomes).alias("outcome"))


def extension_problems(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc_id, name, outcome) where extension folders and declared(doc_id, name) differ: undeclared, or without files."""
    folder = files.where(F.col("path").startswith("ext/")).select("doc_id", F.element_at(F.split("path", "/"), 2).alias("name"), F.lit(True).alias("there")).distinct()
    both = declared.select("doc_id", "name", F.lit(True).alias("told")).distinct().join(folder, ["doc_id", "name"], "full_outer")
    outcome = F.when(F.col("told").isNull(), "undeclared").when(F.col("there").isNull(), "without files")
    return both.select("doc_id", "name", outcome.alias("outcome")).where("outcome is not null")


def page_breaks(breaks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, outcome, id) of breaks(doc_id, list_no, id): ids that the document lacks, or, if none, lists out of document order."""
    spot = nodes.where("kind = 'element'").select("doc_id", F.get(F.filter("attrs", lambda a: a["name"] == "id"), F.lit(0))["value"].alias("id"), "pre").where("id is not null")
    spot = spot.groupBy("doc_id", "id").agg(F.max("pre").alias("pre"))
    placed = breaks.join(spot, ["doc_id", "id"], "left")
    before = F.lag("pre").over(Window.partitionBy("doc_id").orderBy("list_no"))
    state = placed.withColumn("back", F.col("pre") < before).withColumn("lost", F.max(F.col("pre").isNull()).over(Window.partitionBy("doc_id")))
    lost = state.where("pre is null").select("doc_id", F.lit("missing").alias("outcome"), "id")
    return lost.unionByName(state.where("not lost and back").select("doc_id", F.lit("order").alias("outcome"), F.lit(None).cast("string").alias("id")).distinct())


def badge(structure: Column, errors: Column, verified: Column) -> Column:
    """What a reader is shown: not verifiable, tampered, profile errors or verified."""
    return F.when(structure.isNotNull(), "not verifiable").when(~verified, "tampered").when(errors > 0, "profile errors").otherwise("verified")
