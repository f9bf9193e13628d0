"""Closed JSON schemas of package metadata, and a checker that collects every error.

A schema is built from small constructors; a checker yields (json path, message) pairs. Parsing
keeps the last of repeated keys and refuses NaN and infinities.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime

Check = Callable[[object, str], Iterator[tuple[str, str]]]


def load(data: bytes) -> object:
    """Strict UTF-8 JSON; raises ValueError otherwise."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    return json.loads(data.decode("utf-8").removeprefix("﻿"), parse_constant=refuse)


def number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def text(pattern: str | None = None, least: int = 0, date_time: bool = False) -> Check:
    def check(v, at):
        if not isinstance(v, str):
            yield at, "must be string"
            return
        if len(v) < least:
            yield at, f"must NOT have fewer than {least} characters"
        if pattern and not re.search(pattern, v):
            yield at, f'must match pattern "{pattern}"'
        if date_time and not is_date_time(v):
            yield at, 'must match format "date-time"'

    return check


def is_date_time(v: str) -> bool:
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})[tT ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[zZ]|[+-](\d{2}):(\d{2}))", v, re.A)
    if not m:
        return False
    try:
        year = int(m[1][:4])
        datetime.strptime(f"{year % 400 + 400:04d}{m[1][4:]}", "%Y-%m-%d")
    except ValueError:
        return False
    return int(m[2]) < 24 and int(m[3]) < 60 and int(m[4]) <= 60 and int(m[5] or 0) < 24 and int(m[6] or 0) < 60


def const(value: object) -> Check:
    def check(v, at):
        if v != value or isinstance(v, bool) != isinstance(value, bool):
            yield at, "must be equal to constant"

    return check


def one_of(*values: object) -> Check:
    def check(v, at):
        if v not in values:
            yield at, "must be equal to one of the allowed values"

    return check


def amount(whole: bool, least: float | None = None, most: float | None = None, above: float | None = None) -> Check:
    def check(v, at):
        if not number(v) or whole and v != int(v):
            yield at, "must be integer" if whole else "must be number"
            return
        if least is not None and v < least:
            yield at, f"must be >= {least}"
        if most is not None and v > most:
            yield at, f"must be <= {most}"
        if above is not None and v <= above:
            yield at, f"must be > {above}"

    return check


def listing(item: Check, least: int = 0, unique: bool = False) -> Check:
    def check(v, at):
        if not isinstance(v, list):
            yield at, "must be array"
            return
        if len(v) < least:
            yield at, f"must NOT have fewer than {least} items"
        if unique and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            yield at, "must NOT have duplicate items"
        for k, x in enumerate(v):
            yield from item(x, f"{at}/{k}")

    return check


def record(required: str, fields: dict[str, Check], closed: bool = True, more: Check | None = None) -> Check:
    def check(v, at):
        if not isinstance(v, dict):
            yield at, "must be object"
            return
        for name in required.split():
            if name not in v:
                yield at, f"must have required property '{name}'"
        if closed and set(v) - set(fields):
            for _ in sorted(set(v) - set(fields)):
                yield at, "must NOT have additional properties"
        for name, x in v.items():
            if name in fields:
                yield from fields[name](x, f"{at}/{name}")
        if more is not None:
            yield from more(v, at)

    return check


def nullable(inner: Check) -> Check:
    def check(v, at):
        if v is not None:
            yield from inner(v, at)

    return check


def digest_map(v: object, at: str) -> Iterator[tuple[str, str]]:
    if not isinstance(v, dict):
        yield at, "must be object"
        return
    if not v:
        yield at, "must NOT have fewer than 1 properties"
    for name, x in v.items():
        if not re.search(PATH_OF_DIGEST, name):
            yield at, "property name must be valid"
        yield from text("^[0-9a-f]{64}$")(x, f"{at}/{name}")


def _level(v: dict, at: str) -> Iterator[tuple[str, str]]:
    if v.get("type") == "heading" and "level" not in v:
        yield at, "must have required property 'level'"
    elif v.get("type") != "heading" and "level" in v:
        yield at, "must NOT be valid"


#: Patterns and names of the metadata formats.
PATH_OF_DIGEST = r"^(manifest\.json|(content|data|ai|ext)(/[A-Za-z0-9][A-Za-z0-9._-]*)+)$"
ID = "^[a-z]+-[a-z0-9][a-z0-9-]*$"
_NAME = text(least=1)
_COLUMN = record("name type", {"name": _NAME, "type": one_of("string", "integer", "number", "boolean", "date")})
MANIFEST = record("wdf id title language created modified entry", {
    "wdf": const("0.1"), "id": text("^urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "title": _NAME,
    "language": text("^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*$"), "authors": listing(record("name", {"name": _NAME, "role": _NAME}), 1),
    "created": text(date_time=True), "modified": text(date_time=True), "entry": const("content/index.html"),
    "resources": listing(record("path mediaType", {"path": text("^(content|data)(/[A-Za-z0-9][A-Za-z0-9._-]*)+$"), "mediaType": text("^[a-z]+/[A-Za-z0-9.+-]+$")})),
    "datasets": listing(record("path schema", {"path": text(r"^data(/[A-Za-z0-9][A-Za-z0-9._-]*)+\.json$"), "title": _NAME, "schema": record("columns", {"columns": listing(_COLUMN, 1)})})),
    "extensions": listing(record("name", {"name": _NAME, "version": _NAME}, closed=False)),
})
OUTLINE = listing(record("id type parent", {
    "id": text(ID), "type": one_of("section", "heading", "paragraph", "table", "figure", "blockquote", "list-item"), "level": amount(True, 1, 6), "title": _NAME, "parent": nullable(text(ID)),
}, more=_level))
HASHES = record("algorithm files", {"algorithm": const("sha256"), "files": digest_map})
CAPTURE = record("capture url capturedAt userAgent viewport mode", {
    "capture": const("0.1"), "url": text(r"^https?://[^\s<>]+$"), "capturedAt": text(date_time=True), "userAgent": _NAME, "mode": one_of("article", "full-page"),
    "viewport": record("width height", {"width": amount(True, 1), "height": amount(True, 1), "devicePixelRatio": amount(False, above=0)}),
})
PAGINATION = record("pagination breakBefore", {"pagination": const("0.1"), "breakBefore": listing(text(ID), 1, unique=True)})
SCHEMAS = {"manifest": MANIFEST, "outline": OUTLINE, "hashes": HASHES, "capture": CAPTURE, "pagination": PAGINATION}


def problems(schema: str, value: object) -> list[str]:
    """Every error as "path message"; empty if the value conforms."""
    return [f"{at or '/'} {message}" for at, message in SCHEMAS[schema](value, "")]
