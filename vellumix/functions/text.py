"""Column functions of the document engine: plain SQL expressions, so that they stay in generated code."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Media types by file extension.
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "svg": "image/svg+xml", "woff2": "font/woff2",
}


def escape_text(c: Column) -> Column:
    """Backslash before every character that Markdown text must not hold bare."""
    return F.regexp_replace(c, r"([\\`*_\[\]{}<>&|#])", r"\\$1")


def positional_escape(c: Column) -> Column:
    """Backslash where a line would begin a list."""
    return F.regexp_replace(F.regexp_replace(c, r"^([-+])( |$)", r"\\$1$2"), r"^(\d+)([.)])( |$)", r"$1\\$2$3")


def is_package_path(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*\z")


def parse_span(c: Column) -> Column:
    """colspan or rowspan: digits only, kept within 1 and 1000; anything else is 1."""
    digits = F.regexp_replace(F.when(c.rlike(r"\A[0-9]+\z"), c), "^0+", "")
    n = F.when(F.length(digits) > 4, F.lit(1000)).otherwise(digits.try_cast("int"))
    return F.least(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)), F.lit(1000))


def is_date(c: Column) -> Column:
    """YYYY-MM-DD of the proleptic Gregorian calendar, year 0000 included."""
    y, m, d = (F.regexp_extract(c, r"\A(\d{4})-(\d{2})-(\d{2})\z", k).try_cast("int") for k in (1, 2, 3))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(y.isNotNull() & m.between(1, 12) & d.between(1, last), F.lit(False))


def deterministic_uuid(c: Column) -> Column:
    """A version 5 shaped UUID from the SHA-256 of a text."""
    h = F.sha2(c.cast("binary"), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def citation(doc: Column, element: Column) -> Column:
    return F.concat(F.lit("wdf:"), doc, F.lit("#"), element)


def media_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))), F.lit("application/octet-stream"))


def image_type(content: Column) -> Column:
    """Extension by magic bytes: png, jpg, webp or svg, else null."""
    head = F.hex(F.substring(content, 1, 12))
    start = F.substring(content, 1, 512).cast("string")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(start.rlike(r"(?is)\A\x{FEFF}?\s*(<\?xml.*?\?>\s*)?(<!--.*?-->\s*)*<svg[\s>]"), "svg")
    )


@F.arrow_udf(StringType())
def slugify(text: pa.Array) -> pa.Array:
    """Lower-case ASCII words joined by dashes, accents dropped, 40 characters at most."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ").lower()
        return re.sub("[^a-z0-9]+", "-", bare).strip("-")[:40].rstrip("-")

    return pa.array([one(t.as_py()) for t in text], pa.string())


@F.arrow_udf(StringType())
def number_text(x: pa.Array) -> pa.Array:
    """The shortest decimal text of a double as scripts on the web write it."""
    return pa.array([None if v.as_py() is None else _number(v.as_py()) for v in x], pa.string())


def _number(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        return {True: "NaN"}.get(x != x, "Infinity" if x > 0 else "-Infinity")
    if x == 0:
        return "0"
    mantissa, exponent = f"{x!r}e0".split("e")[:2] if "e" not in repr(x) else repr(x).split("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"
