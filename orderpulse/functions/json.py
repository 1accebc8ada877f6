"""JSON message helpers: path extraction, encoding, snapshot shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderpulse.schemas import CATEGORY_COUNT, SNAPSHOT_ARRAY, SNAPSHOT_ENVELOPE


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_path(value: str | Column, path: str) -> Column:
    """String value at a JSON path; missing key or malformed JSON → null."""
    return F.get_json_object(_col(value), path)


def bytes_to_string(value: str | Column) -> Column:
    """Message bytes decoded as UTF-8 text."""
    return _col(value).cast("string")


def to_json_row(*cols: str | Column) -> Column:
    """One JSON object per row from the given columns."""
    return F.to_json(F.struct(*[_col(c) for c in cols]))


def is_wellformed_json(value: str | Column) -> Column:
    """True when the whole text is exactly one JSON value.

    ``get_json_object(v, '$')`` and ``try_parse_json`` both stop after the
    first value and accept ``"123 and more text"``. Here the text becomes the
    first element of an array whose second is a digest of the text. Trailing
    text is then a syntax error; a ``]`` or ``,`` in it cannot close or
    extend the array, because the digest must still come second of two.
    Strict parsing (``allowSingleQuotes=false``) rejects single quotes.
    """
    v = _col(value)
    digest = F.sha2(v, 256)
    wrapped = F.concat(F.lit("["), v, F.lit(',"'), digest, F.lit('"]'))
    strict = F.from_json(v, "v string, _bad string", {
        "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    whole = (F.json_array_length(wrapped) == 2) & (F.get_json_object(wrapped, "$[1]") == digest)
    # an object is checked by the strict parser as well; other values have no names to quote
    quoted = F.when(F.ltrim(v).startswith("{"), strict["_bad"].isNull()).otherwise(F.lit(True))
    return F.coalesce(whole & quoted, F.lit(False))


# Message shapes a snapshot topic may carry.
SHAPE_ENVELOPE = "envelope"
SHAPE_ARRAY = "array"
SHAPE_OBJECT = "object"
SHAPE_TOMBSTONE = "tombstone"
SHAPE_MALFORMED = "malformed"
SHAPE_OTHER = "other"


def snapshot_shape(value: str | Column) -> Column:
    """Classify a snapshot message: envelope (has ``data``), array, object
    (has ``Category``), tombstone (null), malformed, or other JSON."""
    v = _col(value)
    trimmed = F.ltrim(v)
    return (
        F.when(v.isNull(), F.lit(SHAPE_TOMBSTONE))
        .when(~is_wellformed_json(v), F.lit(SHAPE_MALFORMED))
        .when(F.get_json_object(v, "$.data").isNotNull(), F.lit(SHAPE_ENVELOPE))
        .when(trimmed.startswith("["), F.lit(SHAPE_ARRAY))
        .when(F.get_json_object(v, "$.Category").isNotNull(), F.lit(SHAPE_OBJECT))
        .otherwise(F.lit(SHAPE_OTHER))
    )


def snapshot_entries(value: str | Column, shape: str | Column) -> Column:
    """``array<struct<Category,count>>`` carried by a message of any shape."""
    v, s = _col(value), _col(shape)
    return (
        F.when(s == SHAPE_ENVELOPE, F.from_json(v, SNAPSHOT_ENVELOPE)["data"])
        .when(s == SHAPE_ARRAY, F.from_json(v, SNAPSHOT_ARRAY))
        .when(s == SHAPE_OBJECT, F.array(F.from_json(v, CATEGORY_COUNT)))
    )
