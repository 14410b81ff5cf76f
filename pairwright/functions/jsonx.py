"""JSON from free text and JSON rendering.

A reply "contains" a JSON object when the greedy span from the first ``{`` to
the last ``}`` parses as exactly one object.  Spark stops at the end of the first
value, so the span is parsed twice: as the element of an array and as the value of a
key.  What follows the first object must then close (or continue) an array for the one
and an object for the other, which only the end of the span does: ``{..} x {..}``,
``{..},{..}``, ``{..}] [{..}`` and ``{..}} {..}`` fail one of the two.  Strings may
contain raw control characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .. import fixed_values as FV
from .text import ustrip

_PARSE_OPTIONS = {"allowSingleQuotes": "false", "allowUnquotedControlChars": "true",
                  "mode": "PERMISSIVE"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_span(c) -> Column:
    """Greedy ``{...}`` span of the stripped text ('' when there is none)."""
    return F.regexp_extract(ustrip(_col(c)), r"(?s)\{.*\}", 0)


def _single(span: Column) -> Column:
    """Whether the span is one JSON object and nothing else."""
    in_array = F.from_json(F.concat(F.lit("["), span, F.lit("]")), "array<map<string,string>>", _PARSE_OPTIONS)
    in_object = F.from_json(F.concat(F.lit('{"value":'), span, F.lit("}")), "map<string,map<string,string>>", _PARSE_OPTIONS)
    return (F.size(in_array) == 1) & (F.size(in_object) == 1)


def json_object_from_text(c) -> Column:
    """The single object of the span as ``map<string,string>``; null on failure.

    Non-string values come back as their JSON text; duplicate keys keep the
    last value."""
    span = json_span(c)
    return F.when(_single(span), F.from_json(span, "map<string,string>", _PARSE_OPTIONS))


def extract_field(c, key: str = "prompt", default: str | None = FV.DEFAULT_PREDICTED_PROMPT) -> Column:
    """Value of ``key``; ``default`` when the text holds no valid object or
    the key is absent.  A key present with JSON null yields null."""
    obj = json_object_from_text(c)
    # a parsed object may carry a key twice; the last occurrence wins
    matches = F.filter(F.map_entries(obj), lambda e: e["key"] == F.lit(key))
    found = obj.isNotNull() & (F.size(matches) > 0)
    return F.when(found, F.element_at(matches, -1)["value"]).otherwise(F.lit(default))


def parse_field_as(c, key: str, schema: DataType | str) -> Column:
    """Parse the object's ``key`` into a typed value (e.g. ``array<struct<...>>``)."""
    return F.from_json(json_object_from_text(c).getItem(key), schema, _PARSE_OPTIONS)


def to_json_item(**fields) -> Column:
    """JSON object text of the given columns, nulls written as null, in ASCII (other characters as \\uXXXX)."""
    cols = [(_col(v)).alias(k) for k, v in fields.items()]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
