"""JSON in free text: find it, parse it, give defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions.text import strip

# The patterns that say which part of a reply is read.
_OBJECT = r"(?s)(\{.*\})"
_FENCE = r"(?s)```(?:json)?\s*([\{\[].*?[\}\]])\s*```"
_NESTED = r"(?s)(\{[^{}]*+\{[^{}]*+\}[^{}]*+\})"


def _object_of(text: Column) -> Column:
    """The greedy {...}, null if there is none."""
    # Most replies are an object from end to end.
    whole = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    return F.when(whole, text).otherwise(F.nullif(F.regexp_extract(text, _OBJECT, 1), F.lit("")))


def json_of(text: Column, arrays: bool = True) -> Column:
    """A fenced block, else the greedy {...}, else the text.

    With ``arrays`` a text that starts as a JSON array stays one.
    """
    fence = F.when(F.contains(text, F.lit("```")), F.regexp_extract(text, _FENCE, 1)).otherwise("")
    object_ = F.coalesce(_object_of(text), text)
    found = F.when(fence != "", fence)
    if arrays:
        found = found.when(F.startswith(text, F.lit("[")) | text.rlike(r"(?U)^\s+\["), strip(text))
    return found.otherwise(object_)


def relation_json_of(text: Column) -> Column:
    """Without fences: an object holding exactly one object, else the greedy {...}."""
    fenced = F.regexp_replace(F.regexp_replace(text, r"```json\s*", ""), r"```\s*", "")
    plain = F.when(F.contains(text, F.lit("```")), fenced).otherwise(text)
    # Within a list each is evaluated once.
    first = lambda p: F.get(F.filter(F.array(F.regexp_extract(p, _NESTED, 1), _object_of(p)), lambda x: x != ""), 0)
    return F.get(F.transform(F.array(plain), first), 0)


def reply_json_of(text: Column) -> Column:
    """The reply if it is JSON, else what lies between its first { and last }."""
    whole = F.when(F.try_parse_json(text).isNotNull(), text)
    inner = F.regexp_extract(text, _OBJECT, 1)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner))


def as_number(value: Column) -> Column:
    """A JSON scalar as a double if it is written as a number."""
    return F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), value.try_cast("double"))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
