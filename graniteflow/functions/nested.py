"""Column helpers on JSON texts and nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORED = "struct<id:string,type:string,quantity:double,confidence:double>"


def fenced(text: Column) -> Column:
    """What stands in the first code fence, json or bare; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.lit(""))


def braced(text: Column) -> Column:
    """From the first '{' to the last '}'; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def double_quoted(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit('"'))


def reply(text: Column) -> Column:
    """A reply's JSON as a variant: of its code fence, of itself, of its braces, of these with single quotes made double; null if none can be read."""
    body = F.coalesce(fenced(text), text)
    return F.coalesce(*[F.try_parse_json(x) for x in (body, braced(body), double_quoted(braced(body)))])


def position(text: Column) -> Column:
    """x, y, width and height from a JSON list or object; other text as raw."""
    value = F.try_parse_json(text)
    at = lambda i, name: F.coalesce(F.try_variant_get(value, f"$[{i}]", "double"), F.try_variant_get(value, f"$.{name}", "double"))
    return F.struct(*[at(i, name).alias(name) for i, name in enumerate(("x", "y", "width", "height"))], F.when(value.isNull(), text).alias("raw"))


def stored(text: Column) -> Column:
    """A stored result's arrays of components; nulls for broken JSON."""
    return F.from_json(text, f"final_components array<{STORED}>, components array<{STORED}>")


def first_held(*arrays: Column) -> Column:
    """The first array that isn't null or empty; an empty one if there is none."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.slice(F.coalesce(*arrays, F.array()), 1, 0))


def without_empty(values: Column) -> Column:
    """A map of trimmed strings without null and empty ones."""
    return F.map_filter(F.transform_values(values, lambda k, v: F.trim(v)), lambda k, v: v.isNotNull() & (v != ""))
