"""Column helpers on recognised texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of each text type, the first that fits counts.
PATTERNS = {
    "component_id": r"^[A-Z]{1,3}-?[0-9]+[a-z]?$",
    "dimension": r"^[0-9]+ *[x×*] *[0-9]+$",
    "number": r"^[0-9]+(\.[0-9]+)?$",
    "label": r"^[A-Za-z]+ [a-z]+$",
}


def text_type(text: Column) -> Column:
    """The type of a trimmed text; ``unknown`` if none fits, null for null."""
    found = F.when(text.isNotNull(), F.lit("unknown"))
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(F.trim(text).rlike(pattern), kind).otherwise(found)
    return found


def metres(text: Column) -> Column:
    """A length in metres: '200mm' is 0.2, '2.5' is 2.5; null where there is no number."""
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.lower(text).contains("mm"), number / 1000).otherwise(number)


def letters_alike(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' sets of characters; 0 if both are empty."""
    x, y = (F.array_remove(F.array_distinct(F.split(t, "")), "") for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))
