"""Quantities of components from their dimensions, as column expressions.

Two rule sets are there: take-off rules by type, whose rows without the dimensions they need give null, and
standard rules, which fill missing dimensions by defaults and state whether the result complies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of each type, in the order in which they count.
TYPE_WORDS = {
    "wall": ["墙", "wall"],
    "column": ["柱", "column"],
    "beam": ["梁", "beam"],
    "slab": ["板", "slab"],
    "foundation": ["基础", "foundation", "地基", "承台"],
}
#: Names under which a dimension is given, the first that is there counts.
ALIASES = {
    "length": ["length", "长", "l"],
    "width": ["width", "宽", "w", "b"],
    "height": ["height", "高", "h"],
    "thickness": ["thickness", "厚", "t"],
    "diameter": ["diameter", "直径", "d"],
}
#: Default thickness of walls and slabs in metres; a value over LARGEST_METRES is in millimetres.
WALL_THICKNESS, SLAB_THICKNESS, LARGEST_METRES = 0.24, 0.15, 10
#: Standard rules (what is measured, unit, factor) and what they take for missing dimensions.
STANDARD_RULES = {
    "column": ("volume", "m³", 1.0),
    "beam": ("volume", "m³", 1.0),
    "slab": ("area", "m²", 1.0),
    "wall": ("area", "m²", 1.0),
    "foundation": ("volume", "m³", 1.0),
    "stair": ("area", "m²", 1.3),
}
REFERENCE = "GB50854-2013"
LONGEST, HIGHEST = 50, 20
#: Notes of a quantity.
NOTE_FAULT, NOTE_DEFAULT = "⚠️ 该构件可能不符合标准规范，请人工复核", "📝 部分尺寸使用了默认值，建议核实"
NOTE_RULE, NOTE_NONE = f"📋 计算依据: {REFERENCE}", "❌ 计算失败，请人工处理"
NO_UNIT = "个"


def component_type(text: Column) -> Column:
    """wall, column, beam, slab, foundation or unknown by the words in a name; '' for an empty or null one."""
    low, found = F.lower(F.trim(text)), F.lit("unknown")
    for kind, words in reversed(TYPE_WORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        found = F.when(hit, kind).otherwise(found)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(found)


def number(text: Column) -> Column:
    """text as a number, 0 where it is none."""
    return F.coalesce(text.cast("string").try_cast("double"), F.lit(0.0))


def dimension(values: Column, name: str) -> Column:
    """A dimension in metres from a map of strings; the first alias that is a key counts, null if none is. Over 10 it is in millimetres."""
    found = F.lit(None).cast("double")
    for alias in reversed(ALIASES[name]):
        found = F.when(F.map_contains_key(values, F.lit(alias)), number(values[alias])).otherwise(found)
    return F.when(found > LARGEST_METRES, found / 1000).otherwise(found)


def with_sides(found: dict[str, Column], parts: Column) -> dict[str, Column]:
    """Dimensions with width and height in millimetres from the two parts of a 'bxh', where neither is given."""
    pair = (F.size(parts) == 2) & found["width"].isNull() & found["height"].isNull()
    return found | {name: F.when(pair, number(F.get(parts, F.lit(at))) / 1000).otherwise(found[name]) for at, name in enumerate(("width", "height"))}


def dimensions(values: Column) -> dict[str, Column]:
    """All dimensions of a map of strings; width and height may come as 'bxh' in millimetres, where neither is given."""
    return with_sides({name: dimension(values, name) for name in ALIASES}, F.split(values["bxh"], "x"))


def take_off(kind: Column, dims: dict[str, Column], count: Column) -> Column:
    """A struct of volume and area by the type's rule; null where a dimension that the rule needs is missing or 0, and for other types."""
    zero = lambda name: F.coalesce(dims[name], F.lit(0.0))
    length, width, height, diameter = map(zero, ("length", "width", "height", "diameter"))
    wall, slab = F.coalesce(dims["thickness"], F.lit(WALL_THICKNESS)), F.coalesce(dims["thickness"], F.lit(SLAB_THICKNESS))
    both = lambda volume, area: F.struct((volume * count).alias("volume"), (area * count).alias("area"))
    solid = (length != 0) & (width != 0) & (height != 0)
    return (
        F.when((kind == "wall") & (length != 0) & (height != 0), both(length * height * wall, length * height))
        .when((kind == "column") & (((length != 0) & (width != 0)) | (diameter != 0)) & (height != 0), both(length * width * height, length * width))
        .when((kind == "beam") & solid, both(length * width * height, width * height))
        .when((kind == "slab") & (length != 0) & (width != 0) & (slab != 0), both(length * width * slab, length * width))
        .when((kind == "foundation") & solid, both(length * width * height, length * width))
    )


def filled(value: Column, other: Column, default: float) -> Column:
    """value, or other where it is missing, or 0 where both are; the default stands for 0."""
    found = F.coalesce(value, other, F.lit(0.0))
    return F.when(found == 0, default).otherwise(found)


#: What is read of a component given as JSON text; a value of another shape makes the text unreadable.
STORED = "name string, dimensions map<string,string>, quantity string, _broken string"


def parsed(text: Column) -> Column:
    """A component's JSON text as a struct of STORED."""
    return F.from_json(text, STORED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})


def stored_component(text: Column, found: Column) -> Column:
    """A struct of name, dimensions and quantity from a component's JSON text and what was ``parsed`` of it, and an error where there is none.

    quantity: 1 if it isn't given, 0 if it is no number. Errors: 'no text' for null and blank ones, 'not an object', 'not
    readable' for broken JSON and for dimensions that aren't an object. Other fields are left out; a missing name is ''.
    """
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    error = F.when(blank, "no text").when(~F.startswith(F.ltrim(text), F.lit("{")), "not an object").when(found["_broken"].isNotNull() | found.isNull(), "not readable")
    good = lambda value: F.when(error.isNull(), value)
    count = F.when(found["quantity"].isNull(), 1.0).otherwise(number(found["quantity"]))
    dims = F.coalesce(found["dimensions"], F.create_map().cast("map<string,string>"))
    return F.struct(good(F.coalesce(found["name"], F.lit(""))).alias("name"), good(dims).alias("dims"), good(count).alias("quantity"), error.alias("error"))


def standard_quantity(kind: Column, length: Column, width: Column, height: Column, depth: Column | None = None) -> Column:
    """Quantity by the standard rule: a volume or an area; 0 for a type without a rule. Nulls are missing dimensions."""
    depth = F.lit(None).cast("double") if depth is None else depth
    volume = filled(length, width, 1.0) * filled(width, height, 0.3) * filled(height, depth, 3.0)
    area = filled(length, width, 1.0) * filled(width, height, 1.0)
    found = F.lit(0.0)
    for name, (measure, _, factor) in STANDARD_RULES.items():
        found = F.when(kind == name, (volume if measure == "volume" else area) * factor).otherwise(found)
    return found


def standard_unit(kind: Column) -> Column:
    found = F.lit(NO_UNIT)
    for name, (_, unit, _) in STANDARD_RULES.items():
        found = F.when(kind == name, unit).otherwise(found)
    return found


def complies(quantity: Column, length: Column, width: Column, height: Column) -> Column:
    """Quantity over 0, no dimension below 0, length and width up to 50 and height up to 20; a missing dimension is no fault."""
    fault = lambda value, most: F.coalesce((value < 0) | (value > most), F.lit(False))
    return (quantity > 0) & ~fault(length, LONGEST) & ~fault(width, LONGEST) & ~fault(height, HIGHEST)


def notes(kind: Column, compliant: Column, *dims: Column) -> Column:
    """What is to be said of a standard quantity: a fault, defaulted (zero) dimensions, the rule; types without a rule have one note."""
    default = F.lit(False)
    for d in dims:
        default = default | F.coalesce(d == 0, F.lit(False))
    ruled = F.array_compact(F.array(F.when(~compliant, NOTE_FAULT), F.when(default, NOTE_DEFAULT), F.lit(NOTE_RULE)))
    return F.when(kind.isin(list(STANDARD_RULES)), ruled).otherwise(F.array(F.lit(NOTE_NONE)))


def _kind_is(kind: Column, chinese: str, english: str) -> Column:
    return kind.contains(chinese) | F.lower(kind).contains(english)


def plain_area(kind: Column, length: Column, width: Column, height: Column, thickness: Column) -> Column:
    """Area by type; for other types the product of the two largest dimensions; 0 where one is missing."""
    pair = lambda a, b: F.when((a > 0) & (b > 0), a * b).otherwise(0.0)
    largest = F.reverse(F.array_sort(F.filter(F.array(length, width, height, thickness), lambda d: d > 0)))
    return (
        F.when(_kind_is(kind, "板", "slab"), pair(length, width))
        .when(_kind_is(kind, "墙", "wall"), pair(length, height))
        .when(_kind_is(kind, "梁", "beam") | _kind_is(kind, "柱", "column"), pair(width, height))
        .otherwise(F.coalesce(F.get(largest, F.lit(0)) * F.get(largest, F.lit(1)), F.lit(0.0)))
    )


def plain_volume(kind: Column, length: Column, width: Column, height: Column, thickness: Column) -> Column:
    """Volume by type; for other types the product of the first three positive dimensions; 0 where one is missing."""
    first = lambda a, b: F.when(a != 0, a).otherwise(b)
    solid = lambda a, b, c: F.when((a > 0) & (b > 0) & (c > 0), a * b * c).otherwise(0.0)
    given = F.filter(F.array(length, width, height, thickness), lambda d: d > 0)
    product = F.get(given, F.lit(0)) * F.get(given, F.lit(1)) * F.get(given, F.lit(2))
    return (
        F.when(_kind_is(kind, "板", "slab"), solid(length, width, first(thickness, height)))
        .when(_kind_is(kind, "墙", "wall"), solid(length, height, first(thickness, width)))
        .when(_kind_is(kind, "梁", "beam"), solid(length, width, height))
        .when(_kind_is(kind, "柱", "column"), solid(width, height, first(length, thickness)))
        .otherwise(F.coalesce(product, F.lit(0.0)))
    )


def dimension_label(length: Column, width: Column, height: Column, thickness: Column) -> Column:
    """Like L2000×W300×H500, in millimetres; the thickness only if it isn't the height; '-' if there is none."""
    part = lambda letter, d: F.when(d > 0, F.concat(F.lit(letter), F.round(d * 1000).cast("long").cast("string")))
    found = F.concat_ws("×", part("L", length), part("W", width), part("H", height), F.when(thickness != height, part("T", thickness)))
    return F.when(found == "", "-").otherwise(found)


def drawn_type(width: Column, height: Column, length: Column) -> Column:
    """Type of a drawn entity by its size in millimetres: 柱, 梁 or 板; null without width or height."""
    return F.when((width > 0) & (height > 0), F.when((width < 1000) & (height < 1000), "柱").when((length > width) & (length > height), "梁").otherwise("板"))


def drawn_metric(measure: Column, width: Column, height: Column, length: Column, count: Column) -> Column:
    """Square or cubic metres of a drawn entity, or its count, to three decimals."""
    area, volume = width * length / 1e6 * count, width * height * length / 1e9 * count
    return F.round(F.when(measure == "area", area).when(measure == "volume", volume).otherwise(count.cast("double")), 3)
