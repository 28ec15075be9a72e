"""Column helpers on texts of drawings: types, codes, dimensions, materials, labelled lines, likeness, keys.

Patterns are written in ASCII classes, so that Java's and other engines' matchers agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text types of the wide classifier (upper case) and of the narrow one, in the order in which they count.
WIDE = {
    "component_id": r"^[A-Z]{1,3}[0-9]+[A-Z]*$",
    "dimension": r"[0-9]+(\.[0-9]+)?[×xX][0-9]+(\.[0-9]+)?|[0-9]+(\.[0-9]+)?\s*[mM]{2}\s*$|[0-9]+(\.[0-9]+)?\s*[cC][mM]\s*$",
    "material": r"^[CHR]+[0-9]+[AB]?$",
    "axis": r"^[A-Z]$|^[0-9]+$",
    "elevation": r"[±+\-][0-9]+\.[0-9]+",
}
NARROW = {
    "component_id": r"^[A-Z]{1,3}[0-9]+[A-Z]*$",
    "dimension": r"[0-9]+(\.[0-9]+)?[×x][0-9]+(\.[0-9]+)?|[0-9]+(\.[0-9]+)?\s*[mM]{2}\s*$",
    "material": r"^[CHR][0-9]+[AB]?$",
    "axis": r"^[A-Z]$|^[0-9]+$",
}
ANGLE, WIDE_WORDS, NARROW_WORDS, LONG = r"[0-9]+°", "[说明注备施工图]", "[说明注备]", 10
#: Weight of each text type.
IMPORTANCE = {"component_id": 10, "dimension": 9, "axis": 8, "elevation": 7, "material": 6, "angle": 5, "description": 3, "unknown": 1}
#: Names of component types, by what a text contains, by what it is, and by how an id begins.
BY_WORD = {"柱": "框架柱", "梁": "框架梁", "板": "现浇板", "墙": "剪力墙", "基础": "独立基础"}
BY_NAME = {"梁": "梁", "BEAM": "梁", "柱": "柱", "COLUMN": "柱", "板": "板", "SLAB": "板", "墙": "墙", "WALL": "墙", "基础": "基础", "FOUNDATION": "基础"}
BY_PREFIX = {"KZ": "框架柱", "L": "梁", "B": "板", "Q": "墙", "J": "基础", "TL": "楼梯"}
OTHER_PREFIX = "其他构件"
BY_LETTER = {"C": ("column", "柱"), "L": ("beam", "梁"), "B": ("slab", "板"), "W": ("wall", "墙"), "F": ("foundation", "基"), "S": ("stair", "楼")}
#: Patterns of labels, dimensions and symbols in a text, materials and scales that are looked for.
LABELS = [r"(?i)[CLBWFSD][0-9]+[a-zA-Z]?", r"[柱梁板墙基楼][0-9]+"]
DIMENSIONS = [r"(?i)[0-9]+[x×][0-9]+", r"(?i)[0-9]+mm", r"(?i)[0-9]+cm", r"(?i)[0-9]+m", r"φ[0-9]+", r"Φ[0-9]+"]
SYMBOLS = ["KZ", "GZ", "KL", "LL", "LB", "Q", "JQ", "DJJ"]
SYMBOL_NAMES = {"KZ": "框架柱", "GZ": "构造柱", "KL": "框架梁", "LL": "连梁", "LB": "楼板", "Q": "墙", "JQ": "剪力墙", "DJJ": "独立基础"}
MATERIALS = ["C25", "C30", "C35", "HRB400", "HPB300"]
SCALES = ["1:100", "1:200", "1:50", "1:500", "1:1000"]
#: Groups of like component types.
ALIKE = [["梁", "主梁", "次梁"], ["柱", "框架柱", "剪力墙柱"], ["板", "楼板", "屋面板"], ["墙", "剪力墙", "填充墙"]]
#: Characters that a file name may not have.
UNSAFE = r'[/\\:*?"<>| ]'


def first_fit(text: Column, patterns: dict[str, str], default: str = "unknown") -> Column:
    found = F.lit(default)
    for kind, pattern in reversed(patterns.items()):
        found = F.when(text.rlike(pattern), kind).otherwise(found)
    return found


def wide_type(text: Column) -> Column:
    """Type of a text, upper case: component_id, dimension, material, axis, elevation, description, angle or unknown. Null for null."""
    t = F.upper(F.trim(text))
    rest = F.when((F.char_length(t) > LONG) & t.rlike(WIDE_WORDS), "description").when(t.rlike(ANGLE), "angle").otherwise("unknown")
    known = first_fit(t, WIDE)
    return F.when(text.isNotNull(), F.when(known != "unknown", known).otherwise(rest))


def narrow_type(text: Column) -> Column:
    """The narrow classifier: case counts, without elevations and angles."""
    t = F.trim(text)
    known = first_fit(t, NARROW)
    return F.when(text.isNotNull(), F.when(known != "unknown", known).when((F.char_length(t) > LONG) & t.rlike(NARROW_WORDS), "description").otherwise("unknown"))


def bucket(text: Column) -> Column:
    """component_ids, dimensions, technical_specs or other_texts by what a text contains."""
    t, up = F.trim(text), F.upper(F.trim(text))
    return F.when(up.rlike("KZ|L|B|Q|W"), "component_ids").when(t.rlike("[×xXm]"), "dimensions").when(up.rlike("HRB|HPB|C30|C25|C35"), "technical_specs").otherwise("other_texts")


def importance(kind: Column) -> Column:
    found = F.lit(1)
    for name, weight in IMPORTANCE.items():
        found = F.when(kind == name, weight).otherwise(found)
    return found


def type_by_word(text: Column) -> Column:
    found = text
    for word, name in reversed(BY_WORD.items()):
        found = F.when(text.contains(word), name).otherwise(found)
    return found


def type_by_name(text: Column) -> Column:
    found, key = text, F.upper(F.trim(text))
    for word, name in BY_NAME.items():
        found = F.when(key == word, name).otherwise(found)
    return found


def type_by_prefix(code: Column) -> Column:
    """By how an id begins, in the order of the list: LB1 begins with L."""
    found = F.lit(OTHER_PREFIX)
    for prefix, name in reversed(BY_PREFIX.items()):
        found = F.when(F.upper(code).startswith(prefix), name).otherwise(found)
    return found


def type_by_letter(label: Column) -> Column:
    found = F.lit("unknown")
    for letter, (name, word) in reversed(BY_LETTER.items()):
        found = F.when(F.upper(label).startswith(letter) | label.contains(word), name).otherwise(found)
    return found


def all_of(text: Column, patterns: list[str]) -> Column:
    """Hits of each pattern in turn, as one array: a stretch of text may be hit by several."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])


def labels_in(text: Column) -> Column:
    return F.transform(all_of(text, LABELS), lambda x: F.struct(x.alias("label"), type_by_letter(x).alias("kind")))


def dimension_kind(text: Column) -> Column:
    return F.when(text.rlike("[x×]"), "cross_section").when(text.rlike("[φΦ]"), "diameter").when(text.contains("m"), "length").otherwise("unknown")


def dimensions_in(text: Column) -> Column:
    return F.transform(all_of(text, DIMENSIONS), lambda x: F.struct(x.alias("dimension"), dimension_kind(x).alias("kind")))


def materials_in(text: Column) -> Column:
    """Materials that a text names, with their category."""
    kind = lambda m: F.when(m.startswith("C"), "concrete").otherwise("steel")
    return F.transform(F.filter(F.array(*map(F.lit, MATERIALS)), lambda m: F.contains(text, m)), lambda m: F.struct(m.alias("content"), kind(m).alias("category")))


def symbols_in(text: Column) -> Column:
    """Symbols with their numbers, by each symbol's own pattern: JQ1 gives Q and JQ."""
    up = F.upper(F.trim(text))
    hits = lambda symbol: F.transform(F.regexp_extract_all(up, F.lit(f"{symbol}([0-9]+)"), F.lit(1)), lambda n: F.struct(F.lit(symbol).alias("symbol"), n.alias("number")))
    return F.concat(*map(hits, SYMBOLS))


def scales_in(text: Column) -> Column:
    """Scales that a text contains, in the order of the list: 1:500 contains 1:50 too."""
    return F.filter(F.array(*map(F.lit, SCALES)), lambda s: F.contains(text, s))


def numbers_in(text: Column, least: float = 10, most: float = 10_000) -> Column:
    """Numbers with their unit (mm where none is given) between the limits."""
    hits = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(mm|m|cm)?"), F.lit(0))
    parts = F.transform(hits, lambda h: F.struct(F.regexp_extract(h, r"^[0-9.]+", 0).cast("double").alias("value"), F.coalesce(F.nullif(F.regexp_extract(h, "[a-z]+$", 0), F.lit("")), F.lit("mm")).alias("unit")))
    return F.filter(parts, lambda p: p["value"].between(least, most))


def line_after(text: Column, label: str) -> Column:
    """What follows ``label`` and a colon up to the line's end, trimmed; null if the label isn't there."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"{label}[：:]\s*([^\n\r]+)", 1)), F.lit(""))


def scale_of(text: Column) -> Column:
    """1:n from the first pattern that fits; null if none does."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)比例[：:]\s*1\s*[:：]\s*([0-9]+)", r"(?i)Scale\s*[:：]?\s*1\s*[:：]\s*([0-9]+)", r"1\s*[:：]\s*([0-9]+)")])
    return F.concat(F.lit("1:"), found)


def drawing_number(text: Column) -> Column:
    """Of the patterns' first hits the first of two characters at least; null if there is none."""
    hits = [F.trim(F.regexp_extract(text, p, 1)) for p in (r"(?i)图\s*号[：:]\s*([A-Za-z0-9\-/]+)", r"(?i)Drawing\s*No[.:]?\s*([A-Za-z0-9\-/]+)", r"(?i)DWG\s*NO[.:]?\s*([A-Za-z0-9\-/]+)", r"([A-Za-z0-9]{2,}-[A-Za-z0-9]{2,})")]
    return F.coalesce(*[F.when(F.char_length(h) >= 2, h) for h in hits])


def title_of(text: Column) -> Column:
    """The title by a label, else null; of two characters at least."""
    hits = [F.trim(F.regexp_extract(text, p, 1)) for p in (r"图\s*名[：:]\s*([^：:\n]+)", r"(?i)Title\s*[:：]?\s*([^：:\n]+)", r"工程名称[：:]\s*([^：:\n]+)")]
    return F.coalesce(*[F.when(F.char_length(h) >= 2, h) for h in hits])


def view_title(text: Column) -> Column:
    """What stands before the name of a view (plan, elevation, section, detail); '' if nothing does."""
    hits = [F.nullif(F.trim(F.regexp_extract(text, f"(.+){view}", 1)), F.lit("")) for view in ("平面图", "立面图", "剖面图", "详图")]
    return F.coalesce(*hits, F.lit(""))


def date_in(text: Column) -> Column:
    """The first date in a text, with dashes or slashes, else with dots; null if there is none or no such day."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", r"([0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2})")])
    return F.try_to_timestamp(F.regexp_replace(found, r"[/.]", "-"), F.lit("yyyy-M-d")).cast("date")


def safe_float(text: Column, default: float = 0.0) -> Column:
    """A number with its unit mm, m or kg taken off; the default where that isn't a number."""
    return F.coalesce(F.regexp_replace(F.trim(text), "mm|m|kg", "").try_cast("double"), F.lit(default))


def safe_number(text: Column) -> Column:
    """A number from the digits, dots and minus signs of a text; 0 where they aren't one."""
    return F.coalesce(F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def normal_dimensions(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[xX×*]", "×"), r"\s+", "")


def normal_id(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), r"\s+", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parsed_dimensions(text: Column) -> Column:
    """length, width and height of a text's whole numbers; square metres of two, cubic metres of three and more. Null if there is none."""
    n = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("double"))
    at = lambda i, least: F.when(F.size(n) >= least, F.get(n, F.lit(i)))
    area = F.when(F.size(n) == 2, at(0, 2) * at(1, 2) / 1_000_000)
    return F.when(F.size(n) > 0, F.struct(at(0, 2).alias("length"), at(1, 2).alias("width"), at(2, 3).alias("height"), area.alias("area"), (at(0, 3) * at(1, 3) * at(2, 3) / 1_000_000_000).alias("volume")))


def split_dimensions(text: Column) -> Column:
    """width, height and length of W×H[×L]; {raw: text} for anything else, as a map."""
    parts = F.transform(F.split(F.replace(text, F.lit("×"), F.lit("x")), "x"), lambda x: F.trim(x))
    at = lambda i: F.get(parts, F.lit(i))
    two, three = (F.create_map(*[x for k, i in pairs for x in (F.lit(k), at(i))]) for pairs in ([("width", 0), ("height", 1)], [("width", 0), ("height", 1), ("length", 2)]))
    return F.when(F.size(parts) >= 3, three).when(F.size(parts) == 2, two).otherwise(F.create_map(F.lit("raw"), text))


def flags(text: Column) -> Column:
    """Whether a text is all digits, all letters, all letters and digits, or holds a letter or a digit."""
    return F.struct(
        text.rlike(r"^\p{Nd}+$").alias("is_numeric"), text.rlike(r"^\p{L}+$").alias("is_letters"), text.rlike(r"^[\p{L}\p{Nd}]+$").alias("is_alnum"),
        text.rlike(r"\p{L}").alias("has_letters"), text.rlike(r"\p{Nd}").alias("has_digits"),
    )


def rebar(text: Column) -> Column:
    """diameter and spacing of Φd@s at the beginning of a text; null for others."""
    pattern = r"^Φ([0-9]+)@([0-9]+)"
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, i).cast("int").alias(n) for i, n in ((1, "diameter"), (2, "spacing"))]))


def purpose(text: Column) -> Column:
    """What a whole number on a drawing may stand for."""
    n = F.trim(text).try_cast("long")
    return F.when(n.isNull(), "未知").when(n.between(200, 800), "可能为截面尺寸").when(n.between(1000, 10000), "可能为跨度或标高").when(n >= 10000, "可能为坐标或大尺寸").otherwise("其他尺寸")


def beside(dx: Column, dy: Column) -> Column:
    """On which side a point lies by its distances."""
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "右侧").otherwise("左侧")).otherwise(F.when(dy > 0, "下方").otherwise("上方"))


def edit_likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, of upper-case texts without spaces; texts of three characters must be equal."""
    x, y = (F.regexp_replace(F.upper(t), r"\s+", "") for t in (a, b))
    longest, shortest = F.greatest(F.char_length(x), F.char_length(y)), F.least(F.char_length(x), F.char_length(y))
    found = F.when(x == y, 1.0).when(shortest <= 3, 0.0).otherwise(1.0 - F.levenshtein(x, y) / longest)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(found)


def label_likeness(a: Column, b: Column) -> Column:
    """1 for equal labels, 0.7 if one holds the other, 0.5 for a common word, else 0."""
    x, y = F.lower(a), F.lower(b)
    found = F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.7).when(F.arrays_overlap(F.split(x, r"\s+"), F.split(y, r"\s+")), 0.5).otherwise(0.0)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(found)


def type_likeness(a: Column, b: Column) -> Column:
    """1 for equal types, 0.8 for types of one group, else 0."""
    x, y, same = F.lower(a), F.lower(b), F.lit(False)
    for group in ALIKE:
        same = same | (x.isin(group) & y.isin(group))
    found = F.when(x == y, 1.0).when(same, 0.8).otherwise(0.0)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(found)


def tag_likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of tags; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def same_size(a: Column, b: Column) -> Column:
    """Equal without spaces and case; an empty size agrees with any."""
    x, y = (F.lower(F.replace(F.coalesce(t, F.lit("")), F.lit(" "), F.lit(""))) for t in (a, b))
    return (x == "") | (y == "") | (x == y)


def map_key(values: Column) -> Column:
    """A map's entries, sorted, as k and v joined by '_'; empty and zero values are dropped."""
    held = F.array_sort(F.map_entries(F.map_filter(values, lambda k, v: (v != "") & ~v.isin("0", "0.0"))))
    return F.array_join(F.transform(held, lambda e: F.concat(e["key"], e["value"])), "_")


def component_key(code: Column, kind: Column, dims: Column, x: Column, y: Column) -> Column:
    """id_<code>, or without a code type, dimensions and cell of 100 pixels, in lower case without spaces."""
    cell = lambda v: ((v / 100).cast("long") * 100).cast("string")
    place = F.coalesce(F.concat(cell(x), F.lit("_"), cell(y)), F.lit("nopos"))
    other = F.replace(F.lower(F.concat_ws("_", F.coalesce(kind, F.lit("unknown")), F.coalesce(dims, F.lit("")), place)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.concat(F.lit("id_"), F.nullif(code, F.lit(""))), other)


def signature(*parts: Column) -> Column:
    """MD5 of the parts joined by '|'; a null part is None."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def storage_key(folder: Column, file_id: Column, name: Column) -> Column:
    """folder/<file_id>.<extension in lower case>."""
    return F.concat(folder, F.lit("/"), file_id, F.lower(F.regexp_extract(name, r"\.[^./]+$", 0)))


def safe_name(name: Column) -> Column:
    """A file name without its extension and with '_' for what it may not have, of 100 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(name, r"\.[^./]+$", ""), UNSAFE, "_"), F.lit(100))
