"""Texts of drawings: types, names, extraction, parsing, likeness and keys, over marks made from part numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions import marks as m
from graniteflow.functions.quantities import component_type
from graniteflow.functions.text import letters_alike, metres
from graniteflow.plans.quantities import NAMES, NAMES_SQL
from graniteflow.session import table

PREFIXES = ["KZ", "L", "B", "Q", "J", "TL", "KL", "GZ", "W", "C"]


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with a code, a type name, a dimension text and a note of several lines."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    of = lambda values: F.get(F.array(*map(F.lit, values)), (key % 10).cast("int"))
    dims = (
        F.when(key % 8 == 0, F.concat(size * 10, F.lit("×"), size * 20)).when(key % 8 == 1, F.concat(size * 10, F.lit("x"), size * 20, F.lit(" x "), size * 30))
        .when(key % 8 == 2, F.concat(size * 10, F.lit("mm"))).when(key % 8 == 3, F.concat(size, F.lit(".5m"))).when(key % 8 == 4, F.concat(F.lit("Φ"), size, F.lit("@200")))
        .when(key % 8 == 5, F.concat(F.lit("±"), size, F.lit(".000"))).when(key % 8 == 6, F.concat(F.lit("HRB"), size)).otherwise(F.concat(F.lit("说明：钢筋保护层厚度 "), size * 300))
    )
    note = F.concat(
        F.lit("工程名称："), "p_name", F.lit("\n图纸比例：1:"), F.when(key % 2 == 0, 100).otherwise(50), F.lit("\n图号：A-"), size, F.lit(" 材料 C30, HRB400 KZ"), size, F.lit(" JQ"), key % 7,
        F.lit(" 200×"), size * 10, F.lit("mm φ12 2024-0"), key % 9 + 1, F.lit("-1"), key % 10, F.lit("\n首层平面图"),
    )
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", "p_name", "p_type", "p_brand", "p_size", F.concat(of(PREFIXES), F.when(key % 3 == 0, "-").otherwise(""), size).alias("code"), of(NAMES).alias("kind"), dims.alias("dims"), note.alias("note"))


def text_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of every part's code and dimension text by each classifier, with their weights and buckets."""
    wide = m.wide_type(F.col("dims"))
    return marked(spark, sf_dir).select("p_partkey", wide.alias("wide"), m.wide_type(F.col("code")).alias("wide_code"), m.narrow_type(F.col("dims")).alias("narrow"), m.bucket(F.col("dims")).alias("bucket"), m.importance(wide).alias("weight"))


def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, code = F.col("kind"), F.col("code")
    return marked(spark, sf_dir).select("p_partkey", m.type_by_word(kind).alias("by_word"), m.type_by_name(kind).alias("by_name"), m.type_by_prefix(code).alias("by_prefix"), m.type_by_letter(code).alias("by_letter"), component_type(kind).alias("normal"))


def text_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents by wide type and weight; equal words are counted first, then typed."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    kinds = words.groupBy(m.wide_type(F.col("word")).alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))
    return kinds.withColumn("weight", m.importance(F.col("kind")))


def label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each label in the notes, with its type and place among the labels of its pattern order."""
    found = marked(spark, sf_dir).select("p_partkey", F.posexplode(m.labels_in(F.col("note"))).alias("place", "_l"))
    return found.select("p_partkey", "place", "_l.label", "_l.kind")


def dimension_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marked(spark, sf_dir).select("p_partkey", F.posexplode(m.dimensions_in(F.col("note"))).alias("place", "_d"))
    return found.select("p_partkey", "place", "_d.dimension", "_d.kind")


def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials named in the notes, with their category, and how often."""
    return marked(spark, sf_dir).select(F.inline(m.materials_in(F.col("note")))).groupBy("content", "category").agg(F.count("*").alias("n"))


def symbol_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in the notes joined with their names: how often, how many numbers, least and largest number."""
    names = spark.createDataFrame(list(m.SYMBOL_NAMES.items()), "symbol string, name string")  # eight rows
    found = marked(spark, sf_dir).select(F.inline(m.symbols_in(F.col("note"))))
    number = F.col("number").try_cast("long")
    sums = found.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("number").alias("numbers"), F.min(number).alias("least"), F.max(number).alias("most"))
    return sums.join(F.broadcast(names), "symbol")


def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 10 to 10000 in the dimension texts, with units, by purpose."""
    found = marked(spark, sf_dir).select(F.inline(m.numbers_in(F.col("dims"))))
    return found.groupBy("unit", m.purpose(F.col("value").cast("long").cast("string")).alias("purpose")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 1).alias("total"))


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension text by each parser of numbers and dimensions."""
    dims = F.col("dims")
    parsed, split, bars = m.parsed_dimensions(dims), m.split_dimensions(dims), m.rebar(dims)
    return marked(spark, sf_dir).select(
        "p_partkey", F.round(F.coalesce(metres(dims), F.lit(0.0)), 6).alias("metres"), m.safe_float(dims).alias("safe_float"), m.safe_number(dims).alias("safe_number"),
        parsed["length"].alias("length"), parsed["width"].alias("width"), parsed["height"].alias("height"), F.round(parsed["area"], 6).alias("area"), F.round(parsed["volume"], 9).alias("volume"),
        split["width"].alias("split_width"), split["length"].alias("split_length"), split["raw"].alias("raw"), bars["diameter"].alias("diameter"), bars["spacing"].alias("spacing"),
        m.normal_dimensions(dims).alias("normal"), m.normal_id(F.concat(F.lit(" "), F.lower("code"), F.lit(" a"))).alias("id"), m.purpose(F.regexp_extract(dims, "[0-9]+", 0)).alias("purpose"),
    )


def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the notes' labelled lines say: project, scale, number, title, view and date."""
    note = F.col("note")
    return marked(spark, sf_dir).select(
        "p_partkey", m.line_after(note, "工程名称").alias("project"), m.line_after(note, "图纸类型").alias("drawing_type"), m.scale_of(note).alias("scale"), m.drawing_number(note).alias("number"),
        m.title_of(note).alias("title"), m.view_title(note).alias("view"), m.date_in(note).cast("string").alias("day"), F.array_join(m.scales_in(note), ",").alias("scales"), m.collapsed(note).alias("line"),
    )


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by what their dimension texts consist of."""
    return marked(spark, sf_dir).select(m.flags(F.col("dims")).alias("f")).groupBy("f.is_numeric", "f.is_letters", "f.is_alnum", "f.has_letters", "f.has_digits").agg(F.count("*").alias("n"))


def text_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of every part's texts by each measure."""
    name, kind = F.col("p_name"), F.lower("p_type")
    tags = [F.split(t, " ") for t in (name, kind)]
    return marked(spark, sf_dir).select(
        "p_partkey", F.round(letters_alike(F.lower("code"), F.lower("dims")), 6).alias("letters"), F.round(letters_alike(F.col("code"), F.col("p_brand")), 6).alias("letters_cased"), F.round(m.edit_likeness(name, kind), 6).alias("edits"),
        m.label_likeness(name, F.concat_ws(" ", name, F.lit("x"))).alias("within"), m.label_likeness(name, kind).alias("label"), m.type_likeness(F.col("kind"), F.lit("柱")).alias("kind"),
        F.round(m.tag_likeness(*tags), 6).alias("tags"), m.same_size(F.col("dims"), F.upper(F.concat(F.lit(" "), "dims"))).alias("size"),
    )


def component_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, signatures and names of every part; parts by sevens have no code, others no place."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    held = m.map_key(F.create_map(F.lit("width"), (size % 5).cast("string"), F.lit("height"), size.cast("string")))
    whole = m.component_key(F.when(key % 7 != 0, F.col("code")), F.col("p_type"), held, F.when(key % 14 == 0, key.cast("double") - 250), key.cast("double"))
    return marked(spark, sf_dir).select(
        "p_partkey", whole.alias("key"), held.alias("dims"), m.signature(F.col("p_name"), F.when(key % 2 == 0, F.col("p_type")), size).alias("signature"),
        m.storage_key(F.lit("drawings"), F.md5("code"), F.concat("p_name", F.lit(".PDF"))).alias("path"), m.safe_name(F.concat("p_name", F.lit(" a/b.tar"))).alias("name"),
    )


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes in natural order, where runs of digits count as numbers; the sort deals them to tasks by ranges."""
    runs = F.regexp_extract_all(F.col("code"), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    order = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(F.lower(x)))
    return marked(spark, sf_dir).orderBy(F.array_join(order, ""), "p_partkey").select("p_partkey", "code")


QUERIES = {
    f.__name__: f
    for f in (
        text_classify, type_names, text_type_counts, label_extract, dimension_extract, annotation_counts, symbol_report, number_extract, parsed_numbers, labelled_fields,
        text_flags, text_likeness, component_keys, natural_order,
    )
}

_M = f"""m AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, {'[' + ', '.join(f"'{p}'" for p in PREFIXES) + ']'}[p_partkey % 10 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '' END || p_size::INT AS code, {NAMES_SQL}[p_partkey % 10 + 1] AS kind,
  CASE p_partkey % 8 WHEN 0 THEN (p_size * 10)::INT || '×' || (p_size * 20)::INT WHEN 1 THEN (p_size * 10)::INT || 'x' || (p_size * 20)::INT || ' x ' || (p_size * 30)::INT WHEN 2 THEN (p_size * 10)::INT || 'mm'
    WHEN 3 THEN p_size::INT || '.5m' WHEN 4 THEN 'Φ' || p_size::INT || '@200' WHEN 5 THEN '±' || p_size::INT || '.000' WHEN 6 THEN 'HRB' || p_size::INT ELSE '说明：钢筋保护层厚度 ' || (p_size * 300)::INT END AS dims,
  '工程名称：' || p_name || chr(10) || '图纸比例：1:' || CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 50 END || chr(10) || '图号：A-' || p_size::INT || ' 材料 C30, HRB400 KZ' || p_size::INT || ' JQ' || p_partkey % 7 || ' 200×' || (p_size * 10)::INT
    || 'mm φ12 2024-0' || (p_partkey % 9 + 1) || '-1' || p_partkey % 10 || chr(10) || '首层平面图' AS note FROM part)"""


def _fit(text: str, patterns: dict[str, str], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{k}'" for k, p in patterns.items()) + f" {rest} END"


def _wide(text: str) -> str:
    t = f"upper(trim({text}))"
    return _fit(t, m.WIDE, f"WHEN length({t}) > 10 AND regexp_matches({t}, '{m.WIDE_WORDS}') THEN 'description' WHEN regexp_matches({t}, '{m.ANGLE}') THEN 'angle' ELSE 'unknown'")


def _weight(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.IMPORTANCE.items()) + " ELSE 1 END::INT"


def _all(text: str, patterns: list[str]) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({text}, '{p}')" for p in patterns) + "])"


_LETTER = "CASE " + " ".join(f"WHEN starts_with(upper({{0}}), '{k}') OR contains({{0}}, '{w}') THEN '{n}'" for k, (n, w) in m.BY_LETTER.items()) + " ELSE 'unknown' END"
_PURPOSE = "CASE WHEN {0} IS NULL THEN '未知' WHEN {0} BETWEEN 200 AND 800 THEN '可能为截面尺寸' WHEN {0} BETWEEN 1000 AND 10000 THEN '可能为跨度或标高' WHEN {0} >= 10000 THEN '可能为坐标或大尺寸' ELSE '其他尺寸' END"
_TYPE = """CASE WHEN contains({0}, '墙') OR contains(lower({0}), 'wall') THEN 'wall' WHEN contains({0}, '柱') OR contains(lower({0}), 'column') THEN 'column' WHEN contains({0}, '梁') OR contains(lower({0}), 'beam') THEN 'beam'
  WHEN contains({0}, '板') THEN 'slab' WHEN contains({0}, '基础') OR contains({0}, '承台') THEN 'foundation' ELSE 'unknown' END"""
_JACCARD = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"
_CHARS = "string_split({}, '')"
_GET = "nullif(trim(regexp_extract({}, '{}', 1)), '')"
_TWO = "CASE WHEN length(trim(regexp_extract(note, '{0}', 1))) >= 2 THEN trim(regexp_extract(note, '{0}', 1)) END"
_N = "list_transform(regexp_extract_all(dims, '[0-9]+'), lambda x: x::DOUBLE)"
_SYMBOLS = "flatten([" + ", ".join(f"list_transform(regexp_extract_all(upper(trim(note)), '{s}([0-9]+)', 1), lambda n: {{'symbol': '{s}', 'number': n}})" for s in m.SYMBOLS) + "])"
ORACLES = {
    "text_classify": f"""WITH {_M}, k AS (SELECT p_partkey, {_wide('dims')} AS wide, {_wide('code')} AS wide_code,
        {_fit('trim(dims)', m.NARROW, f"WHEN length(trim(dims)) > 10 AND regexp_matches(trim(dims), '{m.NARROW_WORDS}') THEN 'description' ELSE 'unknown'")} AS narrow,
        CASE WHEN regexp_matches(upper(dims), 'KZ|L|B|Q|W') THEN 'component_ids' WHEN regexp_matches(dims, '[×xXm]') THEN 'dimensions' WHEN regexp_matches(upper(dims), 'HRB|HPB|C30|C25|C35') THEN 'technical_specs' ELSE 'other_texts' END AS bucket FROM m)
      SELECT *, {_weight('wide')} AS weight FROM k""",
    "type_names": f"""WITH {_M} SELECT p_partkey, CASE {' '.join(f"WHEN contains(kind, '{k}') THEN '{v}'" for k, v in m.BY_WORD.items())} ELSE kind END AS by_word,
        CASE upper(trim(kind)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in m.BY_NAME.items())} ELSE kind END AS by_name,
        CASE {' '.join(f"WHEN starts_with(code, '{k}') THEN '{v}'" for k, v in m.BY_PREFIX.items())} ELSE '{m.OTHER_PREFIX}' END AS by_prefix, {_LETTER.format('code')} AS by_letter, {_TYPE.format('kind')} AS normal FROM m""",
    "text_type_counts": f"""SELECT kind, n, n_distinct, {_weight('kind')} AS weight FROM (SELECT {_wide('word')} AS kind, count(*) AS n, count(DISTINCT word) AS n_distinct
        FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word != '' GROUP BY 1)""",
    "label_extract": f"WITH {_M}, l AS (SELECT p_partkey, {_all('note', m.LABELS)} AS x FROM m) SELECT p_partkey, (i - 1)::INT AS place, x[i] AS label, {_LETTER.format('x[i]')} AS kind FROM l, unnest(range(1, len(x) + 1)) AS r(i)",
    "dimension_extract": f"""WITH {_M}, l AS (SELECT p_partkey, {_all('note', m.DIMENSIONS)} AS x FROM m) SELECT p_partkey, (i - 1)::INT AS place, x[i] AS dimension,
        CASE WHEN regexp_matches(x[i], '[x×]') THEN 'cross_section' WHEN regexp_matches(x[i], '[φΦ]') THEN 'diameter' WHEN contains(x[i], 'm') THEN 'length' ELSE 'unknown' END AS kind FROM l, unnest(range(1, len(x) + 1)) AS r(i)""",
    "annotation_counts": f"WITH {_M} SELECT content, CASE WHEN starts_with(content, 'C') THEN 'concrete' ELSE 'steel' END AS category, count(*) AS n FROM m, unnest({m.MATERIALS}) AS u(content) WHERE contains(note, content) GROUP BY ALL",
    "symbol_report": f"""WITH {_M}, s AS (SELECT unnest({_SYMBOLS}) AS s FROM m) SELECT s.symbol AS symbol, count(*) AS n, count(DISTINCT s.number) AS numbers, min(s.number::BIGINT) AS least, max(s.number::BIGINT) AS most,
        CASE s.symbol {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in m.SYMBOL_NAMES.items())} END AS name FROM s GROUP BY s.symbol""",
    "number_extract": rf"""WITH {_M}, h AS (SELECT unnest(regexp_extract_all(dims, '([0-9]+(?:\.[0-9]+)?)\s*(mm|m|cm)?')) AS h FROM m),
        v AS (SELECT regexp_extract(h, '^[0-9.]+')::DOUBLE AS value, coalesce(nullif(regexp_extract(h, '[a-z]+$'), ''), 'mm') AS unit FROM h)
      SELECT unit, {_PURPOSE.format('trunc(value)::BIGINT')} AS purpose, count(*) AS n, round(sum(value), 1) AS total FROM v WHERE value BETWEEN 10 AND 10000 GROUP BY ALL""",
    "parsed_numbers": rf"""WITH {_M}, n AS (SELECT *, {_N} AS n, regexp_extract(dims, '([0-9]+(?:\.[0-9]+)?)', 1) AS first, list_transform(string_split(replace(dims, '×', 'x'), 'x'), lambda x: trim(x)) AS parts FROM m)
      SELECT p_partkey, round(CASE WHEN contains(dims, 'mm') THEN first::DOUBLE / 1000 ELSE first::DOUBLE END, 6) AS metres, coalesce(try_cast(regexp_replace(trim(dims), 'mm|m|kg', '', 'g') AS DOUBLE), 0) AS safe_float,
        coalesce(try_cast(regexp_replace(dims, '[^0-9.\-]', '', 'g') AS DOUBLE), 0) AS safe_number, CASE WHEN len(n) >= 2 THEN n[1] END AS length, CASE WHEN len(n) >= 2 THEN n[2] END AS width, CASE WHEN len(n) >= 3 THEN n[3] END AS height,
        CASE WHEN len(n) = 2 THEN round(n[1] * n[2] / 1000000, 6) END AS area, CASE WHEN len(n) >= 3 THEN round(n[1] * n[2] * n[3] / 1000000000, 9) END AS volume,
        CASE WHEN len(parts) >= 2 THEN parts[1] END AS split_width, CASE WHEN len(parts) >= 3 THEN parts[3] END AS split_length, CASE WHEN len(parts) < 2 THEN dims END AS raw,
        nullif(regexp_extract(dims, '^Φ([0-9]+)@([0-9]+)', 1), '')::INT AS diameter, nullif(regexp_extract(dims, '^Φ([0-9]+)@([0-9]+)', 2), '')::INT AS spacing,
        regexp_replace(regexp_replace(dims, '[xX×*]', '×', 'g'), '\s+', '', 'g') AS normal, upper(code) || 'A' AS id, {_PURPOSE.format("nullif(regexp_extract(dims, '[0-9]+'), '')::BIGINT")} AS purpose FROM n""",
    "labelled_fields": rf"""WITH {_M} SELECT p_partkey, {_GET.format('note', r'工程名称[：:]\s*([^\n\r]+)')} AS project, {_GET.format('note', r'图纸类型[：:]\s*([^\n\r]+)')} AS drawing_type,
        '1:' || coalesce(nullif(regexp_extract(note, '比例[：:]\s*1\s*[:：]\s*([0-9]+)', 1), ''), nullif(regexp_extract(note, '1\s*[:：]\s*([0-9]+)', 1), '')) AS scale,
        coalesce({_TWO.format(r'图\s*号[：:]\s*([A-Za-z0-9\-/]+)')}, {_TWO.format('([A-Za-z0-9]{2,}-[A-Za-z0-9]{2,})')}) AS number, {_TWO.format(r'工程名称[：:]\s*([^：:\n]+)')} AS title,
        trim(regexp_extract(note, '(.+)平面图', 1)) AS view, try_strptime(regexp_extract(note, '([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})', 1), '%Y-%m-%d')::DATE::VARCHAR AS day,
        array_to_string(list_filter({m.SCALES}, lambda s: contains(note, s)), ',') AS scales, trim(regexp_replace(note, '\s+', ' ', 'g')) AS line FROM m""",
    "text_flags": rf"""WITH {_M} SELECT regexp_matches(dims, '^\p{{Nd}}+$') AS is_numeric, regexp_matches(dims, '^\p{{L}}+$') AS is_letters, regexp_matches(dims, '^[\p{{L}}\p{{Nd}}]+$') AS is_alnum,
        regexp_matches(dims, '\p{{L}}') AS has_letters, regexp_matches(dims, '\p{{Nd}}') AS has_digits, count(*) AS n FROM m GROUP BY ALL""",
    "text_likeness": f"""WITH {_M}, t AS (SELECT *, regexp_replace(upper(p_name), '\\s+', '', 'g') AS x, regexp_replace(upper(p_type), '\\s+', '', 'g') AS y, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM m)
      SELECT p_partkey, round({_JACCARD.format(_CHARS.format('lower(code)'), _CHARS.format('lower(dims)'))}, 6) AS letters, round({_JACCARD.format(_CHARS.format('code'), _CHARS.format('p_brand'))}, 6) AS letters_cased,
        round(CASE WHEN x = y THEN 1 WHEN least(length(x), length(y)) <= 3 THEN 0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6)::DOUBLE AS edits, 0.7::DOUBLE AS within,
        CASE WHEN lower(p_name) = lower(p_type) THEN 1 WHEN contains(lower(p_name), lower(p_type)) OR contains(lower(p_type), lower(p_name)) THEN 0.7 WHEN list_has_any(string_split(lower(p_name), ' '), b) THEN 0.5 ELSE 0 END::DOUBLE AS label,
        CASE kind WHEN '柱' THEN 1 WHEN '框架柱' THEN 0.8 ELSE 0 END::DOUBLE AS kind, round({_JACCARD.format('a', 'b')}, 6) AS tags, true AS size FROM t""",
    "component_keys": f"""WITH {_M}, d AS (SELECT *, concat_ws('_', 'height' || p_size::INT, CASE WHEN p_size::INT % 5 != 0 THEN 'width' || p_size::INT % 5 END) AS held FROM m)
      SELECT p_partkey, CASE WHEN p_partkey % 7 != 0 THEN 'id_' || code ELSE replace(lower(p_type || '_' || held || '_' || CASE WHEN p_partkey % 14 = 0 THEN trunc((p_partkey - 250) / 100)::BIGINT * 100 || '_' || trunc(p_partkey / 100)::BIGINT * 100 ELSE 'nopos' END), ' ', '_') END AS key,
        held AS dims, md5(concat(p_name, '|', CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'None' END, '|', p_size::INT)) AS signature, 'drawings/' || md5(code) || '.pdf' AS path, replace(p_name, ' ', '_') || '_a_b' AS name FROM d""",
    "natural_order": f"""WITH {_M} SELECT p_partkey, code FROM m ORDER BY array_to_string(list_transform(regexp_extract_all(code, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE lower(x) END), ''), p_partkey""",
}
