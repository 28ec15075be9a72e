"""Quantities of components by take-off and standard rules, their summaries, notes and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions import quantities as q
from graniteflow.plans.takeoff import COMPONENTS_SQL, components
from graniteflow.session import table

#: Names of the component types by part number, and their twins' list.
NAMES = ["框架柱", "框架梁", "楼板", "剪力墙", "独立基础", "Stair", "Main Beam", "WALL 2", "column", "承台"]
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def _text(value: Column) -> Column:
    return value.cast("string")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their dimensions as a map of strings under changing names, as recognition gives them."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 10).cast("int")).alias("name"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    size, length, kind = F.col("p_size"), F.col("l_quantity"), F.col("l_linenumber") % 4
    given = lambda **values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), _text(v))])
    dims = (
        F.when(kind == 0, given(length=length, width=size / 10, height=F.lit(3.0)))
        .when(kind == 1, given(长=length, 宽=size * 100, 高=F.lit(3000)))
        .when(kind == 2, given(l=length, bxh=F.concat(_text(size * 10), F.lit("x"), _text(size * 20))))
        .otherwise(given(l=length, d=F.lit(0.5), h=F.lit(3.0)))
    )
    rows = line.join(part, line.l_partkey == part.p_partkey)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "name", dims.alias("dims"), (F.col("l_linenumber") % 3 + 1).cast("double").alias("pieces"))


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that later expressions name without computing it again: explode over an array of one isn't merged with them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def quantity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and area of every line item by its type's take-off rule; null where a needed dimension is missing."""
    rows = once(measured(spark, sf_dir).withColumnRenamed("dims", "_given"), F.col("_given"), "dims")
    rows = rows.withColumns({name: q.dimension(F.col("dims"), name) for name in q.ALIASES} | {"bxh": F.split(F.col("dims")["bxh"], "x"), "kind": q.component_type(F.col("name"))})
    names = {name: F.col(name) for name in q.ALIASES}
    rows = rows.withColumns(q.with_sides(names, F.col("bxh"))).select("l_orderkey", "l_linenumber", "l_partkey", "kind", q.take_off(F.col("kind"), names, F.col("pieces")).alias("_q"), "pieces")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "kind", F.round("_q.volume", 9).alias("volume"), F.round("_q.area", 9).alias("area"), "pieces")


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as JSON texts, some of them cut off, lists, plain words, empty or null."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    whole, text = F.to_json(F.struct("name", F.col("dims").alias("dimensions"), F.when(key % 3 != 0, F.col("pieces")).alias("quantity"))), F.col("_t")
    odd = F.when(key % 11 == 1, F.substring(text, 1, 12)).when(key % 11 == 2, F.concat(F.lit("["), text, F.lit("]"))).when(key % 11 == 3, F.lit('"beam"')).when(key % 11 == 4, F.lit(" ")).when(key % 11 == 6, F.lit('{"name": "Main Beam", "dimensions": 7}')).when(key % 11 != 5, text)
    return once(once(measured(spark, sf_dir), whole, "_t").select("l_orderkey", "l_linenumber", "l_partkey", "_t"), odd, "text").drop("_t")


def stored_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and area of components given as JSON texts, by their type's rule; null with an error where a text can't be read or its type has no rule."""
    rows = once(stored_texts(spark, sf_dir), q.parsed(F.col("text")), "_p")
    rows = once(rows, q.stored_component(F.col("text"), F.col("_p")), "_c").select("l_orderkey", "l_linenumber", "l_partkey", "_c.*")
    rows = rows.withColumns({name: q.dimension(F.col("dims"), name) for name in q.ALIASES} | {"bxh": F.split(F.col("dims")["bxh"], "x"), "kind": q.component_type(F.col("name"))})
    names = {name: F.col(name) for name in q.ALIASES}
    rows = once(rows.withColumns(q.with_sides(names, F.col("bxh"))), q.take_off(F.col("kind"), names, F.col("quantity")), "_q")
    error = F.coalesce("error", F.when(~F.col("kind").isin(list(q.TYPE_WORDS)), "no rule"), F.when(F.col("_q").isNull(), "dimension missing"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("error").isNull(), F.col("kind")).alias("kind"), F.round("_q.volume", 9).alias("volume"), F.round("_q.area", 9).alias("area"), "quantity", error.alias("error"))


def quantity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of volume, area and pieces by type and in total (kind null); rows without a result count in found alone."""
    rows = quantity_items(spark, sf_dir).where("kind != ''")
    ok = F.col("volume").isNotNull()
    sums = [F.round(F.coalesce(F.sum(c), F.lit(0.0)), 3).alias(c) for c in ("volume", "area")]
    return rows.rollup("kind").agg(F.count("*").alias("found"), F.count_if(ok).alias("n"), *sums, F.coalesce(F.sum(F.when(ok, F.col("pieces"))), F.lit(0.0)).alias("pieces"))


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with zero, negative and oversized dimensions here and there, and their standard quantities."""
    key = F.col("drawing_id") * 8 + F.col("ord")
    length = F.when(key % 7 == 0, 0.0).otherwise(F.col("length"))
    width = F.when(key % 11 == 0, -F.col("width")).otherwise(F.col("width"))
    height = F.when(key % 13 == 0, 25.0).otherwise(F.col("height"))
    rows = components(spark, sf_dir).select("drawing_id", "ord", "material", "component_type", length.alias("length"), width.alias("width"), height.alias("height"))
    quantity = q.standard_quantity(F.col("component_type"), F.col("length"), F.col("width"), F.col("height"))
    rows = rows.withColumns({"quantity": quantity, "unit": q.standard_unit(F.col("component_type"))})
    ruled = F.col("component_type").isin(list(q.STANDARD_RULES))
    rows = rows.withColumn("compliant", ruled & q.complies(F.col("quantity"), F.col("length"), F.col("width"), F.col("height")))
    return rows.withColumn("notes", q.notes(F.col("component_type"), F.col("compliant"), F.col("length"), F.col("width"), F.col("height")))


def standard_rule_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, unit, compliance and number of notes of every component."""
    return standard(spark, sf_dir).select("drawing_id", "ord", "material", F.round("quantity", 6).alias("quantity"), "unit", "compliant", F.array_join("notes", ";").alias("notes"))


def standard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type and in total (component_type null): number, sum, mean, unit, compliant ones and their share."""
    rows = standard(spark, sf_dir)
    unit = F.when(F.grouping("component_type") == 0, F.min("unit")).alias("unit")
    return rows.rollup("component_type").agg(
        F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("total"), F.round(F.avg("quantity"), 4).alias("mean"), unit,
        F.count_if("compliant").alias("compliant"), F.round(F.avg(F.col("compliant").cast("double")), 6).alias("rate"), F.count_distinct("component_type").alias("types"),
    )


def total_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir).groupBy("unit").agg(F.round(F.sum("quantity"), 2).alias("total"))


def noncompliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each component that doesn't comply, with its type and notes."""
    return standard(spark, sf_dir).where("NOT compliant").select("component_type", "drawing_id", "ord", "material", F.array_join("notes", ";").alias("notes"))


def notes_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each note stands, by type."""
    return standard(spark, sf_dir).select("component_type", F.explode("notes").alias("note")).groupBy("component_type", "note").agg(F.count("*").alias("n"))


def priced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, quantity and price by component type and in total. Lines are summed by part before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    kind = q.component_type(F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 10).cast("int")))
    rows = lines.withColumn("kind", kind)
    return rows.rollup("kind").agg(F.sum("n").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.sum("price"), 1).alias("price"))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    dims = {"length": F.when(key % 5 == 0, 0.0).otherwise(size / 5), "width": F.when(key % 7 == 0, 0.0).otherwise(size / 10), "height": F.when(key % 3 == 0, 0.0).otherwise(F.lit(3.0)), "thickness": (key % 4) / 10}
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, NAMES)), (key % 10).cast("int")).alias("name"), *[v.alias(k) for k, v in dims.items()])


def plain_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, volume and dimension label of every part by the plain rules."""
    dims = [F.col(c) for c in ("length", "width", "height", "thickness")]
    area, volume = q.plain_area(F.col("name"), *dims), q.plain_volume(F.col("name"), *dims)
    return _plain(spark, sf_dir).select("p_partkey", F.round(area, 6).alias("area"), F.round(volume, 6).alias("volume"), q.dimension_label(*dims).alias("label"))


def quantity_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by normalised type: number, area to 2 and volume to 3 decimals, the most frequent type first (place from 1)."""
    dims = [F.col(c) for c in ("length", "width", "height", "thickness")]
    rows = _plain(spark, sf_dir).select(q.component_type(F.col("name")).alias("kind"), q.plain_area(F.col("name"), *dims).alias("area"), q.plain_volume(F.col("name"), *dims).alias("volume"))
    sums = rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"), F.round(F.sum("volume"), 3).alias("volume"))
    return sums.orderBy(F.desc("n"), "kind")  # a handful of types


def drawn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and measure of each part taken as a drawn entity; entities without width or height have an error."""
    key, size = F.col("p_partkey"), F.col("p_size")
    width, height, length = F.when(key % 9 == 0, 0).otherwise(size * 60), size * 30, size * F.when(key % 2 == 0, 100).otherwise(20)
    rows = table(spark, sf_dir, "part").select("p_partkey", width.cast("double").alias("w"), height.cast("double").alias("h"), length.cast("double").alias("l"))
    kind = q.drawn_type(F.col("w"), F.col("h"), F.col("l"))
    rows = rows.withColumn("kind", kind).withColumn("measure", F.when(F.col("kind") == "板", "area").when(F.col("kind").isNotNull(), "volume"))
    value = F.when(F.col("kind").isNotNull(), q.drawn_metric(F.col("measure"), F.col("w"), F.col("h"), F.col("l"), F.lit(1)))
    return rows.select("p_partkey", "kind", "measure", value.alias("value"), F.when(F.col("kind").isNull(), "no size").alias("error"))


def drawn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type: entities, those with an error, value; entities with an error count but add nothing."""
    return drawn_parts(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 3).alias("value"), F.min("measure").alias("measure"))


def component_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of each part as a recognised component: id, type, confidence, quantity."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 17 != 0, _text(key)).alias("id"), F.when(key % 19 == 0, "").otherwise(F.col("p_type")).alias("kind"),
        ((size - 2) / 45).alias("confidence"), F.when(key % 23 == 0, "many").otherwise(_text(size - 3)).alias("quantity"),
    )
    number = F.col("quantity").try_cast("double")
    found = lambda **tests: F.array_join(F.array_compact(F.array(*[F.when(test, k) for k, test in tests.items()])), ";")
    errors = found(no_id=F.col("id").isNull(), no_type=F.col("kind") == "", confidence=(F.col("confidence") < 0) | (F.col("confidence") > 1), quantity=number.isNull())
    return rows.select("p_partkey", errors.alias("errors"), found(small_quantity=number <= 0).alias("warnings"), (errors == "").alias("valid"))


def validation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = component_checks(spark, sf_dir)
    return rows.agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.round(F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(0.0)), 6).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        quantity_items, stored_quantities, quantity_rollup, standard_rule_quantities, standard_summary, total_by_unit, noncompliance_report, notes_array, priced_summary,
        plain_measures, quantity_display, drawn_parts, drawn_summary, component_checks, validation_rate,
    )
}

_NAME = f"{NAMES_SQL}[p_partkey % 10 + 1]"
_KIND = """CASE WHEN contains(lower({0}), '墙') OR contains(lower({0}), 'wall') THEN 'wall' WHEN contains({0}, '柱') OR contains(lower({0}), 'column') THEN 'column'
  WHEN contains({0}, '梁') OR contains(lower({0}), 'beam') THEN 'beam' WHEN contains({0}, '板') OR contains(lower({0}), 'slab') THEN 'slab'
  WHEN contains({0}, '基础') OR contains({0}, '承台') OR contains({0}, '地基') OR contains(lower({0}), 'foundation') THEN 'foundation' ELSE 'unknown' END"""
_ITEMS = f"""m AS (SELECT l_orderkey, l_linenumber, l_partkey, {_KIND.format(_NAME)} AS kind, l_linenumber % 3 + 1.0::DOUBLE AS pieces, l_linenumber % 4 AS k,
    CASE WHEN l_quantity > 10 THEN l_quantity / 1000 ELSE l_quantity END AS len,
    CASE l_linenumber % 4 WHEN 0 THEN p_size / 10 WHEN 1 THEN CASE WHEN p_size * 100 > 10 THEN p_size * 100 / 1000 ELSE p_size * 100 END WHEN 2 THEN p_size * 10 / 1000 ELSE 0 END::DOUBLE AS w,
    CASE l_linenumber % 4 WHEN 2 THEN p_size * 20 / 1000 ELSE 3.0 END::DOUBLE AS h FROM lineitem JOIN part ON l_partkey = p_partkey),
  v AS (SELECT *, CASE WHEN kind = 'wall' AND len != 0 AND h != 0 THEN len * h * 0.24::DOUBLE WHEN kind = 'column' AND (len != 0 AND w != 0 OR k = 3) AND h != 0 THEN len * w * h
      WHEN kind IN ('beam', 'foundation') AND len != 0 AND w != 0 AND h != 0 THEN len * w * h WHEN kind = 'slab' AND len != 0 AND w != 0 THEN len * w * 0.15::DOUBLE END * pieces AS volume,
    CASE WHEN kind = 'wall' AND len != 0 AND h != 0 THEN len * h WHEN kind = 'column' AND (len != 0 AND w != 0 OR k = 3) AND h != 0 THEN len * w WHEN kind = 'beam' AND len != 0 AND w != 0 AND h != 0 THEN w * h
      WHEN kind = 'foundation' AND len != 0 AND w != 0 AND h != 0 THEN len * w WHEN kind = 'slab' AND len != 0 AND w != 0 THEN len * w END * pieces AS area FROM m),
  i AS (SELECT l_orderkey, l_linenumber, l_partkey, kind, round(volume, 9) AS volume, round(area, 9) AS area, pieces FROM v)"""
_STD = f"""{COMPONENTS_SQL}, s0 AS (SELECT drawing_id, ord, material, component_type, CASE WHEN (drawing_id * 8 + ord) % 7 = 0 THEN 0.0 ELSE length END::DOUBLE AS length,
    CASE WHEN (drawing_id * 8 + ord) % 11 = 0 THEN -width ELSE width END::DOUBLE AS width, CASE WHEN (drawing_id * 8 + ord) % 13 = 0 THEN 25.0 ELSE height END::DOUBLE AS height FROM components),
  s1 AS (SELECT *, CASE WHEN component_type IN ('column', 'beam', 'foundation') THEN CASE WHEN length = 0 THEN 1 ELSE length END * CASE WHEN width = 0 THEN 0.3 ELSE width END * CASE WHEN height = 0 THEN 3 ELSE height END
      WHEN component_type IN ('slab', 'wall') THEN CASE WHEN length = 0 THEN 1 ELSE length END * CASE WHEN width = 0 THEN 1 ELSE width END ELSE 0 END::DOUBLE AS quantity,
    CASE WHEN component_type IN ('column', 'beam', 'foundation') THEN 'm³' WHEN component_type IN ('slab', 'wall') THEN 'm²' ELSE '个' END AS unit, component_type != 'unknown' AS ruled FROM s0),
  s2 AS (SELECT *, ruled AND quantity > 0 AND length BETWEEN 0 AND 50 AND width BETWEEN 0 AND 50 AND height BETWEEN 0 AND 20 AS compliant FROM s1),
  s AS (SELECT *, CASE WHEN NOT ruled THEN ['{q.NOTE_NONE}'] ELSE list_filter([CASE WHEN NOT compliant THEN '{q.NOTE_FAULT}' END,
    CASE WHEN length = 0 OR width = 0 OR height = 0 THEN '{q.NOTE_DEFAULT}' END, '{q.NOTE_RULE}'], lambda x: x IS NOT NULL) END AS notes FROM s2)"""
_PLAIN = f"""p AS (SELECT p_partkey, {_NAME} AS name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size / 5 END::DOUBLE AS l, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size / 10 END::DOUBLE AS w,
    CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 3 END::DOUBLE AS h, (p_partkey % 4 / 10)::DOUBLE AS t FROM part),
  f AS (SELECT *, list_filter([l, w, h, t], lambda d: d > 0) AS given FROM p),
  g AS (SELECT *, CASE WHEN contains(name, '板') THEN l * w WHEN contains(name, '墙') OR contains(lower(name), 'wall') THEN l * h
      WHEN contains(name, '梁') OR contains(lower(name), 'beam') OR contains(name, '柱') OR contains(lower(name), 'column') THEN w * h
      ELSE coalesce(list_reverse_sort(given)[1] * list_reverse_sort(given)[2], 0) END AS area,
    CASE WHEN contains(name, '板') THEN l * w * CASE WHEN t != 0 THEN t ELSE h END WHEN contains(name, '墙') OR contains(lower(name), 'wall') THEN l * h * CASE WHEN t != 0 THEN t ELSE w END
      WHEN contains(name, '梁') OR contains(lower(name), 'beam') THEN l * w * h WHEN contains(name, '柱') OR contains(lower(name), 'column') THEN w * h * CASE WHEN l != 0 THEN l ELSE t END
      ELSE coalesce(given[1] * given[2] * given[3], 0) END AS volume FROM f)"""
_MM = "CASE WHEN {1} > 0 THEN '{0}' || round({1} * 1000)::BIGINT END"
_DRAWN = """e AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size * 60 END::DOUBLE AS w, (p_size * 30)::DOUBLE AS h, (p_size * CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 20 END)::DOUBLE AS l FROM part),
  k AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN CASE WHEN w < 1000 AND h < 1000 THEN '柱' WHEN l > w AND l > h THEN '梁' ELSE '板' END END AS kind FROM e),
  d AS (SELECT p_partkey, kind, CASE WHEN kind = '板' THEN 'area' WHEN kind IS NOT NULL THEN 'volume' END AS measure,
    round(CASE WHEN kind = '板' THEN w * l / 1e6 WHEN kind IS NOT NULL THEN w * h * l / 1e9 END, 3) AS value, CASE WHEN kind IS NULL THEN 'no size' END AS error FROM k)"""
_CHECKS = """c AS (SELECT p_partkey, p_partkey % 17 = 0 AS no_id, p_partkey % 19 = 0 AS no_type, (p_size - 2) / 45 AS confidence, p_partkey % 23 = 0 AS words, p_size - 3 AS quantity FROM part),
  x AS (SELECT p_partkey, concat_ws(';', CASE WHEN no_id THEN 'no_id' END, CASE WHEN no_type THEN 'no_type' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN words THEN 'quantity' END) AS errors,
    CASE WHEN NOT words AND quantity <= 0 THEN 'small_quantity' ELSE '' END AS warnings FROM c)"""
ORACLES = {
    "quantity_items": f"WITH {_ITEMS} SELECT * FROM i",
    "stored_quantities": f"""WITH {_ITEMS}, j AS (SELECT *, (l_orderkey * 8 + l_linenumber) % 11 AS o, CASE WHEN (l_orderkey * 8 + l_linenumber) % 3 != 0 THEN pieces ELSE 1 END::DOUBLE AS quantity FROM v)
      SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o NOT BETWEEN 1 AND 6 THEN kind END AS kind, CASE WHEN o NOT BETWEEN 1 AND 6 THEN round(volume / pieces * quantity, 9) END AS volume, CASE WHEN o NOT BETWEEN 1 AND 6 THEN round(area / pieces * quantity, 9) END AS area,
      CASE WHEN o NOT BETWEEN 1 AND 6 THEN quantity END AS quantity, CASE WHEN o IN (1, 6) THEN 'not readable' WHEN o IN (2, 3) THEN 'not an object' WHEN o IN (4, 5) THEN 'no text' WHEN kind = 'unknown' THEN 'no rule' WHEN volume IS NULL THEN 'dimension missing' END AS error FROM j""",
    "quantity_rollup": f"""WITH {_ITEMS} SELECT kind, count(*) AS found, count(volume) AS n, round(coalesce(sum(volume), 0.0), 3) AS volume, round(coalesce(sum(area), 0.0), 3) AS area,
      coalesce(sum(pieces) FILTER (volume IS NOT NULL), 0.0)::DOUBLE AS pieces FROM i GROUP BY ROLLUP (kind)""",
    "standard_rule_quantities": f"WITH {_STD} SELECT drawing_id, ord, material, round(quantity, 6) AS quantity, unit, compliant, array_to_string(notes, ';') AS notes FROM s",
    "standard_summary": f"""WITH {_STD} SELECT component_type, count(*) AS n, round(sum(quantity), 2) AS total, round(avg(quantity), 4) AS mean, CASE WHEN grouping(component_type) = 0 THEN min(unit) END AS unit,
      count(*) FILTER (compliant) AS compliant, round(avg(compliant::INT), 6) AS rate, count(DISTINCT component_type) AS types FROM s GROUP BY ROLLUP (component_type)""",
    "total_by_unit": f"WITH {_STD} SELECT unit, round(sum(quantity), 2) AS total FROM s GROUP BY 1",
    "noncompliance_report": f"WITH {_STD} SELECT component_type, drawing_id, ord, material, array_to_string(notes, ';') AS notes FROM s WHERE NOT compliant",
    "notes_array": f"WITH {_STD} SELECT component_type, note, count(*) AS n FROM (SELECT component_type, unnest(notes) AS note FROM s) GROUP BY ALL",
    "priced_summary": f"SELECT kind, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 1) AS price FROM (SELECT *, {_KIND.format(_NAME.replace('p_partkey', 'l_partkey'))} AS kind FROM lineitem) GROUP BY ROLLUP (kind)",
    "plain_measures": f"""WITH {_PLAIN} SELECT p_partkey, round(area, 6) AS area, round(volume, 6) AS volume,
      coalesce(nullif(concat_ws('×', {_MM.format('L', 'l')}, {_MM.format('W', 'w')}, {_MM.format('H', 'h')}, CASE WHEN t != h THEN {_MM.format('T', 't')} END), ''), '-') AS label FROM g""",
    "quantity_display": f"WITH {_PLAIN} SELECT {_KIND.format('name')} AS kind, count(*) AS n, round(sum(area), 2) AS area, round(sum(volume), 3) AS volume FROM g GROUP BY 1 ORDER BY n DESC, kind",
    "drawn_parts": f"WITH {_DRAWN} SELECT * FROM d",
    "drawn_summary": f"WITH {_DRAWN} SELECT kind, count(*) AS n, count(error) AS failed, round(coalesce(sum(value), 0.0), 3) AS value, min(measure) AS measure FROM d GROUP BY 1",
    "component_checks": f"WITH {_CHECKS} SELECT p_partkey, errors, warnings, errors = '' AS valid FROM x",
    "validation_rate": f"WITH {_CHECKS} SELECT count(*) AS n, count(*) FILTER (errors = '') AS valid, round(coalesce(avg((errors = '')::INT), 0.0), 6) AS rate FROM x",
}
