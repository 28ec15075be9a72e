"""Quantities by rules that a table holds as formula text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions.formulas import FormulaError, formula
from graniteflow.session import table

#: Kind, measure, unit, formula and parameters (constants, and defaults of names with ``_default``).
RULES = [
    ("column", "volume", "m³", "length * width * height", {"density_factor": 1.0}), ("beam", "volume", "m³", "length * width * height", {"density_factor": 1.0}),
    ("slab", "area", "m²", "length * width", {"thickness_default": 0.12}), ("wall", "area", "m²", "length * height", {"thickness_default": 0.2}),
    ("foundation", "volume", "m³", "length * width * depth", {"depth_default": 1.5}), ("stair", "area", "m²", "projected_area * step_factor", {"step_factor": 1.3}),
]
#: templates' rules for measures in millimetres (an area of slabs in square metres).
TEMPLATES = [
    ("beam", "volume", "m³", "width * height * length / 1000000000", {}), ("beam", "area", "m²", "2 * (width + height) * length / 1000000", {}), ("column", "volume", "m³", "width * depth * height / 1000000000", {}),
    ("column", "area", "m²", "2 * (width + depth) * height / 1000000", {}), ("wall", "volume", "m³", "thickness * length * height / 1000000000", {}), ("wall", "area", "m²", "length * height / 1000000", {}),
    ("slab", "volume", "m³", "area * thickness / 1000", {}), ("slab", "area", "m²", "area", {}),
]
SCHEMA = "kind string, measure string, unit string, formula string, parameters map<string,double>"
#: Rules that a driver may read: a rule is a branch of one expression.
MOST = 2000
NO_UNIT = "个"


def rule_quantities(rows: DataFrame, rules: DataFrame, names: list[str]) -> DataFrame:
    """rows (kind and the columns ``names``) with measure, unit, quantity and error, a row for each rule of the row's kind.

    rules: kind, measure, unit, formula, parameters. A formula may name the columns and the parameters; a column that
    is null has the parameter ``<name>_default``, if there is one. A rule whose formula can't be read gives its reason in
    error and no quantity; a kind without a rule (or null) gives quantity 0 and the unit for pieces. Of rules of one kind and
    measure the first by formula counts. Raises if there are over ``MOST`` rules, as they are one expression.
    """
    read = rules.groupBy("kind", "measure").agg(F.min_by(F.struct("unit", "formula", "parameters"), F.coalesce("formula", F.lit(""))).alias("r")).limit(MOST + 1).orderBy("kind", "measure").collect()
    if len(read) > MOST:
        raise ValueError(f"over {MOST} rules")
    by_kind: dict[str, list] = {}
    for row in read:
        given = row["r"]["parameters"] or {}
        known = {n: F.coalesce(F.col(n).cast("double"), F.lit(given.get(f"{n}_default"))) if given.get(f"{n}_default") is not None else F.col(n) for n in names}
        known |= {n: F.lit(v) for n, v in given.items() if v is not None and n not in names}
        try:
            value, error = formula(row["r"]["formula"] or "", known), F.lit(None).cast("string")
        except FormulaError as problem:
            value, error = F.lit(None).cast("double"), F.lit(str(problem))
        by_kind.setdefault(row["kind"], []).append(F.struct(F.lit(row["measure"]).alias("measure"), F.lit(row["r"]["unit"]).alias("unit"), value.alias("quantity"), error.alias("error")))
    found = F.array(F.struct(F.lit(None).cast("string").alias("measure"), F.lit(NO_UNIT).alias("unit"), F.lit(0.0).alias("quantity"), F.lit(None).cast("string").alias("error")))
    for kind, structs in by_kind.items():
        if kind is not None:
            found = F.when(F.col("kind") == kind, F.array(*structs)).otherwise(found)
    return rows.select("*", F.inline(found))


def _measured(spark: SparkSession, sf_dir: str, kinds: list[str], scale: float) -> DataFrame:
    line = F.col("l_linenumber")
    at = lambda c, n: (F.col(c) % n) * scale
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.get(F.array(*map(F.lit, kinds)), (F.col("l_partkey") % len(kinds)).cast("int")).alias("kind"), F.when(line != 7, F.col("l_quantity") * scale).alias("length"), at("l_suppkey", 9).alias("width"),
        at("l_partkey", 7).alias("height"), F.when(line % 2 == 0, at("l_orderkey", 3)).alias("depth"), F.col("l_extendedprice").alias("projected_area"), F.when(line % 3 != 0, at("l_suppkey", 4)).alias("thickness"), (F.col("l_quantity") * 1.5).alias("area"),
    )


NAMES = ["length", "width", "height", "depth", "projected_area", "thickness", "area"]


def formula_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item's quantity by the rule of its kind; two kinds have rules that can't be read, one has none."""
    bad = [("ramp", "area", "m²", "length * (width", {}), ("tank", "volume", "m³", "__import__('os')", {}), ("share", "ratio", "", "length / (width - depth) - -1", {"depth_default": 2.0})]
    rules = spark.createDataFrame(RULES + bad, SCHEMA)
    out = rule_quantities(_measured(spark, sf_dir, ["column", "beam", "slab", "wall", "foundation", "stair", "ramp", "tank", "share", "other"], 1.0), rules, NAMES)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "kind", "unit", F.round("quantity", 6).alias("quantity"), "error")


def template_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and area of every line item by the templates, from millimetres."""
    out = rule_quantities(_measured(spark, sf_dir, ["beam", "column", "wall", "slab"], 100.0), spark.createDataFrame(TEMPLATES, SCHEMA), NAMES)
    return out.groupBy("kind", "measure", "unit").agg(F.count("*").alias("n"), F.count("quantity").alias("known"), F.round(F.sum("quantity"), 3).alias("quantity"))


QUERIES = {f.__name__: f for f in (formula_quantities, template_quantities)}


def _sql(kinds: str, scale: str) -> str:
    return f"""m AS (SELECT l_orderkey, l_linenumber, l_extendedprice, {kinds}[l_partkey % len({kinds}) + 1] AS kind, CASE WHEN l_linenumber != 7 THEN l_quantity * {scale} END AS length, (l_suppkey % 9 * {scale})::DOUBLE AS width, (l_partkey % 7 * {scale})::DOUBLE AS height,
      CASE WHEN l_linenumber % 2 = 0 THEN (l_orderkey % 3 * {scale})::DOUBLE END AS depth, l_extendedprice AS projected_area, CASE WHEN l_linenumber % 3 != 0 THEN (l_suppkey % 4 * {scale})::DOUBLE END AS thickness, l_quantity * 1.5::DOUBLE AS area FROM lineitem)"""


ORACLES = {
    "formula_quantities": f"""WITH {_sql("['column', 'beam', 'slab', 'wall', 'foundation', 'stair', 'ramp', 'tank', 'share', 'other']", "1")}
      SELECT l_orderkey, l_linenumber, l_extendedprice, kind, CASE kind WHEN 'column' THEN 'm³' WHEN 'beam' THEN 'm³' WHEN 'foundation' THEN 'm³' WHEN 'tank' THEN 'm³' WHEN 'share' THEN '' WHEN 'other' THEN '个' ELSE 'm²' END AS unit,
        round(CASE kind WHEN 'column' THEN length * width * height WHEN 'beam' THEN length * width * height WHEN 'slab' THEN length * width WHEN 'wall' THEN length * height WHEN 'foundation' THEN length * width * coalesce(depth, 1.5::DOUBLE)
          WHEN 'stair' THEN projected_area * 1.3::DOUBLE WHEN 'share' THEN length / nullif(width - coalesce(depth, 2.0::DOUBLE), 0) + 1 WHEN 'other' THEN 0 END, 6) AS quantity,
        CASE kind WHEN 'ramp' THEN 'bracket isn''t closed' WHEN 'tank' THEN 'unexpected character at 12: ''' END AS error FROM m""",
    "template_quantities": f"""WITH {_sql("['beam', 'column', 'wall', 'slab']", "100")}, v AS (SELECT kind, 'volume' AS measure, CASE kind WHEN 'beam' THEN width * height * length / 1e9 WHEN 'column' THEN width * depth * height / 1e9 WHEN 'wall' THEN thickness * length * height / 1e9 ELSE area * thickness / 1000 END AS q FROM m
        UNION ALL SELECT kind, 'area', CASE kind WHEN 'beam' THEN 2 * (width + height) * length / 1e6 WHEN 'column' THEN 2 * (width + depth) * height / 1e6 WHEN 'wall' THEN length * height / 1e6 ELSE area END FROM m)
      SELECT kind, measure, CASE measure WHEN 'volume' THEN 'm³' ELSE 'm²' END AS unit, count(*) AS n, count(q) AS known, round(sum(q), 3) AS quantity FROM v GROUP BY ALL""",
}
