"""Stored results of any shape as rows: paths and values, what is left without empty ones, and lines of recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.operators.variants import assembled, flattened, pruned, recognised_lines
from graniteflow.session import spread, table


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's stored result in one of three shapes: components, regions, or quantities six levels deep; some are empty in places."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("int").cast("string")
    empty = F.when(F.col("p_partkey") % 5 == 0, '""').when(F.col("p_partkey") % 5 == 1, "null").when(F.col("p_partkey") % 5 == 2, "{}").when(F.col("p_partkey") % 5 == 3, "[]").otherwise(F.concat(F.lit('{"a":'), key, F.lit("}")))
    # fmt: off
    shapes = [
        ['{"final_components":[{"id":"KZ-', key, '","size":', size, ',"note":', empty, '},null,{"id":"","more":', empty, "}]}"],
        ['{"text_regions":[[', size, ",[", key, ',"t ', size, '"]],', empty, '],"all text":"', key, '","ok":true}'],
        ['{"qto_data":{"components":[{"parts":{"list":[', key, ",", empty, '],"none":null,"in":{"only":', empty, "}}}],\"n\":", size, "}}"],
    ]
    # fmt: on
    made = [F.concat(*[F.lit(p) if isinstance(p, str) else p for p in shape]) for shape in shapes]
    which = F.col("p_partkey") % 3
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.when(which == 0, made[0]).when(which == 1, made[1]).otherwise(made[2]).alias("doc"))


def flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every stored result: path, kind and value."""
    out = flattened(stored(spark, sf_dir), "doc", ["p_partkey"])
    kind = F.when(F.col("kind").isin("bigint", "string", "boolean", "object", "array", "null"), F.col("kind")).otherwise("number")
    return out.select("p_partkey", "path", kind.alias("kind"), "value", "depth")


def pruned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored result without empty values, as text again, and how many nodes it has left."""
    left = pruned(flattened(stored(spark, sf_dir), "doc", ["p_partkey"]), ["p_partkey"])
    return assembled(left, ["p_partkey"], count="nodes")


def line_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recognition with boxes, from results in one list or two, with null lines between."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("int").cast("string")
    line = F.concat(F.lit("[[["), key, F.lit(",1],["), size, F.lit(",2],[3,"), size, F.lit(']],["T'), key, F.lit('",0.5]]'))
    lines = F.concat(F.lit("["), line, F.lit(",null,"), F.when(F.col("p_partkey") % 4 == 0, F.lit('["odd"]')).otherwise(line), F.lit("]"))
    docs = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, lines).otherwise(F.concat(F.lit("["), lines, F.lit("]"))).alias("doc"))
    return recognised_lines(docs, "doc", ["p_partkey"])


QUERIES = {f.__name__: f for f in (flat_results, pruned_results, line_results)}

_EMPTY = "CASE p_partkey % 5 WHEN 0 THEN '\"\"' WHEN 1 THEN 'null' WHEN 2 THEN '{}' WHEN 3 THEN '[]' ELSE '{\"a\":' || p_partkey || '}' END"
_STORED = f"""e AS (SELECT p_partkey, p_size::INT AS size, {_EMPTY} AS empty FROM part), d AS (SELECT p_partkey, size, empty, (CASE p_partkey % 3
    WHEN 0 THEN '{{"final_components":[{{"id":"KZ-' || p_partkey || '","size":' || size || ',"note":' || empty || '}},null,{{"id":"","more":' || empty || '}}]}}'
    WHEN 1 THEN '{{"text_regions":[[' || size || ',[' || p_partkey || ',"t ' || size || '"]],' || empty || '],"all text":"' || p_partkey || '","ok":true}}'
    ELSE '{{"qto_data":{{"components":[{{"parts":{{"list":[' || p_partkey || ',' || empty || '],"none":null,"in":{{"only":' || empty || '}}}}}}],"n":' || size || '}}}}' END)::JSON AS doc FROM e)"""
#: What stays of the empty value: in an object, and in an array (with its comma).
_MEMBER, _ITEM = "CASE WHEN p_partkey % 5 < 3 THEN '' ELSE {} END", "CASE WHEN p_partkey % 5 < 2 THEN '' ELSE ',' || empty END"
_M = lambda name, comma: _MEMBER.format(f"'{comma}\"{name}\":' || empty")
ORACLES = {
    "flat_results": f"""WITH {_STORED} SELECT p_partkey, fullkey AS path, CASE type WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(type) END AS kind,
      CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(atom, '$') END AS value, (len(regexp_extract_all(fullkey, '\\.("[^"]*"|[A-Za-z_0-9]+)|\\[')))::INT AS depth FROM d, json_tree(doc)""",
    "pruned_results": f"""WITH {_STORED}, t AS (SELECT p_partkey, CASE p_partkey % 3
        WHEN 0 THEN '{{"final_components":[{{"id":"KZ-' || p_partkey || '"' || {_M('note', ',')} || ',"size":' || size || '}},{{' || {_M('more', '')} || '}}]}}'
        WHEN 1 THEN '{{"all text":"' || p_partkey || '","ok":true,"text_regions":[[' || size || ',[' || p_partkey || ',"t ' || size || '"]]' || {_ITEM} || ']}}'
        ELSE '{{"qto_data":{{"components":[{{"parts":{{"in":{{' || {_M('only', '')} || '}},"list":[' || p_partkey || {_ITEM} || ']}}}}],"n":' || size || '}}}}' END AS doc FROM d)
      SELECT p_partkey, doc, (SELECT count(*) FROM json_tree(doc::JSON)) AS nodes FROM t""",
    "line_results": """WITH l AS (SELECT p_partkey, p_size::INT AS size, unnest([0, 2])::INT AS id FROM part)
      SELECT p_partkey, id, 'T' || p_partkey AS text, 0.5::DOUBLE AS confidence, least(p_partkey, size, 3)::DOUBLE AS x1, least(1, 2, size)::DOUBLE AS y1, greatest(p_partkey, size, 3)::DOUBLE AS x2, greatest(1, 2, size)::DOUBLE AS y2
      FROM l WHERE NOT (id = 2 AND p_partkey % 4 = 0)""",
}
