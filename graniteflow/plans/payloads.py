"""Payloads of recognition: components from answers of several shapes, defaults, validation, fallbacks, reuse, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.plans.tiling import REGIONS_SQL, regions
from graniteflow.session import table

#: Box of a component without one, words that a prose answer is searched for, confidences of what is made of prose and of unknown ones.
NO_BOX = (0.0, 0.0, 100.0, 50.0)
KEYWORDS = ["column", "beam", "slab", "wall", "foundation", "stair"]
PROSE_CONFIDENCE, DESCRIBED_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.6, 0.5, 0.8


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each part, as JSON: its box as a list, under location, under geometry as x, y, width and height, or nowhere."""
    key = F.col("p_partkey")
    num = lambda c: c.cast("string")
    box = F.when(key % 4 == 0, F.concat(F.lit(', "bbox": ['), num(key), F.lit(", 2, 30, 40]"))).when(key % 4 == 1, F.concat(F.lit(', "location": {"bbox": ['), num(key), F.lit(", 5, 60, 70]}"))).when(
        key % 4 == 2, F.concat(F.lit(', "geometry": {"bbox": {"x": '), num(key), F.lit(', "y": 8, "width": 10, "height": 20}}'))
    ).otherwise("")
    confidence = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(', "confidence": 0.'), num(key % 9 + 1)))
    text = F.concat(F.lit('{"id": "'), F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("C-"), num(key))), F.lit('"'), box, confidence, F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", text.alias("answer"))


def payload_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer's component: id, confidence and box, looked up in each place in turn; sizes become far corners, a missing box the default."""
    v = F.try_parse_json("answer")
    at = lambda path: F.try_variant_get(v, path, "double")
    lists = ["$.bbox", "$.location.bbox", "$.geometry.bbox"]
    from_list = lambda i: [at(f"{p}[{i}]") for p in lists]
    x, y = at("$.geometry.bbox.x"), at("$.geometry.bbox.y")
    corner = [x, y, x + at("$.geometry.bbox.width"), y + at("$.geometry.bbox.height")]
    box = [F.coalesce(*from_list(i), corner[i], F.lit(NO_BOX[i])).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    name = F.coalesce(F.nullif(F.try_variant_get(v, "$.id", "string"), F.lit("")), F.concat(F.lit("slice_comp_"), "p_partkey"))
    return answers(spark, sf_dir).select("p_partkey", name.alias("id"), F.coalesce(at("$.confidence"), F.lit(UNKNOWN_CONFIDENCE)).alias("confidence"), *box)


def brand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand's components: number, mean confidence (0.8 where unknown), id prefixes, and a warning for more than ten of these."""
    rows = payload_boxes(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    prefixes = F.count_distinct(F.substring_index("id", "-", 1))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("confidence"), F.lit(UNKNOWN_CONFIDENCE)), 6).alias("confidence"), prefixes.alias("prefixes"), (prefixes > 10).alias("warning"))


def prose_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that prose answers name by a keyword, else one component for the description alone."""
    kind = F.get(F.array(*map(F.lit, [*KEYWORDS, "nothing", "beam and column"])), (F.col("p_partkey") % 8).cast("int"))
    found = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower(kind), k))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("description"))).alias("kinds"))
    rows = rows.select("p_partkey", F.posexplode("kinds").alias("place", "kind"))
    return rows.select("p_partkey", "place", "kind", F.when(F.col("kind") == "description", DESCRIBED_CONFIDENCE).otherwise(PROSE_CONFIDENCE).alias("confidence"))


def tile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sheet the last region for each of its tiles' keys; the last one given wins."""
    return regions(spark, sf_dir).groupBy("sheet", F.concat_ws("_", F.col("id") % 7, F.col("id") % 5).alias("tile")).agg(F.max("id").alias("id"), F.max_by("text", "id").alias("text"))


def provenance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What regions lack of their provenance, and the share of those of a sheet that lack nothing."""
    lacks = F.array_compact(F.array(F.when(F.col("id") % 7 == 0, "source_slice"), F.when(F.col("id") % 11 == 0, "coordinates")))
    rows = regions(spark, sf_dir).select("sheet", lacks.alias("lacks"))
    return rows.groupBy("sheet").agg(F.count("*").alias("n"), F.sum(F.size("lacks")).alias("issues"), F.round(F.avg((F.size("lacks") == 0).cast("double")), 6).alias("rate"))


def last_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the last assistant turn, how many there are, and whether the step that it stands for is complete."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("answers"), F.sum(F.length("text")).alias("characters"))
    grade = F.when(F.col("answers") >= 4, "good").when(F.col("answers") >= 3, "fair").otherwise("limited")
    return rows.select("conv_id", "turn", "answers", "characters", grade.alias("grade"))


def batches_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user's successful batches; of users without one, all: a success counts as one."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("good"), F.count("*").alias("all"))
    return rows.select("user_id", F.when(F.col("good") > 0, F.col("good")).otherwise(F.col("all")).alias("n"), (F.col("good") == 0).alias("fallback"))


def with_global_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by tile with one tile more for texts of the whole sheet, at offset 0; empty texts are left out."""
    rows = regions(spark, sf_dir)
    own = rows.where("id % 4 != 0").select("sheet", (F.col("id") % 4).cast("string").alias("tile"), (F.col("id") % 4 * 500).alias("offset"), F.trim("text").alias("text"))
    whole = rows.where("id % 4 = 0").select("sheet", F.lit("global").alias("tile"), F.lit(0).cast("long").alias("offset"), F.trim("text").alias("text"))
    return own.unionByName(whole).where("text != ''").groupBy("sheet", "tile").agg(F.count("*").alias("n"), F.max("offset").alias("offset"), F.sum(F.length("text")).alias("characters"))


def reuse_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with a cached result of their own, by the whole sheet's, or to be computed, counted, and the share reused."""
    cached = F.when(F.col("id") % 3 == 0, "own").when(F.col("sheet") % 2 == 0, "global").otherwise("computed")
    return regions(spark, sf_dir).groupBy("sheet").agg(*[F.count_if(cached == k).alias(k) for k in ("own", "global", "computed")], F.round(F.avg((cached != "computed").cast("double")), 6).alias("reused"))


def filled_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's array of components with required fields filled in, and the first dimension for those without any."""
    key = F.col("s_suppkey")
    item = lambda i: F.struct(F.when(i % 2 == 0, F.concat(F.lit("K"), i)).alias("id"), F.when(i % 3 == 0, i * 1.5).alias("size"))
    items = F.transform(F.sequence(F.lit(1), (key % 5 + 1).cast("int")), item)
    first = F.get(F.filter(F.transform(items, lambda x: x["size"]), lambda s: s.isNotNull()), F.lit(0))
    whole = F.transform(items, lambda x: F.struct(F.coalesce(x["id"], F.lit("unknown")).alias("id"), F.coalesce(x["size"], first, F.lit(0.0)).alias("size")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(whole, lambda x: F.concat(x["id"], F.lit(":"), F.round(x["size"] * 10).cast("int"))), ";").alias("items"))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sheet a line of its first eight codes, of its kinds, and its number of regions."""
    rows = regions(spark, sf_dir)
    codes = rows.groupBy("sheet", "text").agg(F.min("id").alias("id")).withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy("id"))).where("place <= 8")
    top = codes.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "、").alias("codes"))
    kinds = rows.groupBy("sheet").agg(F.array_join(F.array_sort(F.collect_set("kind")), "、").alias("kinds"), F.count("*").alias("n"))
    return top.join(kinds, "sheet").select("sheet", F.concat_ws("；", "codes", "kinds", F.concat(F.lit("共"), "n")).alias("line"), "n")


def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each sheet's kind: a region begins one when its top is 10 pixels and more below the one before; a block needs two lines."""
    order = Window.partitionBy("sheet", "kind").orderBy("y1", "x1", "id")
    new = F.coalesce(F.abs(F.col("y1") - F.lag("y1").over(order)) >= 10, F.lit(True)).cast("int")
    rows = regions(spark, sf_dir).withColumn("new", new)
    return rows.groupBy("sheet", "kind").agg(F.sum("new").alias("lines"), F.count("*").alias("cells")).withColumn("block", F.col("lines") >= 2)


def pipeline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages each order has gone through, and what is to be done next."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("components"), F.sum("l_quantity").alias("quantity"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    has = {"recognised": F.col("components").isNotNull(), "counted": F.coalesce(F.col("quantity") > 100, F.lit(False)), "finished": F.col("o_orderstatus") == "F"}
    todo = F.array_compact(F.array(*[F.when(~test, name) for name, test in has.items()]))
    return rows.groupBy(*[test.alias(name) for name, test in has.items()], F.array_join(todo, ",").alias("todo")).agg(F.count("*").alias("n"))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stored result is read from by its path, and which of them have none; a task done wholly can't be cancelled."""
    key = F.col("o_orderkey")
    path = F.when(key % 4 == 0, F.concat(F.lit("file:///r/"), key, F.lit(".json"))).when(key % 4 == 1, F.concat(F.lit("https://h/"), key, F.lit(".txt"))).when(key % 4 == 2, F.concat(F.lit("r/"), key, F.lit(".json")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", path.alias("path"))
    source = F.when(F.col("path").isNull(), "missing").when(F.col("path").startswith("file://"), "file").when(F.col("path").rlike("^https?://"), "web").otherwise("store")
    form = F.when(F.col("path").endswith(".json"), "json").when(F.col("path").endswith(".txt"), "text").otherwise("none")
    cancel = ~((F.col("o_orderstatus") == "F") & (key % 2 == 0))
    return rows.groupBy(source.alias("source"), form.alias("form"), cancel.alias("cancellable")).agg(F.count("*").alias("n"))


def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions before and after merging equal texts on each sheet, and the share that went."""
    rows = regions(spark, sf_dir).groupBy("sheet", "text").agg(F.count("*").alias("k"))
    sums = rows.groupBy("sheet").agg(F.sum("k").alias("before"), F.count("*").alias("after"))
    return sums.select("sheet", "before", "after", F.round(1 - F.col("after") / F.col("before"), 6).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        payload_boxes, brand_context, prose_components, tile_map, provenance_checks, last_answers, batches_or_all, with_global_tile, reuse_counters, filled_arrays, summary_lines, table_blocks,
        pipeline_audit, stored_results, merge_metadata,
    )
}
_BOX = """b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 = 0 THEN 'slice_comp_' || p_partkey ELSE 'C-' || p_partkey END AS id, CASE WHEN p_partkey % 5 = 0 THEN 0.8 ELSE ('0.' || (p_partkey % 9 + 1))::DOUBLE END::DOUBLE AS confidence,
    CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_partkey END::DOUBLE AS x1, [2, 5, 8, 0][p_partkey % 4 + 1]::DOUBLE AS y1, CASE WHEN p_partkey % 4 = 2 THEN p_partkey + 10 ELSE [30, 60, 0, 100][p_partkey % 4 + 1] END::DOUBLE AS x2,
    [40, 70, 28, 50][p_partkey % 4 + 1]::DOUBLE AS y2 FROM part)"""
ORACLES = {
    "payload_boxes": f"WITH {_BOX} SELECT * EXCLUDE (p_brand) FROM b",
    "brand_context": f"WITH {_BOX} SELECT p_brand, count(*) AS n, round(avg(confidence), 6) AS confidence, count(DISTINCT split_part(id, '-', 1)) AS prefixes, count(DISTINCT split_part(id, '-', 1)) > 10 AS warning FROM b GROUP BY 1",
    "prose_components": f"""WITH k AS (SELECT p_partkey, list_filter({KEYWORDS}, lambda k: contains({[*KEYWORDS, 'nothing', 'beam and column']}[p_partkey % 8 + 1], k)) AS f FROM part), l AS (SELECT p_partkey, CASE WHEN len(f) > 0 THEN f ELSE ['description'] END AS f FROM k)
      SELECT p_partkey, (i - 1)::INT AS place, f[i] AS kind, CASE WHEN f[i] = 'description' THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM l, unnest(range(1, len(f) + 1)) AS u(i)""",
    "tile_map": f"WITH {REGIONS_SQL} SELECT sheet, id % 7 || '_' || id % 5 AS tile, max(id) AS id, arg_max(text, id) AS text FROM r GROUP BY sheet, 2",
    "provenance_checks": f"WITH {REGIONS_SQL} SELECT sheet, count(*) AS n, sum((id % 7 = 0)::INT + (id % 11 = 0)::INT)::BIGINT AS issues, round(avg((id % 7 != 0 AND id % 11 != 0)::INT), 6) AS rate FROM r GROUP BY 1",
    "last_answers": """SELECT conv_id, turn, answers, characters, CASE WHEN answers >= 4 THEN 'good' WHEN answers >= 3 THEN 'fair' ELSE 'limited' END AS grade
      FROM (SELECT conv_id, max(turn) AS turn, count(*) AS answers, sum(length(text))::BIGINT AS characters FROM conversations WHERE role = 'assistant' GROUP BY 1)""",
    "batches_or_all": "SELECT user_id, CASE WHEN good > 0 THEN good ELSE whole END AS n, good = 0 AS fallback FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS good, count(*) AS whole FROM events GROUP BY 1)",
    "with_global_tile": f"""WITH {REGIONS_SQL} SELECT sheet, CASE WHEN id % 4 = 0 THEN 'global' ELSE (id % 4)::VARCHAR END AS tile, count(*) AS n, max(id % 4 * 500) AS "offset", sum(length(text))::BIGINT AS characters FROM r GROUP BY sheet, 2""",
    "reuse_counters": f"""WITH {REGIONS_SQL}, c AS (SELECT sheet, CASE WHEN id % 3 = 0 THEN 'own' WHEN sheet % 2 = 0 THEN 'global' ELSE 'computed' END AS c FROM r)
      SELECT sheet, count(*) FILTER (c = 'own') AS own, count(*) FILTER (c = 'global') AS "global", count(*) FILTER (c = 'computed') AS computed, round(avg((c != 'computed')::INT), 6) AS reused FROM c GROUP BY 1""",
    "filled_arrays": """WITH l AS (SELECT s_suppkey, s_suppkey % 5 + 1 AS n FROM supplier) SELECT s_suppkey, (SELECT string_agg(CASE WHEN i % 2 = 0 THEN 'K' || i ELSE 'unknown' END || ':' || CASE WHEN i % 3 = 0 THEN i * 15 WHEN n >= 3 THEN 45 ELSE 0 END, ';' ORDER BY i)
      FROM unnest(range(1, n + 1)) AS u(i)) AS items FROM l""",
    "summary_lines": f"""WITH {REGIONS_SQL}, t AS (SELECT sheet, text, row_number() OVER (PARTITION BY sheet ORDER BY min(id)) AS place FROM r GROUP BY sheet, text), c AS (SELECT sheet, string_agg(text, '、' ORDER BY place) AS codes FROM t WHERE place <= 8 GROUP BY 1)
      SELECT sheet, codes || '；' || string_agg(DISTINCT kind, '、' ORDER BY kind) || '；共' || count(*) AS line, count(*) AS n FROM r JOIN c USING (sheet) GROUP BY sheet, codes""",
    "table_blocks": f"""WITH {REGIONS_SQL}, f AS (SELECT sheet, kind, coalesce(abs(y1 - lag(y1) OVER (PARTITION BY sheet, kind ORDER BY y1, x1, id)) >= 10, true)::INT AS new FROM r)
      SELECT sheet, kind, sum(new)::BIGINT AS lines, count(*) AS cells, sum(new) >= 2 AS block FROM f GROUP BY ALL""",
    "pipeline_audit": """WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), a AS (SELECT l_orderkey IS NOT NULL AS recognised, coalesce(q > 100, false) AS counted, o_orderstatus = 'F' AS finished FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
      SELECT recognised, counted, finished, concat_ws(',', CASE WHEN NOT recognised THEN 'recognised' END, CASE WHEN NOT counted THEN 'counted' END, CASE WHEN NOT finished THEN 'finished' END) AS todo, count(*) AS n FROM a GROUP BY ALL""",
    "stored_results": """SELECT ['file', 'web', 'store', 'missing'][o_orderkey % 4 + 1] AS source, ['json', 'text', 'json', 'none'][o_orderkey % 4 + 1] AS form, NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS cancellable, count(*) AS n FROM orders GROUP BY ALL""",
    "merge_metadata": f"WITH {REGIONS_SQL} SELECT sheet, count(*) AS before, count(DISTINCT text) AS after, round(1 - count(DISTINCT text) / count(*), 6) AS rate FROM r GROUP BY 1",
}
