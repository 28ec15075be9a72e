"""Regions of drawings: tile look-ups with their defaults, first ones by key, lines of adjacent texts, corrections, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.functions import correction as c
from graniteflow.functions import geometry as g
from graniteflow.functions import marks as m
from graniteflow.operators.greedy import meeting
from graniteflow.plans.marks import PREFIXES, marked
from graniteflow.plans.tiling import REGIONS_SQL, regions
from graniteflow.session import parts

#: Tiles whose offsets are known, and the tile of a region.
KNOWN = 20


def tiles(spark: SparkSession) -> DataFrame:
    n = F.col("id").cast("int")
    return spark.range(KNOWN).select(F.floor(n / 5).cast("int").alias("row"), (n % 5).alias("col"), (n % 5 * 400).alias("ox"), (F.floor(n / 5) * 400).cast("int").alias("oy"))


def tile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by the first block of their tile key 'r_c + r_c': moved, unmoved or marked by zeros where the tile isn't known, with a default size."""
    key = F.concat(F.col("id") % 6, F.lit("_"), F.col("id") % 5, F.lit(" + 0_0"))
    first = F.split(F.split(key, r" \+ ")[0], "_")
    rows = regions(spark, sf_dir).select("id", "x1", "y1", first[0].try_cast("int").alias("row"), first[1].try_cast("int").alias("col")).join(F.broadcast(tiles(spark)), ["row", "col"], "left")
    known = F.col("ox").isNotNull()
    x = F.col("x1") + F.coalesce("ox", F.lit(0))
    return rows.select("id", x.alias("moved"), F.when(known, x).otherwise(0).alias("marked"), F.when(known, F.round(F.greatest(F.lit(0.0), F.least(x.cast("double"), F.lit(2000.0))), 2)).otherwise(F.col("x1").cast("double")).alias("clamped"), F.when(known, 500).otherwise(1024).alias("side"))


def known_tiles_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each known tile, counted; those of other tiles are skipped."""
    rows = regions(spark, sf_dir).select((F.col("id") % 6).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"))
    return rows.join(F.broadcast(tiles(spark)), ["row", "col"]).groupBy("row", "col").agg(F.count("*").alias("n"), F.min("ox").alias("ox"))


def first_three_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three regions by id, not the nearest, within 100 pixels of each region's centre, and on which side they lie."""
    rows = regions(spark, sf_dir).withColumns({"cx": g.centre("x1", "x2"), "cy": g.centre("y1", "y2")}).select("grp", "id", "cx", "cy", F.col("cx").alias("x1"), F.col("cy").alias("y1"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
    near = F.hypot(F.col("cx") - F.col("cx_"), F.col("cy") - F.col("cy_")) <= 100
    pairs = meeting(rows, near, reach=100, give={"dx": F.col("cx_") - F.col("cx"), "dy": F.col("cy_") - F.col("cy")})
    ways = F.array(F.struct("low", "high", "dx", "dy"), F.struct(F.col("high").alias("low"), F.col("low").alias("high"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")))
    both = pairs.select(F.inline(ways)).repartition(parts(spark), "low")
    order = Window.partitionBy("low").orderBy("high")
    return both.withColumn("place", F.row_number().over(order)).where("place <= 3").select(F.col("low").alias("id"), F.col("high").alias("near"), "place", m.beside(F.col("dx"), F.col("dy")).alias("side"))


def first_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code's first region: texts are looked up in the regions reduced to their first."""
    first = regions(spark, sf_dir).groupBy("text").agg(F.min("id").alias("region"), F.count("*").alias("n"))
    asked = marked(spark, sf_dir).select("p_partkey", F.regexp_replace("code", "-", "").alias("text"))
    return asked.join(first, "text", "left").select("p_partkey", "text", "region", F.coalesce("n", F.lit(0)).alias("n"))


def first_by_id_or_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region of each id, or of type and cell where it has none; both kinds of key share one space."""
    key = F.coalesce(F.when(F.col("id") % 3 == 0, F.col("text")), F.concat_ws("_", "kind", g.cell(F.col("x1")), g.cell(F.col("y1"))))
    return regions(spark, sf_dir).groupBy("sheet", key.alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def distinct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions distinct by text, place and size, and how many each stands for."""
    return regions(spark, sf_dir).groupBy("text", "x1", "y1", F.concat_ws("x", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("dims")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions dealt to a sheet's eight tiles in turn, by id: a sheet is a drawing, so its window is bounded."""
    order = Window.partitionBy("sheet").orderBy("id")
    return regions(spark, sf_dir).select("sheet", "id", F.pmod(F.row_number().over(order) - 1, F.lit(8)).alias("tile"))


def repeated_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a sheet whose row and column repeat one before: where each is put on a square grid by its number."""
    order = Window.partitionBy("sheet").orderBy("id")
    same = Window.partitionBy("sheet", "row", "col").orderBy("id")
    rows = regions(spark, sf_dir).select("sheet", "id", (F.col("id") % 7).alias("row"), (F.col("id") % 11).alias("col"))
    rows = rows.withColumns({"number": F.row_number().over(order) - 1, "again": F.row_number().over(same) > 1, "side": F.ceil(F.sqrt(F.count("*").over(Window.partitionBy("sheet")))).cast("int")})
    pick = lambda new, old: F.when(F.col("again"), new).otherwise(F.col(old)).cast("long")
    return rows.select("sheet", "id", "again", pick(F.floor(F.col("number") / F.col("side")), "row").alias("row"), pick(F.col("number") % F.col("side"), "col").alias("col"))


def lines_of(rows: DataFrame, near: int = 10, gap: int = 30) -> DataFrame:
    """sheet, place and line: texts joined to lines; one goes on a line if its top and height are within ``near`` pixels of the line's anchor and its gap to the last text is ``gap`` pixels at most.

    rows: sheet, id, text and a box, none of which is null. Regions go by top, left edge and id. The anchor is the last that began a line. A region
    more than ``near`` below the one before it, or more than ``gap`` to its right, begins a line whatever the anchor is (tops only grow), so
    a sheet falls into stretches at such regions; only a stretch is gathered, and folded for the breaks that depend on its anchors.
    """
    order = Window.partitionBy("sheet").orderBy("y1", "x1", "id")
    before = F.lag(F.struct("y1", "x2")).over(order)
    cut = F.coalesce((F.col("y1") - before["y1"] > near) | (F.col("x1") - before["x2"] > gap), F.lit(True))
    item = F.struct("y1", "x1", "id", "text", "x2", (F.col("y2") - F.col("y1")).alias("h"))
    cuts = rows.select("sheet", item.alias("item"), "y1", "x1", "id", cut.cast("long").alias("cut"))
    stretches = cuts.select("sheet", "item", F.sum("cut").over(order).alias("stretch")).groupBy("sheet", "stretch").agg(F.array_sort(F.collect_list("item")).alias("items"))
    begin = lambda r: F.struct(r["y1"].alias("y1"), r["x1"].alias("x1"), r["id"].alias("id"), r["h"].alias("h"), r["x2"].alias("end"), r["text"].alias("line"))

    def step(s: Column, r: Column) -> Column:
        line = s["line"]
        joins = (F.abs(r["y1"] - line["y1"]) <= near) & (F.abs(r["h"] - line["h"]) <= near) & (r["x1"] - line["end"] <= gap)
        longer = F.struct(line["y1"].alias("y1"), line["x1"].alias("x1"), line["id"].alias("id"), line["h"].alias("h"), r["x2"].alias("end"), F.concat_ws(" ", line["line"], r["text"]).alias("line"))
        return F.when(joins, F.struct(s["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(F.concat(s["done"], F.array(line)).alias("done"), begin(r).alias("line")))

    first = begin(F.col("items")[0])
    start = F.struct(F.slice(F.array(first), 1, 0).alias("done"), first.alias("line"))
    lines = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, step, lambda s: F.concat(s["done"], F.array(s["line"])))
    whole = stretches.select("sheet", F.inline(lines))
    return whole.select("sheet", (F.row_number().over(order) - 1).alias("place"), "line")


def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each sheet joined to lines, numbered from 0."""
    return lines_of(regions(spark, sf_dir))


def texts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of each sheet's kind in the order in which they first stand, joined by blank lines."""
    first = regions(spark, sf_dir).groupBy("sheet", "kind", "text").agg(F.min("id").alias("id"))
    return first.groupBy("sheet", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n\n").alias("texts"), F.count("*").alias("n"))


def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by text type: number, how many lie at their tile's edge, share, weight."""
    kind = m.wide_type(F.col("text"))
    rows = regions(spark, sf_dir).select(kind.alias("type"), (F.col("id") % 4 == 0).alias("edge"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if("edge").alias("edges"), F.round(F.avg(F.col("edge").cast("double")), 6).alias("share"), F.max(m.importance(F.col("type"))).alias("weight"))


def attribute_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text's regions the share of pairs whose kinds agree, and of its sizes: counted from how often each value stands, without pairs."""
    pairs = lambda n: n * (n - 1) / 2

    def agreeing(value: Column) -> DataFrame:
        counts = regions(spark, sf_dir).groupBy("text", value.alias("value")).agg(F.count("*").alias("k"))
        return counts.groupBy("text").agg(F.sum(pairs(F.col("k"))).alias("same"), F.sum("k").alias("n"))

    a, b = agreeing(F.col("kind")), agreeing(F.col("size") % 3).select("text", F.col("same").alias("same_size"))
    share = F.coalesce(F.try_divide(F.col("same") + F.col("same_size"), 2 * pairs(F.col("n"))), F.lit(0.0))
    return a.join(b, "text").select("text", "n", F.round(share, 6).alias("agreement"), F.round(share * 0.1, 6).alias("bonus"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, sizes and grades as recognition spoils them."""
    key = F.col("p_partkey")
    text = F.when(key % 4 == 0, F.concat(F.lit("KLL"), key % 30)).when(key % 4 == 1, F.concat(key % 50 + 100, F.lit(" x "), key % 70 + 100, F.lit("mm"))).when(key % 4 == 2, F.concat(F.lit("c3"), key % 10, F.lit(" HRB401"))).otherwise("钢筯混凝土 平面图")
    return marked(spark, sf_dir).select("p_partkey", text.alias("text"), F.round(key % 100 / 100, 2).alias("confidence"))


def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spoilt text corrected, with the kinds of corrections and a confidence."""
    rows = c.with_corrections(damaged(spark, sf_dir))
    return rows.select("p_partkey", "text", "corrected", F.array_join("kinds", ",").alias("kinds"), F.round("corrected_confidence", 6).alias("confidence"))


def context_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and words with confusable characters, put right where their neighbours ask for it."""
    key = F.col("p_partkey")
    text = F.when(key % 5 == 0, F.concat(F.lit("1O"), key % 40, F.lit("S"))).when(key % 5 == 1, F.concat(F.lit("K8L"), key % 90)).when(key % 5 == 2, F.concat(F.lit("粱"), key % 7, F.lit("住"))).when(key % 5 == 3, F.concat(key % 300, F.lit("l"), key % 11)).otherwise("A|B")
    rows = marked(spark, sf_dir).select("p_partkey", text.alias("text"))
    found = c.once(rows, "text", lambda texts: texts.withColumn("_c", c.in_context(F.col("_whole"))))
    return found.select("p_partkey", "text", "_c.text", "_c.n").toDF("p_partkey", "text", "corrected", "n")


def respelt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and codes after the table of spellings and the formats of codes, rebar, sizes and concrete."""
    key = F.col("p_partkey")
    text = (
        F.when(key % 6 == 0, F.concat(F.lit("K2 "), key % 50)).when(key % 6 == 1, F.concat(F.lit("φ"), key % 20 + 6, F.lit("a"), key % 9 * 50)).when(key % 6 == 2, F.concat(key % 90, F.lit("x"), key % 70, F.lit("rnm")))
        .when(key % 6 == 3, F.get(F.array(*map(F.lit, "I O G c 17 MPA JO1 K乙3".split())), (key % 8).cast("int"))).when(key % 6 == 4, F.concat(F.lit("g"), key % 60)).otherwise(F.concat(F.lit("GL1 / W0 "), key % 30))
    )
    rows = marked(spark, sf_dir).select("p_partkey", text.alias("text"))
    return c.once(rows, "text", lambda texts: texts.withColumn("respelt", c.respelt(F.col("_whole")))).select("p_partkey", "text", "respelt")


def kind_statistics(rows: DataFrame) -> DataFrame:
    """Rows with a text by kind of correction, and the share of corrected ones (kind null): rows are counted by text, and every text is corrected once."""
    counted = rows.groupBy("text").agg(F.count("*").alias("n"))
    found = c.with_found(c.dealt(counted)).select("n", F.explode_outer(F.col("_found")["kind"]).alias("kind"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return found.rollup("kind").agg(n.alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)) / n, 6).alias("rate"))


def correction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by kind of correction, and the share of corrected ones (kind null)."""
    return kind_statistics(damaged(spark, sf_dir))


def nearest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known prefix nearest to each part's spoilt one, and how alike they are; distinct ones are looked up once."""
    spoilt = F.concat(F.get(F.array(*map(F.lit, PREFIXES)), (F.col("p_partkey") % 10).cast("int")), F.when(F.col("p_partkey") % 3 == 0, "Z").otherwise(""))
    words = marked(spark, sf_dir).select(spoilt.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rows = words.withColumn("nearest", c.nearest_entry(c.PREFIXES, c.PREFIX_LEAST)("word"))
    return rows.select("word", "n", "nearest", F.round(c.matching_ratio("word", "nearest"), 6).alias("ratio"))


QUERIES = {
    f.__name__: f
    for f in (
        tile_defaults, known_tiles_only, first_three_near, first_by_text, first_by_id_or_place, distinct_records, round_robin, repeated_tiles, adjacent_lines, texts_by_kind, type_distribution,
        attribute_agreement, corrected_texts, context_corrections, respelt_texts, correction_statistics, nearest_prefixes,
    )
}
_TILE = f"SELECT (n // 5)::INT AS row, (n % 5)::INT AS col, (n % 5 * 400)::INT AS ox, (n // 5 * 400)::INT AS oy FROM range({KNOWN}) t(n)"

#: A state for each text and pair of a table (w: wrong, r: right), in the table's order.
_PAIRS = lambda table: ", ".join("({}, {}, {})".format(i, *("'" + x.replace("'", "''") + "'" for x in pair)) for i, pair in enumerate(table))
_CONFUSED = [(w, r) for r, wrong in c.CONFUSED.items() for w in wrong]
_SPELLINGS = [(w, r) for r, wrong in c.SPELLINGS.items() for w in wrong.split()]
_AT = "strpos(t, w)"
_AROUND = f"(substr(t, greatest({_AT} - 2, 1)::INT, ({_AT} - greatest({_AT} - 2, 1))::INT) || substr(t, ({_AT} + 1)::INT, 2))"
_FITS = f"({_AT} > 0 AND length(regexp_replace({_AROUND}, CASE WHEN r BETWEEN '0' AND '9' THEN '[0-9]' ELSE '\\p{{L}}' END, '', 'g')) * 2 <= length({_AROUND}))"
_TYPE = "CASE WHEN regexp_matches(upper(text), '^[A-Z]{1,3}[0-9]+[A-Z]*$') THEN 'component_id' ELSE 'unknown' END"
ORACLES = {
    "context_corrections": f"""WITH RECURSIVE pairs(i, w, r) AS (VALUES {_PAIRS(_CONFUSED)}), d AS (SELECT DISTINCT text FROM (SELECT {{0}} AS text FROM part)),
      s AS (SELECT text, text AS t, 0 AS n, 0 AS k FROM d UNION ALL SELECT text, CASE WHEN {_FITS} THEN replace(t, w, r) ELSE t END, n + {_FITS}::INT, k + 1 FROM s JOIN pairs ON i = k)
      SELECT p_partkey, text, t AS corrected, n FROM (SELECT p_partkey, {{0}} AS text FROM part) JOIN s USING (text) WHERE k = {len(_CONFUSED)}""".replace(
        "{0}", "CASE p_partkey % 5 WHEN 0 THEN '1O' || p_partkey % 40 || 'S' WHEN 1 THEN 'K8L' || p_partkey % 90 WHEN 2 THEN '粱' || p_partkey % 7 || '住' WHEN 3 THEN p_partkey % 300 || 'l' || p_partkey % 11 ELSE 'A|B' END"
    ),
    "respelt_texts": f"""WITH RECURSIVE pairs(i, w, r) AS (VALUES {_PAIRS(_SPELLINGS)}), p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'K2 ' || p_partkey % 50 WHEN 1 THEN 'φ' || (p_partkey % 20 + 6) || 'a' || p_partkey % 9 * 50
        WHEN 2 THEN p_partkey % 90 || 'x' || p_partkey % 70 || 'rnm' WHEN 3 THEN string_split('I O G c 17 MPA JO1 K乙3', ' ')[p_partkey % 8 + 1] WHEN 4 THEN 'g' || p_partkey % 60 ELSE 'GL1 / W0 ' || p_partkey % 30 END AS text FROM part),
      s AS (SELECT DISTINCT text, text AS t, 0 AS k FROM p UNION ALL SELECT text, CASE WHEN t = w OR length(w) > 1 THEN replace(t, w, r) ELSE t END, k + 1 FROM s JOIN pairs ON i = k)
      SELECT p_partkey, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([KGJLWSZBC])([Z|L|C|Q|T])[-\\s]*([0-9]+)', '\\1\\2-\\3', 'g'), '[ΦφO0]([0-9]+)[@aA&]([0-9]+)', 'Φ\\1@\\2', 'g'),
        '([0-9]+)[x×*]([0-9]+)', '\\1×\\2', 'g'), '[CcGg]([0-9]+)', 'C\\1', 'g') AS respelt FROM p JOIN s USING (text) WHERE k = {len(_SPELLINGS)}""",
    "tile_defaults": f"""WITH {REGIONS_SQL} SELECT id, (x1 + coalesce(ox, 0))::INT AS moved, CASE WHEN ox IS NULL THEN 0 ELSE x1 + ox END::INT AS marked, CASE WHEN ox IS NULL THEN x1 ELSE round(greatest(0, least(x1 + ox, 2000)), 2) END::DOUBLE AS clamped,
      CASE WHEN ox IS NULL THEN 1024 ELSE 500 END::INT AS side FROM r LEFT JOIN ({_TILE}) t ON t.row = id % 6 AND t.col = id % 5""",
    "known_tiles_only": f"WITH {REGIONS_SQL} SELECT row, col, count(*) AS n, min(ox) AS ox FROM r JOIN ({_TILE}) t ON t.row = id % 6 AND t.col = id % 5 GROUP BY ALL",
    "first_three_near": f"""WITH {REGIONS_SQL}, k AS (SELECT grp, id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM r), p AS (SELECT a.id AS id, b.id AS near, b.cx - a.cx AS dx, b.cy - a.cy AS dy, row_number() OVER (PARTITION BY a.id ORDER BY b.id)::INT AS place
        FROM k a JOIN k b ON a.grp = b.grp AND a.id != b.id AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 100)
      SELECT id, near, place, CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN '右侧' ELSE '左侧' END WHEN dy > 0 THEN '下方' ELSE '上方' END AS side FROM p WHERE place <= 3""",
    "first_by_text": f"""WITH {REGIONS_SQL}, f AS (SELECT text, min(id) AS region, count(*) AS n FROM r GROUP BY 1), a AS (SELECT p_partkey, {PREFIXES}[p_partkey % 10 + 1] || p_size::INT AS text FROM part)
      SELECT p_partkey, a.text AS text, region, coalesce(n, 0) AS n FROM a LEFT JOIN f USING (text)""",
    "first_by_id_or_place": f"WITH {REGIONS_SQL} SELECT sheet, CASE WHEN id % 3 = 0 THEN text ELSE kind || '_' || x1 // 100 * 100 || '_' || y1 // 100 * 100 END AS key, min(id) AS id, count(*) AS n FROM r GROUP BY ALL",
    "distinct_records": f"WITH {REGIONS_SQL} SELECT text, x1, y1, (x2 - x1) || 'x' || (y2 - y1) AS dims, min(id) AS id, count(*) AS n FROM r GROUP BY ALL",
    "round_robin": f"WITH {REGIONS_SQL} SELECT sheet, id, ((row_number() OVER (PARTITION BY sheet ORDER BY id) - 1) % 8)::INT AS tile FROM r",
    "repeated_tiles": f"""WITH {REGIONS_SQL}, w AS (SELECT sheet, id, id % 7 AS a, id % 11 AS b, row_number() OVER (PARTITION BY sheet ORDER BY id) - 1 AS number, row_number() OVER (PARTITION BY sheet, id % 7, id % 11 ORDER BY id) > 1 AS again,
        ceil(sqrt(count(*) OVER (PARTITION BY sheet)))::BIGINT AS side FROM r) SELECT sheet, id, again, CASE WHEN again THEN number // side ELSE a END::BIGINT AS row, CASE WHEN again THEN number % side ELSE b END::BIGINT AS col FROM w""",
    "adjacent_lines": f"""WITH RECURSIVE {REGIONS_SQL}, o AS (SELECT sheet, text, x1, x2, y1, y2 - y1 AS h, row_number() OVER (PARTITION BY sheet ORDER BY y1, x1, id) AS i FROM r),
      w AS (SELECT sheet, i, text, y1 AS y, h, x2 AS x, 0 AS line FROM o WHERE i = 1 UNION ALL SELECT o.sheet, o.i, o.text, CASE WHEN j THEN w.y ELSE o.y1 END, CASE WHEN j THEN w.h ELSE o.h END, o.x2, w.line + CASE WHEN j THEN 0 ELSE 1 END
        FROM w JOIN o ON o.sheet = w.sheet AND o.i = w.i + 1, LATERAL (SELECT abs(o.y1 - w.y) <= 10 AND abs(o.h - w.h) <= 10 AND o.x1 - w.x <= 30 AS j))
      SELECT sheet, line::INT AS place, string_agg(text, ' ' ORDER BY i) AS line FROM w GROUP BY sheet, w.line""",
    "texts_by_kind": f"WITH {REGIONS_SQL}, f AS (SELECT sheet, kind, text, min(id) AS id FROM r GROUP BY ALL) SELECT sheet, kind, string_agg(text, chr(10) || chr(10) ORDER BY id) AS texts, count(*) AS n FROM f GROUP BY ALL",
    "type_distribution": f"WITH {REGIONS_SQL} SELECT {_TYPE} AS type, count(*) AS n, count(*) FILTER (id % 4 = 0) AS edges, round(avg((id % 4 = 0)::INT), 6) AS share, max(CASE {_TYPE} WHEN 'component_id' THEN 10 ELSE 1 END)::INT AS weight FROM r GROUP BY 1",
    "attribute_agreement": f"""WITH {REGIONS_SQL}, a AS (SELECT text, sum(k * (k - 1) / 2) AS s, sum(k)::BIGINT AS n FROM (SELECT text, kind, count(*) AS k FROM r GROUP BY ALL) GROUP BY 1), b AS (SELECT text, sum(k * (k - 1) / 2) AS z FROM (SELECT text, size % 3 AS v, count(*) AS k FROM r GROUP BY ALL) GROUP BY 1),
      q AS (SELECT text, n, coalesce((s + z) / nullif(n * (n - 1.0::DOUBLE), 0), 0.0::DOUBLE) AS v FROM a JOIN b USING (text)) SELECT text, n, round(v, 6) AS agreement, round(v * 0.1::DOUBLE, 6) AS bonus FROM q""",
}
