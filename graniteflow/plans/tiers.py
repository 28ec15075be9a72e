"""Merging of components by several kinds of evidence: place, type, tags, codes that look alike, and neighbouring tiles."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions import geometry as g
from graniteflow.operators.greedy import cut, meeting, seed_groups
from graniteflow.operators.keyed import seeds_by_keys
from graniteflow.operators.similarity import alike_sets, bag
from graniteflow.plans.tiling import PAIRS_SQL, REGIONS_SQL, regions

#: Types that count as kinds of one another.
KINDS = [["梁", "主梁", "次梁", "框架梁", "连梁"], ["柱", "框架柱", "剪力墙柱", "构造柱"], ["板", "楼板", "屋面板"], ["墙", "剪力墙", "填充墙"], ["基础", "独立基础", "条形基础"]]
#: Least overlaps and likenesses of the tiers: place alone; type and place; type, tags and place.
PLACE, TYPE, TAGS = 0.5, (0.8, 0.2), (0.6, 0.6, 0.1)


def kind_likeness(a: Column, b: Column) -> Column:
    """1 for equal types in any case, 0.8 for kinds of one another, 0.6 where one name holds the other, else 0; 0 where one is unknown."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    kin = F.lit(False)
    for names in KINDS:
        kin = kin | (a.isin(names) & b.isin(names))
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(~known, 0.0).when(a == b, 1.0).when(kin, 0.8).when(F.contains(a, b) | F.contains(b, a), 0.6).otherwise(0.0)


def tag_likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of tags; 0 where one is empty or unknown."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(F.array_union(a, b))).otherwise(0.0)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as components: a type in Chinese, tags, a size that some lack, and the tile that they were seen in."""
    kinds = ["梁", "主梁", "框架柱", "柱", "楼板", "墙", "剪力墙", ""]
    return regions(spark, sf_dir).select(
        "grp", "id", *g.BOX, "conf", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("text")).alias("code"), F.get(F.array(*map(F.lit, kinds)), (F.floor(F.col("id") / 3) * 5 % 7 + F.col("id") % 2).cast("int")).alias("kind"),
        F.split(F.lower("material"), " ").alias("tags"), F.when(F.col("id") % 7 == 0, "").otherwise(F.concat((F.floor(F.col("id") / 3) % 4).cast("string"), F.lit(" X 6"))).alias("dims"),
        F.floor(F.col("y1") / 500).cast("int").alias("row"), F.floor(F.col("x1") / 500).cast("int").alias("col"), F.col("size").alias("quantity"),
    )


def type_merge_seeds(rows: DataFrame, least: float = PLACE) -> DataFrame:
    """id and seed: a component goes to the first seed of its sheet that it overlaps by over ``least`` or whose type it has.

    rows: grp, id, kind and a box. Types are equal in any case (kinds of one another score no more than needed, so they
    don't count); the unknown type equals none. Equal types are one key, so a type's components aren't paired with each other.
    """
    kind = F.lower(F.trim("kind"))
    types = rows.where(F.coalesce(kind, F.lit("")) != "").select("id", F.concat_ws("|", F.lit("type"), F.col("grp").cast("string"), kind).alias("key"))
    near = cut(meeting(rows.select("grp", "id", *g.BOX), g.iou() > least))
    own = F.concat(F.lit("box|"), F.col("high").cast("string")).alias("key")
    return seeds_by_keys(rows, types.union(near.select(F.col("low").alias("id"), own)), types.union(near.select(F.col("high").alias("id"), own)))


def type_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components merged by overlap or type: of each seed the number, quantity and hull."""
    rows = components(spark, sf_dir)
    return rows.join(type_merge_seeds(rows), "id").groupBy("grp", "seed").agg(
        F.count("*").alias("n"), F.sum("quantity").cast("long").alias("quantity"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )


def tier() -> Column:
    """The first tier by which two components (columns of the second end in '_') are one: spatial, type, tags; null if none."""
    over, kinds, tags = g.iou(), kind_likeness(F.col("kind"), F.col("kind_")), tag_likeness(F.col("tags"), F.col("tags_"))
    return (
        F.when(over > PLACE, "spatial").when((kinds > TYPE[0]) & (over > TYPE[1]), "type").when((kinds > TAGS[0]) & (tags > TAGS[1]) & (over > TAGS[2]), "tags")
    )


def tier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components merged around seeds in tiers: of each seed the number, by which tier, quantity, hull, tags in order of their first places and most confidence.

    Every tier asks for an overlap, so candidates are the boxes that meet; types and tags are compared on those alone.
    """
    rows = components(spark, sf_dir)
    met = cut(meeting(rows.select("grp", "id", "kind", "tags", *g.BOX), tier().isNotNull(), give={"tier": tier()}))
    groups = cut(seed_groups(rows, met))
    both = cut(rows.join(groups.join(met.select(F.col("low").alias("seed"), F.col("high").alias("id"), "tier"), ["seed", "id"], "left"), "id"))
    counted = [F.count_if(F.col("tier") == name).alias(name) for name in ("spatial", "type", "tags")]
    facts = both.groupBy("grp", "seed").agg(
        F.count("*").alias("n"), *counted, F.sum("quantity").cast("long").alias("quantity"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("conf").alias("conf")
    )
    # a tag's first place in the group, by component and then place in its array: at most as many rows as distinct tags
    tags = both.select("seed", "id", F.posexplode("tags").alias("at", "tag")).groupBy("seed", "tag").agg(F.min(F.col("id") * 1000 + F.col("at")).alias("first"))
    tags = tags.groupBy("seed").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"])).alias("all_tags"))
    return facts.join(tags, "seed", "left").withColumn("all_tags", F.coalesce("all_tags", F.lit("")))


def alike_codes(codes: DataFrame, least: float = 0.8) -> DataFrame:
    """code and other: ordered pairs of distinct codes whose matching ratio (of longest common stretches) is over ``least``.

    codes: code. The ratio is at most the Dice likeness of the codes' letters, so candidates come from a set join on those.
    """
    codes = codes.where(F.coalesce("code", F.lit("")) != "").select("code").distinct()
    numbered = cut(codes.select("code", F.xxhash64("code").alias("id"), bag(F.lower("code")).alias("items")))
    pairs = alike_sets(numbered, least, "dice")
    names = numbered.select("id", "code")
    pairs = pairs.join(names.toDF("low", "a"), "low").join(names.toDF("high", "b"), "high")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    ways = pairs.select(F.col("a").alias("code"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("code"), F.col("a").alias("other")))
    return ways.where(ratio(F.lower("code"), F.lower("other")) > least)


def semantic_seeds(rows: DataFrame) -> DataFrame:
    """id and seed: a component goes to the first seed of its sheet with its code; with a code like its own, its type and size; or with its type and size in a neighbouring tile.

    rows: grp, id, code, kind, dims, row, col; nulls count as empty. Sizes fit if they are equal without spaces and case, or one is
    empty. The three rules are keys that a seed gives and others take: its code; a code like it, with type and size;
    each of the eight tiles around it, with type and size. So neighbouring tiles full of like components cost no pairs.
    """
    at, part = F.col("grp").cast("string"), lambda c: F.coalesce(c, F.lit("")).cast("string")
    rows = rows.select("id", at.alias("grp"), part(F.col("code")).alias("code"), part(F.col("kind")).alias("kind"), F.lower(F.regexp_replace(part(F.col("dims")), " ", "")).alias("dims"), "row", "col")
    key = lambda *parts: F.to_json(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    grp, code, kind, dims = map(F.col, ("grp", "code", "kind", "dims"))
    empty = dims == ""
    # a component without a size fits all ('n' holds those with one), one with a size fits its own and those without ('e')
    fits_given = F.when(empty, F.array(F.lit("n"), F.lit("e"))).otherwise(F.array(F.concat(F.lit("="), dims), F.lit("e")))
    fits_taken = F.when(empty, F.array(F.lit("e"))).otherwise(F.array(F.concat(F.lit("="), dims), F.lit("n")))
    own = rows.where(code != "").select("id", key("code", grp, code).alias("key"))
    like = cut(alike_codes(rows))
    near_given = rows.join(like, "code").select("id", F.explode(F.transform(fits_given, lambda f: key("like", grp, F.col("other"), kind, f))).alias("key"))
    near_taken = rows.where(code != "").select("id", F.explode(F.transform(fits_taken, lambda f: key("like", grp, code, kind, f))).alias("key"))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    tiles = F.transform(steps, lambda s: F.concat_ws("_", (F.col("row") + s["r"]).cast("string"), (F.col("col") + s["c"]).cast("string")))
    placed = rows.where("row IS NOT NULL AND col IS NOT NULL")
    tile_given = placed.select("id", F.explode(F.flatten(F.transform(tiles, lambda t: F.transform(fits_given, lambda f: key("tile", grp, t, kind, f))))).alias("key"))
    tile_taken = placed.select("id", F.explode(F.transform(fits_taken, lambda f: key("tile", grp, F.concat_ws("_", "row", "col"), kind, f))).alias("key"))
    return seeds_by_keys(rows, own.union(near_given).union(tile_given), own.union(near_taken).union(tile_taken))


def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components merged by meaning: of each seed the number, how many by each rule, mean confidence, the surest one's id, tiles and quantity."""
    rows = components(spark, sf_dir)
    groups = cut(semantic_seeds(rows))
    dims = F.lower(F.regexp_replace("dims", " ", ""))
    seed = rows.select(F.col("id").alias("seed"), F.col("code").alias("code_"), F.col("kind").alias("kind_"), dims.alias("dims_"))
    both = rows.withColumn("dims", dims).join(groups, "id").join(seed, "seed")
    fit = (F.col("kind") == F.col("kind_")) & ((F.col("dims") == F.col("dims_")) | (F.col("dims") == "") | (F.col("dims_") == ""))
    like = alike_codes(rows).select(F.col("code").alias("code_"), F.col("other").alias("code"), F.lit(True).alias("like"))
    both = both.join(like, ["code_", "code"], "left")
    rule = F.when(F.col("id") == F.col("seed"), "seed").when((F.col("code") == F.col("code_")) & (F.col("code") != ""), "exact").when(F.col("like") & fit, "similar").otherwise("cross_slice")
    surest = F.max_by(F.col("id"), F.col("conf") * 1_000_000 - F.col("id") % 1_000_000)
    return both.withColumn("rule", rule).groupBy("grp", "seed").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("rule") == r).alias(r) for r in ("exact", "similar", "cross_slice")], F.round(F.avg("conf"), 6).alias("confidence"), surest.alias("base"),
        F.count_distinct("row", "col").alias("tiles"), F.sum("quantity").cast("long").alias("quantity"),
    )


QUERIES = {f.__name__: f for f in (type_merge, tier_merge, semantic_merge)}

_KINDS = "['梁', '主梁', '框架柱', '柱', '楼板', '墙', '剪力墙', '']"
COMPONENTS_SQL = f"""c AS (SELECT grp, id, x1, y1, x2, y2, conf, CASE WHEN id % 11 = 0 THEN '' ELSE text END AS code, {_KINDS}[(id // 3 * 5 % 7 + id % 2 + 1)::INT] AS kind, string_split(lower(material), ' ') AS tags,
    CASE WHEN id % 7 = 0 THEN '' ELSE (id // 3 % 4) || 'x6' END AS dims, y1 // 500 AS row, x1 // 500 AS col, size AS quantity FROM r)"""
#: Each component in order takes the first seed that it has an edge from: edges(grp, low, high).
_SEEDS = """o AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM c),
  l AS (SELECT e.grp, o.i, list(DISTINCT w.i) AS lows FROM edges e JOIN o ON o.id = e.high JOIN o w ON w.id = e.low GROUP BY ALL),
  loop AS (SELECT DISTINCT grp, 0::BIGINT AS i, []::BIGINT[] AS held FROM o UNION ALL SELECT loop.grp, loop.i + 1, CASE WHEN list_has_any(held, coalesce(lows, [])) THEN held ELSE list_append(held, loop.i + 1) END
    FROM loop JOIN o ON o.grp = loop.grp AND o.i = loop.i + 1 LEFT JOIN l ON l.grp = loop.grp AND l.i = loop.i + 1),
  held AS (SELECT grp, arg_max(held, i) AS held FROM loop GROUP BY 1),
  g AS (SELECT o.grp, o.id, CASE WHEN list_contains(held, o.i) THEN o.i ELSE list_min(list_intersect(held, lows)) END AS s FROM o JOIN held USING (grp) LEFT JOIN l ON l.grp = o.grp AND l.i = o.i),
  s AS (SELECT g.grp, g.id, o.id AS seed FROM g JOIN o ON o.grp = g.grp AND o.i = g.s)"""
_HULL = "min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2"
_SAME = "(a.kind = b.kind AND a.kind != '')"
_KIN = " OR ".join(f"(a.kind IN ({names}) AND b.kind IN ({names}))" for names in (", ".join(f"'{n}'" for n in group) for group in KINDS))
_KIND = f"CASE WHEN a.kind = '' OR b.kind = '' THEN 0 WHEN a.kind = b.kind THEN 1 WHEN {_KIN} THEN 0.8 WHEN contains(a.kind, b.kind) OR contains(b.kind, a.kind) THEN 0.6 ELSE 0 END"
_TAGS = "len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))"
_FIT = "(a.kind = b.kind AND (a.dims = b.dims OR a.dims = '' OR b.dims = ''))"
#: The ratio of two codes by longest common stretches: the longest, then leftmost, is taken out, both sides go on.
_BEST = """list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: flatten(list_transform(range(1, length(y) + 1), lambda j:
    list_transform(range(1, least(length(x) - i, length(y) - j) + 2), lambda k: CASE WHEN substr(x, i, k) = substr(y, j, k) THEN k * 1000000 - i * 1000 - j END))))))"""
_RATIO = f"""codes AS (SELECT DISTINCT lower(code) AS code FROM c WHERE code != ''),
  pieces AS (SELECT a.code AS a, b.code AS b, a.code AS x, b.code AS y, 0::BIGINT AS k FROM codes a JOIN codes b ON a.code != b.code
    UNION ALL SELECT a, b, unnest([left(x, (i - 1)::INT), substr(x, (i + n)::INT)]), unnest([left(y, (j - 1)::INT), substr(y, (j + n)::INT)]), unnest([n, 0]) FROM (
      SELECT *, (n * 1000000 - v) // 1000 AS i, (n * 1000000 - v) % 1000 AS j FROM (SELECT *, (v + 999999) // 1000000 AS n FROM (SELECT a, b, x, y, {_BEST} AS v FROM pieces WHERE x != '' AND y != '') WHERE v IS NOT NULL))),
  ratios AS (SELECT a, b, 2 * sum(k) / (length(a) + length(b)) AS ratio FROM pieces GROUP BY a, b)"""
ORACLES = {
    "type_merge": f"""WITH RECURSIVE {PAIRS_SQL}, {COMPONENTS_SQL}, edges AS (SELECT DISTINCT grp, low, high FROM pairs WHERE iou > 0.5 UNION SELECT a.grp, a.id, b.id FROM c a JOIN c b ON a.grp = b.grp AND a.id < b.id AND {_SAME}), {_SEEDS}
      SELECT c.grp, seed, count(*) AS n, sum(quantity)::BIGINT AS quantity, {_HULL} FROM c JOIN s USING (id) GROUP BY ALL""",
    "tier_merge": f"""WITH RECURSIVE {PAIRS_SQL}, {COMPONENTS_SQL}, t AS (SELECT p.grp, low, high, CASE WHEN iou > 0.5 THEN 'spatial' WHEN {_KIND} > 0.8 AND iou > 0.2 THEN 'type' WHEN {_KIND} > 0.6 AND {_TAGS} > 0.6 AND iou > 0.1 THEN 'tags' END AS tier
        FROM pairs p JOIN c a ON a.id = low JOIN c b ON b.id = high), edges AS (SELECT * FROM t WHERE tier IS NOT NULL), {_SEEDS},
      m AS (SELECT c.*, seed, tier FROM c JOIN s USING (id) LEFT JOIN edges e ON e.low = seed AND e.high = c.id),
      tags AS (SELECT seed, string_agg(tag, ',' ORDER BY first) AS all_tags FROM (SELECT seed, tag, min(id * 1000 + nth - 1) AS first FROM (SELECT seed, id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS nth FROM m) GROUP BY ALL) GROUP BY 1)
      SELECT grp, m.seed, count(*) AS n, {', '.join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in ('spatial', 'type', 'tags'))}, sum(quantity)::BIGINT AS quantity, {_HULL}, max(conf) AS conf, all_tags FROM m JOIN tags USING (seed) GROUP BY ALL""",
    "semantic_merge": f"""WITH RECURSIVE {REGIONS_SQL}, {COMPONENTS_SQL}, {_RATIO},
      rules AS (SELECT a.grp, a.id AS low, b.id AS high, CASE WHEN a.code = b.code AND a.code != '' THEN 'exact' WHEN ratio > 0.8 AND {_FIT} THEN 'similar'
          WHEN {_FIT} AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row, a.col) != (b.row, b.col) THEN 'cross_slice' END AS rule
        FROM c a JOIN c b ON a.grp = b.grp AND a.id < b.id LEFT JOIN ratios t ON t.a = lower(a.code) AND t.b = lower(b.code)),
      edges AS (SELECT * FROM rules WHERE rule IS NOT NULL), {_SEEDS}
      SELECT c.grp, seed, count(*) AS n, {', '.join(f"count(*) FILTER (rule = '{t}') AS {t}" for t in ('exact', 'similar', 'cross_slice'))}, round(avg(conf), 6) AS confidence, arg_max(c.id, conf * 1000000 - c.id % 1000000) AS base,
        count(DISTINCT (row, col)) AS tiles, sum(quantity)::BIGINT AS quantity FROM c JOIN s USING (id) LEFT JOIN edges e ON e.low = seed AND e.high = c.id GROUP BY c.grp, seed""",
}
