"""Merging recognised regions: de-duplication, groups, conflicts and their resolution, matches of two sources, keyed aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions import geometry as g
from graniteflow.functions import marks as m
from graniteflow.functions.keys import below, falling, packed
from graniteflow.functions.text import letters_alike
from graniteflow.operators.greedy import cut, greedy_match, greedy_selection, meeting, overlap_edges, seed_groups
from graniteflow.operators.keyed import seeds_by_keys
from graniteflow.operators.similarity import alike_sets
from graniteflow.plans.tiling import PAIRS_SQL, REGIONS_SQL, regions

#: Bits of an order key below the confidence, so that surer regions come first and equal ones by id.
STEP = 1_000_000_000_000


def small_id() -> Column:
    """The id; an error where it is too large for a key."""
    return below(F.col("id"), STEP)


def surest_first(rows: DataFrame) -> DataFrame:
    """Regions numbered so that the order of ids is that of falling confidence; own keeps the id."""
    return rows.withColumn("own", F.col("id")).withColumn("id", (1000 - F.col("conf")) * F.lit(STEP) + small_id())


def kept_regions(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """id and kept of every region by its own id."""
    return greedy_selection(rows, edges).join(rows.select("id", "own"), "id").select(F.col("own").alias("id"), "kept")


def alike_anywhere(rows: DataFrame, least: float) -> DataFrame:
    """(low, high) ids of rows of one group whose texts' sets of letters are alike by over ``least``, wherever they stand.

    Sets that are alike share one of their first few letters: rows meet on those alone.
    """
    letters = F.array_sort(F.array_remove(F.array_distinct(F.split(F.lower("text"), "")), ""))
    rows = rows.select("grp", "id", "text", letters.alias("letters"))
    first = F.slice("letters", 1, F.size("letters") - F.ceil(F.size("letters") * least).cast("int") + 1)
    side = rows.select("*", F.explode(first).alias("letter"))
    other = side.select("grp", "letter", F.col("id").alias("id_"), F.col("text").alias("text_"))
    both = side.join(other, ["grp", "letter"]).where("id < id_").where(letters_alike(F.lower("text"), F.lower("text_")) > least)
    return both.select(F.col("id").alias("low"), F.col("id_").alias("high")).distinct()


def alike_keys(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """gives and takes (id, key) by which rows of one group meet whose texts' sets of letters are alike by over ``least``.

    A row takes its own set and gives that and those like it, so rows of one set aren't paired. Other sets can be alike only if they
    share over least / (1 - least) letters: only sets that large go through the set join.
    """
    letters = F.array_sort(F.array_remove(F.array_distinct(F.split(F.lower("text"), "")), ""))
    rows = rows.select("grp", "id", letters.alias("items")).where(F.size("items") > 0)
    key = lambda items: F.concat_ws("|", F.lit("text"), F.col("grp").cast("string"), F.concat_ws("", items)).alias("key")
    large = rows.where(F.size("items") > least / (1 - least) - 1e-6)
    sets = cut(large.select("grp", "items").distinct().select("grp", F.col("items"), F.concat_ws("|", F.col("grp").cast("string"), F.concat_ws("", "items")).alias("id")))
    pairs = alike_sets(sets, least, by=("grp",)).where(F.col("likeness") > least)
    ways = pairs.select("low", "high").union(pairs.select("high", "low"))
    like = ways.select(F.col("low").alias("own"), F.concat_ws("|", F.lit("text"), "high").alias("key"))
    named = large.select("id", F.concat_ws("|", F.col("grp").cast("string"), F.concat_ws("", "items")).alias("own"))
    own = rows.select("id", key(F.col("items")))
    return own.union(named.join(like, "own").select("id", "key")), own


def greedy_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that stay, the surest first: one goes if a kept one is alike and overlaps, or is very alike anywhere on the sheet."""
    rows = surest_first(regions(spark, sf_dir))
    alike = letters_alike(F.lower("text"), F.lower("text_"))
    near = cut(meeting(rows.select("grp", "id", "text", *g.BOX), (((alike > 0.8) & (g.iou() > 0.3)) | ((g.iou() > 0.7) & (alike > 0.5))) & (alike <= 0.9)))
    box = F.concat(F.lit("box|"), F.col("high").cast("string")).alias("key")
    gives, takes = alike_keys(rows, 0.9)
    seeds = seeds_by_keys(rows, gives.union(near.select(F.col("low").alias("id"), box)), takes.union(near.select(F.col("high").alias("id"), box)))
    return seeds.join(rows.select("id", "own"), "id").select(F.col("own").alias("id"), (F.col("seed") == F.col("id")).alias("kept"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = m.wide_type(F.col("text"))
    rows = regions(spark, sf_dir).withColumns({"type": kind, "edge": F.col("id") % 4 == 0, "own": F.col("id")})
    return rows.withColumn("id", (1000 - F.col("conf")) * F.lit(STEP) + (10 - m.importance(F.col("type"))) * F.lit(STEP // 100) + below(F.col("id"), STEP // 100))


def smart_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that stay by five rules of likeness, overlap, type and edge protection, the surest and weightiest first."""
    rows = typed(spark, sf_dir)
    sim, over = m.edit_likeness(F.col("text"), F.col("text_")), g.iou()
    key = lambda c: F.col(c).isin("component_id", "axis")
    rule = (
        ((sim >= 0.95) & (over > 0.5)) | ((sim > 0.9) & (over > 0.3) & (F.col("type") == F.col("type_"))) | ((over > 0.8) & (sim > 0.6))
        | (key("type") & key("type_") & (sim > 0.85) & (over > 0.4)) | (F.col("edge") & F.col("edge_") & (sim > 0.95) & (over > 0.7))
    )
    return kept_regions(rows, meeting(rows.select("grp", "id", "text", "type", "edge", *g.BOX), rule))


def position_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that stay in input order: one goes if a kept one of the same text begins within 10 pixels both ways."""
    rows = regions(spark, sf_dir).select(F.concat_ws("|", "grp", "text").alias("grp"), "id", "x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    near = (F.abs(F.col("x1") - F.col("x1_")) < 10) & (F.abs(F.col("y1") - F.col("y1_")) < 10)
    return greedy_selection(rows, meeting(rows, near, cell=50, reach=20))


def component_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that stay in input order: one goes if it overlaps a kept one of no less confidence by over a half."""
    rows = regions(spark, sf_dir).select("grp", "id", "conf", *g.BOX)
    return greedy_selection(rows, meeting(rows, (g.iou() > 0.5) & (F.col("conf") >= F.col("conf_"))))


def joined_texts(text: Column) -> Column:
    """Texts of a group in the order of ids, joined by spaces; groups around a seed are as many as boxes can overlap it."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("text")))), lambda x: x["text"]), " ")


def merged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each seed: number, texts, hull and largest confidence of its group."""
    both = rows.join(groups, "id")
    return both.groupBy("grp", "seed").agg(F.count("*").alias("n"), joined_texts(F.col("text")).alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("conf").alias("conf"))


def seed_group_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions merged around seeds in input order, by an overlap of over 0.7."""
    rows = regions(spark, sf_dir).select("grp", "id", "text", "conf", *g.BOX)
    return merged(rows, seed_groups(rows, overlap_edges(rows, 0.7)))


def seed_group_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions merged by overlap, then what came out by centres nearer than 50 pixels."""
    first = cut(seed_group_iou(spark, sf_dir)).withColumnRenamed("seed", "id").drop("n")
    return merged(first, seed_groups(first, meeting(first, g.centre_distance() < 50, reach=60)))


def proximity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose corners lie within 100 pixels of their seed's."""
    rows = regions(spark, sf_dir).select("grp", "id", "text", "conf", *g.BOX)
    near = F.hypot(F.col("x1") - F.col("x1_"), F.col("y1") - F.col("y1_")) <= 100
    return seed_groups(rows, meeting(rows, near, reach=100))


def fixpoint_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of one type that overlap by over a half, merged again until none do: number, pieces and hull."""
    now = regions(spark, sf_dir).select(F.concat_ws("|", "grp", "kind").alias("grp"), "id", F.lit(1).cast("long").alias("n"), F.col("size").cast("long").alias("pieces"), *g.BOX)
    return merged_to_fixpoint(now)


def merged_to_fixpoint(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """rows: grp, id, n, pieces and a box. Passes of seed groups over the hulls of the pass before, until one merges nothing."""
    now = cut(rows)
    while True:
        edges = cut(overlap_edges(now, least))
        if edges.isEmpty():
            return now
        hulls = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
        now = cut(now.join(seed_groups(now, edges), "id").groupBy("grp", F.col("seed").alias("id")).agg(F.sum("n").alias("n"), F.sum("pieces").alias("pieces"), *hulls))


def merged_by_id_or_type(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Components of one id or of one type whose boxes overlap by over ``least``, merged around seeds in encounter order, again until none do.

    rows: grp, id (the order of encounter, from 0 below 10**18), label, type, richness (0 to 10**9 - 1), n, pieces and a box. Out of a group come the
    sums of n and pieces, the hull, and label, type and richness of its richest component, the first of equal ones, so a
    later pass may merge what an earlier one couldn't. Ids are unique. Empty and null labels and types match nothing; nor do null boxes and such without an area.
    """
    same = F.coalesce(F.nullif("label", F.lit("")) == F.col("label_"), F.lit(False)) | F.coalesce(F.nullif("type", F.lit("")) == F.col("type_"), F.lit(False))
    hull = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    richest = F.max_by(F.struct("label", "type", "richness"), packed((F.col("richness"), 9), (falling(F.col("id"), 18), 18)))
    now = cut(rows.select("grp", "id", "label", "type", "richness", "n", "pieces", *g.BOX))
    while True:
        edges = cut(meeting(now.where("x1 < x2 AND y1 < y2").drop("n", "pieces", "richness"), same & (g.iou("", "_") > least)))
        if edges.isEmpty():
            return now
        alone = now.join(edges.select(F.explode(F.array("low", "high")).alias("id")), "id", "left_anti")
        met = now.join(alone.select("id"), "id", "left_anti")
        groups = met.join(seed_groups(met.select("id"), edges), "id").groupBy("grp", F.col("seed").alias("id"))
        out = groups.agg(richest.alias("_r"), F.sum("n").alias("n"), F.sum("pieces").alias("pieces"), *hull).select("grp", "id", "_r.*", "n", "pieces", *g.BOX)
        now = cut(out.unionByName(alone))


def coordinated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a sheet merged by id or type and overlap, until none do."""
    now = regions(spark, sf_dir).select(
        "grp", "id", F.col("text").alias("label"), F.col("kind").alias("type"), (F.col("size") * 7 % 11).cast("long").alias("richness"), F.when(F.col("id") % 6 == 0, 2).otherwise(1).cast("long").alias("n"), F.lit(1).cast("long").alias("pieces"), *g.BOX,
    )
    return merged_by_id_or_type(now)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as candidates of a fusion: source, label and how many attributes and coordinates they have."""
    source = F.when(F.col("id") % 3 == 0, "ocr").when(F.col("id") % 3 == 1, "vision").otherwise("cad")
    return regions(spark, sf_dir).withColumns({"source": source, "label": F.lower("text"), "attributes": (F.col("size") % 3).cast("int"), "coordinates": F.when(F.col("id") % 5 == 0, 2).otherwise(4)})


def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the seed of their group: overlaps of over three tenths of either box."""
    rows = candidates(spark, sf_dir)
    return rows.join(seed_groups(rows, meeting(rows.select("grp", "id", *g.BOX), g.overlaps())), "id")


def fused_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component for each conflict, chosen by its type, and each single candidate: source, confidence and quality.

    A conflict is spatial if centres spread, of attributes if materials differ, semantic if labels do, else one
    of confidence. Ties go to the least id. The winner's key is one number, so sums combine before the shuffle.
    """
    rows = cut(conflict_groups(spark, sf_dir))
    cx, cy = g.centre("x1", "x2"), g.centre("y1", "y2")
    facts = rows.groupBy("seed").agg(
        F.count("*").alias("n"), F.least(F.lit(1.0), (F.var_pop(cx) + F.var_pop(cy)) / 10000).alias("spread"), (F.min("material") != F.max("material")).alias("attribute"),
        (F.min("label") != F.max("label")).alias("semantic"), F.count_if(F.col("source") == "vision").alias("vision"),
    )
    kind = F.when(F.col("n") == 1, "single").when(F.col("spread") > 0.3, "spatial").when(F.col("attribute"), "attribute").when(F.col("semantic"), "semantic").otherwise("confidence")
    facts = facts.select("seed", "n", kind.alias("conflict"), "vision")
    both = rows.join(facts, "seed")
    first = F.when(F.col("conflict") == "spatial", F.col("coordinates")).when(F.col("conflict") == "attribute", F.col("attributes")).when(F.col("conflict") == "semantic", (F.col("source") == "vision").cast("int")).otherwise(0)
    key = (first.cast("long") * 1001 + F.col("conf")) * F.lit(STEP) + (F.lit(STEP) - 1 - small_id())
    best = both.groupBy("seed").agg(F.max(key).alias("_key"))
    winner = best.select((F.lit(STEP) - 1 - F.col("_key") % F.lit(STEP)).alias("id"))
    boost = F.when(F.col("conflict") == "spatial", 0.05).when(F.col("conflict") == "attribute", 0.03).when(F.col("conflict") == "semantic", F.when(F.col("vision") > 0, 0.08).otherwise(0.02)).otherwise(0.0)
    confidence = F.least(F.lit(1.0), F.col("conf") / 1000 + boost)
    quality = F.least(F.lit(1.0), confidence + F.least(F.lit(0.1), F.col("attributes") * 0.02) + F.col("coordinates") / 4 * 0.1)
    name = F.when(F.col("conflict") == "single", F.concat(F.lit("single_"), "id")).otherwise(F.concat(F.lit("conflict_resolved_"), "seed"))
    return both.join(winner, "id").select(name.alias("component"), "id", "conflict", "n", "source", F.round(confidence, 6).alias("confidence"), F.round(quality, 6).alias("quality"))


def fusion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence and quality of the fused components, the share of good ones, and how many sources they come from."""
    rows = fused_components(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("quality"),
        F.round(F.coalesce(F.avg((F.col("quality") > 0.8).cast("double")), F.lit(0.0)), 6).alias("good"), F.round(F.count_distinct("source") / 3, 6).alias("sources"),
    )


def two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions of two sources: the first of each three as a text, the others as components."""
    rows = regions(spark, sf_dir).select("grp", "id", "text", "conf", *g.BOX)
    return rows.where("id % 3 = 0"), rows.where("id % 3 != 0").withColumn("text", F.when(F.col("id") % 2 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))


def match_candidates(texts: DataFrame, things: DataFrame) -> DataFrame:
    """a, b and score of texts and components of one group that score over a half: 0.7 for place and size, 0.3 for the label.

    Only near ones, and ones of equal label wherever they stand, can score that much: they meet in cells and on labels.
    """
    score = F.round(g.spatial_likeness() * 0.7 + m.label_likeness(F.col("text"), F.col("text_")) * 0.3, 9)
    b = things.withColumnsRenamed({c: f"{c}_" for c in things.columns if c != "grp"})
    at = lambda rows, s: rows.withColumns({"gx": F.floor((F.col(f"x1{s}") + F.col(f"x2{s}")) / 2 / 50), "gy": F.floor((F.col(f"y1{s}") + F.col(f"y2{s}")) / 2 / 50)})
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    near = at(texts, "").withColumn("gx", around("gx")).withColumn("gy", around("gy")).join(at(b, "_"), ["grp", "gx", "gy"])
    same = texts.join(b, (texts["grp"] == b["grp"]) & (F.lower(texts["text"]) == F.lower(b["text_"]))).drop(b["grp"])
    pairs = near.select(F.col("id").alias("a"), F.col("id_").alias("b"), score.alias("score")).union(same.select(F.col("id").alias("a"), F.col("id_").alias("b"), score.alias("score")))
    return pairs.where("score > 0.5").distinct()


def cross_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-to-one match of texts and components, each text in turn taking the best component left."""
    return greedy_match(match_candidates(*two_sources(spark, sf_dir)))


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and components matched, or in one source only, with the action that is called for."""
    texts, things = two_sources(spark, sf_dir)
    found = cross_match(spark, sf_dir)
    both = texts.select(F.col("id").alias("a"), F.col("conf").alias("text_conf")).join(found, "a", "left").join(things.select(F.col("id").alias("b"), F.col("conf").alias("thing_conf")), "b", "full")
    status = F.when(F.col("b").isNull(), "missing_vision").when(F.col("a").isNull(), "missing_ocr").when(F.col("score") > 0.7, "consistent").when(F.least("text_conf", "thing_conf") < 600, "low_confidence").otherwise("inconsistent")
    action = F.when(F.col("b").isNull(), "vision_reprocess").when(F.col("a").isNull(), "ocr_reprocess")
    return both.select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"), action.alias("action"))


def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, their shares, and how many matches agree."""
    rows = cross_validation(spark, sf_dir)
    share = lambda test: F.round(F.coalesce(F.avg(test.cast("double")), F.lit(0.0)), 6)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("consistent", "inconsistent", "low_confidence", "missing_ocr", "missing_vision")]
    return rows.agg(F.count("*").alias("n"), *counts, share(F.col("status") == "consistent").alias("convergence"), share(F.when(F.col("action").isNull(), F.col("score") > 0.7)).alias("agreement"))


def keyed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a sheet with one text: pieces (1 where unknown), the first one's place, sources, hull, surest and longest values."""
    pieces = F.when(F.col("id") % 4 == 0, 1).otherwise(F.col("size"))
    long_first = (F.length("material").cast("long") * F.lit(STEP)) + (F.lit(STEP) - 1 - small_id())
    rows = regions(spark, sf_dir).groupBy("grp", "text").agg(
        F.count("*").alias("n"), F.sum(pieces).cast("long").alias("pieces"), F.min("id").alias("first"), F.min_by("x1", "id").alias("x"), F.count_distinct(F.col("id") % 3).alias("sources"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("conf").alias("conf"), (F.lit(STEP) - 1 - F.max(long_first) % F.lit(STEP)).alias("longest"),
        F.min(F.when(F.col("id") % 5 != 0, F.col("id"))).alias("first_known"),
    )
    return rows


def most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sheet's records the one with most known values, then most keys, then the first."""
    known = (F.col("size") % 4).cast("int") + (F.col("kind") != "ECONOMY").cast("int")
    key = (known.cast("long") * 10 + F.col("size") % 4) * F.lit(STEP) + (F.lit(STEP) - 1 - small_id())
    best = regions(spark, sf_dir).groupBy("sheet").agg(F.max(key).alias("_k"), F.count("*").alias("n"))
    return best.select("sheet", (F.lit(STEP) - 1 - F.col("_k") % F.lit(STEP)).alias("id"), F.floor(F.col("_k") / F.lit(STEP * 10)).cast("int").alias("known"), "n")


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each sheet's ten rows of its 10x10 grid, by column and id, joined by spaces. A line is as long as its sheet is wide."""
    gx, gy = (F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / 2 / 2000 * 10).cast("int") for c in "xy")
    rows = regions(spark, sf_dir).select("sheet", gy.alias("line"), F.struct(gx.alias("gx"), "id", "text").alias("_t"))
    return rows.groupBy("sheet", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t["text"]), " ").alias("text"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sheet's texts: characters, confidence, its levels, lengths, quality and consistency."""
    c, n = F.col("conf") / 1000, F.length("text")
    density = F.least(F.count("*") / 400, F.lit(1.0))
    coverage = F.least(F.sum(g.area()) / F.lit(2000 * 2000), F.lit(1.0))
    return regions(spark, sf_dir).groupBy("sheet").agg(
        F.sum(n).alias("characters"), F.round(F.avg(c), 6).alias("mean"), F.min("conf").alias("least"), F.max("conf").alias("most"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"),
        F.count_if(c < 0.5).alias("low"), F.count_if(n <= 5).alias("short"), F.count_if(n > 20).alias("long"), F.round(coverage, 6).alias("coverage"),
        F.round(0.4 * F.avg(c) + 0.3 * coverage + 0.3 * density, 6).alias("quality"), F.round(F.greatest(F.lit(0.0), 1 - F.var_pop(c)), 6).alias("consistency"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        greedy_text_dedup, smart_dedup, position_dedup, component_dedup, seed_group_iou, seed_group_hybrid, proximity_groups, fixpoint_merge, coordinated_merge, fused_components, fusion_quality,
        cross_match, cross_validation, validation_metrics, keyed_components, most_complete, grid_lines, text_statistics,
    )
}


def greedy_sql(nodes: str, edges: str, step: str = "id") -> str:
    """CTEs (with recursion, a step for each node of all groups at once) that give ``kept(grp, r, id, is_kept, seed)``.

    nodes: table with grp, id and an order; edges: table with grp, low and high ids.
    """
    return f"""o AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY {step}) AS r FROM {nodes}),
    l AS (SELECT h.grp, h.r, list(w.r) AS lows FROM {edges} e JOIN o w ON w.grp = e.grp AND w.id = e.low JOIN o h ON h.grp = e.grp AND h.id = e.high WHERE w.r < h.r GROUP BY ALL),
    loop AS (SELECT DISTINCT grp, 0::BIGINT AS i, []::BIGINT[] AS held FROM o UNION ALL SELECT loop.grp, loop.i + 1, CASE WHEN list_has_any(loop.held, coalesce(l.lows, [])) THEN loop.held ELSE list_append(loop.held, loop.i + 1) END
      FROM loop JOIN o ON o.grp = loop.grp AND o.r = loop.i + 1 LEFT JOIN l ON l.grp = loop.grp AND l.r = loop.i + 1),
    last AS (SELECT grp, arg_max(held, i) AS held FROM loop GROUP BY 1),
    kept AS (SELECT o.grp, o.id, list_contains(held, o.r) AS is_kept, CASE WHEN list_contains(held, o.r) THEN o.r ELSE list_min(list_intersect(held, lows)) END AS seed_r FROM o JOIN last USING (grp) LEFT JOIN l ON l.grp = o.grp AND l.r = o.r),
    seeded AS (SELECT kept.*, o.id AS seed FROM kept JOIN o ON o.grp = kept.grp AND o.r = kept.seed_r)"""


_BOTH_WAYS = "(SELECT grp, low, high FROM {0} UNION ALL SELECT grp, high AS low, low AS high FROM {0})"
_CHARS = "list_distinct(string_split(lower({}), ''))"
_ALIKE = f"(len(list_intersect({_CHARS.format('text')}, {_CHARS.format('text_')})) / len(list_distinct(list_concat({_CHARS.format('text')}, {_CHARS.format('text_')}))))"
_EDITS = "CASE WHEN upper(text) = upper(text_) THEN 1 WHEN least(length(text), length(text_)) <= 3 THEN 0 ELSE 1 - levenshtein(upper(text), upper(text_)) / greatest(length(text), length(text_)) END"
_KIND = "CASE WHEN regexp_matches(upper({0}), '^[A-Z]{{1,3}}[0-9]+[A-Z]*$') THEN 'component_id' ELSE 'unknown' END"


def _selection(edges_where: str, nodes: str = "r", step: str = "id", out: str = "id, is_kept AS kept") -> str:
    edges = _BOTH_WAYS.format("edges") if step != "id" else "edges"
    return f"WITH RECURSIVE {PAIRS_SQL}, edges AS (SELECT grp, low, high FROM pairs WHERE {edges_where}), {greedy_sql(nodes, edges, step)} SELECT {out} FROM seeded"


_GROUPED = "SELECT s.grp, s.seed, count(*) AS n, string_agg(text, ' ' ORDER BY s.id) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(conf) AS conf FROM seeded s JOIN {0} t ON t.id = s.id GROUP BY ALL"
_FUSED = f"""WITH RECURSIVE {PAIRS_SQL}, edges AS (SELECT grp, low, high FROM pairs WHERE shared / area > 0.3 OR shared / area_ > 0.3), {greedy_sql('r', 'edges')},
  c AS (SELECT r.*, seed, CASE id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'vision' ELSE 'cad' END AS source, size % 3 AS attributes, CASE WHEN id % 5 = 0 THEN 2 ELSE 4 END AS coordinates FROM r JOIN seeded USING (id)),
  f AS (SELECT seed, count(*) AS n, count(*) FILTER (source = 'vision') AS vision, CASE WHEN count(*) = 1 THEN 'single' WHEN least(1.0, (var_pop((x1 + x2) / 2) + var_pop((y1 + y2) / 2)) / 10000) > 0.3 THEN 'spatial'
    WHEN min(material) != max(material) THEN 'attribute' WHEN min(lower(text)) != max(lower(text)) THEN 'semantic' ELSE 'confidence' END AS conflict FROM c GROUP BY 1),
  w AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CASE conflict WHEN 'spatial' THEN coordinates WHEN 'attribute' THEN attributes WHEN 'semantic' THEN (source = 'vision')::INT ELSE 0 END DESC, conf DESC, id) AS place FROM c JOIN f USING (seed)),
  b AS (SELECT *, least(1.0::DOUBLE, conf / 1000 + CASE conflict WHEN 'spatial' THEN 0.05 WHEN 'attribute' THEN 0.03 WHEN 'semantic' THEN CASE WHEN vision > 0 THEN 0.08 ELSE 0.02 END ELSE 0 END::DOUBLE) AS sure FROM w WHERE place = 1),
  fused AS (SELECT CASE WHEN conflict = 'single' THEN 'single_' || id ELSE 'conflict_resolved_' || seed END AS component, id, conflict, n, source, round(sure, 6) AS confidence,
    round(least(1.0::DOUBLE, sure + least(0.1::DOUBLE, attributes * 0.02::DOUBLE) + coordinates / 4 * 0.1::DOUBLE), 6) AS quality FROM b)"""
_CROSS = f"""WITH RECURSIVE {PAIRS_SQL}, a AS (SELECT * FROM r WHERE id % 3 = 0), b AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN text || ' x' ELSE text END AS text) FROM r WHERE id % 3 != 0),
  sc AS (SELECT a.grp, a.id AS a, b.id AS b, round((greatest(0.0, 1 - sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2) / 50) * 0.6::DOUBLE
      + least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) / greatest((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) * 0.4::DOUBLE) * 0.7::DOUBLE
      + CASE WHEN lower(a.text) = lower(b.text) THEN 1.0 WHEN contains(lower(a.text), lower(b.text)) OR contains(lower(b.text), lower(a.text)) THEN 0.7 WHEN list_has_any(string_split(lower(a.text), ' '), string_split(lower(b.text), ' ')) THEN 0.5 ELSE 0 END::DOUBLE * 0.3::DOUBLE, 9) AS score FROM a JOIN b USING (grp)),
  o AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM a),
  cand AS (SELECT sc.grp, o.i, list({{'b': b, 'score': score}} ORDER BY score DESC, b) AS bs FROM sc JOIN o ON o.id = sc.a WHERE score > 0.5 GROUP BY ALL),
  loop AS (SELECT DISTINCT grp, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::STRUCT(b BIGINT, score DOUBLE) AS got FROM o
    UNION ALL SELECT grp, i, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.b) END, pick
      FROM (SELECT loop.grp, loop.i + 1 AS i, taken, list_filter(coalesce(bs, []), lambda x: NOT list_contains(taken, x.b))[1] AS pick FROM loop JOIN o ON o.grp = loop.grp AND o.i = loop.i + 1 LEFT JOIN cand ON cand.grp = loop.grp AND cand.i = loop.i + 1)),
  matched AS (SELECT o.id AS a, got.b AS b, got.score AS score FROM loop JOIN o ON o.grp = loop.grp AND o.i = loop.i WHERE got IS NOT NULL),
  valid AS (SELECT x.id AS a, y.id AS b, coalesce(score, 0.0) AS score, CASE WHEN y.id IS NULL THEN 'missing_vision' WHEN x.id IS NULL THEN 'missing_ocr' WHEN score > 0.7 THEN 'consistent' WHEN least(x.conf, y.conf) < 600 THEN 'low_confidence' ELSE 'inconsistent' END AS status,
    CASE WHEN y.id IS NULL THEN 'vision_reprocess' WHEN x.id IS NULL THEN 'ocr_reprocess' END AS action FROM (SELECT a.id, a.conf, m.b, m.score FROM a LEFT JOIN matched m ON m.a = a.id) x FULL JOIN b y ON y.id = x.b)"""


def _fixpoint(source: str, same: str, out: str) -> str:
    """SQL of passes over a group's list: a step merges one seed with the later ones like it; a pass without a merge ends it. source: a CTE's rows as s; same: of a and b."""
    shared = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
    both = f"({same}) AND {shared} > 0.5::DOUBLE * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {shared})"
    each = lambda f, c: f"list_{f}(list_transform(g, lambda x: x.{c}))"
    first = "list_filter(g, lambda x: x.richness = list_max(list_transform(g, lambda y: y.richness)))[1]"
    joined = f"""{{'id': a.id, 'label': {first}.label, 'type': {first}.type, 'richness': {each('max', 'richness')}, 'n': {each('sum', 'n')}::BIGINT, 'pieces': {each('sum', 'pieces')}::BIGINT,
      'x1': {each('min', 'x1')}, 'y1': {each('min', 'y1')}, 'x2': {each('max', 'x2')}, 'y2': {each('max', 'y2')}}}"""
    return f"""WITH RECURSIVE {source}, w AS (
        SELECT grp, list({{'id': id, 'label': label, 'type': type, 'richness': richness, 'n': n, 'pieces': pieces, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY id) AS l, 1::BIGINT AS i, false AS changed, false AS done FROM s GROUP BY grp
        UNION ALL SELECT grp, CASE WHEN len(g) > 1 THEN l[:i - 1] || [{joined}] || list_filter(l[i + 1:], lambda b: NOT ({both})) ELSE l END, CASE WHEN i > len(l) THEN 1 ELSE i + 1 END, i <= len(l) AND (changed OR len(g) > 1), i > len(l) AND NOT changed
        FROM (SELECT *, CASE WHEN i <= len(l) THEN [a] || list_filter(l[i + 1:], lambda b: {both}) ELSE [] END AS g FROM (SELECT *, l[i] AS a FROM w WHERE NOT done)))
      SELECT {out} FROM (SELECT grp, unnest(l) AS c FROM w WHERE done)"""


_BOXES = "c.x1 AS x1, c.y1 AS y1, c.x2 AS x2, c.y2 AS y2"
ORACLES = {
    "fixpoint_merge": _fixpoint(f"{REGIONS_SQL}, s AS (SELECT grp || '|' || kind AS grp, id, '' AS label, kind AS type, 0 AS richness, 1::BIGINT AS n, size::BIGINT AS pieces, x1, y1, x2, y2 FROM r)", "true", f"grp, c.id AS id, c.n AS n, c.pieces AS pieces, {_BOXES}"),
    "coordinated_merge": _fixpoint(
        f"{REGIONS_SQL}, s AS (SELECT grp, id, text AS label, kind AS type, (size * 7 % 11)::BIGINT AS richness, CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END::BIGINT AS n, 1::BIGINT AS pieces, x1, y1, x2, y2 FROM r)",
        "a.label = b.label OR a.type = b.type", f"grp, c.id AS id, c.label AS label, c.type AS type, c.richness AS richness, c.n AS n, c.pieces AS pieces, {_BOXES}",
    ),
    "greedy_text_dedup": _selection(f"({_ALIKE} > 0.8 AND iou > 0.3) OR {_ALIKE} > 0.9 OR (iou > 0.7 AND {_ALIKE} > 0.5)", step="conf DESC, id"),
    "smart_dedup": f"""WITH RECURSIVE {PAIRS_SQL}, s AS (SELECT *, {_EDITS} AS sim, {_KIND.format('text')} AS t, {_KIND.format('text_')} AS t_ FROM pairs WHERE iou > 0.3),
      edges AS (SELECT grp, low, high FROM s WHERE (sim >= 0.95 AND iou > 0.5) OR (sim > 0.9 AND iou > 0.3 AND t = t_) OR (iou > 0.8 AND sim > 0.6) OR (t = 'component_id' AND t_ = 'component_id' AND sim > 0.85 AND iou > 0.4)
        OR (low % 4 = 0 AND high % 4 = 0 AND sim > 0.95 AND iou > 0.7)), {greedy_sql('r', _BOTH_WAYS.format('edges'), 'conf DESC, id')} SELECT id, is_kept AS kept FROM seeded""",
    "position_dedup": _selection("text = text_ AND abs(x1 - x1_) < 10 AND abs(y1 - y1_) < 10"),
    "component_dedup": _selection("iou > 0.5 AND conf >= conf_"),
    "seed_group_iou": f"WITH RECURSIVE {PAIRS_SQL}, edges AS (SELECT grp, low, high FROM pairs WHERE iou > 0.7), {greedy_sql('r', 'edges')} {_GROUPED.format('r')}",
    "proximity_groups": _selection("sqrt((x1 - x1_) ** 2 + (y1 - y1_) ** 2) <= 100", out="id, seed"),
    "fused_components": f"{_FUSED} SELECT * FROM fused",
    "fusion_quality": f"{_FUSED} SELECT count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(quality), 6) AS quality, round(avg((quality > 0.8)::INT), 6) AS good, round(count(DISTINCT source) / 3, 6) AS sources FROM fused",
    "cross_match": f"{_CROSS} SELECT * FROM matched",
    "cross_validation": f"{_CROSS} SELECT * FROM valid",
    "validation_metrics": f"""{_CROSS} SELECT count(*) AS n, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('consistent', 'inconsistent', 'low_confidence', 'missing_ocr', 'missing_vision'))},
      round(avg((status = 'consistent')::INT), 6) AS convergence, round(coalesce(avg((score > 0.7)::INT) FILTER (action IS NULL), 0.0), 6) AS agreement FROM valid""",
    "keyed_components": f"""WITH {REGIONS_SQL} SELECT grp, text, count(*) AS n, sum(CASE WHEN id % 4 = 0 THEN 1 ELSE size END)::BIGINT AS pieces, min(id) AS first, arg_min(x1, id) AS x, count(DISTINCT id % 3) AS sources, min(x1) AS x1, min(y1) AS y1,
      max(x2) AS x2, max(y2) AS y2, max(conf) AS conf, arg_max(id, (length(material), -id)) AS longest, min(id) FILTER (id % 5 != 0) AS first_known FROM r GROUP BY ALL""",
    "most_complete": f"""WITH {REGIONS_SQL}, k AS (SELECT *, size % 4 + (kind != 'ECONOMY')::INT AS known FROM r)
      SELECT sheet, arg_max(id, (known, size % 4, -id)) AS id, max(known)::INT AS known, count(*) AS n FROM k GROUP BY 1""",
    "grid_lines": f"WITH {REGIONS_SQL} SELECT sheet, floor((y1 + y2) / 2 / 2000 * 10)::INT AS line, string_agg(text, ' ' ORDER BY floor((x1 + x2) / 2 / 2000 * 10), id) AS text FROM r GROUP BY ALL",
    "text_statistics": f"""WITH {REGIONS_SQL}, c AS (SELECT *, conf / 1000 AS c, length(text) AS n, (x2 - x1) * (y2 - y1) AS a FROM r)
      SELECT sheet, sum(n)::BIGINT AS characters, round(avg(c), 6) AS mean, min(conf) AS least, max(conf) AS most, count(*) FILTER (c >= 0.8) AS high, count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (c < 0.5) AS low,
        count(*) FILTER (n <= 5) AS short, count(*) FILTER (n > 20) AS long, round(least(sum(a) / 4000000, 1.0), 6) AS coverage,
        round(0.4::DOUBLE * avg(c) + 0.3::DOUBLE * least(sum(a) / 4000000, 1.0::DOUBLE) + 0.3::DOUBLE * least(count(*) / 400, 1.0::DOUBLE), 6) AS quality, round(greatest(0.0, 1 - var_pop(c)), 6) AS consistency FROM c GROUP BY 1""",
}
