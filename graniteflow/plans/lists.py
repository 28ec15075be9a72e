"""Pages with totals, look-ups, patches, deletions, unions, differences and look-up joins over stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.session import table

#: Columns that a patch may change.
PATCHABLE = ("o_totalprice", "o_orderstatus")
#: Most ids in one deletion.
DELETED = 20


def paged_totals(spark: SparkSession, sf_dir: str, status: str = "F", page: int = 3, size: int = 25) -> DataFrame:
    """One page of the orders of a status with the unpaged total and the number of pages; the limit is the feature."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
    total = rows.agg(F.count("*")).scalar()
    here = rows.orderBy("o_orderkey").offset((page - 1) * size).limit(size).select("o_orderkey", "o_custkey")
    return here.select("*", total.alias("total"), F.ceil(total / size).cast("long").alias("pages"))


def customer_page(spark: SparkSession, sf_dir: str, skip: int = 40, limit: int = 20) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_custkey").offset(skip).limit(limit).select("c_custkey", "c_name")


def point_lookup(spark: SparkSession, sf_dir: str, owner: int = 7) -> DataFrame:
    """Orders of one owner with a status: both predicates reach the scan."""
    return table(spark, sf_dir, "orders").where((F.col("o_custkey") == owner) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_custkey", "o_totalprice")


def composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items asked for by '<order>_<part>_<line>': only the first separator splits."""
    asked = table(spark, sf_dir, "orders").select(F.concat_ws("_", "o_orderkey", F.lit("1_x")).alias("asked"))
    parts = F.split("asked", "_", 2)
    keys = asked.select("asked", parts[0].try_cast("long").alias("l_orderkey"), parts[1].alias("rest"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("part"))
    return keys.join(lines, "l_orderkey", "left").select("asked", "rest", F.coalesce("n", F.lit(0)).alias("n"), "part")


def patch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after patches by id, of the allowed columns alone, and patches whose id is unknown as errors."""
    key = F.col("c_custkey")
    patches = table(spark, sf_dir, "customer").select(F.when(key % 5 == 0, -key).otherwise(key * 4).alias("o_orderkey"), F.lit("P").alias("new_status"), F.when(key % 2 == 0, 1.5).alias("new_price"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("known", F.lit(True))
    both = rows.join(patches.withColumn("patched", F.lit(True)), "o_orderkey", "full")
    error = F.when(F.col("known").isNull(), "unknown id")
    return both.select("o_orderkey", F.coalesce("new_status", "o_orderstatus").alias("status"), F.coalesce("new_price", "o_totalprice").alias("price"), F.coalesce("patched", F.lit(False)).alias("patched"), error.alias("error"))


def deleted_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left by status after those of one nation's owners are deleted."""
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def deletion(rows: DataFrame, ids: tuple[int | None, ...], key: str, busy: str) -> tuple[DataFrame, DataFrame]:
    """What is left of ``rows`` after those with these ids are deleted, and what became of each id as asked for, in order.

    Ids that no row has are errors, and so are those of rows for which ``busy`` holds, which stay. More than DELETED ids, as
    given, are refused before anything is read. A repeated id is answered each time as the first; a null one is not found.
    """
    if len(ids) > DELETED:
        raise ValueError(f"more than {DELETED} ids")
    asked = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"place int, {key} long")
    wanted = [i for i in set(ids) if i is not None]
    held = rows.where(F.col(key).isin(wanted)).groupBy(key).agg(F.max(F.coalesce(F.expr(busy), F.lit(False))).alias("_busy"))  # DELETED rows at most
    state = F.when(F.col("_busy").isNull(), "not found").when(F.col("_busy"), "being processed")
    report = asked.join(held, key, "left").select("place", key, F.when(state.isNull(), "success").otherwise("error").alias("status"), state.alias("message"))
    return rows.join(F.broadcast(held.where("NOT _busy").select(key)), key, "left_anti"), report


def deletion_report(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (3, 0, 1, 10**12, 3, 4, -7)) -> DataFrame:
    """What became of each id of a deletion of orders: orders in progress stay, unknown ids are errors."""
    return deletion(table(spark, sf_dir, "orders"), ids, "o_orderkey", "o_orderstatus = 'P'")[1]


def left_after_deletion(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (3, 0, 1, 10**12, 3, 4, -7)) -> DataFrame:
    """Orders that a deletion leaves."""
    return deletion(table(spark, sf_dir, "orders"), ids, "o_orderkey", "o_orderstatus = 'P'")[0].select("o_orderkey", "o_orderstatus")


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three sources under one schema, tagged by source, counted by nation."""
    named = lambda name, key, nation: table(spark, sf_dir, name).select(F.col(nation).alias("nation"), F.col(key).alias("key"), F.lit(name).alias("source"))
    every = named("customer", "c_custkey", "c_nationkey").unionByName(named("supplier", "s_suppkey", "s_nationkey")).unionByName(named("nation", "n_nationkey", "n_nationkey"))
    return every.groupBy("nation", "source").agg(F.count("*").alias("n"), F.min("key").alias("least"))


def missing_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in orders' owners but not in line items' parts and the other way round, with the side."""
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    right = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    both = left.withColumn("a", F.lit(1)).join(right.withColumn("b", F.lit(1)), "id", "full")
    return both.where("a IS NULL OR b IS NULL").select("id", F.when(F.col("b").isNull(), "owner_only").otherwise("part_only").alias("side"))


def id_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation the agreement of customers' and suppliers' ids, by Jaccard, and what follows from it."""
    side = lambda name, key, nation, flag: table(spark, sf_dir, name).select(F.col(nation).alias("nation"), (F.col(key) % 40).alias("id")).distinct().withColumn(flag, F.lit(1))
    both = side("customer", "c_custkey", "c_nationkey", "a").join(side("supplier", "s_suppkey", "s_nationkey", "b"), ["nation", "id"], "full")
    rate = F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*"), 6)
    rows = both.groupBy("nation").agg(rate.alias("agreement"))
    return rows.withColumn("advice", F.when(F.col("agreement") > 0.8, "accept").when(F.col("agreement") > 0.6, "check").otherwise("redo"))


def id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name among the labels of its brand: an equal one, without regard to case, else the first that holds it or that it holds.

    Labels are the distinct first words of names, a vocabulary, so they lie in an array beside each part.
    """
    labels = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.upper(F.element_at(F.split("p_name", " "), 1)))).alias("labels"))
    name = F.upper("p_name")
    exact = F.get(F.filter("labels", lambda x: x == name), F.lit(0))
    loose = F.get(F.filter("labels", lambda x: F.contains(name, x) | F.contains(x, name)), F.lit(0))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").join(labels, "p_brand", "left")
    return rows.select("p_partkey", F.coalesce(exact, loose).alias("label"), F.when(F.coalesce(exact, loose).isNotNull(), 0.8).otherwise(0.5).alias("confidence"))


def three_way_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their first line item's quantity and their nation's first customer; the look-ups are reduced before the joins."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("n"))
    owners = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("first_customer"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(lines, "s_suppkey", "left").join(owners, "s_nationkey", "left")
    return rows.select("s_suppkey", "first_order", F.coalesce("n", F.lit(1)).alias("n"), "first_customer")


def stage_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by type side by side, and which types are missing."""
    kinds = ["signup", "view", "click", "purchase", "error"]
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    missing = F.array_compact(F.array(*[F.when(F.col(k) == 0, k) for k in kinds]))
    return rows.select("user_id", *kinds, F.array_join(missing, ",").alias("missing"))


def status_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status and line items' return flags disagree, set right: open ones with a returned item are done."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey")
    fix = (F.col("o_orderstatus") == "O") & (F.col("returned") > 0)
    return rows.select("o_orderkey", F.when(fix, "SUCCESS").otherwise(F.col("o_orderstatus")).alias("status"), fix.alias("repaired"))


def cache_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's value from the first tier that has it: its own, its brand's, the whole; with the tier."""
    own = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("own"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    brand = part.where("p_size > 45").groupBy("p_brand").agg(F.max("p_size").cast("double").alias("shared"))
    rows = part.join(own, "p_partkey", "left").join(brand, "p_brand", "left")
    return rows.select("p_partkey", F.coalesce("own", "shared", F.lit(0.0)).alias("value"), F.when(F.col("own").isNotNull(), "single").when(F.col("shared").isNotNull(), "shared").otherwise("global").alias("tier"))


def source_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation suppliers against customers: which has over 1.2 times the other."""
    side = lambda name, nation, col: table(spark, sf_dir, name).groupBy(F.col(nation).alias("n_nationkey")).agg(F.count("*").alias(col))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(side("customer", "c_nationkey", "direct"), "n_nationkey", "left").join(side("supplier", "s_nationkey", "sliced"), "n_nationkey", "left")
    a, b = F.coalesce("direct", F.lit(0)), F.coalesce("sliced", F.lit(0)) * 10
    return rows.select("n_name", a.alias("direct"), b.alias("sliced"), F.when(b > a * 1.2, "sliced").when(a > b * 1.2, "direct").otherwise("either").alias("advice"))


QUERIES = {
    f.__name__: f
    for f in (
        paged_totals, customer_page, point_lookup, composite_lookup, patch_report, deleted_by_ids, deletion_report, left_after_deletion, union_sources, missing_both_ways, id_agreement, id_match, three_way_first, stage_synthesis,
        status_reconciliation, cache_tiers, source_advice,
    )
}
_KINDS = ["signup", "view", "click", "purchase", "error"]
ORACLES = {
    "paged_totals": "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, (SELECT ceil(count(*) / 25) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS pages FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 50",
    "customer_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'",
    "composite_lookup": """SELECT o_orderkey || '_1_x' AS asked, '1_x' AS rest, coalesce(n, 0) AS n, part FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS part FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "patch_report": """SELECT coalesce(o.o_orderkey, p.k) AS o_orderkey, coalesce(p.s, o_orderstatus) AS status, coalesce(p.price, o_totalprice) AS price, p.k IS NOT NULL AS patched, CASE WHEN o.o_orderkey IS NULL THEN 'unknown id' END AS error
      FROM orders o FULL JOIN (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey * 4 END AS k, 'P' AS s, CASE WHEN c_custkey % 2 = 0 THEN 1.5 END::DOUBLE AS price FROM customer) p ON p.k = o.o_orderkey""",
    "deleted_by_ids": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY 1",
    "deletion_report": """SELECT (place - 1)::INT AS place, o_orderkey, CASE WHEN o_orderstatus IS NULL OR o_orderstatus = 'P' THEN 'error' ELSE 'success' END AS status, CASE WHEN o_orderstatus IS NULL THEN 'not found' WHEN o_orderstatus = 'P' THEN 'being processed' END AS message
      FROM (SELECT unnest(range(1, 8)) AS place, unnest([3, 0, 1, 1000000000000, 3, 4, -7])::BIGINT AS o_orderkey) LEFT JOIN orders USING (o_orderkey)""",
    "left_after_deletion": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (3, 0, 1, 1000000000000, 4, -7) OR o_orderstatus = 'P'",
    "union_sources": """SELECT nation, source, count(*) AS n, min(key) AS least FROM (SELECT c_nationkey AS nation, c_custkey AS key, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 'supplier' FROM supplier
      UNION ALL SELECT n_nationkey, n_nationkey, 'nation' FROM nation) GROUP BY ALL""",
    "missing_both_ways": """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'owner_only' ELSE 'part_only' END AS side FROM (SELECT DISTINCT o_custkey AS id FROM orders) a FULL JOIN (SELECT DISTINCT l_partkey AS id FROM lineitem) b ON a.id = b.id
      WHERE a.id IS NULL OR b.id IS NULL""",
    "id_agreement": """SELECT nation, agreement, CASE WHEN agreement > 0.8 THEN 'accept' WHEN agreement > 0.6 THEN 'check' ELSE 'redo' END AS advice FROM (SELECT nation, round(count(*) FILTER (sides = 2) / count(*), 6) AS agreement
      FROM (SELECT nation, id, count(*) AS sides FROM (SELECT DISTINCT c_nationkey AS nation, c_custkey % 40 AS id, 'a' AS s FROM customer UNION ALL SELECT DISTINCT s_nationkey, s_suppkey % 40, 'b' FROM supplier) GROUP BY ALL) GROUP BY 1)""",
    "id_match": """SELECT p_partkey, label, CASE WHEN label IS NOT NULL THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT p_partkey, coalesce(list_filter(labels, lambda x: x = upper(p_name))[1],
      list_filter(labels, lambda x: contains(upper(p_name), x) OR contains(x, upper(p_name)))[1]) AS label FROM part LEFT JOIN (SELECT p_brand, list_sort(list(DISTINCT upper(split_part(p_name, ' ', 1)))) AS labels FROM part GROUP BY 1) USING (p_brand))""",
    "three_way_first": """SELECT s_suppkey, first_order, coalesce(n, 1) AS n, first_customer FROM supplier LEFT JOIN (SELECT l_suppkey, min(l_orderkey) AS first_order, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
      LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS first_customer FROM customer GROUP BY 1) ON c_nationkey = s_nationkey""",
    "stage_synthesis": f"""SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {k} = 0 THEN '{k}' END" for k in _KINDS)}) AS missing FROM (SELECT user_id, {', '.join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS)} FROM events GROUP BY 1)""",
    "status_reconciliation": """SELECT o_orderkey, CASE WHEN fix THEN 'SUCCESS' ELSE o_orderstatus END AS status, fix AS repaired FROM (SELECT o_orderkey, o_orderstatus, o_orderstatus = 'O' AND r > 0 AS fix FROM orders
      JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "cache_tiers": """SELECT p_partkey, coalesce(own, shared, 0.0)::DOUBLE AS value, CASE WHEN own IS NOT NULL THEN 'single' WHEN shared IS NOT NULL THEN 'shared' ELSE 'global' END AS tier FROM part
      LEFT JOIN (SELECT l_partkey, max(l_quantity) AS own FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN (SELECT p_brand, max(p_size)::DOUBLE AS shared FROM part WHERE p_size > 45 GROUP BY 1) USING (p_brand)""",
    "source_advice": """SELECT n_name, direct, sliced, CASE WHEN sliced > direct * 1.2 THEN 'sliced' WHEN direct > sliced * 1.2 THEN 'direct' ELSE 'either' END AS advice FROM (SELECT n_name, coalesce(d, 0) AS direct, coalesce(s, 0) * 10 AS sliced FROM nation
      LEFT JOIN (SELECT c_nationkey, count(*) AS d FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)""",
}
