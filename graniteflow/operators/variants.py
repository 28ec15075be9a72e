"""Documents of any shape: flattened to paths and values level by level, pruned, and put together again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteflow.operators.greedy import cut

PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_]*$"


def _kind(v: Column) -> Column:
    """object, array, null, or the type of a plain value; null for SQL null."""
    shape = F.schema_of_variant(v)
    return F.when(v.isNull(), F.lit(None)).when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null").otherwise(F.lower(shape))


def _step(key: Column, pos: Column, parent: Column) -> Column:
    named = F.when(key.rlike(PLAIN_KEY), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('."'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.when(parent == "array", F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).otherwise(named)


def flattened(rows: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """A row for each node of each document, with keys, depth, path, parent, name, place, kind and value (of plain values, as text).

    doc: a column of JSON texts. Paths are like ``$.a[0].b``; name is the key in an object, place the position in an array
    or among an object's keys in order of their names. Containers have rows too, with kind object or array and no value.
    A text that is no JSON gives one row of kind ``invalid``, a null text one of kind null. Every level is one
    pass over what the level before holds in containers, so depth has no limit, and no document is taken apart in one task's memory twice.
    """
    root = rows.select(*keys, F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("place"), F.col(doc).alias("_doc"), F.try_parse_json(doc).alias("_v"))
    kind = F.when(F.col("_doc").isNull(), F.lit(None)).when(F.col("_v").isNull(), "invalid").otherwise(_kind(F.col("_v")))
    level = cut(root.withColumn("kind", kind).drop("_doc"))
    plain = ["depth", "path", "parent", "name", "place", "kind"]
    out = []
    while True:
        value = F.when(~F.col("kind").isin("object", "array", "null", "invalid"), F.expr("try_variant_get(_v, '$', 'string')"))
        out.append(level.select(*keys, *plain, value.alias("value")))
        inner = level.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, out)
        children = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        found = children.select(*keys, (F.col("depth") + 1).alias("depth"), F.concat("path", _step(F.col("key"), F.col("pos"), F.col("kind"))).alias("path"), F.col("path").alias("parent"), F.when(F.col("kind") == "object", F.col("key")).alias("name"), F.col("pos").cast("int").alias("place"), F.col("value").alias("_v"))
        level = cut(found.withColumn("kind", F.coalesce(_kind(F.col("_v")), F.lit("null"))))


def _empty_objects(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.where("kind = 'object'").join(nodes.select(*keys, F.col("parent").alias("path")).distinct(), [*keys, "path"], "left_anti")


def pruned(nodes: DataFrame, keys: list[str], deep: bool = False) -> DataFrame:
    """Nodes without null and empty values and, in objects, empty objects; roots stay, and so do arrays that have become empty.

    An object that loses all its members stays as an empty one, unless ``deep``: then it goes too, from the bottom up, one
    level a round. keys must tell the documents apart and not be null.
    """
    nodes = cut(nodes)
    gone = (F.col("depth") > 0) & ((F.col("kind") == "null") | ((F.col("kind") == "string") & (F.col("value") == "")))
    kept = nodes.where(~F.coalesce(gone, F.lit(False)))
    in_objects = lambda df: df.where("depth > 0 AND name IS NOT NULL").select(*keys, "path")
    if not deep:  # only objects in objects are joined
        asked = F.coalesce((F.col("depth") > 0) & F.col("name").isNotNull() & (F.col("kind") == "object"), F.lit(False))
        full = kept.where(asked).join(nodes.select(*keys, F.col("parent").alias("path")).hint("merge"), [*keys, "path"], "left_semi")
        return kept.where(~asked).unionByName(full)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest, 0, -1):
        kept = cut(kept)
        kept = kept.join(in_objects(_empty_objects(kept, keys).where(F.col("depth") == depth)), [*keys, "path"], "left_anti")
    return kept


def assembled(nodes: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """keys and doc: each document's nodes as JSON text again, object keys in order of their names, numbers and booleans as they were read; also how many nodes it has, as column ``count``.

    From the deepest level up, children meet their parents in one grouping a level; a document is one row, so its text is built in one task.
    Nodes whose parent isn't there aren't in the text and don't count. keys must tell the documents apart and not be null.
    """
    nodes = cut(nodes)
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    text = F.when(F.col("kind") == "string", quoted(F.col("value"))).when(F.col("kind") == "null", "null").otherwise(F.col("value"))
    shown = F.coalesce(text, F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]"))
    own = F.struct("parent", "name", "place", "kind", shown.alias("text"))
    rows = nodes.select(*keys, "depth", "path", own.alias("own"), F.lit(None).cast("struct<place:int,part:string,n:bigint>").alias("child"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    built = rows.where(F.col("depth") == deepest).select(*keys, "path", "own.*", F.lit(1).cast("long").alias("n"))
    for depth in range(deepest, 0, -1):
        part = F.concat(F.when(F.col("name").isNotNull(), F.concat(quoted(F.col("name")), F.lit(":"))).otherwise(""), F.col("text"))
        children = built.select(*keys, F.col("parent").alias("path"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"), F.struct(F.col("place").cast("int").alias("place"), part.alias("part"), "n").alias("child"))
        both = rows.where(F.col("depth") == depth - 1).select(*keys, "path", "own", "child").unionByName(children)
        met = both.groupBy(*keys, "path").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("child")).alias("inner")).where("own IS NOT NULL")
        inner = F.array_join(F.transform("inner", lambda x: x["part"]), ",")
        whole = F.when(F.size("inner") == 0, F.col("own.text")).when(F.col("own.kind") == "object", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
        held = F.aggregate("inner", F.lit(1).cast("long"), lambda n, x: n + x["n"])
        built = cut(met.select(*keys, "path", "own.parent", "own.name", "own.place", "own.kind", whole.alias("text"), held.alias("n")))
    return built.select(*keys, F.col("text").alias("doc"), *([F.col("n").alias(count)] if count else []))


def recognised_lines(rows: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """Lines of recognition results ``[[points, [text, confidence]], ...]``: keys, id (place in the list), text, confidence and a box.

    A list in one more list is taken out of it first. Null lines, and lines of another shape, give no row but count in the places.
    """
    read = lambda path, kind: F.expr(f"try_variant_get(_v, '{path}', '{kind}')")
    lists = rows.select(*keys, F.try_parse_json(doc).alias("_v")).select(*keys, read("$", "array<variant>").alias("outer"), read("$[0]", "array<variant>").alias("inner"))
    lines = F.when((F.size("outer") == 1) & F.col("inner").isNotNull(), F.col("inner")).otherwise(F.col("outer"))
    one = lists.select(*keys, F.posexplode(lines).alias("id", "_v")).where(F.col("_v").isNotNull())
    one = one.select(*keys, "id", F.size(read("$", "array<variant>")).alias("parts"), F.size(read("$[1]", "array<variant>")).alias("said"), read("$[0]", "array<array<double>>").alias("points"), read("$[1][0]", "string").alias("text"), read("$[1][1]", "double").alias("confidence"))
    side = lambda i, f: f(F.transform("points", lambda p: p[i]))
    good = one.where("parts = 2 AND said = 2 AND size(points) > 0 AND forall(points, p -> size(p) >= 2) AND text IS NOT NULL")
    return good.select(*keys, "id", "text", "confidence", side(0, F.array_min).alias("x1"), side(1, F.array_min).alias("y1"), side(0, F.array_max).alias("x2"), side(1, F.array_max).alias("y2"))
