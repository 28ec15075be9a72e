"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions alone.

A text falls into sections (after blank lines) and paragraphs (after line ends); the pieces joined give the
text again. A paragraph's digest is the SHA-256 of its text, a section's is over its paragraphs' and the
root over the sections'. So equal roots mean equal texts, and where roots differ, descending into the
branches whose digests differ locates the edits. For likeness a paragraph also has tags: 32-bit hashes of
its leaves (sentences, cut every 32 code points), cut from their MD5.

A fingerprint is a string: the root, then for each section ``/`` and its digest, for each paragraph ``:``
and its digest, ``=`` and its leaves' tags of eight digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where sections and paragraphs end, and what a leaf is.
SECTION, PARAGRAPH, LEAF = r"(?<=\n\n)(?!\n)", r"(?<=\n)", r"[^.!?\n]{1,32}[.!?\n]*|[.!?\n]+"
DIGITS = 16


def tree(text: Column) -> Column:
    """An array of sections, each an array of paragraphs (digest, tags); the empty text has none."""
    tag = lambda leaf: F.left(F.md5(leaf), F.lit(8))
    tags = lambda paragraph: F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), tag)
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("digest"), tags(p).alias("tags"))
    paragraphs = lambda section: F.transform(F.filter(F.split(section, PARAGRAPH), lambda p: p != ""), paragraph)
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SECTION), lambda s: s != ""), paragraphs)


def with_digests(nested: Column) -> Column:
    """The tree with a digest for each section: an array of sections (digest, paragraphs)."""
    digest = lambda section: F.sha2(F.array_join(F.transform(section, lambda p: p["digest"]), ""), 256)
    return F.transform(nested, lambda section: F.struct(digest(section).alias("digest"), section.alias("paragraphs")))


def rendered(sections: Column) -> Column:
    """The fingerprint string of ``with_digests``."""
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ""), 256)
    part = lambda p: F.concat(F.lit(":"), F.left(p["digest"], F.lit(DIGITS)), F.lit("="), F.array_join(p["tags"], ""))
    inner = lambda s: F.concat(F.lit("/"), F.left(s["digest"], F.lit(DIGITS)), F.array_join(F.transform(s["paragraphs"], part), ""))
    return F.concat(root, F.array_join(F.transform(sections, inner), ""))


def root_of(fingerprint: Column) -> Column:
    return F.left(fingerprint, F.lit(64))


def likeness(root: Column, tags: Column, other_root: Column, other_tags: Column) -> Column:
    """1 for equal roots, else twice the shared distinct tags over both counts, and less than 1; 0 if either has no leaf.

    Texts of the same leaves in another order or number have unequal roots: half a leaf is taken off.
    """
    both = F.size(tags) + F.size(other_tags)
    shared = F.size(F.array_intersect(tags, other_tags))
    return F.when(root == other_root, 1.0).when(both == 0, 0.0).otherwise(F.least(2.0 * shared / both, 1.0 - 1.0 / (2.0 * both)))


def with_fingerprint(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>fingerprint``, ``<prefix>tags`` and ``<prefix>sections`` (digests alone) of the column ``text``.

    explode over an array of one keeps the tree from being computed once for each of them.
    """
    df = df.select("*", F.explode(F.array(with_digests(tree(F.col(text))))).alias("_sections"))
    tags = F.array_distinct(F.flatten(F.flatten(F.transform("_sections", lambda s: F.transform(s["paragraphs"], lambda p: p["tags"])))))
    light = F.transform("_sections", lambda s: F.struct(s["digest"].alias("digest"), F.transform(s["paragraphs"], lambda p: p["digest"]).alias("paragraphs")))
    return df.select("*", rendered(F.col("_sections")).alias(f"{prefix}fingerprint"), tags.alias(f"{prefix}tags"), light.alias(f"{prefix}sections")).drop("_sections")


def differing_branches(sections: Column, other: Column) -> Column:
    """Paths ``section.paragraph`` (from 0) of the paragraphs that ``other`` doesn't have in the same place, in order.

    sections, other: arrays of (digest, paragraphs) as ``with_fingerprint`` gives them. Sections whose digests
    agree in their places are passed over with all below them; in the others the paragraphs are compared in
    their places. So edited, new and moved paragraphs are found.
    """
    unlike = lambda s, i: ~F.coalesce(F.get(other, i)["digest"] == s["digest"], F.lit(False))
    path = lambda i, j: F.concat_ws(".", i.cast("string"), j.cast("string"))
    below = lambda s, i: F.filter(
        F.transform(s["paragraphs"], lambda p, j: F.when(~F.coalesce(F.get(F.get(other, i)["paragraphs"], j) == p, F.lit(False)), path(i, j))), lambda x: x.isNotNull()
    )
    return F.flatten(F.transform(sections, lambda s, i: F.when(unlike(s, i), below(s, i)).otherwise(F.array().cast("array<string>"))))


def differing_paragraphs(fingerprint: Column, other: Column) -> Column:
    """Positions (from 0, over all sections) of the paragraphs of ``fingerprint`` that ``other`` has nowhere: edited or new ones."""
    paragraphs = lambda f: F.regexp_extract_all(f, F.lit(f":([0-9a-f]{{{DIGITS}}})="), F.lit(1))
    theirs = paragraphs(other)
    return F.filter(F.transform(paragraphs(fingerprint), lambda p, i: F.when(~F.array_contains(theirs, p), i)), lambda i: i.isNotNull())


#: Where rows without an id stand: last in descending order.
LOWEST = -(2**63)


def _places(df: DataFrame, ranges: int) -> tuple[Column, dict[int, tuple[int, int]]]:
    """A column that numbers ranges of (_key, _tie) from 0 upwards, and the largest (_key, _tie) of each range that has rows.

    The driver gets a sample of some rows for each range and one row for each range.
    """
    rows = df.count()
    share = min(1.0, 20 * ranges / max(rows, 1))
    drawn = sorted((r[0], r[1]) for r in df.select("_key", "_tie").sample(fraction=share, seed=11).collect())
    bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")  # one constant, however long
    number = F.lit(0)
    if bounds:
        below = lambda b: (b["k"] < F.col("_key")) | ((b["k"] == F.col("_key")) & (b["t"] < F.col("_tie")))
        passed = lambda values: F.aggregate(values, F.lit(0), lambda n, b: n + F.when(below(b), 1).otherwise(0))
        pairs = lambda part: F.arrays_zip(literal([k for k, _ in part]).alias("k"), literal([t for _, t in part]).alias("t"))
        block = F.greatest(passed(pairs(bounds[::step])) - 1, F.lit(0))
        number = block * step + passed(F.slice(pairs(bounds), block * step + 1, step))
    number = number.cast("int")
    largest = df.select(number.alias("range"), "_key", "_tie").groupBy("range").agg(F.max(F.struct("_key", "_tie")).alias("most")).collect()
    return number, {r["range"]: tuple(r["most"]) for r in largest}


def with_next(docs: DataFrame, id_column: str = "doc_id", ranges: int | None = None, rows_each: int = 20_000) -> tuple[DataFrame, Window]:
    """Rows dealt to ranges of ids, in which a window finds each row's successor in descending order of ids.

    Rows of one id, or of none, follow one another by their column _tie, a hash of their text, and are dealt
    to several ranges where they are many. Each range also gets, as ``guest`` rows, the first rows of the
    range after it (the last range those of the first), so no window spans the table. ranges: by default
    one for ``rows_each`` rows, at least 64. Returns the rows with columns range and guest and the window.
    """
    docs = docs.withColumn("_key", F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)))
    ranges = ranges or min(16_384, max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows_each))
    number, largest = _places(docs, ranges)
    order = sorted(largest, reverse=True)
    window = Window.partitionBy("range").orderBy("guest", F.col("_key").desc(), F.col("_tie").desc())
    if not order:
        return docs.withColumns({"range": F.lit(0), "guest": F.lit(False)}), window
    host = {r: order[i - 1] for i, r in enumerate(order)}  # the range before; before the first: the last
    size = max(order) + 1
    table = lambda values: F.split(F.lit(",".join(str(values.get(r, 0)) for r in range(size))), ",").cast("array<long>")
    lookup = lambda values: F.get(table(values), F.col("_own"))
    first = (F.col("_key") == lookup({r: k for r, (k, _) in largest.items()})) & (F.col("_tie") == lookup({r: t for r, (_, t) in largest.items()}))
    own = F.struct(F.col("_own").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(lookup(host).cast("int").alias("range"), F.lit(True).alias("guest"))
    rows = docs.withColumn("_own", number).select("*", F.inline(F.when(first, F.array(own, guest)).otherwise(F.array(own)))).drop("_own")
    return rows, window


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text and their likeness, as op1 asks.

    The edited text is the text with its last third replaced by as much of the beginning of the next
    document, in descending order of doc_id; after the last comes the first, and a single document
    follows itself. Null text counts as empty; the empty text has a fingerprint without leaves and is
    its own edit, likeness 1. Null ids come last. Repeated ids follow one another by their texts' hashes
    (repeated rows are each other's successors). An empty table gives no rows. Other columns are ignored.
    edited_branches: paths of the paragraphs of the edited text that the text doesn't have there, joined by commas.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows, order = with_next(docs)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("*", n.cast("long").alias("n_chars"), F.lead("text").over(order).alias("_next"))
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)))
    rows = with_fingerprint(rows.drop("_next"), "text", "")
    rows = with_fingerprint(rows.drop("text"), "_edited", "edited_")
    rows = rows.select(
        "doc_id", "range", "guest", "_key", "_tie", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "tags",
        likeness(root_of(F.col("fingerprint")), F.col("tags"), root_of(F.col("edited_fingerprint")), F.col("edited_tags")).alias("near_edited"),
        F.array_join(differing_branches(F.col("edited_sections"), F.col("sections")), ",").alias("edited_branches"),
    )
    rows = rows.select("*", F.lead(F.struct(root_of(F.col("fingerprint")).alias("root"), "tags")).over(order).alias("_next")).where(~F.col("guest"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        likeness(root_of(F.col("fingerprint")), F.col("tags"), F.col("_next.root"), F.col("_next.tags")).alias("near_next"), "edited_branches",
    )


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))

