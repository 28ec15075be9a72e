"""Points in the order of a space-filling curve: tables of which a look-up by box reads few row groups, and joins of points with boxes by blocks of the curve."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteflow.operators.greedy import cut

#: Bits of a coordinate: pixels from 0 to 16,777,215. Others count as the nearest of these, so they are found, only not fast.
BITS = 24
MOST = (1 << BITS) - 1


def pixel(value: Column) -> Column:
    """The coordinate as a whole number of BITS bits. It never falls as value grows, so a box's pixels hold those of all points in it."""
    return F.floor(F.greatest(F.least(value.cast("double"), F.lit(float(MOST))), F.lit(0.0)))


def _number(x: int, y: int) -> int:
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(BITS))


def _apart(value: Column) -> Column:
    """The bits of a pixel with a zero after each: its binary digits read to the base of 4."""
    return F.conv(F.bin(value), 4, 10).cast("long")


def place(x: Column, y: Column) -> Column:
    """The point's number on the curve: the bits of x and y in turn. Null if a coordinate is null."""
    return F.when(x.isNotNull() & y.isNotNull(), _apart(pixel(x)).bitwiseOR(F.shiftleft(_apart(pixel(y)), 1)))


def ranges(box: tuple[float, float, float, float], most: int = 48) -> list[tuple[int, int]]:
    """Ranges of the curve, ``most`` at most, that together hold every pixel of the box (x1, y1, x2, y2), edges included.

    The square is quartered, largest blocks first, until blocks lie within the box or there are enough of them; what
    a block holds beside the box is left to the look-up's exact test. A box without points gives none.
    """
    x1, y1, x2, y2 = (int(min(max(v, 0), MOST)) for v in box)
    if box[0] > box[2] or box[1] > box[3]:
        return []
    inside, split = [], deque([(0, 0, BITS)])
    while split and len(inside) + len(split) + 3 <= most:
        x, y, bits = split.popleft()
        end = (1 << bits) - 1
        if x1 <= x and x + end <= x2 and y1 <= y and y + end <= y2:
            inside.append((x, y, bits))
            continue
        half = 1 << bits - 1
        quarters = [(x + dx, y + dy, bits - 1) for dy in (0, half) for dx in (0, half)]
        split += [q for q in quarters if q[0] <= x2 and q[0] + half > x1 and q[1] <= y2 and q[1] + half > y1]
    out: list[tuple[int, int]] = []
    for low, high in sorted((_number(x, y), _number(x, y) + 4**bits - 1) for x, y, bits in [*inside, *split]):
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def write_in_order(rows: DataFrame, folder: str, x: str = "x", y: str = "y", within: tuple[str, ...] = (), files: int | None = None, block: int = 8 << 20) -> None:
    """Writes rows by ``within``, then along the curve, with their number as ``place``: files and row groups hold neighbours.

    ``block``: bytes of a row group. Rows of one point are told apart by their number in the input, so very many of them
    are spread. Rows without a place come first. A column ``place`` of the input is replaced.
    """
    rows = rows.withColumn("place", place(F.col(x), F.col(y)))
    order = [*within, "place"]
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*([files] if files else []), *order, "_tie").sortWithinPartitions(*order).drop("_tie")
    dealt.write.mode("errorifexists").option("parquet.block.size", block).parquet(folder)


def in_box(rows: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y", most: int = 48) -> DataFrame:
    """Rows of a table written by ``write_in_order`` that lie in the box, edges included; ranges of the curve reach the scan."""
    near = reduce(Column.__or__, [F.col("place").between(low, high) for low, high in ranges(box, most)], F.lit(False))
    return rows.where(near).where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every point with every box of its group that holds it, edges included; the box's columns end in '_'.

    points: grp, x, y; boxes: grp, x1, y1, x2, y2; both with what else there is. A box is known by the blocks of the
    curve that its corners lie in, of the least size that isn't below the box's longer side: four at most, which hold
    all of it. Points meet it by their block of that size: an equi-join, with a copy of the point for each size
    that boxes have, at most one for each bit. Null groups, coordinates and empty boxes meet nothing.
    """
    corners = F.array(*[place(F.col(a), F.col(b)) for a in ("x1", "x2") for b in ("y1", "y2")])
    long_side = F.greatest(pixel(F.col("x2")) - pixel(F.col("x1")), pixel(F.col("y2")) - pixel(F.col("y1")))
    size = F.when(long_side > 0, F.length(F.bin(long_side))).otherwise(0)
    held = boxes.where("x1 <= x2 AND y1 <= y2 AND grp IS NOT NULL").withColumns({"_corners": corners, "_size": size})
    held = cut(held.withColumn("_block", F.explode(F.array_distinct(F.transform("_corners", lambda c: F.call_function("shiftright", c, 2 * F.col("_size"))))))).drop("_corners")
    sizes = sorted(r[0] for r in held.select("_size").distinct().collect())  # BITS + 1 values at most
    held = held.withColumnsRenamed({c: f"{c}_" for c in boxes.columns if c != "grp"})
    shown = points.where("grp IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    shown = shown.withColumn("_block", F.call_function("shiftright", place(F.col("x"), F.col("y")), 2 * F.col("_size")))
    return shown.join(held, ["grp", "_size", "_block"]).where("x BETWEEN x1_ AND x2_ AND y BETWEEN y1_ AND y2_").drop("_size", "_block")
