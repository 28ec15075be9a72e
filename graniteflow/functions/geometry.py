"""Column helpers on boxes (x1, y1, x2, y2), points, tiles and sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def centre(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def squared_distance(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def clamped(value: Column, most: int) -> Column:
    """Between 0 and most, to two decimals."""
    return F.round(F.greatest(F.lit(0.0), F.least(value.cast("double"), F.lit(float(most)))), 2)


def cells(low: Column, high: Column, size: int) -> Column:
    """Numbers of the grid cells that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def cell(value: Column, size: int = 100) -> Column:
    """The grid line at or towards 0 from a coordinate."""
    return (value / size).cast("long") * size


def sides(suffix: str = "") -> list[Column]:
    return [F.col(c + suffix) for c in BOX]


def shared_area(a: str = "", b: str = "_") -> Column:
    """Area that the boxes of columns with suffixes a and b share; null if a side is null."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = sides(a), sides(b)
    wide, high = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    known = reduce_and(*[c.isNotNull() for c in sides(a) + sides(b)])
    return F.when(known, F.when((wide > 0) & (high > 0), wide * high).otherwise(0).cast("double"))


def reduce_and(*tests: Column) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def area(suffix: str = "") -> Column:
    x1, y1, x2, y2 = sides(suffix)
    return (x2 - x1) * (y2 - y1)


def iou(a: str = "", b: str = "_") -> Column:
    """Intersection over union; 0 for boxes that don't meet or have no area, null if a side is null."""
    shared = shared_area(a, b)
    return F.when(shared.isNull(), None).otherwise(F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0)))


def overlaps(a: str = "", b: str = "_", least: float = 0.3) -> Column:
    """Whether the shared area is over ``least`` of either box's."""
    shared = shared_area(a, b)
    return F.coalesce(F.try_divide(shared, area(a)) > least, F.lit(False)) | F.coalesce(F.try_divide(shared, area(b)) > least, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger of two positive sizes; 0 if one isn't positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def size_likeness(a: str = "", b: str = "_") -> Column:
    """Mean of the ratios of widths and heights; 0 for a box without area."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = sides(a), sides(b)
    wide, high = ratio(ax2 - ax1, bx2 - bx1), ratio(ay2 - ay1, by2 - by1)
    return F.when((wide > 0) & (high > 0), (wide + high) / 2).otherwise(0.0)


def centre_distance(a: str = "", b: str = "_") -> Column:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = sides(a), sides(b)
    return F.hypot((ax1 + ax2 - bx1 - bx2) / 2, (ay1 + ay2 - by1 - by2) / 2)


def spatial_likeness(a: str = "", b: str = "_", tolerance: float = 50.0) -> Column:
    """0.6 for near centres and 0.4 for like areas."""
    return F.greatest(F.lit(0.0), 1 - centre_distance(a, b) / tolerance) * 0.6 + ratio(area(a), area(b)) * 0.4


def hull(points: Column) -> Column:
    """The box around an array of points (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The four corners of a box as points, clockwise from the top left."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def moved(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


#: Largest side of a tile, and what two tiles share (a tenth, rounded down).
LARGEST_TILE, SHARED = 2048, 204


def slicing_plan(width: Column, height: Column) -> Column:
    """Columns and rows of tiles of a sheet and a tile's size; one tile for a sheet that needs none."""

    def along(side: Column) -> tuple[Column, Column]:
        n = F.ceil(side / (LARGEST_TILE - SHARED)).cast("int")
        return n, F.least(F.lit(LARGEST_TILE), F.floor((side + SHARED * (n - 1)) / n)).cast("int")

    (nx, w), (ny, h) = along(width), along(height)
    whole = (width <= LARGEST_TILE) & (height <= LARGEST_TILE)
    one = lambda many, single: F.when(whole, single).otherwise(many).cast("int")
    return F.struct(one(nx, F.lit(1)).alias("nx"), one(ny, F.lit(1)).alias("ny"), one(w, width).alias("tile_width"), one(h, height).alias("tile_height"), (~whole).alias("sliced"))


def tiles_of(width: Column, height: Column) -> Column:
    """The tiles of a sheet by ``slicing_plan``: row, col, x, y, width, height and what each side shares with its neighbour.

    Tiles at the right and bottom that would reach over the sheet are set back to its edge.
    """
    plan = slicing_plan(width, height)
    nx, ny, w, h = plan["nx"], plan["ny"], plan["tile_width"], plan["tile_height"]
    at = lambda i, size, side: F.least(i * (size - SHARED), F.greatest(F.lit(0), side - size)).cast("int")
    share = lambda test: F.when(test, SHARED).otherwise(0)

    def tile(row: Column, col: Column) -> Column:
        return F.struct(
            row.cast("int").alias("row"), col.cast("int").alias("col"), at(col, w, width).alias("x"), at(row, h, height).alias("y"), w.alias("width"), h.alias("height"),
            share(col > 0).alias("left"), share(row > 0).alias("top"), share(col < nx - 1).alias("right"), share(row < ny - 1).alias("bottom"),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), ny - 1), lambda row: F.transform(F.sequence(F.lit(0), nx - 1), lambda col: tile(row, col))))


def adaptive_size(width: Column, height: Column, density: Column) -> Column:
    """Kind, tile side and overlap by the sheet's area and how much of it is drawn on."""
    whole = width.cast("double") * height
    plan = lambda kind, size: F.struct(F.lit(kind).alias("kind"), F.lit(size).alias("size"), F.lit(size // 8).alias("overlap"))
    return F.when(whole < 2048 * 2048, plan("fine_grain", 512)).when(whole > 8192 * 8192, plan("coarse_grain", 2048)).when(density > 0.15, plan("balanced", 768)).otherwise(plan("balanced", 1024))


def adaptive_tiles(width: Column, height: Column, density: Column) -> Column:
    """row, col, x, y, width and height of the tiles by ``adaptive_size``; those under half a side are left out."""
    plan = adaptive_size(width, height, density)
    size, step = plan["size"], plan["size"] - plan["overlap"]
    count = lambda side: F.greatest(F.lit(1), F.floor((side - plan["overlap"]) / step).cast("int"))

    def tile(row: Column, col: Column) -> Column:
        x, y = col * step, row * step
        return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.least(size, width - x).cast("int").alias("width"), F.least(size, height - y).cast("int").alias("height"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), count(height) - 1), lambda row: F.transform(F.sequence(F.lit(0), count(width) - 1), lambda col: tile(row, col))))
    return F.filter(every, lambda t: (t["width"] >= F.floor(size / 2)) & (t["height"] >= F.floor(size / 2)))


def adaptive_count(width: Column, height: Column, density: Column) -> Column:
    """n and pixels of the tiles of ``adaptive_tiles``, without making them: along a side of a tile's length or more all tiles are whole; along a shorter one there is one, if half a tile fits."""
    plan = adaptive_size(width, height, density)
    size, overlap = plan["size"], plan["overlap"]
    along = lambda side: F.when(side >= size, F.floor((side - overlap) / (size - overlap))).when(side >= F.floor(size / 2), 1).otherwise(0)
    n = along(width) * along(height)
    return F.struct(n.cast("int").alias("n"), (n * F.least(size, width) * F.least(size, height)).cast("long").alias("pixels"))


def priority(density: Column) -> Column:
    return F.when(density > 0.1, "high").when(density > 0.05, "medium").otherwise("low")


def estimated_tiles(width: Column, height: Column) -> Column:
    """A quick estimate of a sheet's tiles, nine tenths of a tile each way; it may differ from the plan."""
    along = lambda side: F.greatest(F.lit(1), F.ceil(side / (LARGEST_TILE * 0.9)).cast("int"))
    return F.when(F.greatest(width, height) <= LARGEST_TILE, 1).otherwise(along(width) * along(height))


def tile_place(index: Column, total: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """Row and column of a tile by its place on a sheet, or by its number on a square of tiles if the sheet has no size."""
    rows = F.ceil(F.sqrt(total * height / width))
    cols = F.ceil(total / rows)
    by = lambda at, side, n: F.least(F.floor(at / F.greatest(F.lit(1), F.floor(side / n))), n - 1)
    square = F.greatest(F.lit(1), F.ceil(F.sqrt(total)))
    sized = (width > 0) & (height > 0)
    pick = lambda a, b: F.greatest(F.lit(0), F.when(sized, a).otherwise(b)).cast("int")
    return F.struct(pick(by(y, height, rows), F.floor(index / square)).alias("row"), pick(by(x, width, cols), index % square).alias("col"))


def adjacent(row: Column, col: Column, row_: Column, col_: Column) -> Column:
    return (F.abs(row - row_) <= 1) & (F.abs(col - col_) <= 1) & ((row != row_) | (col != col_))


def near_edge(width: Column, height: Column, kind: Column, reach: float = 20.0) -> Column:
    """Whether a box (x1 .. y2) lies within reach of its tile's edge, half as far again for codes, dimensions and axes; false for a tile without size."""
    x1, y1, x2, y2 = sides()
    near = F.when(kind.isin("component_id", "dimension", "axis"), reach * 1.5).otherwise(reach)
    return (width != 0) & (height != 0) & ((x1 <= near) | (x2 >= width - near) | (y1 <= near) | (y2 >= height - near))


def in_shared_band(left: Column, top: Column, right: Column, bottom: Column, side: int = LARGEST_TILE) -> Column:
    """Whether a box's centre lies in the bands that a tile shares with its neighbours."""
    x, y = centre("x1", "x2"), centre("y1", "y2")
    return (x < left) | (x > side - right) | (y < top) | (y > side - bottom)


def needs_slicing(width: Column, height: Column, size: Column) -> Column:
    """Why a sheet needs tiles: its width, height or file size; an empty array if it doesn't."""
    return F.array_compact(F.array(F.when(width > LARGEST_TILE, "width"), F.when(height > LARGEST_TILE, "height"), F.when(size > 1.5 * (1 << 20), "size")))


def use_slicing(force: Column, automatic: Column, width: Column, height: Column, most: int = LARGEST_TILE) -> Column:
    """The forced choice, else whether automatic slicing is on and the longer side is over ``most``."""
    return F.coalesce(force, automatic & (F.greatest(width, height) > most))


def complexity(size: Column, width: Column, height: Column, extension: Column) -> Column:
    """A score from 0 to 10 of pixels, megabytes, file type and aspect ratio."""
    pixels, mb = width.cast("double") * height, size / (1 << 20)
    steps = lambda value, *bounds: F.coalesce(*[F.when(value > b, float(len(bounds) - i)) for i, b in enumerate(bounds)], F.lit(0.0))
    kind = F.when(extension.isin("dwg", "dxf"), 2.0).when(extension == "pdf", 1.5).when(extension.isin("tiff", "tif"), 1.0).otherwise(0.0)
    long = F.when((width > 0) & (height > 0) & (F.greatest(F.try_divide(width, height), F.try_divide(height, width)) > 3), 1.0).otherwise(0.0)
    return F.least(F.lit(10.0), steps(pixels, 50_000_000, 20_000_000, 8_000_000, 2_000_000) + steps(mb, 50, 20, 5) + kind + long)


def scale(text_height: Column, width: Column, height: Column, want: float = 24.0, most: int = 4096) -> Column:
    """Factor for resizing: by the height of text within 0.5 to 3 where it is known (over 0), else to the largest side or up to 1024."""
    side = F.greatest(width, height)
    by_text = F.greatest(F.lit(0.5), F.least(F.lit(3.0), want / F.when(text_height > 0, text_height), most / side))
    return F.when(text_height > 0, by_text).when(side > most, most / side).when(side < 1024, F.least(F.lit(2.0), 1024 / side)).otherwise(1.0)


def discrepancies(text: Column, label: Column, dx: Column, dy: Column, most: float = 20.0) -> Column:
    """What differs between a text and a component: text, place."""
    return F.array_compact(F.array(F.when(~text.eqNullSafe(label), "text_mismatch"), F.when((F.abs(dx) > most) | (F.abs(dy) > most), "coordinate_mismatch")))
