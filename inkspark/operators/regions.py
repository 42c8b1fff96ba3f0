"""Lines, cells and boxes on a page: islands, range joins, clusters and fits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.operators.sides import small


def islands(rows: DataFrame, keys: list[str], start: Column, end: Column, tie: list[str], name: str = "island") -> DataFrame:
    """Numbers runs of overlapping half-open extents: a new one starts at or after the greatest end so far."""
    with_ends = rows.withColumns({"__start": start, "__end": end})
    order = Window.partitionBy(*keys).orderBy("__start", *tie)
    reach = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = with_ends.withColumn("__new", F.when(reach.isNull() | (F.col("__start") >= reach), 1).otherwise(0))
    return new.withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__start", "__end", "__new")


def glyphs(components: DataFrame) -> DataFrame:
    """Components of a glyph's size and shape."""
    ratio = F.col("width") / F.col("height")
    return components.filter(F.col("height").between(8, 24) & ratio.between(0.2, 2.5))


def line_boxes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box and number of rows by key."""
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(right).alias("right"), F.max(bottom).alias("bottom"))


def skew_degrees(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Lean of the least-squares line through each key's points; 0 with fewer than two, or none apart in x."""
    sxx, sxy = F.regr_sxx(y, x), F.regr_sxy(y, x)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 2) & (sxx > 0), F.degrees(F.atan2(sxy, sxx))).otherwise(0.0).alias("skew"))


def in_spans(cells: DataFrame, layout: DataFrame, form: str, line: str, position: str) -> DataFrame:
    """Cells joined to the field whose span holds their position.

    Format and line are equal, the span is the condition.
    """
    spans = small(layout)
    held = (cells[form] == spans["format"]) & (cells[line] == spans["line"]) & cells[position].between(spans["first"], spans["last"])
    return cells.join(spans, held).select(*(cells[c] for c in cells.columns), spans["field"])


def shift_clusters(matches: DataFrame, dx: Column, dy: Column, tolerance: int = 16, at_least: int = 8) -> DataFrame:
    """Matches by shift in bins (halves to even): number and mean shift of bins with enough of them."""
    binned = matches.select(F.bround(dx / tolerance).cast("int").alias("bin_x"), F.bround(dy / tolerance).cast("int").alias("bin_y"), dx.cast("decimal(18,6)").alias("__x"), dy.cast("decimal(18,6)").alias("__y"))
    out = binned.groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"), F.sum("__x").cast("double").alias("__sx"), F.sum("__y").cast("double").alias("__sy"))
    return out.filter(F.col("n") >= at_least).select("bin_x", "bin_y", "n", (F.col("__sx") / F.col("n")).alias("mean_dx"), (F.col("__sy") / F.col("n")).alias("mean_dy"))


def vote_map(points: DataFrame, x: Column, y: Column, block: int = 8) -> DataFrame:
    """Votes by block: a quarter for each point, at most 1."""
    cells = points.select(F.floor(x / block).alias("bx"), F.floor(y / block).alias("by"))
    return cells.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")).withColumn("vote", F.least(F.col("n") / 4, F.lit(1.0)))


def order_corners(points: DataFrame, key: str) -> DataFrame:
    """Top left, top right, bottom right and bottom left of points, by extremes of sum and difference."""
    point, plus, minus = F.struct("x", "y"), F.col("x") + F.col("y"), F.col("y") - F.col("x")
    return points.groupBy(key).agg(
        F.min_by(point, F.struct(plus, "x", "y")).alias("top_left"), F.min_by(point, F.struct(minus, "x", "y")).alias("top_right"),
        F.max_by(point, F.struct(plus, "x", "y")).alias("bottom_right"), F.max_by(point, F.struct(minus, "x", "y")).alias("bottom_left"),
    )


def reading_rows(words: DataFrame, key: str) -> DataFrame:
    """Words dealt to rows: each joins the first row whose extent it overlaps, else starts one.

    A word widens its row, so the result depends on order and isn't islands.
    Pages are dealt whole to tasks and read in order; a task keeps the rows of
    one page at a time.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, spans = None, []
        for batch in batches:
            found = []
            for p, top, bottom in zip(batch[key], batch["top"], batch["bottom"], strict=True):
                if p != page:
                    page, spans = p, []
                row = next((i for i, s in enumerate(spans) if top < s[1] and s[0] < bottom), len(spans))
                if row == len(spans):
                    spans.append([top, bottom])
                else:
                    spans[row] = [min(spans[row][0], top), max(spans[row][1], bottom)]
                found.append(row)
            yield batch[[key, "pos"]].assign(row=pd.Series(found, index=batch.index, dtype="int64"))

    ordered = words.select(key, "pos", "top", "bottom").repartition(key).sortWithinPartitions(key, "pos", "top", "bottom")
    return ordered.mapInPandas(of, f"{key} long, pos long, row long")


def infer_format(lines: DataFrame, key: str) -> DataFrame:
    """Format of each zone by its number of lines and their median number of glyphs, within two of the format's width."""
    from inkspark.functions.mrz import SHAPES

    counts = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.median("n").alias("glyphs"))
    found = F.lit(None).cast("string")
    for name, (n, width) in SHAPES.items():
        found = F.when((F.col("n_lines") == n) & F.col("glyphs").between(width - 2, width + 2), F.lit(name)).otherwise(found)
    return counts.withColumn("format", found)


def layout_deviations(blobs: DataFrame, template: DataFrame, key: str, reach: float = 64.0, tolerance: float = 12.0) -> DataFrame:
    """How far each field's ink is from where the template puts it.

    blobs: key, cx, cy, area; template: field, x, y, width, height. Ink goes to the nearest field centre within reach.

    The page is a grid of cells as wide as the reach, so a centre within reach of
    a blob is in its cell or one of the eight around it. Centres stand in all nine,
    and cells are joined by equality, whatever the template's size is.
    """
    centres = template.select("field", (F.col("x") + F.col("width") / 2).alias("__fx"), (F.col("y") + F.col("height") / 2).alias("__fy"))
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.array(*(cell(c) + i for i in (-1, 0, 1))))
    centres = small(centres.withColumn("__gx", around("__fx")).withColumn("__gy", around("__fy")))
    far = F.hypot(F.col("cx") - F.col("__fx"), F.col("cy") - F.col("__fy"))
    celled = blobs.withColumns({"__gx": cell("cx"), "__gy": cell("cy")})
    near = celled.join(centres, ["__gx", "__gy"]).withColumn("__far", far).filter(F.col("__far") <= reach)
    own = near.groupBy(key, "cx", "cy", "area").agg(F.min_by(F.struct("field", "__fx", "__fy"), F.struct("__far", "field")).alias("f"))
    mean = lambda c: F.sum(F.col(c) * F.col("area")) / F.sum("area")
    fields = own.groupBy(key, "f.field", "f.__fx", "f.__fy").agg(mean("cx").alias("__x"), mean("cy").alias("__y"))
    deviation = F.hypot(F.col("__x") - F.col("__fx"), F.col("__y") - F.col("__fy"))
    return fields.select(key, "field", deviation.alias("deviation"), F.least(F.lit(1.0), deviation / (2 * tolerance)).alias("value"), (deviation > tolerance).alias("flagged"))


def layout_score(deviations: DataFrame, key: str, tolerance: float = 12.0) -> DataFrame:
    """Mean of 1 less each field's deviation over twice the tolerance, from 0; null if nothing was measured."""
    return deviations.groupBy(key).agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col("deviation") / (2 * tolerance))).alias("score"))


def sound_lines(rows: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Lines of a page (key, line, top, height of each glyph) that can be a zone's: heights within a third of their median, and lines apart by no more than a quarter over the tightest.

    A page has few lines, so the windows run over one row a line.
    """
    lines = rows.groupBy(key, line).agg(F.min("top").alias("__top"), (F.max("height") - F.min("height")).alias("__spread"), F.median("height").alias("__median"))
    order = Window.partitionBy(key).orderBy("__top", line)
    gap = F.least(F.col("__top") - F.lag("__top").over(order), F.lead("__top").over(order) - F.col("__top"))
    spaced = lines.withColumn("__gap", gap)
    tightest = F.min("__gap").over(Window.partitionBy(key))
    even = F.col("__gap").isNull() | (F.col("__gap") - tightest <= 0.25 * tightest)
    return spaced.withColumn("__even", even).filter((F.col("__median") > 0) & (F.col("__spread") <= F.col("__median") / 3) & F.col("__even")).select(key, line)


def turned(rows: DataFrame, angle: Column, cx: Column, cy: Column) -> DataFrame:
    """Boxes (left, top, width, height) turned around a point by degrees: the bounds of their turned corners, halves to even."""
    t = F.radians(angle)
    x = lambda a, b: cx + (a - cx) * F.cos(t) - (b - cy) * F.sin(t)
    y = lambda a, b: cy + (a - cx) * F.sin(t) + (b - cy) * F.cos(t)
    left, top = F.col("left"), F.col("top")
    corners = [(a, b) for a in (left, left + F.col("width")) for b in (top, top + F.col("height"))]
    whole = lambda c: F.bround(c).cast("int")
    xs, ys = [x(*c) for c in corners], [y(*c) for c in corners]
    low_x, low_y = whole(F.least(*xs)), whole(F.least(*ys))
    out = rows.withColumns({"__x": low_x, "__y": low_y, "__w": whole(F.greatest(*xs)) - low_x, "__h": whole(F.greatest(*ys)) - low_y})
    return out.drop("left", "top", "width", "height").withColumnsRenamed({"__x": "left", "__y": "top", "__w": "width", "__h": "height"})


def font_style(glyph_boxes: DataFrame, key: str) -> DataFrame:
    """Share of ink in the glyphs' boxes, and mean and population deviation of their heights."""
    ink = F.sum("area").cast("double") / F.sum(F.col("width") * F.col("height"))
    return glyph_boxes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), ink.alias("density"), F.avg("height").alias("mean_height"), F.stddev_pop("height").alias("height_spread"))


def tolerances(template: DataFrame, given: DataFrame) -> DataFrame:
    """A template's fields with their tolerance. A field without one, and a tolerance of no field, are errors."""
    rows = template.select("field").distinct().join(given.select("field", "tolerance"), "field", "full_outer").join(template.select("field").distinct().withColumn("__known", F.lit(True)), "field", "left")
    sound = F.col("__known").isNotNull() & F.col("tolerance").isNotNull() & (F.col("tolerance") > 0)
    return rows.select("field", F.when(sound, F.col("tolerance")).otherwise(F.raise_error(F.concat(F.lit("no sound tolerance for "), F.col("field"))).cast("double")).alias("tolerance"))
