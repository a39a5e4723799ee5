"""The form's layout as small tables, and what follows from it.  All of them have fewer than twenty rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright import constants as C

_BOX = ("x1", "y1", "x2", "y2")


def fields(spark: SparkSession) -> DataFrame:
    rows = [(n, i, kind, region, label, *anchor, *value) for i, (n, (anchor, value, kind, region, label)) in enumerate(C.FIELDS.items())]
    return spark.createDataFrame(rows, "field string, ord int, type string, region string, label string, " + ", ".join(f"a{c} double" for c in _BOX) + ", " + ", ".join(f"{c} double" for c in _BOX))


def options(spark: SparkSession) -> DataFrame:
    rows = [(g, n, i, label, *box) for i, (n, (g, label, box)) in enumerate(C.OPTIONS.items())]
    return spark.createDataFrame(rows, "grp string, option string, ord int, label string, " + ", ".join(f"{c} double" for c in _BOX))


def signatures(spark: SparkSession) -> DataFrame:
    rows = [(n, *anchor, *value) for n, (anchor, value) in C.SIGNATURES.items()]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"a{c} double" for c in _BOX) + ", " + ", ".join(f"{c} double" for c in _BOX))


def checks(spark: SparkSession) -> DataFrame:
    """mode, check, ord: the checks that decide in each region mode."""
    rows = [(mode, name, C.CHECK_ORDER.index(name)) for mode, names in C.DECISIVE.items() for name in names]
    return spark.createDataFrame(rows, "mode string, check string, ord int")


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length of the common part of two intervals; zero or less if there is none."""
    return F.least(a2, b2) - F.greatest(a1, b1)


def neighbour_limits(spark: SparkSession) -> DataFrame:
    """field, next_top, prev_bottom: the nearest box below (of any kind) and above (fields only) that lies over or under it."""
    own = fields(spark).select("field", *_BOX)
    boxes = own.select(F.col("field").alias("name"), *_BOX).unionByName(options(spark).select(F.col("option").alias("name"), *_BOX)).unionByName(signatures(spark).select("name", *_BOX))
    boxes = boxes.select("name", *[F.col(c).alias(f"o{c}") for c in _BOX])
    aside = overlap(F.col("x1"), F.col("x2"), F.col("ox1"), F.col("ox2")) > 0
    below = own.join(F.broadcast(boxes), aside & (F.col("name") != F.col("field")) & (F.col("oy1") >= F.col("y2")), "left").groupBy("field").agg(F.coalesce(F.min("oy1"), F.lit(1.0)).alias("next_top"))
    above = boxes.join(own.select(F.col("field").alias("name")), "name", "left_semi")
    above = own.join(F.broadcast(above), aside & (F.col("name") != F.col("field")) & (F.col("oy2") <= F.col("y1")), "left").groupBy("field").agg(F.coalesce(F.max("oy2"), F.lit(0.0)).alias("prev_bottom"))
    return below.join(above, "field")


def region_envelopes(boxes: DataFrame, by: list[str], pad: float = 0.01) -> DataFrame:
    """The padded envelope of each group's boxes (x1, y1, x2, y2 as page fractions)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return boxes.groupBy(*by).agg(
        F.greatest(zero, F.min("x1") - pad).alias("x1"), F.greatest(zero, F.min("y1") - pad).alias("y1"), F.least(one, F.max("x2") + pad).alias("x2"), F.least(one, F.max("y2") + pad).alias("y2")
    )


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Rounded (half to even) and cut to the image, one pixel wide and high at least."""
    cut = lambda v, low, high: F.greatest(low, F.least(high, F.bround(v, 0).cast("int")))
    left, top = cut(x1, F.lit(0), width - 1), cut(y1, F.lit(0), height - 1)
    return F.struct(left.alias("x1"), top.alias("y1"), cut(x2, left + 1, width).alias("x2"), cut(y2, top + 1, height).alias("y2"))


def clamp_to_neighbours(box: Column, next_top: Column, prev_bottom: Column, height: Column) -> Column:
    """The box held between its neighbours' edges, or as it was if that turns it over."""
    top = F.greatest(box["y1"], F.bround(prev_bottom * height, 0).cast("int"))
    bottom = F.least(box["y2"], F.bround(next_top * height, 0).cast("int"))
    held = F.struct(box["x1"].alias("x1"), top.alias("y1"), box["x2"].alias("x2"), bottom.alias("y2"))
    return F.when(bottom > top, held).otherwise(box)


def decompose(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Rotation, scales and shear of the linear part [[a, b], [c, d]], in degrees."""
    sx, sy = F.hypot(a, c), F.hypot(b, d)
    return F.struct(F.degrees(F.atan2(c, a)).alias("rotation"), sx.alias("scale_x"), sy.alias("scale_y"), F.degrees(F.atan2(a * b + c * d, sx * sx)).alias("shear"))


def transform_box(box: Column, m: Column) -> Column:
    """Envelope of a box's corners under the affine map m(a, b, tx, c, d, ty)."""
    corners = [(box[x], box[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs = [m["a"] * x + m["b"] * y + m["tx"] for x, y in corners]
    ys = [m["c"] * x + m["d"] * y + m["ty"] for x, y in corners]
    return F.struct(F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"))
