"""Tokens to crops and fields: interval and window joins, reading order, canvases, bands, medians, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright import constants as C
from sheetwright.functions import text as X


def canvas_layout(crops: DataFrame, by: list[str], order: list[str], height: str = "h", gap: int = C.BATCH_GAP) -> DataFrame:
    """Top and bottom of each crop on its group's canvas, stacked with gaps."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.sum(F.col(height) + gap).over(before), F.lit(0))
    return crops.withColumn("y0", top).withColumn("y1", F.col("y0") + F.col(height))


def canvas_chunks(crops: DataFrame, by: str, order: list[str], budget: int, height: str = "h", gap: int = C.BATCH_GAP) -> DataFrame:
    """``chunk`` (from 1): next-fit packing of each group's crops, in order, by height with gaps; a tall crop has a chunk to itself.

    Where a chunk ends depends on where it began, so a group is read in order
    as a stream; none is held in memory.
    """
    kind = crops.schema

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, chunk, used = None, 0, 0
        for rows in batches:
            out = []
            for key, h in zip(rows[by], rows[height], strict=True):
                need = h + gap
                if key != group:
                    group, chunk, used = key, 1, need
                elif used + need > budget:
                    chunk, used = chunk + 1, need
                else:
                    used += need
                out.append(chunk)
            yield rows.assign(chunk=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", chunk int"
    return crops.repartition(by).sortWithinPartitions(by, *order).mapInPandas(pack, schema)


def tokens_to_crops(tokens: DataFrame, layout: DataFrame, by: list[str], slack: int = 2) -> DataFrame:
    """Each token with the first crop, in layout order, whose band holds its centre; boxes are then the crop's own.

    The join is by group, so only crops of the token's own canvas are tried.
    """
    centre = (F.col("ty1") + F.col("ty2")) / 2
    joined = tokens.join(layout, by).where(centre.between(F.col("y0") - slack, F.col("y1") + slack))
    first = Window.partitionBy(*by, "token").orderBy("ord")
    return joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumns({"ty1": F.col("ty1") - F.col("y0"), "ty2": F.col("ty2") - F.col("y0")})


def reading_text(tokens: DataFrame, by: list[str], order: list[str], confidence: str = "mean") -> DataFrame:
    """The group's text in reading order, and the mean or least confidence; null texts are left out."""
    listed = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.struct(*order, "text"))))
    text = F.trim(F.array_join(F.transform(listed, lambda t: t["text"]), " "))
    sure = F.avg("confidence") if confidence == "mean" else F.min("confidence")
    return tokens.groupBy(*by).agg(text.alias("text"), sure.alias("confidence"), F.count("*").alias("n_tokens"))


def line_of(y: Column, top: Column, height: Column, lines: int = 40) -> Column:
    """The line of a token: its top within the region, in fortieths, half to even."""
    return F.bround((y - top) / F.greatest(height, F.lit(1)) * lines, 0).cast("int")


def tokens_to_fields(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """Field texts from region tokens.

    tokens: doc_id, region, text, confidence, x1, y1, x2, y2; windows: region,
    field, label, pattern-free label text, wx1..wy2 and the region's ry1, ry2.
    A token that looks like the field's label gives what follows the label,
    wherever it stands; any other counts if its centre is in the window.
    """
    joined = tokens.join(F.broadcast(windows), "region")  # fewer than twenty rows
    label = X.fuzzy_contains(F.col("text"), F.col("label"))
    remainder = F.coalesce(*[F.when(F.col("label") == name, X.label_remainder(F.col("text"), name)) for name in sorted({v[4] for v in C.FIELDS.values() if v[4]})])
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = cx.between(F.col("wx1"), F.col("wx2")) & cy.between(F.col("wy1"), F.col("wy2"))
    picked = joined.withColumn("text", F.when(label, remainder).when(inside, F.col("text"))).where("text is not null")
    picked = picked.withColumn("line", line_of(F.col("y1"), F.col("ry1"), F.col("ry2") - F.col("ry1")))
    return reading_text(picked, ["doc_id", "field"], ["line", "x1"], "min").where("text <> ''")


def ink_bands(rows: DataFrame, by: list[str], at: str, gap: int = C.BAND_GAP) -> DataFrame:
    """Bands of positions no more than ``gap`` apart: start and end (exclusive)."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    marked = rows.select(*by, at).distinct().withColumn("_new", new).withColumn("_band", F.sum("_new").over(w))
    return marked.groupBy(*by, "_band").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"), F.count("*").alias("n")).drop("_band")


def robust_offsets(points: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Median offset of each group, the points within ``limit`` of it, and their mean."""
    middle = points.groupBy(*by).agg(F.percentile("dx", F.lit(0.5)).alias("mx"), F.percentile("dy", F.lit(0.5)).alias("my"), F.count("*").alias("n"))
    near = F.hypot(F.col("dx") - F.col("mx"), F.col("dy") - F.col("my")) <= limit
    return points.join(middle, by).groupBy(*by, "mx", "my", "n").agg(F.count_if(near).alias("n_near"), F.avg(F.when(near, F.col("dx"))).alias("dx"), F.avg(F.when(near, F.col("dy"))).alias("dy"))


def best_candidate(candidates: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The value of each group's greatest candidate by ``order``."""
    return candidates.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))


def ratio_matches(left: DataFrame, right: DataFrame, ratio: float, block: int = 512) -> DataFrame:
    """Left rows whose nearest right row is nearer than ``ratio`` times the next: l_id, r_id, d1, d2, n.

    left: key, l_id, l_e; right: key, r_id, r_e; unit vectors, compared within
    a key by cosine distance, a row never with its own id.  Keys are dealt in
    pairs of blocks of about ``block`` rows, so no task gets a key's pairs, and
    a block pair gives the two nearest of each left row alone.
    """
    counts = lambda side, name: side.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = counts(left, "_i").join(counts(right, "_j"), "key")
    own = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l_rows = left.join(sizes, "key").select("key", own("l_id", "_i").alias("i"), every("_j").alias("j"), F.lit(0).alias("side"), F.col("l_id").alias("id"), F.col("l_e").alias("e"))
    r_rows = right.join(sizes, "key").select("key", every("_i").alias("i"), own("r_id", "_j").alias("j"), F.lit(1).alias("side"), F.col("r_id").alias("id"), F.col("r_e").alias("e"))

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.side == 0], rows[rows.side == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"l_id": [], "r_id": [], "distance": []})
        ids, others = a.id.to_numpy(), b.id.to_numpy()
        distance = np.round(1 - np.stack(a.e.to_numpy()) @ np.stack(b.e.to_numpy()).T, 6)
        distance[ids[:, None] == others[None, :]] = np.inf
        first = np.argsort(distance, axis=1, kind="stable")[:, :2]  # the lesser id of equal distances
        found = np.take_along_axis(distance, first, 1)
        kept = np.isfinite(found)
        return pd.DataFrame({"l_id": np.repeat(ids, first.shape[1])[kept.reshape(-1)], "r_id": others[first][kept], "distance": found[kept]})

    pairs = l_rows.unionByName(r_rows).groupBy("key", "i", "j").applyInPandas(nearest, "l_id long, r_id long, distance double")
    listed = pairs.groupBy("l_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "r_id"))), 1, 2).alias("_two"))
    two = listed.select("l_id", F.col("_two")[0]["r_id"].alias("r_id"), F.col("_two")[0]["distance"].alias("d1"), F.element_at("_two", -1)["distance"].alias("d2"), F.size("_two").cast("long").alias("n"))
    return two.where((F.col("n") == 2) & (F.col("d1") < ratio * F.col("d2")))
