"""Recognisers as a protocol, and the Arrow functions that call them once per document or chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwright import constants as C
from sheetwright.vision import kernels

TOKEN = "array<struct<text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>"


class Backend(Protocol):
    """Reads an image; made once in each worker."""

    def tokens(self, image: np.ndarray) -> list[dict]: ...


class Recorded:
    """A backend that returns what it was given, by image content; for tests and replays."""

    def __init__(self, known: dict[bytes, list[dict]]):
        self.known = known

    def tokens(self, image: np.ndarray) -> list[dict]:
        return self.known.get(image.tobytes(), [])


def payload_tokens(texts: list[str], scores: list[float], polygons: list[list[list[float]]]) -> list[dict]:
    """Tokens of a model's answer: boxes around the polygons, rounded outwards; empty texts dropped."""
    out = []
    for text, score, polygon in zip(texts, scores, polygons, strict=True):
        if text:
            p = np.array(polygon, np.float64)
            out.append({"text": text, "confidence": score, "x1": int(np.floor(p[:, 0].min())), "y1": int(np.floor(p[:, 1].min())), "x2": int(np.ceil(p[:, 0].max())), "y2": int(np.ceil(p[:, 1].max()))})
    return out


def recognise(make: Callable[[], Backend]):
    """A function of encoded images to struct(tokens, error); a page that can't be read stops no other.

    It is marked as not deterministic, so that it is not run again for a column
    that is used twice.
    """
    schema = T.StructType([T.StructField("tokens", T._parse_datatype_string(TOKEN)), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        backend = make()
        for contents in batches:
            rows = []
            for data in contents:
                try:
                    rows.append((backend.tokens(kernels.grey(kernels.decode_png(bytes(data)))), None))
                except Exception as e:  # any failure of a page is a value of its row
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["tokens", "error"])

    return run.asNondeterministic()


def _png_pair(template: bytes, filled: bytes) -> tuple[np.ndarray, np.ndarray]:
    return kernels.grey(kernels.decode_png(bytes(template))), kernels.grey(kernels.decode_png(bytes(filled)))


@F.pandas_udf(T.DoubleType())
def ink_change(template: pd.Series, filled: pd.Series) -> pd.Series:
    """Share of pixels that differ between two crops of one size; null if either can't be read."""

    def one(a, b) -> float | None:
        try:
            return kernels.ink_ratio(*_png_pair(a, b))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(a, b) for a, b in zip(template, filled, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("components", T.IntegerType()), T.StructField("area_ratio", T.DoubleType()), T.StructField("spread_x", T.DoubleType()), T.StructField("spread_y", T.DoubleType())]))
def signature_ink(template: pd.Series, filled: pd.Series) -> pd.DataFrame:
    """Ink statistics of a signature box against the template, printed lines removed; nulls if either can't be read."""

    def one(a, b) -> tuple:
        try:
            return kernels.ink_stats(kernels.without_lines(kernels.difference_mask(*_png_pair(a, b))))
        except (ValueError, TypeError):
            return (None,) * 4

    rows = [one(a, b) for a, b in zip(template, filled, strict=True)]
    return pd.DataFrame(rows, columns=["components", "area_ratio", "spread_x", "spread_y"])


def option_marks(crops: DataFrame, covered: Column) -> DataFrame:
    """Scores of option crops (template, filled); options out of the frame are not looked at."""
    out = crops.withColumn("out_of_frame", covered < C.COVERAGE_MIN)
    seen = out.where("not out_of_frame").withColumn("score", ink_change("template", "filled"))
    return seen.unionByName(out.where("out_of_frame").withColumn("score", F.lit(None).cast("double")))
