"""Functions that have no built-in form: name similarity and JSON repair, on Arrow batches."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(a: str | None, b: str | None) -> float:
    """Matching-block ratio of two normal forms, in percent with one decimal.  Not symmetric."""
    return round(100 * SequenceMatcher(None, a, b).ratio(), 1) if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def repair_object(text: str | None) -> str | None:
    """A truncated JSON object made whole: closed as it is, else without its last members (four at most), else with its last quote closed."""
    if not text or "{" not in text:
        return None

    def parsed(candidate: str) -> str | None:
        try:
            value = json.loads(candidate)
        except ValueError:
            return None
        return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None

    rest = re.sub(r",\s*$", "", text[text.index("{") :].rstrip())
    for _ in range(4):
        if (found := parsed(rest + "}")) is not None:
            return found
        if "," not in rest:
            break
        rest = rest[: rest.rindex(",")]
    return parsed(rest + '"}') if rest.count('"') % 2 else None


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repair_object)
