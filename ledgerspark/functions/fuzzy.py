"""Label similarity. The Ratcliff-Obershelp ratio has no built-in form; it runs in an Arrow-batched UDF."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T, M being the characters in matching blocks; null texts count as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def metric_words(metric: Column | str) -> Column:
    """A metric's words of two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(metric)), r"[.,()]", " "), r"(?U)\s+"), lambda w: F.length(w) > 1)


def word_coverage(label: Column | str, metric: Column | str) -> Column:
    """The share of the metric's words that the label holds; null without words."""
    ws = metric_words(metric)
    return F.try_divide(F.size(F.filter(ws, lambda w: F.contains(F.lower(col(label)), w))).cast("double"), F.size(ws))


def register(spark: SparkSession) -> None:
    spark.udf.register("sequence_ratio", sequence_ratio)
