"""Label search and label classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(label: Column, key: str, mode: str) -> Column:
    """whole: the key as it is; all, any: its words."""
    if mode == "whole":
        return F.contains(label, F.lit(key))
    words = [F.contains(label, F.lit(w)) for w in key.split() if w] or [F.lit(False)]
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), words)


def search(labels: DataFrame, key: str, mode: str = "whole") -> DataFrame:
    return labels.filter(matches(F.col("label"), key, mode))


#: Substrings that mark a class of labels, in the order they are tried.
CLASSES = ["TMI", "ATU", "ETK"]


def label_class(label: Column) -> Column:
    """A marked class; otherwise place for one word, person for more."""
    out = F
    for c in CLASSES:
        out = out.when(F.contains(label, F.lit(c)), c)
    return out.when(F.size(F.split(label, " ")) <= 1, "place").otherwise("person")


def count_classes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(label_class(F.col("label")).alias("label_class")).agg(F.count("*").alias("n"))


def rules(df: DataFrame, cases: list[tuple[str, object]], prop: str) -> DataFrame:
    """A property overridden by the first rule (predicate, value) that holds."""
    out = F
    for predicate, value in cases:
        out = out.when(F.expr(predicate), F.lit(value))
    return df.withColumn(prop, out.otherwise(F.col(prop)) if cases else F.col(prop))
