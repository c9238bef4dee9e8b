"""Plain sets as one-column tables of distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(a: DataFrame, *items) -> DataFrame:
    (name,) = a.columns
    new = a.sparkSession.createDataFrame([(x,) for x in items], a.schema)
    return a.unionByName(new).distinct()


def remove(a: DataFrame, *items) -> DataFrame:
    return a.where(~F.col(a.columns[0]).isin(*items)) if items else a


def has(a: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked``, one column of the same name, with ``has``: is it in the set?"""
    (name,) = a.columns
    return asked.join(a.select(name, F.lit(True).alias("has")), name, "left").select(name, F.coalesce("has", F.lit(False)).alias("has"))


def update(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with all of ``b``."""
    return union(a, b)


def elements(a: DataFrame) -> DataFrame:
    """In ascending order."""
    return a.orderBy(*a.columns)


def text(x: Column) -> Column:
    """An array of a set's elements as text, in order: ``{1, 2}``."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(x), lambda e: e.cast("string")), ", "), F.lit("}"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
