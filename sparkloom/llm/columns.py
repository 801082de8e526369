"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row.

    Inside a lambda an outer expression is evaluated anew for each element; bound as a
    lambda variable it is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Copies of a row that one task makes.
COPIES = 4096


def each_copy(df: DataFrame, copies: str, name: str = "copy") -> DataFrame:
    """Each row as often as its column ``copies`` says, numbered from 0; rows of many copies are dealt out over the tasks."""
    start, last = F.col("_slice") * COPIES, F.least(F.col(copies), (F.col("_slice") + 1) * COPIES) - 1
    few = df.where(F.col(copies) <= COPIES).withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1)))
    many = df.where(F.col(copies) > COPIES).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / COPIES))))
    many = many.repartition(F.col("_slice"), F.col(copies)).withColumn(name, F.explode(F.sequence(start, last))).drop("_slice")
    return few.unionByName(many).drop(copies)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
