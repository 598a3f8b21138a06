"""Joined result tables and their presentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import abbreviated, latex_escaped


def latest(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key; equal ones by all columns, so that the choice is the same each time."""
    order = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in newest), *sorted(c for c in rows.columns if c not in (key, *newest)))
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def left_joined(base: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """``base`` with each other table on its key; columns that clash get a number as suffix."""

    def add(left: DataFrame, item: tuple[int, DataFrame]) -> DataFrame:
        number, right = item
        clash = {c: f"{c}_{number}" for c in right.columns if c != on and c in left.columns}
        return left.join(right.withColumnsRenamed(clash), on, "left")

    return reduce(add, enumerate(others, 2), base)


def inner_chain(*frames: DataFrame, on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), frames)


def first_filled(*columns: str) -> Column:
    """The first column that holds more than blanks."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def without_prefix(frame: DataFrame, *prefixes: str) -> DataFrame:
    return frame.drop(*(c for c in frame.columns if c.startswith(prefixes)))


def looked_up(override: DataFrame, base: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` of each key: from the override table where it has one, else from the base."""
    over = override.select(key, F.col(value).alias("over"))
    return names.join(over, key, "left").join(base.select(key, F.col(value).alias("base")), key, "left").withColumn(value, F.coalesce("over", "base")).drop("over", "base")


def latex_rows(frame: DataFrame, text: tuple[str, ...], counts: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """One line of a LaTeX table per row: texts escaped, counts abbreviated, numbers with three places."""
    cells = [F.coalesce(latex_escaped(F.col(c)), F.lit("--")) for c in text]
    cells += [F.coalesce(abbreviated(F.col(c)), F.lit("--")) for c in counts]
    cells += [F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("--")) for c in numbers]
    return frame.select(text[0], F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))
