"""Running values along an integer order within a key, where one key may hold most of the rows.

Rows are dealt out by key and range of the order (RANGE places); each range is summed up, the sums
of a key's ranges, one row for each, are scanned in order, and what stands before or after a range
is joined to its rows. No task has more of a key than a range, or its sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorlake.functions.text import unused

RANGE = 256


def range_of(order: str, size: int = RANGE) -> Column:
    return F.floor(F.col(order) / size)


def scan(df: DataFrame, keys: list[str], order: str, last: dict[str, Column] | None = None, following: dict[str, Column] | None = None, number: str | None = None, size: int = RANGE) -> DataFrame:
    """``df`` with, within ``keys`` and by ``order``: under ``last`` the last value that is not null up
    to a row, under ``following`` the value of the next row, as ``number`` the place of a row from 1.
    Null keys are a key like others; rows of equal order come in any order."""
    last, following = last or {}, following or {}
    names = [*(f"last of {n}" for n in last), *(f"next of {n}" for n in following)]
    values = {unused(df, k): v for k, v in zip(names, [*last.values(), *following.values()])}
    at, n = unused(df, "range of order"), unused(df, "rows of range")
    rows = df.select("*", *(v.alias(k) for k, v in values.items()), range_of(order, size).alias(at))
    held = list(values)
    lasts, nexts = held[: len(last)], held[len(last) :]

    sums = [F.max(F.when(F.col(k).isNotNull(), F.struct(order, k)))[k].alias(k) for k in lasts] + [F.min(F.struct(order, k))[k].alias(k) for k in nexts]
    ranges = rows.groupBy(*keys, at).agg(F.count("*").alias(n), *sums)
    by_range = Window.partitionBy(*keys).orderBy(at)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(k, ignorenulls=True).over(before).alias(f"{k} outside") for k in lasts] + [F.lead(k).over(by_range).alias(f"{k} outside") for k in nexts]
    own = [F.col(k).alias(f"{k} of range") for k in [*keys, at]]
    ranges = ranges.select(*own, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n), *carried)

    inside = Window.partitionBy(*keys, at).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    place = [F.row_number().over(inside).alias(f"{n} before")] if number else []
    found = [F.last(k, ignorenulls=True).over(upto).alias(f"{k} inside") for k in lasts]
    found += [F.lead(F.struct(F.col(k).alias("v"))).over(inside).alias(f"{k} inside") for k in nexts]
    rows = rows.select("*", *place, *found)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k} of range")) for k in [*keys, at]))
    rows = rows.join(ranges, same)
    out = [F.coalesce(f"{k} inside", f"{k} outside").alias(name) for k, name in zip(lasts, last)]
    out += [F.when(F.col(f"{k} inside").isNull(), F.col(f"{k} outside")).otherwise(F.col(f"{k} inside")["v"]).alias(name) for k, name in zip(nexts, following)]
    if number:
        out.append((F.col(n) + F.col(f"{n} before")).cast("long").alias(number))
    new = {*last, *following, number}
    return rows.select(*(c for c in df.columns if c not in new), *out)
