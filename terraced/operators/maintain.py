"""Grouped aggregates that follow their source: refreshed from changed rows, not rebuilt.

Counts and sums are merged. A smallest or largest value is merged too, unless the
row that held it went: only such groups are read from the source again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced.session import pin


@dataclass(frozen=True)
class Measures:
    """What is kept per group, each as name -> column of the source; ``rows`` names the row count.

    Sums must be exact to be merged: integers or decimals, not floats.
    """

    rows: str = "row_count"
    sums: Mapping[str, str] = field(default_factory=dict)
    lows: Mapping[str, str] = field(default_factory=dict)
    highs: Mapping[str, str] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [self.rows, *self.sums, *self.lows, *self.highs]


def _held(name: str) -> str:
    """How many values of a sum are not null; a sum of none is null."""
    return f"{name}__held"


def summary_state(source: DataFrame, groups: Sequence[str], measures: Measures) -> DataFrame:
    """The aggregate with what a refresh needs besides it. Null is a group of its own."""
    kept = [F.count("*").alias(measures.rows)]
    for name, column in measures.sums.items():
        kept += [F.sum(column).alias(name), F.count(column).alias(_held(name))]
    kept += [F.min(column).alias(name) for name, column in measures.lows.items()]
    kept += [F.max(column).alias(name) for name, column in measures.highs.items()]
    return source.groupBy(*groups).agg(*kept)


def summary(state: DataFrame, groups: Sequence[str], measures: Measures) -> DataFrame:
    """The aggregate alone."""
    return state.select(*groups, *measures.names())


def row_changes(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that went and rows that came between two versions of a table with a unique ``key``.

    A changed row went in its old form and came in its new one. One join by key, which both sides need once.
    """
    columns = before.columns
    old = before.select(F.col(key).alias("_old"), F.struct(*columns).alias("_before"))
    new = after.select(F.col(key).alias("_new"), F.struct(*columns).alias("_after"))
    changed = old.join(new, F.col("_old") == F.col("_new"), "full_outer").filter(~F.col("_before").eqNullSafe(F.col("_after")))
    stored = pin(changed.select("_before", "_after"), "changes")
    return (
        stored.filter("_before IS NOT NULL").select("_before.*"),
        stored.filter("_after IS NOT NULL").select("_after.*"),
    )


def refresh(
    state: DataFrame, went: DataFrame, came: DataFrame, source: DataFrame, groups: Sequence[str], measures: Measures
) -> DataFrame:
    """``state`` after rows went and came; ``source`` holds the rows as they are now.

    The changes are aggregated first, so one row per changed group meets the state. Groups
    without rows leave. The source is read only if a smallest or largest value went,
    and then only the rows of such groups are aggregated.
    """
    lost, gained = summary_state(went, groups, measures), summary_state(came, groups, measures)
    sides = (("_s", state, 1), ("_g", gained, 1), ("_l", lost, -1))
    added = [measures.rows, *measures.sums, *map(_held, measures.sums)]
    extremes = [*measures.lows, *measures.highs]

    def side(mark: str, df: DataFrame, sign: int) -> DataFrame:
        merged = [(F.col(name) * sign).cast(df.schema[name].dataType).alias(name) for name in added]
        apart = [F.lit(mark == other).alias(f"is{other}") for other, _, _ in sides]
        return df.select(*groups, *merged, *extremes, *apart)

    rows = None
    for mark, df, sign in sides:
        rows = side(mark, df, sign) if rows is None else rows.unionByName(side(mark, df, sign))

    def of(name: str, mark: str) -> Column:
        least = F.min if name in measures.lows else F.max
        return least(F.when(F.col(f"is{mark}"), F.col(name))).alias(f"{name}{mark}")

    wanted = [F.sum(name).cast(state.schema[name].dataType).alias(name) for name in added]
    wanted += [of(name, mark) for name in extremes for mark, _, _ in sides]
    merged = rows.groupBy(*groups).agg(*wanted).filter(F.col(measures.rows) > 0)
    stale = F.lit(False)
    kept = []
    for name in extremes:
        held, came_in, went_out = (F.col(f"{name}{mark}") for mark in ("_s", "_g", "_l"))
        low = name in measures.lows
        reaches = went_out <= held if low else went_out >= held
        covered = came_in <= held if low else came_in >= held
        stale = stale | (F.coalesce(reaches, F.lit(False)) & ~F.coalesce(covered, F.lit(False)))
        best = F.least(held, came_in) if low else F.greatest(held, came_in)
        kept.append(best.alias(name))
    for name in measures.sums:
        wanted_sum = F.when(F.col(_held(name)) > 0, F.col(name)).alias(name)
        kept.append(wanted_sum)
    ready = merged.select(*groups, measures.rows, *kept, *map(_held, measures.sums), stale.alias("_stale"))
    ready = pin(ready.select(*state.columns, "_stale"), "merged")
    again = ready.filter("_stale").select(*[F.col(g).alias(f"_{g}") for g in groups])
    fine = ready.filter("NOT _stale").drop("_stale")
    if again.isEmpty():
        return fine
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    reread = summary_state(source.join(again, same, "left_semi"), groups, measures)
    return fine.unionByName(reread.select(*state.columns))
