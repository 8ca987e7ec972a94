"""Data checks as frames: one row per check with its number of failures.

Every check is a partial aggregate, so a value shared by a third of the rows is
counted where it lies and only counts travel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraced.session import pin

if TYPE_CHECKING:
    from terraced.sources.catalog import Warehouse

RESULT = ["check_name", "table_name", "column_name", "failures"]


def _failed(count: Column, check: str, table: str, column: str) -> list[Column]:
    labels = [F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name")]
    return [*labels, count.cast("bigint").alias("failures")]


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counted(df: DataFrame, check: str, table: str, broken: Mapping[str, Column]) -> DataFrame:
    """One pass over ``df`` that counts rows breaking each named rule."""
    counts = df.agg(*[F.count_if(rule).alias(column) for column, rule in broken.items()])
    rows = [F.struct(*_failed(F.col(f"`{column}`"), check, table, column)) for column in broken]
    return counts.select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Rules:
    """Rules that a write can count while it writes: one pass, no second scan.

    The counts are taken in the stage that writes, where Spark adds up each
    partition once, whatever tasks are repeated.
    """

    present: Sequence[str] = ()
    ranges: Mapping[str, Column] = field(default_factory=dict)

    def counts(self) -> list[Column]:
        missing = [F.count_if(F.col(c).isNull()).alias(f"not_null {c}") for c in self.present]
        outside = [F.count_if(~rule).alias(f"range {c}") for c, rule in self.ranges.items()]
        return [F.count(F.lit(1)).alias("row_count"), *missing, *outside]

    def results(self, table: str, found: Mapping[str, int]) -> Iterator[tuple[str, str, str, int]]:
        for check, columns in (("not_null", self.present), ("range", self.ranges)):
            for column in columns:
                yield check, table, column, found[f"{check} {column}"]


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return _counted(df, "not_null", table, {c: F.col(c).isNull() for c in columns})


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their row count. NULL is not a value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("row_count"))
    return counted.filter("row_count > 1")


def unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Number of duplicated values per column."""
    return union(
        [duplicates(df, c).agg(F.count("*").alias("n")).select(*_failed(F.col("n"), "unique", table, c)) for c in columns]
    )


def present_and_distinct(tables: Sequence[tuple[str, DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Not-null and unique checks of many tables: one scan each, one shuffle for all.

    ``tables`` holds (label, frame, columns that must be present, columns that must be
    distinct). Every table sends a 64-bit hash per distinct column and row, counted
    where it lies first, and something for a null only; one aggregate counts nulls
    and repeated hashes. Equal values have equal hashes, so a column without repeated ones
    is distinct; columns with repeated hashes are counted again by value.
    """
    checks: list[tuple[int, str, str, str]] = []
    sent: list[DataFrame] = []
    frames: dict[int, tuple[DataFrame, str]] = {}
    for label, df, present, distinct in tables:
        entries = []
        for column in dict.fromkeys([*present, *distinct]):
            number = len(frames)
            frames[number] = (df, column)
            checks += [(number, "not_null", label, column)] * (column in present) + [(number, "unique", label, column)] * (column in distinct)
            value = F.col(f"`{column}`")
            hashed = F.when(value.isNotNull(), F.xxhash64(value)) if column in distinct else F.lit(None).cast("bigint")
            entry = F.struct(F.lit(number).alias("number"), hashed.alias("hash"))
            entries.append(entry if column in distinct else F.when(value.isNull(), entry))
        if entries:
            sent.append(df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*"))
    spark = tables[0][1].sparkSession
    met = union(sent).groupBy("number", "hash").agg(F.count("*").alias("n"))
    found = met.groupBy("number").agg(
        F.sum(F.when(F.col("hash").isNull(), F.col("n"))).alias("nulls"), F.count_if(F.col("hash").isNotNull() & (F.col("n") > 1)).alias("repeated")
    )
    counted = {r.number: r for r in found.collect()}  # one row per declared column
    rows = []
    for number, check, label, column in checks:
        failures = 0
        if number in counted:
            failures = (counted[number].nulls or 0) if check == "not_null" else counted[number].repeated
            if check == "unique" and failures:
                failures = duplicates(*frames[number]).count()
        rows.append((check, label, column, failures))
    return spark.createDataFrame(rows, "check_name string, table_name string, column_name string, failures bigint")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Keys of the child that the parent does not know, with the rows that use them.

    The child is counted per key first, so the anti join moves one row per key.
    """
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("row_count"))
    return used.join(parent.select(F.col(parent_column).alias("key")), "key", "left_anti")


def relationships(child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    broken = orphans(child, column, parent, parent_column).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"))
    return broken.select(*_failed(F.col("n"), "relationships", table, column))


def accepted_values(df: DataFrame, table: str, accepted: Mapping[str, Sequence[str]]) -> DataFrame:
    return _counted(df, "accepted_values", table, {c: ~F.col(c).isin(*values) for c, values in accepted.items()})


def in_range(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """``rules`` says per column what must hold; NULL breaks no rule."""
    return _counted(df, "range", table, {c: ~rule for c, rule in rules.items()})


def keys(df: DataFrame, table: str, primary: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Primary and unique columns: present and distinct. Required columns: present."""
    return union([not_null(df, table, [*primary, *required]), unique(df, table, primary)])


def row_counts(frames: Mapping[str, DataFrame], expected: Mapping[str, int] | DataFrame) -> DataFrame:
    """Expected against found rows per relation; a relation without a frame counts as missing."""
    spark = next(iter(frames.values())).sparkSession
    if not isinstance(expected, DataFrame):
        expected = spark.createDataFrame(list(expected.items()), "relation string, expected bigint")
    found = union(
        [df.agg(F.count("*").alias("found")).select(F.lit(name).alias("relation"), "found") for name, df in frames.items()]
    )
    return expected.join(found, "relation", "left").select(
        "relation", "expected", "found", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)).alias("matches")
    )


def require_tables(warehouse: Warehouse, needed: Iterable[tuple[str, str]]) -> None:
    """Raise when an ACCESS table of (product, table) is missing."""
    missing = [f"{p}.{t}" for p, t in needed if not warehouse.exists(p, "access", t)]
    if missing:
        raise LookupError(f"required upstream tables are missing, build the source products first: {', '.join(missing)}")


def require_counts(results: DataFrame) -> None:
    """Raise when a relation of ``row_counts`` has not the expected rows. Reads one row per relation."""
    wrong = [f"{r.relation}: {r.found} rows, not {r.expected}" for r in results.filter("NOT matches").collect()]
    if wrong:
        raise ValueError("row counts differ: " + "; ".join(wrong))


def upstream_contract(
    warehouse: Warehouse, expected: Mapping[tuple[str, str], int]
) -> DataFrame:
    """Producer ACCESS tables a domain needs: there, and with the expected rows.

    ``expected`` maps (product, table) to a row count. Raises when a table is missing.
    """
    require_tables(warehouse, expected)
    frames = {f"{p}.{t}": warehouse.table(p, "access", t) for p, t in expected}
    return row_counts(frames, {f"{p}.{t}": n for (p, t), n in expected.items()})


def layer_parity(stages: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Row counts of one table across its stages, side by side, and whether they agree.

    ``stages`` maps a table to its {stage: frame}; all tables need the same stages.
    """
    names = list(next(iter(stages.values())))
    counts = union(
        [
            df.agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit(stage).alias("stage"), "n")
            for table, by_stage in stages.items()
            for stage, df in by_stage.items()
        ]
    )
    wide = counts.groupBy("table_name").pivot("stage", names).agg(F.first("n"))
    agree = reduce(lambda a, b: a & b, [F.col(names[0]) == F.col(n) for n in names[1:]])
    return wide.select("table_name", *[F.col(n).alias(f"{n}_rows") for n in names], agree.alias("matches"))


#: Ranges of keys at each level of a content comparison.
DIGEST_LEVELS = (256, 65_536)


def _digests(df: DataFrame, levels: int) -> DataFrame:
    """Per range of keys: rows and two order-free sums of row hashes."""
    return df.groupBy(F.pmod(F.col("_place"), F.lit(levels)).alias("_range")).agg(
        F.count("*").alias("_rows"), F.sum(F.col("_h1").cast("decimal(38,0)")).alias("_s1"), F.sum(F.col("_h2").cast("decimal(38,0)")).alias("_s2")
    )


def differing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between two frames of the same columns, with their rows on each side.

    Both sides are reduced to digests of ranges of keys: sums of row hashes, so order does
    not matter and rows count as often as they stand. Only ranges with unequal digests
    are looked at again, in finer ranges, and only rows of unequal fine ranges are
    compared one by one. Equal tables move digests alone. A row counts as on a side as
    often as it stands there; keys may be null.
    """
    columns = left.columns

    def marked(df: DataFrame) -> DataFrame:
        all_columns = [F.col(f"`{c}`") for c in columns]
        row = [F.xxhash64(F.lit(seed), F.struct(*[c.isNull() for c in all_columns]), *all_columns) for seed in (1, 2)]
        return df.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.lit(3), F.col(f"`{key}`")).alias("_place"), row[0].alias("_h1"), row[1].alias("_h2"))

    sides = [marked(left), marked(right)]
    for levels in DIGEST_LEVELS:
        one, two = (_digests(side, levels) for side in sides)
        other = two.toDF(*[f"{c}_" for c in two.columns])
        equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("_rows", "_s1", "_s2")])
        unequal = one.join(other, F.col("_range") == F.col("_range_"), "full").filter(~equal)
        unequal = pin(unequal.select(F.coalesce("_range", "_range_").alias("_unequal")), "unequal")
        within = F.pmod(F.col("_place"), F.lit(levels)) == F.col("_unequal")
        sides = [side.join(unequal, within, "left_semi") for side in sides]
    counted = sides[0].withColumn("_side", F.lit(1)).unionByName(sides[1].withColumn("_side", F.lit(-1)))
    per_row = counted.groupBy("_key", "_h1", "_h2").agg(
        F.sum("_side").alias("_more"), F.count_if(F.col("_side") == 1).alias("_left"), F.count_if(F.col("_side") == -1).alias("_right")
    )
    per_key = per_row.groupBy("_key").agg(F.max(F.abs("_more")).alias("_off"), F.sum("_left").alias("left_rows"), F.sum("_right").alias("right_rows"))
    return per_key.filter("_off > 0").select(F.col("_key").alias(key), "left_rows", "right_rows")


def failing(results: DataFrame) -> DataFrame:
    return results.filter("failures > 0")


def require(results: DataFrame) -> None:
    """Raise when any check failed. Reads one row per check."""
    broken = [f"{r.check_name}({r.table_name}.{r.column_name}): {r.failures}" for r in failing(results).collect()]
    if broken:
        raise ValueError("failed checks: " + "; ".join(broken))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "check_name string, table_name string, column_name string, failures bigint")
