"""Aggregates refreshed from changes against rebuilt ones."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terraced.operators.maintain import Measures, refresh, row_changes, summary, summary_state

SCHEMA = "id long, g string, h long, v decimal(12,2), n long"
KEEP = Measures("rows", {"total": "v", "count_sum": "n"}, {"first": "n", "cheapest": "v"}, {"last": "n"})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(chance, ids):
    value = lambda: None if chance.random() < 0.2 else Decimal(chance.randrange(-500, 500)) / 4
    number = lambda: None if chance.random() < 0.1 else chance.randrange(20)
    return {i: (i, chance.choice(["a", "b", "c", None]), chance.choice([1, 2, None]), value(), number()) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_refreshed_as_rebuilt(spark, seed):
    chance = random.Random(seed)
    now = made(chance, range(40))
    groups = ["g", "h"]
    before = spark.createDataFrame(list(now.values()), SCHEMA)
    state = summary_state(before, groups, KEEP)
    for version in range(2):
        for i in chance.sample(sorted(now), 12):
            del now[i]
        now.update(made(chance, chance.sample(sorted(now), 6)))
        now.update(made(chance, range(100 * (version + 1), 100 * (version + 1) + 8)))
        after = spark.createDataFrame(list(now.values()), SCHEMA)
        went, came = row_changes(before, after, "id")
        state = refresh(state, went, came, after, groups, KEEP)
        assert rows_of(summary(state, groups, KEEP)) == rows_of(summary(summary_state(after, groups, KEEP), groups, KEEP))
        before = after


def test_the_source_is_read_only_where_an_extreme_went(spark):
    before = spark.createDataFrame([(1, "a", 1, Decimal(1), 1), (2, "a", 1, Decimal(2), 5), (3, "a", 1, Decimal(3), 9), (4, "b", 1, None, None)], SCHEMA)
    trap = before.withColumn("v", F.raise_error(F.lit("source read")).cast("decimal(12,2)"))
    state = summary_state(before, ["g"], KEEP)
    middle = before.filter("id = 2")
    came = spark.createDataFrame([(9, "a", 1, Decimal(0), 0), (10, "z", 1, None, 4)], SCHEMA)
    fresh = refresh(state, middle, came, trap, ["g"], KEEP)
    assert rows_of(summary(fresh, ["g"], KEEP)) == sorted(
        [("a", 3, Decimal("4.00"), 10, 0, Decimal("0.00"), 9), ("b", 1, None, None, None, None, None), ("z", 1, None, 4, 4, None, 4)], key=repr
    )
    with pytest.raises(Exception, match="source read"):
        refresh(state, before.filter("id = 3"), came, trap, ["g"], KEEP).collect()


def test_nothing_and_everything_changes(spark):
    before = spark.createDataFrame([(1, "a", 1, Decimal(1), 1), (2, None, 1, None, None)], SCHEMA)
    none = before.limit(0)
    state = summary_state(before, ["g"], KEEP)
    assert [d.count() for d in row_changes(before, before, "id")] == [0, 0]
    assert rows_of(refresh(state, none, none, before, ["g"], KEEP)) == rows_of(state)
    assert refresh(state, before, none, none, ["g"], KEEP).collect() == []
    assert rows_of(refresh(summary_state(none, ["g"], KEEP), none, before, before, ["g"], KEEP)) == rows_of(state)
