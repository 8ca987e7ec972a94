"""Manifests as documents, references in model texts, one state from listings and events, state that ends."""

from __future__ import annotations

import gzip
import json
import random
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terraced.operators import contracts, reconcile
from terraced.streaming.lifecycle import EndingState, fold_ending_stream, fold_stream, read_event_stream

EVENTS = "k string, ts timestamp, event_id bigint, action string"
START = datetime(2026, 1, 1)

# ---------------------------------------------------------------- manifests


def rewritten(spark, *texts):
    given = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "position int, manifest string")
    done = contracts.rewrite_manifests(given, {"orders": "DEV_ORDERS", "taxes": "DEV_TAXES"})
    assert done.columns == given.columns
    return [r["manifest"] for r in done.orderBy("position").collect()]


def test_only_databases_change(spark):
    manifest = {
        "metadata": {"version": 12, "none": None, "ratio": 0.25},
        "nodes": {
            "a": {"database": "RAW", "name": "x", "path": "models/Orders/x.sql", "meta": {"tags": ["t", None, 1], "deep": {"database": "RAW"}}},
            "b": {"database": "RAW", "fqn": ["p", "taxes"], "config": True},
            "c": {"database": "RAW", "name": "shipments"},
            "d": {"database": " ", "name": "orders"},
            "e": {"database": None, "name": "orders"},
            "f": {"database": 5, "name": "orders"},
            "g": {"name": "orders"},
            "h": "orders",
            "i": {"database": "RAW", "fqn": "taxes"},
            "j": {"database": "RAW", "name": None, "alias": "ORDERS", "columns": {"é": "ü\"\n"}},
            "k": {"database": "RAW", "name": "customers"},
        },
        "macros": {"database": "RAW"},
        "disabled": [],
    }
    (done,) = rewritten(spark, json.dumps(manifest))
    expected = json.loads(json.dumps(manifest))
    for node, database in {"a": "DEV_ORDERS", "b": "DEV_TAXES", "j": "DEV_ORDERS"}.items():
        expected["nodes"][node]["database"] = database
    assert json.loads(done) == expected


def test_other_texts_stay(spark):
    texts = ['{"nodes": [1]}', '{"metadata": 1}', "no json", "[1, 2]", "", None, '{"nodes": {}, "nodes": {}}', "3"]
    assert rewritten(spark, *texts) == texts
    assert rewritten(spark, '{"nodes":{}}') == ['{"nodes":{}}']
    empty = spark.createDataFrame([], "manifest string")
    assert contracts.rewrite_manifests(empty, {"orders": "X"}).collect() == []
    assert contracts.rewrite_manifests(empty, {}) is empty


def test_a_manifest_is_one_gzip_file(spark, tmp_path):
    texts = ['{\n "nodes": {"a": {"database": "RAW", "name": "orders"}}\n}', '{"nodes": {}}']
    given = spark.createDataFrame([(t,) for t in texts], "manifest string").coalesce(1)
    place = str(tmp_path / "out")
    contracts.write_manifests(given, place)
    files = [f for f in Path(place).iterdir() if f.name.endswith(".gz")]
    assert sorted(gzip.open(f, "rt").read().strip() for f in files) == sorted(texts)
    back = contracts.rewrite_manifests(contracts.read_manifests(spark, place), {"orders": "DEV"})
    assert sorted(json.loads(r[0])["nodes"].get("a", {}).get("database", "") for r in back.collect()) == ["", "DEV"]


# ---------------------------------------------------------------- references in texts


def references(spark, text, **options):
    found = contracts.text_references(spark.createDataFrame([(1, text)], "id int, text string"), **options)
    assert found.columns == ["id", "package", "name"]
    return [(r["package"], r["name"]) for r in found.collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("select * from {{ ref('a') }} join {{ref( \"p\" , 'b' )}}", [(None, "a"), ("p", "b")]),
        ("{%- set x = ref('a', v=2) -%}{{ builtins.ref('b') }}", [(None, "a"), (None, "b")]),
        ("{{ ref('a') ~ ref('p', 'b', version=1) }}", [(None, "a"), ("p", "b")]),
        ("{{ ref(\n'a'\n) }}", [(None, "a")]),
        ("{# {{ ref('a') }} #} {% raw %}{{ ref('b') }}{% endraw %} {{ ref('c') }}", [(None, "c")]),
        ("{{ \"ref('a')\" }} {{ 'it\\'s ref(\"b\")' }} {{ ref('c') }}", [(None, "c")]),
        ("ref('a') {{ xref('b') }} {{ my.ref('c') }} {{ ref(d) }} {{ ref() }} {{ source('e', 'f') }}", []),
        ("don't {{ ref('a') }} it's", [(None, "a")]),
        ("{{ ref('a'", []),
        ("{{ '}} ref(\"a\") }}", []),
        ("", []),
        (None, []),
    ],
)
def test_references(spark, text, expected):
    assert references(spark, text) == expected


def test_references_in_sql_comments(spark):
    text = "select 1 -- {{ ref('a') }}\n/* {{ ref('b') }}\n */ from {{ ref('c') }} where x = '--' and y = {{ ref('d') }}"
    assert [name for _, name in references(spark, text)] == ["a", "b", "c", "d"]
    assert [name for _, name in references(spark, text, in_sql_comments=False)] == ["c", "d"]


def test_long_texts_of_references(spark):
    assert len(references(spark, "x' {{ ref('a') }} " * 20_000)) == 20_000
    assert references(spark, "{{ " + "'q' " * 200_000 + "ref('a') }}") == [(None, "a")]
    assert references(spark, "{{ " * 200_000) == []


@pytest.mark.parametrize(
    "text, expected, outside_comments",
    [
        ("{% raw %x ref('a') %} {{ ref('b') }}", [(None, "b")], [(None, "b")]),
        ("{%} {{ ref('a') }} {{}} {%%}{{ ref('b') }}}", [(None, "a"), (None, "b")], [(None, "a"), (None, "b")]),
        ("{{ 'x\\\\' ~ ref('a') ~ 'ref(\"b\")\\\\\\'}} {{ ref('c') }}", [(None, "a"), (None, "c")], [(None, "a"), (None, "c")]),
        ("{{ ref('p', \"q'r\") }} {{ ref('s, \"t') }}", [(None, "p"), ("s, ", "t")], [(None, "p"), ("s, ", "t")]),
        ("{{ ref('p'\t,\n'' ) ~ éref('a') ~ ref ('b') ~ ref(c) ~ builtins.ref('d') }}", [("p", ""), (None, "a"), (None, "b"), (None, "d")], [("p", ""), (None, "a"), (None, "b"), (None, "d")]),
        ("'-- {{ ref(\"a\") }}' /{# #}* {{ ref('b') }} -{# #}- {/**/{ ref('c') }}", [(None, "a"), (None, "b")], [(None, "a"), (None, "b"), (None, "c")]),
        ("- /* {{ ref('a') }} ** {{ ref('b') }}", [(None, "a"), (None, "b")], []),
    ],
)
def test_references_in_odd_texts(spark, text, expected, outside_comments):
    assert references(spark, text) == expected
    assert references(spark, text, in_sql_comments=False) == outside_comments


@pytest.mark.parametrize("inside", [True, False])
def test_references_are_searched_by_compiled_expressions(spark, inside):
    texts = spark.createDataFrame([("{{ ref('a') }}",)], "text string")
    plan = contracts.text_references(texts, in_sql_comments=inside)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("*(1) Generate") == 2


def test_references_to_one_package(spark):
    text = "it's {{ ref('p/*x*/q', 'a') }} {{ ref('pq', 'b') ~ ref('pq2', 'c') }} {{ ref('pq') }} {{ ref(\"r\", 'pq') }}"
    assert references(spark, text, package="pq") == [("pq", "b")]
    assert references(spark, text, package="pq", in_sql_comments=False) == [("pq", "a"), ("pq", "b")]
    assert references(spark, "{{ ref('', 'a') }} {{ ref('b') }}", package="") == [("", "a")]


def test_unresolved_of_the_producer_only(spark):
    texts = spark.createDataFrame([("{{ ref('p', 'a') }} {{ ref('p', 'b') }} {{ ref('q', 'b') }} {{ ref('c') }} {{ ref('p', 'b') }}",)], "text string")
    contract = spark.createDataFrame([("a",)], "name string")
    found = contracts.unresolved_in_texts(contracts.text_references(texts), contract, "p")
    assert [tuple(r) for r in found.collect()] == [("b", 2)]


# ---------------------------------------------------------------- one state from listings and events


def brute_state(facts, listings):
    newest = {}
    for scope, key, ts, rank, event_id, action in facts:
        order = (ts, rank, -1 if event_id is None else event_id, action)
        if (scope, key) not in newest or order > newest[scope, key][0]:
            newest[scope, key] = (order, (ts, event_id, action))
    last = {}
    for scope, at in listings:
        last[scope] = max(at, last.get(scope, at))
    state = set()
    for (scope, key), (_, (ts, event_id, action)) in newest.items():
        at = last.get(scope)
        state.add((scope, key, at, None, "destroy") if at and ts < at else (scope, key, ts, event_id, action))
    return state


@pytest.mark.parametrize("seed", range(3))
def test_any_order_gives_one_state(spark, seed):
    chance = random.Random(seed)
    at = lambda: START + timedelta(hours=chance.randrange(12))
    scopes = [f"p{p}:{kind}" for p in range(2) for kind in (reconcile.BRANCH, reconcile.REQUEST)]
    listings, facts = [], []
    for _ in range(10):
        scope, moment = chance.choice(scopes[:3]), at()
        listings.append((scope, moment))
        facts += [(scope, f"{scope}:{k}", moment, 0, None, "listed") for k in range(4) if chance.random() < 0.4]
    for event in range(60):
        scope = chance.choice(scopes)
        facts.append((scope, f"{scope}:{chance.randrange(4)}", at(), 1, event, chance.choice(["create", "update", "destroy"])))
    expected = brute_state(facts, listings)

    def frame(rows):
        return spark.createDataFrame(rows, "scope string, key string, ts timestamp, rank int, event_id bigint, action string")

    def seen(state):
        return {(r["scope"], r["key"], r["ts"], r["event_id"], r["action"]) for r in state.collect()}

    def taken(rows):
        return spark.createDataFrame(rows, "scope string, taken_at timestamp")

    assert seen(reconcile.merge_state(frame(facts), taken(listings))) == expected
    chance.shuffle(facts)
    chance.shuffle(listings)
    state, known = None, taken([])
    for part in range(3):
        known = reconcile.newest_listings(known.unionByName(taken(listings[part::3])))
        state = reconcile.merge_state(frame(facts[part::3] + facts[:5]), known, state)
    assert seen(state) == expected
    assert seen(reconcile.merge_state(frame([]), known, state)) == expected
    late = START + timedelta(hours=6)
    kept = seen(reconcile.expire_state(state, F.lit("2026-01-01 06:00:00").cast("timestamp")))
    assert kept == {r for r in expected if r[4] != "destroy" or r[2] >= late}


def test_state_of_nothing_and_of_gaps(spark):
    nothing = spark.createDataFrame([], "scope string, key string, ts timestamp, rank int, event_id bigint, action string")
    listings = spark.createDataFrame([("p:branch", None), (None, START)], "scope string, taken_at timestamp")
    assert reconcile.merge_state(nothing, listings).collect() == []
    rows = [(None, "k", START, 1, 1, "update"), ("p:branch", None, START, 1, 2, "update"), ("p:branch", "p:branch:x", None, 1, 3, "update"), ("p:branch", "p:branch:x", START, 1, None, "update")]
    state = reconcile.merge_state(spark.createDataFrame(rows, nothing.schema), listings)
    assert [tuple(r) for r in reconcile.live_sandboxes(state, reconcile.BRANCH).collect()] == [("p:branch:x", START, "update")]
    assert reconcile.live_sandboxes(state, reconcile.REQUEST).collect() == []


def test_scopes_of_sandboxes(spark):
    names = spark.createDataFrame([("p:branch:a:request:b",), ("p:request:7",), ("q",)], "s string")
    assert [r[0] for r in names.select(reconcile.scope_of_sandbox(F.col("s"))).collect()] == ["p:branch", "p:request", ""]


# ---------------------------------------------------------------- state that ends


def arrivals(chance, batches, per_batch, keys):
    """Batches of events an hour apart, some up to five hours late."""
    rows, event = [], 0
    for batch in range(batches):
        mine = []
        for _ in range(per_batch):
            ts = START + timedelta(hours=batch, minutes=chance.randrange(60)) - timedelta(hours=chance.choice([0, 0, 0, 1, 5]))
            mine.append((chance.choice([*keys, None]), ts, event, chance.choice(["create", "update", "destroy", "destroy"])))
            event += 1
        rows.append(mine)
    return rows


def brute_ending(batches, lateness):
    newest, last = None, {}
    for batch in batches:
        kept = [r for r in batch if r[1] and (newest is None or r[1] >= newest - lateness)]
        for key, ts, event_id, action in kept:
            if key not in last or (ts, event_id) > last[key][:2]:
                last[key] = (ts, event_id, action)
        newest = max([newest] * (newest is not None) + [r[1] for r in kept], default=newest)
    return {(k, *v) for k, v in last.items() if v[2] != "destroy" or v[0] >= newest - lateness}


def rows_of(state):
    return {tuple(r) for r in state.select("k", "ts", "event_id", "action").collect()}


def test_ending_state_over_many_batches(spark, tmp_path):
    chance, lateness = random.Random(5), timedelta(hours=3)
    batches = arrivals(chance, 24, 6, [f"k{i}" for i in range(30)])
    folder = str(tmp_path / "state")
    for number, batch in enumerate(batches):
        state = EndingState(spark, folder, "k", lateness, fanout=3)  # a new one, as after a restart
        frame = spark.createDataFrame(batch, EVENTS).coalesce(1)
        state.apply(frame, number)
        if number % 5 == 0:
            state.apply(frame, number)  # repeated, as after a crash before the stream's own commit
        if number % 6 == 5:
            assert rows_of(state.read()) == brute_ending(batches[: number + 1], lateness)
    record = state.record()
    assert len(record.runs) <= 3 * 4
    assert len(list((tmp_path / "state" / "runs").iterdir())) <= 2 * len(record.runs) + 4
    assert len([f for f in (tmp_path / "state" / "records").iterdir() if f.suffix == ".json"]) <= 2


def test_destroyed_keys_leave_the_folders(spark, tmp_path):
    state = EndingState(spark, str(tmp_path / "state"), "k", timedelta(hours=1), fanout=2)
    for number in range(6):
        at = START + timedelta(hours=2 * number)
        rows = [(f"gone{number}", at, number, "destroy"), ("stays", at, 100 + number, "update")]
        state.apply(spark.createDataFrame(rows, EVENTS), number)
    assert {r[0] for r in rows_of(state.read())} == {"gone5", "stays"}
    assert sum(run.rows for run in state.record().runs) <= 4  # twelve without forgetting
    late = [("gone0", START, 900, "create"), ("new", START + timedelta(hours=10), 901, "create"), ("timeless", None, 902, "create")]
    state.apply(spark.createDataFrame(late, EVENTS), 6)
    assert {r[0] for r in rows_of(state.read())} == {"gone5", "stays", "new"}


def test_a_run_cut_off_before_its_record_is_done_again(spark, tmp_path, monkeypatch):
    state = EndingState(spark, str(tmp_path / "state"), "k", timedelta(hours=1), fanout=2)
    batches = [[(f"k{n}", START + timedelta(minutes=n), n, "create")] for n in range(3)]
    for number, batch in enumerate(batches):
        with monkeypatch.context() as cut:
            cut.setattr(EndingState, "_write", lambda *_: (_ for _ in ()).throw(OSError("lost driver")))
            with pytest.raises(OSError):
                state.apply(spark.createDataFrame(batch, EVENTS), number)
        assert state.record().batch == number - 1
        state.apply(spark.createDataFrame(batch, EVENTS), number)
    assert rows_of(state.read()) == brute_ending(batches, timedelta(hours=1))


def test_ending_stream_restarts(spark, tmp_path):
    source, folder = tmp_path / "events", str(tmp_path / "state")
    source.mkdir()
    lateness = timedelta(days=30)  # nothing is late and nothing ends: the same as the fold that keeps all
    schema = spark.createDataFrame([], EVENTS).schema

    def stream():
        return read_event_stream(spark, str(source), schema)

    assert fold_ending_stream(stream(), "k", folder, lateness).collect() == []
    for batch in arrivals(random.Random(1), 4, 8, ["a", "b", "c", "d"]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        state = fold_ending_stream(stream(), "k", folder, lateness, fanout=2)
        assert rows_of(state) == rows_of(fold_stream(stream(), "k", str(tmp_path / f"all-{uuid.uuid4().hex}")))
    assert rows_of(fold_ending_stream(stream(), "k", folder, lateness, fanout=2)) == rows_of(state)
    with pytest.raises(ValueError):
        EndingState(spark, folder, "k", lateness, fanout=1)
