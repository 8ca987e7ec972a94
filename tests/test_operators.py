"""Ranking, checks, plans for clones, contracts and reconciling, on small hand-made rows."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraced.operators import clones, contracts, quality, reconcile
from terraced.operators.ranking import number_rows
from terraced.sources import landing, seed
from terraced.streaming.lifecycle import fold_stream, read_event_stream


def skewed_rows(seed: int) -> list[tuple]:
    """A third of the rows share one key, another tenth have none."""
    rng = random.Random(seed)
    rows = []
    for n in range(900):
        place = rng.random()
        group = "hot" if place < 0.34 else None if place < 0.44 else f"g{rng.randrange(60)}"
        rows.append((group, f"item-{rng.randrange(10**9)}-{n}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_row_numbers_equal_a_plain_window(spark, seed):
    df = spark.createDataFrame(skewed_rows(seed), "g string, item string").repartition(5)
    got = number_rows(df, "g", "item", "n")
    want = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("item")))
    assert got.columns == ["g", "item", "n"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_group_with_most_rows_is_numbered_in_several_tasks(spark):
    df = spark.range(8000).select(F.when(F.col("id") < 7000, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("item"))
    got = number_rows(df, "g", "item", "n")
    assert got.filter("g = 'hot' AND n != item + 1").isEmpty() and got.filter("g != 'hot' AND n != 1").isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "broadcast" not in plan.split("Relation")[0].lower()
    assert number_rows(df.limit(0), "g", "item", "n").count() == 0


def test_large_keys_have_sample_rows(spark, as_of):
    keys = spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("bigint") for k in (3_000_000_000, 100_000_000_000)])).alias("n"))
    for make in (seed.seed_customers, seed.seed_orders, seed.seed_taxes, seed.seed_depot_transactions):
        rows = make(keys, as_of)
        assert len(rows.select(*[F.col(c).cast("string") for c in rows.columns]).collect()) == 2


def test_tables_without_files_are_reported(spark, tmp_path):
    (tmp_path / "bare").mkdir()
    for n in (1, 2, 3):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "full"))
    paths = {t: str(tmp_path / t) for t in ("full", "bare", "absent")}
    missing = landing.missing_files(spark, paths, ["full", "bare", "absent", "unknown"])
    assert sorted(r[0] for r in missing.collect()) == ["absent", "bare", "unknown"]
    [newest] = landing.latest_files(paths, spark).collect()
    assert (newest.table_name, newest.row_count, newest.data_files) == ("full", 3, 3) and newest.file_name.endswith(".parquet")


def test_a_stream_without_events_has_no_state(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    events = read_event_stream(spark, str(tmp_path / "inbox"), T.StructType.fromDDL("k string, ts timestamp, event_id bigint, action string"))
    assert fold_stream(events, "k", str(tmp_path / "state")).collect() == []


def test_checks_report_each_fault(spark):
    orders = spark.createDataFrame(
        [("O1", 1, "paid", 5), ("O1", 2, "refunded", 0), (None, 9, None, -1), ("O3", None, "paid", None)],
        "order_id string, customer_id int, status string, quantity int",
    )
    customers = spark.createDataFrame([(1,), (2,)], "customer_id int")
    checks = quality.union(
        [
            quality.keys(orders, "orders", ["order_id"], ["status"]),
            quality.relationships(orders, "orders", "customer_id", customers, "customer_id"),
            quality.accepted_values(orders, "orders", {"status": ["paid"]}),
            quality.in_range(orders, "orders", {"quantity": F.col("quantity") > 0}),
        ]
    )
    got = {(r.check_name, r.column_name): r.failures for r in checks.collect()}
    assert got == {
        ("not_null", "order_id"): 1,
        ("not_null", "status"): 1,
        ("unique", "order_id"): 1,
        ("relationships", "customer_id"): 1,
        ("accepted_values", "status"): 1,
        ("range", "quantity"): 2,
    }
    assert [tuple(r) for r in quality.duplicates(orders, "order_id").collect()] == [("O1", 2)]
    assert [tuple(r) for r in quality.orphans(orders, "customer_id", customers, "customer_id").collect()] == [(9, 1)]
    with pytest.raises(ValueError, match="unique\\(orders.order_id\\): 1"):
        quality.require(checks)
    quality.require(quality.empty(spark))


def test_parity_and_missing_relation(spark):
    two, three = spark.range(2), spark.range(3)
    parity = quality.layer_parity({"a": {"source": two, "landed": two}, "b": {"source": three, "landed": two}})
    assert {r.table_name: r.matches for r in parity.collect()} == {"a": True, "b": False}
    counts = quality.row_counts({"a": two}, {"a": 2, "gone": 4})
    assert {r.relation: (r.found, r.matches) for r in counts.collect()} == {"a": (2, True), "gone": (None, False)}


def _cksum(text: str) -> int:
    data = text.encode() + b"\n"
    size, crc = len(data), 0
    count = []
    while size:
        count.append(size & 255)
        size >>= 8
    for octet in list(data) + count:
        crc ^= octet << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else (crc << 1) & 0xFFFFFFFF
    return crc ^ 0xFFFFFFFF


@pytest.mark.parametrize("base", [10, 80, 95, 99, 100, 103, 104, 110, 130])
def test_clone_names_at_every_length(spark, base):
    name, owner, branch = "B" * base, "OWNER", "a_branch_with_a_long_name"
    lead = f"{name}_CI_CLO_{owner}_"
    room, token, check = 120 - len(lead), branch.upper(), str(_cksum(f"{name}_{owner}_{branch}"))
    if room <= 0:
        want = lead[:120]
    elif len(token) <= room:
        want = lead + token
    elif room - 1 - len(check) < 1:
        want = lead + check[:room]
    else:
        want = f"{lead}{token[: room - 1 - len(check)]}_{check}"
    got = spark.createDataFrame([(name, owner, branch)], "b string, o string, t string")
    assert got.select(clones.clone_name(F.col("b"), F.col("o"), F.col("t"))).head()[0] == want


def test_clone_plan_keeps_the_first_of_equal_targets(spark):
    long = "X" * 130
    registry = spark.createDataFrame(
        [(1, "a", "SDP_A"), (2, "b", long + "1"), (3, "c", long + "2"), (4, "d", None), (5, "e", "")],
        "position int, key string, source_database string",
    )
    rows = clones.clone_plan(registry, "OWN", F.lit("feat")).collect()
    assert {r.key: r.target_database for r in rows} == {"a": "SDP_A_CI_CLO_OWN_FEAT", "b": "X" * 120}


def test_clone_names_match_whole_bases_only(spark):
    names = ["A_CI_CLO_X", "a_ci_clo_y", "AB_CI_CLO_X", "A", "A_CI_CLO", "Z_A_CI_CLO_X", "A_CI_CLO_CI_CLO_X"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    bases = spark.createDataFrame([("A",), ("a_ci_clo",)], "base string")
    got = sorted(r.name for r in clones.clone_names(frame, bases).collect())
    want = sorted(n for n in names if n.upper().startswith(("A_CI_CLO_", "A_CI_CLO_CI_CLO_")))
    assert got == want


def test_sandbox_changes_drop_what_concerns_no_sandbox(spark):
    zero, some = reconcile.ZERO_REVISION, "a" * 40
    schema = (
        "event_id int, ts int, project string, kind string, ref string, before string, after string, "
        "source_branch string, target_branch string, mr_iid string, request string, state string"
    )
    none = (None,) * 5
    request = ("p", "merge_request", None, None, None)
    rows = [
        (1, 1, "p", "push", "refs/heads/a/b", zero, some, *none),
        (2, 1, "p", "repository_update", "refs/heads/c", some, zero, *none),
        (3, 1, "p", "push", "refs/heads/main", zero, some, *none),
        (4, 1, "p", "push", "refs/tags/v1", zero, some, *none),
        (5, 1, "p", "push", None, zero, some, *none),
        (6, 1, "foreign", "push", "refs/heads/a", zero, some, *none),
        (7, 1, None, "push", "refs/heads/a", zero, some, *none),
        (8, 1, "p", None, "refs/heads/a", zero, some, *none),
        (9, 1, *request, "a", "main", "7", "open", "opened"),
        (10, 1, *request, "a", "main", "8", "merge", None),
        (11, 1, *request, "a", "release", "9", "open", "opened"),
        (12, 1, *request, "main", "main", "9", "open", "opened"),
        (13, 1, *request, None, "main", "9", "open", "opened"),
        (14, 1, *request, "a", "main", None, "open", "opened"),
        (15, 1, "q", "push", "refs/heads/main", some, some, *none),
    ]
    projects = spark.createDataFrame([("p", None), ("p", None), ("q", "trunk")], "project string, default_branch string")
    got = {r.event_id: (r.sandbox, r.action) for r in reconcile.sandbox_changes(spark.createDataFrame(rows, schema), projects).collect()}
    assert got == {
        1: ("p:branch:a/b", "create"), 2: ("p:branch:c", "destroy"), 9: ("p:request:7", "update"),
        10: ("p:request:8", "destroy"), 15: ("q:branch:main", "update"),
    }


def test_sandbox_namespace(spark):
    seed = "branch_project_a_feature_with_a_long_name"
    want = f"{seed[:29]}_{_cksum(seed)}".replace("__", "_")[:40]
    got = spark.createDataFrame([(seed,)], "s string").select(clones.sandbox_namespace(F.col("s")))
    assert got.head()[0] == want


NODES = {
    "m.ok": {"resource_type": "model", "package_name": "p", "access": "public", "name": "ok", "database": "D", "schema": "S", "alias": "T_OK"},
    "m.plain": {"resource_type": "model", "package_name": "p", "access": "public", "name": "plain", "database": "D", "schema": "S", "alias": ""},
    "m.private": {"resource_type": "model", "package_name": "p", "access": "private", "name": "x", "database": "D", "schema": "S"},
    "m.other": {"resource_type": "model", "package_name": "q", "access": "public", "name": "x", "database": "D", "schema": "S"},
    "t.test": {"resource_type": "test", "package_name": "p", "access": "public", "name": "x", "database": "D", "schema": "S"},
    "m.bare": {"resource_type": "model", "package_name": "p", "access": "public", "name": "x", "database": "D"},
}


def test_public_contract_from_a_gzip_manifest(spark, tmp_path):
    with gzip.open(tmp_path / "manifest.json.gz", "wt") as out:
        json.dump({"metadata": {}, "nodes": NODES}, out, indent=1)
    rows = contracts.nodes(contracts.read_manifests(spark, str(tmp_path)))
    contract = contracts.require_public(contracts.public_contract(rows, "p"), "p")
    assert sorted(tuple(r) for r in contract.collect()) == [("ok", "D", "S", "T_OK"), ("plain", "D", "S", "plain")]
    with pytest.raises(LookupError):
        contracts.require_public(contracts.public_contract(rows, "nobody"), "nobody")
    used = spark.createDataFrame([("ok",), ("x",), ("x",)], "name string")
    assert [tuple(r) for r in contracts.unresolved(used, contract).collect()] == [("x", 2)]


def test_retarget_takes_the_first_scope_mentioned(spark):
    nodes = {
        "a": {"name": "orders_of_Customers", "database": "OLD"},
        "b": {"name": "x", "database": "OLD", "fqn": ["p", "Orders"]},
        "c": {"name": "taxes", "database": "OLD"},
        "d": {"name": "orders", "database": " "},
        "e": {"name": "depot_transactions", "path": "customers/x.sql", "database": "OLD"},
        "f": {"name": "nothing", "database": "OLD"},
    }
    frame = spark.createDataFrame([(json.dumps({"nodes": nodes}),)], "manifest string")
    moved = contracts.retarget(contracts.nodes(frame), {"customers": "CUST", "orders": "ORD", "depot_transactions": "DEP"})
    assert {r.node_id: r.database for r in moved.collect()} == {"a": "CUST", "b": "ORD", "c": "OLD", "d": " ", "e": "DEP", "f": "OLD"}


def test_reconcile_every_case(spark):
    def keyed(*keys):
        return spark.createDataFrame([(k,) for k in keys], "k string")

    plan = reconcile.snapshot_reconcile(keyed("kca", "kc", "ka", "k"), keyed("kca", "kc", "ca", "c"), keyed("kca", "ka", "ca", "a"), "k")
    assert {r.k: r.action for r in plan.collect()} == {
        "kca": "keep", "kc": "provision", "ca": "provision", "c": "provision", "ka": "destroy", "k": "forget",
    }


def test_entries_and_actions(spark):
    branches = spark.createDataFrame([("a", "main"), ("main", "main"), ("main", ""), ("dev", None)], "branch_name string, default_branch string")
    assert sorted(tuple(r) for r in reconcile.branch_entries(branches).collect()) == [("a", "main"), ("dev", "main")]
    requests = spark.createDataFrame(
        [("a", "main", "1", "main"), ("a", "rel", "2", "main"), ("main", "main", "3", "main"), (None, "main", "4", "main"), ("a", "main", None, "main"), ("b", "main", "6", None)],
        "source_branch string, target_branch string, mr_iid string, default_branch string",
    )
    assert sorted(r.mr_iid for r in reconcile.merge_request_entries(requests).collect()) == ["1", "6"]
    zero = reconcile.ZERO_REVISION
    changes = spark.createDataFrame([(zero, "x"), ("x", zero), ("x", "y"), (zero, zero)], "b string, a string")
    assert [r[0] for r in changes.select(reconcile.change_action(F.col("b"), F.col("a"))).collect()] == ["create", "destroy", "update", "destroy"]
    asked = spark.createDataFrame([("merge", "x"), (None, "closed"), (None, None), ("open", "opened")], "a string, s string")
    assert [r[0] for r in asked.select(reconcile.request_action(F.col("a"), F.col("s"))).collect()] == ["destroy", "destroy", "update", "update"]


def test_stream_equals_batch_across_restarts_and_repeats(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (f"k{rng.randrange(20)}", i, rng.choice(["create", "update", "destroy"]), f"2026-01-{rng.randrange(1, 29):02d} 00:00:00")
        for i in range(300)
    ]
    events = spark.createDataFrame(rows, "k string, event_id int, action string, at string").select(
        "k", "event_id", "action", F.to_timestamp("at").alias("ts")
    )
    inbox, folder = tmp_path / "inbox", str(tmp_path / "state")
    first, second = events.filter("event_id < 170"), events.filter("event_id >= 150")
    first.repartition(2).write.parquet(str(inbox / "one"))
    stream = lambda: read_event_stream(spark, str(inbox / "*"), events.schema, maxFilesPerTrigger="1")
    state = fold_stream(stream(), "k", folder)
    want = reconcile.lifecycle_fold(first, "k")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, want.collect()))
    second.repartition(2).write.parquet(str(inbox / "two"))
    state = fold_stream(stream(), "k", folder)
    want = reconcile.lifecycle_fold(events, "k")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, want.collect()))
    live = {r.k for r in reconcile.live_keys(state, "k").collect()}
    assert live == {r.k for r in want.collect() if r.action != "destroy"}


def test_distinct_columns_send_one_hash(spark):
    from terraced.operators import quality

    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "b")], "k bigint, v string")
    sent = []
    kept = quality.union
    quality.union = lambda frames: sent.extend(frames) or kept(frames)
    try:
        found = quality.present_and_distinct([("t", rows, ["k"], ["k", "v"])])
    finally:
        quality.union = kept
    assert [f.columns for f in sent] == [["number", "hash"]]
    assert sorted((r.check_name, r.column_name, r.failures) for r in found.collect()) == [("not_null", "k", 1), ("unique", "k", 1), ("unique", "v", 1)]
