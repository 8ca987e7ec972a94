"""Comparing what is known with what is there, and folding changes into a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the revision that stands for "nothing" in a change event.
ZERO_REVISION = "0" * 40


def branch_entries(branches: DataFrame) -> DataFrame:
    """Branches that get a sandbox: all but the default one (``main`` when unnamed)."""
    default = _default_branch()
    return branches.filter(F.col("branch_name") != default).withColumn("default_branch", default)


def merge_request_entries(requests: DataFrame) -> DataFrame:
    """Merge requests that get a sandbox: from another branch into the default one, with a number."""
    default = _default_branch()
    source, number = F.coalesce("source_branch", F.lit("")), F.coalesce("mr_iid", F.lit(""))
    usable = (source != "") & (number != "") & (source != default) & (F.col("target_branch") == default)
    return requests.filter(usable).withColumn("default_branch", default)


def _default_branch() -> Column:
    named = F.col("default_branch")
    return F.when(named != "", named).otherwise("main")


def snapshot_reconcile(known: DataFrame, current: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """What to do per key: provision, destroy, forget or keep.

    ``artifacts`` holds the keys whose artifact exists. All three are keyed by
    ``key`` without duplicates; the three frames share one partitioning.
    """

    def present(df: DataFrame, flag: str) -> DataFrame:
        return df.select(key).distinct().withColumn(flag, F.lit(True))

    both = present(known, "_known").join(present(current, "_current"), key, "full_outer")
    joined = both.join(present(artifacts, "_artifact"), key, "left")
    is_current, has_artifact = F.col("_current").isNotNull(), F.col("_artifact").isNotNull()
    is_known = F.col("_known").isNotNull()
    action = (
        F.when(is_current & is_known & has_artifact, "keep")
        .when(is_current, "provision")
        .when(has_artifact, "destroy")
        .otherwise("forget")
    )
    return joined.select(key, action.alias("action"))


def change_action(before: Column, after: Column) -> Column:
    """A change to the zero revision destroys, one from it creates, any other updates."""
    return F.when(after == ZERO_REVISION, "destroy").when(before == ZERO_REVISION, "create").otherwise("update")


def request_action(action: Column, state: Column) -> Column:
    """Closing or merging a request destroys its sandbox; anything else keeps it up to date."""
    ended = action.isin("close", "merge") | state.isin("closed", "merged")
    return F.when(F.coalesce(ended, F.lit(False)), "destroy").otherwise("update")


def branch_of_ref(ref: Column) -> Column:
    """The branch that a full reference names; empty for tags, other references and null."""
    return F.regexp_extract(F.coalesce(ref, F.lit("")), "^refs/heads/(.*)$", 1)


# Kinds of sandbox, as they stand in the names of their scopes.
BRANCH, REQUEST = "branch", "request"


def sandbox_changes(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Raw change events as ``sandbox, ts, event_id, action``, for the fold.

    ``projects`` (``project``, ``default_branch``) are the managed ones; events of
    others are dropped. A push counts on a branch that is not the default one. A
    merge request counts with a number, from another branch into the default one.
    Other kinds of events, and null kinds, are dropped. Batch or stream.
    """
    managed = projects.groupBy("project").agg(F.max("default_branch").alias("default_branch"))
    default, branch = _default_branch(), branch_of_ref(F.col("ref"))
    source, number = F.coalesce("source_branch", F.lit("")), F.coalesce("mr_iid", F.lit(""))
    pushed = F.col("kind").isin("push", "repository_update") & (branch != "") & (branch != default)
    requested = (F.col("kind") == "merge_request") & (source != "") & (number != "")
    requested &= (source != default) & (F.col("target_branch") == default)
    sandbox = F.when(pushed, F.concat_ws(":", "project", F.lit(BRANCH), branch)).when(
        requested, F.concat_ws(":", "project", F.lit(REQUEST), number)
    )
    action = F.when(pushed, change_action(F.col("before"), F.col("after"))).otherwise(
        request_action(F.col("request"), F.col("state"))
    )
    named = events.join(managed, "project").select(sandbox.alias("sandbox"), "ts", "event_id", action.alias("action"))
    return named.filter("sandbox IS NOT NULL")


def lifecycle_fold(events: DataFrame, key: str) -> DataFrame:
    """Last action per key by ``(ts, event_id)``. Repeated events change nothing.

    One bounded aggregate per key: a key with most of the events is reduced in
    the map tasks and one row per task is shuffled.
    """
    last = F.max(F.struct("ts", "event_id", "action")).alias("last")
    return events.groupBy(key).agg(last).select(
        key, F.col("last.ts").alias("ts"), F.col("last.event_id").alias("event_id"), F.col("last.action").alias("action")
    )


def live_keys(state: DataFrame, key: str) -> DataFrame:
    return state.filter(F.col("action") != "destroy").select(key)


# One state from full listings and change events. A listing is complete for its scope (a project's branches, or its
# merge requests) at one moment; a change is about one key. Both are facts with a time, so any order of arrival will do.

_FACT = ("scope", "key", "ts", "rank", "event_id", "action")
_LISTED, _CHANGED = 0, 1


def scope_of_sandbox(sandbox: Column) -> Column:
    """Project and kind, all but the last part of a branch's or a request's key."""
    return F.regexp_extract(sandbox, f"^(.*?:(?:{BRANCH}|{REQUEST})):", 1)


def change_facts(changes: DataFrame) -> DataFrame:
    """Changes (``sandbox, ts, event_id, action``) as facts."""
    return changes.select(
        scope_of_sandbox(F.col("sandbox")).alias("scope"),
        F.col("sandbox").alias("key"),
        "ts",
        F.lit(_CHANGED).alias("rank"),
        F.col("event_id").cast("bigint").alias("event_id"),
        "action",
    )


def listing_facts(entries: DataFrame) -> DataFrame:
    """Entries of listings (``scope, key, taken_at``) as facts: the key was there at that time."""
    return entries.select(
        "scope",
        "key",
        F.col("taken_at").alias("ts"),
        F.lit(_LISTED).alias("rank"),
        F.lit(None).cast("bigint").alias("event_id"),
        F.lit("listed").alias("action"),
    )


def merge_state(facts: DataFrame, listings: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The newest fact per key, keys missing from a newer listing of their scope as destroyed.

    ``listings`` (``scope, taken_at``) names every listing taken, those without
    entries too; ``state`` is an earlier result. Facts are ordered by time; at one
    moment a change counts more than a listing, and the larger event id more than
    the smaller, null ones least. Destroyed keys stay as tombstones, so an older fact that
    arrives later brings nothing back. Merging is a maximum: facts in any order, in
    any batches and any number of times give the same state. A batch of facts only
    needs the newest listings of all batches so far (``newest_listings``).

    Facts without key, scope or time are dropped. One shuffle by key with map-side
    maxima; the listings are reduced to one row per scope before the join.
    """
    rows = facts.select(*_FACT)
    if state is not None:
        rows = rows.unionByName(state.select(*_FACT))
    order = F.struct("ts", "rank", F.coalesce("event_id", F.lit(-(2**63)).cast("bigint")).alias("_id"), "event_id", "action")
    newest = (
        rows.dropna(subset=["scope", "key", "ts"])
        .groupBy("scope", "key")
        .agg(F.max(order).alias("newest"))
        .select("scope", "key", "newest.ts", "newest.rank", "newest.event_id", "newest.action")
    )
    listed = newest_listings(listings)
    gone = F.coalesce(F.col("ts") < F.col("taken_at"), F.lit(False))
    joined = newest.join(listed, "scope", "left")
    return joined.select(
        "scope",
        "key",
        F.when(gone, F.col("taken_at")).otherwise(F.col("ts")).alias("ts"),
        F.when(gone, F.lit(_LISTED)).otherwise(F.col("rank")).alias("rank"),
        F.when(~gone, F.col("event_id")).alias("event_id"),
        F.when(gone, "destroy").otherwise(F.col("action")).alias("action"),
    )


def newest_listings(listings: DataFrame) -> DataFrame:
    """The time of the newest listing per scope; all that later merges need to know of earlier ones."""
    return listings.dropna().groupBy("scope").agg(F.max("taken_at").alias("taken_at"))


def live_sandboxes(state: DataFrame, kind: str) -> DataFrame:
    """Keys of one kind, branches or requests, that a state holds as there."""
    return state.filter(F.col("scope").endswith(f":{kind}") & (F.col("action") != "destroy")).select("key", "ts", "action")


def expire_state(state: DataFrame, before: Column) -> DataFrame:
    """Forget tombstones older than ``before``; only right once no fact that old can arrive any more."""
    return state.filter((F.col("action") != "destroy") | (F.col("ts") >= before))
