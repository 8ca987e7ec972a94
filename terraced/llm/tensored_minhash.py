"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

Method. Two collections of ``side`` short sketches are made for each set, each
sketch ``width`` minimum hashes long. A table key is a pair of one left and one
right sketch, so ``2 * side * width`` minimum hashes give ``side ** 2`` tables of
``2 * width`` hashes each: about the square root of what separate tables need.
Two sets of similarity s meet in some table with probability
``(1 - (1 - s**width) ** side) ** 2``; with the defaults that is 0.9999 at 0.75
and 0.99999 at 0.8.

The pair structure also prunes exactly: a table can only be shared by documents
that share its left sketch and its right sketch, so sketches held by one set alone
are dropped before any pair key is formed. Most documents form none.

No table is expanded into all pairs. Members are compared with a pivot of their
table, first the smallest member, later other ones, and only while the table still
spans several components. What then still spans several components goes through an
exact rule: similar sets share one of their rarest shingles (those left after
taking away all that an intersection of the needed size could miss).

Defined results. Null and empty texts have no shingles and no links. Texts of one
to four words have one shingle, the whole sequence. Rows with one doc_id are one
document. A null doc_id takes part under a substitute made from its text; it never
names a component, so a component of such rows alone has a null id and keeps them.
Repeated rows stay rows. Only the id and text columns are read, so further columns
and their names do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraced.llm.common import hash_words, in_chunks, mix64, pin
from terraced.llm.components import components

SHINGLE = 5
PERCENT = 75
SIDE = 12
WIDTH = 2
PIVOT_ROUNDS = 3
_SUBSTITUTE = 1 << 62


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    hashed = hash_words(text.encode("utf-8", "surrogatepass").lower())
    if not len(hashed):
        return hashed
    span = min(words, len(hashed))
    with np.errstate(over="ignore"):
        rolled = np.full(len(hashed) - span + 1, span, dtype=np.uint64)
        for at in range(span):
            rolled = rolled * np.uint64(0xD1342543DE82EF95) + hashed[at : at + len(rolled)]
            rolled ^= rolled >> np.uint64(29)
        return np.unique(mix64(rolled))


def _sketches(shingles: np.ndarray, side: int, width: int) -> np.ndarray:
    """``2 * side`` sketch hashes: first the left collection, then the right one."""
    count = 2 * side * width
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64))
    odd = seeds | np.uint64(1)
    lowest = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        turned = (part[None, :] ^ seeds[:, None]) * odd[:, None]
        turned ^= turned >> np.uint64(32)
        np.minimum(lowest, turned.min(axis=1), out=lowest)
    joined = np.arange(2 * side, dtype=np.uint64)
    for at in range(width):
        joined = mix64(joined ^ lowest[at::width])
    return joined


def _digest(shingles: np.ndarray, salt: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(shingles + np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))


def _sketched(side: int, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for frame in in_chunks(frames, "text"):
                rows = []
                for doc_id, digest, text in zip(frame["doc_id"], frame["_digest"], frame["text"]):
                    found = shingle_set(text)
                    keys = _sketches(found, side, width).astype(np.int64) if len(found) else None
                    rows.append((None if pd.isna(doc_id) else int(doc_id), digest, len(found), _digest(found, 1), _digest(found, 2), keys))
                out = pd.DataFrame(rows, columns=["doc_id", "_digest", "n_shingles", "h1", "h2", "keys"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return run


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in in_chunks(frames, "text"):
        found = [shingle_set(text).astype(np.int64) for text in frame["text"]]
        yield pd.DataFrame({"node": frame["node"].to_numpy(), "shingles": found})


def near_duplicates(docs: DataFrame, *, side: int = SIDE, width: int = WIDTH, percent: int = PERCENT, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``_digest``, ``kept`` for every row of ``docs``.

    ``_digest`` is the hash of the text, to find a row again with its id.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_digest"), text.alias("text"))
    rows = texts.mapInPandas(_sketched(side, width), "doc_id long, _digest long, n_shingles long, h1 long, h2 long, keys array<long>")
    substitute = F.shiftrightunsigned("h1", 2) + F.lit(_SUBSTITUTE)
    rows = pin(rows.withColumn("node", F.coalesce("doc_id", substitute)), "sketches")

    classes = rows.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles")
    classes = pin(classes.agg(F.min("node").alias("node"), F.first("keys").alias("keys")), "classes")
    tables = pin(_tables(classes, side), "tables")
    # Copies of one text, and different texts under one id, are linked without comparing.
    copies = rows.join(classes.select("h1", "h2", F.col("node").alias("b")), ["h1", "h2"]).select(F.col("node").alias("a"), "b")
    copies = pin(copies.filter("a != b").distinct(), "copies")
    repeated = not rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    links = _links(docs, tables, classes, repeated, percent, rounds)
    roots = components(links.unionByName(copies))

    found = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = F.when(F.col("root") < F.lit(_SUBSTITUTE), F.col("root"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), "_digest").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _tables(classes: DataFrame, side: int) -> DataFrame:
    """``slot`` (a table and its key) and ``node``, for keys that more than one set can hold."""
    held = classes.select("node", F.posexplode("keys").alias("at", "key"))
    shared = held.groupBy("at", "key").agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
    shared = shared.filter("_low != _high").select("at", "key")
    sides = held.join(shared, ["at", "key"], "left_semi").groupBy("node").agg(
        F.collect_set(F.when(F.col("at") < side, F.struct("at", "key"))).alias("left"),
        F.collect_set(F.when(F.col("at") >= side, F.struct("at", "key"))).alias("right"),
    )
    paired = sides.select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r"))
    slots = paired.select(F.xxhash64("l.at", "l.key", "r.at", "r.key").alias("slot"), "node")
    several = slots.groupBy("slot").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).filter("_low != _high")
    return slots.join(several.select("slot"), "slot", "left_semi")


def _links(docs: DataFrame, tables: DataFrame, classes: DataFrame, repeated: bool, percent: int, rounds: int) -> DataFrame:
    """Confirmed links ``a``, ``b`` that connect all that links connect."""
    wanted = tables.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    missing = classes.filter(F.col("node") >= F.lit(_SUBSTITUTE))
    if not missing.isEmpty():  # texts of rows without an id are found again by their set
        texts = _with_substitutes(docs, texts)
    texts = texts.join(wanted, "node", "left_semi")
    if repeated:  # rows with one id and text would otherwise multiply the pairs
        texts = texts.dropDuplicates(["node", "text"])
    sets = texts.mapInPandas(_sets, "node long, shingles array<long>")
    sets = pin(sets, "sets")

    links = None
    state = None
    for turn in range(rounds):
        pairs = _pivot_pairs(tables, state, turn)
        found = pin(confirmed(pairs, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        state = components(links)
    rest = _rare_pairs(tables, state, sets, percent)
    return links.unionByName(pin(confirmed(rest, sets, percent), "links"))


def _with_substitutes(docs: DataFrame, texts: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_chunks(frames, "text"):
            with np.errstate(over="ignore"):
                nodes = [((_digest(shingle_set(t), 1) & ((1 << 64) - 1)) >> 2) + _SUBSTITUTE for t in frame["text"]]
            yield pd.DataFrame({"node": nodes, "text": frame["text"].to_numpy()}).astype({"node": "int64"})

    nameless = docs.filter("doc_id IS NULL").select(F.col("text").cast("string").alias("text"))
    return texts.filter("node IS NOT NULL").unionByName(nameless.mapInPandas(run, "node long, text string"))


def _spanning(tables: DataFrame, state: DataFrame | None) -> DataFrame:
    """The rows of tables whose members are in several components, with ``root``."""
    if state is None:
        return tables.withColumn("root", F.col("node"))
    rows = tables.join(state, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rows.groupBy("slot").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low != _high")
    return rows.join(apart.select("slot"), "slot", "left_semi")


def _pivot_pairs(tables: DataFrame, state: DataFrame | None, turn: int) -> DataFrame:
    """For each node the pivot that it shares most tables with, of another component.

    In the first turn a table's pivot is its smallest node, later the first by a
    hash that changes with the turn.
    """
    rows = pin(_spanning(tables, state), "spanning")
    order = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")
    pivots = rows.groupBy("slot").agg(F.min(F.struct(order.alias("o"), "node", "root")).alias("p"))
    met = rows.join(pivots, "slot").filter(F.col("root") != F.col("p.root"))
    counted = met.groupBy(F.col("node").alias("a"), F.col("p.node").alias("b")).agg(F.count("*").alias("n"))
    best = counted.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m"))
    return best.select("a", (-F.col("m.b")).alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets reach ``percent`` of their union."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_one"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_two"))
    second = second.join(pairs.select("b").distinct(), "b", "left_semi")
    n, m = F.size("_one").cast("long"), F.size("_two").cast("long")
    sized = pairs.join(first, "a").join(second, "b")
    sized = sized.filter((100 * n >= percent * m) & (100 * m >= percent * n))
    same = F.size(F.array_intersect("_one", "_two")).cast("long")
    return sized.filter(100 * same >= percent * (n + m - same)).select("a", "b")


def _rare_pairs(tables: DataFrame, state: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components, among nodes of tables that still span several, that can be similar.

    A set of n shingles shares at least ``ceil(percent * n / 100)`` of them with a
    similar set, so of its ``n - that + 1`` rarest ones at least one is shared, and
    that one is also among the rarest of the other set, as both use one order. The
    first shared one has all others behind it in both sets, so their places bound
    the intersection; a shingle whose places leave too few is not that one.
    """
    rest = _spanning(tables, state).select("node", "root").distinct()
    held = pin(sets.join(rest, "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "rest")
    often = held.groupBy("shingle").agg(F.count("*").alias("df"))
    often = often.filter("df > 1")
    ranked = held.join(often, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    by_rarity = W.partitionBy("node", "n").orderBy("df", "shingle")
    needed = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    prefix = ranked.withColumn("_at", F.row_number().over(by_rarity)).filter((F.col("_at") <= needed) & (F.col("df") > 1))
    prefix = pin(prefix.select("shingle", "node", "root", "n", F.col("_at").alias("at")), "prefix")
    apart = prefix.groupBy("shingle").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low != _high")
    prefix = prefix.join(apart.select("shingle"), "shingle", "left_semi")
    other = prefix.select("shingle", F.col("node").alias("b"), F.col("root").alias("_root"), F.col("n").alias("_n"), F.col("at").alias("_at"))
    fits = (F.col("node") < F.col("b")) & (F.col("root") != F.col("_root"))
    fits &= (100 * F.col("n") >= percent * F.col("_n")) & (100 * F.col("_n") >= percent * F.col("n"))
    most = 1 + F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    fits &= (100 + percent) * most >= percent * (F.col("n") + F.col("_n"))
    return prefix.join(other, "shingle").filter(fits).select(F.col("node").alias("a"), "b").distinct()
