"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors are projected on ``projections`` random directions. Two vectors collide
on a direction when one lies in the window of half width ``half`` centred at the
other. Vectors whose cosine is the threshold differ by a normal number of known
spread on each direction, so the number of collisions among all directions is
binomial; a pair is verified when it reaches the count that such pairs miss with a
chance of at most ``1 - recall``. Closer pairs collide more often.

Candidates come from strip hashing, which replaces windows of sorted projections:
nothing is sorted. Each direction is cut into strips of one width, and vectors in equal strips on ``depth`` directions share a cell. ``tables``
such groups of directions with shifted strips are used, so that a pair at the
threshold shares a cell in one of them with a chance of ``recall``. Collisions are
counted, and counts that pass are verified by the exact cosine in double precision,
for the pairs that share a cell, each in the first table where it does. A pair at the
threshold passes both filters with a chance of about ``recall`` squared, 0.98. Cells keep
the pairs looked at to a small part of all pairs, a part that falls with ``depth``.

Skew. Equal vectors of one label are one vector with a count. A cell above ``block``
vectors is cut into blocks by a hash, and every pair of blocks is a task of its own.
Sums and a spanning forest of links leave a task, never lists of pairs.

Defined results. Vectors that are null, of length 0, all zero, or that hold null or
non-finite numbers, and vectors with a null label, link with nothing. Vectors of
different lengths do not link. Rows with one vec_id are one vector for components and
several for counts. Null ids take no part. Repeated rows stay rows. Further columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import pin
from terraced.llm.components import components

COSINE = 0.93
DEPTH = 6
STRIP = 1.3
TABLES = 20
PROJECTIONS = 64
HALF = 0.45
RECALL = 0.99
BLOCK = 400


def needed_collisions(projections: int, half: float, cosine: float, recall: float) -> int:
    """The largest count that pairs at the threshold reach with a chance of at least ``recall``."""
    spread = math.sqrt(2 - 2 * cosine)
    p = math.erf(half / spread / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
    return projections


def _directions(length: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, count))


def _unit(vectors: pd.Series) -> np.ndarray:
    made = np.stack(vectors.to_numpy()).astype(np.float64)
    made /= np.abs(made).max(axis=1, keepdims=True)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def _celled(tables: int, depth: int, strip: float):
    """``node``, ``n`` and vectors to one row per table: cell hash and, for the first-table rule, all cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, part in frame.groupby(frame["vector"].map(len)):
                vectors = _unit(part["vector"])
                shift = np.random.default_rng([5, length]).random(tables * depth)
                strips = np.floor(vectors @ _directions(length, tables * depth, 1) / strip + shift).astype(np.int64)
                weights = np.random.default_rng([7, length]).integers(1 << 62, size=tables * depth) | 1
                with np.errstate(over="ignore"):
                    cells = (strips * weights).reshape(len(part), tables, depth).sum(axis=2)
                yield pd.DataFrame(
                    {"node": part["node"].to_numpy(), "label": part["label"].to_numpy(), "n": part["n"].to_numpy(), "vector": part["vector"].to_numpy(), "cells": list(cells)}
                )

    return run


def _linked(projections: int, half: float, cosine: float, recall: float):
    least = needed_collisions(projections, half, cosine, recall)

    def compare(part: pd.DataFrame, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked pairs in a cell, or between its two blocks."""
        vectors, cells = _unit(part["vector"]), np.stack(part["cells"].to_numpy())
        table = int(part["table"].iloc[0])
        cross = bool(part["first"].iloc[0] != part["second"].iloc[0])
        one, two = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if cross else (np.arange(len(part)),) * 2
        if cross:
            i, j = np.repeat(one, len(two)), np.tile(two, len(one))
        else:
            i, j = np.triu_indices(len(part), 1)
        if table:
            fresh = ~(cells[i, :table] == cells[j, :table]).any(axis=1)
            i, j = i[fresh], j[fresh]
        made = (vectors @ _directions(vectors.shape[1], projections, 2)).astype(np.float32)
        passed = np.zeros(len(i), dtype=bool)
        for start in range(0, len(i), 20_000):
            at = slice(start, start + 20_000)
            passed[at] = (np.abs(made[i[at]] - made[j[at]]) <= half).sum(axis=1) >= least
        i, j = i[passed], j[passed]
        exact = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= cosine
        return i[exact], j[exact]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            marks = frame["task"].to_numpy()
            last = np.flatnonzero(marks != marks[-1])
            cut = last[-1] + 1 if len(last) else 0
            rest = frame.iloc[cut:]
            yield from each(frame.iloc[:cut])
        if rest is not None:
            yield from each(rest)

    def each(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        for _, part in frame.groupby("task", sort=False):
            if len(part) < 2:
                continue
            lengths = part["vector"].map(len)
            for _, own in part.groupby(lengths) if lengths.nunique() > 1 else [(0, part)]:
                sides = (own["block"] != own["first"]).to_numpy().astype(int)
                i, j = compare(own, sides)
                if len(i):
                    nodes, n = own["node"].to_numpy(), own["n"].to_numpy()
                    sums = np.bincount(i, n[j], len(own)) + np.bincount(j, n[i], len(own))
                    root = _forest(len(own), i, j)
                    at = np.flatnonzero(sums)
                    out.append(pd.DataFrame({"node": nodes[at], "links": sums[at].astype(np.int64), "root": nodes[root[at]]}))
        if out:
            yield pd.concat(out)

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place it is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(
    rows: DataFrame,
    *,
    cosine: float = COSINE,
    tables: int = TABLES,
    depth: int = DEPTH,
    strip: float = STRIP,
    projections: int = PROJECTIONS,
    half: float = HALF,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``rows`` (``vec_id``, ``embedding``, ``label``)."""
    number = rows.schema["embedding"].dataType.elementType.simpleString()
    number = number if number in ("float", "double") else "double"
    vector = F.transform(F.col("embedding"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(number))
    good = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("_v", lambda x: x != 0)
    read = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("_v"))
    usable = F.coalesce(good, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    read = read.select("vec_id", "label", F.when(usable, F.col("_v")).alias("vector"))
    read = pin(read.withColumn("hash", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))), "vectors")

    classes = read.filter("vector IS NOT NULL").groupBy("hash").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    celled = classes.mapInPandas(_celled(tables, depth, strip), f"node long, label string, n long, vector array<{number}>, cells array<long>")
    celled = pin(celled, "celled")

    held = celled.select("node", "label", F.posexplode("cells").alias("table", "cell"))
    key = F.xxhash64("label", "table", "cell")
    held = held.select("node", "table", key.alias("key"))
    sizes = held.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    placed = held.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("_other", other).select(
        "node", "table", "block", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"), "key"
    )
    placed = placed.withColumn("task", F.xxhash64("key", "first", "second"))
    full = placed.join(celled.select("node", "n", "vector", "cells"), "node")
    full = full.repartition("task").sortWithinPartitions("task")
    found = pin(full.mapInPandas(_linked(projections, half, cosine, recall), "node long, links long, root long"), "found")

    sums = found.groupBy("node").agg(F.sum("links").alias("_links"))
    copies = read.filter("vector IS NOT NULL").join(classes.select("hash", "node", "n"), "hash").select("vec_id", "node")
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(edges.unionByName(copies.select(F.col("vec_id").alias("a"), F.col("node").alias("b"))))
    node = read.join(classes.select("hash", "node", "n"), "hash", "left").join(sums, "node", "left")
    node = node.join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
    links = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("_links", F.lit(0))
    component = F.coalesce("root", "vec_id")
    return node.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
