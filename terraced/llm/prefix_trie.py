"""Conversation prefix trie by collapsing whole sequences.

Conversations are rebuilt with a shared head, numbered turn by turn, and every prefix
gets a 128-bit digest: the exclusive or of hashes of (depth, role and text), so digests
of prefixes are running sums and equal prefixes have equal digests at equal depth.
Identical conversations then collapse to one sequence with its weight, its smallest
member and the list of its members. A sequence that is a proper prefix of another one is
found by an anti-join with all proper prefixes; the others are the leaves. Nodes are
the prefixes of the collapsed sequences, aggregated with the weights.

``saved_tokens`` of a node x sums ``(n_convs - 1) * words`` over its subtree. Its first
half, ``n_convs * words``, is the words that the members of x have from x on: weights
times the sequences' words, less those before x. Its second half, every node's words
once, gives each node to the leaf with the smallest member in its subtree: a leaf owns
the end of its path from some place on, so leaf l adds its words from x or from that
place on, whichever is later. Both are one aggregate over prefixes; no path is expanded
into pairs of nodes.

A conversation may hold any share of the rows: turns are numbered over ranges of
(conversation, turn), running sums are taken in stretches of ``STRETCH`` turns and moved
by the stretches before, and joins by conversation or parent are plain joins that
adaptive execution splits. Member lists are never collected: ids are sorted over ranges,
written out there as pieces of text, and the pieces of a list are streamed through the
hash in order.

Defined results: turns with equal ``turn`` (null first) go by the MD5 of their role and
text; repeated rows are repeated turns. Null role or text is empty. Rows without a
``conv_id`` belong to no conversation. The remainder of a negative id is negative, as in
SQL. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraced.llm.common import crc_of_id, pin, word_count
from terraced.operators.ranking import number_rows
from terraced.session import scanned_bytes, width_for

GROUP = 20
HEADS = 4
STRETCH = 256
PIECE = 8192
_EMPTY = hashlib.sha256(b"").hexdigest()

Batches = Iterator[pa.RecordBatch]


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (1, 2, ...), ``d1``, ``d2`` (digest of role and text), ``words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    read = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("md5"), word_count(text).alias("words")).alias("key")
    )
    numbered = number_rows(read, "conv_id", "key", "at")
    return numbered.select("conv_id", "at", _long("key.md5", 1).alias("d1"), _long("key.md5", 16).alias("d2"), F.col("key.words").alias("words"))


def _long(hex_text: str, start: int) -> Column:
    return F.conv(F.substring(hex_text, start, 15), 16, 10).cast("long")


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """All conversations as ``conv_id``, and their rebuilt turns ``conv_id``, ``depth``, ``x1``, ``x2``, ``words``.

    A conversation c gets the first h turns of c - c % group, then its own after its
    first h; h is the unsigned crc32 of c in decimal, modulo ``heads``.
    """
    turns = pin(_turns(conversations), "trie-turns")
    ids = turns.groupBy("conv_id").agg(F.lit(1)).select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("_base"))
    ids = ids.withColumn("_h", crc_of_id(F.col("conv_id")) % heads)
    first = turns.filter(F.col("at") < heads).groupBy(F.col("conv_id").alias("_base")).agg(
        F.array_sort(F.collect_list(F.struct("at", "d1", "d2", "words"))).alias("_first")  # heads - 1 turns at most
    )
    head = F.slice(F.coalesce("_first", F.array().cast(first.schema["_first"].dataType)), 1, F.col("_h").cast("int"))
    ids = pin(ids.join(first, "_base", "left").select("conv_id", "_h", head.alias("_head")), "trie-ids")
    shared = ids.select("conv_id", F.explode("_head").alias("t")).select("conv_id", F.col("t.at").alias("depth"), "t.d1", "t.d2", "t.words")
    own = turns.join(ids.select("conv_id", "_h", F.size("_head").alias("_n")), "conv_id").filter(F.col("at") > F.col("_h"))
    own = own.select("conv_id", (F.col("at") - F.col("_h") + F.col("_n")).alias("depth"), "d1", "d2", "words")
    rows = shared.unionByName(own)
    hashed = [F.xxhash64(F.lit(seed), "depth", "d1", "d2").alias(name) for seed, name in ((1, "x1"), (2, "x2"))]
    return ids.select("conv_id"), rows.select("conv_id", F.col("depth").cast("long").alias("depth"), *hashed, "words")


def _prefixes(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``rows`` with ``p1``, ``p2`` (digest of the prefix) and ``before`` (words of the turns before)."""
    cut = pin(rows.withColumn("_part", F.floor(F.col("depth") / stretch)), "trie-rows")
    within = W.partitionBy("conv_id", "_part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inner = cut.select(
        "*", F.bit_xor("x1").over(within).alias("_y1"), F.bit_xor("x2").over(within).alias("_y2"), (F.sum("words").over(within) - F.col("words")).alias("_w")
    )
    parts = cut.groupBy("conv_id", "_part").agg(F.bit_xor("x1").alias("z1"), F.bit_xor("x2").alias("z2"), F.sum("words").alias("w"))
    earlier = W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    moves = parts.select("conv_id", "_part", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias("_" + c) for f, c in ((F.bit_xor, "z1"), (F.bit_xor, "z2"))], F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("_v"))
    moved = inner.join(moves, ["conv_id", "_part"])
    return moved.select(
        "conv_id",
        "depth",
        F.col("_y1").bitwiseXOR(F.col("_z1")).alias("p1"),
        F.col("_y2").bitwiseXOR(F.col("_z2")).alias("p2"),
        F.col("_y1").bitwiseXOR(F.col("_z1")).bitwiseXOR(F.col("x1")).alias("q1"),
        F.col("_y2").bitwiseXOR(F.col("_z2")).bitwiseXOR(F.col("x2")).alias("q2"),
        (F.col("_w") + F.col("_v")).alias("before"),
    )


def _runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Starts and ends of runs of equal keys."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(new)]))


def _written(piece: int) -> Callable[[Batches], Batches]:
    """Sorted ids as pieces of comma-joined text, each of one list."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            s1, s2, ids = (batch.column(c).to_numpy() for c in ("s1", "s2", "conv_id"))
            cut = [(a, min(a + piece, end)) for start, end in _runs([s1, s2]) for a in range(start, end, piece)]
            at = np.array([a for a, _ in cut], dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "s1": pa.array(s1[at]),
                    "s2": pa.array(s2[at]),
                    "least": pa.array(ids[at]),
                    "ids": pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in cut], pa.string()),
                }
            )

    return run


def _streamed(batches: Batches) -> Batches:
    """The hash of each list from its pieces in order."""
    open_key, state = None, None

    def told(key: tuple, done: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"s1": pa.array([key[0]], pa.int64()), "s2": pa.array([key[1]], pa.int64()), "ends_sha256": [done.hexdigest()]})

    for batch in batches:
        rows = []
        for s1, s2, ids in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "ids"))):
            if (s1, s2) != open_key:
                if open_key is not None:
                    rows.append(told(open_key, state))
                open_key, state = (s1, s2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    if open_key is not None:
        yield told(open_key, state)


def list_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``s1``, ``s2``, ``ends_sha256``: SHA-256 of the ids of each list, ascending and comma-joined."""
    tasks = width_for(ends.sparkSession, scanned_bytes(ends))
    order = ["s1", "s2", "conv_id"]
    sorted_ids = ends.select(*order).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    pieces = sorted_ids.mapInArrow(_written(piece), "s1 long, s2 long, least long, ids string")
    dealt = pieces.repartition(tasks, "s1", "s2").sortWithinPartitions("s1", "s2", "least").select("s1", "s2", "ids")
    return dealt.mapInArrow(_streamed, "s1 long, s2 long, ends_sha256 string")


def trie(conversations: DataFrame, *, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` of every node."""
    ids, rows = rebuilt(conversations, group, heads)
    prefixes = pin(_prefixes(rows), "trie-prefixes")
    rows = rows.groupBy("conv_id").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.count("*").alias("depth"), F.sum("words").alias("words"))
    ends = ids.join(rows, "conv_id", "left").na.fill(0)
    ends = pin(ends, "trie-ends")

    # Whole-sequence collapse: one sequence per digest, with its weight and smallest member.
    sequences = ends.groupBy("s1", "s2").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("length"), F.first("words").alias("total"))
    sequences = pin(sequences, "trie-sequences")
    root = [F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2")] + [F.lit(None).cast("long").alias(c) for c in ("q1", "q2")] + [F.lit(0).cast("long").alias("before")]
    held = sequences.select("conv_id", "weight", "length", "total")
    held = held.join(prefixes, "conv_id").unionByName(held.select("*", *root))
    held = pin(held, "trie-held")
    proper = held.filter("depth < length").select(F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    leaves = pin(sequences.join(proper, ["s1", "s2"], "left_anti").select("conv_id", F.lit(1).alias("_leaf")), "trie-leaves")

    key = ["depth", "p1", "p2"]
    marked = pin(held.join(leaves, "conv_id", "left"), "trie-marked")
    nodes = marked.groupBy(*key).agg(
        F.max("q1").alias("q1"),
        F.max("q2").alias("q2"),
        F.max("before").alias("before"),
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.col("weight") * F.col("total")).alias("_words"),
        F.count("_leaf").alias("n_leaves"),
        F.min(F.when(F.col("_leaf").isNotNull(), F.col("conv_id"))).alias("_owner"),
    )
    nodes = pin(nodes, "trie-nodes")
    owned = nodes.groupBy(F.col("_owner").alias("conv_id")).agg(F.min("before").alias("_from"))
    once = marked.filter("_leaf IS NOT NULL").join(owned, "conv_id").groupBy(*key).agg(
        F.sum(F.col("total") - F.greatest("before", "_from")).alias("_once")
    )
    up = nodes.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    children = up.filter("depth >= 0").groupBy(*key).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("_depth"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), F.col("conv_id").alias("parent_conv_id"))
    ended = list_hashes(ends).select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), "ends_sha256")
    above = (F.col("depth") == F.col("_depth")) & (F.col("q1") == F.col("_p1")) & (F.col("q2") == F.col("_p2"))
    found = nodes.join(once, key).join(children, key, "left").join(ended, ["p1", "p2"], "left").join(parents, above, "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("_words") - F.col("n_convs") * F.col("before") - F.col("_once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
