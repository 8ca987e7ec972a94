"""Vector code compression: product codes by Lloyd rounds over two trees.

Vectors become integers ``floor(4096 * x)`` and are cut into equal consecutive parts;
each part position has a codebook. Rows are stored once in blocks. Every block holds,
for each part position, a balanced tree over its parts: per node a bounding box, the
count and the integer sums of its parts. The entries of a codebook make a small tree of
their own. A round walks both trees together, level by level:

* a pair of nodes whose smallest distance is above the largest distance to another
  entry node is dropped with all its entries;
* against single entries, the half-space between two of them decides whole boxes;
* a node left with one entry is assigned whole, by its cached count and sums;
* parts in leaves that stay undecided are compared in exact integers with the entries
  left, ties to the lower index.

All bounds are integers and drop an entry only if it is strictly farther, so codes,
sums and errors equal those of plain Lloyd rounds, whatever the blocks are.

Only sums per position, entry and component reach the driver, in limbs of 30 bits, so
no sum overflows. A lost task is repeated from the stored blocks. No row is keyed, so no
key is hot; the labels' sums are partial.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped. A vector shorter than the longest kept one is read as if zeros followed, up to
the next multiple of the number of parts. Repeated rows and ids count as often as they
stand; the first entries go by id (null last), then by components. With fewer rows than
entries there are as many entries as rows. Errors beyond a long are null, and so is the
label error they would enter. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import pin

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LEAF = 32
#: Components in one block: 4,096 rows of 64 components.
BLOCK_COMPONENTS = 1 << 18
_LIMB = 30
_EXACT = 1 << 62

Batches = Iterator[pa.RecordBatch]


def _integers(values: np.ndarray) -> np.ndarray:
    """``floor(4096 * x)`` of finite numbers, as int64 or, beyond its safe range, as Python integers."""
    if not values.size or np.abs(values).max() < 1 << 30:
        return np.floor(values * SCALE).astype(np.int64)
    exact = [math.floor(x * SCALE) if abs(x) < 1 << 40 else SCALE * int(x) if x == int(x) else math.floor(SCALE * x) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _kept_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the kept rows of a batch, all components, and where each row's start and end."""
    vectors = batch.column("vector")
    starts, ends = (x.astype(np.int64) for x in (vectors.offsets.to_numpy()[:-1], vectors.offsets.to_numpy()[1:]))
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    keep = (bad[ends] == bad[starts]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(keep), values, starts, ends


def _first_rows(entries: int) -> Callable[[Batches], Batches]:
    """Per task the rows with the smallest ids, and the longest vector."""

    def run(batches: Batches) -> Batches:
        best: list[tuple] = []
        widest = None
        for batch in batches:
            rows, values, starts, ends = _kept_rows(batch)
            if not len(rows):
                continue
            ids = batch.column("vec_id")
            wide = int((ends - starts)[rows].max())
            widest = wide if widest is None else max(widest, wide)
            known = np.array([math.inf if ids[i].as_py() is None else float(ids[i].as_py()) for i in rows.tolist()])
            near = rows[known <= np.partition(known, min(entries, len(known)) - 1)[min(entries, len(known)) - 1]]
            found = [(ids[i].as_py(), values[starts[i] : ends[i]].tolist()) for i in near.tolist()]
            best = sorted(best + found, key=_by_id)[:entries]
        if widest is not None:
            yield pa.RecordBatch.from_pydict(
                {"vec_id": pa.array([i for i, _ in best], pa.int64()), "vector": pa.array([v for _, v in best], pa.list_(pa.float64())), "widest": pa.array([widest] * len(best), pa.int32())}
            )

    return run


def _by_id(row: tuple) -> tuple:
    return (row[0] is None, row[0] or 0, row[1])


def _padded(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The rows cut out of ``values`` as a matrix, zeros at the end."""
    lengths = ends - starts
    if len(lengths) and (lengths == width).all() and (starts[1:] == ends[:-1]).all():
        return values[starts[0] : ends[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    for at, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        out[at, : end - start] = values[start:end]
    return out


def _levels(n: int, leaf: int) -> list[np.ndarray]:
    """Borders of the nodes on every level of a balanced tree over ``n`` rows."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        borders = levels[-1]
        halves = np.empty(2 * len(borders) - 1, dtype=np.int64)
        halves[::2], halves[1::2] = borders, (borders[:-1] + borders[1:]) // 2
        levels.append(halves)
    return levels


def _tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple]]:
    """The order of the rows, and per level the borders, boxes and sums of the nodes."""
    order = np.arange(len(points))
    levels = _levels(len(points), leaf)
    for borders in levels[:-1]:  # sort every node along its widest side; its halves are the next level
        starts = borders[:-1]
        now = points[order]
        widest = (np.maximum.reduceat(now, starts) - np.minimum.reduceat(now, starts)).argmax(axis=1)
        node = np.repeat(np.arange(len(starts)), np.diff(borders))
        order = order[np.lexsort((now[np.arange(len(now)), widest[node]], node))]
    now = points[order]
    made = []
    for borders in levels:
        starts = borders[:-1]
        made.append((borders, np.minimum.reduceat(now, starts), np.maximum.reduceat(now, starts), np.add.reduceat(now, starts)))
    return order, made


def _blocks(width: int, parts: int, leaf: int) -> Callable[[Batches], Batches]:
    rows_each = max(leaf, BLOCK_COMPONENTS // max(1, width))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows, values, starts, ends = _kept_rows(batch)
            for first in range(0, len(rows), rows_each):
                some = rows[first : first + rows_each]
                points = _integers(_padded(values, starts[some], ends[some], width))
                cut = points.reshape(len(some), parts, width // parts)
                # Numbers beyond int64 make one leaf: everything is then compared exactly.
                size = leaf if points.dtype != object else len(some)
                trees = [_tree(cut[:, at], size) for at in range(parts)] if width else []
                taken = pa.array(some)
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.array([batch.column("vec_id").take(taken).to_pylist()], pa.list_(pa.int64())),
                        "labels": pa.array([batch.column("label").take(taken).to_pylist()], pa.list_(pa.string())),
                        "body": pa.array([pickle.dumps((cut, trees), protocol=5)], pa.binary()),
                    }
                )

    return run


def _entry_tree(entries: np.ndarray) -> list[np.ndarray]:
    """Per level which entries each node holds; single entries at the end."""
    groups = [np.arange(len(entries))]
    levels = []
    while True:
        levels.append(np.array([np.isin(np.arange(len(entries)), g) for g in groups]))
        if max(len(g) for g in groups) <= 1:
            return levels
        halves = []
        for g in groups:
            if len(g) == 1:
                halves.append(g)
                continue
            held = entries[g]
            widest = int((held.max(axis=0) - held.min(axis=0)).argmax())
            g = g[np.argsort(held[:, widest], kind="stable")]
            halves += [g[: len(g) // 2], g[len(g) // 2 :]]
        groups = halves


def _pruned(low: np.ndarray, high: np.ndarray, left: np.ndarray, entries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """``left`` (part nodes x entries) without the entries of nodes that another one beats for whole boxes."""
    e_low = np.array([entries[m].min(axis=0) for m in members])
    e_high = np.array([entries[m].max(axis=0) for m in members])
    apart = np.maximum(e_low[None] - high[:, None], low[:, None] - e_high[None])
    nearest = (np.maximum(apart, 0) ** 2).sum(axis=2)
    reach = np.maximum(high[:, None] - e_low[None], e_high[None] - low[:, None])
    farthest = (reach**2).sum(axis=2)
    there = (left[:, None, :] & members[None]).any(axis=2)
    least = np.where(there, farthest, farthest.max() + 1).min(axis=1)
    return left & ((there & (nearest <= least[:, None])) @ members)


def _split_apart(low: np.ndarray, high: np.ndarray, left: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``left`` without the entries that one near the box's middle beats at every point of the box."""
    middle = (low + high)[:, None]
    around = ((middle - 2 * entries[None]) ** 2).sum(axis=2)
    star = np.where(left, around, around.max() + 1).argmin(axis=1)
    toward = entries[None] - entries[star][:, None]
    most = 2 * np.where(toward > 0, high[:, None] * toward, low[:, None] * toward).sum(axis=2)
    squares = (entries**2).sum(axis=1)
    return left & ~(most + squares[star][:, None] - squares[None] < 0)


def _nearest(points: np.ndarray, left: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry left of each point in exact integers, ties to the lower index."""
    row, entry = np.nonzero(left)
    far = ((points[row] - entries[entry]) ** 2).sum(axis=1)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.flatnonzero(far == np.minimum.reduceat(far, starts)[row])
    return entry[best[np.flatnonzero(np.diff(row[best], prepend=-1))]]


def assign(points: np.ndarray, tree: tuple, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry of each part, and the entries' counts and sums, over both trees."""
    order, levels = tree
    size = max((int(abs(x).max()) for x in (points, entries) if x.size), default=0)
    kind = np.int64 if 16 * points.shape[1] * size * size < _EXACT else object
    points, entries = points.astype(kind), entries.astype(kind)
    codes = np.empty(len(points), dtype=np.int64)
    counts = np.zeros(len(entries), dtype=np.int64)
    sums = np.zeros(entries.shape, dtype=kind)
    holders = _entry_tree(entries)
    nodes, left = np.array([0]), np.ones((1, len(entries)), dtype=bool)
    for step in range(max(len(levels), len(holders))):
        level = min(step, len(levels) - 1)
        if level == step and step:
            nodes, left = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(left, 2, axis=0)
        borders, low, high, cached = levels[level]
        box = low[nodes].astype(kind), high[nodes].astype(kind)
        left = _pruned(*box, left, entries, holders[min(step, len(holders) - 1)])
        if step >= len(holders) - 1:
            left = _split_apart(*box, left, entries)
        sure = left.sum(axis=1) == 1
        entry, mine = left[sure].argmax(axis=1), nodes[sure]
        sizes = borders[mine + 1] - borders[mine]
        codes[order[_places(borders[mine], sizes)]] = np.repeat(entry, sizes)
        np.add.at(counts, entry, sizes)
        np.add.at(sums, entry, cached[mine].astype(kind))
        nodes, left = nodes[~sure], left[~sure]
        if not len(nodes):
            return codes, counts, sums
    borders = levels[-1][0]
    sizes = borders[nodes + 1] - borders[nodes]
    at = order[_places(borders[nodes], sizes)]
    entry = codes[at] = _nearest(points[at], np.repeat(left, sizes, axis=0), entries)
    np.add.at(counts, entry, 1)
    np.add.at(sums, entry, points[at])
    return codes, counts, sums


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of several ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _limbs(number: int) -> Iterator[tuple[int, int]]:
    sign, rest, at = (-1 if number < 0 else 1), abs(number), 0
    while rest:
        yield at, sign * (rest & ((1 << _LIMB) - 1))
        rest >>= _LIMB
        at += 1


def _totals(books: list[np.ndarray]) -> Callable[[Batches], Batches]:
    """Per task, the counts and sums of every entry: ``place``, ``limb``, ``amount``."""

    def run(batches: Batches) -> Batches:
        total = [np.zeros((len(b), b.shape[1] + 1), dtype=object) for b in books]
        for batch in batches:
            for body in batch.column("body"):
                cut, trees = pickle.loads(body.as_buffer())
                for at, tree in enumerate(trees):
                    _, counts, sums = assign(cut[:, at], tree, books[at])
                    total[at][:, :-1] += sums.astype(object)
                    total[at][:, -1] += counts
        flat = np.concatenate([t.ravel() for t in total])
        rows = [(place, limb, amount) for place, number in enumerate(flat.tolist()) for limb, amount in _limbs(int(number))]
        places, limbs, amounts = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int64()), "limb": pa.array(limbs, pa.int32()), "amount": pa.array(amounts, pa.int64())})

    return run


def _codes(books: list[np.ndarray]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for ids, labels, body in zip(batch.column("ids"), batch.column("labels"), batch.column("body")):
                cut, trees = pickle.loads(body.as_buffer())
                n = len(ids.values)
                codes, error = np.zeros((n, cut.shape[1]), dtype=np.int64), np.zeros(n, dtype=object)
                for at, tree in enumerate(trees):
                    codes[:, at] = assign(cut[:, at], tree, books[at])[0]
                    apart = cut[:, at].astype(object) - books[at].astype(object)[codes[:, at]] if _wide(cut, books[at]) else cut[:, at] - books[at].astype(np.int64)[codes[:, at]]
                    error += (apart**2).sum(axis=1).astype(object)
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                told = [e if e < 1 << 63 else None for e in map(int, error.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": pa.array(ids.values, pa.int64()), "label": pa.array(labels.values, pa.string()), "code": pa.array(text, pa.string()), "error": pa.array(told, pa.int64())}
                )

    return run


def _wide(cut: np.ndarray, book: np.ndarray) -> bool:
    size = max((int(abs(x).max()) for x in (cut, book) if x.size), default=0)
    return 16 * cut.shape[2] * size * size >= _EXACT


def train(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` Lloyd rounds over stored blocks; unused entries stay."""
    for _ in range(rounds):
        sums = blocks.select("body").mapInArrow(_totals(books), "place long, limb int, amount long")
        found: dict[int, int] = {}
        for place, limb, amount in sums.groupBy("place", "limb").agg(F.sum("amount")).collect():  # entries x components x limbs
            found[place] = found.get(place, 0) + (amount << (_LIMB * limb))
        moved, base = [], 0
        for book in books:
            entries, width = book.shape
            new = book.astype(object)
            for entry in range(entries):
                row = base + entry * (width + 1)
                count = found.get(row + width, 0)
                if count:
                    new[entry] = [found.get(row + at, 0) // count for at in range(width)]
            base += entries * (width + 1)
            moved.append(new)
        books = moved
    return books


def compress(
    vectors: DataFrame, vector: str = "embedding", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, leaf: int = LEAF
) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of every kept row of ``vectors``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("vector"))
    firsts = pin(read.select("vec_id", "vector").mapInArrow(_first_rows(entries), "vec_id long, vector array<double>, widest int"), "code-firsts")
    widest = firsts.agg(F.max("widest")).first()[0] or 0
    seeds = [tuple(r) for r in firsts.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    width = -(-widest // parts) * parts
    first = np.array([v + [0.0] * (width - len(v)) for _, v in seeds], dtype=np.float64).reshape(len(seeds), width)
    cut = _integers(first).astype(object).reshape(len(seeds), parts, width // parts)

    stored = read.mapInArrow(_blocks(width, parts, leaf), "ids array<long>, labels array<string>, body binary")
    blocks = pin(stored, "code-blocks")
    books = train(blocks, [cut[:, at] for at in range(parts)], rounds if width else 0)
    listed = ",".join(str(int(x)) for book in books for x in book.ravel().tolist())
    digest = hashlib.sha256(listed.encode()).hexdigest()

    coded = pin(blocks.mapInArrow(_codes(books), "vec_id long, label string, code string, error long"), "codes")
    summed = coded.groupBy(F.col("label").alias("_of")).agg(
        F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")
    )
    return coded.join(summed, F.col("label").eqNullSafe(F.col("_of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
