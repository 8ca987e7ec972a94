"""Licence scan: diagonal voting of word k-grams against licence notices, and fixed phrases.

Every k-gram of words of every text is hashed and joined with the k-grams of the
notices. A match at word ``i`` of a text and ``j`` of a notice votes for the diagonal
``i - j``; the votes of a diagonal and of its neighbours up to ``REACH`` away are added,
as an inserted or lost word moves what follows to a near diagonal. In each stretch of
``REACH`` diagonals the strongest one is a candidate if its votes reach ``SHARE`` of the
notice's k-grams. The words around it are then compared with the notice: it stands
there if the longest common subsequence holds the whole notice (up to ``WHOLE``
words) or at least ``ALIKE`` of it. Of overlapping places those that another one beats
in similarity, or in words at equal similarity, are dropped.

The k-grams of the notices are stored, so the planner knows their size and decides how
to join. Equal texts give equal votes: votes are keyed by a 128-bit hash of the text and
made distinct before they are counted, so a group of copies is checked once. What is
grouped by text is in proportion to one text.

Defined results: a null text is empty. A row is judged by its text alone, so repeated
rows and ids get equal results and stay repeated. Words are found in whole texts of any
length. Overlapping phrases all count. An empty table gives no rows; other columns are
ignored. ``score`` is the largest similarity of a place found, 0.5 where only a phrase
stands, else 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraced.llm.common import _BASE, _BASE_INVERSE, _BYTE, _power, mix64, pin
from terraced.llm.licence_texts import NOTICES

#: Fixed phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
GRAM = 4
REACH = 16
SHARE = 0.25
ALIKE = 0.8
WHOLE = 12

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_CAPITALS = {c: c + 32 for c in range(65, 91)}

Batches = Iterator[pa.RecordBatch]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_CAPITALS))


class Words:
    """The words of all texts of an Arrow column: hash, bytes and row of each."""

    def __init__(self, texts: pa.Array):
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        borders = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        self.raw = _LOWER[np.frombuffer(data, dtype=np.uint8)[borders[0] : borders[-1]]] if data else np.zeros(0, np.uint8)
        borders = borders - borders[0]
        inside = _INSIDE[self.raw]
        new_text = np.zeros(len(inside) + 1, dtype=bool)
        new_text[borders] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | new_text[1:-1]
        ends[:-1] &= ~inside[1:] | new_text[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, borders)  # each text's first word, and the end
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = self._hashed()

    def _hashed(self, each: int = 100_000) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        for at in range(0, len(out), each):
            starts, ends = self.starts[at : at + each], self.ends[at : at + each]
            base, n = starts[0], ends[-1] - starts[0]
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.raw[base : base + n]] * _power(_BASE, "up", n), out=total[1:])
            sums = (total[ends - base] - total[starts - base]) * _power(_BASE_INVERSE, "down", n)[starts - base]
            out[at : at + each] = mix64(sums + (ends - starts).astype(np.uint64))
        return out

    def word(self, at: int) -> bytes:
        return self.raw[self.starts[at] : self.ends[at]].tobytes()

    def places(self, phrase: list[bytes], hashed: np.ndarray) -> np.ndarray:
        """Words at which the phrase starts, within one text."""
        n = len(phrase)
        if len(self.hashes) < n:
            return np.zeros(0, dtype=np.int64)
        found = np.flatnonzero(self.hashes[: len(self.hashes) - n + 1] == hashed[0])
        for step in range(1, n):
            found = found[(self.hashes[found + step] == hashed[step]) & (self.row[found + step] == self.row[found])]
        return np.array([p for p in found.tolist() if all(self.word(p + s) == w for s, w in enumerate(phrase))], dtype=np.int64)

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all runs of ``width`` words of one text, and the runs' hashes."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        rolled = np.zeros(n, dtype=np.uint64)
        for step in range(width):
            rolled = rolled * np.uint64(0xD1342543DE82EF95) + self.hashes[step : step + n]
            rolled ^= rolled >> np.uint64(29)
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return at, mix64(rolled[at])


def _hashed_words(text: str) -> Words:
    with np.errstate(over="ignore"):
        return Words(pa.array([text], pa.string()))


def _parts(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text, or one longer text."""
    start = held = 0
    for at, n in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
        if held and held + (n or 0) > size:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def _base(phrases: tuple) -> Callable[[Batches], Batches]:
    wanted = [([w.encode() for w in words_of(p)], _hashed_words(p).hashes, label) for p, label in phrases]

    def run(batches: Batches) -> Batches:
        with np.errstate(over="ignore"):
            for batch in (part for b in batches for part in _parts(b)):
                words, n = Words(batch.column("text")), batch.num_rows
                count = np.zeros(n, dtype=np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for phrase, hashed, label in wanted:
                    places = words.places(phrase, hashed)
                    rows = words.row[places]
                    np.add.at(count, rows, 1)
                    np.minimum.at(first, rows, places - words.first[rows])
                    np.maximum.at(last, rows, places - words.first[rows])
                    for row in set(rows.tolist()):
                        labels[row].add(label)
                none = count == 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "k1": batch.column("k1"),
                        "k2": batch.column("k2"),
                        "doc_id": batch.column("doc_id"),
                        "n_words": pa.array(np.diff(words.first), pa.int64()),
                        "n_base": pa.array(count),
                        "first_word": pa.array(first, mask=none),
                        "last_word": pa.array(last, mask=none),
                        "base": pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    }
                )

    return run


def _grams(width: int, each: int = 100_000) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        with np.errstate(over="ignore"):
            for batch in (part for b in batches for part in _parts(b)):
                words = Words(batch.column("text"))
                at, grams = words.grams(width)
                k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
                for start in range(0, len(at), each):
                    some = at[start : start + each]
                    row = words.row[some]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "k1": pa.array(k1[row]),
                            "k2": pa.array(k2[row]),
                            "place": pa.array(some - words.first[row]),
                            "gram": pa.array(grams[start : start + each].astype(np.int64)),
                        }
                    )

    return run


def _template_grams(spark: SparkSession, notices: tuple, width: int) -> DataFrame:
    rows = []
    for number, (_, text) in enumerate(notices):
        with np.errstate(over="ignore"):
            at, grams = _hashed_words(text).grams(width)
        rows += [(number, place, gram, len(at)) for place, gram in zip(at.tolist(), grams.astype(np.int64).tolist())]
    return pin(spark.createDataFrame(rows, "notice int, at long, gram long, of int").coalesce(1), "licence-grams")


def common_words(notice: list[str], span: list[str]) -> tuple[int, int]:
    """Length of the longest common subsequence, and the place in ``span`` where it is complete."""
    bits: dict[str, int] = {}
    for at, word in enumerate(notice):
        bits[word] = bits.get(word, 0) | 1 << at
    full = (1 << len(notice)) - 1
    row, best, end = full, 0, 0
    for at, word in enumerate(span):
        hit = row & bits.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
            found = len(notice) - row.bit_count()
            if found > best:
                best, end = found, at + 1
    return best, end


def verified(words: list[str], candidates: list[tuple[int, int]], notices: list[tuple[str, list[str]]]) -> list[tuple[str, int, int, float]]:
    """Places ``(label, start, end, similarity)`` where a candidate's notice stands, best ones of overlapping places."""
    found = set()
    for number, diagonal in candidates:
        label, notice = notices[number]
        low = max(0, diagonal - REACH)
        span = words[low : max(0, diagonal + len(notice) + REACH)]
        same, end = common_words(notice, span)
        if same < (len(notice) if len(notice) <= WHOLE else math.ceil(ALIKE * len(notice))):
            continue
        _, back = common_words(notice[::-1], span[end - 1 :: -1])
        found.add((same / len(notice), same, label, low + end - back, low + end))
    kept = [x for x in found if not any(y[:2] > x[:2] and y[3] < x[4] and x[3] < y[4] for y in found)]
    return sorted({(label, start, end, alike) for alike, _, label, start, end in kept}, key=lambda x: (x[1], x[2], x[0]))


def _verify(notices: tuple) -> Callable[[Batches], Batches]:
    listed = [(label, words_of(text)) for label, text in notices]
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            spans = []
            for text, candidates in zip(batch.column("text"), batch.column("candidates")):
                pairs = [(c["notice"], c["diagonal"]) for c in candidates.as_py()]
                spans.append([dict(zip(("label", "start", "end", "similarity"), x)) for x in verified(words_of(text.as_py()), pairs, listed)])
            yield pa.RecordBatch.from_pydict({"k1": batch.column("k1"), "k2": batch.column("k2"), "spans": pa.array(spans, pa.list_(place))})

    return run


def candidates_of(votes: DataFrame, share: float = SHARE) -> DataFrame:
    """The strongest diagonal of each stretch, from ``k1``, ``k2``, ``notice``, ``of``, ``diagonal``, ``votes``."""
    near = W.partitionBy("k1", "k2", "notice").orderBy("diagonal").rangeBetween(-REACH, REACH)
    merged = votes.withColumn("merged", F.sum("votes").over(near)).filter(F.col("merged") >= F.ceil(F.lit(share) * F.col("of")))
    stretch = F.floor(F.col("diagonal") / REACH)
    best = merged.groupBy("k1", "k2", "notice", stretch.alias("_stretch")).agg(F.max(F.struct("merged", "votes", (-F.col("diagonal")).alias("d"))).alias("m"))
    return best.select("k1", "k2", F.struct("notice", (-F.col("m.d")).alias("diagonal")).alias("c"))


def scan(docs: DataFrame, *, phrases: tuple = PHRASES, notices: tuple = NOTICES, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``spans`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    base = keyed.mapInArrow(
        _base(phrases), "k1 long, k2 long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>"
    )
    grams = keyed.select("k1", "k2", "text").mapInArrow(_grams(gram), "k1 long, k2 long, place long, gram long")
    matched = grams.join(_template_grams(docs.sparkSession, notices, gram), "gram")
    matched = matched.select("k1", "k2", "notice", "of", "place", "at").distinct()  # equal texts vote once
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    votes = matched.groupBy("k1", "k2", "notice", "of", diagonal).agg(F.count("*").alias("votes"))
    found = pin(candidates_of(votes).groupBy("k1", "k2").agg(F.collect_list("c").alias("candidates")), "licence-candidates")

    texts = keyed.select("k1", "k2", "text").join(found.select("k1", "k2"), ["k1", "k2"], "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(found, ["k1", "k2"])
    spans = pin(
        texts.select("k1", "k2", "text", "candidates").mapInArrow(
            _verify(notices), "k1 long, k2 long, spans array<struct<label:string,start:long,end:long,similarity:double>>"
        ),
        "licence-spans",
    )
    all_spans = F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform(all_spans, lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform(all_spans, lambda s: s["similarity"])), F.lit(0.0))
    return base.join(spans, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        all_spans.alias("spans"),
    )
