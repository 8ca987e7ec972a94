"""Quality rules and n-gram perplexity under a modified Kneser-Ney model of each language.

The model is one of character trigrams (digits folded to one character, white space but
line ends to a space) with no limit on characters, n-grams or languages: what is counted
grows with the corpus. Rows are stored once in blocks of at most ``ROWS_PER_BLOCK``, in a
table bucketed by block. A task counts the distinct n-grams of its block; Spark adds the
blocks up and makes from them, with joins and aggregates, continuation counts of the lower
orders, three discounts for each order and language, and interpolated probabilities.

A document is part of the corpus that judges it, so each occurrence is left out of the
counts when its own probability is taken: one is taken off the n-gram, and off each lower
order whose n-gram occurs in that place alone. Without this, junk would look familiar
because it had been counted itself. Where other rows of the language hold the same text
(as the model reads it), all they counted is taken off as well, from n-grams, totals and
numbers of n-grams of a context, so a document is judged alike however often it is copied.
Lower orders count each n-gram once and the text itself stays, so copies do not touch them;
the three discounts are those of all rows.

Nothing of the model is broadcast and no task holds it whole. Each block gets the n-grams
it counted back with the parts of their probabilities, as sorted arrays, and looks the texts of
a language up in them, many texts at once; their size is bounded by the block. Texts are not
shuffled for it, as they lie by block; equal ones are counted by digest.

A document's perplexity is that of its text in pieces of ``CHUNK`` characters, of which
the middle one counts, so a quoted passage in another language does not decide about a
document. Each language has a lower and an upper border, the median of its documents' log
perplexity minus and plus ``WIDTH`` robust standard deviations (at least ``LEAST``). Equal
values count once there, so a large group of copies does not narrow the band. Documents
beyond a border, or that fail the base rules, are not kept.

Defined results. Null and empty texts have no words and fail the base rules. A null
language is a language of its own. Repeated rows stay rows. Only id, text and lang
are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import in_chunks, pin
from terraced.session import scanned_bytes, scratch_path

ORDER = 3
WIDTH = 4.0
LEAST = 0.1
CHUNK = 200
ROWS_PER_BLOCK = 16_384
BYTES_PER_BLOCK = 16 * 1024 * 1024
BYTES_PER_BUCKET = 32 * 1024 * 1024
MOST_BUCKETS = 100_000  # what Spark allows; a bucket then holds several blocks, one after the other
HELD = 2_000_000  # n-grams a counting task holds before it hands on what it has
COMMON = 127  # characters whose n-grams are found by table: at most 128**3 cells
TABLE_FROM = 100_000  # characters to look up for which a table is worth making
_BORDER = 2
_CHARACTERS = 0x110000
_BITS = 21  # of a character; those of an n-gram fit into 64
_PARTS = ("c", "total", "t1", "t2", "t3", "low", "low_out", "d1", "d2", "d3")


def _fold(points: np.ndarray) -> np.ndarray:
    points = np.where((points >= 48) & (points <= 57), 48, points)
    points = np.where((points == 9) | ((points >= 11) & (points <= 13)), 32, points)
    return np.where((points == 0) | (points == _BORDER), 0xFFFD, points).astype(np.uint32)


_FOLDED = _fold(np.arange(_CHARACTERS, dtype=np.uint32))


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded characters of ``texts`` between borders, which of their n-grams in order count, and how many each text has.

    Those that end in a character or the end of a text count; those that end in the border before a text do not.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    lead = chr(_BORDER) * (ORDER - 1)
    joined = lead.join(["", *(t + chr(_BORDER) for t in texts)])
    points = _FOLDED[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    starts = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1])).astype(np.int64)
    before = (starts[:, None] + np.arange(ORDER - 1)).ravel()
    points[before] = points[starts + ORDER - 1 + sizes] = _BORDER
    counted = np.ones(len(points), dtype=bool)
    counted[before] = False
    return points, counted[ORDER - 1 :], sizes + 1


def _shifted(points: np.ndarray) -> list[np.ndarray]:
    """The first, second and further characters of the n-grams of ``points``."""
    return [points[at : len(points) - ORDER + 1 + at] for at in range(ORDER)]


def _packed(characters: Iterable[np.ndarray]) -> np.ndarray:
    """The n-grams of the given first, second and further characters, each as one number that no other n-gram has."""
    keys = 0
    for each in characters:
        keys = keys << _BITS | each.astype(np.int64)
    return keys


def _unpacked(keys: np.ndarray) -> np.ndarray:
    """The characters of each n-gram of ``keys`` as a row."""
    return ((keys[:, None] >> _BITS * np.arange(ORDER - 1, -1, -1)) & ((1 << _BITS) - 1)).astype(np.uint32)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for frame in in_chunks(frames, "text"):
        for key, part in frame[frame["text"].str.len() > 0].groupby(["block", "of"]):
            points, counted, _ = _laid_out(list(part["text"]))
            keys, n = np.unique(_packed(_shifted(points))[counted], return_counts=True)
            if key in held:
                known, counts = held[key]
                keys, back = np.unique(np.concatenate((known, keys)), return_inverse=True)
                n = np.bincount(back, np.concatenate((counts, n)), len(keys)).astype(np.int64)
            held[key] = keys, n
        if sum(len(entry[0]) for entry in held.values()) > HELD:  # sums are joined later, so parts may leave early
            yield from _handed_on(held)
            held = {}
    yield from _handed_on(held)


def _handed_on(held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    for (block, of), (keys, n) in held.items():
        for at in range(0, len(n), 100_000):
            part = np.ascontiguousarray(_unpacked(keys[at : at + 100_000])).view(f"<U{ORDER}").ravel()
            yield pd.DataFrame({"block": block, "of": of, "gram": part.astype(object), "n": n[at : at + 100_000]})


def probabilities(counts: DataFrame) -> DataFrame:
    """``of``, ``gram`` and what ``left_out`` makes its probability of, from ``of``, ``gram``, ``n``."""
    tables = {ORDER: pin(counts.groupBy("of", "gram").agg(F.sum("n").alias("c")), f"grams-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.expr("substring(gram, 2)").alias("gram")
        tables[order] = pin(tables[order + 1].groupBy("of", suffix).agg(F.count("*").alias("c")), f"grams-{order}")
    lower = None
    for order in range(1, ORDER):
        lower = pin(_interpolated(_parts(tables[order], order, lower)), f"probabilities-{order}")
    return pin(_parts(tables[ORDER], ORDER, lower).select("of", "gram", *_PARTS), f"probabilities-{ORDER}")


def _parts(table: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """Count, sums of the context, discounts and lower probabilities of each n-gram of an order."""

    def times(k: int) -> Column:
        return F.count(F.when(F.col("c") == k, 1))

    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    raw = {
        "d1": 1 - 2 * y * F.col("n2") / F.col("n1"),
        "d2": 2 - 3 * y * F.col("n3") / F.col("n2"),
        "d3": F.when(F.col("n3") > 0, 3 - 4 * y * F.col("n4") / F.col("n3")).otherwise(2 - 3 * y * F.col("n3") / F.col("n2")),
    }
    seen = table.groupBy("of").agg(*[times(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    some = (F.col("n1") > 0) & (F.col("n2") > 0)
    cuts = [
        F.when(some, F.greatest(F.lit(0.05), F.least(F.lit(most), raw[name]))).otherwise(F.lit(usual)).alias(name)
        for name, most, usual in (("d1", 0.95, 0.5), ("d2", 1.95, 0.75), ("d3", 2.95, 0.9))
    ]
    cuts = pin(seen.select("of", *cuts), "discounts")  # one row for each language

    context = F.expr(f"substring(gram, 1, {order - 1})")
    rows = table.withColumn("context", context).withColumn("suffix", F.expr("substring(gram, 2)"))
    totals = rows.groupBy("of", "context").agg(
        F.sum("c").alias("total"), times(1).alias("t1"), times(2).alias("t2"), F.count(F.when(F.col("c") > 2, 1)).alias("t3")
    )
    rows = rows.join(totals, ["of", "context"]).join(cuts, "of")
    if lower is None:  # all characters of the language and one unknown are alike
        rows = rows.withColumn("low", 1 / (F.col("t1") + F.col("t2") + F.col("t3") + 1)).withColumn("low_out", F.col("low"))
    else:
        below = lower.select("of", F.col("gram").alias("suffix"), F.col("p").alias("low"), F.col("left_out").alias("low_out"))
        rows = rows.join(below, ["of", "suffix"])
    return rows


def _interpolated(rows: DataFrame) -> DataFrame:
    """``p``, and ``left_out``: the same with one occurrence taken off, for each n-gram of an order."""

    def cut(count: Column) -> Column:
        return F.when(count <= 0, 0.0).when(count == 1, F.col("d1")).when(count == 2, F.col("d2")).otherwise(F.col("d3"))

    c, total = F.col("c"), F.col("total")
    freed = F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")
    freed_out = freed - cut(c) + cut(c - 1)
    below_out = F.when(c == 1, F.col("low_out")).otherwise(F.col("low"))
    p = (F.greatest(c - cut(c), F.lit(0.0)) + freed * F.col("low")) / total
    left_out = (F.greatest(c - 1 - cut(c - 1), F.lit(0.0)) + freed_out * below_out) / (total - 1)
    return rows.select("of", "gram", p.alias("p"), F.when(total == 1, below_out).otherwise(left_out).alias("left_out"))


def left_out(c: np.ndarray, total: np.ndarray, t1: np.ndarray, t2: np.ndarray, t3: np.ndarray, low: np.ndarray, low_out: np.ndarray, *d: np.ndarray) -> np.ndarray:
    """Log probabilities of n-grams with one occurrence of each taken off; as ``_interpolated`` has it."""

    def cut(count: np.ndarray) -> np.ndarray:
        return np.select([count <= 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2])

    freed = d[0] * t1 + d[1] * t2 + d[2] * t3 - cut(c) + cut(c - 1)
    below = np.where(c == 1, low_out, low)
    return np.log(np.where(total == 1, below, (np.maximum(c - 1 - cut(c - 1), 0.0) + freed * below) / np.maximum(total - 1, 1)))


class Model:
    """The parts of the probabilities of one language and block in arrays sorted by n-gram.

    N-grams of the ``COMMON`` most frequent characters are found by their place in a table, others by search.
    """

    def __init__(self, grams: pd.DataFrame):
        points = np.frombuffer("".join(grams["gram"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        keys = _packed(points.reshape(-1, ORDER).T)
        order = np.argsort(keys)
        self.keys, self.parts = keys[order], [grams[part].to_numpy()[order] for part in _PARTS]
        self.values = left_out(*self.parts)
        self.number: np.ndarray | None = None

    def _tabulate(self) -> None:
        """``number`` of each character, the last for rare ones, and ``table`` of places by the numbers of an n-gram."""
        characters = _unpacked(self.keys).T
        kinds, back = np.unique(characters[-1], return_inverse=True)  # each character ends an n-gram
        kinds = kinds[np.argsort(-np.bincount(back, self.parts[0]), kind="stable")[:COMMON]]
        self.width = len(kinds) + 1
        self.number = np.full(_CHARACTERS, len(kinds), dtype=np.int32)
        self.number[kinds] = np.arange(len(kinds))
        numbers = self.number[characters]
        places = np.flatnonzero((numbers < len(kinds)).all(axis=0))
        self.table = np.full(self.width**ORDER, -1, dtype=np.int32)
        self.table[self._cell(numbers[:, places])] = places

    def _cell(self, numbers: Iterable[np.ndarray]) -> np.ndarray:
        cell = 0
        for each in numbers:
            cell = cell * self.width + each
        return cell

    def _places(self, points: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Where the n-grams of ``points`` that count are."""
        if self.number is None and len(points) >= TABLE_FROM:
            self._tabulate()
        if self.number is None:
            return self._searched(_packed(_shifted(points))[counted])
        at = self.table[self._cell(_shifted(self.number[points]))][counted]
        rare = np.flatnonzero(at < 0)
        if len(rare):
            starts = np.flatnonzero(counted)[rare]
            at[rare] = self._searched(_packed(points[starts + shift] for shift in range(ORDER)))
        return at

    def _searched(self, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        if not (self.keys[at] == wanted).all():
            raise ValueError("an n-gram of the text was not counted")
        return at

    def log_perplexities(self, texts: list[str], copies: list[int]) -> np.ndarray:
        """Of each of ``texts``, which as many rows of the language hold as ``copies`` says."""
        points, counted, sizes = _laid_out(texts)
        at = self._places(points, counted)
        values = self.values[at]
        ends = np.cumsum(sizes)
        for text in np.flatnonzero(np.array(copies) > 1):
            own = slice(ends[text] - sizes[text], ends[text])
            values[own] = self._without(at[own], copies[text] - 1)
        pieces = -(-np.maximum(sizes - CHUNK // 2, 1) // CHUNK)
        first = np.cumsum(pieces) - pieces
        text = np.repeat(np.arange(len(texts)), pieces)
        starts = (ends - sizes)[text] + CHUNK * (np.arange(len(text)) - first[text])
        each = -np.add.reduceat(values, starts) / np.diff(np.append(starts, len(values)))
        each = each[np.lexsort((each, text))]
        return (each[first + (pieces - 1) // 2] + each[first + pieces // 2]) / 2

    def _without(self, at: np.ndarray, others: int) -> np.ndarray:
        """The values of the n-grams of a text, found ``at``, when ``others`` further texts like it are taken off."""
        found, back, own = np.unique(at, return_inverse=True, return_counts=True)
        context = np.unique(self.keys[found] >> _BITS, return_inverse=True)[1]
        c, total, t1, t2, t3, *rest = (part[found] for part in self.parts)
        after = c - others * own

        def moved(less: np.ndarray) -> np.ndarray:
            return np.bincount(context, less)[context]

        total = total - others * moved(own)
        t1 = t1 + moved((after == 1) * 1 - (c == 1))
        t2 = t2 + moved((after == 2) * 1 - (c == 2))
        t3 = t3 + moved((after > 2) * 1 - (c > 2))
        return left_out(after, total, t1, t2, t3, *rest)[back]


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated three-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    n = len(words)
    repeated = 0
    if n >= 4:
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
        pairs = ids[:-1] * len(known) + ids[1:]
        if len(known) > 2_000_000:  # the number of a window would not fit into 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(known) + ids[2:]
        ordered = np.sort(windows)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            twice = again[np.minimum(np.searchsorted(again, windows), len(again) - 1)] == windows
            inside = np.zeros(n, dtype=bool)
            for shift in range(3):
                inside[shift : shift + n - 2] |= twice
            repeated = int(inside.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _measured(docs: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
    """The measures of the rows of one block, with the n-grams it counted and its texts that several rows hold."""
    several = grams["same"].notna()
    copies = dict(zip(zip(grams["of"][several], grams["same"][several]), grams["copies"][several].astype("int64")))
    parts = grams[~several].groupby("of")
    found = {}
    for of, part in docs[docs["text"].str.len() > 0].drop_duplicates(["of", "same"]).groupby("of"):
        model = Model(parts.get_group(of))
        for chunk in in_chunks(iter([part]), "text"):
            held = [copies.get((of, same), 1) for same in chunk["same"]]
            found |= zip(zip(chunk["of"], chunk["same"]), model.log_perplexities(list(chunk["text"]), held).tolist())
    rows = [
        (*base_measures(t), found[of, same] if t else math.nan) for of, same, t in zip(docs["of"], docs["same"], docs["text"])
    ]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _MEASURES.split(", ")])
    out.insert(0, "lang", docs["lang"].to_numpy())
    out.insert(0, "doc_id", docs["doc_id"].astype("Int64").to_numpy())
    return out


def _several(stored: DataFrame) -> DataFrame:
    """``block``, ``of``, ``same`` and ``copies`` of the texts that several rows of a language hold."""
    texts = stored.filter(F.length("text") > 0).select("block", "of", "same")
    copies = texts.groupBy("of", "same").agg(F.count("*").alias("copies")).filter("copies > 1")
    return texts.distinct().join(copies, ["of", "same"])


def _block(task: Column, size: Column) -> Column:
    """A number per block of the rows of a task in order, above 32 bits the task."""

    @F.pandas_udf("long")
    def numbered(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        block = held = filled = 0
        for tasks, sizes in rows:
            numbers = np.empty(len(sizes), dtype=np.int64)
            for at, own in enumerate(sizes.tolist()):
                if held and (held >= ROWS_PER_BLOCK or filled + own > BYTES_PER_BLOCK):
                    block, held, filled = block + 1, 0, 0
                held, filled = held + 1, filled + own
                numbers[at] = block
            yield pd.Series(numbers + (tasks.to_numpy() << 32))

    return numbered(task, size)


def _in_blocks(docs: DataFrame, name: str, path: str) -> DataFrame:
    """Store id, text and language as table ``name``, bucketed by ``block``; ``of`` stands for the language, ``same`` for the text.

    A block holds rows of one task, so a task writes its blocks without a shuffle: at
    most ``ROWS_PER_BLOCK`` of them and ``BYTES_PER_BLOCK`` of text, or one longer text.
    The number is stored, so whatever runs again later sees the same blocks. The table's
    files go to the shared folder.
    """
    task = F.shiftright(F.monotonically_increasing_id(), 33)
    block = _block(task, F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)))
    lang = F.col("lang").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    folded = F.translate("text", "123456789\t\x0b\x0c\r", "000000000    ")
    read = read.select("*", block.alias("block"), F.xxhash64("lang").alias("of"), F.md5(folded).alias("same"))
    buckets = min(max(scanned_bytes(docs) // BYTES_PER_BUCKET, 8), MOST_BUCKETS)
    read.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return docs.sparkSession.table(name)


def judge(docs: DataFrame, *, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """The base measures, ``base_failed``, ``log_perplexity`` and ``kept`` for every row of ``docs``."""
    spark, name = docs.sparkSession, f"perplexity_{uuid.uuid4().hex}"
    path = scratch_path(spark, "perplexity-blocks")
    try:
        stored = _in_blocks(docs, name, path)
        counts = stored.select("block", "of", "text").mapInPandas(_count, "block long, of long, gram string, n long")
        counts = pin(counts, "block-grams")
        wanted = counts.select("block", "of", "gram").distinct().join(probabilities(counts), ["of", "gram"])
        wanted = wanted.unionByName(_several(stored), allowMissingColumns=True)
        measured = stored.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(_measured, "doc_id long, lang string, " + _MEASURES)
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        measured = pin(measured.withColumn("base_failed", failed), "perplexity")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    values = measured.filter("NOT base_failed").select(F.col("lang").alias("_lang"), "log_perplexity").distinct()
    middle = values.groupBy("_lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("_middle"))
    middle = pin(middle, "perplexity-middle")
    same = F.col("_lang").eqNullSafe(F.col("_of"))
    off = values.join(middle.withColumnRenamed("_lang", "_of"), same)
    spread = off.groupBy("_lang").agg(
        F.first("_middle").alias("_middle"), F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("_middle")), 0.5, 10_000).alias("_off")
    )
    half = F.greatest(F.lit(least), F.lit(width * 1.4826) * F.col("_off"))
    bands = pin(spread.select("_lang", (F.col("_middle") - half).alias("low"), (F.col("_middle") + half).alias("high")), "perplexity-bands")
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    judged = measured.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_lang")
