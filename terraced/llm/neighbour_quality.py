"""Quality by a vote of the nearest labelled documents in a latent-semantic space.

The terms of a document are pairs of neighbouring character classes and marks of
repetition (words equal to the one before, words and word pairs seen before, capitals
and signs at words). Term shares are damped, weighted by inverse document frequency,
counted over all documents, and reduced by a singular value decomposition of the labelled sample. The sample is
at most ``PER_LABEL`` labelled documents of each label, the first by a hash of the id
(a documented bound); its vectors are broadcast (``2 * PER_LABEL * RANK`` numbers).

Every document is compared with every labelled vector: exact cosine products of
blocks of ``BLOCK`` documents with the whole sample. Its ``NEAREST`` neighbours vote
with their similarity, sharpened by a power, as weight.

Labels, lang, source and doc_id are not terms; the id only picks the sample.

Defined results. Null and empty texts have no terms: their score is the share of
label 1 in the sample. Documents without a label and labels without a document take
no part in learning. Repeated labels of one id count once, with the lowest value.
Repeated rows stay rows. An empty table gives an empty result; without any labels
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import hash_words, in_chunks

PER_LABEL = 2_048
RANK = 48
NEAREST = 25
BLOCK = 512
SHARPEN = 12
CLASSES = 24
MARKS = 8
TERMS = CLASSES * CLASSES + MARKS
_SIGNS = ".,!?|#*$%&<>"

_tables: dict[str, np.ndarray] = {}


def _class_table() -> np.ndarray:
    table = np.full(65536, 7, dtype=np.int64)
    for point in range(65536):
        char = chr(point)
        if char.isalpha():
            table[point] = 1 if char.isupper() else 2
        elif char.isdigit():
            table[point] = 3
        elif char == "\n":
            table[point] = 5
        elif char.isspace():
            table[point] = 4
        elif point < 128:
            table[point] = 6
    for vowel in "aeiou":
        table[ord(vowel)] = 8
    for at, sign in enumerate(_SIGNS):
        table[ord(sign)] = 9 + at
    return table


def terms(text: str | None) -> np.ndarray:
    """Damped shares of the terms of one text."""
    row = np.zeros(TERMS, dtype=np.float32)
    if not text:
        return row
    if "class" not in _tables:
        _tables["class"] = _class_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = np.concatenate(([0], _tables["class"][np.minimum(points, 65535)], [0]))
    pairs = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES * CLASSES)
    row[: CLASSES * CLASSES] = np.sqrt(pairs / pairs.sum())
    words = hash_words(text.encode("utf-8", "surrogatepass"))
    n = len(words)
    if n > 1:
        with np.errstate(over="ignore"):
            couples = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        marks = [
            (words[1:] == words[:-1]).mean(),
            1 - len(np.unique(words)) / n,
            1 - len(np.unique(couples)) / (n - 1),
        ]
        for at, mark in enumerate(marks):
            row[CLASSES * CLASSES + at] = np.sqrt(mark)
            row[CLASSES * CLASSES + 3 + at] = mark > 0.5
    return row


def labelled(docs: DataFrame, labels: DataFrame, learns: Column, label: str, per_label: int) -> DataFrame:
    """``text`` and ``y`` of at most ``per_label`` rows of each label, the first by a hash of the id."""
    known = labels.filter(learns & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("y"))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("y") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "y")  # at most 2 * per_label rows


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in in_chunks(frames, "text"):
        yield pd.DataFrame({"y": frame["y"].to_numpy(), "terms": [terms(t).tobytes() for t in frame["text"]]})


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per task: documents, and how many of them hold each term."""
    seen, rows = np.zeros(TERMS, dtype=np.int64), 0
    for frame in in_chunks(frames, "text"):
        for text in frame["text"]:
            seen += terms(text) > 0
        rows += len(frame)
    yield pd.DataFrame({"n": [rows], "seen": [seen]})


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """All documents and how many hold each term; ``TERMS + 1`` numbers reach the driver, summed by position."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_count, "n long, seen array<long>")
    places = counted.select(F.posexplode(F.concat(F.array("n"), "seen")).alias("at", "found")).groupBy("at").agg(F.sum("found").alias("found"))
    sums = np.zeros(TERMS + 1, dtype=np.int64)
    for row in places.collect():
        sums[row["at"]] = row["found"]
    return int(sums[0]), sums[1:]


class Voters:
    """The labelled vectors and the projection that makes vectors of terms."""

    def __init__(self, labels: np.ndarray, weight: np.ndarray, middle: np.ndarray, directions: np.ndarray, vectors: np.ndarray):
        self.labels, self.weight, self.middle, self.directions, self.vectors = labels, weight, middle, directions, vectors

    @classmethod
    def fitted(cls, found: np.ndarray, labels: np.ndarray, documents: int, frequency: np.ndarray) -> Voters:
        weight = (np.log((1 + documents) / (1 + frequency)) + 0.3).astype(np.float32)
        weighted = found * weight
        middle = weighted.mean(axis=0) if len(found) else np.zeros(TERMS, np.float32)
        around = weighted - middle
        _, directions = np.linalg.eigh(around.T @ around)
        made = cls(labels.astype(np.float32), weight, middle, directions[:, ::-1][:, :RANK].astype(np.float32), np.empty(0))
        made.vectors = made.project(found)
        return made

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.labels, self.weight, self.middle, self.directions, self.vectors

    def project(self, found: np.ndarray) -> np.ndarray:
        made = (found * self.weight - self.middle) @ self.directions
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)

    def scores(self, found: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(found), 0.5)
        prior = float(self.labels.mean())
        cosines = self.project(found) @ self.vectors.T
        near = min(NEAREST, len(self.labels))
        top = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
        weight = np.maximum(np.take_along_axis(cosines, top, axis=1), 0.0).astype(np.float64) ** SHARPEN
        vote = (weight * self.labels[top]).sum(axis=1)
        score = (vote + 1e-6 * prior) / (weight.sum(axis=1) + 1e-6)
        return np.where(found.any(axis=1), np.clip(score, 0.0, 1.0), prior)


def score(docs: DataFrame, labels: DataFrame, learns: Column, *, label: str = "quality", per_label: int = PER_LABEL) -> DataFrame:
    """``doc_id`` and ``score`` for every row of ``docs``, learning where ``learns`` (over ``labels``) holds."""
    sample = labelled(docs, labels, learns, label, per_label).mapInPandas(_fit, "y int, terms binary").toPandas()
    sample = sample.sort_values(["y", "terms"])  # the order of arrival must not matter
    found = np.frombuffer(b"".join(sample["terms"]), dtype=np.float32).reshape(-1, TERMS)
    voters = Voters.fitted(found, sample["y"].to_numpy(dtype=np.float64), *document_frequencies(docs))
    shared = docs.sparkSession.sparkContext.broadcast(voters.arrays())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(*shared.value)
        for frame in in_chunks(frames, "text"):
            for start in range(0, len(frame), BLOCK):
                block = frame.iloc[start : start + BLOCK]
                rows = np.stack([terms(t) for t in block["text"]])
                yield pd.DataFrame({"doc_id": block["doc_id"].astype("Int64").to_numpy(), "score": voters.scores(rows)})

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "doc_id long, score double")
