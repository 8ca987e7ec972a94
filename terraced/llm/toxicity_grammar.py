"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat verb, second- or third-person target, speaker,
intent, negation, reporting verb, filler, other; commas and colons are pauses. Five
small transducers read the symbols of a sentence from left to right and answer each
with a weight or a factor; their composition is one machine over tuples of states,
built as it is used.

* insult: an insult gives the weight of its word.
* threat: a threat verb in any form, soon followed by a target, gives a weight: the
  largest when the clause has a speaker or an intent ("I", "will") and the target is
  the second person, the smallest when others act on others.
* target: an insult soon after a target counts more.
* negation: an insult right after a negation, fillers aside, counts less, and so does
  a threat whose verb stands in the ``SCOPE`` words after a negation.
* reported speech: what follows a reporting verb in its sentence counts less.

A pause starts all machines but reported speech afresh, since reported words often
begin there. A sentence scores its strongest match and half its second one; the
document scores its strongest sentence, so many weak ones do not add up with length.
Sentences without an insult or threat are not run.

The insult words and their weights are learned: in a bounded sample of labelled
documents (at most ``PER_LABEL`` of each label, the first by a hash of the id), the
documents that hold a word, or a word beginning of 4 to 8 letters, are counted by
label; those far more frequent in toxic ones become insults, weighted by their log
odds. Beginnings find words that share a stem. Near copies are reduced to one
before, or every word of an often copied toxic text would look like an insult.

Defined results. Null and empty texts score 0. Without labels only the threat part
scores. Repeated labels of one id count once, with the lowest value. Repeated rows
stay rows. Only id and text are read, and id and label of the labels. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import in_chunks
from terraced.llm.neighbour_quality import labelled
from terraced.llm.tensored_minhash import _sketches, shingle_set

PER_LABEL = 4_096
LIFT = 25.0
LEAST_SHARE = 0.01
LEAST_COUNT = 6
STEMS = (4, 5, 6, 7, 8)
BAR = 3.0
SHADOW = 0.7
KNOWN = 100_000  # words and stems a task remembers before it starts afresh
SCOPE = 5
REACH = 3
#: Weight of a threat by (speaker or intent in the clause, second-person target).
THREAT_WEIGHTS = {(True, True): 4.5, (True, False): 2.5, (False, True): 2.5, (False, False): 1.5}


def _inflected(verb: str) -> set[str]:
    """The forms of a regular English verb."""
    stem = verb[:-1] if verb.endswith("e") else verb
    doubled = stem + stem[-1]
    return {verb, verb + "s"} | {start + end for start in (stem, doubled) for end in ("ed", "ing")}


THREATS = frozenset().union(*(_inflected(v) for v in "kill hurt destroy beat murder stab shoot strangle burn punch harm smash choke".split())) | frozenset(
    "shot beaten töten töte tötet umbringen verletze verletzen tuer tue tuerai frapper matar mato mata mataré golpear".split()
)
YOU = frozenset("you your yours ya u yourself du dich dir euch tu te vous toi usted ustedes ti".split())
THEM = frozenset("they them he him she her us their his sie ihn ihr ils elles eux lui ellos ellas él".split())
SPEAKER = frozenset("i we i'm i'll we'll we're ich wir je nous yo nosotros".split())
INTENT = frozenset("will shall gonna going want must should let's i'll we'll you'll he'll she'll they'll werde werden vais va voy vamos".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't weren't won't wouldn't don't doesn't didn't can't cannot nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says saying wrote writes quoted claimed called reported shouted yelled sagte schrieb dit écrit dijo".split())
FILLERS = frozenset("a an the so very really such ein eine un une el la".split())
_SYMBOLS = (("threat", THREATS), ("you", YOU), ("them", THEM), ("intent", INTENT), ("speaker", SPEAKER), ("negation", NEGATIONS), ("report", REPORTS), ("filler", FILLERS))

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[,:]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_SENTENCE = re.compile(r"[.;!?\n]+")


def _lower(text: str) -> str:
    """Lower case with one kind of apostrophe. Replacing is much faster than a translation table."""
    return text.lower().replace("\u2019", "'").replace("\u02bc", "'").replace("\u2018", "'")


# ------------------------------------------------------------- the machine
#
# A transducer maps (state, symbol) to (next state, weight, factor). State 0 is the start.

State = int | tuple[int, ...]


def _insult(state: State, symbol: str) -> tuple[State, float, float]:
    return 0, 1.0 if symbol == "insult" else 0.0, 1.0


def _threat(state: State, symbol: str) -> tuple[State, float, float]:
    """The state is whether the clause has a speaker or intent, and the words left to a target."""
    meant, left = state or (0, 0)
    if symbol == "pause":
        return 0, 0.0, 1.0
    if symbol == "threat":
        return (meant, REACH), 0.0, 1.0
    weight = THREAT_WEIGHTS[bool(meant), symbol == "you"] if left and symbol in ("you", "them") else 0.0
    return (meant or int(symbol in ("speaker", "intent")), max(left - 1, 0)), weight, 1.0


def _target(state: State, symbol: str) -> tuple[State, float, float]:
    if symbol == "pause":
        return 0, 0.0, 1.0
    return (4 if symbol in ("you", "them") else max(state - 1, 0)), 0.0, 1.2 if symbol == "insult" and state else 1.0


def _negation(state: State, symbol: str) -> tuple[State, float, float]:
    """The state is whether a negation stands right before, the words left in its scope, and those left of a negated threat."""
    near, scope, denied = state or (0, 0, 0)
    if symbol == "pause":
        return 0, 0.0, 1.0
    if symbol == "negation":
        return (1, SCOPE, 0), 0.0, 1.0
    factor = 0.3 if symbol == "insult" and near or symbol in ("you", "them") and denied else 1.0
    denied = REACH if symbol == "threat" and scope else max(denied - 1, 0)
    return (int(near and symbol == "filler"), max(scope - 1, 0), denied), 0.0, factor


def _reported(state: State, symbol: str) -> tuple[State, float, float]:
    return state or int(symbol == "report"), 0.0, 0.5 if state and symbol in ("insult", "you", "them") else 1.0


MACHINES = (_insult, _threat, _target, _negation, _reported)


@dataclass
class Grammar:
    """The composed machine with the learned insult words."""

    insults: dict[str, float]
    moves: dict[tuple[tuple[State, ...], str], tuple[tuple[State, ...], float, float, float]] = field(default_factory=dict)
    known: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def symbol(self, word: str) -> tuple[str, float] | None:
        """Symbol and insult weight of a lower-case word; none for words without meaning here."""
        if word in self.known:
            return self.known[word]
        found = None
        whole = self.insults.get("=" + word)
        stems = [self.insults[word[:n]] for n in STEMS if word[:n] in self.insults and len(word) >= n]
        if whole is not None or stems:
            found = ("insult", max([whole or 0.0, *stems]))
        else:
            for name, words in _SYMBOLS:
                if word in words:
                    found = (name, 0.0)
                    break
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known[word] = found
        return found

    def step(self, states: tuple[State, ...], symbol: str) -> tuple[tuple[State, ...], float, float, float]:
        key = (states, symbol)
        if key not in self.moves:
            made = [machine(state, symbol) for machine, state in zip(MACHINES, states)]
            factor = math.prod(m[2] for m in made)
            self.moves[key] = tuple(m[0] for m in made), made[0][1], sum(m[1] for m in made[1:]), factor
        return self.moves[key]

    def matches(self, tokens: list[str]) -> Iterator[float]:
        """The weights of the matches of a sentence."""
        states: tuple[State, ...] = (0,) * len(MACHINES)
        for token in tokens:
            symbol, weight = ("pause", 0.0) if token in ",:" else self.symbol(token) or ("other", 0.0)
            states, insult, other, factor = self.step(states, symbol)
            if insult or other:
                yield factor * (insult * weight + other)

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        lower = _lower(text)
        hits = {w for w in set(_WORD.findall(lower)) if (s := self.symbol(w)) and s[0] in ("insult", "threat")}
        if not hits:
            return 0.0
        best = 0.0
        for sentence in _SENTENCE.split(lower):
            tokens = _TOKEN.findall(sentence)
            if not hits.isdisjoint(tokens):
                first, second, *_ = sorted((0.0, 0.0, *self.matches(tokens)), reverse=True)
                best = max(best, first + second / 2)
        return 1.0 / (1.0 + math.exp(BAR - best)) if best else 0.0


# ------------------------------------------------------------- learning


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three minimum hashes of each text, equal for most near copies."""
    for frame in in_chunks(frames, "text"):
        rows = []
        for text in frame["text"]:
            found = shingle_set(text)
            rows.append(_sketches(found, 2, 1)[:3].astype("int64") if len(found) else [0, 0, 0])
        out = pd.DataFrame(rows, columns=["m1", "m2", "m3"])
        out["y"], out["text"] = frame["y"].to_numpy(), frame["text"].to_numpy()
        yield out


def _stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = (Counter(), Counter())
    for frame in in_chunks(frames, "text", 1_000_000):
        if len(counts[0]) + len(counts[1]) > KNOWN:  # sums are joined later, so parts may leave early
            yield from _counted(*counts)
            counts = (Counter(), Counter())
        for y, text in zip(frame["y"], frame["text"]):
            found = set()
            for word in set(_WORD.findall(_lower(text or ""))):
                found.add("=" + word)
                found.update(word[:n] for n in STEMS if len(word) >= n)
            counts[y].update(found)
    yield from _counted(*counts)


def _counted(clean: Counter, toxic: Counter) -> Iterator[pd.DataFrame]:
    every = list(clean.keys() | toxic.keys())
    for start in range(0, len(every), 50_000):
        part = every[start : start + 50_000]
        yield pd.DataFrame({"stem": part, "clean": [clean[s] for s in part], "toxic": [toxic[s] for s in part]})


def learn(docs: DataFrame, labels: DataFrame, learns: Column, *, label: str = "toxic", per_label: int = PER_LABEL) -> Grammar:
    """The grammar with insult words learned where ``learns`` (over ``labels``) holds."""
    sample = labelled(docs, labels, learns, label, per_label).mapInPandas(_marked, "m1 long, m2 long, m3 long, y int, text string")
    for mark in ("m1", "m2", "m3"):
        sample = sample.groupBy("y", mark).agg(F.min(F.struct("text", *[m for m in ("m1", "m2", "m3") if m != mark])).alias("s")).select("y", mark, "s.*")
    counts = sample.select("y", "text").mapInPandas(_stems, "stem string, clean long, toxic long")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Grammar({})
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    sums = counts.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = max(LEAST_COUNT, math.ceil(LEAST_SHARE * toxic))
    chosen = sums.filter((F.col("toxic") >= least) & (odds >= LIFT)).select("stem", F.log(odds).alias("weight"), "toxic")
    return Grammar(_without_shadows({r["stem"]: (r["weight"], r["toxic"]) for r in chosen.collect()}))  # bounded by the sample


def _without_shadows(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Drops beginnings that one insult word explains, as they would catch unrelated longer words."""
    most = Counter()
    for stem, (_, toxic) in found.items():
        if stem[0] == "=":
            for n in STEMS:
                most[stem[1 : n + 1]] = max(most[stem[1 : n + 1]], toxic)
    return {stem: weight for stem, (weight, toxic) in found.items() if stem[0] == "=" or most[stem] < SHADOW * toxic}


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id`` and ``score`` for every row of ``docs``."""
    insults = docs.sparkSession.sparkContext.broadcast(grammar.insults)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Grammar(insults.value)
        for frame in in_chunks(frames, "text"):
            scores = [own.score(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").to_numpy(), "score": pd.Series(scores, dtype="float64").to_numpy()})

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "doc_id long, score double")


def score_column(text: Column, grammar: Grammar) -> Column:
    """The score as a column, for filters that keep all other columns as they are."""
    insults = dict(grammar.insults)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Grammar(insults)
        for texts in batches:
            yield texts.map(own.score).astype("float64")

    return scored(text.cast("string"))
