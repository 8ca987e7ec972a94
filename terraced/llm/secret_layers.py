"""Secret scans through nested encodings.

Every text is scanned as it stands, then it is unwrapped: percent escapes, Unicode
escapes in all usual notations, escaped quotes and line breaks, base64 runs, UTF-16 and
UTF-32, and gzip, zlib (of any window), bzip2 or xz data in them. Each layer found is
scanned, whatever its bytes are, and unwrapped in turn until nothing new comes out. A
layer whose text was seen before in the same document is not taken again, which ends
cycles; every other layer is shorter than what it came from or comes from inflating it.

Decoded bytes are read as Latin-1: one character for each byte, as all that is looked
for is ASCII. A base64 run goes on over single line breaks with white space around them,
and is decoded from each of its first four characters, so one that begins anywhere in it
is found; the lines of such a run are decoded by themselves too. The lines may be quoted
by ``>``. Compressed data is opened wherever decoded bytes hold its mark. Wide characters are
read without their zero bytes, where at least ``SHORTEST`` of them follow one another.
Not opened: other encodings (base32, base85, quoted-printable), archives with formats of
their own inside (zip, 7z), and encrypted data.

Spans are code points of the document. A finding inside three layers is reported at
the escape or base64 run that holds it. Escapes map one by one, base64 in groups of
four characters, inflated data to the part from its first group to the end of its run.

Inflating is done in pieces of about ``PIECE`` bytes with ``OVERLAP`` bytes repeated. A
piece ends where no encoded run is open; a run longer than that is held whole. Layers
are made one after the other. Data compressed several times over is inflated level by
level in the same way.

Defined results. Null text: as empty, no findings. Repeated rows stay rows. Only the
id and text columns are read. Broken encodings give no layer. An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import accumulate, chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import in_chunks

KINDS = ("assign", "access", "hex")
PIECE = 4 << 20
OVERLAP = 4096
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of the shortest finding: a name of five, a sign and six more.
SHORTEST = 12
_ESCAPE = re.compile(
    r"(?=[%\\&])(?:(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\[nrt\"'/]|&#x?[0-9A-Fa-f]{1,6};)"
)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t"}
_WIDE = re.compile(f"(?:[\x20-\x7e]\0{{1,3}}){{{SHORTEST}}}|(?:\0{{1,3}}[\x20-\x7e]){{{SHORTEST}}}")
_B64, _BREAK = "[A-Za-z0-9+/_-]", r"[ \t]*+\r?\n[ \t>]*+"
#: 16 characters hold the shortest finding, an assignment of 12; the lines of a run may be shorter.
_BASE64 = re.compile(rf"(?<!{_B64})(?:{_B64}{{16,}}+|{_B64}++(?={_BREAK}{_B64}))(?:{_BREAK}{_B64}++)*+={{0,2}}")
_LINE = re.compile(f"{_B64}+")
#: The two bytes zlib data can begin with, for each window and level, without a preset dictionary.
_ZLIB = frozenset(bytes((cmf, flags)) for cmf in range(0x08, 0x80, 0x10) for flags in range(256) if (cmf * 256 + flags) % 31 == 0 and not flags & 0x20)
_MARKS = re.compile(b"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|" + b"|".join(map(re.escape, sorted(_ZLIB))))
#: In reversed data: a byte no encoded run holds, or white space within a line but after a quote's sign.
_FREE = re.compile(rb"[^A-Za-z0-9+/_.=%\\&#;\s>{}-]|\S[ \t]+(?=[^\s>])")

Span = tuple[int, int, int]  # start, place of the kind, end


def scan(text: str) -> list[Span]:
    """Findings of one layer, leftmost and non-overlapping for each kind."""
    low = text.lower()
    named = any(name in low for name in ("passw", "secret", "token", "api"))  # much faster than the expression, and needed by it
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if named else []
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A text made from another one, its ``parent``; ``within`` gives the parent's part that characters came from."""

    def __init__(self, text: str, parent: _Layer | None = None, within: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.parent, self.within = text, parent, within

    def part(self, start: int, end: int) -> tuple[int, int]:
        """The part of the document that characters ``start`` to ``end`` came from."""
        layer = self
        while layer.parent is not None:
            start, end = layer.within(start, end)
            layer = layer.parent
        return start, end


def _unescaped(layer: _Layer) -> Iterator[_Layer]:
    """The whole layer with its escapes replaced, and what compressed escaped bytes hold."""
    pieces: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    at = 0

    def keep(to: int) -> None:
        if to > at:
            pieces.append(layer.text[at:to])
            starts.append(np.arange(at, to))
            ends.append(np.arange(at + 1, to + 1))

    changed = False
    for m in _ESCAPE.finditer(layer.text):
        raw, width, plain = m[0], 0, None
        if raw[0] == "%" or raw[:2] == "\\x":
            width = 3 if raw[0] == "%" else 4
            data = bytes.fromhex(raw.replace("%", "").replace("\\x", ""))
            for place in _opened(data):
                for text in _inflated(data[place:]):
                    yield _whole(layer, text, m.start() + place * width, m.end())
            plain, sizes = data.decode("latin-1"), np.full(len(data), width)
        elif raw[0] == "\\" and (raw[1] == "U" or raw[2:3] == "{"):
            number = int(raw[2:].strip("{}"), 16)
            if number >= 0x110000 or 0xD800 <= number < 0xE000:
                continue
            plain, sizes = chr(number), np.array([len(raw)])
        elif raw[0] == "\\" and len(raw) == 2:
            plain, sizes = _PLAIN.get(raw[1], raw[1]), np.array([2])
        elif raw[0] == "\\":
            units = bytes.fromhex(raw.replace("\\u", ""))
            plain = units.decode("utf-16-be", "replace")
            sizes = np.array([len(c.encode("utf-16-be")) for c in plain]) * 3
        else:
            number = int(raw[3:-1], 16) if raw[2] == "x" else int(raw[2:-1]) if raw[2:-1].isdigit() else -1
            if not 0 < number < 0x110000 or 0xD800 <= number < 0xE000:
                continue
            plain, sizes = chr(number), np.array([len(raw)])
        keep(m.start())
        edges = m.start() + np.concatenate(([0], np.cumsum(sizes)))
        pieces.append(plain)
        starts.append(edges[:-1])
        ends.append(edges[1:])
        at, changed = m.end(), True
    if changed:
        keep(len(layer.text))
        first, last = np.concatenate(starts), np.concatenate(ends)
        yield _Layer("".join(pieces), layer, lambda start, end: (int(first[start]), int(last[end - 1])))


def _whole(layer: _Layer, text: str, start: int, end: int) -> _Layer:
    return _Layer(text, layer, lambda *_: (start, end))


def _decoded(layer: _Layer) -> Iterator[_Layer]:
    """What the base64 runs of the layer hold."""
    for m in _BASE64.finditer(layer.text):
        lines = [(m.start() + part.start(), m.start() + part.end()) for part in _LINE.finditer(m[0])]
        runs = [lines] if len(lines) == 1 else [lines, *([line] for line in lines)]
        for run in runs:
            if sum(end - start for start, end in run) >= 16:
                yield from _from_run(layer, run, m.end() if run[-1][1] == lines[-1][1] else run[-1][1])


def _from_run(layer: _Layer, lines: list[tuple[int, int]], end: int) -> Iterator[_Layer]:
    """The layers of one run, given by the places of its lines."""
    joined = "".join(layer.text[first:last] for first, last in lines).translate({45: 43, 95: 47})
    before = list(accumulate((last - first for first, last in lines), initial=0))

    def place(at: int) -> int:
        line = bisect_right(before, at, hi=len(lines)) - 1
        return lines[line][0] + at - before[line]

    for phase in range(4):
        body = joined[phase : len(joined) - ((len(joined) - phase) % 4 == 1)]
        data = base64.b64decode(body + "=" * (-len(body) % 4))

        def within(start: int, stop: int, phase: int = phase) -> tuple[int, int]:
            last = phase + ((stop - 1) // 3 + 1) * 4
            return place(phase + start // 3 * 4), place(last - 1) + 1 if last < len(joined) else end

        yield _Layer(data.decode("latin-1"), layer, within)
        for at in _opened(data):
            for text in _inflated(data[at:]):
                yield _whole(layer, text, place(phase + at // 3 * 4), end)


def _opener(head: bytes) -> Callable[[], Any] | None:
    """What makes a decompressor for data that begins with ``head``."""
    if head[:2] == b"\x1f\x8b" or head[:2] in _ZLIB:
        return partial(zlib.decompressobj, 47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _opened(data: bytes) -> Iterator[int]:
    """Where compressed data begins: at a mark, if its first bytes can be inflated, as otherwise it gives nothing."""
    for mark in _MARKS.finditer(data):
        head = data[mark.start() : mark.start() + 256]
        try:
            _opener(head)().decompress(head, PIECE)
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            continue
        yield mark.start()


def _pieces(parts: Iterable[bytes], make: Callable[[], Any]) -> Iterator[bytes]:
    """What compressed ``parts`` hold, at most ``PIECE`` bytes at a time, up to the first damage."""
    opened = make()
    try:
        for part in parts:
            more = bool(part)
            while more:
                if opened.eof:  # members follow one another
                    opened = make()
                piece = opened.decompress(part, PIECE)
                if piece:
                    yield piece
                if opened.eof:
                    part = opened.unused_data
                    more = bool(part)
                elif hasattr(opened, "needs_input"):
                    part, more = b"", not opened.needs_input
                else:
                    part = opened.unconsumed_tail
                    more = bool(part) or len(piece) == PIECE
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
        return


def _cut(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The pieces, moved so that each ends where no encoded run is open, with the last ``OVERLAP`` bytes before it."""
    held, tail, looked = bytearray(), b"", 0
    for piece in pieces:
        held += piece
        if len(held) < PIECE:
            continue
        free = _FREE.search(bytes(held[max(looked - 2, 0) :])[::-1])
        looked = len(held)
        if free:
            at = len(held) - free.start() - (free.end() - free.start() > 1)
            whole = tail + bytes(held[:at])
            tail, held = whole[-OVERLAP:], held[at:]
            looked = len(held)
            yield whole
    if held:
        yield tail + bytes(held)


def _inflated(data: bytes) -> Iterator[str]:
    """The texts in compressed ``data``, in pieces, also where it is compressed more than once.

    Data that holds itself ends the descent: a level that begins like an earlier
    one, over a whole piece, is not opened again.
    """
    seen, levels = set(), []
    while True:
        parts: Iterable[bytes] = (data,)
        for make in levels:
            parts = _pieces(parts, make)
        inner = iter(parts)
        head = next(inner, b"")
        if levels:
            for held in _cut(chain((head,), inner)):
                yield held.decode("latin-1")
        make, mark = _opener(head), hashlib.blake2b(head, digest_size=16).digest()
        if make is None or mark in seen:
            return
        seen.add(mark)
        levels.append(make)


def _narrowed(layer: _Layer) -> Iterator[_Layer]:
    """The layer without its zero characters, if they belong to wide characters."""
    if "\0" in layer.text and _WIDE.search(layer.text):
        kept = np.flatnonzero(np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        yield _Layer(layer.text.replace("\0", ""), layer, lambda start, end: (int(kept[start]), int(kept[end - 1]) + 1))


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    return chain(_unescaped(layer), _decoded(layer), _narrowed(layer))


def findings(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base findings of the text as it stands, and all findings, both sorted."""
    if not text:
        return [], []
    base = scan(text)
    every = set(base)
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work = [_unwrapped(_Layer(text))]
    while work:
        made = next(work[-1], None)
        if made is None:
            work.pop()
            continue
        if not made.text:
            continue
        mark = hashlib.blake2b(made.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        # The place counts too: equal runs in two places are two findings.
        mark += b"%d" % made.part(0, 1)[0]
        if mark in seen:
            continue
        seen.add(mark)
        for start, kind, end in scan(made.text):
            first, last = made.part(start, end)
            every.add((first, kind, last))
        work.append(_unwrapped(made))
    return base, sorted(every)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in in_chunks(frames, "text"):
        rows = []
        for text in frame["text"]:
            base, every = findings(text)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every)))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])
        out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
        yield out


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and digests of findings for every row: see ``_report`` for the columns."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(
        _report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    )


def without_secrets(text: Column) -> Column:
    """The text with every finding, overlapping ones together, replaced by ``MASK``. Null stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(_masked)

    return masked(text)


def _masked(text: str | None) -> str | None:
    _, every = findings(text)
    if not every:
        return text
    pieces, at, upto = [], 0, 0
    for start, _, end in every:
        if start >= upto:
            pieces += [text[at:start], MASK]
        at = upto = max(upto, end)
    return "".join([*pieces, text[at:]])
