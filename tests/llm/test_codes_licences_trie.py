"""Product codes, licence scans and the conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraced.llm import dual_tree_codes, licence_diagonals, prefix_trie

FOLDER = "/root/testdata/sf0.001"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """``{row: (code, error, label error, digest)}`` by comparing every part with every entry in Python integers."""
    rows = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    wide = -(-max((len(r[2]) for r in rows), default=0) // parts) * parts
    ints = [[math.floor(4096 * int(x)) if abs(x) > 1e300 else math.floor(4096 * x) for x in r[2]] + [0] * (wide - len(r[2])) for r in rows]
    step = wide // parts
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [float(x) for x in rows[i][2]]))[:entries]
    books = [[ints[i][p * step : (p + 1) * step] for i in first] for p in range(parts)]

    def assigned():
        out = []
        for vector in ints:
            mine = []
            for p, book in enumerate(books):
                part = vector[p * step : (p + 1) * step]
                far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
                mine.append((far.index(min(far)), min(far)))
            out.append(mine)
        return out

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                held = [v[p * step : (p + 1) * step] for v, a in zip(ints, now) if a[p][0] == e]
                if held:
                    books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    now = assigned()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f for _, f in a) for a in now]
    of_label = {}
    for row, error in zip(rows, errors):
        of_label[row[1]] = of_label.get(row[1], 0) + error
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(
        ((r[0], "".join(f"{e:02x}" for e, _ in a), fits(err), fits(of_label[r[1]]) if all(fits(x) is not None for q, x in zip(rows, errors) if q[1] == r[1]) else None, digest) for r, a, err in zip(rows, now, errors)),
        key=str,
    )


def codes_of(df, **options):
    return sorted((tuple(r) for r in dual_tree_codes.compress(df, **options).collect()), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, ids string, body string"


def test_codes_equal_plain_rounds(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert codes_of(e) == plain_codes([(r.vec_id, r.label, r.embedding) for r in e.collect()])


def test_codes_whatever_the_blocks_and_leaves(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(7, 16))
    rows = [(int(i), (centres[i % 7] + rng.normal(size=16) * (0.01 if i % 3 else 0.5)).tolist(), int(i % 3), "x", 1, "y", "z") for i in range(900)]
    rows += [(900 + i, centres[0].tolist(), None, "x", 1, "y", "z") for i in range(300)]  # a third of the rows in one place
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_codes([(r[0], r[2], r[1]) for r in rows])
    for leaf, slices in ((32, 1), (2, 7), (400, 3)):
        assert codes_of(df.repartition(slices), leaf=leaf) == want


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, -2.0, 3.0], 1), (2, [0.5] * 8, 1), (2, [0.5] * 8, 1), (2, [0.25] * 8, None), (None, [9.0] * 8, None), (7, None, 1), (8, [nan] * 8, 1),
        (9, [1.0, None], 2), (10, [inf], 2), (11, [], 2), (12, [1e30, -1e30], 3), (13, [-0.0001] * 8, 2), (14, [1e308, 3.5], 4), (15, [1e15, 0.3], 5),
    ]
    df = spark.createDataFrame([(i, v, label, "c", 0, "i", "b") for i, v, label in rows], VECTORS)
    assert codes_of(df) == plain_codes([(i, label, v) for i, v, label in rows])
    assert codes_of(df.filter("vec_id = 11")) == plain_codes([(11, 2, [])])
    assert codes_of(df.limit(0)) == []
    assert codes_of(df.filter("vec_id IN (7, 8, 9, 10)")) == []


def test_bounds_drop_only_farther_entries():
    rng = np.random.default_rng(1)
    for wide in (1, 3, 8):
        points = rng.integers(-50, 50, size=(700, wide))
        entries = np.concatenate([rng.integers(-50, 50, size=(9, wide)), points[:4], points[:3]])  # equal entries: ties
        codes, counts, sums = dual_tree_codes.assign(points, dual_tree_codes._tree(points, 8), entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (codes == want).all()
        assert (counts == np.bincount(want, minlength=len(entries))).all()
        assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(len(entries)))


DOCS = "doc_id long, text string, labels string, score string, k1 string, notice string, n_words string"
MIT = licence_diagonals.NOTICES[0][1]


def plain_base(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licence_diagonals.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def plain_spans(text):
    """Every notice tried at every diagonal, by a table of subsequence lengths."""

    def common(a, b):
        row, best, end = [0] * (len(a) + 1), 0, 0
        for at, y in enumerate(b):
            new = [0]
            for i, x in enumerate(a):
                new.append(row[i] + 1 if x == y else max(row[i + 1], new[i]))
            row = new
            if row[-1] > best:
                best, end = row[-1], at + 1
        return best, end

    words, reach = licence_diagonals.words_of(text), licence_diagonals.REACH
    found = set()
    for label, notice in licence_diagonals.NOTICES:
        n = licence_diagonals.words_of(notice)
        needed = len(n) if len(n) <= licence_diagonals.WHOLE else math.ceil(licence_diagonals.ALIKE * len(n))
        for d in range(-len(n), len(words), 5):
            low = max(0, d - reach)
            same, end = common(n, words[low : max(0, d + len(n) + reach)])
            if same >= needed:
                found.add(label)
    return found


def licence_rows():
    changed = MIT.replace("free of charge, ", "").replace("PARTICULAR PURPOSE", "PARTICULAR and other PURPOSE").replace("merge, ", "")
    return [
        (1, "Released under the MIT License."),
        (2, "gnu general public license, apache LICENSE cc by\nmit license mit license"),
        (3, None),
        (4, ""),
        (5, "filler words here " * 40 + changed + " and more words" * 10),
        (6, MIT),
        (6, MIT),
        (None, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."),
        (8, "licensed under cc by 5"),
        (9, "\U0001f600 Ünder ccé by cc by"),
        (10, "cc"),
        (11, " ".join(MIT.split()[i] for i in range(0, 160, 2))),
        (12, "Mit LICENSE" + " nothing" * 3),
        (13, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ]


def scanned(spark, rows):
    df = spark.createDataFrame([(i, t, "l", "s", "k", "n", "w") for i, t in rows], DOCS)
    return licence_diagonals.scan(df)


def test_licences_against_plain_search(spark):
    rows = licence_rows()
    got = scanned(spark, rows).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == sorted([(i, *plain_base(t)) for i, t in rows], key=str)
    by_id = {r.doc_id: r for r in got}
    for i, text in rows:
        r = by_id[i]
        tried = plain_spans(text)
        best = {s.label for s in r.spans}
        assert best <= tried and bool(best) == bool(tried), (i, best, tried)
        assert set(filter(None, r.labels.split(","))) == best | set(filter(None, r.base_labels.split(",")))
        assert r.score == max([s.similarity for s in r.spans] + [0.5 if r.n_base else 0.0])
    assert [s.label for s in by_id[5].spans] == ["mit"] and by_id[5].spans[0].similarity > 0.95
    words = licence_diagonals.words_of(rows[4][1])
    assert words[by_id[5].spans[0].start : by_id[5].spans[0].end][:4] == ["permission", "is", "hereby", "granted"]
    assert by_id[5].spans[0].end - by_id[5].spans[0].start < 175
    assert [s.label for s in by_id[13].spans] == ["agpl-3.0-or-later"]
    assert {s.label for s in by_id[None].spans} == {"cc-by-nc-4.0", "apache-2.0"}
    assert by_id[6].score == 1.0 and by_id[8].labels == "cc-by" and by_id[11].labels == ""


def test_licences_in_long_texts_and_copies(spark):
    long = "word " * 300_000 + MIT + " word" * 700_000 + " mit license"
    rows = [(1, long)] + [(i, "Some text. Released under the MIT License.") for i in range(2, 400)]
    got = {r.doc_id: r for r in scanned(spark, rows).collect()}
    assert len(got) == 399
    assert (got[1].spans[0].start, got[1].first_word) == (300_000, plain_base(long)[2])
    assert got[1].n_words == plain_base(long)[0]
    assert {got[i].labels for i in range(2, 400)} == {"mit"}
    assert scanned(spark, rows).limit(0).count() == 0
    assert scanned(spark, rows[:1]).filter("false").count() == 0


def test_licences_of_no_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert licence_diagonals.scan(df).collect() == []


def test_bit_rows_equal_the_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = [str(x) for x in rng.integers(0, 6, size=rng.integers(1, 30))]
        b = [str(x) for x in rng.integers(0, 6, size=rng.integers(0, 40))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        best = table[-1][-1]
        end = next((j for j, v in enumerate(table[-1]) if v == best), 0)
        assert licence_diagonals.common_words(a, b) == (best, end)


def plain_trie(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn, role or "", text or ""))

    def order(turn):
        return (turn[0] is not None, turn[0] or 0, hashlib.md5(f"{len(turn[1])}:{turn[1]}{turn[2]}".encode()).hexdigest())

    said = {c: [(r, t) for _, r, t in sorted(v, key=order)] for c, v in said.items()}
    whole = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = said.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members, kids = {}, {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\\x20\\x09-\\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids.get(node, []))
        leaves[node] = sum(leaves[k] for k in kids[node]) if node in kids else 1
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(whole[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TALK = "conv_id long, turn long, role string, text string, depth string, words string, at string, key string"


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "d", "w", "a", "k") for r in rows], TALK)
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


def test_trie_of_given_conversations(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str) == plain_trie([tuple(r) for r in df.collect()])


def test_trie_of_odd_rows(spark):
    rows = [
        (20, 0, "user", "hello  there"), (20, 1, "bot", "yes\tand no"), (20, None, "system", "be kind"), (20, 2, "user", None), (20, 2, None, "tie"), (20, 2, None, "tie"),
        (21, 0, "user", "x"), (22, 0, "user", "hello  there"), (22, 1, "bot", "other words here"), (23, 5, "u", "a b c"), (25, 1, "u", ""), (-3, 0, "u", "neg"), (0, 0, "u", "zero here"),
        (None, 0, "u", "nobody"), (41, 0, "u", "no base"), (42, 0, "u", "no base"), (43, 0, "u", "no base"), (44, 0, "u", "no base"), (44, 1, "u", "more of it"),
    ]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert trie_of(spark, rows[:0]) == []
    assert trie_of(spark, [(None, 0, "u", "t")]) == []


def test_trie_with_a_hot_conversation_and_many_copies(spark):
    rows = [(7, t, "u", f"turn {t % 5}") for t in range(1500)]
    rows += [(1000 + 20 * i, t, "u", f"same {t}") for i in range(300) for t in range(4)]
    rows += [(7001 + i, t, "u", f"turn {t % 5}") for i in range(3) for t in range(500 + i)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_lists_in_pieces_hash_like_whole_lists(spark):
    ends = spark.range(5000).select((F.col("id") % 3).alias("s1"), F.lit(1).cast("long").alias("s2"), (F.col("id") * 7 - 100).alias("conv_id"))
    got = {r.s1: r.ends_sha256 for r in prefix_trie.list_hashes(ends, piece=64).collect()}
    for s in range(3):
        ids = ",".join(str(i * 7 - 100) for i in range(5000) if i % 3 == s)
        assert got[s] == hashlib.sha256(ids.encode()).hexdigest()
