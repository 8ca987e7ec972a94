"""Small tables with odd rows against plain Python, one operator at a time."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraced.llm import (
    collision_projections,
    length_buckets,
    neighbour_quality,
    pareto_mixing,
    perplexity_rules,
    secret_layers,
    splitter_shards,
    tensored_minhash,
    toxicity_grammar,
    url_rules,
)
from terraced.llm.common import crc_of_id
from terraced.operators import ranking

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, node string"


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "other")
    texts = [base, base, near, base.upper(), None, "", " \n\t", "one two three", "one  two\nthree", "long " * 5000 + base, base, "a b \U0001f600 c"]
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "b", "a"][i % 3], None, "x", "y", "z", "n") for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, base, None, None, None, "x", "y", "z", "n"), (None, "only nameless text of six words", None, None, None, "x", "y", "z", "n")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def near_dup_truth(rows):
    sets = []
    for _, text in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return sorted(
        ((d, len(s), min(ids[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str
    )


def test_near_duplicates_equal_brute_force(odd, docs, empty):
    for table in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = tensored_minhash.near_duplicates(table).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near_dup_truth(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert tensored_minhash.near_duplicates(empty).count() == 0


def test_links_hidden_behind_a_shared_passage_are_found(spark):
    """Many texts share half of their words; the few that are near copies of each other must still link."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(100))
    own = [" ".join(f"d{k}x{i}" for i in rng.permutation(70)) for k in range(60)]
    texts = [passage + " " + o for o in own] + [passage + " " + own[k][:-12] + " end" for k in (41, 52)]
    rows = list(enumerate(texts))
    got = tensored_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near_dup_truth(rows)


def test_mix(odd, docs, empty):
    for table in (odd, docs):
        rows = pareto_mixing.mix(table).collect()
        again = pareto_mixing.mix(table.repartition(5)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
        truth = defaultdict(int)
        for r in table.collect():
            truth[r["source"]] += len(words_of(r["text"]))
        order = sorted((s for s in truth if s is not None), key=lambda s: s.encode()) + [None] * (None in truth)
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        left, target, full = 1.5 * sum(truth.values()), {}, set()
        while True:
            share = (left - sum(2 * truth[s] for s in full)) / (sum(weight[s] for s in weight if s not in full) or 1)
            over = {s for s in weight if s not in full and share * weight[s] > 2 * truth[s]}
            if not over:
                break
            full |= over
        target = {s: 2.0 * truth[s] if s in full else share * weight[s] for s in weight}
        taken = defaultdict(int)
        for r in rows:
            assert r["source_size"] == truth[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
            assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
            taken[r["source"]] += r["taken"]
        sizes = defaultdict(list)
        for r in rows:
            sizes[r["source"]].append(r["size"])
        for s in truth:
            assert abs(taken[s] - target[s]) <= max(sizes[s]) / 2 + 1
    assert pareto_mixing.mix(empty).count() == 0


def test_mix_includes_in_proportion_to_size(spark):
    """Over many seeds a document is in the sample about as often as c times its size says."""
    rows = [(i, "w " * (5 + 5 * (i % 4)), "s") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = np.zeros(4)
    for seed in range(6):
        for r in pareto_mixing.mix(table, share=0.4, seed=seed).collect():
            times[r["doc_id"] % 4] += r["copies"]
    assert times[3] > times[1] > times[0] and times.sum() > 0


def test_shards(odd, docs, empty):
    for table, shards in ((odd, 3), (docs, 24)):
        rows = splitter_shards.shard_documents(table, shards=shards).collect()
        truth = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in table.collect()), key=str)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == truth
        held, slots = defaultdict(int), defaultdict(list)
        for r in rows:
            held[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(0 <= s < shards for s in held)
        share, largest = sum(held.values()) / shards, max(r["size"] for r in rows)
        assert max(held.values()) <= share + 1.05 * largest
    assert splitter_shards.shard_documents(empty).count() == 0


def test_one_text_in_most_rows_is_spread_over_shards(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = splitter_shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).groupBy("shard").sum("size").collect()
    held = [r[1] for r in got]
    assert len(held) == 8 and max(held) < 1.05 * sum(held) / 8


def test_equal_texts_stay_together(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"single text number {i} " * int(rng.integers(1, 30))) for i in range(4000)]
    for group in range(150):
        text = f"group {group} " * int(rng.integers(1, 12))
        rows += [(10_000 + 100 * group + i, text) for i in range(int(rng.integers(2, 51)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = 6
    got = splitter_shards.shard_documents(df, shards=shards).collect()
    total = sum(r["size"] for r in got)
    share = total / (shards * splitter_shards.RANGES_PER_SHARD)
    held, of_shard = defaultdict(list), Counter()
    for r in got:
        held[r["text_crc32"]].append(r)
        of_shard[r["shard"]] += r["size"]
    for rs in held.values():
        assert len({r["shard"] for r in rs}) == 1 or sum(r["size"] for r in rs) > share
    assert len(held) == len({t for _, t in rows})
    assert max(of_shard.values()) < 1.03 * total / shards and min(of_shard.values()) > 0.97 * total / shards


def test_equal_rows_are_numbered_over_many_tasks(spark):
    df = spark.range(400_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one same text").alias("text"))
    df = df.unionByName(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("other").alias("text")))
    got = splitter_shards.shard_documents(df, shards=8)
    sizes = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(sizes) == 8 and max(r.b for r in sizes) < 1.03 * sum(r.b for r in sizes) / 8
    assert all(r.n == r.d == r.m + 1 for r in sizes)
    packed = length_buckets.pack(df)
    assert packed.count() == 401_000 == packed.select("bucket", "batch", "place").distinct().count()
    rows = df.filter("doc_id IS NULL").select(F.lit(0).alias("g"), F.monotonically_increasing_id().alias("o"))
    [cuts] = ranking._cuts(rows, "g", "o", 8).collect()
    places = np.searchsorted(np.sort(rows.toPandas()["o"].to_numpy()), [0, *[c["at"] for c in cuts["_cuts"]], 1 << 62])
    assert len(places) in (9, 10) and np.diff(places).max() < 2 * 400_000 / 8


def test_best_borders_equal_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths, counts = np.sort(rng.choice(40, 8, replace=False)) + 1, rng.integers(1, 9, 8)
        cost = lambda b: sum(int(c) * min(x for x in b if x >= v) for v, c in zip(lengths, counts))
        best = min(cost([*c, lengths[-1]]) for c in combinations(lengths[:-1], 2))
        assert cost(length_buckets.best_borders(lengths, counts, 3)) == best


def test_pack(odd, docs, empty):
    for table in (odd, docs):
        rows = length_buckets.pack(table, buckets=5, budget=4096).collect()
        assert sorted(((r["doc_id"], r["size"]) for r in rows), key=str) == sorted(((r["doc_id"], len(words_of(r["text"]))) for r in table.collect()), key=str)
        batches = defaultdict(list)
        for r in rows:
            assert r["padding"] == r["bucket"] - r["size"] >= 0
            batches[r["bucket"], r["batch"]].append(r["place"])
        assert len({b for b, _ in batches}) <= 5
        for (bucket, _), places in batches.items():
            assert sorted(places) == list(range(len(places)))
            assert len(places) == 1 or len(places) * bucket <= 4096
    assert length_buckets.pack(empty).count() == 0


def test_secrets_base_equals_plain_regexes(odd, docs, empty):
    for table in (odd, docs):
        got = {(r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secret_layers.secrets(table).collect()}
        truth = set()
        for r in table.collect():
            text, spans = r["text"] or "", []
            for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
                spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
            for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
                spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
            names = ("assign", "access", "hex")
            digest = hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
            truth.add((r["doc_id"], digest, *(sum(k == i for _, k, _ in spans) for i in range(3))))
        assert got == truth
    assert secret_layers.secrets(empty).count() == 0


SECRET = "password=hunter2hunter2"


@pytest.mark.parametrize(
    "hidden",
    [
        quote(SECRET, safe=""),
        "".join(f"%{b:02X}" for b in SECRET.encode()),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        base64.b64encode(SECRET.encode()).decode(),
        base64.urlsafe_b64encode(SECRET.encode()).decode(),
        base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zlib.compress(base64.b64encode(SECRET.encode()))).decode(),
        base64.b64encode(gzip.compress(bz2.compress(lzma.compress(SECRET.encode())))).decode(),
        base64.b64encode(gzip.compress(b"first ") + gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zlib.compress(b"x^2 + y^2 " + SECRET.encode())).decode(),
        base64.b64encode(quote(base64.b64encode(SECRET.encode()).decode() + " %41", safe="").encode()).decode(),
    ],
)
def test_nested_secrets_are_found_in_place(hidden):
    text = "é before " + hidden + " after 50% off"
    base, every = secret_layers.findings(text)
    assert any(kind == 0 and 9 <= start and end <= 9 + len(hidden) for start, kind, end in every)
    assert set(base) <= set(every)
    masked = secret_layers._masked(text)
    assert masked.startswith("é before ") and masked.endswith(" after 50% off") and "hunter2" not in masked
    assert not secret_layers.findings(masked)[1]


def test_decoding_ends_on_cycles_and_large_data():
    assert secret_layers.findings("%2525252525252541 %25" * 50)[1] == []
    big = base64.b64encode(zlib.compress(b"x" * (9 << 20) + b" " + SECRET.encode() + b" " + b"y" * (5 << 20))).decode()
    assert [(k, s, e) for s, k, e in secret_layers.findings("go " + big + " on")[1]] == [(0, 3, 3 + len(big))]
    twice = base64.b64encode(gzip.compress(gzip.compress(os.urandom(6 << 20).hex().encode() + b" " + SECRET.encode()))).decode()
    assert (0, 3, 3 + len(twice)) in [(k, s, e) for s, k, e in secret_layers.findings("go " + twice + " on")[1]]
    assert [(k, s, e) for s, k, e in secret_layers.findings("so " + base64.b64encode(b"token=a1b2c3").decode())[1]] == [(0, 3, 19)]


def _tar_gz():
    head = b"notes.txt".ljust(100, b"\0") + b"\0" * 412
    return base64.b64encode(gzip.compress(head + SECRET.encode())).decode()


def _wrapped(data, width):
    return re.sub(f"(.{{{width}}})", "\\1\n", base64.b64encode(data).decode())


@pytest.mark.parametrize(
    "hidden",
    [
        _tar_gz(),
        base64.b64encode("caf\xe9 ".encode("latin-1") + SECRET.encode() + b"\x01").decode(),
        "%E9%20" + quote(SECRET, safe=""),
        "".join(f"\\x{b:02x}" for b in b"\xe9 " + SECRET.encode()),
    ],
)
def test_layers_of_any_bytes_are_scanned(hidden):
    assert any(kind == 0 and 7 <= start and end <= 7 + len(hidden) for start, kind, end in secret_layers.findings("before " + hidden + " after")[1])


@pytest.mark.parametrize("width", [12, 64, 76])
def test_wrapped_base64_is_joined(width):
    noise = os.urandom(200).hex().encode()
    for data in (b"x, " * 15 + SECRET.encode(), gzip.compress(noise + b" " + SECRET.encode()), lzma.compress(noise + b" " + SECRET.encode())):
        hidden = _wrapped(data, width)
        assert any(kind == 0 and 7 <= start and end <= 7 + len(hidden) for start, kind, end in secret_layers.findings("before " + hidden + " after")[1])


@pytest.mark.parametrize("before", ["https://x.org/data/", "https://x.org/dat/", "a", "ab-", "abc_"])
def test_base64_is_decoded_from_any_place_of_its_run(before):
    for data in (b"user token=abcdef123456", gzip.compress(b"user token=abcdef123456")):
        hidden = base64.b64encode(data).decode()
        assert any(kind == 0 and len(before) <= start <= end <= len(before + hidden) for start, kind, end in secret_layers.findings(before + hidden + " x")[1])


def test_runs_are_not_split_between_pieces():
    filler = os.urandom(3 << 20)
    inner = base64.b64encode(gzip.compress(filler + b" " + SECRET.encode())).decode()
    for lead in ("word " * 600_000, ""):
        outer = base64.b64encode(gzip.compress((lead + inner + " end").encode())).decode()
        assert (0, 3, 3 + len(outer)) in [(k, s, e) for s, k, e in secret_layers.findings("go " + outer + " on")[1]]


def test_data_that_holds_itself_ends(monkeypatch):
    class Same:
        eof, needs_input = False, True

        def decompress(self, part, most):
            return part

    monkeypatch.setattr(secret_layers, "_opener", lambda head: Same if head else None)
    assert list(secret_layers._inflated(b"the same again")) == ["the same again"]
    assert list(secret_layers._inflated(b"")) == []


def test_url_rules(spark):
    urls = [
        "http://a.net", "http://a.net/", "http://a.net/x?y#z", "https://Example.NET/en/1", "http://b.example.net/en/", "http://example.net/EN/",
        "http://example.com/de/x", "http://xexample.com/de/x", "http://q.org/fr/1", "http://q.org/de/1", "ftp://m.ads-track.example.com/x",
        "no scheme", None, "", "http://", "http://casino.example.org/a", "http://x.org/wp-login.php?a=1", "http://a.net:80/x", "http://casino.net/",
    ]
    rows = [(i, u, "h", "c", "c") for i, u in enumerate(urls)] + [(0, urls[0], "h", "c", "c"), (None, "http://a.net/", "h", "c", "c")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")).collect()
    assert len(got) == len(rows)
    hosts = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    truth = []
    for page, url, *_ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            truth.append((page, host, path, max(fits)[1], max(fits)[2]))
        else:
            low = (url or "").lower()
            does = {r.verdict for r in url_rules.PATTERNS if re.search(r.pattern, low)}
            truth.append((page, host, path, None, "allow" if "allow" in does or not does else "block"))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == sorted(truth, key=str)
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_every_pattern_fetches_its_urls(spark):
    samples = {
        "ad-tracker": ["http://m.ads-track.com/"], "ad-server": ["http://adserver.com/", "http://a.adserver.com/"], "casino": ["http://my-casino.com/"],
        "betting": ["http://sportsbet.com/x", "http://sports-bet.com/x", "http://bet.com/", "http://SportsBet.com/"],
        "adult-host": ["http://xxx.com/"], "adult-path": ["http://a.com/adult/1"], "login-page": ["http://a.com/wp-login.php"],
        "script-folder": ["http://a.com/cgi-bin/x"], "cart": ["http://a.com/cart/add", "http://a.com/cart/checkout"],
        "calendar-trap": ["http://a.com/calendar/2020/1/12/"], "session": ["http://a.com/?PHPSESSID=1"], "program": ["http://a.com/x.exe"],
        "encyclopedia": ["http://encyclopedia.com/", "http://a.encyclopedia.com/"],
    }
    assert samples.keys() == {r.name for r in url_rules.PATTERNS}
    rows = [(i, name, url) for i, (name, url) in enumerate((n, u) for n, urls in samples.items() for u in urls)]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, name string, url string")).collect()
    assert {r["page_id"]: r["pattern"] for r in got} == {i: name for i, name, _ in rows}


def test_rules_of_one_name_and_without_tokens(spark):
    rule = url_rules.Rule
    patterns = (
        rule("same", "block", "/one/", ("one",)),
        rule("same", "block", "/two/", ("two",)),
        rule("digits", "block", "/\\d{6,}", ()),
        rule("half", "allow", "/good/|[?]ok", ("good",), others=((),)),
    )
    hosts = (url_rules.host_rule("block", "a.net/ba"), url_rules.host_rule("allow", "b.net/"), url_rules.host_rule("block", "b.net/"))
    urls = {
        "http://x.org/one/": ("block", "same"), "http://x.org/two/": ("block", "same"), "http://x.org/1234567": ("block", "digits"),
        "http://x.org/one/?ok": ("allow", "half"), "http://x.org/good/": ("allow", "half"), "http://x.org/": ("allow", None),
        "http://a.net/bananas": ("block", None), "http://a.net/bb": ("allow", None), "http://s.b.net/": ("block", None), "": ("allow", None),
    }
    pages = spark.createDataFrame(list(enumerate([*urls, None])), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in url_rules.judge(pages, host_rules=hosts, patterns=patterns).collect()}
    assert got == dict(enumerate([*urls.values(), ("allow", None)]))
    plain = url_rules.judge(pages, host_rules=(), patterns=(rule("any", "block", "org", ()),)).collect()
    assert {r["page_id"] for r in plain if r["verdict"] == "block"} == {i for i, u in enumerate(urls) if "org" in u}
    assert {r["verdict"] for r in url_rules.judge(pages, host_rules=(), patterns=()).collect()} == {"allow"}
    many = tuple(rule(f"r{n}", "block", f"/w{n}/", (f"w{n}",)) for n in range(300))
    some = spark.createDataFrame([(n, f"http://x.org/w{n}/") for n in range(0, 400, 7)], "page_id long, url string")
    got = {r["page_id"]: r["pattern"] for r in url_rules.judge(some, patterns=many).collect()}
    assert got == {n: f"r{n}" if n < 300 else None for n in range(0, 400, 7)}


def kneser_ney(texts):
    """Modified Kneser-Ney from its definition; ``p(gram, out)`` with one occurrence of ``gram`` taken off if ``out``."""
    n = perplexity_rules.ORDER
    tables = [Counter() for _ in range(n)]
    for text in texts:
        row = "\x02" * (n - 1) + text + "\x02"
        tables[-1].update(row[i : i + n] for i in range(len(row) - n + 1))
    for order in range(n - 2, -1, -1):
        tables[order].update(gram[1:] for gram in tables[order + 1])
    cuts = []
    for table in tables:
        times = [sum(v == k for v in table.values()) for k in range(5)]
        d = [0.0, 0.5, 0.75, 0.9]
        if times[1] and times[2]:
            y = times[1] / (times[1] + 2 * times[2])
            raw = [1 - 2 * y * times[2] / times[1], 2 - 3 * y * times[3] / times[2]]
            raw.append(3 - 4 * y * times[4] / times[3] if times[3] else raw[1])
            d[1:] = [min(max(r, 0.05), m) for r, m in zip(raw, (0.95, 1.95, 2.95))]
        cuts.append(d)

    def p(gram, out=False):
        if not gram:
            return 1 / (len(tables[0]) + 1)
        d = cuts[len(gram) - 1]
        own = {g: v for g, v in tables[len(gram) - 1].items() if g[:-1] == gram[:-1]}
        if out:
            own[gram] -= 1
        lower = p(gram[1:], out and not own[gram])
        total = sum(own.values())
        if not total:
            return lower
        left = sum(d[min(v, 3)] for v in own.values()) / total
        seen = own.get(gram, 0)
        return max(seen - d[min(seen, 3)], 0) / total + left * lower

    return p


def test_perplexity_equals_the_definition(spark):
    texts = ["the cat sat on the mat.", "a dog and a cat!", "\u00dcber the cats & dogs \U0001f600", "mat mat mat the the", "zx"]
    other = ["le chat et le chien", "un chat"]
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))  # a document with several pieces
    rows = [(i, t, "en") for i, t in enumerate([*texts, words])] + [(i + 20, t, None) for i, t in enumerate(other)]
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity_rules.judge(spark.createDataFrame(rows, SCHEMA.split(", source")[0])).collect()}
    n = perplexity_rules.ORDER
    for part in ([*texts, words], other):
        p = kneser_ney(part)
        for doc_id, text, _ in [r for r in rows if r[1] in part]:
            row = "\x02" * (n - 1) + text + "\x02"
            logs = [math.log(p(row[i : i + n], True)) for i in range(len(row) - n + 1)]
            starts = range(0, max(len(logs) - perplexity_rules.CHUNK // 2, 1), perplexity_rules.CHUNK)
            pieces = [logs[s:e] for s, e in zip(starts, [*starts[1:], len(logs)])]
            assert math.isclose(got[doc_id], np.median([-sum(x) / len(x) for x in pieces]), rel_tol=1e-9)
    p = kneser_ney(texts)
    for context in ("th", "\x02\x02", "at"):
        chars = {c for t in texts for c in t} | {"\x02"}
        assert math.isclose(sum(p(context + c) for c in chars) + p(context + "?"), 1.0, rel_tol=1e-9)


def test_copies_of_a_text_do_not_judge_it(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").collect() if r["text"]]
    texts = list(dict.fromkeys(texts))
    read = lambda rows: {r["doc_id"]: r for r in perplexity_rules.judge(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("lang", F.lit("en"))).collect()}
    once = read(texts)
    for at in [i for i, r in once.items() if r["kept"]][:3]:
        many = read([*texts, *[texts[at]] * (len(texts) // 2)])
        rows = [many[i] for i in (at, *range(len(texts), len(many)))]
        assert all(r["kept"] for r in rows) and len({r["log_perplexity"] for r in rows}) == 1
        assert abs(rows[0]["log_perplexity"] - once[at]["log_perplexity"]) < 0.03


def test_left_out_copies_equal_the_definition(spark):
    text, texts = "the cat sat on the mat, the cat 12", ["a dog and a cat!", "mat mat mat the the", "zx", "the cattle and the cats"]
    rows = [*texts, text, text, text.replace("12", "34")]  # alike to the model
    got = perplexity_rules.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], SCHEMA.split(", source")[0])).collect()
    n, whole = perplexity_rules.ORDER, Counter()
    folded = lambda t: "\x02" * (n - 1) + re.sub("[0-9]", "0", t) + "\x02"
    grams = lambda t: [folded(t)[i : i + n] for i in range(len(folded(t)) - n + 1)]
    for t in rows:
        whole.update(grams(t))
    times = [sum(v == k for v in whole.values()) for k in range(5)]
    y = times[1] / (times[1] + 2 * times[2])
    raw = [1 - 2 * y * times[2] / times[1], 2 - 3 * y * times[3] / times[2]]
    raw.append(3 - 4 * y * times[4] / times[3] if times[3] else raw[1])
    d = [0.0, *(min(max(r, 0.05), m) for r, m in zip(raw, (0.95, 1.95, 2.95)))]
    p = kneser_ney([re.sub("[0-9]", "0", t) for t in dict.fromkeys([*texts, text])])  # lower orders count each n-gram once
    left = Counter(whole)
    left.subtract(Counter({g: 2 * v for g, v in Counter(grams(text)).items()}))
    logs = []
    for gram in grams(text):
        own = {g: v - (g == gram) for g, v in left.items() if g[:-1] == gram[:-1]}
        total, low = sum(own.values()), p(gram[1:], not own[gram])
        freed = sum(d[min(v, 3)] for v in own.values())
        logs.append(math.log((max(own[gram] - d[min(own[gram], 3)], 0) + freed * low) / total if total else low))
    assert all(math.isclose(r["log_perplexity"], -sum(logs) / len(logs), rel_tol=1e-9) for r in got if r["doc_id"] >= len(texts))


def test_the_model_grows_and_ignores_how_rows_are_dealt(spark):
    rows = [(i, " ".join(f"{chr(97 + (i * 7 + k) % 26)}{chr(97 + k % 26)}{i % 3}" for k in range(80)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA.split(", source")[0])
    one = {r["doc_id"]: r["log_perplexity"] for r in perplexity_rules.judge(docs.coalesce(1)).collect()}
    many = {r["doc_id"]: r["log_perplexity"] for r in perplexity_rules.judge(docs.repartition(7)).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)
    assert not spark.catalog.listTables() or not [t for t in spark.catalog.listTables() if t.name.startswith("perplexity_")]


def blocks_of_texts(texts, seed=0):
    """Rows of one block and language, and the n-grams it counted with parts of their probabilities."""
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "block": 0, "of": 7, "same": [f"{t!r}" for t in texts]})
    grams = pd.concat(list(perplexity_rules._count(iter([docs]))), ignore_index=True).rename(columns={"n": "c"})
    rng = np.random.default_rng(seed)
    whole = {"total": grams["c"].to_numpy() + rng.integers(1, 90, len(grams)), **{t: rng.integers(1, 9, len(grams)) for t in ("t1", "t2", "t3")}}
    grams = grams.assign(**whole, low=rng.random(len(grams)), low_out=rng.random(len(grams)), d1=0.6, d2=1.1, d3=1.5)
    return docs, grams.assign(same=None, copies=None)


@pytest.mark.parametrize("kinds", [20, 400, 5000])
def test_ngrams_of_frequent_and_rare_characters_are_found(kinds):
    rng = np.random.default_rng(kinds)
    draw = np.minimum(rng.zipf(1.3, (80, 2000)), kinds)
    texts = ["".join(map(chr, 0x3000 + row)) + "\U0010ffff\0\x02 \t12" for row in draw]
    docs, grams = blocks_of_texts(texts)
    whole = Counter()
    folded = ["\x02\x02" + re.sub("[\0\x02]", "\ufffd", t).replace("\t", " ").replace("12", "00") + "\x02" for t in texts]
    for t in folded:
        whole.update(t[i : i + 3] for i in range(len(t) - 2))
    assert dict(zip(grams["gram"], grams["c"])) == whole
    values = dict(zip(grams["gram"], perplexity_rules.left_out(*(grams[p].to_numpy() for p in perplexity_rules._PARTS))))
    model = perplexity_rules.Model(grams)
    got = model.log_perplexities(texts, [1] * len(texts))
    assert model.number is not None  # enough characters for the table
    one = perplexity_rules.Model(grams)
    assert [one.log_perplexities([t], [1])[0] for t in texts] == got.tolist() and one.number is None
    for t, found in zip(folded, got):
        logs = [values[t[i : i + 3]] for i in range(len(t) - 2)]
        starts = range(0, len(logs) - perplexity_rules.CHUNK // 2, perplexity_rules.CHUNK)
        pieces = [logs[s:e] for s, e in zip(starts, [*starts[1:], len(logs)])]
        assert math.isclose(found, np.median([-sum(x) / len(x) for x in pieces]), rel_tol=1e-9)
    for large in (texts, texts[:1]):
        with pytest.raises(ValueError):
            model.log_perplexities([*large, "never seen"], [1] * (len(large) + 1))


def test_perplexity_takes_little_time_for_each_character():
    """Counting and judging, measured by a plain count of the same n-grams in Python on the same machine."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(1500)]

    def plain():
        for t in texts:
            Counter(zip(t, t[1:], t[2:]))

    def seconds(what):
        times = []
        for _ in range(3):
            start = time.process_time()
            what()
            times.append(time.process_time() - start)
        return min(times)

    docs, grams = blocks_of_texts(texts)
    count = seconds(lambda: list(perplexity_rules._count(iter([docs]))))
    judge = seconds(lambda: perplexity_rules._measured(docs, grams))
    assert count + judge < 2 * seconds(plain), (count, judge, seconds(plain))


def test_base_measures_equal_plain_python(odd, docs, empty):
    for table in (odd, docs):
        got = perplexity_rules.judge(table).collect()
        truth = []
        for r in table.collect():
            text = r["text"] or ""
            w = words_of(text)
            lines = [x for x in text.split("\n") if words_of(x)]
            where = defaultdict(list)
            for i in range(len(w) - 2):
                where[tuple(w[i : i + 3])].append(i)
            inside = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
            truth.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)))
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(truth, key=str)
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert perplexity_rules.judge(empty).count() == 0


def truth_of_vectors(rows):
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if v is not None and len(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    links = {i: [j for j in unit if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in unit}
    return links


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    seeds = rng.standard_normal((30, 32)).astype(np.float32)
    rows = []
    for i in range(1500):
        v = seeds[i % 30] + rng.standard_normal(32).astype(np.float32) * (0.08 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 30 % 4)))
    nan = float("nan")
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 32, 1), (2003, [nan] * 32, 1), (2004, [None] * 32, 1), (2005, rows[0][1], None)]
    rows += [(2006, rows[0][1], rows[0][2]), (2007, [x * 2 for x in rows[0][1]], rows[0][2]), (2008, [1.0, 2.0], 1), (2009, [1.0, 2.0], 1)]
    table = spark.createDataFrame([(*r, "extra", "n") for r in rows], "vec_id long, embedding array<float>, label int, node string, root string")
    got = {r["vec_id"]: r for r in collision_projections.near_duplicates(table, block=100).collect()}
    links = truth_of_vectors(rows)
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    wanted = sum(map(len, links.values()))
    assert 0.97 * wanted <= found <= wanted
    for i, (vec_id, *_) in enumerate(rows):
        assert got[vec_id]["n_links"] <= len(links.get(i, []))
        assert got[vec_id]["kept"] == (vec_id == got[vec_id]["component_id"])
    for vec_id in (2000, 2001, 2002, 2003, 2004, 2005):
        assert got[vec_id]["n_links"] == 0 and got[vec_id]["component_id"] == vec_id
    assert got[2006]["component_id"] == got[2007]["component_id"] == got[0]["component_id"] == 0
    assert got[2009]["component_id"] == 2008 and got[2009]["n_links"] == 1
    assert collision_projections.near_duplicates(table.limit(0)).count() == 0


def held_out(table, labels, folds, fold, label):
    learns = crc_of_id(F.col("doc_id")) % folds != fold
    return learns, {r["doc_id"]: r[label] for r in labels.filter(~learns).collect()}


def test_quality_on_held_out_labels(spark, odd, empty, labels):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learns, truth = held_out(docs, labels, 4, 2, "quality")
    got = {r["doc_id"]: r["score"] for r in neighbour_quality.score(docs, labels, learns).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    right = [(got[d] >= 0.7) == bool(y) for d, y in truth.items() if d in got]
    assert np.mean(right) > 0.95
    rows = neighbour_quality.score(odd, labels, learns).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert neighbour_quality.score(empty, labels, learns).count() == 0
    assert {r["score"] for r in neighbour_quality.score(odd, labels.limit(0), learns).collect()} == {0.5}


def test_toxicity_on_held_out_labels(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learns, truth = held_out(docs, labels, 3, 1, "toxic")
    grammar = toxicity_grammar.learn(docs, labels, learns)
    got = {r["doc_id"]: r["score"] for r in toxicity_grammar.score(docs, grammar).collect()}
    caught = [got[d] >= 0.7 for d, y in truth.items() if y and d in got]
    clean = [got[d] < 0.7 for d, y in truth.items() if not y and d in got]
    assert np.mean(caught) > 0.85 and np.mean(clean) > 0.97
    rows = toxicity_grammar.score(odd, grammar).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_grammar.score(empty, grammar).count() == 0
    assert toxicity_grammar.learn(empty, labels, learns).insults == {}


def test_grammar_weighs_the_clause():
    grammar = toxicity_grammar.Grammar({"=idiot": 5.0})
    plain, aimed = grammar.score("an idiot"), grammar.score("you idiot")
    negated, told = grammar.score("not an idiot"), grammar.score("he said an idiot")
    assert aimed > plain > told > negated
    assert grammar.score("I will kill you") > 0 and grammar.score("kill time. you") == 0
    assert grammar.score("not. idiot") == plain and grammar.score("idiots") == 0


def test_probe_sentences_in_order():
    score = toxicity_grammar.Grammar({"=idiot": 5.0}).score
    reports = [score(t) for t in ("He said: you are an idiot", "He said, you are an idiot", "He said you are an idiot")]
    assert len(set(reports)) == 1 and reports[0] < 0.7 < score("You are an idiot")
    assert score("I will never hurt you. We will not hurt you.") < 0.3 < 0.7 < score("I will hurt you")
    assert 0 < score("They beat them. We beat them.") < 0.5
    assert score("I am killing you") > 0.7 > score("he shoots them") > 0
    once = score("You are not an idiot.")
    assert once < 0.5 and score("You are not an idiot. " * 40) == once
    assert score("not an idiot " * 500) < 0.7
    assert score("You isn\u2019t an idiot") == score("You isn't an idiot") < 0.5


def test_composed_machine_equals_the_five_one_by_one():
    names = [n for n, _ in toxicity_grammar._SYMBOLS] + ["insult", "other", "pause"]
    words = {n: sorted(w)[0] for n, w in toxicity_grammar._SYMBOLS} | {"insult": "idiot", "other": "stone", "pause": ","}
    grammar = toxicity_grammar.Grammar({"=idiot": 5.0})
    symbol_of = {w: (grammar.symbol(w) or ("other",))[0] if w != "," else "pause" for w in words.values()}
    rng = np.random.default_rng(10)
    for _ in range(400):
        tokens = [words[n] for n in rng.choice(names, rng.integers(1, 14))]
        answers = []
        for machine in toxicity_grammar.MACHINES:  # each alone over the whole sentence
            state, told = 0, []
            for token in tokens:
                state, weight, factor = machine(state, symbol_of[token])
                told.append((weight, factor))
            answers.append(told)
        want = []
        for at in range(len(tokens)):
            weight = answers[0][at][0] * 5.0 + sum(a[at][0] for a in answers[1:])
            if weight:
                want.append(weight * math.prod(a[at][1] for a in answers))
        assert list(grammar.matches(tokens)) == pytest.approx(want)


def _deflated(data, window):
    packer = zlib.compressobj(9, zlib.DEFLATED, window)
    return packer.compress(data) + packer.flush()


def _json_lines(data, width=64):
    return "\\n".join(base64.b64encode(data).decode()[i : i + width] for i in range(0, len(base64.b64encode(data)), width))


SECRET_LINE = b"user: someone, " * 9 + b"token=abcdef123456 " + b"and so on " * 9


@pytest.mark.parametrize(
    "hidden",
    [
        '{"a": "' + _json_lines(gzip.compress(os.urandom(120).hex().encode() + b" " + SECRET_LINE)) + '"}',
        "".join(f"> {line}\n" for line in _wrapped(gzip.compress(SECRET_LINE + os.urandom(90)), 64).split("\n")),
        "\\u{74}oken=abcdef123456",
        "\\U00000074oken=abcdef123456",
        *(base64.b64encode(_deflated(SECRET_LINE, w)).decode() for w in range(9, 16)),
        base64.b64encode("some text token=abcdef123456 more".encode("utf-16")).decode(),
        base64.b64encode("some text token=abcdef123456 more".encode("utf-16-be")).decode(),
        base64.b64encode("token=abcdef123456".encode("utf-32-le")).decode(),
        base64.b64encode(gzip.compress("wide token=abcdef123456 text".encode("utf-16-le"))).decode(),
        '{\\"token\\": \\"abcdef123456\\"}',
    ],
)
def test_further_layers_are_opened(hidden):
    before = "plain words first\n"
    base, every = secret_layers.findings(before + hidden + "\nplain words last")
    assert [k for _, k, _ in every] and any(k == 0 and start >= len(before) and end <= len(before + hidden) + 1 for start, k, end in every), every


def test_spans_of_further_layers():
    for hidden in ("\\u{74}oken=abcdef123456", "\\U00000074oken=abcdef123456"):
        assert secret_layers.findings("ab " + hidden)[1] == [(3, 0, 3 + len(hidden))]
    wide = base64.b64encode("token=abcdef123456".encode("utf-16-le")).decode()
    [(start, kind, end)] = secret_layers.findings("x " + wide + " y")[1]
    assert (start, kind) == (2, 0) and 2 + 44 <= end <= 2 + len(wide)
    assert secret_layers.findings("a\0b\0c token=abc\0")[1] == []


def test_blocks_are_bounded_in_bytes(spark):
    rows = [(i, "word " * (400_000 if i % 5 == 0 else 10), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    size = F.octet_length("text")
    blocks = df.select(size.alias("n"), perplexity_rules._block(F.shiftright(F.monotonically_increasing_id(), 33), size).alias("block"))
    held = blocks.groupBy("block").agg(F.sum("n").alias("bytes")).collect()
    assert sum(r["bytes"] for r in held) == sum(len(t) for _, t, _ in rows)
    assert len(held) >= 2 and max(r["bytes"] for r in held) <= perplexity_rules.BYTES_PER_BLOCK


def test_a_text_of_a_million_words(spark):
    text = " ".join(f"w{i % 977} and{i % 31}" for i in range(500_000)) + " password=abcdef123456"
    rows = [(i, f"short text number {i} of some words here", "en", "s") for i in range(30)] + [(99, text, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {r["doc_id"]: r["n_words"] for r in perplexity_rules.judge(df).collect()}
    assert judged[99] == 1_000_001 and len(judged) == 31
    assert {r["doc_id"]: r["n_assign"] for r in secret_layers.secrets(df).collect()}[99] == 1
    assert {r["doc_id"]: r["component_id"] for r in tensored_minhash.near_duplicates(df.filter("doc_id > 27")).collect()}[99] == 99


def test_quality_votes_by_hand(spark):
    """Frequencies over all documents, and every vote, recomputed one document at a time."""
    words = ["alpha", "Beta", "gamma!", "12", "delta,", "#x", "eps\nilon", "zeta|"]
    rows = [(i, " ".join(words[(i * k * k + k) % len(words)] * (1 + (i + k) % 3) for k in range(4 + i % 9))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "xyz " * 3000), (203, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = {i: i % 3 == 0 for i in range(60)}
    labels = spark.createDataFrame([(i, int(y)) for i, y in known.items()], "doc_id long, quality int")
    got = {(r["doc_id"]): r["score"] for r in neighbour_quality.score(docs, labels, F.lit(True), per_label=1000).collect()}
    made = [(i, neighbour_quality.terms(text).astype(float)) for i, text in rows]
    documents, frequency = neighbour_quality.document_frequencies(docs)
    held = [sum(1 for _, vector in made if vector[t] > 0) for t in range(neighbour_quality.TERMS)]
    assert documents == len(rows) and frequency.tolist() == held
    weight = [math.log((1 + len(rows)) / (1 + n)) + 0.3 for n in held]
    sample = [(known[i], vector * weight) for i, vector in made if i in known]
    middle = sum(vector for _, vector in sample) / len(sample)
    _, _, axes = np.linalg.svd(np.stack([vector - middle for _, vector in sample]), full_matrices=False)

    def placed(vector):
        inner = axes[: neighbour_quality.RANK] @ (vector - middle)
        return inner / max(np.linalg.norm(inner), 1e-9)

    voters = [(y, placed(vector)) for y, vector in sample]
    for i, vector in made:
        if not vector.any():
            assert got[i] == pytest.approx(sum(known.values()) / len(known))
            continue
        place = placed(vector * weight)
        near = sorted(((float(place @ other), y) for y, other in voters), reverse=True)[: neighbour_quality.NEAREST]
        powers = [(max(cosine, 0.0) ** neighbour_quality.SHARPEN, y) for cosine, y in near]
        share = sum(known.values()) / len(known)
        expected = (sum(p for p, y in powers if y) + 1e-6 * share) / (sum(p for p, _ in powers) + 1e-6)
        assert got[i] == pytest.approx(expected, abs=2e-3)
