"""Conversation prefix trie and license scan against brute force, and at their edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from chronoweave.llm import conversation_trie, license_scan, nearest_smaller
from chronoweave.llm.shared import Scratch

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        convs[c] = own.get(base, [])[:h] + ts[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
        ends[tuple(ts)].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], sha))
    return sorted(out, key=repr)


def trie_rows(spark, rows):
    got = conversation_trie.trie(spark.createDataFrame(rows, TURNS))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(map(tuple, got.collect()), key=repr)


def some_conversations(rng, n, words=3, longest=12):
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, longest])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "çç", "", None][:words])))
    return rows


@pytest.mark.parametrize("block,chunk,words", [(4096, 1024, 3), (4, 3, 2), (3, 2, 1)])
def test_trie(spark, monkeypatch, block, chunk, words):
    """Small blocks and chunks, so that several levels of minima and of chunks are needed; copies, prefixes of others,
    and conversations alike through many chunks."""
    monkeypatch.setattr(nearest_smaller, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    rng = random.Random(block)
    rows = some_conversations(rng, 60, words)
    rows += [(c, t, "user", "same") for c in (100, 103, 104, 106) for t in range(20 + (c == 106))]
    rows += [(200, None, None, None), (200, 5, "user", "x"), (200, 5, "user", "x"), (200, 5, "assistant", "w"), (None, 1, "user", "nobody's"), (-3, 0, "user", "below")]
    rng.shuffle(rows)
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_few(spark):
    assert trie_rows(spark, []) == []
    for rows in ([(7, 0, "user", "a")], [(0, 0, "user", "a"), (1, 0, "user", "a")], [(3, t, "r", "s" * 100_000) for t in range(30)]):
        assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_with_clashing_columns(spark):
    names = ["k", "l", "m", "place", "part", "row", "depth", "id", "chunk", "tie", "h", "own"]
    rows = some_conversations(random.Random(5), 10)
    wide = spark.createDataFrame([(*r, *[0] * len(names)) for r in rows], TURNS + "".join(f", {c} int" for c in names))
    assert sorted(map(tuple, conversation_trie.trie(wide).collect()), key=repr) == brute_trie(rows)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_nearest_smaller_values(spark, monkeypatch, block):
    monkeypatch.setattr(nearest_smaller, "BLOCK", block)
    rng = random.Random(block)
    for n, top in ((1, 2), (37, 3), (120, 40)):
        v = [rng.randrange(top) for _ in range(n)]
        low, leaves, shared = ([rng.randrange(100) for _ in range(n)] for _ in range(3))
        data = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(v, low, leaves, shared, strict=True))], "k long, v long, low long, leaves long, shared long")
        got = {r["k"]: r for r in nearest_smaller.nearest_smaller(data, n - 1, Scratch(spark, "test")).collect()}
        for i in range(n):
            left = next((k for k in range(i - 1, -1, -1) if v[k] < v[i]), None)
            right = next((k for k in range(i + 1, n) if v[k] < v[i]), None)
            for side, at, between in (("l", left, range((-1 if left is None else left) + 1, i)), ("r", right, range(i + 1, n if right is None else right))):
                want = (at, None if at is None else v[at], min((low[k] for k in between), default=None), sum(leaves[k] for k in between), sum(shared[k] for k in between))
                assert tuple(got[i][f"{side}_{c}"] for c in ("pos", "val", "low", "leaves", "shared")) == want


def test_inside_of_a_hot_block():
    e = pd.DataFrame({"k": np.arange(4096), "v": np.zeros(4096, np.int64), "low": np.arange(4096), "leaves": 1, "shared": 2, "block": 0})
    out = nearest_smaller._inside(e)
    assert out["l_pos"].isna().all() and out["r_leaves"].tolist() == list(range(4095, -1, -1))


def brute_licenses(text):
    words = license_scan.template_words(text or "")
    starts, base = [], set()
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        starts += at
        base |= {label} if at else set()
    found, best = set(), 0.0
    for t in license_scan.TEMPLATES:
        own = license_scan.template_words(t.text)
        step = 8
        while step < len(own):
            step *= 2
        for i in range(0, len(words), step):
            n = len(set(own) & set(words[i : i + 2 * step]))
            if n >= t.share * len(set(own)) - 1e-9:
                found.add(t.label)
                best = max(best, n / len(set(own)))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best)


def license_rows(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(docs).collect()}


def test_licenses(spark):
    """Templates with words left out, added and moved, at any place, next to each other and amid their own words."""
    rng = random.Random(12)
    pool = [w for t in license_scan.TEMPLATES for w in license_scan.template_words(t.text)] + [f"w{k}" for k in range(40)]
    texts = ["under the mit license under the MIT License", "cc by nc cc-by-nc", "Apache License, Version 2.0", "apache license\x7fversion 2É", "ſunder the mit licenseK", "İ under the mit license"]
    for k in range(150):
        words = rng.choices(pool, k=rng.choice([0, 3, 30, 200]))
        for _ in range(rng.randrange(3)):
            t = license_scan.template_words(rng.choice(license_scan.TEMPLATES).text)
            for _ in range(rng.randrange(len(t) // 3 + 1)):
                t[rng.randrange(len(t))] = rng.choice(pool)
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        texts.append(rng.choice([" ", "\n", ", "]).join(words).title() if k % 3 else " ".join(words))
    got = license_rows(spark, texts)
    want = {k: brute_licenses(t) for k, t in enumerate(texts)}
    assert got == want
    assert {label for w in want.values() for label in w[5].split(",")} >= {t.label for t in license_scan.TEMPLATES}


def test_license_edges(spark):
    text = "Released under the MIT License. " + "word " * 200_000 + "Licensed under CC BY-NC 4.0."
    extra = ["row", "words", "step", "rank", "label", "own", "hits", "spaced", "n_words"]
    rows = [(1, None), (None, "some cc by nc text"), (2, ""), (3, " \n,.;"), (4, text), (5, "gnu"), (5, "gnu")]
    docs = spark.createDataFrame([(*r, *[0] * len(extra)) for r in rows], "doc_id long, text string" + "".join(f", {c} int" for c in extra))
    got = sorted((tuple(r) for r in license_scan.scan(docs).collect()), key=repr)
    assert got == sorted(((i, *brute_licenses(t)) for i, t in rows), key=repr)
    assert license_scan.scan(docs.where("false")).count() == 0
    for wrong in ([license_scan.Template("x", "...")], [license_scan.Template("x", "a", 0.0)], [license_scan.Template("it's", "a")]):
        with pytest.raises(ValueError):
            license_scan.scan(docs, wrong)
    own = license_scan.scan(docs, [license_scan.Template("gnu", "gnu")]).where("doc_id = 5").collect()
    assert [(r["labels"], r["base_labels"], r["score"]) for r in own] == [("gnu", "", 1.0)] * 2


def test_license_scan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
