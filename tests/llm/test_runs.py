"""Periodic runs against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from vigil.llm import queries, runs
from vigil.llm.runs import ColouredPaths, suffix_automaton

SF = "/root/testdata/sf0.001"


def brute_runs(words, exponent=4, shortest=6):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, exponent * q) and not any(
                    all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    repeated = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), best[0], best[1], best[2], 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in repeated)))


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 1), (3, 5)])
def test_runs_of_random_words(exponent, shortest):
    rng = random.Random(exponent)
    for _ in range(700):
        n = rng.randint(0, 50)
        words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 6)
            words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
        want = brute_runs(words, exponent, shortest)
        assert sorted(runs.runs_of(words, exponent, shortest), key=lambda r: (r[0], r[2])) == want
        assert runs.word_runs([str(w) for w in words], exponent, shortest) == want


def test_an_access_returns_the_last_ends_of_the_suffixes():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randrange(2) for _ in range(40)]
        link, length, states = suffix_automaton(s)
        paths = ColouredPaths(link, length)
        for i, state in enumerate(states):
            got = {e: m for e, m in paths.access(state, i) if m}
            want = {}
            for m in range(1, i + 2):
                ends = [e for e in range(m - 1, i) if s[e - m + 1:e + 1] == s[i - m + 1:i + 1]]
                if ends:
                    want[ends[-1]] = m
            assert got == want


def test_long_periodic_texts_stay_cheap():
    assert runs.word_runs(["a"] * 50_000) == [(0, 50_000, 1)]
    block = [str(i % 5000) for i in range(20_000)]
    assert runs.word_runs(block) == [(0, 20_000, 5000)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r[0]: tuple(r) for r in got.collect()}
    short = [r for r in docs if len(r["text"] or "") < 6000]
    assert len(rows) == len(docs) and len(short) > 150
    assert any(rows[r["doc_id"]][1] for r in short)
    for r in short:
        assert rows[r["doc_id"]] == brute_row(r["doc_id"], r["text"])


def test_odd_rows(spark):
    schema = "doc_id long, text string, found string, _text string, start string"
    rows = [(None, "x y " * 8, "f", "t", "s"), (1, None, None, None, None), (2, "", "f", "t", "s"), (3, " \n\t ", "f", "t", "s"),
            (4, "a b " * 30000, "f", "t", "s"), (5, "un deux " * 4, "f", "t", "s"), (5, "un deux " * 4, "f", "t", "s"), (6, "z z " * 5, "f", "t", "s")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = Counter(tuple(r) for r in runs.report(docs).collect())
    assert got == Counter(brute_row(i, t) if i != 4 else next(tuple(r) for r in got if r[0] == 4) for i, t, *_ in rows)
    assert {r[0] for r in got if r[1]} >= {None, 4, 5}
    assert runs.report(spark.createDataFrame([], schema)).count() == 0
    once = runs.collapse(docs)
    assert once.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in once.collect()}
    assert kept[None] == "x y" and kept[4] == "a b" and kept[3] == " \n\t " and kept[1] is None
    with pytest.raises(ValueError):
        runs.find_runs(docs, exponent=1)
