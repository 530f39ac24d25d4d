"""Training-data operators against brute force, and on odd input: nulls in any
column, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import bpe, cascade, huffman, imatch, lm, mixing, queries, secrets, simhash, template, toxicity

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, fp string, word string, h string, "
          "n string, src string, size string, range string, bucket string, spans string, ids string, _row string, tie string")
EXTRA = ("x",) * 13


def text_of(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "wort", "été", "tion", "ing"]) + rng.choice(["", "s", "er", "a"])
                    for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty text, white space only, exact and repeated copies, a long text, null source."""
    rng = random.Random(4)
    base = text_of(rng, 60)
    rows = [(1, base, "en", "a", len(base)), (2, base, "en", None, None), (3, None, None, "b", None), (4, "", "en", "a", 0),
            (5, " \n\t ", None, "b", 4), (None, base, "en", "a", 1), (None, None, None, None, None),
            (6, text_of(rng, 30000), "de", "a", 5), (7, text_of(rng, 40), "de", "c", 5), (7, text_of(rng, 41), "de", "c", 5),
            (8, "password = hunter2hunter2 and AKIA" + "Q" * 20 + " x " + "0123456789abcdef" * 3, "en", "c", 9)]
    rows += [(9, text_of(rng, 25), "fr", "b", 3)] * 3
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, text string")


OPERATORS = {
    "op1": lambda s, d: simhash.near_duplicates(d), "op2": lambda s, d: mixing.mix_report(d),
    "op3": lambda s, d: toxicity.score(d, labels(s, [(1, 0, "t"), (2, 1, None), (7, 0, "t"), (None, 1, "t"), (9, None, "t")])),
    "op4": lambda s, d: lm.score(d, RANKS, public_tokenizers.PATTERN, top=64, steps=2),
    "op5": lambda s, d: secrets.find_secrets(d), "op6": lambda s, d: cascade.quality_report(d),
    "op7": lambda s, d: imatch.report(d), "op10": lambda s, d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_one_row_each_and_empty_tables_none(spark, odd, none, name):
    got = OPERATORS[name](spark, odd)
    assert got.count() == odd.count()
    want = Counter(r[0] for r in odd.select("doc_id").collect())
    assert Counter(r[0] for r in got.select("doc_id").collect()) == want
    assert OPERATORS[name](spark, none).count() == 0


def test_token_file_of_odd_rows(spark, odd, none, tmp_path):
    for i, d in enumerate((odd, none)):
        huffman.write_tokens(d, f"{tmp_path}/{i}", public_tokenizers.path("byte_bpe_50k.json"))
        got = huffman.read_tokens(spark, f"{tmp_path}/{i}").orderBy("start").collect()
        assert len(got) == d.count()
        at = 0
        for r in got:
            assert r["start"] == at and r["ids"][-1] == 0 and len(r["ids"]) == r["n_tokens"]
            at += r["n_tokens"]
        known = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert known == sorted(known) and all(r["doc_id"] is None for r in got[len(known):])


def test_stages_on_odd_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (odd, none):
            got = stage(spark, d, SF)
            assert got.columns == odd.columns
            assert got.count() <= 3 * odd.count() + 60 and (d is odd or got.count() == 0)
    got = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert got.count() == odd.count() and got.filter("not intact").isEmpty()
    kept = simhash.keep_one(odd)
    ids = Counter(r[0] for r in kept.select("doc_id").collect())
    assert ids[1] == 1 and 2 not in ids and ids[9] == 1 and None not in ids
    rows = [(5, "a b c d"), (5, "w x y z q"), (4, "a b c d"), (None, "only here u v"), (None, "only here u v"), (None, "w x y z q")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert Counter(tuple(r) for r in kept.collect()) == {(5, "w x y z q"): 1, (4, "a b c d"): 1, (None, "only here u v"): 1}


def test_near_copies_of_a_hot_group_stay_alike(spark):
    """A third of the rows are near copies, one word of 60 changed."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = [f"v{rng.randrange(900)}" for _ in range(60)]
        if i < 200:
            words = list(base)
            words[rng.randrange(60)] = f"v{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r for r in imatch.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    near = sorted(got[i]["near_next"] for i in range(1, 200))
    assert near[len(near) // 2] > 0.5 and sum(x > 0.3 for x in near) > 0.9 * len(near)
    far = [got[i]["near_next"] for i in range(201, 600)]
    assert sum(far) / len(far) < 0.05


# --- op1 ----------------------------------------------------------------------

def brute_fingerprint(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= budget:
            ra, rb = top(a), top(b)
            root[max(ra, rb)] = min(ra, rb)
    groups = defaultdict(set)
    for f in fps:
        groups[top(f)].add(f)
    return {frozenset(g) for g in groups.values()}


def clustered(rng, n):
    out = set()
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(f)
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
    return out


def test_trie_walk_is_complete():
    rng = random.Random(1)
    for _ in range(5):
        a = np.array(sorted(clustered(rng, 300)), np.uint64)
        i, j = simhash.walk(a, None, 0, 0, 2, frontier=50)
        assert {(x, y) for x, y in zip(i.tolist(), j.tolist())} == {
            (x, y) for x, y in combinations(range(len(a)), 2) if int(a[x] ^ a[y]).bit_count() <= 2}


@pytest.mark.parametrize("node_size,task_rows", [(1000, 20000), (20, 30)])
def test_trie_links_connect_what_brute_force_connects(spark, node_size, task_rows):
    fps = clustered(random.Random(2), 400)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    links = simhash.trie_links(frame, len(fps), 2, node_size, task_rows)
    got = defaultdict(set)
    seen = set()
    for r in simhash.components(links).collect():
        got[r["root"]].add(r["node"] % (1 << 64))
        seen.add(r["node"] % (1 << 64))
    groups = {frozenset(g) for g in got.values()} | {frozenset([f]) for f in fps - seen}
    assert groups == brute_components(fps, 2)


def test_near_duplicates_match_brute_force(spark, docs):
    rows = docs.collect()
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    low = {}
    for g in brute_components(set(fp.values()), 2):
        m = min(d for d, f in fp.items() if f in g)
        low |= {f: m for f in g}
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{f:016x}", low[f]) for d, f in fp.items()}


# --- op2 ----------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    w = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [n for n in names if n not in capped]
        rest = total - sum(capped.values())
        over = [n for n in free if w[n] * rest / sum(w[m] for m in free) > 3 * sizes[n]]
        if not over:
            return capped | {n: w[n] * rest / sum(w[m] for m in free) for n in free}
        capped |= {n: 3.0 * sizes[n] for n in over}


def test_mix_meets_targets_and_is_repeatable(spark, docs):
    small = docs.withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("source"))) \
        .withColumn("source", F.when((F.col("source") == "src2") & (F.col("doc_id") > 50), F.lit("src3")).otherwise(F.col("source")))
    got = mixing.mix_report(small, block_words=64).toPandas()
    sizes = {None if pd.isna(k) else k: int(v) for k, v in
             small.select("source", mixing.word_count().alias("n")).groupBy("source").agg(F.sum("n")).collect()}
    want = brute_targets(sizes)
    src = {r["doc_id"]: r["source"] for r in small.collect()}
    got["src"] = [src[d] for d in got.doc_id]
    for name, g in got.groupby("src", dropna=False):
        key = None if pd.isna(name) else name
        assert g.target.iloc[0] == pytest.approx(want[key]) and (g.source_size == sizes[key]).all()
        assert g.taken.sum() == round(want[key])
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix_report(small.repartition(5), block_words=64).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_mix_pieces_sum_up_and_shards_are_disjoint_ranges(spark, docs):
    pieces = mixing.mix(docs, block_words=64, shards=8).select(F.col("row.doc_id").alias("d"), "shard", "epoch", "lo", "hi").toPandas()
    taken = pieces.assign(n=pieces.hi - pieces.lo).groupby("d").n.sum().to_dict()
    report = mixing.mix_report(docs, block_words=64, shards=8).toPandas()
    assert taken == {d: t for d, t in zip(report.doc_id, report.taken) if t}
    words = pieces.assign(n=pieces.hi - pieces.lo).groupby("shard").n.sum()
    assert len(words) == 8 and words.max() < 1.2 * words.min()
    n = np.full(1000, 1000)
    assert sorted(mixing.permute(np.arange(1000), n, np.full(1000, 9)).tolist()) == list(range(1000))
    assert mixing.word_slice("  a bb  c d ", 1, 3) == "bb  c"


def test_report_sums_what_the_tree_deals(spark, docs, monkeypatch):
    whole_tree, nodes = mixing._hypergeometric, []
    monkeypatch.setattr(mixing, "_hypergeometric", lambda rng, counts, draws: nodes.append(draws) or whole_tree(rng, counts, draws))
    twice = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("text"), "source")
    twice = twice.unionByName(twice)  # repeated rows and rows without words
    got = mixing.mix_report(twice, block_words=64, shards=8).toPandas()
    assert len(nodes) == 7
    assert len(got) == 2 * docs.count() and (got.taken[got["size"] == 0] == 0).all()
    assert (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source_size"):
        assert g.taken.sum() == round(g.target.iloc[0])


# --- op3 ----------------------------------------------------------------------

def brute_kernel(s, t):
    def phi(w):
        w, d = "^" + w, defaultdict(float)
        for c in combinations(range(len(w)), toxicity.ORDER):
            if c[-1] - c[0] < toxicity.SPAN:
                d["".join(w[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return d
    a, b = phi(s), phi(t)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def test_string_kernel_is_the_brute_force_sum():
    marks = ["idiot", "banana", "trashcan"]
    matrix, rows = toxicity.vectors(marks)
    words = ["idxiot", "bananana", "trash", "idiot", "unrelatedly"]
    got = toxicity.features(words, matrix, rows)
    assert np.allclose(got, [[brute_kernel(w, m) for m in marks] for w in words], atol=1e-5)


def test_toxicity_finds_gapped_insults_on_held_out_rows(spark):
    rng = random.Random(3)
    insults = ["blorvax", "snorkit", "grumwel"]
    texts, marks = [], []
    for i in range(500):
        body = " ".join("".join(rng.choice("aeioubcdflmnprst") for _ in range(rng.randint(3, 8))) for _ in range(30)).split()
        bad = i % 4 == 0
        if bad:
            body[rng.randrange(30)] = rng.choice(insults)
        texts.append((i, " ".join(body) + ". Fine words here."))
        marks.append((i, int(bad), None))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = toxicity.score(d, labels(spark, marks)).toPandas().sort_values("doc_id")
    held = got[got.held_out]
    assert (held.predicted.to_numpy() == (held.doc_id.to_numpy() % 4 == 0)).mean() > 0.95
    assert (got.held_out.to_numpy() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)]).all()
    model = toxicity.train([([toxicity.folded(t.split())], m[1]) for (_, t), m in zip(texts, marks)])
    margin = toxicity.best_margins(["so blorvax", "so b.l.o.r.v.a.x", "so b l o r v a x", "kind regards", ""], toxicity.Memory(model))
    assert margin[0] == pytest.approx(margin[1]) == pytest.approx(margin[2]) and margin[0] > margin[3]


# --- op4 ----------------------------------------------------------------------

def test_base_score_is_the_brute_force_sum(spark, docs):
    got = lm.score(docs, RANKS, public_tokenizers.PATTERN, top=256, steps=4, hot_words=100).toPandas()
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    train = [d for d in words if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for d in train for w in words[d])
    c["<end of text>"] = len(train)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        tokens = [*words[r.doc_id], "<end of text>"]
        assert r.base_score == pytest.approx(sum(math.log10((c.get(t, 0) + 1) / (n + v + 1)) for t in tokens))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in c for t in tokens), n)
        assert r.held_out == (r.doc_id not in train) and r.score < 0


def small_model():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 40, 4000)
    unigrams = np.bincount(ids, minlength=50)
    top = np.append(np.argsort(-unigrams, kind="stable")[:29], 49)
    symbol = np.full(50, 30)
    symbol[top] = np.arange(30)
    s = symbol[ids]
    pairs = np.bincount(s[:-1] * 31 + s[1:], minlength=31 * 31).reshape(31, 31)
    t = lm.tables(unigrams, pairs, top, 49, classes=5)
    w = lm.fresh(31, 5)
    w["out"] = w["out"] * 30
    return t, w


def test_symbols_and_network_come_from_every_training_text(spark):
    rows = [(i, f"{w} " * 40) for i, w in enumerate(["water", "house", "green", "music", "paper", "light", "river", "stone"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs, RANKS, public_tokenizers.PATTERN, sample_rows=1, steps=0)
    flat, _ = lm.words_of(RANKS, public_tokenizers.PATTERN).ids(lm.cut([w for i, w in rows if zlib.crc32(str(i).encode()) % 7 != 2]))
    used = np.unique(flat)
    symbols = model.tables.symbol[used]
    assert len(set(symbols.tolist())) == len(used)
    start = lm.fresh(*model.params["embed"].shape[:1], model.tables.prior.shape[1])["embed"]
    assert (model.params["embed"][symbols] != start[symbols]).any(1).all()


def test_model_is_a_distribution_and_windows_score_each_id_once():
    t, w = small_model()
    scorer = lm.Scorer(w, t)
    context = np.array([3, 7, 1])
    total = sum(10 ** scorer.score([np.append(context, i)])[0] for i in range(50))
    assert total == pytest.approx(10 ** scorer.score([context])[0], rel=1e-4)
    long = np.random.default_rng(1).integers(0, 50, 200)
    whole = scorer.score([long])[0]
    parts = 0.0  # each stride again, with its overlap only
    for k in range(0, 200, lm.STRIDE):
        lo = max(0, k - lm.OVERLAP)
        if k == 0:
            parts += scorer.score([long[:lm.STRIDE]])[0]
        else:
            inp = t.symbol[np.append(long, 0)[lo - 1:k + lm.STRIDE - 1]]
            inp = np.pad(inp, (0, lm.WIDTH - len(inp)))[None]
            tgt = t.symbol[long[k:k + lm.STRIDE]]
            tgt = np.pad(tgt, (0, lm.STRIDE - len(tgt)), constant_values=-1)[None]
            parts += (scorer._windows(inp, tgt, np.array([False]))[0] + t.share[long[k:k + lm.STRIDE]].sum()) / math.log(10)
    assert whole == pytest.approx(parts, rel=1e-4)


def test_new_words_are_encoded_in_one_call_and_as_one_by_one(monkeypatch):
    from types import SimpleNamespace
    enc = lm.Words(RANKS, public_tokenizers.PATTERN)
    engine, calls = enc._engine, []

    def spy(name):
        return lambda *a, **b: calls.append(name) or getattr(engine, name)(*a, **b)

    enc._engine = SimpleNamespace(encode_ordinary=spy("encode_ordinary"), encode_to_numpy=spy("encode_to_numpy"))
    words = ["water", "it's", "'s", "12ab,", "\x1f", "été", "x\u00a0", "\u00a0y", "\u2003", "\u3000z\u2003\u2003", "\u00a0\u00a0q", "日本", "<|endoftext|>", "\x85", "ab" * 50]
    words += [f"{w}{i}" for i in range(40) for w in ("der", "ion.", "\u00a0é")]
    texts = [" ".join(words), "", " water\tnew ", " ".join(reversed(words))]
    flat, bounds = enc.ids(lm.cut(texts))
    for t, a, b in zip(texts, bounds, bounds[1:]):
        alone = [i for w in lm.cut([t]).words if w for i in engine.encode_ordinary(" " + w)]
        assert flat[a:b].tolist() == [*alone, enc.end]
    assert calls.count("encode_to_numpy") == 1 and len(calls) < 10
    monkeypatch.setattr(lm, "CACHE", 7)
    again, _ = lm.Words(RANKS, public_tokenizers.PATTERN).ids(lm.cut(texts))
    assert (again == flat).all()


def test_training_windows_of_texts_in_a_row_are_those_of_each():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 9, n) for n in (1, 31, 32, 33, 64, 65, 200)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    together = lm._sequences(np.concatenate(parts), 9, bounds)
    assert (together == np.concatenate([lm._sequences(x, 9) for x in parts])).all()
    assert (together[:, 1:] >= 0).sum() == bounds[-1] and (together[0] == [9, parts[0][0], *[-1] * 31]).all()


def test_each_text_is_encoded_once_for_all_passes(spark, docs):
    every, hot = lm._coded(docs, RANKS, public_tokenizers.PATTERN, "text", "doc_id", ["the", "of", "no-such-word"])
    enc = lm.words_of(RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in every.withColumnRenamed("id", "doc_id").collect()}
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    train = [t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(got) == len(texts) and sum(r["train"] for r in got.values()) == len(train)
    assert hot == {w: sum(t.encode().lower().split().count(w.encode()) for t in train) for w in ("the", "of", "no-such-word")}
    for i, t in texts[:50]:
        flat, _ = enc.ids(lm.cut([t]))
        packed = lm._packing().decompress(got[i]["ids"], got[i]["n"] * enc.kind.itemsize, asbytes=True)
        assert (np.frombuffer(packed, enc.kind) == flat).all()
    flat = np.concatenate([enc.ids(lm.cut([t]))[0] for t in train])
    assert (lm._unigrams(every.filter("train").select("n", "ids"), enc) == np.bincount(flat, minlength=enc.size)).all()


def test_gradient_is_the_slope_of_the_loss():
    t, w = small_model()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x = np.random.default_rng(2).integers(0, 31, (3, lm.WIDTH + 1))
    x[2, 20:] = -1
    loss, g = lm.gradient(w, t, x)
    rng = np.random.default_rng(3)
    for name in w:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            keep = w[name][at]
            w[name][at] = keep + 1e-4
            up = lm.gradient(w, t, x)[0]
            w[name][at] = keep - 1e-4
            down = lm.gradient(w, t, x)[0]
            w[name][at] = keep
            assert (up - down) / 2e-4 == pytest.approx(float(g[name][at]), abs=2e-4)


# --- op5 ----------------------------------------------------------------------

def test_secret_spans(spark):
    key = "0123456789abcdef0123456789"
    rows = [(1, f"é password = \"abc123xyz\" and token:{key}"), (2, "AKIA" + "A1" * 10), (3, "AKIASHORT secret=abc"), (4, None),
            (5, "PASSWD:  'QWERTY99' pass"), (6, "ſecret=abcdefgh")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "crf"]
           for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    t = rows[0][1]
    at = t.index("token")
    assert got == {1: [("assign", 2, 2 + len('password = "abc123xyz')), ("assign", at, len(t)), ("hex", t.index(key), len(t))],
                   2: [("access", 0, 24)], 3: [], 4: [], 5: [("assign", 0, len("PASSWD:  'QWERTY99"))], 6: []}
    assert secrets.replaced(t, secrets.base_spans(t, t.encode()), "*") == "é password = \"*\" and token:*"


def test_windowed_decoding_equals_viterbi_over_all_tokens(spark, docs):
    field = secrets.fit(docs.unionByName(docs.withColumn("text", F.concat(F.lit("api_key: 0a1b2c3d4e5f60718293a4b5 "), "text"))))
    found = 0
    for r in docs.limit(60).collect():
        t = secrets.tokenize("api_key: 77ab0192837465ffab019283 " + (r["text"] or ""))
        e = field.emissions(t.features())
        y = field.decode(e)
        assert np.array_equal(y, field.viterbi(e))
        found += (y == secrets.BEGIN).any()
    assert found > 50


# --- op6, op7 -------------------------------------------------------------------

def test_repeated_words_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        words = [bytes([rng.choice(b"ab")]) for _ in range(rng.randint(0, 60))]
        n = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        hit = {k for i in range(len(words) - 7) if n[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
        assert cascade.repeated_words(words) == len(hit)


def test_rules_run_by_rejections_per_cost():
    rules = cascade.default_rules()
    got = cascade.order_rules(rules, {"too_few_words": (0.1, 1.0), "repeated_words": (0.5, 100.0), "symbol_heavy": (0.2, 1.0),
                                      "duplicate_lines": (0.0, 1.0), "word_length": (0.3, 1.0)})
    assert [r.name for r in got] == ["word_length", "symbol_heavy", "too_few_words", "repeated_words", "duplicate_lines"]


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_imatch"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    pd.testing.assert_frame_equal(got.sort_values("doc_id").reset_index(drop=True), want.sort_values("doc_id").reset_index(drop=True),
                                  check_dtype=False)


def test_next_documents_over_several_ranges(spark, docs):
    got = {r["id"]: r["next"] for r in imatch.with_next(docs).collect()}
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    assert got == {r["doc_id"]: n["text"] for r, n in zip(rows, rows[1:] + rows[:1])}


# --- op8 ----------------------------------------------------------------------

def test_main_text(spark):
    page = ("<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-banner'>c</div><article><h1>A &amp; B</h1>"
            "<p><b>one\n two<p>three&nbsp;four<br>five<script>x</script><aside>no</aside></article><div id=comments>r</div><footer>f</footer>")
    same = "".join("<div class=box>Read our great weekly letter</div>")
    rows = [(1, "http://a.x/1", page), (2, None, None), (3, "http://b.x", "")]
    rows += [(10 + i, f"https://Site.example/{i}", f"<body>{same}<div><p>own text {i}</p></div></body>") for i in range(6)]
    rows += [(10, "https://site.example/0", rows[3][2])]
    got = template.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, hashes string"))
    out = Counter((r["page_id"], r["text"], r["n_chars"]) for r in got.collect())
    text = "A & B\none two\nthree four five"
    want = Counter([(1, text, len(text)), (2, "", 0), (3, "", 0), (10, "own text 0", 10)] + [(10 + i, f"own text {i}", 10) for i in range(6)])
    assert out == want
    assert template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert template.blocks("<div>" * 5000 + "deep" + "</div>" * 5000, set()) == ["deep"]


@pytest.mark.parametrize("open_tag, close_tag", [("<div>", "</div>"), ("<article>", "</article>")])
def test_copies_of_a_page_are_one_page(spark, open_tag, close_tag):
    parts = "".join(f"<section><h2>part {k}</h2><p>{'long text ' * 5}{k}</p><ul><li>item {k}</li></ul></section>" for k in range(3))
    copied = f"<body><div class=box>Read our great letter</div>{open_tag}{parts}{close_tag}</body>"
    rows = [(i, f"https://copy.example/{i}", copied) for i in range(8)]
    rows += [(100 + i, f"https://copy.example/{i}", f"<body><div class=box>Read our great letter</div><p>own {i}</p></body>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "\n".join(f"part {k}\n{'long text ' * 5}{k}\nitem {k}" for k in range(3))
    assert got == {i: text for i in range(8)} | {100 + i: f"own {i}" for i in range(8)}


LONG = "word " * 300


@pytest.mark.parametrize("page,want", [
    ("<p title=it's>Hello world</p><p>Don't stop</p><p>more</p>", ["Hello world", "Don't stop", "more"]),
    ("<p class=\"a\" \">one</p><p a\"b=c>two</p><p data-x = 'q>r' y>three</p><a href=x/>4</a>", ["one", "two", "three", "4"]),
    ('<div title="open>five</div><p>six</p>', ["five", "six"]),
    (f"<div><p>short</p></div><div class=comments><p>{LONG}</p></div>", ["short"]),
    (f"<article><p>short</p><div class='comments'><p>{LONG}</p></div></article>", ["short"]),
    (f"<article><p>short</p><section id=comments><article>{LONG}</article></section></article>", ["short"]),
    (f"<body><div class='cookie notice'><p>{LONG}</p></div><p>real</p></body>", ["real"]),
    ("<div>" * 3000 + "three" + "</div>" + "<div>four</div>" + "</div>" * 2999, ["three", "four"]),
    ("<p>a</p><p style='color:red; display : none'>gone</p><p style='display:block'>b</p>", ["a", "b"]),
    (f"<div class='widget'><p>{LONG}</p></div><p>foot</p>", [LONG.strip(), "foot"]),
    ("<div class=sidebar><article><p>teaser</p></article></div><article><p>own</p></article>", ["own"]),
    (f"<div class=sidebar><article><p>{LONG}</p></article></div>", [LONG.strip()]),
    ("<body class='ad' id=menu><p>all</p></body>", ["all"]), ("", []), ("<", ["<"]), ("a < b", ["a < b"])])
def test_blocks_of_odd_pages(page, want):
    assert template.blocks(page, set()) == want
    main, hashes = template.page_hashes(page)
    assert all(-2 ** 63 <= h < 2 ** 63 for h in [main, *hashes])


def test_odd_pages_table(spark):
    rows = [(None, "http://a.b/x", "<p>n</p>", "k"), (1, None, None, "k"), (2, "http://a.b/y", "", "k"), (3, "x", f"<article>{LONG * 200}</article>", "k"),
            (4, "http://a.b/z", "<div>" * 20000 + "deep", "k"), (4, "http://a.b/z", "<div>" * 20000 + "deep", "k")]
    got = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(2)).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == {
        (None, "n", 1): 1, (1, "", 0): 1, (2, "", 0): 1, (3, (LONG * 200).strip(), len((LONG * 200).strip())): 1, (4, "deep", 4): 2}


def test_class_names_drop_no_page(spark):
    page = "<body class='no-sidebar ad'><div class='content with-sidebar'><article class=comments-open><h1>A</h1><p class=share-price>b and more</p>" \
           "<div class='x ad'>buy</div></article></div></body>"
    assert template.blocks(page, set()) == ["A", "b and more"]
    assert template.blocks("<body><div class=sidebar><p>most of the text here</p></div><div class=ad>c</div></body>", set()) == ["most of the text here"]


@pytest.mark.parametrize("hot", [1, 1000])
def test_what_recurs_is_template_of_a_large_host(spark, monkeypatch, hot):
    monkeypatch.setattr(template, "HOT", hot)  # 1: the joins by shuffle
    few = "<div class=variant>Only on one page in ten</div>"
    rows = [(i, f"https://wide.example/{i}", f"<body><div class=top>On all</div>{few * (i % 10 == 0)}<p>own {i}</p></body>") for i in range(60)]
    rows += [(100 + i, f"https://small.example/{i}", f"<body>{few * (i == 0)}<p>own {i}</p></body>") for i in range(5)]
    rows += [rows[0]] * 3
    got = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), recurs=6)
    want = Counter({**{(i, f"own {i}"): 1 for i in range(60)}, (0, "own 0"): 4, (100, "Only on one page in ten\nown 0"): 1})
    want.update({(100 + i, f"own {i}"): 1 for i in range(1, 5)})
    assert Counter((r["page_id"], r["text"]) for r in got.collect()) == want


# --- op9, op10 --------------------------------------------------------------------

def test_huffman_code_is_optimal_and_limited():
    import heapq
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 1000, 300)
    heap = [(int(c), i) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost, k = 0, 1000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k := k + 1))
    lengths = huffman.code_lengths(counts, 16).astype(int)
    assert (lengths * counts).sum() == cost
    limited = huffman.code_lengths(np.array([2 ** i for i in range(12)]), 5).astype(float)
    assert limited.max() <= 5 and (2.0 ** -limited).sum() <= 1
    code = huffman.Code(huffman.code_lengths(counts, 10))
    for n in (0, 1, 1023, 1024, 1025, 5000):
        ids = rng.choice(np.flatnonzero(counts), n)
        bits, at = code.encode(ids)
        assert np.array_equal(code.decode(bits, at, n), ids)


def test_visible_ascii_is_not_translated_byte_by_byte():
    class Untranslated(dict):
        def __getitem__(self, key):
            assert key == 32, "looked up although it stands for itself"
            return super().__getitem__(key)

    pieces = huffman.Ids(public_tokenizers.path("byte_bpe_50k.json"))._cached
    plain = [" word", "~!", " a b", ""]
    odd = ["é".encode(), b"\n", b"\x7f", b" \xad\xff", b"a\tb"]
    letters = pieces._letters_of
    assert [pieces._lettered(p) for p in odd] == ["".join(letters[b] for b in p) for p in odd]
    pieces._letters_of = Untranslated(letters)
    assert [pieces._lettered(p.encode()) for p in plain] == [p.replace(" ", letters[32]) for p in plain]


def test_token_file_holds_the_librarys_ids(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_token_file"](spark, SF).collect()}
    at = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = tok.encode(r["text"], add_special_tokens=False).ids + [0]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"]) == (at, len(ids))
        assert got[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_transducer_equals_the_reference_encoder(docs):
    import tiktoken
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(6)
    letters = [chr(x) for x in [*range(0, 0x250), *range(0x2000, 0x2070), *range(0x3040, 0x30ff), 0x1f600, 0x85, 0xa0, 0xfeff]]
    texts = ["", " ", "  a", "<|endoftext|> x", "a" * 3000, "= " * 400, "can't  won't"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(100)]
    texts += [r["text"] for r in docs.limit(50).collect()]
    for text, ids in zip(texts, c.encode_many(texts)):
        assert ids.tolist() == enc.encode_ordinary(text)
        assert c.decode(ids.tolist()) == text


def test_full_caches_and_state_tables_change_nothing(monkeypatch):
    large = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "STATES", 40)
    monkeypatch.setattr("vigil.llm.pieces.PIECES", 5)
    monkeypatch.setattr("vigil.llm.pieces.CHUNKS", 3)
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(7)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdrstéü.") for _ in range(rng.randint(1, 12))) for _ in range(20))
        got = small.encode(text).tolist()
        assert got == large.encode(text).tolist() and small.decode(got) == text


def test_pieces_in_any_order_share_what_was_read(monkeypatch):
    """Shared starts, entries of the vocabulary in between, a table that starts
    anew midway and a second caller meanwhile: always the merges of the piece."""
    ranks = bpe.Codec(RANKS, public_tokenizers.PATTERN).ranks
    rng = random.Random(8)
    pieces = [("".join(rng.choice("abcdrstéü") for _ in range(rng.randint(1, 9)))).encode() for _ in range(400)]
    pieces += [b"", b"the", b"a" * 500, *pieces[:50]]
    for states in (1 << 12, 30):
        monkeypatch.setattr(bpe, "STATES", states)
        for order in (pieces, sorted(pieces), sorted(pieces, reverse=True)):
            machine = bpe.Transducer(ranks)
            for piece, ids in zip(order, machine.encode_all(order), strict=True):
                assert ids == [ranks[t] for t in machine.merges(piece)]
                assert machine.encode(piece[::-1]) == [ranks[t] for t in machine.merges(piece[::-1])]


def test_utf8_machine_over_split_characters():
    m = bpe.Utf8Machine({i: bytes([i]) for i in range(256)})
    for text in ("aé€😀z", "", "߿ࠀ￿𐀀"):
        assert "".join(m.stream(text.encode())) == text
    assert "".join(m.stream(b"a\xffb\xe2\x82")) == "a�b�"
    assert hashlib.sha256("".join(m.stream("é".encode())).encode()).hexdigest() == hashlib.sha256("é".encode()).hexdigest()


def test_pipeline_runs_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("not intact").isEmpty()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pieces_are_cut_by_the_reference_engines_classes():
    """Random texts over all planes, rare and newly assigned code points included."""
    import base64

    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(12)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    pools = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x530, 0x600), range(0x0C00, 0x0D00), range(0x2000, 0x2100), range(0x20000, 0x32000),
             range(0x11D00, 0x11F00), range(0x1F300, 0x1F700), [0x209D, 0x20, 0x0A, 0x85, 0xA0, 0x3000, 0x27]]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> a <|endoftext|>", "word₝₝word", " ₝", ""]
    for text, ids in zip(texts, codec.encode_many(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text.encode("unicode_escape")
        assert codec.decode(ids.tolist()) == text


def test_new_words_share_calls_of_the_library():
    """Eight new words are one call of the merge model (one each before), with the library's own ids."""
    import public_tokenizers
    from vigil.llm import huffman
    enc = huffman.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"{a}{b}ow{c}" for a in ("bl", "th", "Q", "vé") for b in "aeiou" for c in ("ix", "lund", "à", "pà")]
    texts = [" ".join(words), "One.\nTwo!! it's a\n\nb, c%%% |", "", "x" + " à" * 9]
    calls = []
    model = enc._cached._model
    enc._cached._model = type("Counted", (), {"tokenize": lambda self, s: (calls.append(s), model.tokenize(s))[1]})()
    got = enc.encode_many(texts)
    assert [x.tolist() for x in got] == [enc._tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < len(words)
    ids = np.arange(5000) % 257
    code = huffman.Code(huffman.code_lengths(np.bincount(ids)))
    for n in (0, 1, 1024, 1025, 5000):
        assert code.decode(*code.encode(ids[:n]), n).tolist() == ids[:n].tolist()


def test_checked_ids_keep_little_memory():
    """A worker of the pipeline's token stage on texts of ever new words: two
    of them and the JVM share an executor's 3 GB."""
    code = """
import random, re, string
import pyarrow as pa, public_tokenizers
from vigil.llm import bpe
path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
def mb():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def batches():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 10)))
    for _ in range(12):
        yield pa.RecordBatch.from_pydict({"doc_id": [1] * 256, "text": [" ".join(word() for _ in range(100)) for _ in range(256)]})
list(bpe._checked(iter([]), path, pattern, ["doc_id", "n_tokens", "ids", "intact"]))
before, rows, most = mb(), 0, 0
for got in bpe._checked(batches(), path, pattern, ["doc_id", "n_tokens", "ids", "intact"]):
    assert all(got["intact"].to_pylist()) and got.schema.names == ["doc_id", "n_tokens", "ids", "intact"]
    rows, most = rows + got.num_rows, max(most, mb())
print(rows, most - before)
"""
    rows, grown = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], check=True, capture_output=True, text=True).stdout.split()
    assert int(rows) == 12 * 256
    assert float(grown) < 100, grown  # 136 with the larger caches and the freed memory of Arrow kept
