"""Queries and stages without SQL against brute force over small tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from celloom.llm import decontamination, packing, pii, quality, queries, spotsigs, urls, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with the given tables as Parquet."""

    def write(**named):
        for name, df in named.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def prose(rng, n):
    return " ".join(rng.choice(["the", "and", "of", "to"]) if rng.random() < 0.3 else "w%d" % rng.randrange(800) for _ in range(n))


def made(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def hashed(key, n):
    seed = 42 if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(int(n).to_bytes(4, "little"), seed)


def test_op1_equals_brute_force(spark, tables):
    texts = ["", None, "é", "x" * 50_000, *("doc %d" % (i % 90) for i in range(300))]
    ids = [None, None, *range(302)]
    got = queries.op1_shard(spark, tables(documents=made(spark, texts, ids))).collect()

    def shard(key, n):
        return min(range(n), key=lambda s: (-math.log(((hashed(key, s) >> 11) + 0.5) * 2.0**-53), s))

    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", shard(i, 40), shard(i, 41)) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def brute_spots(text):
    own = [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]
    found = set()
    for i, w in enumerate(own):
        if w in spotsigs.ANCHORS:
            chain = [c for c in own[i + 1 : i + 1 + spotsigs.REACH] if c not in spotsigs.COMMON][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((w, *chain))
    return found or ({tuple(own)} if own else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op7_equals_brute_force(spark, tables):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 3, 40, 90, 200, 200, 30_000)] + ["", None, "...", "ä" * 1000]
    texts += [texts[5], texts[6][:-3]]
    got = {r.doc_id: r for r in queries.op7_spotsigs(spark, tables(documents=made(spark, texts))).collect()}
    for i, t in enumerate(texts):
        own, following = t or "", texts[i - 1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(jaccard(brute_spots(own), brute_spots(edited)))
        assert got[i].near_next == pytest.approx(jaccard(brute_spots(own), brute_spots(following)))
        for j in range(i):
            assert (got[i].fingerprint == got[j].fingerprint) == (brute_spots(own) == brute_spots(texts[j]))


def test_op7_repeats_and_nulls(spark, tables):
    got = queries.op7_spotsigs(spark, tables(documents=made(spark, ["one", "one", "two", "two", "three"], [1, 1, 1, None, None]))).collect()
    assert len(got) == 5 and len({(r.doc_id, r.fingerprint, r.edited_sha256) for r in got}) == 4
    assert spotsigs.with_edits(made(spark, ["x"]).limit(0)).count() == 0


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, 300) for _ in range(6)]
    texts = base + [" ".join(w if rng.random() > rate else "w%d" % rng.randrange(800) for w in t.split()) for t in base for rate in (0.005, 0.02, 0.05)] + [base[0], "", None]
    sets = [brute_spots(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    keys = sorted(i for s, i in first.items() if s)
    want = {(a, b): jaccard(sets[a], sets[b]) for a in keys for b in keys if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    got = {(r.key_a, r.key_b): r.likeness for r in spotsigs.near_pairs(made(spark, texts)).collect()}
    assert len(want) > 5 and got == pytest.approx(want)


def test_op9_repeats_clashes_and_empty(spark):
    rows = [(1, "http://org/x", 5, "b"), (1, "http://org/x", 5, "b"), (2, None, 5, "b"), (3, "http://x.org/" + "y" * 50_000, 5, "b")]
    held = spark.createDataFrame(rows, "page_id long, url string, best int, digest string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.rule, r.verdict, r.best, r.digest) for r in urls.judge(held.withColumnRenamed("x", "host"), rules).collect())
    assert [g[:3] for g in got] == [(1, "org/", "allow"), (1, "org/", "allow"), (2, None, "allow"), (3, "org/", "allow")] and {g[3:] for g in got} == {(5, "b")}
    assert urls.judge(held.limit(0), rules).count() == 0 and {r.verdict for r in urls.judge(held, rules.limit(0), default="block").collect()} == {"block"}
    ties = spark.createDataFrame([("org", "/", "allow"), ("ORG", "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge(held.where("page_id = 1"), ties).collect()} == {"block"}


def test_op10_trees_equal_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    x[:, 4] = rng.integers(0, 3, 400)
    y = ((x[:, 0] > 0.2) ^ (x[:, 4] == 1)).astype(float)
    model = quality.fit(x, y, trees=15, depth=3)

    def walk(t, node, row):
        if model.left[t, node] == node:
            return model.value[t, node]
        return walk(t, model.right[t, node] if row[model.feature[t, node]] > model.threshold[t, node] else model.left[t, node], row)

    want = [1 / (1 + math.exp(-(model.base + sum(walk(t, 0, row) for t in range(15))))) for row in x]
    assert model.score(x) == pytest.approx(want)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    # the first split is the best of all cuts
    p = y.mean() * 0 + 1 / (1 + math.exp(-model.base))
    grad, hess = y - p, np.full(400, p * (1 - p))
    gain = lambda s: grad[s].sum() ** 2 / (hess[s].sum() + 1.0)
    cuts = [(gain(x[:, f] <= c) + gain(x[:, f] > c)) for f in range(5) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) if 8 <= (x[:, f] <= c).sum() <= 392]
    f, c = model.feature[0, 0], model.threshold[0, 0]
    assert gain(x[:, f] <= c) + gain(x[:, f] > c) == pytest.approx(max(cuts))
    assert (quality.fit(x[:0], y[:0]).score(x) == 0.5).all()


def test_op10_nulls_repeats_and_ties(spark):
    texts = ["good text of words. " * 5, "bad!!! " * 9] * 40
    held = made(spark, [*texts, texts[0], None, ""], [*range(80), 0, None, 81])
    told = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)] + [(0, 0), (0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.scored(held, told).collect()
    assert len(got) == 83 and [r.held_out for r in got if r.doc_id is None] == [True]
    assert len({r.score for r in got if r.doc_id == 0}) == 1 and len({r.score for r in got if r.doc_id in (None, 81)}) == 1
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 80)
    assert quality.scored(held.limit(0), told).count() == 0
    kept = quality.keep_good(held, told)
    assert sorted((r.doc_id for r in kept.collect()), key=repr)[:3] == sorted([r.doc_id for r in got if r.score >= 0.5], key=repr)[:3] and kept.columns == held.columns


def shingles(text):
    own = [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]
    return {" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def test_sketch_never_loses_a_candidate(spark):
    rows = spark.range(1, 3000).select("id", *[c.alias(n) for c, n in zip(decontamination.sketch_sizes(decontamination.F.col("id").cast("int"), 0.8), ("k", "need"), strict=True)]).collect()
    for n, k, need in rows:
        assert 1 <= need <= k <= n and k - (n - math.ceil(0.8 * n - 1e-9)) >= need or need == 1 and k - (n - math.ceil(0.8 * n - 1e-9)) >= 1


def test_op4_repeated_ids_and_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(1, item), (1, item), (2, "w " * 3000 + item), (None, item)], "item_id long, text string")
    texts = [f"x {item} y", "nothing", f"{item}", "w " * 60_000 + item, None, ""]
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.find(made(spark, texts, [1, 1, 2, 3, 4, None]), items).collect()}
    share = lambda t, s: len(shingles(t) & shingles(s)) / len(shingles(s))
    want = {(d, i): max(share(t, s) for e, t in zip([1, 1, 2, 3], texts, strict=False) if e == d) for d in (1, 2, 3) for i, s in ((1, item), (2, "w " * 3000 + item))}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.8})


def test_packing_edges(spark):
    held = made(spark, ["a b", "a b", None, "z"], [1, 1, None, None])
    got = packing.pack(held.withColumn("place", held.n_chars).withColumn("ids", held.text), queries.tokenizer()).collect()
    assert sorted(repr(r.doc_id) for r in got) == ["1", "1", "None", "None"] and all(r.length == r.doc_tokens for r in got)
    assert packing.pack(held.limit(0), queries.tokenizer()).count() == 0
    rng = np.random.default_rng(0)
    rare = [rng.integers(20_000, 50_000, 60) for _ in range(40)]
    some = [np.append(r, rng.integers(256, 400, 60)).astype(np.uint16) for r in rare] + [np.append(r, rng.integers(256, 400, 60)).astype(np.uint16) for r in rare]
    order = np.argsort(packing.places(some, packing._draws()).view(np.uint64), kind="stable").tolist()
    assert np.median([abs(order.index(i) - order.index(i + 40)) for i in range(40)]) <= 3  # documents that share rare terms lie together
    assert (packing.places([some[0], some[0]], packing._draws()) == packing.places([some[0]], packing._draws())[0]).all()


def test_pipeline_equals_brute_force(spark, tables):
    rng = random.Random(9)
    item = prose(rng, 30)
    texts = [prose(rng, 120) + "." for _ in range(30)]
    texts += [texts[0], texts[1] + " end", "spam!!! " * 80, "spam!!! spam " * 60, texts[2] + " " + item, texts[3] + " write to a.b@c.org now", None, "", "the " + "long " * 30_000]
    held = made(spark, texts)
    told = spark.createDataFrame([(i, int("spam" not in (t or "spam")), 0) for i, t in enumerate(texts)] * 1, "doc_id long, quality int, toxic int")
    folder = tables(documents=held, labels=told, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    score = {r.doc_id: r.score for r in quality.scored(held, told).collect()}
    kept = [i for i in range(len(texts)) if score[i] >= 0.5]
    sets = {i: shingles(texts[i]) for i in kept}
    left = []
    for i in kept:  # groups here are pairs, so the first of each stays
        if not any((texts[i] or "") == (texts[j] or "") or sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8 for j in kept if j < i):
            left.append(i)
    left = [i for i in left if len(sets[i] & shingles(item)) < 0.8 * len(shingles(item))]
    docs, at = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == held.columns
            docs = docs.persist()
        at[name] = docs.collect()
    assert sorted(r.doc_id for r in at["quality"]) == kept
    assert sorted(r.doc_id for r in at["decontamination"]) == left
    clean = {r.doc_id: r.text for r in at["personal_data"]}
    field = pii.train(pii.labelled_table())
    for i in left:
        _, (every,) = pii._both([texts[i] or ""], field)
        want = texts[i]
        for k, spans in every.items():
            assert not any(texts[i][a:b] in clean[i] for a, b in spans)
        if not any(every.values()):
            assert clean[i] == want
    assert "a.b@c.org" not in str(clean.values())
    tokens = {i: len(packing.Encoder.at(queries.tokenizer()).encode([clean[i] or ""])[0]) + 1 for i in left}
    summed = Counter()
    for r in at["packing"]:
        summed[r.doc_id] += r.length
    assert summed == tokens
    assert corpus_pipeline.run(spark, folder).count() == len(at["packing"])


def test_words_module_is_the_rule():
    texts = ["", "A b-c ÄÖ 12x", "\x80\U0010ffff x", "a" * 1000]
    hashes, at = words.word_hashes(texts)
    assert [b - a for a, b in zip(at, at[1:], strict=False)] == [len([w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", t.lower()) if w]) for t in texts]
    assert sys.getsizeof(hashes)
