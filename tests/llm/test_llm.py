"""Small cases of every text operator against brute force, round trips and stated results."""

import hashlib
import io
import itertools
import os
import random
import re
import string
import zlib
from pathlib import Path

import numpy as np
import oracle
import pytest
from conftest import SF

from celloom import session
from celloom.llm import decontamination, groups, html, ngram_join, packing, pii, quality, queries, sharding, spotsigs, tokens, urls, warc

EXTRA = ["lang string", "source string"]
TEXTS = ["", None, "one", "a b c", "the quick brown fox jumps over the lazy dog and runs away", "x" * 200_000, "word " * 30_000]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, 1, 5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long, shard int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    oracle.compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_sharding(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, "doc_id", [1.0] * 7).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(df, "doc_id", [1.0] * 8).collect()}
    assert all(b[k] in (a[k][0], 7) for k in a)
    for s in range(7):
        assert sorted(x for t, x in a.values() if t == s) == list(range(sum(t == s for t, _ in a.values())))
    heavy = [r.shard for r in sharding.shard(df, "doc_id", [3.0, 1.0]).collect()]
    assert 0.7 < heavy.count(0) / 2000 < 0.8
    odd = docs(spark, TEXTS + ["a"], [None, None, 1, 1, 2, 3, 4, 5])
    assert sorted(x.slot for x in sharding.shard(odd, "doc_id", [1.0]).collect()) == list(range(8))
    assert sharding.shard(odd.limit(0), "doc_id", [1.0]).count() == 0


def near(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
    return " ".join(w)


def test_ngram_join_counts_links_and_keeps_one(spark):
    rng = random.Random(3)
    base = [" ".join("w%d" % rng.randrange(5000) for _ in range(200)) for _ in range(12)]
    texts = base + [near(b, rng, e) for b in base for e in (1, 2, 5)] + base[:3] + ["", "", None, "a b"]
    got = {r.doc_id: r for r in ngram_join.join(docs(spark, texts)).collect()}
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = [sum(j != i and (jac(sets[i], sets[j]) >= 0.8) for j in range(len(texts))) for i in range(len(texts))]
    assert [got[i].n_links for i in range(len(texts) - 4)] == want[:-4]
    assert got[len(texts) - 4].n_links == 2 and got[len(texts) - 1].n_links == 0  # null reads as empty, and equal empty texts are copies
    kept = {r.doc_id for r in ngram_join.keep_first(docs(spark, texts)).collect()}
    assert kept == {got[i].class_id for i in got}
    odd = {(r.doc_id, r.copy_of, r.class_id, r.n_links) for r in ngram_join.join(docs(spark, ["p q r s t u", "p q r s t u", "other words", "p q r s t u"], [None, 4, 4, None])).collect()}
    assert odd == {(None, 4, 4, 2), (4, 4, 4, 2), (4, 4, 4, 0)}
    assert ngram_join.join(docs(spark, texts).limit(0)).count() == 0


def five(t):
    w = t.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join_finds_pairs_at_the_threshold(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        base = " ".join("w%d" % rng.randrange(9000) for _ in range(300))
        texts += [base, near(base, rng, rng.choice([5, 6, 6, 7]))]
    sets = [five(t) for t in texts]
    want = {i for i in range(0, 300, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert 60 < len(want) < 150
    read = []
    told = ngram_join.recall_of
    monkeypatch.setattr(ngram_join, "recall_of", lambda c, d, t: read.append(d) or min(told(c, d, t), 0.9 if d > 6 else 1.0))
    got = {r.doc_id: r.n_links for r in ngram_join.join(docs(spark, texts)).collect() if r.n_links and r.doc_id % 2 == 0}
    assert set(got) <= want and len(got) >= 0.99 * len(want)
    assert read == [8, 7, 6] and set(got.values()) == {1}  # prefixes got shorter; no pair counts twice


def test_forest_prefixes_and_recall():
    rng = random.Random(2)
    own, counts = ngram_join.signatures(["a b c d e f g", "a b c d e f g", "", "x " * 200_000, *(" ".join("v%d" % rng.randrange(99) for _ in range(50)) for _ in range(20))])
    assert (own[0] == own[1]).all() and list(counts[:4]) == [3, 3, 0, 1]
    for d in range(1, 9):
        assert (ngram_join.prefixes(own, d) == (own.view(np.uint64) >> np.uint64(64 - 8 * d))).all()
    assert len(np.unique(own[:, 0] & 255)) > 10
    assert ngram_join.recall_of({}, 8, 0.8) == 1.0 and ngram_join.recall_of({396: 10**6}, 8, 0.8) == 1.0
    assert ngram_join.recall_of({321: 1000}, 8, 0.8) < 0.999 < ngram_join.recall_of({321: 1000}, 6, 0.8)


def test_small_tables_get_few_files(spark, monkeypatch):
    """However many the shuffle partitions are: each file starts processes in an executor, which count its memory once more."""
    paths, scratch = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *a: paths.append(scratch(*a)) or paths[-1])
    rng = random.Random(8)
    base = [" ".join("w%d" % rng.randrange(5000) for _ in range(200)) for _ in range(30)]
    held = docs(spark, base + [t + f" tail{k}" for k, t in enumerate(base)] + base[:9]).coalesce(2)
    few = [sorted(f(held).drop("text").collect()) for f in (ngram_join.join, ngram_join.keep_first)]
    own = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    paths.clear()
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        joined = ngram_join.join(held)
        assert [sorted(f.drop("text").collect()) for f in (joined, ngram_join.keep_first(held))] == few
        assert joined.rdd.getNumPartitions() == 1
        files = [len(list(Path(p.removeprefix("file://")).glob("part-*"))) for p in paths]
        assert len(files) > 20 and max(files) <= 2, files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_files_of_contaminated_and_labelled_documents(spark, monkeypatch):
    paths, scratch = {}, session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: paths.setdefault(name, scratch(s, name)))
    rng = random.Random(9)
    passages = [" ".join("v%d" % rng.randrange(5000) for _ in range(30)) for _ in range(40)]
    held = docs(spark, [" ".join("w%d" % rng.randrange(5000) for _ in range(50)) + (f" {p}" if k % 4 else "") for k, p in enumerate(passages)]).coalesce(2)
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int").coalesce(2)
    own = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        assert {r.doc_id for r in decontamination.drop_contaminated(held, items).collect()} == set(range(0, 40, 4))
        quality.keep_good(held, labels).count()
        names = ["benchmark-candidate-documents", "benchmark-contaminated", "quality-labelled"]
        assert [len(list(Path(paths[n].removeprefix("file://")).glob("part-*"))) for n in names] == [1, 1, 1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keep_first_tells_rows_apart(spark):
    a, b = "one two three four five six", "nothing alike in these words here"
    kept = lambda texts, ids: sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(docs(spark, texts, ids)).collect()), key=repr)
    assert kept([a, a, b], [1, 5, 5]) == [(1, a), (5, b)]
    assert kept([a, a, b, b, b], [1, 1, None, None, 7]) == [(1, a), (7, b)]
    assert kept([a, a, None, None], [None, None, 3, 4]) == [(3, None), (None, a)]
    assert kept([], []) == []
    long = "w " * 100_000
    assert kept([long, long + "w", a], [2, 1, 1]) == [(1, a), (1, long + "w")]


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(5)
    base = " ".join("w%d" % i for i in range(300))
    texts = [near(base, rng, 1) for _ in range(40)]
    got = ngram_join.join(docs(spark, texts)).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}


def test_components_of_stars_and_paths(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT_ROWS", 5)
    draw = np.random.default_rng(6)
    edges = [(7, 1000 + i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2060)] + [tuple(map(int, draw.integers(3000, 3400, 2))) for _ in range(250)] + [(5000, 5000)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    found = groups.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(found) == len({r.node for r in found})
    assert {n: n for n in root} | {r.node: r.root for r in found} == root


def test_html_extraction(spark):
    page = '<html><head><title>t</title><script>var a="<p>x";</script></head><body><nav>menu</nav><div class="ad">buy</div><p>We use pages</p><article><h1>A &amp; B</h1><p>one\n two<p>three <b>four</b></article><div id="comments"><p>nice</p></div><footer>f</footer></body></html>'
    plain = "<body><div class='cookie-notice'>ok?</div><p>Same notice</p><p>body {}</p></body>"
    rows = [(0, "http://a.org/1", page), (1, None, None), (2, "x", "")] + [(10 + i, f"http://b.org/{i}", plain.format(i)) for i in range(4)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    assert got[0].text == "A & B\none two\nthree four" and got[0].n_chars == len(got[0].text)
    assert got[1].text == got[2].text == ""
    assert got[11].text == "body 1"  # the notice on all of the host's pages is template


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n long"), ["page_id", "url"]).collect()}


def test_html_copies_count_as_one_page(spark):
    page = "<html><body><article><h1>Title</h1><p>first part</p><p>second part</p></article></body></html>"
    bare = "<body><script>{}</script><p>All the same</p><p>second</p></body>"
    plain = "<body><div><p>Same notice</p></div><p>body {}</p></body>"
    rows = [(i, f"http://a.org/{i}", page, "x", 1) for i in range(4)] + [(i, f"http://b.org/{i}", plain.format(max(i, 12)), "x", 1) for i in range(10, 16)]
    rows += [(20 + i, f"http://c.org/{i}", bare.format(i), None, None) for i in range(3)] + [(20, "http://c.org/0", bare.format(0), None, None)]
    got = extracted(spark, rows)
    assert all(got[i] == "Title\nfirst part\nsecond part" for i in range(4))
    assert all(got[i] == f"body {max(i, 12)}" for i in range(10, 16))  # four different pages: the notice is template still
    assert all(got[20 + i] == "All the same\nsecond" for i in range(3))  # copies but for their scripts
    assert extracted(spark, []) == {}


def test_html_templates_decide_where_roles_do_not(spark, monkeypatch):
    page = "<body><div><ul><li><a>Home</a><li><a>About {0}</a><li><a>News</a></ul></div><div><h2>Title {0}</h2><p>Words of story {0}, long enough.</p></div><div>Made by us</div></body>"
    rows = [(i, f"http://a.org/{i}", page.format(i), None, None) for i in range(5)] + [(9, "http://b.org", "<div>" + "<p>long text</p>" * 20_000 + "</div>", None, None)]
    got = extracted(spark, rows)
    assert all(got[i] == f"Title {i}\nWords of story {i}, long enough." for i in range(5))
    assert got[9].count("\n") == 19_999
    parsed = [html.Page(page.format(i)) for i in range(5)]
    assert all("Made by us" in html.main_text(p, set(), None, set()) for p in parsed)  # without the template


def brute_template(pages):
    """The tokens of a host's template, by vectors and orders of all pages at once."""
    places = [[t for t in p.tokens] for p in pages]
    vector = {t: tuple(own.count(t) for own in places) for own in places for t in own}
    held = {t for t, v in vector.items() if sum(map(bool, v)) >= max(html.LEAST_PAGES, html.LEAST_SHARE * len(pages))}
    held = {t for t in held if any(u % 2 == 0 and vector[u] == vector[t] for u in held)}
    before = {}
    for page, own in zip(pages, places, strict=True):
        for at, t in enumerate(own):
            if t in held:
                alike = [u for u in own if u % 2 == 0 and u in held and vector[u] == vector[t] and (t % 2 or page.parents[u >> 1] == page.parents[t >> 1])]
                ahead = [u for u in own[:at] if u in alike]
                before.setdefault(t, set()).add(ahead[-1] if ahead else 0 if t % 2 else alike[-1])
    return {t for t, own in before.items() if len(own) == 1}


def test_html_template_equals_brute_force(spark):
    rng = random.Random(8)
    parts = ["<p>one</p>", "<div class='x'><b>two</b></div>", "<ul><li>a<li>b</ul>", "<p>three</p>"]
    sources = []
    for i in range(12):
        own = parts[:2] + rng.sample(parts[2:], rng.randrange(3))
        sources.append(f"<html><body><nav>n</nav>{''.join(own)}<p>text {i}</p><footer>f</footer></body></html>")
    held = spark.createDataFrame([(7, s) for s in sources], "host long, html string")
    found = html.templates(html.representatives(html.skeletons(held, "host", "html"))).collect()
    assert len(found) == 1 and found[0].of == 12
    assert set(found[0].template) == brute_template([html.Page(s) for s in sources])


def test_html_names_of_frames(spark):
    cases = [("<article class='related-work'>only</article>", "only"), ("<div class='share-price search'>only</div>", "only"), ("<div class='post-comment-policy'>only</div>", "only")]
    cases += [("<h1>T</h1><div class='search box'>the long text of the only part here</div>", "T\nthe long text of the only part here"), ("<article><div class='cookie-notice'>no</div><p>yes</p></article>", "yes")]
    got = extracted(spark, [(i, f"http://h{i}.org", source, None, None) for i, (source, _) in enumerate(cases)])
    assert [got[i] for i in range(len(cases))] == [text for _, text in cases]


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, None), (3, "short one"), (None, "x y z")], "item_id long, text string")
    texts = TEXTS + ["pre Alpha, beta gamma; delta epsilon zeta eta post", "short one", "short one more"]
    got = sorted((r.doc_id, r.item_id) for r in decontamination.find(docs(spark, texts), items).collect())
    assert got == [(len(TEXTS), 1), (len(TEXTS) + 1, 3)]
    assert decontamination.find(docs(spark, texts), items.limit(0)).count() == 0


def test_packing_is_exact_and_full(spark):
    from tokenizers import Tokenizer

    told = Tokenizer.from_file(queries.tokenizer())
    texts = ["it's  here\n\n now", "", None, "<|endoftext|> 12ab", "a<|endoftext|><|endoftext|>", "it's <|endoftext|>x", "Ähm 日本 x " * 400, "plain words here " * 900, *("doc number %d " % i * 20 for i in range(60))]
    got = packing.pack(docs(spark, texts), queries.tokenizer()).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*told.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]])) and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own[:-1]]])) and sum(n for _, n in own) <= packing.WINDOW


class CountedPieces:
    """Stands before a tiktoken encoding and counts the pieces it is given."""

    def __init__(self, real):
        self.real, self.calls, self._core_bpe = real, 0, self

    def encode_single_piece(self, piece):
        self.calls += 1
        return self.real._encode_single_piece(piece)

    _encode_single_piece = encode_single_piece


def test_pieces_are_encoded_once_also_in_large_vocabularies():
    encoder = tokens.Encoder(queries.tokenizer())
    encoder.encoding = counted = CountedPieces(encoder.encoding)
    words = [f" {a}{b}{c}q{d}" for a in string.ascii_lowercase for b in string.ascii_lowercase for c in string.ascii_lowercase for d in "abcdefghijkl"]
    texts = ["".join(words[i::100]) for i in range(100)]
    once = encoder.encode(texts)
    again = encoder.encode(texts)
    assert all(a.tolist() == b.tolist() for a, b in zip(once, again, strict=True))
    assert len(words) <= counted.calls < 1.3 * len(words)


@pytest.mark.parametrize(("slots", "kept"), [(1, 1), (3, 50), (8, 1000)])
def test_ids_are_exact_when_pieces_drive_each_other_out(monkeypatch, slots, kept):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SLOTS", slots, raising=False)
    monkeypatch.setattr(tokens, "KEPT", kept)
    told, encoder, rng = Tokenizer.from_file(queries.tokenizer()), tokens.Encoder(queries.tokenizer()), random.Random(slots)
    parts = [*"abcdeAZ09 ..,!\n\t  '", "\u00a0", "é", "日本", "\U0001f600", "'s", "\x00", "e\u0301", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for i in range(0, len(texts), 50):
        for got, text in zip(encoder.encode(texts[i : i + 50]), texts[i : i + 50], strict=True):
            assert got.tolist() == told.encode(text, add_special_tokens=False).ids


def test_distinct_ids_of_documents():
    rng = np.random.default_rng(3)
    held = [rng.integers(0, 1 << 16, n).astype(np.uint16) for n in (0, 1, 5, 0, 3000)] + [np.full(4, 65535, np.uint16), np.zeros(2, np.uint16)]
    assert all(a.tolist() == np.unique(b).tolist() for a, b in zip(packing.distinct(held), held, strict=True))
    assert packing.distinct([]) == []


def test_packing_scores_all_terms_of_a_seed():
    docs = [np.arange(1, 60), np.arange(200, 230), np.append(np.arange(300, 400), 59), np.append(np.arange(400, 440), np.arange(1, 59))]
    docs = [d.astype(np.uint16) for d in docs]
    df = np.ones(1 << 16, np.int64)
    df[59] = 3  # the seed's term of least weight: the only one it shares with the third document
    index = packing.Index(docs, df, 4, 70.0)
    assert list(index.neighbours(0, np.array([False, True, True, True]))) == [3, 2]


def brute_base(text):
    """The contract's patterns as they stand."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def test_pii_base_equals_the_patterns():
    rng = random.Random(4)
    parts = ["a.b", "@", "x-1", ".com", ".", "1.2.3.4", "300.1.1.1", "0001", "4111 1111-1111 1111", "5", " ", "+", "(0)", "-", "é", "+1 555 0199", "\n", "%", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)]
    assert [pii.joined(pii.base_spans(t)) for t in texts] == [brute_base(t) for t in texts]


def spans_of(labels):
    return {(k, sum(1 for _ in itertools.takewhile(lambda x: x == "I" + n[1:], labels[k + 1 :])), n[2:]) for k, n in enumerate(labels) if n[0] == "B"}


def test_pii_field_on_held_out_sentences():
    table = pii.labelled_table()
    right = wrong = missed = 0
    for fold in range(3):
        held = table[fold::3]
        field = pii.train([x for i, x in enumerate(table) if i % 3 != fold])
        for (_, labels), found in zip(held, field.decode([w for w, _ in held]), strict=True):
            a, b = spans_of(labels), spans_of([pii.LABELS[x] for x in found])
            right, wrong, missed = right + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert right / (right + missed) > 0.65 and right / (right + wrong) > 0.8


def test_pii_viterbi_equals_all_paths():
    field = pii.train(pii.labelled_table(), rounds=20)
    for words in (["call", "(555)", "123-4567"], ["x@y", "12"], ["1"]):
        score = field.emissions(words)
        def total(path):
            return score[range(len(words)), path].sum() + pii._START[path[0]] + sum(field.pairs[a, b] + pii._ALLOWED[a, b] for a, b in itertools.pairwise(path))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(words)), key=lambda p: total(list(p)))
        assert list(field.decode([words])[0]) == list(best)


def test_pii_added_spans():
    field = pii.train(pii.labelled_table())
    texts = ["mail a.b@c.org, call (555) 123-4567 or +1 (555) 123-4567", "version 2.0 of 2019", "", "1.2.3.999 and 10.0.0.1", "4111 1111 1111 1111", "a@b.co_x@c.de"]
    base, every = pii._both(texts, field)
    assert pii.joined(base[0]) == "email:5:14,phone:39:56" and "phone:21:35" in pii.joined(every[0])
    assert pii.joined(every[1]) == pii.joined(every[2]) == "" and pii.joined(base[3]) == "ip:14:22"
    assert pii.joined(base[4]) == "card:0:19" and pii.joined(base[5]) == "email:0:6,email:6:13"
    assert all(set(b[k]) <= set(e[k]) for b, e in zip(base, every, strict=True) for k in pii.KINDS)
    text = "a b c d 1 e f g h i 2@ k l m"
    assert [[text[a:b] for a, b in run] for run in pii.windows(text)] == [["c", "d", "1", "e", "f"], ["h", "i", "2@", "k", "l"]]
    assert pii.windows("x 1 y 2 z") == [[(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)]] and pii.windows("no") == []


def test_pii_find_and_redact(spark):
    odd = docs(spark, [*TEXTS, "mail a.b@c.org now", "mail a.b@c.org now", "x" * 300_000 + " 10.0.0.1"], [None, 1, 2, 3, 4, 5, 6, 7, 7, 8])
    found = sorted(pii.find(odd).collect(), key=repr)
    assert len(found) == 10 and sum(r.n_email for r in found) == 2 and sum(r.n_ip for r in found) == 1
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in found if not r.spans)
    clean = sorted(pii.redact(odd).collect(), key=repr)
    assert [r.text for r in clean if r.doc_id == 7] == ["mail [EMAIL] now"] * 2 and [r.n_chars for r in clean if r.doc_id == 7] == [16] * 2
    assert any(r.text is None for r in clean) and pii.find(odd.limit(0)).count() == pii.redact(odd.limit(0)).count() == 0


def test_spotsigs_edits(spark):
    texts = ["the quick brown fox and the lazy dog " * 3, "", None, "alpha", "x" * 100, "the quick brown fox and the lazy dog " * 3]
    got = {r.doc_id: r for r in queries_op7(spark, texts)}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        cut = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[5].fingerprint != "" and got[0].near_next == 1.0
    pairs = spotsigs.near_pairs(docs(spark, ["the quick brown fox and the lazy dog sat", "the quick brown fox and the lazy dog sat.", "nothing alike here"]))
    assert pairs.count() == 0  # equal sets are one


def queries_op7(spark, texts):
    from pyspark.sql import functions as F

    e = spotsigs.with_edits(docs(spark, texts)).withColumn("ef", spotsigs.signatures(F.col("edited")))
    return e.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), spotsigs.as_text(F.col("found")).alias("fingerprint"), spotsigs.likeness(F.col("found"), F.col("ef")).alias("near_edited"), spotsigs.likeness(F.col("found"), F.col("next_found")).alias("near_next")).collect()


def test_warc_salvage():
    record = lambda i, p: warc.build_record("response", warc.record_urn(str(i)), "http://x/", p, warc.digest(p), str(i), len(p), None)
    members = [warc.member(record(i, os.urandom(3000))) for i in range(6)]
    whole = b"".join(members)
    assert [r["kind"] for r in warc.salvage(io.BytesIO(whole))] == ["response"] * 6
    broken = bytearray(whole)
    at = len(members[0]) + 500
    broken[at : at + 40] = os.urandom(40)
    got = list(warc.salvage(io.BytesIO(bytes(broken[: -len(members[5]) // 2]))))
    assert [r["kind"] for r in got] == ["response", "gap", "response", "response", "response", "gap"]
    assert got[1]["offset"] == len(members[0]) and got[1]["gap_bytes"] == len(members[1])
    plain = record(1, b"a") + b"junk" + record(2, b"b")
    assert [r["kind"] for r in warc.salvage(io.BytesIO(plain))] == ["response", "gap", "response"]
    assert list(warc.salvage(io.BytesIO(b""))) == []


def test_warc_members_of_many_records():
    record = lambda i, p: warc.build_record("response", warc.record_urn(str(i)), "http://x/", p, warc.digest(p), str(i), len(p), None)
    kinds = lambda data: [(r["kind"], r.get("gap_bytes")) for r in warc.salvage(io.BytesIO(data))]
    three = [record(i, os.urandom(200_000)) for i in range(3)]
    assert kinds(warc.member(b"".join(three))) == [("response", None)] * 3
    assert kinds(warc.member(three[0] + b"junk" + three[1] + b"tail") + warc.member(three[2])) == [("response", None), ("gap", 4), ("response", None), ("gap", 4), ("response", None)]
    bad = bytearray(three[1])
    bad[5000] ^= 1
    found = kinds(warc.member(three[0] + bytes(bad) + three[2]))
    assert found == [("response", None), ("gap", len(bad)), ("response", None)]
    cut = warc.member(b"".join(three))[:-300_000]
    assert [k for k, _ in kinds(cut + warc.member(three[2]))] == ["response", "gap", "response"]  # the second was not followed by a sound one
    assert [k for k, _ in kinds(warc.member(b"no archive" * 1000))] == ["gap"]
    wide = record(1, b"a").replace(b"X-Page-ID: 1", b"X-Page-ID: 1\r\nX-Long: " + b"v" * (9 << 20))
    assert kinds(wide + record(2, b"b")) == [("response", None)] * 2


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    rows = [(1, "http://a/", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (None, "u", "same", 0), (5, "u\r\nv", "x" * 300_000, 0), (6, "u", "other", 0), (6, "u", "other", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, records long")
    for held in (pages, pages.limit(0)):
        written = warc.write(warc.plan_records(held), f"file://{tmp_path}/{held.count()}").toPandas()
        files = spark.createDataFrame([(f"file://{f}",) for f in written.file], "file string")
        back = warc.checked(warc.read(spark, files), int(written.records.sum()), f"file://{tmp_path}/check{held.count()}").collect()
        assert len(back) == held.count()
    by = {(r.page_id, r.kind): r for r in warc.read(spark, spark.createDataFrame([(f"file://{p}",) for p in sorted((tmp_path / "8").glob("*.gz"))], "file string")).collect()}
    assert sorted(by, key=repr) == sorted([(1, "revisit"), (2, "response"), (3, "revisit"), (4, "response"), (None, "response"), (5, "response"), (6, "response")], key=repr)
    assert by[1, "revisit"].refers_to == "urn:x-page:2" and bytes(by[5, "response"].payload) == b"x" * 300_000 and by[1, "revisit"].full_bytes == 4
    with pytest.raises(RuntimeError):
        warc.checked(warc.read(spark, files), 3, f"file://{tmp_path}/check")


def test_url_edges(spark):
    rows = [(1, "http://A.EXAMPLE.org/es/x?q"), (2, None), (3, "no scheme"), (4, "http://org"), (5, "http://notexample.org/es/"), (6, "x://b.com/de/#/fr/")]
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("org", "", None, "allow") and got[5][2:] == ("org/", "allow") and got[6][2:] == ("com/de/", "block")


def test_quality(spark):
    scored = queries.op10_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(scored, on="doc_id")
    held = labels[labels.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored.doc_id]).all()
    assert quality.statistics(["", "a"]).shape == (2, len(quality.STATISTICS)) and not quality.statistics([""]).any()
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs(spark, TEXTS), empty).collect()} == {0.5}
