"""Vectors, pages, urls and tokens on small fixtures, against brute force or an exact round trip."""

from __future__ import annotations

import collections
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quire.llm import bpe, html_text, planes, queries, url_filter, vector_graph
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def brute_vectors(rows):
    units = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            units[k] = a / np.linalg.norm(a)
    links = {k: {j for j, b in units.items() if j != k and len(a) == len(b) and a @ b >= 0.9} for k, a in units.items()}
    out = []
    for k, (key, _) in enumerate(rows):
        seen, line = {k}, [k]
        while line:
            new = links.get(line.pop(), set()) - seen
            seen |= new
            line += new
        out.append((key, len(links.get(k, ())), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


@pytest.mark.parametrize("part", [4096, 40])
def test_vector_groups_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(vector_graph, "PART", part)
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    rng = np.random.default_rng(1)
    rows = [(int(k), rng.normal(size=16).tolist()) for k in range(1000, 1200)]
    for size in (3, 10, 90):
        centre = rng.normal(size=16)
        rows += [(len(rows), (centre + rng.normal(size=16) * 0.12).tolist()) for _ in range(size)]
    same = rng.normal(size=16).tolist()
    rows += [(700, same), (701, same), (701, same), (None, same), (702, [2 * x for x in same])]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [1.0] * 15 + [None]), (804, [1.0] * 15 + [float("nan")]), (805, [float("inf")] * 16), (806, [1.0, 2.0]), (807, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, key int, unit string, n double")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    found = vector_graph.vector_groups(frame).collect()
    assert {r.recall for r in found} == {1.0}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.id, r.n_links, r.component) for r in found), key=key) == sorted(brute_vectors(rows), key=key)
    assert vector_graph.vector_groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("part", [4096, 30])
def test_vectors_of_every_length_are_linked(spark, monkeypatch, part):
    monkeypatch.setattr(vector_graph, "PART", part)
    rng = np.random.default_rng(4)
    rows = []
    for size, n in ((16, 60), (12, 40), (8, 6)):
        for _ in range(3):
            centre = rng.normal(size=size)
            rows += [(len(rows) + k, (centre + rng.normal(size=size) * 0.1).tolist()) for k in range(n // 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vector_graph.vector_groups(frame).collect()
    assert sorted((r.id, r.n_links, r.component) for r in found) == sorted(brute_vectors(rows))


def test_lost_links_of_small_groups_are_seen_and_found(spark, monkeypatch):
    hot = {k: 100_000 for k in range(300)}
    few = {1000 + k: 2 for k in range(20)}
    assert vector_graph.audit_recall(hot | few, hot) == 0.0
    assert vector_graph.audit_recall(hot | few, hot | few) == vector_graph.audit_recall({}, {}) == 1.0
    # a search that loses everything: the audit sees it, and all vectors are compared
    monkeypatch.setattr(vector_graph, "_linked", lambda nodes, *_: nodes.limit(0).selectExpr("key", "copies as n", "key as root"))
    monkeypatch.setattr(vector_graph, "PART", 20)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + rng.normal(size=16) * 0.1).tolist()) for k in range(60)]
    found = vector_graph.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id, r.n_links, r.component) for r in found) == sorted(brute_vectors(rows))


def test_vectors_against_sql(spark):
    good, message = compare(spark, connect(SMALL), SMALL, lambda s, f: queries.QUERIES["op1_vector_graph"](s, f), queries.ORACLES["op1_vector_graph"])
    assert good, message


def test_urls_against_sql(spark):
    good, message = compare(spark, connect(SMALL), SMALL, queries.QUERIES["op6_path_template_tree"], queries.ORACLES["op6_path_template_tree"])
    assert good, message


def test_url_rules_and_edge_rows(spark):
    rows = [
        (1, "https://A.Example.NET/en/x?y"), (2, "http://net/"), (3, "http://x.net"), (4, None), (5, "nope"), (6, "://"), (7, "http://example.com/de/1"), (7, "http://example.com/de/1"),
        (8, "http://notexample.com/de/1"), (9, "http://q.org/fr/"), (10, "http://e.com:80/a//b#f"), (11, "HTTP://X.NET?q=/"), (None, "x://y?z"),
    ]
    frame = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, shape string")
    found = sorted((r.id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame).fillna("-", ["rule"]).collect())
    assert found == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "net", "/", "net/", "block"), (3, "x.net", "", "-", "allow"), (4, "", "", "-", "allow"), (5, "", "", "-", "allow"),
        (6, "", "", "-", "allow"), (7, "example.com", "/de/1", "example.com/de/", "block"), (7, "example.com", "/de/1", "example.com/de/", "block"), (8, "notexample.com", "/de/1", "-", "allow"),
        (9, "q.org", "/fr/", "org/fr/", "allow"), (10, "e.com:80", "/a//b", "-", "allow"), (11, "x.net", "", "-", "allow"), (0, "y", "", "-", "allow")])
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rules = (url_filter.Rule("shop.com", "/sale/a", "block"), url_filter.Rule("shop.com", "/sale/b", "block"), url_filter.Rule("shop.com", "/news/", "allow"))
    urls = [f"http://shop.com/sale/{c}{w}/{n}" for c in "abz" for w in ("x", "y", "q", "r") for n in range(3) for _ in range(2)]
    urls += [f"http://shop.com/sale/{''.join(p)}/7" for p in itertools.product("abcdefgh", repeat=2)] + [f"http://shop.com/news/{k}" for k in range(9)] + ["http://shop.com/about"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {urls[r.id]: r for r in url_filter.judge_urls(frame, rules=rules, limit=0.5).collect()}
    # more than 32 different names under /sale: a wildcard, whose judged urls are all blocked
    assert {found[f"http://shop.com/sale/{c}x/0"].verdict for c in "abz"} == {"block"}
    assert found["http://shop.com/sale/zx/0"].rule is None and found["http://shop.com/about"].verdict == "allow"


def brute_cut(values, edges):
    best = None
    for side in itertools.product((False, True), repeat=len(values)):
        cost = sum(-v if s and v < 0 else v if not s and v > 0 else 0 for s, v in zip(side, values)) + sum(w for a, b, w in edges if side[a] != side[b])
        best = cost if best is None or cost < best - 1e-12 else best
    return best


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 8)
        values = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        side = html_text.minimum_cut(values, edges)
        cost = sum(-v if s and v < 0 else v if not s and v > 0 else 0 for s, v in zip(side, values)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert abs(cost - brute_cut(values, edges)) < 1e-9


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=x>Home</a></header>
    <div id="cookie-notice">We use cookies on this site. Accept them.</div><div class="post-content"><h2>Title</h2>
    <div>First  para &amp; some words,<br>and more of them &lt;here&gt; to read.</div><ul><li>one point</li><li>two point</ul><p>Open para with <b>bold<p>Next para is here, and it ends.
    <form><label>Mail</label><input></form><script>var a="</p><p>no</p>";</script><div class=ad>Buy now this great product today. It is good.</div><!-- <p>gone</p> --><p>Last para&nbsp;end&#46;</div>
    <aside><p>Related long sentence with many words in it, truly many.</p></aside><section id=comments><p>I liked this article a lot, thanks for writing it.</p></section><footer>(c) x</footer>"""
    text = "Title\nFirst para & some words, and more of them <here> to read.\none point\ntwo point\nOpen para with bold\nNext para is here, and it ends.\nLast para end."
    assert html_text.main_text(page) == text
    long = "<article>" + "<p>Some words of a paragraph that is here.</p>" * 4000 + "</article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain <"), (None, "u", "<nav>only a menu</nav>"), (5, "u", long), (6, "u", "<p unclosed")]
    frame = spark.createDataFrame([(*r, "id", "text") for r in rows], "page_id long, url string, html string, id string, text string")
    found = [(r.id, r.text) for r in html_text.extract(frame).collect()]
    assert found.count((1, text)) == 2 and (2, "") in found and (3, "") in found and (None, "") in found and (6, "") in found
    assert dict(found)[5].count("\n") == 3999 and html_text.extract(frame.limit(0)).count() == 0


def mixed_texts(rng, n):
    blanks = [" ", "\n", "\t", "\x0b", "\r", "\xa0", "\u3000", "\x1c", "\x85", "  ", "\n\n", " \n", "\u200b"]
    bits = ["word", "Été", "e\u0301", "İ", "ΣΑΣ", "don't", "12", "<|endoftext|>", "<|startoftext|>", "!!", "中文", "<|end", "'s", "ﬁ", "\x00", "Ġ", " the", "\U0001f600"]
    return ["".join(rng.choice(blanks) if rng.random() < 0.4 else rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_tree_encoding_of_unsplit_text():
    rng = random.Random(1)
    made = bpe.tokenizer(WORDS)
    for _ in range(200):
        alphabet = rng.choice(["ab", "abcdefghij", "theinqu", "é中文字ñ", "a", "!?.#"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 700)))
        for run in bpe.pre_tokens(text, WORDS):
            assert bpe.tree_encode(run, WORDS, piece=rng.choice([8, 16, 50, 100])) == [t.id for t in made.model.tokenize(run)]


def test_encode_digests_against_the_library(spark):
    rng = random.Random(6)
    texts = [None, "", " ", *mixed_texts(rng, 150), "".join(rng.choices("abcdefgh", k=900)), "x" + "a" * 1500 + " tail", "".join(rng.choices("中文字é", k=400)) + "<|endoftext|>" + "b" * 300]
    rows = [(k, t, "a", "b") for k, t in enumerate(texts)] + [(1, "", "a", "b"), (None, "no id", "a", "b"), (155, texts[153], "a", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string, tokens string")
    made = bpe.tokenizer(WORDS)
    wanted = []
    for key, text, *_ in rows:
        ids = made.encode(text or "", add_special_tokens=False).ids
        plain = made.decode(ids, skip_special_tokens=False)
        wanted.append((-1 if key is None else key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
    found = bpe.encode_digests(frame, WORDS, long=200, piece=64).fillna(-1, ["id"]).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert bpe.encode_digests(frame.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_plane_file_round_trip(bits):
    class Kept(io.BytesIO):
        def close(self):
            pass

    sink = Kept()
    file = planes.PlaneFile(sink, bits, block=100)
    docs = [(None if k % 7 == 0 else k, np.random.default_rng(k).integers(0, 1 << 31, k * 13 % 301).astype("<u4")) for k in range(60)]
    for key, ids in docs:
        file.add(key, ids)
    file.close()
    keys, sizes, ids = planes.read_file(sink.getvalue())
    assert keys == [k for k, _ in docs] and sizes.tolist() == [len(x) for _, x in docs] and (ids == np.concatenate([x for _, x in docs])).all()
    with pytest.raises(ValueError):
        planes.read_file(sink.getvalue()[:-1])


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip_against_the_library(spark, bits):
    rng = random.Random(9)
    texts = mixed_texts(rng, 200) + ["word " * 4000]
    rows = [(k * 3 % 201, t, "a") for k, t in enumerate(texts)] + [(500, None, "a"), (501, "", "a"), (501, "", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made, at, wanted = bpe.tokenizer(BYTES), 0, []
    for key, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 2]
        wanted.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = sorted(planes.planes_round_trip(frame, BYTES, bits=bits).collect(), key=lambda r: (r.start))
    for row in found:
        assert row.start == at
        at += row.n_tokens
    assert sorted((r.id, r.n_tokens, r.ids_crc32) for r in found) == sorted(wanted) and [r.id for r in found] == sorted(r[0] for r in rows)
    assert planes.planes_round_trip(frame.limit(0), BYTES).count() == 0


def test_pages_with_odd_attributes_and_deep_nesting():
    kept = '<article><p class="md:flex hidden lg:block">One long sentence of the article stands here, and it stays.</p><p title="a hidden thing">Another sentence of the article, which stays as well.</p>'
    lost = '<p hidden>Nobody sees this sentence of the page at all.</p><p style="color:red; display : none">Nor this one, whatever it says.</p><div aria-hidden="TRUE"><p>And not this one either, of course.</p></div></article>'
    assert html_text.main_text(kept + lost) == "One long sentence of the article stands here, and it stays.\nAnother sentence of the article, which stays as well."
    assert html_text.main_text('<article data-class="ad"><p data-id="nav">A sentence of the article that no advert holds.</p></article>') == "A sentence of the article that no advert holds."
    sentence = "A sentence of the article that is read from far below."
    for open_, close in (("<div>", "</div>"), ("<b>", "</b>"), ("<ul><li>", "</li></ul>")):
        deep = "<article>" + open_ * 50_000 + f"<p>{sentence}</p>" + close * 50_000 + f"<p>{sentence}</p></article>"
        assert html_text.main_text(deep) == f"{sentence}\n{sentence}"
    assert html_text.main_text("<article>" + "</i>" * 50_000 + "<b>" * 50_000 + "</i>" * 50_000 + f"<p>{sentence}</p>") == sentence


def test_distance_in_the_tree():
    root = html_text.Node(None, 0)
    chains = []
    for _ in range(2):
        node = root
        for _ in range(5):
            node = html_text.Node(node, node.depth + 1)
        chains.append(node)
    assert html_text.distance(*chains) == 10 and html_text.distance(root, chains[0]) == 5 and html_text.distance(root, root) == 0
    for _ in range(html_text.FAR):
        chains[0] = html_text.Node(chains[0], chains[0].depth + 1)
    assert html_text.distance(*chains) is None


def test_repeated_words_are_looked_up_once():
    made = bpe.tokenizer(BYTES)
    plain = lambda t: np.array(made.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    looked = collections.Counter()

    class Counting(planes.Memory):
        def fill(self, kind, keys):
            lookup = super().fill(kind, keys)
            return lookup if kind == "chunk" else lambda key: looked.update([key]) or lookup(key)

    texts = [b"one two two\none two", b"two one\ntwo", "\u00e9t\u00e9 two\u00a0x\nit's 'tis".encode(), b"", b" two  one\n\ntwo ", b"one\ttwo two", b"a <|endoftext|> b"] * 3
    assert planes.encode_texts(texts, Counting(planes._chunk_entries(BYTES), room=4), plain) == [plain(t) for t in texts]
    assert looked and set(looked.values()) == {1}
