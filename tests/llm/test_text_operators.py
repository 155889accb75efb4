"""SimHash, quality, toxicity, mixing and licences on small fixtures, against brute force."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
import regex
import xxhash

from quire.llm import licenses, mixing, quality, queries, simhash, toxicity
from quire.llm.components import components
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, id string, text_key string, __copy string, fp int"


def docs_of(spark, rows):
    """Rows of (doc_id, text, source), with columns that clash with inner names."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], DOCS)


def groups_of(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    edges = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    wanted = groups_of(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    assert found == wanted
    assert components(edges.limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", "One", "one TWO", "a b c", "x\x0by\tz\n\nw É é", "word " * 5000, "\xa0 q"):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_connects_what_brute_force_connects(seed):
    rng = np.random.default_rng(seed)
    roots = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))) for _ in range(600)]
    leaves = np.unique(np.array([rng.choice(roots) ^ f for f in flips], np.uint64))
    for right in (None, np.unique(leaves[::2] ^ np.uint64(5))):
        left = leaves if right is None else leaves[1::2]
        everyone = left if right is None else np.concatenate((left, right))
        others = left if right is None else right
        pairs = [(int(a), int(b)) for a in left for b in others if (int(a) ^ int(b)).bit_count() <= 3]
        wanted = groups_of(pairs, set(everyone.tolist()))
        got = groups_of(list(zip(*[x.tolist() for x in simhash.trie_join(left, right)])), set(everyone.tolist()))
        assert got == wanted


def test_simhash_groups_and_edge_rows(spark):
    base = [f"w{k}" for k in range(400)]
    near = [" ".join([*base[:-1], f"x{k}"]) for k in range(6)]
    rows = [(10 + k, t, "a") for k, t in enumerate(near)] + [(3, None, None), (4, "", "a"), (5, " \n", "b"), (6, "solo", "a"), (6, "solo", "a"), (None, "solo", "a"), (None, "lost words here only", None)]
    rows += [(50 + k, " ".join(random.Random(k).choices(base, k=300)), "c") for k in range(20)]
    found = simhash.simhash_groups(docs_of(spark, rows)).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = groups_of(links, range(len(rows)))
    lowest = {g: min((rows[k][0] for k in group if group[k] == g and rows[k][0] is not None), default=None) for g in group.values()}
    wanted = collections.Counter((r[0], p, lowest[group[k]]) for k, (r, p) in enumerate(zip(rows, prints)))
    assert collections.Counter((r.id, r.fp % (1 << 64), r.component) for r in found) == wanted
    kept = simhash.keep_first(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert kept.count() == len(lowest) and {r.doc_id for r in kept.collect()} == set(lowest.values())
    assert simhash.keep_first(docs_of(spark, [])).count() == 0


def test_quality_against_sql(spark):
    good, message = compare(spark, connect(SMALL), SMALL, queries.QUERIES["op8_line_frequency"], queries.ORACLES["op8_line_frequency"])
    assert good, message


def test_quality_removes_shared_lines_and_keeps_copies(spark):
    menu = "Home About Contact Terms and more of the same menu again"
    own = [" ".join(f"v{k}x{j}" for j in range(60 + 7 * k)) for k in range(40)]
    rows = [(k, f"{menu}\n{t}", "h") for k, t in enumerate(own)]  # a menu above own text: stays
    rows += [(100 + k, "\n".join([menu] * (6 + k)), "h") for k in range(2)]  # a menu alone: few texts, but repeated words
    body = [" ".join(f"b{j}" for j in range(k, k + 30)) for k in range(0, 120, 30)]
    rows += [(200 + k, "\n".join([*body, f"end {k}"]), "h") for k in range(60)]  # near copies of one text: no class of their own
    rows += [(300, None, None), (301, "", "h"), (302, "few words", "h"), (0, rows[0][1], "h")]
    judged = {(r.id, r.kept) for r in quality.judge(docs_of(spark, rows)).collect()}
    assert all((k, True) in judged for k in [*range(40), *range(200, 260)])
    assert {(300, False), (301, False), (302, False), (100, False)} <= judged
    kept = quality.keep_good(docs_of(spark, rows))
    assert kept.count() == 101 and kept.columns == docs_of(spark, rows).columns
    assert quality.judge(docs_of(spark, [])).count() == 0


def test_quality_rejects_depleted_documents(spark):
    lines = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(40)]
    rows = [(k, "\n".join(lines[: 8 + k]), "h") for k in range(30)]
    judged = {r.id: r for r in quality.judge(docs_of(spark, rows)).collect()}
    assert judged[0].removed_words == judged[0].n_words and not judged[0].kept and not judged[0].base_failed


def test_quality_hands_on_texts_without_frequent_lines(spark):
    menu = "Home  About Contact"
    own = [" ".join(f"v{k}x{j}" for j in range(60 + 7 * k)) for k in range(40)]
    rows = [(k, f"{menu if k % 2 else 'Home About\tContact'} \n\n{t}\n{menu}", "h") for k, t in enumerate(own)]
    rows += [(90, f"{menu}\n{own[0]}", "other"), (91, None, "h")]  # not frequent there; no text
    judged = {r.id: r for r in quality.judge(docs_of(spark, rows)).collect()}
    assert all(judged[k].text == f"\n{t}" and judged[k].removed_words == 6 for k, t in enumerate(own))
    assert judged[90].text == rows[40][1] and judged[90].removed_words == 0 and judged[91].text is None
    kept = {r.doc_id: r for r in quality.keep_good(docs_of(spark, rows)).collect()}
    assert {k: r.text for k, r in kept.items()} == {k: judged[k].text for k in [*range(40), 90]}
    assert all(tuple(r)[2:] == (rows[k][2] if k < 40 else "other", "x", "y", "z", 1) for k, r in kept.items())


def test_quality_moves_texts_compressed(spark):
    rows = [(k, "\n".join(f"line {k} of the same few words" for _ in range(50)), "h") for k in range(40)] + [(90, None, "h"), (91, "", None)]
    moved = quality._dropped(docs_of(spark, rows), "text", "source", quality.MAX_TEXTS, quality.MAX_SHARE, quality.MAX_CLASSES).collect()
    assert sum(len(r.text) for r in moved if r.text) < sum(len(t) for _, t, _ in rows if t) / 4
    judged = {r.id: r.text for r in quality.judge(docs_of(spark, rows)).collect()}
    assert judged == {k: t for k, t, _ in rows}


def test_repeated_words_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(12))]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        assert quality.repeated_words(words) == len(covered)


def toxic_rows(n=400):
    rng = random.Random(11)
    parts = ["the", "and", "ing", "her", "tion", "ver", "est", "on", "ar", "mi"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["moron", "idiot", "scum", "vequ" + word()])
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_learns_and_restores(spark):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, rows), marks)
    scores = {r.id: r.score for r in toxicity.toxicity(docs_of(spark, rows), model).collect()}
    right = [(scores[k] >= 0.5) == bool(t) for k, t in labels if __import__("zlib").crc32(str(k).encode()) % 5 == 0]
    assert sum(right) / len(right) >= 0.9
    hidden = [(1, "what a m0r0n you are", "s"), (2, "you i d i o t there", "s"), (3, "you are sc*um of the earth", "s"), (4, "moooooron", "s"), (5, None, None), (6, "", "s"), (7, "her ingest the tion", "s")]
    found = {r.id: r.score for r in toxicity.toxicity(docs_of(spark, hidden), model).collect()}
    assert found[1] > 0.5 and found[2] > 0.5 and found[4] > 0.5 and found[5] == found[6] < 0.5 and found[7] < 0.5
    kept = toxicity.keep_harmless(docs_of(spark, hidden), model)
    assert {r.doc_id for r in kept.collect()} >= {5, 6, 7} and not {r.doc_id for r in kept.collect()} & {1, 2, 4}
    empty = toxicity.train(docs_of(spark, []), marks.limit(0))
    assert not empty.shares and toxicity.toxicity(docs_of(spark, []), empty).count() == 0


def test_water_fill_and_quotas():
    assert mixing.water_fill([100, 100], [5, 1], 300) == [200.0, 100.0]
    for seed in range(5):
        rng = np.random.default_rng(seed)
        sizes, weights = rng.integers(0, 1000, 7).tolist(), [5, 2, 1, 5, 2, 1, 5]
        total = 1.5 * sum(sizes)
        targets = mixing.water_fill(sizes, weights, total)
        assert abs(sum(targets) - total) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(targets, sizes))
        open_ = [t / w for t, s, w in zip(targets, sizes, weights) if t < 2 * s - 1e-9]
        assert max(open_, default=0) - min(open_, default=0) < 1e-6
    quotas = mixing.split_quotas([100, 7, 0, 1], 6)
    assert quotas.sum(axis=0).tolist() == [100, 7, 0, 1] and (quotas.sum(axis=1) >= 18).all()
    assert (mixing.split_quotas([100, 7, 0, 1], 6) == quotas).all()


def test_mix_takes_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    rows += [(2000, "dup text here", "a"), (2000, "dup text here", "a"), (2001, None, "b"), (2002, "", None), (None, "no id", "b")]
    plan = mixing.mix_plan(docs_of(spark, rows)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [5, 2, 1, 5], 1.5 * sum(sizes.values()))))
    taken = collections.Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and len(r.copies) <= 2 and (r["size"] > 0 or not r.copies)
        taken[r.source] += r["size"] * len(r.copies) * r["rows"]
    assert all(abs(taken[s] - targets[s]) <= 40 for s in order)
    assert sum(r["rows"] for r in plan) == len(rows)
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert counts == collections.Counter({r.id: len(r.copies) * n for r in plan for n in [r["rows"]] if r.copies})
    assert sorted(map(str, mixing.mix_plan(docs_of(spark, rows)).collect())) == sorted(map(str, plan))
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_licences_against_brute_force(spark):
    texts = [
        "Released under the MIT License.", "relased undr the mit license", "Apache License, Version 2.0 and CC BY-NC", "cc by nc cc by nc", "all rights reservd", None, "",
        "ball rights reserved", "É under the mit license\x00under the MIT-license", "word " * 3000 + "licensed under cc by nc 40",
    ]
    found = {r.id: r for r in licenses.scan_licenses(docs_of(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()}
    for k, text in enumerate(texts):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        wanted = sorted((label, at) for phrase, label in licenses.PHRASES for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split())
        assert found[k].n_words == len(words) and sorted((p.label, p.first) for p in found[k].phrases) == wanted
    assert [n.label for n in found[1].notices] == ["mit"] and found[1].notices[0].edits == 2 and [n.label for n in found[4].notices] == ["proprietary"]
    assert not found[7].notices and [(n.label, n.first) for n in found[9].notices] == [("cc-by-nc", 3000)]
    rng, alphabet = random.Random(8), "abcdefghijklmnopqrstuvwxyz "
    for notice, _ in licenses.NOTICES[:1] + licenses.NOTICES[-1:]:
        k = licenses.allowed(notice)
        for _ in range(60):
            changed = list(notice)
            for _ in range(rng.randint(0, k + 2)):
                changed[rng.randrange(len(changed))] = rng.choice(alphabet)
            line = " ".join(("xyz " + "".join(changed) + " abc").split())
            hits = regex.finditer(rf"(?e)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])", line)
            plain = any(licenses.held(hit.group()) == licenses.held(notice) for hit in hits)
            assert bool(licenses.fuzzy_notices(line, ((notice, "x"),))) == plain


def test_licences_that_differ_by_a_number_or_a_short_name():
    def labels(text):
        return [f.label for f in licenses.fuzzy_notices(b" ".join(licenses.words_of(text.encode())).decode())]

    for text in (
        "This work is licensed under the GNU General Public License version 2", "licensed under CC BY ND 4.0", "licensed under the Apache License, Version 1.0",
        "released under the mut license", "licensed under cc by nd 4 0", "licensed under cc by 3 0",
    ):
        assert labels(text) == [], text
    assert labels("this werk is licensed under the GNU Generl Public License version 3") == ["gpl-3"]
    assert labels("licensd under CC-BY-NC 4.0") == ["cc-by-nc"] and labels("licensed undr CC BY 4.0!") == ["cc-by"] and labels("Licensed under the Apach License 2.0") == []
    many = "released under the mit licence and then " * 20_000
    assert len(licenses.fuzzy_notices(many)) == 20_000
