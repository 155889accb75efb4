"""Presence-mask search, conversation repair and differencing, against brute force and their SQL on small fixtures."""

from __future__ import annotations

import collections
import functools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from quire.llm import differencing, lexical, queries, turns
from tests.compare import rows_of


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        columns, values = rows
        con.execute(f"create table {name} ({columns})")
        if values:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(values[0]))})", values)
    done = con.execute(sql)
    return rows_of([c[0] for c in done.description], done.fetchall())


def brute_search(docs, items, top=10):
    split = [(k, lexical.terms(None if t is None else t.encode())) for k, t in docs]
    split = [(k, w) for k, w in split if w]
    n, size = len(split), sum(len(w) for _, w in split)
    df = collections.Counter(t for _, w in split for t in set(w))
    asked = collections.defaultdict(set)
    for k, t in items:
        asked[k] |= set(lexical.terms(None if t is None else t.encode()))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for key, words in split:
            tf, m = collections.Counter(words), 10 + 90 * len(words) * n // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in wanted if tf[t])
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        scored.sort()
        out |= {(item, r + 1, key, -s) for r, (s, _, _, key) in enumerate(scored[:top])}
    return out


def search_fixture():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(90)] + ["Ärger", "日本", "x9"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, "!! --"), (None, "w1 w2 w3"), (7, docs[7][1]), (8, docs[7][1]), (9, "W1-w1_W1.w1"), (600, "w5 " * 30_000), (601, "ÄRGER ärger"), (602, "a b İx")]
    items = [(0, "w1 w2 W2 w3"), (1, None), (2, "nothing known"), (3, " ".join(words[:80])), (4, "w5"), (None, "日本 x9"), (6, "w7"), (6, "w8 w9"), (7, "a b"), (8, "")]
    return docs, items


def test_terms():
    assert lexical.terms("It's 9 ÉTÉ-x\x00y_z q".encode()) == [w.encode() for w in ("it", "s", "9", "ÉtÉ", "x", "y", "z q")]
    assert lexical.terms(None) == lexical.terms(b"") == []


@pytest.mark.parametrize("pass_terms", [100_000, 25])
def test_search_against_brute_force_and_sql(spark, pass_terms, monkeypatch):
    docs, items = search_fixture()
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, rank string").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    found = lexical.search(frame, asked, pass_terms=pass_terms)
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == brute_search(docs, items) and len(rows) == len(set(rows))
    assert lexical.search(frame.limit(0), asked).count() == lexical.search(frame, asked.limit(0)).count() == 0
    if pass_terms > 25:
        wanted = sql_rows(queries.ORACLES["op11_presence_masks"], documents=("doc_id bigint, text varchar", docs), benchmark=("item_id bigint, text varchar", items))
        assert rows_of(found.columns, rows) == wanted


def test_search_of_blocks_stops_early_and_loses_nothing():
    rng = random.Random(2)
    vocabulary = 100
    for size in (5, 40, 100):
        item = np.array(sorted(rng.sample(range(vocabulary), size)), np.int64)
        weights = np.array([rng.choice([0, 1, 50, 9000]) for _ in range(vocabulary)], np.int64)
        best, every, scored, total = lexical.Best(10), [], 0, 0
        for _ in range(4):
            block = lexical.Block(vocabulary)
            for key in rng.sample(range(10_000), 400):
                held = rng.sample(range(vocabulary), rng.choice([1, 2, 3, 30]))
                block.add(key, rng.randint(10, 300), {t: rng.choice([1, 1, 2, 9]) for t in held})
            block.close()
            scored, total = scored + lexical.search_block(block, item, weights, best, first=4), total + 400
            gain = np.zeros(vocabulary, np.int64)
            gain[item] = weights[item]
            every += [(-s, k) for s, k in zip(block.scores(np.arange(400), gain).tolist(), block.key.tolist(), strict=True) if s > 0]
        assert [(-s, k) for s, k, _ in best.rows.tolist()] == sorted(every)[:10]
        assert scored < total


def brute_audit(symbols: str) -> tuple[int, str]:
    """Least (cost, letters) over all edits, by states of the grammar and positions."""
    keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
    forced = {0: 2, 1: 2, 2: 3, 3: 2}

    @functools.cache
    def best(k, state, inserts):
        found = []
        if k == len(symbols):
            if state in (0, 3):
                found.append((0, ""))
        else:
            def then(cost, letter, to):
                c, rest = best(k + 1, to, 3)
                found.append((c + cost, letter + rest))

            then(2, "D", state)
            if symbols[k] != "x":
                fine = 5 if symbols[k].isupper() else 0
                then(1 + fine, "R", forced[state])
                if state in keep[symbols[k].lower()]:
                    then(fine, "K", keep[symbols[k].lower()][state])
        if inserts:
            c, rest = best(k, forced[state], inserts - 1)
            found.append((c + 5, "I" + rest))
        return min(found, default=(10**9, ""))

    return best(0, 0, 3)


def letters_of(made):
    return "".join(e.replace("|", "")[::2] for e in made)


def test_repair_is_the_least_of_all_edits():
    rng = random.Random(1)
    assert len(turns.vectors()) < 200
    texts = ["x", "s", "u", "a", "o", "S", "us", "ss", "aaaa", "sxuA", "uuuu", "UAUA", "aSuoxAsuau"]
    texts += ["".join(rng.choices("xsuaoSUAO", k=rng.randint(1, 40))) for _ in range(400)] + ["".join(rng.choices("sua", k=rng.randint(1, 30))) for _ in range(200)]
    for text in texts:
        cost, letters = brute_audit(text)
        cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 3))))
        pieces = [text[a:b].encode() for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert letters_of([e for made in turns.trace(pieces) for e in made]) == letters, text
        vector, total = turns.price(text.encode())
        assert total + turns.vectors()[vector][0] == cost
        assert turns.price(text.encode(), block=1) == turns.price(text.encode(), block=3) == (vector, total)


CONVERSATIONS = "conv_id bigint, turn bigint, role varchar, text varchar"


def conversations():
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ugly", "User"], ["Yes.", "no", " \t", "", None, "Why?!", "Long " * 50 + ".", "é!\n", "x ", "a.b"]
    rows = [(c, t, rng.choice(roles[:3] if c % 3 else roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (100, 3, "assistant", "Yes."), (None, 0, "user", "Hello."), (None, 9, None, None), (None, None, "system", "Be.")]
    rows += [rows[3], rows[3], (-5, -2, "user", "Minus."), (-5, 4, "assistant", "Plus.")]
    rows += [(200, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(9000)] + [(201, 0, "user", "z " * 200_000)]
    return rows


def test_conversations_against_sql(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, at int, key string, conv string").repartition(5)
    fixed = turns.repair(turns.damage(frame))
    found = turns.audits(frame, fixed).withColumnRenamed("conv", "conv_id")
    short = [r for r in rows if r[0] != 200]
    wanted = sql_rows(queries.ORACLES["op12_block_tables"], conversations=(CONVERSATIONS, short))
    got = [tuple(r) for r in found.collect()]
    assert rows_of(found.columns, [r for r in got if r[0] != 200]) == wanted
    long = next(r for r in got if r[0] == 200)
    again = sorted((r.at, r.step, r.role, r.text) for r in turns.repaired(fixed.where("conv = 200")).collect())
    assert [r[2] for r in again] == ["user", "assistant"] * (len(again) // 2)
    damaged = [r for r in rows if r[0] == 200 and zlib.crc32(f"200:{r[1]}".encode()) % 20 != 0]
    assert long[1] == damaged[-1][1] - damaged[0][1] + 1 - len(damaged)
    assert turns.audits(frame.limit(0), turns.repair(turns.damage(frame.limit(0)))).count() == 0


def plain_difference(sizes, shards):
    parts = [[s] + [0] * (shards - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: -(p[0] - p[-1]))
        a, b, *parts = parts
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


def test_difference():
    rng = random.Random(6)
    assert differencing.difference([], 3) == [] and differencing.difference([5], 3) == [0]
    assert plain_difference([8, 7, 6, 5, 4], 2) == [16, 14]
    for n, shards in ((6, 2), (40, 3), (300, 8), (2000, 8)):
        # different sizes, so that equal spreads hardly matter
        sizes = [rng.randrange(10**9) for _ in range(n)]
        loads = [0] * shards
        for size, shard in zip(sizes, differencing.difference(sizes, shards), strict=True):
            loads[shard] += size
        assert sorted(loads, reverse=True) == plain_difference(sizes, shards)
        if n >= 300:
            assert max(loads) - min(loads) < sum(sizes) / shards / 1000


def shard_rows(spark, docs, **options):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in docs], "doc_id long, text string, shard int, digest string, size string").repartition(4)
    return frame, [tuple(r) for r in differencing.shard_slots(frame, **options).collect()]


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(differencing, "RUN", 7)
    monkeypatch.setattr(differencing, "PART", 10)
    rng = random.Random(8)
    docs = [(k, "t" * rng.randint(1, 400) + str(k % 600)) for k in range(1500)] + [(5000 + k, "the same text") for k in range(300)]
    docs += [(7000, None), (7001, ""), (None, "é"), (None, "é"), (3, "dup")] + [(4, "rows")] * 40 + [(9, "y" * 300_000)]
    frame, rows = shard_rows(spark, docs)
    assert sorted((k is None, k, s, c) for k, s, c, _, _ in rows) == sorted((k is None, k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs)
    slots, loads, homes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for _, size, crc, shard, slot in rows:
        slots[shard].append(slot)
        loads[shard] += size
        homes[size, crc].add(shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert all(len(h) == 1 for h in homes.values())
    # the long text is more than one shard's part: it stands nearly alone, the others are equal
    rest = sorted(loads.values())[:-1]
    assert rest[-1] - rest[0] < sum(rest) / len(rest) / 100 and max(loads.values()) < 300_000 + 50_000
    assert sorted(map(repr, rows)) == sorted(map(repr, shard_rows(spark, docs[::-1])[1]))
    assert shard_rows(spark, [])[1] == []
    placed = differencing.with_shard(frame, out="home")
    assert placed.columns == [*frame.columns, "home"]
    assert {(r.doc_id, r.home) for r in placed.collect()} == {(r[0], r[3]) for r in rows}


def test_items_of_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(differencing, "UNITS", 16)
    docs = [(k, f"text {k}") for k in range(2000)] + [(5000 + k, "copies of one text") for k in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    units = differencing._units(frame, "doc_id", "text")
    items = differencing._items(units, 8, 32).collect()
    assert len(items) <= 16 + 32 and sum(i.digest is not None for i in items) == 1
    loads = collections.Counter()
    for _, size, _, shard, _ in shard_rows(spark, docs, bundles=32)[1]:
        loads[shard] += size
    assert len(loads) == 8
