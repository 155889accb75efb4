"""Near-duplicate vectors by a robust-pruned flat graph, searched by ranges.

Equal vectors are one node. A bounded sample gives cluster centres; every node belongs to the shards of its few nearest
centres, so shards overlap. Within a shard each node keeps the robustly pruned list of its nearest neighbours and some
edges back; the lists that a node got in its shards are united. Each shard then searches the united graph for all its
members: a greedy beam search starts at the shard's medoids (and at the member's own node), and from every node within
the range it goes on through all neighbours that are within the range too. Hits are verified in double precision, and
counted only in the first shard that both nodes share, so that an overlap counts once. A sample of nodes is compared
with all vectors to audit the recall, averaged over nodes and over those with few links; if it is low, the graph is built
anew with twice the overlap, until comparing all vectors is no more work: then they are compared.

Each length of vectors has a graph of its own; the vectors of rare lengths are compared outright.

Shards above ``PART`` members are cut into parts, and every part is searched from every part of its shard, so a cluster
that holds a third of all vectors is many bounded tasks. Links are never listed: a task returns counts and stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, stored
from quire.llm.components import components
from quire.llm.simhash import Forest

COSINE = 0.9
#: Sampled vectors that the centres are fitted on, members that a shard would have without overlap, centres at most.
SAMPLE = 8192
SHARD = 1024
MOST_CENTRES = 1024
OVERLAP = 3
PART = 4096
#: Candidates of a node, edges it keeps, and the factor of robust pruning.
NEAREST = 64
DEGREE = 24
ALPHA = 1.2
MEDOIDS = 16
BEAM = 16
#: Nodes of a beam that one step goes on from.
AT_ONCE = 4
#: Nodes of the audit, and the recall below which the graph is built again.
AUDIT = 512
RECALL = 0.95
#: Links of a node that count as few: such nodes must reach the recall on their own.
FEW = 8
SLACK = 1e-4

_UNITS = pa.schema([("id", pa.int64()), ("unit", pa.binary())])


def _unit(values: list | None) -> bytes | None:
    if not values or any(v is None for v in values):
        return None
    vector = np.array(values, np.float64)
    if not np.isfinite(vector).all() or not (top := np.abs(vector).max()):
        return None
    vector /= top
    return (vector / math.sqrt(vector @ vector)).tobytes()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch_of(_UNITS, [batch.column(0), [_unit(v) for v in batch.column(1).to_pylist()]])


def fit_centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from spread-out starts; the same for the same sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[a : a + 1024] @ centres.T, axis=1) for a in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _assigned(centres: np.ndarray, overlap: int):
    schema = pa.schema([("centre", pa.int32()), ("key", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()), ("centres", pa.list_(pa.int32()))])
    m = min(overlap, len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, copies, units = (part.column(k).to_pylist() for k in range(3))
                near = np.sort(np.argsort(-(_matrix(units) @ centres.T), axis=1, kind="stable")[:, :m], axis=1)
                rows = [(c, key, n, unit, list(own)) for key, n, unit, own in zip(keys, copies, units, near.tolist(), strict=True) for c in own]
                yield batch_of(schema, list(zip(*rows, strict=True)))

    return assign


def robust_prune(vectors: np.ndarray, nearest: int = NEAREST, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each vector: nearest first, without those that an earlier neighbour is closer to; and edges back.

    A node that many name keeps the edges back to its nearest ones up to the degree. Every node is also named by the two
    neighbours it keeps first, whatever their number of edges: else no search would come to the rim of a dense cluster.
    """
    n = len(vectors)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    near = vectors.astype(np.float32)
    alike = near @ near.T
    np.fill_diagonal(alike, -2)
    k = min(nearest, n - 1)
    rows = np.arange(n)[:, None]
    candidates = np.argpartition(-alike, k - 1, axis=1)[:, :k]
    candidates = candidates[rows, np.argsort(-alike[rows, candidates], axis=1, kind="stable")]
    far, alive = 1 - alike[rows, candidates], np.ones((n, k), bool)
    sources, targets = [], []
    for _ in range(min(degree, k)):
        open_ = np.flatnonzero(alive.any(axis=1))
        if not len(open_):
            break
        pick = np.argmax(alive[open_], axis=1)
        chosen = candidates[open_, pick]
        sources.append(open_)
        targets.append(chosen)
        alive[open_] &= alpha * (1 - alike[chosen[:, None], candidates[open_]]) > far[open_]
        alive[open_, pick] = False
    a, b = np.concatenate(sources), np.concatenate(targets)
    # edges back, the nearest ones up to the degree
    order = np.lexsort((-alike[b, a], b))
    back, rank = b[order], np.arange(len(b))
    rank = rank - np.maximum.accumulate(np.where(np.concatenate(([True], back[1:] != back[:-1])), rank, 0))
    x, y = np.concatenate((a, back[rank < degree], *targets[:2])), np.concatenate((b, a[order][rank < degree], *sources[:2]))
    pairs = np.unique(x * n + y)
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("key", ignore_index=True)
    keys = frame["key"].to_numpy()
    return pd.DataFrame({"key": keys, "near": [keys[near] for near in robust_prune(_matrix(frame["unit"]))]})


def _medoids(vectors: np.ndarray, m: int = MEDOIDS) -> np.ndarray:
    """The most central vector, then again and again the one that is farthest from those chosen."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    best = vectors @ vectors[chosen[0]]
    while len(chosen) < min(m, len(vectors)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, vectors @ vectors[chosen[-1]])
    return np.array(chosen)


def range_search(graph: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, own: np.ndarray, cosine: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within the range that the search meets; ``lists`` has each node's neighbours, ``own`` each query's node, or -1."""
    n, m, limit = len(graph), len(queries), np.float32(cosine - SLACK)
    degree, near = np.array([len(x) for x in lists]), np.concatenate([*lists, np.empty(0, np.int64)])
    first = np.cumsum(degree) - degree
    starts = _medoids(graph)
    score = np.full((m, n), -2, np.float32)  # of the nodes met so far

    def meet(q: np.ndarray, node: np.ndarray) -> None:
        for at in range(0, len(q), 1 << 16):
            a, b = q[at : at + (1 << 16)], node[at : at + (1 << 16)]
            score[a, b] = np.einsum("pd,pd->p", queries[a], graph[b])

    def fresh(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = degree[node]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        q, around = np.repeat(q, size), near[np.repeat(first[node], size) + within]
        new = score[q, around] < -1
        flat = np.unique(q[new] * n + around[new])
        return flat // n, flat % n

    score[:, starts] = queries @ graph[starts].T
    has = np.flatnonzero(own >= 0)
    meet(has, own[has])
    done = np.zeros((m, n), bool)
    width = min(beam, n)
    while True:
        top = np.argpartition(-score, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(score, top, axis=1)
        waiting = np.where(np.take_along_axis(done, top, axis=1) | (value < -1), np.float32(-3), value)
        pick = np.argpartition(-waiting, min(AT_ONCE, width) - 1, axis=1)[:, :AT_ONCE]
        q, k = np.nonzero(np.take_along_axis(waiting, pick, axis=1) > -2)
        if not len(q):
            break
        node = top[q, pick[q, k]]
        done[q, node] = True
        meet(*fresh(q, node))
    while True:
        q, node = np.nonzero((score >= limit) & ~done)
        if not len(q):
            return np.nonzero(score >= limit)
        done[q, node] = True
        # as many at once as have a bounded number of edges together
        turns = np.flatnonzero(np.diff(np.cumsum(degree[node]) >> 18)) + 1
        for some, those in zip(np.split(q, turns), np.split(node, turns), strict=True):
            meet(*fresh(some, those))


def _searched(cosine: float, block: int = 128, exact: bool = False):
    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Members of one part of a shard as queries against the graph of another part, or of the same one; or against all of it."""
        centre, frame = key[0], frame.sort_values("key", ignore_index=True)
        nodes, asks = frame[frame["node"]].reset_index(drop=True), frame[frame["query"]].reset_index(drop=True)
        keys, asked = nodes["key"].to_numpy(), asks["key"].to_numpy()
        if not len(keys) or not len(asked):
            return pd.DataFrame({"key": [], "n": [], "root": []})
        units, wanted = _matrix(nodes["unit"]), _matrix(asks["unit"])
        lists = [] if exact else [np.searchsorted(keys, near[np.isin(near, keys)]) for near in nodes["near"]]
        own = np.searchsorted(keys, asked)
        own = np.where((own < len(keys)) & (keys[np.minimum(own, len(keys) - 1)] == asked), own, -1)
        homes, ask_homes = (np.array(f["centres"].tolist(), np.int64) for f in (nodes, asks))
        copies, links = nodes["copies"].to_numpy(), np.zeros(len(asked), np.int64)
        small, small_asks = units.astype(np.float32), wanted.astype(np.float32)
        forest = Forest(len(keys) + len(asked))
        for at in range(0, len(asked), block):
            if exact:
                q, node = np.nonzero(small_asks[at : at + block] @ small.T >= np.float32(cosine - SLACK))
            else:
                q, node = range_search(small, lists, small_asks[at : at + block], own[at : at + block], cosine)
            q = q + at
            keep = asked[q] != keys[node]
            q, node = q[keep], node[keep]
            for low in range(0, len(q), 1 << 16):
                a, b = q[low : low + (1 << 16)], node[low : low + (1 << 16)]
                true = np.einsum("pd,pd->p", wanted[a], units[b]) >= cosine
                a, b = a[true], b[true]
                forest.join(b, a + len(keys))
                both = (ask_homes[a][:, :, None] == homes[b][:, None, :]).any(axis=2)
                first = np.where(both, ask_homes[a], np.iinfo(np.int64).max).min(axis=1) == centre
                np.add.at(links, a[first], copies[b[first]])
        everyone = np.concatenate((keys, asked))
        member = np.flatnonzero(forest.root != np.arange(len(everyone)))
        out = pd.DataFrame({"key": asked[links > 0], "n": links[links > 0], "root": asked[links > 0]})
        stars = pd.DataFrame({"key": everyone[member], "n": np.zeros(len(member), np.int64), "root": everyone[forest.root[member]]})
        return pd.concat([out, stars], ignore_index=True)

    return search


def _audited(wanted: np.ndarray, asked: np.ndarray, cosine: float):
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                close = wanted @ _matrix(part.column(2).to_pylist()).T >= cosine
                total += (close & (asked[:, None] != part.column(0).to_numpy()[None])) @ part.column(1).to_numpy()
        if total.any():
            yield batch_of(schema, [asked[total > 0], total[total > 0]])

    return audit


def _linked(nodes: DataFrame, centres: np.ndarray, overlap: int, cosine: float) -> DataFrame:
    """``key``, ``n`` (links counted here), ``root``: build the graph, unite it, search it."""
    members = nodes.select("key", "copies", "unit").mapInArrow(_assigned(centres, overlap), "centre int, key long, copies long, unit binary, centres array<int>")
    sizes = {r.centre: r.n for r in members.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.element_at(F.lit([max(1, math.ceil(sizes.get(c, 0) / PART)) for c in range(len(centres))]), F.col("centre") + 1)
    members = stored(members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), "members")
    built = members.select("centre", "part", "key", "unit").groupBy("centre", "part").applyInPandas(_build, "key long, near array<long>")
    united = stored(built.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    return stored(_by_cell(members.join(united, "key")).applyInPandas(_searched(cosine), "key long, n long, root long"), "links")


def _by_cell(whole: DataFrame):
    """Members by shard and pair of its parts: the one asks, the other is searched."""
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("q"), F.lit(0).alias("g"), F.lit(True).alias("query"), F.lit(True).alias("node")))).otherwise(
        F.concat(
            F.transform(others, lambda o: F.struct(F.col("part").alias("q"), o.alias("g"), F.lit(True).alias("query"), (o == F.col("part")).alias("node"))),
            F.filter(F.transform(others, lambda o: F.struct(o.alias("q"), F.col("part").alias("g"), F.lit(False).alias("query"), F.lit(True).alias("node"))), lambda c: c["q"] != c["g"])))
    spread = whole.withColumn("cell", F.explode(cells)).select("centre", F.col("cell.q").alias("q"), F.col("cell.g").alias("g"), "cell.query", "cell.node", "key", "copies", "unit", "centres", "near")
    return spread.groupBy("centre", "q", "g")


def _compared(nodes: DataFrame, parts: int, cosine: float) -> DataFrame:
    """The same table as of ``_linked``, from comparing all vectors of one length with each other, in ``parts`` squared tasks."""
    centre = F.length("unit").cast("int")
    whole = nodes.select(
        centre.alias("centre"), F.lit(parts).alias("parts"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "copies", "unit",
        F.array(centre).alias("centres"), F.array().cast("array<bigint>").alias("near"))
    return stored(_by_cell(whole).applyInPandas(_searched(cosine, exact=True), "key long, n long, root long"), "links")


def audit_recall(exact: dict[int, int], found: dict[int, int]) -> float:
    """The recall of a node's links, averaged over the audited nodes that have links, or over those with few if that is lower."""
    each = [(v, min(v, found.get(k, 0)) / v) for k, v in exact.items() if v]
    few = [r for v, r in each if v <= FEW]
    return min((sum(rs) / len(rs) for rs in ([r for _, r in each], few) if rs), default=1.0)


def _of_one_length(nodes: DataFrame, n: int, cosine: float, overlap: int) -> tuple[DataFrame, float]:
    """The links of ``n`` nodes of one length and the recall of their audit."""
    sample = nodes.select("key", "unit").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    fitted = _matrix([r.unit for r in sample])
    centres = fit_centres(fitted, max(1, min(MOST_CENTRES, len(sample), n // SHARD)))
    asked = np.array([r.key for r in sample[:AUDIT]])
    exact = {r.key: r.n for r in nodes.select("key", "copies", "unit").mapInArrow(_audited(fitted[:AUDIT], asked, cosine), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    while True:
        links = _linked(nodes, centres, overlap, cosine)
        found = {r.key: r.n for r in links.where(F.col("key").isin(asked.tolist())).groupBy("key").agg(F.sum("n").alias("n")).collect()}
        recall = audit_recall(exact, found)
        if recall >= RECALL:
            return links, recall
        overlap *= 2
        # shards of n * overlap / centres members are together as much work as all pairs
        if overlap * overlap >= len(centres):
            return _compared(nodes, math.ceil(n / PART), cosine), 1.0


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """One row per row: ``id``, ``n_links`` (other vectors within the range), ``component`` (smallest id reachable, itself
    included) and ``recall`` (of the audit).

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Vectors of different lengths
    do not link; the recall is the lowest of all lengths. Repeated rows are vectors of their own and link with each other. Rows without
    an id have links but name no component. An empty table gives no rows.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = stored(plain.mapInArrow(_units, "id long, unit binary").withColumn("key", F.when(F.col("unit").isNotNull(), F.xxhash64("unit"))), "units")
    classes = rows.where("unit is not null").groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    classes = stored(classes, "classes")
    lengths = classes.groupBy(F.length("unit").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "size").collect()
    recall, links = 1.0, None
    for k, length in enumerate(lengths):
        if k and length.n <= PART:
            # rare lengths, one task each
            rare = [r.size for r in lengths[k:]]
            links = links.unionByName(_compared(classes.where(F.length("unit").isin(rare)), 1, cosine))
            break
        more, audited = _of_one_length(classes.where(F.length("unit") == length.size), length.n, cosine, overlap)
        recall, links = min(recall, audited), more if links is None else links.unionByName(more)
    if links is None:
        counted = classes.select("key", F.lit(0).cast("long").alias("n"), F.col("key").alias("root"))
    else:
        roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
        counts = links.groupBy("key").agg(F.sum("n").alias("n"))
        counted = classes.select("key").join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
        counted = counted.select("key", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("root", "key").alias("root"))
    counted = stored(classes.select("key", "low", "copies").join(counted, "key"), "counted")
    named = counted.groupBy("root").agg(F.min("low").alias("component"))
    named = counted.join(named, "root").select("key", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component")
    linked = rows.where("key is not null").select("id", "key").join(named, "key").select("id", "n_links", "component")
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("recall", F.lit(float(recall)))
