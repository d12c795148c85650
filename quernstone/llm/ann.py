"""Nearest neighbours by an inverted multi-index.

Vectors are extended by one coordinate so that the largest inner product is the smallest distance, and cut into two
halves; each half has its own centroids, fitted on a bounded sample. Every vector is put into the cell of its centroid pair.
A query walks the centroid pairs in order of summed distance, by a heap over the two sorted distance lists, until the
cells it has met hold enough vectors. Then those cells' vectors are ranked anew by the true inner product.

How many vectors are enough is measured: for some vectors of the sample, at which share of the sample their true neighbours'
cells come up in the walk. Clustered vectors need little, random directions nearly half.

The index is stored in parts: neighbouring first centroids share one until it is full, and one with more vectors than that
(or very many copies of one vector) is dealt over several by a salt. The queries are dealt over chunks. A task ranks, for one part
and one chunk, the part's share of each query's cells, which come as a bit map, and passes on no more than k a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

#: Centroids of a half (so 16,384 cells), vectors that they are fitted on (the documented bound), and rounds of fitting.
CENTROIDS, SAMPLE, ROUNDS = 128, 20_000, 12
#: A query visits cells until they hold a share of all vectors, and at least LEAST_CANDIDATES. The share is the one at
#: which PROBES vectors of the sample meet RECALL of their neighbours in the sample.
RECALL, PROBES, LEAST_CANDIDATES = 0.95, 256, 2_000
#: Vectors of one part of the index, and queries of one chunk.
PART, CHUNK = 4_096, 8_192


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = nearest(x, centres)
        for j in range(k):
            mine = x[of == j]
            centres[j] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def halves(x: np.ndarray, most: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of vectors that are extended to length `most` (stored vectors) or by 0 (queries, most None)."""
    more = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(0, most**2 - (x * x).sum(1)))
    d = x.shape[1] // 2
    return x[:, :d], np.column_stack([x[:, d:], more])


def walk(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Filled centroid pairs in order of d1 + d2, until they hold `enough` vectors."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, out, held = [(d1[o1[0]] + d2[o2[0]], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if n := count[o1[i], o2[j]]:
            out.append((int(o1[i]), int(o2[j])))
            held += n
        if j + 1 < len(o2):
            heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))
    return out


def share_for(sample: np.ndarray, most: float, c1: np.ndarray, c2: np.ndarray, k: int) -> float:
    """The share of the sample's vectors that a query has to visit to meet RECALL of its k nearest in the sample."""
    if len(sample) < 2:
        return 1.0
    h1, h2 = halves(sample, most)
    cell = nearest(h1, c1) * len(c2) + nearest(h2, c2)
    count = np.bincount(cell, minlength=len(c1) * len(c2))
    needed = []
    for i in range(0, len(sample), -(-len(sample) // PROBES)):
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        d1, d2 = (distances(h, c)[0] for h, c in zip(halves(sample[i : i + 1], None), (c1, c2), strict=True))
        order = np.argsort((d1[:, None] + d2).ravel(), kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(count[order])
        needed += before[cell[near]].tolist()
    return float(np.quantile(needed, RECALL, method="higher")) / len(sample)


def usable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, v: array of doubles) of the rows that take part: those with an id and a vector that is not null, empty or
    zero, holds no null and no number that is not finite, and has the most common length."""
    v = F.transform(F.col(f"`{value}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length[0] if length else 0))


def search(vectors: DataFrame, k: int = 20, every: int = 20, share: float | None = None, least: int = LEAST_CANDIDATES) -> DataFrame:
    """For each row of vectors (vec_id, embedding) whose vec_id is divisible by `every`: its k nearest found among all other
    rows, by inner product in double precision: query_id, rank from 1, vec_id, score; ties to the smaller vec_id. share: of
    all vectors, to be visited; measured if not given.

    Only a query's own row is no candidate. Rows that share a vec_id are rows like others: each is found, and each is a
    query of its own, whose results have that query_id. Rows named in usable() take no part; other columns are left out; an empty
    table gives an empty result."""
    spark = vectors.sparkSession
    with scratch(spark) as kept:
        rows = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()))
        schema = "query_id long, rank int, vec_id long, score double"
        n, asking, most = rows.select(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
        if n < 2:
            return spark.createDataFrame([], schema)
        sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id", "row"), "row").select("v").limit(SAMPLE).collect()])
        c1, c2 = (kmeans(h, CENTROIDS) for h in halves(sample, most))
        index = kept(rows.mapInArrow(_placer(most, c1, c2), "row long, vec_id long, v array<double>, c1 int, c2 int"))
    count = np.zeros((len(c1), len(c2)), np.int64)
    for a, b, m in index.groupBy("c1", "c2").count().collect():  # at most CENTROIDS squared rows
        count[a, b] = m
    share = share_for(sample, most, c1, c2, k) if share is None else share
    enough = max(least, int(share * n)) + 1
    group, first, held = np.zeros(len(c1), np.int64), [0], 0
    for i, m in enumerate(count.sum(1)):
        if held and held + m > PART:
            first.append(i)
            held = 0
        held += int(m)
        group[i] = len(first) - 1
    parts = [max(1, -(-int(count[group == g].sum()) // PART)) for g in range(len(first))]
    local, chunks = np.arange(len(c1)) - np.array(first)[group], max(1, -(-asking // CHUNK))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 2))
            h1, h2 = halves(x, None)
            for row, q, v, d1, d2 in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), x, distances(h1, c1), distances(h2, c2), strict=True):
                cells = np.zeros(count.shape, bool)
                cells[tuple(np.array(walk(d1, d2, count, enough)).T)] = True
                for g in np.unique(group[cells.any(axis=1)]):
                    bits = np.packbits(cells[group == g]).tobytes()
                    for p in range(parts[g]):
                        for column, y in zip(out, (int(g) * 1_000_000 + p, row, q, v, bits), strict=True):
                            column.append(y)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["part", "row", "vec_id", "v", "cells"])

    asked = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v").mapInArrow(visit, "part long, row long, vec_id long, v array<double>, cells binary")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("c1") + 1)
    part = of(group) * F.lit(1_000_000).cast("long") + F.pmod(F.xxhash64("row"), of([parts[g] for g in group]))
    stored = index.select(part.alias("part"), "row", "vec_id", "v", (of(local) * len(c2) + F.col("c2")).alias("cell"))
    stored = stored.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("chunk", F.col("chunk").cast("long"))
    found = asked.groupBy("part", "chunk").cogroup(stored.groupBy("part", "chunk")).applyInArrow(_ranker(k), "row long, part long, query_id long, vec_id long, score double")

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k)
        return rows.groupBy(*keys).agg(top.alias("best"))

    # in two steps, so that no task has k rows of each of very many parts for a query
    some = best(found.withColumn("part", F.col("part") % 64), "row", "query_id", "part").select("row", "query_id", F.explode("best").alias("e")).select("row", "query_id", "e.*")
    top = best(some, "row", "query_id").select("query_id", F.posexplode("best").alias("at", "e"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def _placer(most: float, c1: np.ndarray, c2: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                h1, h2 = halves(x, most)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(nearest(h1, c1).astype(np.int32)), pa.array(nearest(h2, c2).astype(np.int32))], ["row", "vec_id", "v", "c1", "c2"])

    return place


def _ranker(k: int):
    def rank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, row, cell = (right.column(c).to_numpy() for c in ("vec_id", "row", "cell"))
            y = right.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            asked = left.column("v").combine_chunks().flatten().to_numpy().reshape(left.num_rows, -1)
            for q_row, q, x, bits in zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist(), asked, left.column("cells"), strict=True):
                visited = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8)).astype(bool)
                here = np.flatnonzero(visited[cell] & (row != q_row))
                if not len(here):
                    continue
                s = y[here] @ x
                if len(here) > k:
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    top = np.flatnonzero(s >= edge - 1e-9 * max(1.0, abs(edge)))
                    here, s = here[top], s[top]
                s = np.array([_dot(x, z) for z in y[here]])
                best = np.lexsort((ids[here], -s))[:k]
                out += [(q_row, key[0].as_py(), q, int(ids[here[b]]), float(s[b])) for b in best]
        cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["row", "part", "query_id", "vec_id", "score"])

    return rank


def _dot(x: np.ndarray, y: np.ndarray) -> float:
    """The inner product summed from the first component on, so that equal vectors score alike wherever they stand."""
    return float(np.add.accumulate(x * y)[-1])


#: Brute force in SQL. Up to LEAST_CANDIDATES rows every query visits all cells, so that the search is exact and equals it; on
#: larger tables the search is held to a recall instead.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
