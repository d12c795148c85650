"""Benchmark decontamination by the q-gram lemma.

An item of m characters that stands in a document with at most k edits shares at least m - q + 1 - k q of its q-grams with
it, all of them on 2k + 1 neighbouring diagonals (place in the document less place in the item). Matching q-grams are
counted in overlapping bands of diagonals; a band that has fewer than the lemma asks for is left, and the rest are verified by an
alignment that stays within the band. Both sides are compared in lower case with white space collapsed.

A gram that stands at many places of one item (a periodic text) would make a pair of each with each of its places in the
document. What is counted is places in the document, though: each of them takes part in an alignment once at most. So of the
item's places those suffice that put one count into every band which any of them reaches: its first, its last and, from the
first on, one each band width. The counts are then still no smaller than the lemma's, and nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Length of the grams, and edits allowed a character of the item: below 1/q, so that the lemma's bound is positive.
Q, RATE = 10, 0.08
#: Items, and characters of items, that a pass over the documents looks for: bounds the broadcast (16 bytes a character
#: and the table of BITS); more items make more passes.
BLOCK, BLOCK_CHARS = 10_000, 4_000_000
#: Characters whose grams are looked up at a time, pairs of equal grams that are counted at a time, and counts that may
#: wait until those of finished bands are taken out. Together they bound a task's memory for texts of any kind.
WINDOW, PAIRS, WAITING = 1 << 19, 1 << 20, 1 << 21
#: Diagonals of one alignment, as far as neighbouring bands are aligned at once.
WIDTH = 1 << 15
#: Bits of the table that tells most grams of a document apart from all grams of the items.
BITS = 22
_P = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item of m characters; never so many that the lemma says nothing."""
    return max(0, min(math.floor(rate * m), (m - q) // q))


def least_shared(m: int, k: int, q: int = Q) -> int:
    return m - q + 1 - k * q


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, made from those of powers of two."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, width, done, have = np.zeros(n, np.uint64), 1, 0, codes * _P + np.uint64(1)
    with np.errstate(over="ignore"):
        while width <= q:
            if q & width:
                out = out * _power(width) + have[done : done + n]
                done += width
            if 2 * width <= q:
                have = have[:-width] * _power(width) + have[width:]
            width *= 2
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))


@dataclass
class Index:
    ids: list
    texts: list[str]
    hashes: np.ndarray  # of all grams of the items, sorted
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    short: list[int]  # items below q characters, which have no gram
    q: int


def build(items: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> Index:
    """Items that are empty after normalisation match nothing and are left out."""
    items = [(i, t) for i, x in items if (t := normal(x))]
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
    for _, t in items:
        h = gram_hashes(_codes(t), q)
        p = _thinned(h, 2 * budget(len(t), q, rate) + 1)
        hashes.append(p[0])
        places.append(p[1])
    item = np.repeat(np.arange(len(items), dtype=np.int32), [len(p) for p in places[1:]])
    all_, place = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(all_, kind="stable")
    seen = np.zeros(1 << BITS, bool)
    seen[all_ >> np.uint64(64 - BITS)] = True
    return Index([i for i, _ in items], [t for _, t in items], all_[order], item[order], place[order], seen, [k for k, (_, t) in enumerate(items) if len(t) < q], q)


def _thinned(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of an item's grams; of a gram at more places than its span has bands of this size, the places that
    reach every such band."""
    kinds, first, of, many = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    last = np.zeros(len(kinds), np.int64)
    last[of] = np.arange(len(hashes))  # the last assignment stays
    steps = (last - first) // size + 2
    dense = many > steps
    plain = ~dense[of]
    out = [(hashes[plain], np.flatnonzero(plain))]
    for g in np.flatnonzero(dense):
        at = np.unique(np.append(np.arange(first[g], last[g] + 1, size), last[g]))
        out.append((np.full(len(at), kinds[g]), at))
    return np.concatenate([h for h, _ in out]), np.concatenate([p for _, p in out]).astype(np.int32)


def align(item: str, region: str, k: int, low: int, high: int) -> tuple[int, int, int] | None:
    """The fewest edits from item to a substring of region whose diagonals (place in region less place in item) stay in
    [low, high], if at most k, with that substring's start and end; the leftmost end among equals."""
    a, b = _codes(item), _codes(region)
    width, inf = high - low + 1, k + 1
    diag = np.arange(low, high + 1)
    # row 0: the substring may start anywhere on the region
    cost = np.where((diag >= 0) & (diag <= len(b)), 0, inf)
    start = diag.copy()
    step = np.arange(width)
    for i in range(1, len(a) + 1):
        j = diag + i  # place in region after this column
        ok = (j >= 1) & (j <= len(b))
        same = np.zeros(width, bool)
        same[ok] = b[j[ok] - 1] == a[i - 1]
        sub = np.where(ok, cost + ~same, inf)
        drop = np.append(cost[1:] + 1, inf)  # the item's character is left out
        drop[(j < 0) | (j > len(b))] = inf
        best = np.minimum(sub, drop)
        from_ = np.where(sub <= drop, start, np.append(start[1:], 0))
        # characters of the region put in: best[d] = min over e <= d of best[e] + d - e
        shifted = best - step
        low_so_far = np.minimum.accumulate(shifted)
        at = np.maximum.accumulate(np.where(shifted == low_so_far, step, 0))
        at = np.where(shifted == low_so_far, step, at)
        cost = np.minimum(low_so_far + step, inf)
        cost[(j < 0) | (j > len(b))] = inf
        start = from_[at]
        if cost.min() > k:
            return None
    d = int(np.argmin(cost))
    return (int(cost[d]), int(start[d]), int(diag[d] + len(a))) if cost[d] <= k else None


def _folded(doc: np.ndarray, item: np.ndarray, band: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts n summed by document, item and band, in that order."""
    if not len(n):
        return doc, item, band, n
    order = np.lexsort((band, item, doc))
    doc, item, band, n = doc[order], item[order], band[order], n[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
    return doc[first], item[first], band[first], np.add.reduceat(n, first)


def _full(need: np.ndarray, doc: np.ndarray, item: np.ndarray, band: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the sorted bands have, with the next one, as many counts as the lemma asks for. A pair that starts in an
    empty band needs no look of its own: the alignment reaches an item's edits beyond its bands."""
    if not len(n):
        return np.zeros(0, bool)
    next_ = np.append((doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1), False)
    return n + np.where(next_, np.append(n[1:], 0), 0) >= need[item]


def _crowded(index: Index, texts: list[str], sizes: np.ndarray, need: np.ndarray, chars: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, band) of the bands that have, with the next band, the grams that the lemma asks for. sizes, need and
    chars: an item's width of a band, least number of grams, and length."""
    q = index.q
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    held: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in range(4))
    for begin in range(0, max(1, len(codes)), WINDOW):
        grams = gram_hashes(codes[begin : begin + WINDOW + q - 1].astype(np.uint64), q)
        maybe = np.flatnonzero(index.seen[grams >> np.uint64(64 - BITS)])
        low = np.searchsorted(index.hashes, grams[maybe], "left")
        many = np.searchsorted(index.hashes, grams[maybe], "right") - low
        maybe, low, many = maybe[many > 0] + begin, low[many > 0], many[many > 0]
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // PAIRS, prepend=0, append=-1))
        for x, y in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            pos = np.repeat(maybe[x:y], many[x:y])
            if not len(pos):
                continue
            entry = np.repeat(low[x:y] - np.cumsum(many[x:y]) + many[x:y], many[x:y]) + np.arange(len(pos))
            item, doc = index.item[entry].astype(np.int64), np.searchsorted(starts, pos, "right") - 1
            band = (pos - starts[doc] - index.place[entry]) // sizes[item]
            new = _folded(doc, item, band, np.ones(len(pos), np.int64))
            held = _folded(*map(np.concatenate, zip(held, new, strict=True)))
            if len(held[0]) > WAITING:  # later places reach neither these bands nor the next ones
                doc, item, band, _ = held
                done = starts[doc] + (band + 2) * sizes[item] + chars[item] <= pos[-1]
                full = _full(need, *held) & done
                yield doc[full], item[full], band[full]
                held = tuple(c[~done] for c in held)
    full = _full(need, *held)
    yield tuple(c[full] for c in held[:3])


def search(index: Index, texts: list[str], rate: float = RATE) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, edits, start, end) for each item found in each normal text: the fewest
    edits, leftmost among equals."""
    q = index.q
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item in index.short:
        for doc, text in enumerate(texts):
            if (at := text.find(index.texts[item])) >= 0:
                found[doc, item] = (0, at, at + len(index.texts[item]))
    if not len(index.hashes) or not texts:
        return [(d, t, *hit) for (d, t), hit in sorted(found.items())]
    m = np.array([len(x) for x in index.texts])
    k = np.array([budget(x, q, rate) for x in m])
    bands: dict[tuple[int, int], list[int]] = {}
    for docs, items, which in _crowded(index, texts, 2 * k + 1, least_shared(m, k, q), m):
        for d, t, x in zip(docs.tolist(), items.tolist(), which.tolist(), strict=True):
            bands.setdefault((d, t), []).append(x)
    for (d, t), mine in bands.items():
        what, text, kk, size = index.texts[t], texts[d], int(k[t]), int(2 * k[t] + 1)
        if (at := text.find(what)) >= 0:
            found[d, t] = (0, at, at + len(what))
            continue
        if not kk:
            continue
        spans: list[list[int]] = []  # neighbouring bands are aligned at once
        for x in sorted(set(mine)):
            low, high = x * size - kk, (x + 2) * size + kk
            if spans and low <= spans[-1][1] and high - spans[-1][0] <= max(WIDTH, 3 * size):
                spans[-1][1] = high
            else:
                spans.append([low, high])
        best = None
        for low, high in spans:
            left, right = max(0, low), min(len(text), high + len(what))
            # what has as many edits as the best so far may still be further left
            hit = align(what, text[left:right], best[0] if best else kk, low - left, high - left)
            if hit and (best is None or (hit[0], hit[1] + left, hit[2] + left) < best):
                best = (hit[0], hit[1] + left, hit[2] + left)
        if best:
            found[d, t] = best
    return [(d, t, *hit) for (d, t), hit in sorted(found.items())]


SCHEMA = "doc_id long, item_id long, edits int, start long, end long, item_chars int"


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The stated items, a block at a time; repeated rows once."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) == size or chars + len(row[1]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs (doc_id, text) and each item of benchmark (item_id, text) found in it: doc_id, item_id,
    the fewest edits, start and end (end exclusive) in the normal text, the leftmost of equals, and the item's length.

    An item counts as found if a part of the document is within floor(rate * length) edits of it (but never more than the
    lemma can rule out; items below 2q characters must stand verbatim). Null or empty texts match nothing; an empty benchmark
    gives an empty result; repeated documents give repeated rows, repeated items one. Nothing is exchanged: each block of
    items is broadcast, and each task reads its documents against it."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], SCHEMA)
    for items in _blocks(benchmark, block):
        held = spark.sparkContext.broadcast(build(items, q, rate))
        out = out.unionAll(docs.mapInArrow(_finder(held, rate), SCHEMA))
    return out


def _finder(held, rate: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [normal(x).replace("\0", " ") for x in texts]
            for a, b in slices(texts, 1 << 19):
                rows = [(ids[a + d], index.ids[t], e, s, f, len(index.texts[t])) for d, t, e, s, f in search(index, texts[a:b], rate)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "edits", "start", "end", "item_chars"])

    return find


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """docs without the rows that hold a benchmark item, columns as they are: a filter where the rows are read."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, block):
        held = spark.sparkContext.broadcast(build(items, q, rate))
        docs = docs.where(~_holds_item(held, rate)(F.coalesce("text", F.lit(""))))
    return docs


def _holds_item(held, rate: float):
    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = held.value
        for texts in batches:
            texts = [normal(x).replace("\0", " ") for x in texts]
            found = [a + d for a, b in slices(texts, 1 << 19) for d, *_ in search(index, texts[a:b], rate)]
            hits = np.zeros(len(texts), bool)
            hits[found] = True
            yield pd.Series(hits)

    return hit
