"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketch. A document is its set of distinct k-word shingles. In round i every shingle is thrown into one of T bins with a random
value; a bin keeps the smallest value of the first round that reached it. A set of many more than T shingles is done after one
round; from round T on, round i throws all shingles into bin i - T, so every coordinate is filled after 2T rounds. Two sets
agree in a coordinate with a probability of their Jaccard similarity, and the agreements concentrate as if independent.

Banding. 32 bands of 4 coordinates: sets of similarity 0.8 share no band with a probability of 4e-8.

Verification. Equal sets are one representative from the start. Then, over the representatives:
1. each is compared with one centre, the smallest member that it shares the most bands with;
2. what is then in another component than one of its centres is compared with that centre too;
3. members that share a band have its centre in common. Where a centre's members are still in several components, each is
   written as its difference from the centre: the shingles that one of the two sets has and the other has not. Of two
   members the differences alone tell the exact distance: what stands in one set only are the shingles that stand in one of
   the two differences only. So members are compared in blocks without their texts, and a block gives only links that join
   components. The component that most members are in is not compared with itself. Sizes, and sizes of differences, that
   leave no room for a link pass over pairs without loss; nothing is dropped by an estimate.
Each comparison is exact, on the full sets. Pairs inside one component are not compared, as no link of theirs can change it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hubs, looked_up, scratch, semi, slices, too_many, written
from .components import components

COORDINATES, PER_BAND = 128, 4
BANDS = COORDINATES // PER_BAND
#: Bounds for estimates by the sketch, and by a finer one (4 bits a coordinate). Stage 3 counts exactly and uses neither.
LEAST_EQUAL, LEAST_FINE, FINE = 0.6, 0.70, 1024
#: Members in a block of stage 3, and shingles of their differences.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 4096, 2 * len(_powers))
        base = np.full(size, np.uint64(0xD6E8FEB86659FD93))
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles; of the whole row of words if there are fewer."""
    raw = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]  # bytes: lowers A-Z alone
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return [np.empty(0, np.uint64) for _ in texts]
    within = np.arange(len(data)) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(data)]])))
    value = data.astype(np.uint64) + np.uint64(1)
    value *= _power(int(within.max()) + 1)[within]
    value[space] = 0
    words = _mix(np.add.reduceat(value, begin) + (end - begin).astype(np.uint64) * np.uint64(_G))
    bounds = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in raw)]))
    rolled = np.full(max(0, len(words) - k + 1), np.uint64(k))
    for i in range(k):
        rolled = _mix(rolled * np.uint64(_G) + words[i : i + len(rolled)])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            x = np.full(1, np.uint64(b - a))
            for w in words[a:b]:
                x = _mix(x * np.uint64(_G) + w)
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t 16-bit coordinates for each non-empty set."""
    out = np.zeros((len(sets), t), np.uint16)
    full = np.zeros((len(sets), t), bool)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for r in range(2 * t):
        if not len(todo):
            break
        size = np.array([len(sets[i]) for i in todo])
        row = np.repeat(np.arange(len(todo)), size)
        x = _mix(np.concatenate([sets[i] for i in todo]) + np.uint64((r + 1) * _G % (1 << 64)))
        bin_ = (x >> np.uint64(48)) % np.uint64(t) if r < t else np.full(len(x), r - t, np.uint64)
        least = np.full(len(todo) * t, np.uint64(0xFFFFFFFFFFFFFFFF))
        np.minimum.at(least, row * t + bin_.astype(np.int64), (x << np.uint64(16)) | (x >> np.uint64(48)))
        least = least.reshape(-1, t)
        new = (least != np.uint64(0xFFFFFFFFFFFFFFFF)) & ~full[todo]
        got = out[todo]
        got[new] = (_mix(least[new] + np.uint64(r)) & np.uint64(0xFFFF)).astype(np.uint16)
        out[todo] = got
        full[todo] |= new
        todo = todo[~full[todo].all(axis=1)]
    return out


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([x or "" for x in texts], 1 << 20):
                sets = shingle_sets(texts[a:b], k)
                bands = sketches(sets).view(np.int64)
                n = np.array([len(s) for s in sets])
                with np.errstate(over="ignore"):
                    keys = [np.array([f(_mix(s + np.uint64(c))) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for f, c in ((np.add.reduce, 1), (np.bitwise_xor.reduce, 2))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return sketch


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, more columns), a written table, with text_a and text_b."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    # the smaller side of each pair may be a centre with very many partners: join it last, so that its text goes straight
    # into the check and is not exchanged again with each partner, and deal such a centre over several tasks
    hot = F.broadcast(hubs(pairs, "a", pairs.count()))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    more = side("a").join(hot, "a").withColumn("salt", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).drop("parts")
    centres = side("a").withColumn("salt", F.lit(0)).unionAll(more)
    return dealt.join(side("b"), "b").join(centres, ["a", "salt"]).select(*pairs.columns, "text_a", "text_b")


def _sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Consecutive ranges of the batch's rows, with the sets of text_a and text_b of each row."""
    left, right = batch.column("text_a"), batch.column("text_b")
    at = 0
    while at < batch.num_rows:
        to, held = at, 0
        while to < batch.num_rows and (to == at or held < 1 << 19):
            held += len(left[to].as_py()) + len(right[to].as_py())
            to += 1
        x = left[at:to].dictionary_encode()
        sets_a = shingle_sets(x.dictionary.to_pylist(), k)
        yield at, to, [(sets_a[p], s) for p, s in zip(x.indices.to_pylist(), shingle_sets(right[at:to].to_pylist(), k), strict=True)]
        at = to


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b), a written table, with linked: 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at, _, sets in _sets_of(batch, k):
                for i, (x, y) in enumerate(sets, at):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = both and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], ["a", "b", "linked"])

    return _with_texts(pairs, texts).mapInArrow(check, "a long, b long, linked boolean")


def _apart(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """members (a: the centre, b, comp), a written table, with size, that of b's set, and apart: the shingles that stand in
    one of the sets of a and b only. base tells the centre's sets apart where several rows have its doc_id."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, sets in _sets_of(batch, k):
                with np.errstate(over="ignore"):
                    base = np.array([np.add.reduce(_mix(x)) for x, _ in sets], np.uint64).view(np.int64)
                only = [np.setxor1d(x, y, assume_unique=True) for x, y in sets]
                ends = np.cumsum([0, *(len(x) for x in only)], dtype=np.int32)
                apart = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(only).view(np.int64)))
                size = pa.array([len(y) for _, y in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at:to] for c in ("a", "b", "comp")), pa.array(base), size, apart], ["a", "b", "comp", "base", "size", "apart"])

    return _with_texts(members, texts).mapInArrow(differ, "a long, b long, comp long, base long, size long, apart array<long>").where("size > 0")


def _joined(left: np.ndarray, right: np.ndarray, comp: np.ndarray, size: np.ndarray, ends: np.ndarray, apart: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between rows of left and rows of right, as many as it takes to join the components that they link. apart: the
    rows' differences from one set, one after the other, row i's from ends[i] to ends[i + 1]; comp and size by row."""
    label, n = comp.copy(), np.diff(ends)
    place = np.unique(apart, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(n)), n)
    there = np.zeros(len(n), bool)
    there[right] = True
    mine = there[owner]
    order = np.argsort(place[mine], kind="stable")
    holders = owner[mine][order]
    starts = np.searchsorted(place[mine][order], np.arange(place.max(initial=-1) + 2))
    for x in left:
        ys = right[label[right] != label[x]]
        # linked if (100 + percent) * distance <= (100 - percent) * sum of sizes; the distance is at least either difference
        room = (100 - percent) * (size[ys] + size[x])
        least = np.maximum(abs(n[ys] - n[x]), abs(size[ys] - size[x]))
        fits = (100 + percent) * least <= room
        ys, room = ys[fits], room[fits]
        if not len(ys):
            continue
        shingles = place[ends[x] : ends[x + 1]]
        low, many = starts[shingles], starts[shingles + 1] - starts[shingles]
        spots = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
        both = np.bincount(holders[spots], minlength=len(n))[ys]
        ys = ys[(100 + percent) * (n[ys] + n[x] - 2 * both) <= room]
        while len(ys):
            yield x, ys[0]
            label[label == label[ys[0]]] = label[x]
            ys = ys[label[ys] != label[x]]


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components which members of one centre are in. members: what _apart gives, a written table."""
    group = ["a", "base"]
    of_comp = members.groupBy(*group, "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("apart")).alias("w"))
    of_comp = of_comp.groupBy(*group).agg(F.max(F.struct("n", "w", "comp")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("comps"))
    several = F.greatest(F.lit(1), F.ceil(F.col("most.n") / BLOCK), F.ceil(F.col("most.w") / BLOCK_SHINGLES)).cast("int")
    others = F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("most.n")) / BLOCK), F.ceil((F.col("w") - F.col("most.w")) / BLOCK_SHINGLES)).cast("int")
    plan = written(of_comp.where("comps > 1").select(*group, F.col("most.comp").alias("main"), several.alias("of_main"), others.alias("of_rest"), "n"))
    rows = looked_up(members, plan.drop("n"), group, plan.where(F.col("n") > too_many(members.count())).drop("n"), "inner")
    # blocks of the main component come first, and meet only those of the rest
    main, turn = F.col("comp") == F.col("main"), F.xxhash64("b")
    own = F.when(main, F.pmod(turn, F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(turn, F.col("of_rest"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(main, F.col("of_main")).otherwise(F.lit(0)), F.col("of_main") + F.col("of_rest") - 1)))
    rows = rows.select(*group, "b", "comp", "size", "apart", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            key = np.column_stack([rows.column(c).to_numpy() for c in (*group, "i", "j")])
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            if batch is not None:  # the last group may go on in the next batch
                held = rows.slice(edge[-2])
                edge = edge[:-1]
            out = [np.empty((0, 2), np.int64)]
            for start, end in zip(edge[:-1], edge[1:], strict=True):
                block = rows.slice(start, end - start).combine_chunks()
                rep, comp, size, own, i, j = (block.column(c).to_numpy() for c in ("b", "comp", "size", "own", "i", "j"))
                lists = block.column("apart").combine_chunks()
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                left, right = sorted((np.flatnonzero(own == i), np.flatnonzero(own == j)), key=len)
                found = np.array(list(_joined(left, right, comp, size, ends, lists.flatten().to_numpy(), percent)), np.int64).reshape(-1, 2)
                out.append(rep[found])
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    groups = rows.repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j")
    return groups.mapInArrow(compare, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that can be reached by links of
    similarity percent / 100 or more), kept (doc_id = component_id). exact makes no difference any more: no pair is dropped
    by an estimate.

    Words: runs of bytes other than space and 0x09-0x0D, A-Z lowered. Null, empty or blank texts have no shingles and
    are their own component. Rows that share a doc_id are one node, linked by whatever any of them is linked by, and each
    row has its own n_shingles. A null doc_id takes no part: component_id null, kept true. Other columns are left out; an
    empty table gives an empty result. Of the tables written on the way only the two that the result reads stay."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession) as kept:
        sketched = kept(docs.mapInArrow(_sketcher(k), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
        classes = kept(_classes(docs, sketched, k, percent))
    # the copies of one text, and the rows without words, are joined where they are
    empty = classes.sparkSession.createDataFrame([(0, 0, 0, None)], "n_shingles long, k1 long, k2 long, component_id long")
    hot = classes.where(F.col("n") > too_many(sketched.count())).select(*empty.columns).unionAll(empty)
    out = looked_up(sketched.select("doc_id", "n_shingles", "k1", "k2"), classes.select(*empty.columns), ["n_shingles", "k1", "k2"], hot)
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """(n_shingles, k1, k2, rep, n, component_id) of each distinct set, which n rows have."""
    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(known.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    sets = known.join(reps.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "bands")
    spread = sets.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", "band", F.xxhash64("band", "value").alias("key"))
    crowded = spread.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("centre < last")
    crowded = written(crowded.select("key", "centre", "n"))
    hot = crowded.where(F.col("n") > too_many(BANDS * reps.count())).drop("n")
    members = written(looked_up(spread, crowded.drop("n"), ["key"], hot, "inner"))
    ids = written(members.select(F.col("rep").alias("doc_id")).distinct())
    texts = written(semi(docs.where("text IS NOT NULL"), ids, "doc_id"))
    if texts.count() > ids.count():  # equal rows of one doc_id would meet each other in every pair
        texts = written(texts.distinct())
    to_centre = members.where("rep != centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("shared"))
    to_centre = written(to_centre.select(F.col("centre").alias("a"), F.col("rep").alias("b"), "shared"))
    best = to_centre.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    # rows that share a doc_id but not a set are one node: its representatives are linked
    sets_of = ["n_shingles", "k1", "k2"]
    same = looked_up(known.select("doc_id", *sets_of), reps.drop("n"), sets_of, reps.where(F.col("n") > too_many(sketched.count())).drop("n"), "inner").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    own = same.join(reps.select(F.col("rep").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    compared = written(_verified(written(best), texts, k, percent))
    links = written(compared.where("linked").select("a", "b").unionAll(own))
    comp = components(links)

    hot_centres = written(hubs(to_centre, "a", to_centre.count()).select("a"))

    def placed(rows: DataFrame, node: str, name: str) -> DataFrame:
        found = comp.select(F.col("node").alias(node), F.col("component").alias(name))
        if node == "a":  # a centre may have very many partners
            out = looked_up(rows, found, ["a"], hot_centres.join(found, "a", "left"))
        else:
            out = rows.join(found, node, "left")
        return out.withColumn(name, F.coalesce(name, node))

    def also(more: DataFrame) -> None:
        """Takes links in."""
        nonlocal links, comp
        if more.limit(1).count():
            links = links.unionAll(more)
            comp = components(links)

    rest = to_centre.select("a", "b").join(compared, ["a", "b"], "left_anti")
    rest = written(placed(placed(rest, "a", "x"), "b", "y").where("x != y").select("a", "b"))
    also(written(_verified(rest, texts, k, percent).where("linked").select("a", "b")))
    pairs = to_centre.select("a", "b")
    spots = placed(pairs.unionAll(pairs.select("a", F.col("a").alias("b")).distinct()), "b", "comp")
    mixed = written(spots.groupBy("a").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y"))
    hot = mixed.where(F.col("n") > too_many(to_centre.count()))
    spots = written(looked_up(spots, mixed, ["a"], hot, "inner").select("a", "b", "comp"))
    also(written(_blocks(written(_apart(spots, texts, k)), percent).distinct()))
    return placed(reps, "rep", "component_id")


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each class of near duplicates, the one of the smallest doc_id; of several rows with that
    doc_id, one stays if they are equal in all columns. Rows without words, or with a null doc_id, all stay."""
    found = written(near_duplicates(docs, k, percent).where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "kept"))
    gone = written(found.where("NOT kept").select("doc_id").distinct())
    again = written(found.where("kept AND n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    left = semi(docs.withColumn("doc_id", F.col("doc_id").cast("long")), gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    # only rows whose doc_id stands more than once are compared, so that no other text is exchanged
    has_words = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    several = semi(left.where(has_words), again, "doc_id").select(*docs.columns).dropDuplicates()
    single = semi(left.where(has_words), again, "doc_id", "left_anti").select(*docs.columns)
    return left.where(~has_words).unionAll(single).unionAll(several)


#: The query of k = 4 in SQL, by joining all shingles: for small tables, as frequent shingles and large classes make many rows.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
runs AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER (PARTITION BY doc_id ORDER BY i), lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i),
                                 lead(word, 3) OVER (PARTITION BY doc_id ORDER BY i)) AS shingle FROM words),
sets AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE i <= greatest(1, n - 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY a, b),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
walk AS (SELECT doc_id, doc_id AS met FROM documents UNION SELECT walk.doc_id, links.b FROM walk JOIN links ON links.a = walk.met),
classes AS (SELECT doc_id, min(met) AS component_id FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN classes ON classes.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
