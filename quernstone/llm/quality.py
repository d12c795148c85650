"""Quality classifier with hierarchical empirical Bayes.

Two classifiers give a document's own log odds: of good quality, by logistic regression on the text's make-up, and of
toxicity, by the word or word beginning in it that is the clearest sign of it in the labelled sample. Then all documents'
expected values are summed by path (source and language) and host (source), and each level's mean is shrunk toward the one above by the strength that the spread between sites supports (method of moments):
sparse sites end at the global mean. A document's final log odds are its own, shifted by its path's posterior against the
global mean, by at most MOST_SHIFT, so that no site overrules clear evidence in a text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, free, scratch, slices, written
from .near_dup import shingle_sets

#: Labelled documents that the classifiers are fitted on: those of the smallest hash, one text each. Bounds the fitting, and
#: what the driver gets: their figures, and the signs of toxicity in them, each of which stands in three of them at least.
SAMPLE = 20_000
FEATURES = 9
MOST_SHIFT = 1.5
#: Lengths of word beginnings that count beside the whole word.
BEGINNINGS = (4, 5, 6)
#: A word counts only if its share of toxic rows is as unlikely by chance as e**-14, about one in a million, and if
#: at least this share of the rows that have it are toxic. So no number of weak signs makes a long clean text toxic.
EVIDENCE, LEAST_SHARE = 14.0, 0.95
#: Runs whose sign a task keeps (about 150 bytes each) before it starts anew; no result depends on it.
KEPT_WORDS = 200_000
_words = re.compile(r"\w+").findall


@cache
def odd_signs() -> np.ndarray:
    """Per code point, whether it is an odd sign: none of letters, digits, _, combining marks (they are parts of words),
    white space and common punctuation."""
    every = "".join(map(chr, range(0x110000)))
    odd = np.ones(len(every), bool)
    odd[[m.start() for m in re.finditer(r"[\w\s.,;:!?'\"()-]", every)]] = False
    odd[[i for i, c in enumerate(every) if unicodedata.category(c)[0] == "M"]] = False
    return odd


def make_up(text: str | None) -> list[float]:
    """Figures of a text that do not depend on its language."""
    text = text or ""
    n, words = max(1, len(text)), text.split()
    k = max(1, len(words))
    signs = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    caps = sum(map(str.isupper, words))
    again = sum(map(eq, words, words[1:]))
    if text.isascii():
        odd = int(signs[:128][odd_signs()[:128]].sum())
    else:
        odd = int(np.count_nonzero(odd_signs()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]))
    digits = int(signs[48:58].sum())
    return [caps / k, signs[33] / n, signs[124] / n, odd / n, again / k, len(set(words)) / k**0.8, math.log1p(len(words)), len(text) / k / 10, digits / n]


def parts(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Signs(dict):
    """Run of signs without white space -> log odds of the clearest sign of toxicity in it."""

    def __init__(self, toxic: dict[str, float]):
        super().__init__()
        self.toxic = toxic

    def __missing__(self, run: str) -> float:
        self[run] = out = max((self.toxic.get(p, -30.0) for w in _words(run) for p in parts(w)), default=-30.0)
        return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    toxic: dict[str, float]
    toxic_prior: float

    def quality(self, figures: np.ndarray) -> np.ndarray:
        x = np.clip((figures - self.mean) / self.scale, -20, 20)
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)

    def toxicity(self, text: str | None, signs: Signs) -> float:
        """signs: Signs(self.toxic), kept from text to text."""
        if len(signs) > KEPT_WORDS:
            signs.clear()
        return max(map(signs.__getitem__, set((text or "").lower().split())), default=-30.0)


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * np.append(w[:-1], 0)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Classifiers from labels (doc_id, quality, toxic). Rows with nulls are left out, of repeated labels the largest counts,
    of several texts of a doc_id the first in order; without any labelled text all documents pass. Texts are reduced to
    figures and words on the executors."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    named = written(named.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(named), "doc_id")
    texts = written(texts.groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text")))

    def told(toxic: int, counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["toxic", "part", "n"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                mine = counts[int(toxic > 0)]
                mine.update({p for w in set(_words(text.lower())) for p in parts(w)})
                if len(mine) > KEPT_WORDS:
                    yield told(int(toxic > 0), mine)
                    mine.clear()
        for k, mine in counts.items():
            yield told(k, mine)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("text").to_pylist()
            copies = [int(s[0] >> np.uint64(1)) if len(s) else 0 for x, y in slices(held, 1 << 18) for s in shingle_sets(held[x:y], 3)]
            own = pa.array([list(map(float, make_up(t))) for t in held], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("toxic"), own, pa.array(copies, pa.int64())], ["doc_id", "quality", "toxic", "figures", "copy"])

    rows = texts.mapInArrow(figures, "doc_id long, quality int, toxic int, figures array<double>, copy long").orderBy("doc_id").toPandas()
    if rows.empty:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), 30.0), {}, -30.0)
    x, y = np.array(rows["figures"].tolist()), (rows["quality"] > 0).to_numpy().astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    weights = _regression(np.clip((x - mean) / scale, -20, 20), y) if 0 < y.sum() < len(y) else np.append(np.zeros(FEATURES), 30.0 if y.all() else -30.0)
    # of copies, which share their smallest shingle, one counts: else a copied text's own words would look like signs
    own = rows.sort_values(["doc_id"]).drop_duplicates("copy")
    n1 = int((own["toxic"] > 0).sum())
    n0 = len(own) - n1
    texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(own[["doc_id"]])), "doc_id", "left_semi")
    spread = texts.mapInArrow(reduce, "toxic int, part string, n long")
    a, b = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    base = (n1 + 0.5) / (n1 + n0 + 1.0)
    share = F.col("a") / (F.col("a") + F.col("b"))
    unlikely = F.col("a") * F.log(share / base) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - base))).otherwise(0)
    odds = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5))
    strong = spread.groupBy("part").agg(a.alias("a"), b.alias("b")).where((F.col("a") >= 3) & (unlikely >= EVIDENCE) & ((F.col("a") + 0.5) / (F.col("a") + F.col("b") + 1) >= LEAST_SHARE))
    toxic = {p: float(w) for p, w in strong.select("part", odds.alias("w")).collect()}
    return Model(mean, scale, weights, toxic, math.log((n1 + 0.5) / (n0 + 0.5)))


def evidence(model: Model):
    """A column function: text -> struct of a document's own log odds of quality and of toxicity."""

    @F.pandas_udf("quality double, toxic double")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        signs = Signs(model.toxic)
        for texts in batches:
            figures = np.array([make_up(t) for t in texts]).reshape(-1, FEATURES)
            toxic = np.array([model.toxicity(t, signs) for t in texts], float)
            yield pd.DataFrame({"quality": model.quality(figures), "toxic": np.maximum(toxic, model.toxic_prior)})

    return own.asNondeterministic()  # or a filter on it would run it once more, in a second worker


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, shift_quality, shift_toxic): each path's posterior log odds against the global mean's.
    scored: host, path, own. Sums by path are formed where the rows are; only they are exchanged."""
    kinds = ("quality", "toxic")
    p = {k: 1 / (1 + F.exp(-F.col(f"own.{k}"))) for k in kinds}
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(p[k]).alias(f"s_{k}") for k in kinds)))
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{k}").alias(f"h_{k}") for k in kinds)))

    def strength(table: DataFrame, n: str, s: str, mean: float) -> float:
        """Prior rows worth of a beta prior, from the spread of the sites' means: mean (1 - mean) / variance - 1, where the
        sampling variance is taken off."""
        v = mean * (1 - mean)
        got = table.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2)), F.sum(n), F.count(F.lit(1))).first()
        if not got[1] or v <= 0:
            return 1e6
        between = (got[0] - v * max(0, got[2] - 1)) / got[1]
        return min(1e6, max(1.0, v / between - 1)) if between > 0 else 1e6

    total = hosts.agg(F.sum("hn"), *(F.sum(f"h_{k}") for k in kinds)).first()
    out = paths.join(hosts, "host")
    for i, k in enumerate(kinds):
        mean = float(total[i + 1] / total[0]) if total[0] else 0.5
        up, down = strength(hosts, "hn", f"h_{k}", mean), strength(paths, "n", f"s_{k}", mean)
        host = (F.col(f"h_{k}") + up * mean) / (F.col("hn") + up)
        path = (F.col(f"s_{k}") + down * host) / (F.col("n") + down)
        shift = _logit(path) - _logit(F.lit(mean))
        out = out.withColumn(f"shift_{k}", F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), shift)))
    return out.select("host", "path", "shift_quality", "shift_toxic")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carried: list[str] | None = None) -> DataFrame:
    """docs, or of them the columns that are carried, with a struct column _judged: quality and toxic (posterior
    probabilities) and kept (quality >= 0.5 > toxic).

    A null text counts as empty, a null source or language as ''; repeated rows are judged alike; an empty table stays
    empty; a column _judged in docs is replaced, all other columns come back as they are. Each text is read by the
    classifiers once: the rows are written with their own log odds, from where the sites are summed and the verdicts drawn. The
    texts are not exchanged unless there are over BROADCAST_IDS paths."""
    with scratch(docs.sparkSession) as kept:
        model = fit(docs, labels, sample)
        docs = docs.drop("_judged")
        taken = {c.lower() for c in docs.columns}
        o, h, p, q, t = (free(c, taken) for c in ("_own", "_host", "_path", "_shift_quality", "_shift_toxic"))
        columns = [c for c in docs.columns if carried is None or c in carried]
        own = evidence(model)(F.coalesce("text", F.lit(""))).alias(o)
        scored = kept(docs.select(*(F.col(f"`{c}`") for c in columns), own, F.coalesce("source", F.lit("")).alias(h), F.coalesce("lang", F.lit("")).alias(p)))
        shifts = kept(sites(scored.select(F.col(h).alias("host"), F.col(p).alias("path"), F.col(o).alias("own"))))
    shifts = shifts.withColumnsRenamed({"host": h, "path": p, "shift_quality": q, "shift_toxic": t})
    if shifts.count() <= BROADCAST_IDS:
        shifts = F.broadcast(shifts)
    both = scored.join(shifts, [h, p], "left")
    quality, toxic = (1 / (1 + F.exp(-(F.col(o)[k] + F.coalesce(s, F.lit(0.0))))) for k, s in (("quality", q), ("toxic", t)))
    verdict = F.struct(quality.alias("quality"), toxic.alias("toxic"), ((quality >= 0.5) & (toxic < 0.5)).alias("kept"))
    return both.withColumn("_judged", verdict).select(*(F.col(f"`{c}`") for c in columns), "_judged")
