"""Full-text search: tokens of a text by stem or sound, an inverted index, and phrases scored by how far their words stand apart."""

from __future__ import annotations

import hashlib
import math
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.numbering import kept

#: Words that are not indexed; fixed values.
STOP_WORDS = frozenset(
    """a about after all also am an and andor another any are as at be because been before being between both but by came can come
    could did do does each for from get got had has have he her here him himself his how i if in into is it like make many me might
    more most much must my never now of on only or other our out over said same see should since some still such take than that
    the their them then there these they this those through to too under up very was way we well were what where which while who
    with would you your""".split()
)
_digit = re.compile("[0-9]")
_digits = re.compile(r"([0-9]+)/([0-9]+)|[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?")
#: Points that do not follow a digit, and white space beyond ASCII.
_points, _wide = re.compile(r"\.(?<![0-9]\.)"), re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_gaps = b"-_[](){}\t\n\v\f\r\x1c\x1d\x1e\x1f"
_spaced, _drop = bytes.maketrans(_gaps, b" " * len(_gaps)), bytes(i for i in range(128) if chr(i) not in "abcdefghijklmnopqrstuvwxyz0123456789 ." and i not in _gaps)

#: Digits of the longest number that is read as one; longer runs are no numbers but marks, and stay as they are.
LONGEST_NUMBER = 15


@lru_cache(100_000)
def _number(text: str, decimals: int) -> str:
    """A number or fraction, as _digits finds it, with a fixed number of decimals."""
    if max(map(len, re.findall("[0-9]+", text.replace(",", "")))) > LONGEST_NUMBER:
        return text
    over, _, under = text.partition("/")
    if under:
        return f"{int(over) / int(under):.{decimals}f}" if int(under) else text
    return f"{float(text.replace(',', '')):.{decimals}f}"


def spaced(text: str | None, decimals: int = 4) -> bytes:
    """The words of a text between spaces, in lower case and ASCII; fractions and numbers with a fixed number of decimals."""
    text, drop = (text or "").lower(), _drop + b"."
    if _digit.search(text):
        text, drop = _points.sub("", _digits.sub(lambda m: _number(m[0], decimals), text)), _drop
    return (text if text.isascii() else _wide.sub(" ", text)).encode("ascii", "ignore").translate(_spaced, drop)


def normalise(text: str | None, decimals: int = 4) -> list[str]:
    """Words in lower case; fractions and numbers with a fixed number of decimals."""
    return spaced(text, decimals).decode("ascii").split()


def _measure(stem: str) -> int:
    forms = re.sub(r"[^V]+", "C", re.sub(r"V+", "V", _shape(stem)))
    return forms.count("VC")


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "V" if c in "aeiou" or (c == "y" and i and out[-1] != "V") else "C"
    return out


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "CVC" and word[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 of Porter's algorithm (1980); fixed values.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) < 3:
        return w
    for end, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + by
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and "V" in _shape(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: Sound rules in the manner of Metaphone (1990), applied at each place, first match first; fixed values.
SOUNDS = [(re.compile(p), s) for p, s in ((r"^(?:ae)", "E"), (r"^(?:gn|kn|pn|wr)", ""), (r"^x", "S"), (r"^wh", "W"), (r"mb$", "M"), (r"sch", "SK"), (r"tch", "X"), (r"cia|ch", "X"), (r"c(?=[iey])", "S"), (r"ck", "K"), (r"[cq]", "K"), (r"dg(?=[eiy])", "J"), (r"d", "T"), (r"gh(?![aeiou]|$)|gh$", ""), (r"gn(?=ed$|$)", "N"), (r"g(?=[iey])", "J"), (r"g", "K"), (r"ph", "F"), (r"sh|si(?=[oa])|ti(?=[oa])", "X"), (r"th", "0"), (r"v", "F"), (r"x", "KS"), (r"z", "S"), (r"[wy](?![aeiou])", ""), (r"(?<=[aeiou])h(?![aeiou])", ""))]


@lru_cache(200_000)
def metaphone(word: str) -> str:
    word = re.sub(r"([abd-z])\1", r"\1", word.lower())
    first = {"kn": "N", "gn": "N", "pn": "N", "wr": "R"}.get(word[:2], "")
    out, at = first, 2 if first else 0
    while at < len(word):
        for rule, sound in SOUNDS:
            if m := rule.match(word, at):
                out, at = out + sound, at + len(m[0])
                break
        else:
            c = word[at]
            out, at = out + (c.upper() if c not in "aeiou" or at == 0 else ""), at + 1
    return out


class Tokens(dict):
    """Word -> its token, or '' for words that are dropped. All are forgotten when there are over MOST."""

    MOST = 300_000

    def __init__(self, mode: str):
        super().__init__()
        self.make = {"english": lambda w: metaphone(stem(w)), "english-stem": stem, "english-meta": metaphone}.get(mode)

    def __missing__(self, w: str) -> str:
        if len(self) > self.MOST:
            self.clear()
        if self.make is None:
            out = w
        elif len(w) == 1 or w in STOP_WORDS:
            out = ""
        else:
            out = w if w[0].isdigit() else self.make(w)
        self[w] = out
        return out


def tokenize(text: str | None, mode: str = "english", tokens: Tokens | None = None) -> list[tuple[str, int]]:
    """(token, place); stop words and single letters are dropped but keep their places. Any other mode takes words as they
    are, and all of them."""
    tokens = Tokens(mode) if tokens is None else tokens
    return [(t, i) for i, w in enumerate(normalise(text)) if (t := tokens[w])]


def sanitised(term: str) -> str:
    """A term as it may stand between quotes in an expression."""
    return re.sub("[',]", "", term)


#: Characters whose words are grouped at once.
SLICE = 1 << 20


def index(df: DataFrame, key: str, column: str, mode: str = "english") -> DataFrame:
    """(id, w, places): the places of each token in each row's text."""
    return entries(df, key, [column], mode).select("id", "w", "places")


def entries(df: DataFrame, key: str, columns: list[str], mode: str = "english", raw: bool = False) -> DataFrame:
    """(id, col, w, places): the places of each token in each row's text in each column, by one pass over Arrow batches. raw:
    the digest of the whole text too, as a token that no word can be, without places."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens(mode)
        for batch in batches:
            for name, column in zip(columns, batch.columns[1:], strict=True):
                texts = column.to_pylist()
                for a, b in _slices(texts):
                    held, ids = texts[a:b], batch.column(0).slice(a, b - a)
                    yield _rows(ids, name, *grouped(held, known))
                    if raw and (there := [i for i, t in enumerate(held) if t is not None]):
                        marks = pa.array([mark(held[i]) for i in there], pa.string())
                        yield _rows(ids, name, np.array(there), marks, pa.ListArray.from_arrays(pa.array(np.zeros(len(there) + 1), pa.int32()), pa.array([], pa.int32())))

    texts = df.select(F.col(key).alias("id"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)))
    schema = T.StructType([texts.schema["id"], T.StructField("col", T.StringType()), T.StructField("w", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    return texts.mapInArrow(made, schema)


def mark(text: str) -> str:
    """What stands for a whole text in an index."""
    return "\0" + hashlib.sha256(text.encode()).hexdigest()


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t or "") > SLICE:
            yield at, i
            at, held = i, 0
        held += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _rows(ids: pa.Array, name: str, at: np.ndarray, w: pa.Array, places: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.repeat(pa.scalar(name, pa.string()), len(at)), w, places], ["id", "col", "w", "places"])


def grouped(texts: list[str | None], known: Tokens) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each text and token in it: the text's number, the token, its places. Words are cut, numbered and sorted as
    arrays; Python sees each distinct word once, and none where words are tokens."""
    raw = [spaced(t) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = data == 32
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[::2], edge[1::2]
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(0, np.cumsum(end - begin)).astype(np.int32)), pa.py_buffer(data[~space])).dictionary_encode()
    tokens, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    first = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in raw)]))  # of each text's words
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    place = np.arange(len(begin)) - first[text]
    if known.make is not None:
        made = pa.array([known[w] for w in tokens.to_pylist()], pa.string()).dictionary_encode()
        tokens, code = made.dictionary, made.indices.to_numpy().astype(np.int64)[code]
        some = np.array([t != "" for t in tokens.to_pylist()], bool)[code]
        text, place, code = text[some], place[some], code[some]
    both = text * max(1, len(tokens)) + code
    order = np.argsort(both, kind="stable")  # places of a token stay in order
    groups = np.flatnonzero(np.diff(both[order], prepend=-1))
    at = order[groups]
    return text[at], tokens.take(pa.array(code[at])), pa.ListArray.from_arrays(pa.array(np.append(groups, len(order)), pa.int32()), pa.array(place[order], pa.int32()))


def places(text: str | None, mode: str, known: Tokens, only: frozenset[str] | None = None) -> dict[str, list[int]]:
    """Token -> its places in a text; of all tokens, or of those only."""
    out: dict[str, list[int]] = {}
    for i, w in enumerate(normalise(text)):
        if (t := known[w]) and (only is None or t in only):
            out.setdefault(t, []).append(i)
    return out


def phrase_score(wanted: list[tuple[str, int]], found: dict[str, list[int]]) -> int:
    """The least, over all choices of places, of 2 for each missing token and, for each neighbouring pair that is there, the
    difference between its distances in the text and in the phrase. 0: the phrase as it is."""
    score = 2 * sum(w not in found for w, _ in wanted)
    here = [(w, i) for w, i in wanted if w in found]
    if not here:
        return score
    best = {p: 0 for p in found[here[0][0]]}
    for (_, i), (w, j) in zip(here, here[1:], strict=False):
        best = {q: min(s + abs(abs(q - p - 1) - abs(j - i - 1)) for p, s in best.items()) for q in found[w]}
    return score + min(best.values())


#: Comparisons of scores, by the operator's text.
COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def _met(text: str | None, found: dict[str, list[int]], term: str, wanted: list[tuple[str, int]], op: str, value: float) -> int | None:
    """The score with which a text meets a term, or None. The term itself as the text always does, with 0; a term of one
    token does where the token stands, if the comparison is with 0 and takes 0 in; others do by their phrase's score."""
    if text == term:
        return 0
    if not any(w in found for w, _ in wanted):
        return None
    if len(wanted) == 1:
        return 0 if "=" in op and op != "!=" and value == 0 else None
    score = phrase_score(wanted, found)
    return score if COMPARE[op](score, value) else None


def score(columns: list[Column], terms: list[str], op: str = "<=", value: float = math.inf, mode: str = "english", single: bool = False) -> Column:
    """The least score with which any of the columns meets any of the terms (op value), null where none does. single: a term
    of one token meets a text whatever the comparison. All columns and terms are read in one pass over Arrow batches."""
    wanted = [(t, tokenize(t, mode)) for t in terms]
    only = frozenset(w for _, ws in wanted for w, _ in ws)
    at_least = (lambda op, value, ws: ("=", 0) if single and len(ws) == 1 else (op, value))

    @F.pandas_udf("int")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known = Tokens(mode)
        for held in batches:
            out = []
            for texts in zip(*(held if isinstance(held, tuple) else (held,)), strict=True):  # one column comes by itself
                best = None
                for text in texts:
                    found = places(text, mode, known, only)
                    for term, ws in wanted:
                        got = _met(text, found, term, ws, *at_least(op, value, ws))
                        best = got if best is None else best if got is None else min(best, got)
                out.append(best)
            yield pd.Series(out, dtype="Int32")

    return scores(*(c.cast("string") for c in columns))


def search(df: DataFrame, key: str, column: str, terms: list[str], mode: str = "english", most: int = 0) -> DataFrame:
    """(id, score) of the rows that meet any term with a score of at most `most`; rows whose text is the term, or that have a
    term's only token, score 0. One pass over the texts; only what is met is exchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    texts = df.select(key, column)
    if texts.rdd.getNumPartitions() < cores:  # a small file is one partition; a large table has more of them than cores
        texts = texts.repartition(cores)
    rows = texts.select(F.col(key).alias("id"), score([F.col(column)], terms, "<=", most, mode, single=True).alias("score"))
    return rows.where("score IS NOT NULL").groupBy("id").agg(F.min("score").alias("score"))


@dataclass
class SearchIndex:
    """A stored index (id, col, w, places) of the text columns of a table, kept up with its changes by the rows that changed. What
    is stored is not written again: a change adds the ids whose former entries no longer hold, and the rows' new entries."""

    frame: DataFrame
    key: str
    columns: list[str]
    mode: str
    changes: tuple[tuple[DataFrame, DataFrame | None], ...] = ()

    #: Changes that are read side by side; one more, and they become one.
    MOST = 8

    @staticmethod
    def built(df: DataFrame, key: str, columns: list[str], mode: str = "english") -> SearchIndex:
        return SearchIndex(kept(entries(df, key, columns, mode, raw=True)), key, columns, mode)

    def changed(self, rows: DataFrame, gone: bool = False, keys: DataFrame | None = None) -> SearchIndex:
        """The index after rows have been written, or deleted (gone): only their tokens are made anew. keys: a table with the
        keys of the rows, if it is simpler than they are."""
        ids = kept((rows if keys is None else keys).select(F.col(self.key).alias("id")))
        changes = (*self.changes, (ids, None if gone else kept(entries(rows, self.key, self.columns, self.mode, raw=True))))
        if len(changes) > self.MOST:
            every = reduce(DataFrame.unionAll, [ids for ids, _ in changes]).distinct()
            made = _holding(list(enumerate(changes, 1)), lambda df: df)
            changes = ((kept(every), made and kept(made)),)
        return SearchIndex(self.frame, self.key, self.columns, self.mode, changes)

    def search(self, terms: list[str], op: str = "=", value: float = 0, column: str = "*") -> DataFrame:
        """(id, score) of the rows that meet any term (op value) in the column, or with * in any. The index is read once, for the terms'
        tokens alone; only their places meet, by row."""
        wanted = [(t, tokenize(t, self.mode)) for t in terms]
        marks = {mark(t): t for t in terms}
        some = F.col("w").isin([*{w for _, ws in wanted for w, _ in ws}, *marks])
        some = some if column == "*" else some & (F.col("col") == column)
        rows = _holding([(0, (None, self.frame)), *enumerate(self.changes, 1)], lambda df: df.where(some))

        @F.pandas_udf("int")
        def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for held in batches:
                out = []
                for entries in held:
                    found = {e["w"]: list(e["places"]) for e in entries}
                    text = next((t for m, t in marks.items() if m in found), None)
                    scores = [s for t, ws in wanted if (s := _met(text, found, t, ws, op, value)) is not None]
                    out.append(min(scores, default=None))
                yield pd.Series(out, dtype="Int32")

        met = rows.groupBy("id", "col").agg(F.collect_list(F.struct("w", "places")).alias("t")).select("id", best("t").alias("score"))
        return met.where("score IS NOT NULL").groupBy("id").agg(F.min("score").alias("score"))


def _holding(changes: list[tuple[int, tuple[DataFrame | None, DataFrame | None]]], some: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The entries that no later change has replaced, of those that `some` takes from each; None where there are none at all."""
    made = [some(df).withColumn("_at", F.lit(i)) for i, (_, df) in changes if df is not None]
    gone = [ids.withColumn("_gone", F.lit(i)) for i, (ids, _) in changes if ids is not None]
    if not made or not gone:
        return made[0].drop("_at") if made else None
    last = reduce(DataFrame.unionAll, gone).groupBy("id").agg(F.max("_gone").alias("_gone"))
    found = reduce(DataFrame.unionAll, made).join(last, "id", "left").where("_gone IS NULL OR _gone <= _at")
    return found.select("id", "col", "w", "places")
