"""Byte-pair encoding and decoding with a given tokenizer file; long texts by tree concatenation.

A text of more than LEAF characters is cut into leaves, which other tasks encode in parallel. The leaves are then joined
in pairs, level by level. At a join, a window around the seam is encoded anew and grown until it agrees with both sides:

* on the left the window starts at a word that the tokenizer's splitter cannot have split otherwise, whatever follows,
  because it ends MARGIN characters before the seam at least;
* on the right it must reach a word start that both the window and the right side have: from there on the splitter, which
  never looks back over a word start, goes on alike.

Where a single word spans the seam (text without any place to split), the tokens themselves are compared: a row of tokens
is the encoding of a word exactly if every two neighbours are, so a window of tokens whose first and last token come out
unchanged fits both sides. A window that reaches both ends is the whole text, so the result is always that of encoding the
whole text at once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, slices

#: Characters of a leaf, and of the longest text that is encoded in one piece.
LEAF = 65_536
#: Characters that the splitter may look ahead: more than the longest special token (13) or contraction (3).
MARGIN = 16


def tokenizer_path(name: str) -> str:
    """Place of a tokenizer file on this machine: a path as it is, else a name in the installed collection."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


#: The splitting pattern of byte-level BPE vocabularies of this kind; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a process keeps of words and their ids.
KEPT_BYTES = 64 << 20


class Encoder:
    """The library's encoding, with the ids of words kept: the words of a text are encoded independently of each other, so
    each distinct one goes to the library once. Tokenizers that split otherwise, and texts with code points that are
    unassigned in this Python's Unicode tables (which the library may know as letters or not), go to it whole."""

    def __init__(self, name: str):
        import regex

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        split, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.library = load(name)
        self.plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"] and not spec["post_processor"]
        self.plain = self.plain and not spec["model"].get("dropout") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        self.special = {x["content"] for x in added}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if added else None
        self.find = regex.compile(PATTERN).findall
        self.known = Kept(self._of_word, getsizeof, KEPT_BYTES)

    def _of_word(self, word: str) -> bytes | None:
        """A word's ids, 4 bytes each; None if it has a code point that is unassigned in this Python's Unicode tables."""
        odd = not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)
        return None if odd else array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def words(self, text: str) -> list[str] | None:
        """The words that text is split into; None: the library has to split it."""
        if not self.plain:
            return None
        if self.split and any(x in text for x in self.special):
            words = [w for part in self.split(text) for w in ([part] if part in self.special else self.find(part))]
        else:
            words = self.find(text)
        return words

    def ids(self, text: str) -> list[int]:
        words = self.words(text)
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32).tolist()
        except TypeError:  # no words, or one with an unassigned code point
            return self.library.encode(text, add_special_tokens=False).ids

    def piece(self, text: str) -> Piece:
        words = self.words(text)
        packed = None if words is None else [*map(self.known.__getitem__, words)]
        if packed is None or None in packed:
            return _true_starts(text, self.library.encode(text, add_special_tokens=False))
        starts, tokens = [], []
        at = n = 0
        for w, x in zip(words, packed, strict=True):
            starts.append(at)
            tokens.append(n)
            n += len(x) // 4
            at += len(w)
        return Piece(text, np.frombuffer(b"".join(packed), np.uint32).tolist(), starts, tokens)


@lru_cache(2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


class Piece:
    """Encoding of a text on its own: ids, and where each token's word starts (words: start in characters, tokens before it)."""

    __slots__ = ("ids", "starts", "text", "tokens")

    def __init__(self, text: str, ids: list[int], starts: list[int], tokens: list[int]):
        self.text, self.ids, self.starts, self.tokens = text, ids, starts, tokens


def _piece(text: str, e) -> Piece:
    starts, tokens, last = [], [], None
    for i, (w, (a, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
        if w is None or w != last:  # a special token in the text is a word of its own
            starts.append(a)
            tokens.append(i)
        last = w
    return Piece(text, list(e.ids), starts, tokens)


def encode_piece(name: str, text: str) -> Piece:
    return encoder(name).piece(text)


def _true_starts(text: str, e) -> Piece:
    """Offsets leave out a word's leading space (trimmed); put it back so that the words are gapless."""
    p = _piece(text, e)
    gap = e.offsets
    for k, i in enumerate(p.tokens):
        p.starts[k] = gap[i - 1][1] if i else 0
    return p


def join(name: str, a: Piece, b: Piece) -> Piece:
    """The encoding of a.text + b.text, from those of both."""
    if not a.ids or not b.ids:
        return b if not a.ids else a
    text = a.text + b.text
    whole = _join_word(name, a, b)
    if whole is not None:
        return Piece(text, *whole)
    # the last word start from which the splitter goes right whatever b is
    k = max((i for i, s in enumerate(a.starts) if s <= len(a.text) - MARGIN), default=0)
    cut, before = a.starts[k], a.tokens[k]
    reach, starts_b = 4 * MARGIN, dict(zip(b.starts, b.tokens, strict=True))
    while True:
        reach = min(reach, len(b.text))
        w = encode_piece(name, a.text[cut:] + b.text[:reach])
        seam = len(a.text) - cut
        last = len(w.text) - (0 if reach == len(b.text) else MARGIN)
        for s, t in zip(w.starts, w.tokens, strict=True):
            if s > seam and s <= last and s - seam in starts_b:
                rest = starts_b[s - seam]
                ids = a.ids[:before] + w.ids[:t] + b.ids[rest:]
                mid = [(x + cut, y + before) for x, y in zip(w.starts, w.tokens, strict=True) if x < s]
                end = [(x + len(a.text), y - rest + before + t) for x, y in zip(b.starts, b.tokens, strict=True) if x >= s - seam]
                both = [*zip(a.starts[:k], a.tokens[:k], strict=True), *mid, *end]
                return Piece(text, ids, [x for x, _ in both], [y for _, y in both])
        if reach == len(b.text):
            both = [*zip(a.starts[:k], a.tokens[:k], strict=True), *((x + cut, y + before) for x, y in zip(w.starts, w.tokens, strict=True))]
            return Piece(text, a.ids[:before] + w.ids, [x for x, _ in both], [y for _, y in both])
        reach *= 2


def _join_word(name: str, a: Piece, b: Piece) -> tuple[list[int], list[int], list[int]] | None:
    """If one word spans the seam and is long on both sides: the joined ids and words, by growing windows of tokens."""
    start, end = a.starts[-1], b.starts[1] if len(b.starts) > 1 else len(b.text)
    if len(a.text) - start <= 4 * MARGIN or end <= 4 * MARGIN:
        return None
    t = load(name)
    probe = t.pre_tokenizer.pre_tokenize_str(a.text[-2 * MARGIN :] + b.text[: 2 * MARGIN])
    special = t.get_added_tokens_decoder().values()
    if len(probe) != 1 or any(x.content[0] in a.text[-MARGIN:] for x in special):
        return None
    la, lb = a.ids[a.tokens[-1] :], b.ids[: b.tokens[1] if len(b.tokens) > 1 else len(b.ids)]
    k = 8
    while True:
        left, right = la[-k:], lb[:k]
        word = "".join(t.id_to_token(i) for i in left + right)
        w = [x.id for x in t.model.tokenize(word)]
        if (k >= len(la) or w[0] == left[0]) and (k >= len(lb) or w[-1] == right[-1]):
            mid = la[:-k] + w + lb[k:] if k < len(la) else w + lb[k:]
            head = a.ids[: a.tokens[-1]]
            shift = len(head) + len(mid) - len(lb)
            starts = a.starts + [x + len(a.text) for x in b.starts[1:]]
            return head + mid + b.ids[len(lb) :], starts, a.tokens + [y + shift for y in b.tokens[1:]]
        k *= 2


def merge_tree(name: str, pieces: list[Piece]) -> Piece:
    while len(pieces) > 1:
        pieces = [join(name, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def encode_long(name: str, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of a text by leaves and joins, in this process."""
    if not text:
        return []
    leaves = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    return merge_tree(name, [encode_piece(name, x) for x in leaves]).ids


@lru_cache(1)
def _digits() -> list[str]:
    return [str(i) for i in range(1 << 16)]


def ids_sha256(ids: list[int]) -> str:
    s = _digits()
    return hashlib.sha256(",".join([s[i] if i < 65536 else str(i) for i in ids]).encode()).hexdigest()


def decode(name: str, ids: list[int]) -> str:
    return load(name).decode(ids, skip_special_tokens=False)


SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(name: str, digest: bool, ids: list, encoded: Iterator[list[int]]) -> pa.RecordBatch:
    out: list[list] = [[], [], [], []]
    for i, e in zip(ids, encoded, strict=True):
        text = decode(name, e)
        for column, x in zip(out, (i, len(e), ids_sha256(e), hashlib.sha256(text.encode()).hexdigest()) if digest else (i, len(e), e, text), strict=True):
            column.append(x)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string()) if digest else (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
    names = [x.split()[0] for x in (DIGEST if digest else SCHEMA).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def encode(docs: DataFrame, name: str = "byte_bpe_50k.json", digest: bool = False, leaf: int = LEAF) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, and ids with the decoded text, or the SHA-256 of both (digest).

    A null text counts as empty (no ids, decoded ''); repeated rows give repeated results; other columns are left out.
    Texts of up to `leaf` characters are encoded where they are read. Only longer ones are exchanged, as leaves, so that
    a very long text is encoded by many tasks; the ids of one text then meet in one task, which holds that one text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                yield _rows(name, digest, ids[a:b], map(e.ids, texts[a:b]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [text[k : k + leaf] for k in range(0, len(text), leaf)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["doc_id", "row", "part", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in slices(texts, 1 << 19):
                pieces = [encode_piece(name, x) for x in texts[a:b]]
                held = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*held.columns, *(pa.array([getattr(p, k) for p in pieces], pa.list_(pa.int32())) for k in ("ids", "starts", "tokens"))], [*held.schema.names, "ids", "starts", "tokens"])

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        texts, ids, starts, tokens = (group.column(k).to_pylist() for k in ("text", "ids", "starts", "tokens"))
        p = merge_tree(name, [Piece(*x) for x in zip(texts, ids, starts, tokens, strict=True)])
        return pa.Table.from_batches([_rows(name, digest, [group.column("doc_id")[0].as_py()], iter([p.ids]))])

    schema = DIGEST if digest else SCHEMA
    is_short = F.length("text") <= leaf
    long = (
        docs.where(~is_short)
        .select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
        .mapInArrow(cut, "doc_id long, row long, part long, text string")
        .repartition("row", "part")
        .mapInArrow(leaves, "doc_id long, row long, part long, text string, ids array<int>, starts array<int>, tokens array<int>")
        .groupBy("row")
        .applyInArrow(whole, schema)
    )
    return docs.where(is_short).mapInArrow(short, schema).unionAll(long)
