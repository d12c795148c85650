"""Token counts by byte-pair merging over a heap and a linked list, with no ids made.

A word of n bytes starts as n symbols in a doubly linked list; the ranks of neighbouring pairs stand in a heap. The pair of
the lowest rank (leftmost among equals) is popped, checked to be still there, and merged, until no pair is left that the
vocabulary merges. The number of tokens is n less the merges made. Words recur, so each task keeps the counts it has found.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, load, tokenizer_path
from .common import Kept, slices

LIMIT = 512
#: Bytes that a process keeps of words and their counts.
KEPT_BYTES = 96 << 20


class Counter:
    def __init__(self, name: str):
        import regex

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
        if model["type"] != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{name}: only byte-level BPE with the usual splitting is counted here")
        self.find = regex.compile(PATTERN).findall
        self.specials = [x["content"] for x in spec["added_tokens"]]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{name}: special tokens that take in white space are not counted here")
        self.library = load(name)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        chars = _chars_of_bytes()
        self.symbols = {b: c for b, c in enumerate(chars)}
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.known = Kept(self.of_word, lambda n: 32, KEPT_BYTES)

    def merged(self, word: list[str]) -> int:
        """Tokens of one word, given as the symbols of its bytes."""
        n = len(word)
        if n < 2:
            return n
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((word[i], word[i + 1]))) is not None]
        if not heap:
            return n
        heapify(heap)
        left, right, merges = list(range(-1, n - 1)), list(range(1, n + 1)), 0
        while heap:
            rank, i = heappop(heap)
            j = right[i]
            if word[i] is None or j >= n or ranks.get((word[i], word[j])) != rank:
                continue  # one of the two has been merged since
            word[i] += word[j]
            word[j] = None
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get((word[i], word[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := left[i]) >= 0 and (r := ranks.get((word[h], word[i]))) is not None:
                heappush(heap, (r, h))
        return n - merges

    def of_word(self, word: str) -> int | None:
        """None: the word has a code point that is unassigned in this Python's Unicode tables, so that the pattern may
        split otherwise than the library, which has older ones."""
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            return None
        return self.merged([self.symbols[b] for b in word.encode()])

    def of_text(self, text: str) -> int:
        total, parts = 0, [text]
        for s in self.specials:
            if s in text:
                parts = [y for x in parts for y in x.split(s)]
        if len(parts) > 1:
            total = len(parts) - 1
        known = self.known
        for part in parts:
            try:
                total += sum(map(known.__getitem__, self.find(part)))
            except TypeError:  # a word has a code point that is unassigned
                total += sum(self.merged(list(w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part))
        return total


def _chars_of_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from
    U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(2)
def counter(name: str) -> Counter:
    return Counter(name)


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0, 0, false); repeated rows give repeated results; other columns are left out. Nothing is
    exchanged. A text without any place to split costs n log n in its length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(name)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, 4 << 20):
                n = [c.of_text(x) for x in texts[a:b]]
                size = [len(x) if x.isascii() else len(x.encode()) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
