"""Byte-level BPE over a public rank file, for one text or a whole corpus.

The merges of a piece are found with a segment tree over the ranks of adjacent
pairs: its root is the leftmost pair of lowest rank, a merge updates at most
three leaves, so a piece of n bytes takes O(n log n) however long it is.

A corpus repeats its words, so encoded stretches are kept in bounded per-worker
tables. Texts are cut only where the piece pattern can't look across.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import ship, spread

#: The public pattern that splits a text before the merges of the rank files.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches between white space; each is made of whole pieces.
STRETCHES = r" ?\S+|\s+(?!\S)|\s+"
#: Entries of a worker's table of encoded stretches, and of bytes in one entry's text.
KEPT, KEPT_CHARS = 400_000, 64

_NONE = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file; ``folder`` defaults to that of the installed public tokenizers."""
    if folder is None:
        folder = "/opt/tokenizers"
    return f"{folder.rstrip('/')}/{name}"


class BpeEncoder:
    """Encoder of a rank file (lines of base64 token, blank, rank); ids are ranks, no special tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self._pairs: dict[tuple[int, int], int] = {}
        self._pieces = regex.compile(PIECES)
        self._stretches = regex.compile(STRETCHES)
        self._kept, self._bare = _Kept(self), {}

    def _pair(self, a: int, b: int) -> int:
        """Rank of the merge of two tokens, which is the id of the merged one."""
        got = self._pairs.get((a, b))
        if got is None:
            got = self.ranks.get(self.tokens[a] + self.tokens[b], _NONE)
            if len(self._pairs) < 1_000_000:
                self._pairs[a, b] = got
        return got

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by repeated merge of its leftmost pair of lowest rank."""
        tok = [self.single[b] for b in piece]
        n, none, pair = len(tok), _NONE, self._pair
        if n < 2:
            return tok
        # a binary tree in one list: node i has the children 2i and 2i + 1, the leaves begin at ``size``. A leaf is
        # rank * n + place of the pair that begins there, so the least is the lowest rank, leftmost.
        size = 1 << (n - 2).bit_length()
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pair(tok[i], tok[i + 1])) != none:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, rank: int) -> None:
            at = size + i
            tree[at] = none if rank == none else rank * n + i
            while at > 1:
                at >>= 1
                x, y = tree[2 * at], tree[2 * at + 1]
                least = x if x < y else y
                if tree[at] == least:
                    return
                tree[at] = least

        while (root := tree[1]) != none:
            rank, i = divmod(root, n)
            gone = after[i]
            tok[i], tok[gone] = rank, -1
            after[i] = nxt = after[gone]
            if gone < n - 1:
                put(gone, none)
            if nxt < n:
                before[nxt] = i
                put(i, pair(rank, tok[nxt]))
            else:
                put(i, none)
            if (p := before[i]) >= 0:
                put(p, pair(tok[p], rank))
        return [t for t in tok if t >= 0]

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        got = self.ranks.get(raw)  # a token's own bytes merge to it
        return [got] if got is not None else self.merge(raw)

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch that is made of whole pieces."""
        return tuple(chain.from_iterable(map(self.piece, self._pieces.findall(text))))

    def bare(self, text: str) -> tuple[int, ...]:
        """As stretch(), by a table of its own."""
        got = self._bare.get(text)
        if got is None:
            got = self.stretch(text)
            if len(text) <= KEPT_CHARS and len(self._bare) < KEPT // 2:
                self._bare[text] = got
        return got

    def stretches(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text in tuples, one for each stretch."""
        if not text:
            return []
        kept = self._kept
        # The usual text has single blanks and at most two line ends in a row. There a cut before each blank
        # or run of line ends leaves whole pieces; a stretch that begins with a line end had no blank before it.
        eol = "\r\n" if "\r\n" in text else "\n"
        if not ("  " in text or " \n" in text or " \r" in text or 3 * eol in text or text[0].isspace() or text[-1] == " "):
            parts = text.replace(eol, " " + eol).replace(f"{eol} {eol}", 2 * eol).split(" ")
            if not parts[0][-1:].isspace():
                try:
                    out = [self.bare(parts[0])]
                    out.extend(map(kept.__getitem__, parts[1:]))
                    return out
                except _Odd:
                    pass
        return [self.bare(s) for s in self._stretches.findall(text)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, whole; empty for a null or empty one."""
        return list(chain.from_iterable(self.stretches(text))) if text else []

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        return sum(map(len, self.stretches(text))) if text else 0

    def trim(self) -> None:
        if len(self._kept) > KEPT:
            self._kept.clear()
        if len(self._bare) >= KEPT // 2:
            self._bare.clear()


class _Odd(Exception):
    """A stretch with white space at its ends: the text needs the general way."""


class _Kept(dict):
    """Encoded stretches by their text after the blank; text that begins with a line end has no blank before it."""

    def __init__(self, encoder: BpeEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, key: str) -> tuple[int, ...]:
        if not key:
            raise _Odd
        inner = key.lstrip() if key[0] in "\r\n" else key
        if inner and (inner[0].isspace() or inner[-1].isspace()):
            raise _Odd
        ids = self.encoder.stretch(key if key[0] in "\r\n" else " " + key)
        if len(key) <= KEPT_CHARS and len(self) <= KEPT + 100_000:
            self[key] = ids
        return ids


@cache
def encoder(path: str) -> BpeEncoder:
    """The worker's encoder of a rank file."""
    return BpeEncoder(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids ARRAY<INT>`` of every row, whole texts, without special tokens.

    A null or empty text gives an empty list. Repeated rows each give a row; other
    columns aren't read. One narrow pass: no shuffle, whatever the skew.
    """
    ship(df.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, ends = [], [0]
            total = 0
            for text in batch.column(1).to_pylist():
                if text:
                    parts = enc.stretches(text)
                    flat.append(np.fromiter(chain.from_iterable(parts), np.int32))
                    total += len(flat[-1])
                ends.append(total)
            enc.trim()
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(df[id_col].alias("id"), df[text_col].alias("t"))).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def corpus_sizes(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens BIGINT`` of every row; null for a null text, 0 for an empty one."""
    ship(df.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            last = batch.num_columns - 1
            sizes = [None if t is None else enc.count(t) for t in batch.column(last).to_pylist()]
            enc.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*[df[c] for c in keep], df[text_col].alias("__text"))).mapInArrow(run, f"{kinds}, n_tokens bigint")
