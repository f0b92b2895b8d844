"""Byte-level BPE ids of whole texts, made by the tokenizers library on distinct words.

A byte-level BPE never merges across the boundary before a blank that follows a
visible character, nor across a single newline between visible ones, so a text
is cut there, each distinct piece of a slice is encoded once and the ids are
gathered back by numpy.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuskit.llm._text import REMEMBERED, Remembered, gather, release, slices, texts, word_parts

#: Bytes of text in one slice: the larger, the fewer words are looked up twice.
SLICE = 4_000_000
#: Texts with white space before a blank, or other white space than these four, are encoded whole.
_ODD = "[ \\t\\n\\r] |[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: The parts of a text that must show that newlines stand alone.
_SHOWN = ["a", ".", "\n", "B", "\n", "c"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordCache(Remembered):
    """Ids of distinct pieces, remembered per worker process."""

    _all: dict[str, WordCache] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        newline = self.whole(["\n"])[0]
        self.newline = int(newline[0]) if len(newline) == 1 else -1
        text, shown = "".join(_SHOWN), self.tok.pre_tokenizer and self.tok.pre_tokenizer.pre_tokenize_str("".join(_SHOWN))
        self.lines = [text[a:b] for _, (a, b) in shown or []] == _SHOWN
        super().__init__(np.uint32)

    @classmethod
    def of(cls, path: str) -> WordCache:
        if path not in cls._all:
            cls._all[path] = cls(path)
        return cls._all[path]

    def whole(self, items: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(items, add_special_tokens=False)]

    def fresh(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new pieces in one array, how many each has, and the pieces' order in the array.

        Pieces without other white space than a first blank are encoded as one
        text with newlines between them: a newline is a token of its own there.
        """
        size = np.zeros(len(items), np.int64)
        joins = pc.match_substring_regex(items, r"^ ?[^\s\x0b]+$").to_numpy(zero_copy_only=False) & (self.newline >= 0)
        at, parts = np.flatnonzero(joins), []
        for a in range(0, len(at), 20_000):
            part = items.take(pa.array(at[a : a + 20_000])).to_pylist()
            ids = self.whole(["\n".join(part)])[0]
            ends = np.flatnonzero(ids == self.newline)
            if len(ends) == len(part) - 1:
                size[at[a : a + 20_000]] = np.diff(np.r_[-1, ends, len(ids)]) - 1
                parts.append(ids[ids != self.newline])
            else:
                each = self.whole(part)
                size[at[a : a + 20_000]] = [len(x) for x in each]
                parts += each
        rest = np.flatnonzero(~joins)
        each = self.whole(items.take(pa.array(rest)).to_pylist())
        size[rest] = [len(x) for x in each]
        order = np.concatenate([at, rest]).astype(np.int64)
        flat = np.concatenate([*parts, *each]) if len(order) else np.empty(0, np.uint32)
        return flat, size, order


def pieces(column: pa.Array, added: list[str], lines: bool) -> tuple[np.ndarray, np.ndarray, pa.Array, dict[int, str]]:
    """Texts as codes of pieces: codes, row offsets, distinct pieces, and rows to encode whole.

    The first word of a text has no blank before it; each later one has one.
    Words are cut further by :func:`word_parts`. Texts that hold one of the
    ``added`` tokens are encoded whole.
    """
    odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
    for token in added:
        odd = odd | pc.match_substring(column, token).to_numpy(zero_copy_only=False)
    whole = {int(i): column[int(i)].as_py() for i in np.flatnonzero(odd)}
    plain = pc.if_else(pa.array(odd), "", column) if whole else column
    split = pc.split_pattern(plain, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    flat = split.flatten()
    first = np.zeros(len(flat), bool)
    first[offsets[:-1]] = True
    spaced = flat.dictionary_encode()
    code = spaced.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = flat.filter(pa.array(first)).dictionary_encode()
    code[first] = heads.indices.to_numpy(zero_copy_only=False) + len(spaced.dictionary)
    items = pa.concat_arrays([pc.binary_join_element_wise("", spaced.dictionary, " "), heads.dictionary])
    parts, size, distinct = word_parts(items, lines)
    size_of = size[code]
    return gather(parts, (np.cumsum(size) - size)[code], size_of), np.concatenate([[0], np.cumsum(size_of)])[offsets], distinct, whole


@dataclass
class Coded:
    """Texts as codes into a dictionary of pieces; ``number`` and ``flat`` are the pieces' ids."""

    code: np.ndarray
    offsets: np.ndarray
    number: np.ndarray
    flat: np.ndarray
    odd: dict[int, np.ndarray]

    def expand(self, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and row offsets of length n + 1."""
        n = self.number[self.code]
        first = np.concatenate([[0], np.cumsum(self.number)])[:-1]
        ids = gather(self.flat, first[self.code], n)
        before = np.concatenate([[0], np.cumsum(n)])[self.offsets]
        held = np.diff(before)
        size = held.copy()
        for i, x in self.odd.items():
            size[i] = len(x)
        start = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(start[-1], end_id, np.uint32)
        kept = held.copy()
        kept[list(self.odd)] = 0
        inner = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
        out[np.repeat(start[:-1], kept) + inner] = ids[np.repeat(before[:-1], kept) + inner]
        for i, x in self.odd.items():
            out[start[i] : start[i] + len(x)] = x
        return out, start

    def histogram(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids and how often each occurs, without closing ids."""
        keep = np.repeat(~np.isin(np.arange(len(self.offsets) - 1), list(self.odd)), np.diff(self.offsets))
        uses = np.bincount(self.code[keep], minlength=len(self.number))
        ids = np.concatenate([self.flat, *self.odd.values()]).astype(np.int64)
        weight = np.concatenate([np.repeat(uses, self.number), *(np.ones(len(x)) for x in self.odd.values())])
        total = np.bincount(ids, weights=weight) if len(ids) else np.empty(0)
        found = np.flatnonzero(total)
        return found, total[found].astype(np.int64)


def code_column(column: pa.Array, cache: WordCache) -> Coded:
    code, offsets, items, whole = pieces(column, cache.added, cache.lines)
    start, number = cache.places(items)
    return Coded(code, offsets, number, gather(cache.flat, start, number), dict(zip(whole, cache.whole(list(whole.values())))))


def coded(batches: Iterator[pa.RecordBatch], path: str, slice_bytes: int = SLICE, remembered: int = REMEMBERED) -> Iterator[tuple[pa.RecordBatch, Coded]]:
    """Slices of the batches with their coded texts."""
    cache = WordCache.of(path)
    cache.limit = remembered
    for batch in slices(batches, limit=slice_bytes):
        yield batch, code_column(texts(batch), cache)
        if slice_bytes < SLICE:
            release()
