"""SentencePiece encoding and decoding with unigram scores.

An Aho-Corasick automaton over the pieces reports, at each position, the
longest piece that ends there and by its output links all shorter ones; each
relaxes the best score of the position in a single Viterbi pass. No piece holds
a blank mark after its first character, so words are segmented apart, distinct
words once; where the pieces allow it they are cut at newlines and before
closing punctuation too.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm._text import TAIL, Remembered, gather, list_array, read, slices, texts, tidy, word_parts

MARK = "▁"
#: Bytes of text in one slice.
SLICE = 4_000_000
#: How much a byte costs more than the rarest piece.
BYTE_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel(Remembered):
    """Pieces and scores of a model file.

    A file whose scores are merge ranks (0, -1, -2, ...) gets the log
    probabilities of Zipf's law by rank; others keep their scores. Pieces
    scored out of use (-1e8 and below), control pieces and marks inside pieces
    are left out; the mark alone always takes part, scored 0 or as first rank.
    """

    _all: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_id, self.score = [0] * 256, {}
        raw = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
                if piece == MARK:
                    raw.append((piece, i, max(0.0, sp.get_score(i))))
                elif sp.get_score(i) > -1e8 and MARK not in piece[1:]:
                    raw.append((piece, i, sp.get_score(i)))
        ranks = all(s <= 0 and s == int(s) for _, _, s in raw)
        norm = math.log(sum(1 / (k + 1) for k in range(len(raw))))
        self.automaton = ahocorasick.Automaton()
        for piece, i, s in raw:
            score = -math.log(1 - s) - norm if ranks else s
            self.score[piece] = (i, score)
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.byte_score = min(s for _, s in self.score.values()) - BYTE_PENALTY
        # Words are cut where no piece lies across: at a newline, and before closing punctuation.
        pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.cuts = not any("\n" in x or (x[0].isalnum() and x[1] in TAIL) for x in pairs)
        size = np.array([len(x) for x in self.bytes])
        self.byte_start, self.byte_size = np.cumsum(size) - size, size
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        super().__init__(np.int32)

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls._all:
            cls._all[path] = cls(path)
        return cls._all[path]

    def segment(self, marked: str) -> list[int]:
        """The ids of the best segmentation; of equal ones the longest last piece wins."""
        n = len(marked)
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        matches = self.automaton.iter(marked)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            while ahead is not None and ahead[0] == end - 1:
                i, size, score = ahead[1]
                total = best[end - size] + score
                if total > best[end]:
                    best[end], back[end] = total, (end - size, i)
                ahead = next(matches, None)
            raw = len(marked[end - 1].encode())
            total = best[end - 1] + raw * self.byte_score
            if total > best[end]:
                best[end], back[end] = total, (end - 1, -1)
        out, at = [], n
        while at:
            start, i = back[at]
            out += [i] if i >= 0 else [self.byte_id[b] for b in reversed(marked[start:at].encode())]
            at = start
        return out[::-1]

    def word(self, part: str) -> list[int]:
        """Ids of a part of a word; one that opens the word has a blank before it. A mark in the text itself goes as bytes."""
        first, *more = part.split(MARK)
        out = self.segment(MARK + first[1:] if first.startswith(" ") else first)
        for x in more:
            out += [self.byte_id[b] for b in MARK.encode()] + self.segment(x)
        return out

    def fresh(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [self.word(w) for w in items.to_pylist()]
        return np.array(list(itertools.chain.from_iterable(ids)), np.int32), np.array([len(x) for x in ids], np.int64), np.arange(len(ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, gathered as bytes at once; lists that give no UTF-8 or no leading blank one by one."""
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        n = self.byte_size[ids]
        data = gather(self.byte_flat, self.byte_start[ids], n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(size)])]
        full = np.diff(ends) > 0
        first = ends[:-1][full]
        try:
            if (data[first] != 0x20).any():
                raise pa.ArrowInvalid("no leading blank")
            offsets = (ends - np.concatenate([[0], np.cumsum(full)])).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(np.delete(data, first))])
            return pc.if_else(lists.is_valid(), raw.cast(pa.string()), pa.scalar(None, pa.string()))
        except pa.ArrowInvalid:
            return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.string())


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """Adds the piece ids of each text as an array; null and empty texts have an empty array.

    The text is read as if a blank stood before it, and blanks as marks. Any
    text is encoded whole: characters without a piece go as UTF-8 bytes. A
    column named ``out_col`` is replaced.
    """
    model, keep = model or default_model(), [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PieceModel.of(model)
        for batch in slices(batches, text_col, SLICE):
            column = texts(batch, text_col)
            split = pc.split_pattern(column, " ")
            offsets = split.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            coded = split.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            parts, many, distinct = word_parts(pc.binary_join_element_wise("", coded.dictionary, " "), held.cuts)
            start, size = held.places(distinct)
            # The ids of each distinct word, then of each word.
            inner = size[parts]
            ids, total = gather(held.flat, start[parts], inner), np.add.reduceat(np.append(inner, 0), np.cumsum(many) - many) if len(many) else inner
            n = total[code]
            n[offsets[:-1][pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)]] = 0
            ids = gather(ids, (np.cumsum(total) - total)[code], n)
            ends = np.concatenate([[0], np.cumsum(n)])[offsets]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), list_array(ids, ends, pa.int32())], names=[*keep, out_col])

    kinds = dict(docs.dtypes)
    return docs.select(*keep).mapInArrow(tidy(run), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out_col}` array<int>")


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """Adds the text of each array of piece ids; a null array gives null, an empty one the empty text."""
    model, keep = model or default_model(), [c for c in encoded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PieceModel.of(model)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), held.decode_lists(batch.column(ids_col))], names=[*keep, out_col])

    kinds = dict(encoded.dtypes)
    return encoded.select(*keep).mapInArrow(tidy(run), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out_col}` string")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: number and hash of the ids, and whether the text came back."""
    done = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text")))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return done.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("ids_xxhash64"), same.alias("round_trip"))
