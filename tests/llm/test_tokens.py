"""Token files, packing and the word-wise encoder against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuskit.llm import packing, token_files, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
BITS = ["hello", "  ", " ", "\n", "\t", "é", "1234", "'s", "!!", "\x1c", "word,", "foo.", "<|endoftext|>", "it's", "日本", " \n", "\r\n", "\x0b", "😀", "...", " a", " the", "end.\nNew", "a\nb\n\nc", "\nx"]


def random_texts(n, seed, longest=30):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(longest))) for _ in range(n)]


def whole(texts):
    """By a freshly loaded tokenizer."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    return [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_encoder_equals_library():
    texts = [*random_texts(2000, 1), "", " ", "\n"]
    ids, start = tokens.code_column(pa.array(texts), tokens.WordCache.of(tokens.default_tokenizer())).expand(0)
    for i, want in enumerate(whole(texts)):
        assert ids[start[i] : start[i + 1]].tolist() == want, texts[i]


def test_byte_code_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (2 ** r.uniform(0, 32, n)).astype(np.uint32)
        assert (token_files.decode(*token_files.encode(x), n) == x).all()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


DOCS = "doc_id long, text string, lang string, part int, length int"


def table(spark, texts):
    rows = [(i * 7 % 1009, t, "en", 5, 9) for i, t in enumerate(texts)]
    random.Random(4).shuffle(rows)
    return rows, spark.createDataFrame(rows, DOCS)


def test_token_files(spark, tmp_path):
    rows, docs = table(spark, [*random_texts(300, 2), None, "", "x" * 5000, "the " * 4000])
    token_files.write_token_files(docs, f"file://{tmp_path}/set")
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in token_files.document_digests(spark, f"file://{tmp_path}/set").collect()}
    at = 0
    for (doc_id, *_), ids in zip(sorted(rows, key=lambda r: r[0]), whole([r[1] for r in sorted(rows, key=lambda r: r[0])])):
        assert got[doc_id] == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(rows)


def test_token_files_of_empty_table(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], DOCS), f"file://{tmp_path}/set")
    assert token_files.document_digests(spark, f"file://{tmp_path}/set").count() == 0


def check_packing(rows, got, window):
    texts = dict((r[0], r[1]) for r in rows)
    ids = dict(zip(texts, whole(texts.values())))
    seen, windows = Counter(), {}
    for x in got:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert len(part) == x.length and crc(part) == x.ids_crc32 and x.doc_tokens == len(ids[x.doc_id])
        seen.update((x.doc_id, i) for i in range(x.start, x.start + x.length))
        windows.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert seen == Counter((d, i) for d, v in ids.items() for i in range(len(v)))
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= window
    return len(windows), sum(map(len, ids.values()))


def test_packing(spark):
    rows, docs = table(spark, [*random_texts(400, 3, 60), None, "", "x" * 5000, "the " * 4000])
    n, total = check_packing(rows, packing.pack(docs, window=256).collect(), 256)
    assert n <= 1.05 * total / 256 + 1
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_is_best_fit_decreasing():
    r = random.Random(6)
    for _ in range(200):
        lengths = [r.randrange(1, 33) for _ in range(r.randrange(60))]
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, c in enumerate(free) if c >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(32 - n)
        hist = Counter(lengths)
        plan = packing.best_fit_decreasing(dict(hist), 32)
        used = Counter()
        for k, (length, rank, first, _, per) in enumerate(plan):
            end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else hist[length]
            for i in range(end - rank):
                used[first + i // per] += length
        assert sorted(32 - v for v in used.values()) == sorted(free)


def test_encoder_equals_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "one,<|endoftext|>.two", "<|endoftext|><|endoftext|>", "<|endoftext", "plain text", "", *random_texts(500, 9)]
    ids, start = tokens.code_column(pa.array(texts), tokens.WordCache.of(tokens.default_tokenizer())).expand(0)
    assert 50256 in ids
    for i, t in enumerate(texts):
        assert ids[start[i] : start[i + 1] - 1].tolist() == fresh.encode(t, add_special_tokens=False).ids, t
