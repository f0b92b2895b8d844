"""Secret scan: patterns for known shapes, and password guess costs for values in credential context.

A value that stands where a credential is expected is cut into the cheapest
sequence of words, dates, repeats, keyboard walks and brute-force spans by
dynamic programming; the product of the parts' guesses tells a real secret
from a placeholder.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm._text import read, slices, texts
from corpuskit.llm.tokens import default_tokenizer

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
#: Further places where a credential is expected: short names, bearer headers, user info of addresses.
CONTEXT = re.compile(rb"(?:(?<![a-z0-9])(?:(?:pwd|passphrase|credentials?)[\"']?\x20*[:=]\x20*[\"']?|bearer\x20+)|://[a-z0-9._%+-]+:)([a-z0-9+/_.=!#$%^&*~-]{6,})", re.I)
CONTEXT_WORDS = (b"pwd", b"passphrase", b"credential", b"bearer", b"://")
_HEXES = bytes(0x68 if chr(i) in "0123456789abcdef" else 0x20 for i in range(256))

# Common password words in order of use, and the keyboard's rows.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc123 hello test guest changeme secret "
    "root default user pass example sample dummy placeholder your token key api none null true false value string here "
    "summer winter spring autumn love sunshine princess football baseball shadow michael jordan superman batman"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {a + b for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[::-1], row[-2::-1])]}
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"[-/.]?(?:0[1-9]|1[0-2])", r"[-/.]?(?:0[1-9]|[12]\d|3[01])"
#: A year, a month of it, a day of it.
DATES = [re.compile(x) for x in (_YEAR, _YEAR + _MONTH, _YEAR + _MONTH + _DAY)]
#: A value counts as a secret from 10 to this power guesses on.
GUESSES_LOG10 = 8.0


class Dictionary:
    """Words by their rank in a guesser's list: the common ones, then further ones given in order of use."""

    def __init__(self, further: Iterable[str] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *further]))}
        self.longest = max(map(len, self.rank))


COMMON = Dictionary()


@functools.cache
def vocabulary(path: str) -> Dictionary:
    """The whole words of a byte-level BPE file: those merged first are the most used."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (w[1:].lower() for w in sorted(ids, key=ids.get) if w.startswith("\u0120"))
    return Dictionary(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha())


def _listed(value: str, low: str, at: int, words: Dictionary) -> Iterator[tuple[int, float, str]]:
    """Words and dates that start at a place: (end, log10 of guesses, kind)."""
    for end in range(at + 3, min(len(value), at + words.longest) + 1):
        if rank := words.rank.get(low[at:end]):
            upper = 0.3 * (value[at:end] != low[at:end])
            yield end, math.log10(rank + 1) + upper, "word"
    if value[at] in "12":
        for k, form in enumerate(DATES):
            if m := form.match(value, at):
                yield m.end(), 4.0 if k else 2.1, "date"


class _Run:
    """Repeats or walks that end where the value has been read to: their possible starts and what leads up to them.

    A part of n characters costs log10(weight n), which grows ever slower: of
    two starts the earlier one that was no dearer to reach stays the better once
    it is, and the later one that was no dearer always is. So few are kept.
    """

    def __init__(self, kind: str):
        self.kind, self.starts, self.weight = kind, [], 0

    def begin(self, weight: int) -> None:
        self.starts, self.weight = [], weight

    def best(self, end: int) -> tuple[float, int] | None:
        """The least cost up to ``end`` with such a part last, and its start."""
        open_ = [(cost + math.log10(self.weight * (end - at)), at, cost) for at, cost in self.starts if end - at >= 3]
        if not open_:
            return None
        total, start, reached = min(open_)
        self.starts = [(at, cost) for at, cost in self.starts if end - at < 3 or at == start or cost < reached]
        return total, start


def _size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def guess_cost(value: str, words: Dictionary = COMMON) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses that the cheapest segmentation needs, and its parts ``(start, end, kind)``.

    Brute-force characters cost the size of their class each; each further part
    costs a little, as a guesser must choose the sequence of kinds too. The
    least cost up to each place is kept twice: with a brute-force part at the
    end, which the next character may continue, and with another. The empty
    value costs 0.
    """
    n, low = len(value), value.lower()
    best = [[0.0, math.inf]] + [[math.inf, math.inf] for _ in range(n)]  # by whether the last part is brute force
    back: list[list[tuple[int, int, str]]] = [[(0, 0, ""), (0, 0, "")] for _ in range(n + 1)]
    repeats, walks = _Run("repeat"), _Run("walk")
    for at in range(n):
        single, brute = math.log10(_size(value[at])), int(best[at][1] < best[at][0])
        for last, cost in ((0, best[at][0] + single + 0.3), (1, best[at][1] + single)):
            if cost < best[at + 1][1]:
                best[at + 1][1], back[at + 1][1] = cost, (at, last, "brute")
        for end, cost, kind in _listed(value, low, at, words):
            if best[at][brute] + cost + 0.3 < best[end][0]:
                best[end][0], back[end][0] = best[at][brute] + cost + 0.3, (at, brute, kind)
        if not at or value[at] != value[at - 1]:
            repeats.begin(_size(value[at]))
        if not at or low[at - 1 : at + 1] not in NEXT:
            walks.begin(40)
        for run in (repeats, walks):
            run.starts.append((at, best[at][brute]))
            if (found := run.best(at + 1)) and found[0] + 0.3 < best[at + 1][0]:
                start = found[1]
                best[at + 1][0], back[at + 1][0] = found[0] + 0.3, (start, int(best[start][1] < best[start][0]), run.kind)
    out, at, last = [], n, int(best[n][1] < best[n][0])
    total = best[n][last]
    while at:
        start, before, kind = back[at][last]
        if out and kind == "brute" and out[-1][2] == "brute" and out[-1][0] == at:
            out[-1] = (start, out[-1][1], kind)
        else:
            out.append((start, at, kind))
        at, last = start, before
    return total, out[::-1]


def scan(raw: bytes, words: Dictionary = COMMON) -> list[tuple[str, int, int, float]]:
    """Spans ``(kind, start, end, guesses_log10)`` of one UTF-8 text, in bytes; base kinds first."""
    found, low = [], raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(raw):
            if len(m[2]) >= 6:
                found.append(("assign", *m.span(), guess_cost(m[2].decode(), words)[0]))
    if b"AKIA" in raw:
        found += [("access", *m.span(), 0.0) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    if b"h" * 24 in raw.translate(_HEXES):
        found += [("hex", *m.span(), 0.0) for m in HEX.finditer(raw)]
    if any(w in low for w in CONTEXT_WORDS):
        for m in CONTEXT.finditer(raw):
            cost = guess_cost(m[1].decode(), words)[0]
            if cost >= GUESSES_LOG10:
                found.append(("value", *m.span(1), cost))
    return found


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("guesses_log10", pa.float64())]))


def _points(raw: bytes) -> np.ndarray | None:
    """How many code points stand before each byte of a UTF-8 text; None if they are as many as bytes."""
    return None if raw.isascii() else np.cumsum(np.r_[0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_file: str | None = None) -> DataFrame:
    """``(id_col, secrets array<struct<kind, start, end, guesses_log10>>)``, places in code points.

    Kinds: assign, access, hex and value, in this order, then by start. Guess
    costs know the words of ``vocabulary_file``. Null and empty texts have an
    empty array; repeated ids give repeated rows; other columns are not read.
    """
    kind, path = dict(docs.dtypes)[id_col], vocabulary_file or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in slices(batches):
            out = []
            for raw in texts(batch).cast(pa.binary()).to_pylist():
                spans = scan(raw, held)
                points = _points(raw) if spans else None
                at = (lambda i: i) if points is None else (lambda i, points=points: int(points[i]))
                out.append([{"kind": k, "start": at(a), "end": at(b), "guesses_log10": c} for k, a, b, c in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, SPAN)], names=["id", "secrets"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, secrets array<struct<kind:string,start:int,end:int,guesses_log10:double>>").withColumnRenamed("id", id_col)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, all spans, and log10 of the guesses of each."""
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("assign", "access", "hex")
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*base, "value"))), s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end"), s["guesses_log10"].alias("cost"))
    ordered = F.array_sort(F.transform("secrets", order))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, base), F.sha2(joined(F.filter(ordered, lambda s: s["kind"] != "value")), 256).alias("base_sha256"), joined(ordered).alias("spans"), F.array_join(F.transform(ordered, lambda s: F.format_string("%.2f", s["cost"])), ",").alias("guesses_log10"))
