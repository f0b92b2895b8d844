"""Overlapping chunks that end at sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_BREAK = re.compile(r"[.!?](?=\s)")


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """``(content, start, end)`` of one text; the next chunk starts ``overlap`` characters before the last end."""
    text, start = text.strip(), 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            last = max((m.end() for m in _BREAK.finditer(text, start, end) if m.end() < end), default=start) - start
            if last > overlap:
                end = start + last
        if content := text[start:end].strip():
            yield content, start, end
        if end >= len(text):
            return
        start = end - overlap


def chunk_text(docs: DataFrame, size: int = 1500, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, chunk_index, content, char_start, char_end)`` of every document.

    The cut of one chunk depends on the last, so a task walks each text; texts
    are independent of each other. Null and blank texts have no chunks.
    """
    if overlap >= size:
        raise ValueError("overlap must be less than size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                rows = [(d, i, *c) for d, t in zip(part[id_col], part[text_col]) if t for i, c in enumerate(cut(t, size, overlap))]
                yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "content", "char_start", "char_end"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_index long, content string, char_start long, char_end long")
