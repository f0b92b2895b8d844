"""Language identification by Bayesian fusion of text, declaration and host.

The posterior of a language is the product of three kinds of evidence: byte
trigram likelihoods of the whole text, tempered as neighbouring trigrams repeat
each other; the declared language, as reliable as declarations agree with texts
over the whole table; and a prior of the host, smoothed towards its domain,
that towards its address suffix, and that towards all rows. The priors are
grouped counts over all rows, without the row itself. One more class stands for
text in no known language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuskit.llm._text import read, slices, small_batches, texts, tidy
from corpuskit.plans.scratch import Scratch

#: Labelled rows of each language that the text model is fitted on, those with the least hashes of their ids, and
#: languages it has at most, those with most rows.
SAMPLE_ROWS, MOST_LANGUAGES = 1000, 200
#: Hash buckets of byte trigrams.
BUCKETS = 1 << 16
#: A text of many trigrams counts as this many independent ones.
EVIDENCE = 40.0
#: Rows of the next wider group that a host, domain or suffix is smoothed with.
KAPPA = 20.0
#: Prior of no known language; a text below this posterior of its best language is rejected too.
UNKNOWN_PRIOR, LEAST_POSTERIOR = 0.001, 0.5
#: The share of the uniform distribution in each language's.
UNIFORM = 0.1
UNKNOWN = "und"
#: Bytes of text in one slice; each takes some 50 bytes of arrays.
SLICE = 1_500_000
_LOWER = np.array([32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint32)
#: What a byte is: 1 part of a letter, 2 white space, 0 anything else.
_KIND = np.array([2 if 9 <= c <= 13 or c == 32 else int(c >= 128 or chr(c).isalpha()) for c in range(256)], np.uint8)


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and for each text the first and the end of its trigrams.

    Trigrams with other bytes than of letters and white space tell no language: they get BUCKETS.
    """
    column = column.cast(pa.large_string())
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    plain = np.frombuffer("".join(column.to_pylist()).encode() + b"  ", np.uint8)
    raw, kind = _LOWER[plain], _KIND[plain]
    bucket = ((raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    told = (kind[:-2] > 0) & (kind[1:-1] > 0) & (kind[2:] > 0) & ((kind[:-2] & kind[1:-1] & kind[2:]) != 2)
    bucket[~told] = BUCKETS
    first = np.cumsum(size) - size
    return bucket, first, first + np.maximum(size - 2, 0)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of the trigram buckets in each language; the last row is no known language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def evidence(self, column: pa.Array) -> np.ndarray:
        """The tempered log likelihoods ``(n, languages + 1)``; zeros for texts without a trigram."""
        bucket, first, end = _trigrams(column)
        told = np.concatenate([[0], np.cumsum(bucket < BUCKETS)])
        n = told[end] - told[first]
        out = np.zeros((len(first), len(self.table)))
        for k, row in enumerate(self.table):
            total = np.concatenate([[0.0], np.cumsum(np.append(row, 0)[bucket], dtype=np.float64)])
            out[:, k] = total[end] - total[first]
        return out / np.maximum(n, 1)[:, None] * (n / (1 + n / EVIDENCE))[:, None]


def language_of(label: Column) -> Column:
    """A declared or labelled language without its region: ``en`` of ``en-US`` and ``EN_gb``; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def fit(labelled: DataFrame, text_col: str, lang_col: str, id_col: str) -> TextModel:
    """Fits the text model on at most SAMPLE_ROWS labelled rows of each language, chosen by the hash of their ids.

    So a rare language is fitted as a common one is. Labels count without their
    region. The least hashes are found by their rank within ranges of hashes:
    no task sorts all rows of a language.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), language_of(F.col(lang_col)).alias("lang")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES)
    # Some four times as many rows as are wanted lie below this share of the hash range, and fewer than wanted practically never.
    hashed = rows.join(F.broadcast(sizes), "lang").withColumn("h", F.xxhash64("id")).where(F.col("h") / float(2**63) <= 8 * SAMPLE_ROWS / F.col("rows") - 1)
    best = Window.partitionBy("lang").orderBy("h", "id")
    picked = hashed.select("id", "lang", "h").withColumn("r", F.row_number().over(best)).where(F.col("r") <= SAMPLE_ROWS).select("id", "lang")
    rows = rows.join(F.broadcast(picked), ["id", "lang"], "left_semi")  # SAMPLE_ROWS ids of MOST_LANGUAGES languages

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            bucket, first, end = _trigrams(texts(batch))
            langs = np.array(batch.column("lang").to_pylist())
            for lang in np.unique(langs).tolist():
                mine = np.flatnonzero(langs == lang)
                got = [bucket[first[i] : end[i]] for i in mine]
                got = np.concatenate(got)
                found, n = np.unique(got[got < BUCKETS], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "bucket": pa.array(found, pa.int32()), "n": pa.array(n, pa.int64())})

    counts = rows.select("text", "lang").mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with small_batches(labelled.sparkSession):
        got = counts.toPandas()  # BUCKETS rows per language of the sample at most
    languages = tuple(sorted(got["lang"].unique()))
    table = np.full((len(languages) + 1, BUCKETS), -np.log(BUCKETS))
    for k, lang in enumerate(languages):
        mine = got[got["lang"] == lang]
        seen = np.zeros(BUCKETS)
        seen[mine["bucket"].to_numpy()] = mine["n"].to_numpy()
        table[k] = np.log((1 - UNIFORM) * seen / seen.sum() + UNIFORM / BUCKETS)
    return TextModel(languages, table)


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """``(id, declared, host, letters, evidence)``; ``letters`` tells whether the text has any."""
    table = model.table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = TextModel(model.languages, table)
        for batch in slices(batches, limit=SLICE):
            found = held.evidence(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), batch.column("host"), pc.match_substring_regex(texts(batch), r"\p{L}"), pa.array(list(found), pa.list_(pa.float64()))], names=["id", "declared", "host", "letters", "evidence"])

    return rows.select("id", "text", "declared", "host").mapInArrow(tidy(run), "id long, declared string, host string, letters boolean, evidence array<double>")


def _best(score: list[Column], names: list[str]) -> Column:
    """The name with the highest score; of equal ones the first."""
    return F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("name")) for k, (s, n) in enumerate(zip(score, names)))))["name"]


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """``(id, text_language, language, confidence, kept)`` of rows ``(id, text, declared, host)``.

    Declared languages are compared by their part before ``-`` or ``_`` in lower
    case; unknown and null ones are no evidence, nor is a null host. A text
    without a letter is ``und``, so are null and empty texts and those that no
    known language explains; they and texts below LEAST_POSTERIOR are not kept.
    A model without languages tells nothing: languages are null and all rows kept. Repeated rows give repeated rows; an empty table gives none.
    """
    scratch = Scratch(rows.sparkSession, "language_id")
    names = list(model.languages)
    if not names:
        nothing = F.lit(None).cast("string")
        return rows.select("id", nothing.alias("text_language"), nothing.alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("kept"))
    with small_batches(rows.sparkSession):
        scored = scratch.table(text_evidence(rows, model), "evidence")
    langs = [F.col("evidence")[k] for k in range(len(names))]
    unknown = F.col("evidence")[len(names)]
    host = F.lower(F.trim("host"))
    parts = F.split(host, r"\.")
    scored = scored.withColumns(
        {
            "text_language": F.when(~F.col("letters"), F.lit(UNKNOWN)).otherwise(_best([*langs, unknown + float(np.log(UNKNOWN_PRIOR))], [*names, UNKNOWN])),
            "told": language_of(F.col("declared")),
            "suffix": F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("")),
            "domain": F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(host),
            "host": host,
        }
    )
    scored = scored.withColumn("vote", F.when(F.col("text_language").isin(names), F.col("text_language")))
    scored = scored.withColumn("told", F.when(F.col("told").isin(names), F.col("told")))

    votes = [F.count_if(F.col("vote") == n) for n in names]
    by_host = scored.where("vote is not null").groupBy("suffix", "domain", "host").agg(F.array(*votes).alias("c"))
    by_host = scratch.table(by_host, "hosts")
    add = lambda c: F.array(*(F.sum(F.col(c)[k]) for k in range(len(names))))
    by_domain = by_host.where("host is not null").groupBy("suffix", "domain").agg(add("c").alias("cd"))
    by_suffix = by_host.where("host is not null").groupBy("suffix").agg(add("c").alias("cs"))
    total = by_host.agg(add("c").alias("c")).first()["c"]
    agree = scored.agg(F.count_if(F.expr("vote = told")).alias("a"), F.count_if(F.expr("vote is not null and told is not null")).alias("n")).first()
    reliable = (agree["a"] + 9) / (agree["n"] + 10)

    everywhere = [(x or 0) + 1 for x in total]
    everywhere = [x / sum(everywhere) for x in everywhere]
    groups = by_host.where("host is not null").join(by_domain, ["suffix", "domain"]).join(by_suffix, "suffix").select("host", "c", "cd", "cs")
    joined = scored.join(groups, "host", "left")

    def prior(k: int) -> Column:
        mine = F.when(F.col("vote") == names[k], 1).otherwise(0)
        any_vote = F.when(F.col("vote").isNotNull(), 1).otherwise(0)
        p = F.lit(everywhere[k])
        for c in ("cs", "cd", "c"):
            own = F.coalesce(F.col(c)[k] - mine, F.lit(0))
            size = F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - any_vote, F.lit(0))
            p = (own + KAPPA * p) / (size + KAPPA)
        return p

    wrong = (1 - reliable) / max(1, len(names) - 1)
    for k, n in enumerate(names):
        said = F.when(F.col("told").isNull(), F.lit(0.0)).when(F.col("told") == n, F.lit(float(np.log(reliable)))).otherwise(F.lit(float(np.log(max(wrong, 1e-6)))))
        joined = joined.withColumn(f"s{k}", F.col("evidence")[k] + said + F.log(prior(k)) + float(np.log(1 - UNKNOWN_PRIOR)))
    mean_said = float(np.log(1 / max(1, len(names))))
    joined = joined.withColumn(f"s{len(names)}", F.col("evidence")[len(names)] + float(np.log(UNKNOWN_PRIOR)) + F.when(F.col("told").isNull(), 0.0).otherwise(mean_said))
    score = [F.col(f"s{k}") for k in range(len(names) + 1)]
    top = F.greatest(*score)
    joined = joined.withColumn("confidence", 1 / sum((F.exp(s - top) for s in score[1:]), F.exp(score[0] - top)))
    joined = joined.withColumn("language", F.when(~F.col("letters"), F.lit(UNKNOWN)).otherwise(_best(score, [*names, UNKNOWN])))
    return joined.select("id", "text_language", "language", F.round("confidence", 6).alias("confidence"), ((F.col("language") != UNKNOWN) & (F.col("confidence") >= LEAST_POSTERIOR)).alias("kept"))


def documents_as_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents declare their ``lang`` and have their ``source`` as host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text_col).alias("text"), F.col("lang").alias("declared"), F.col("source").alias("host"))


_OPENS = re.compile(rb"(?i)<(script|style)\b|<!--")
_CLOSES = {b"script": re.compile(rb"(?i)</script\s*>"), b"style": re.compile(rb"(?i)</style\s*>"), b"": re.compile(rb"-->")}


def visible(page: bytes) -> bytes:
    """What stands outside tags, comments, scripts and styles, a blank for each of them.

    One pass: a script, style or comment that is never closed hides nothing but
    its tag, and no later one of its kind is looked at again; a ``<`` that no
    ``>`` follows is text.
    """
    out, at, unclosed = [], 0, set()
    while (start := page.find(b"<", at)) >= 0:
        end, opened = -1, _OPENS.match(page, start)
        kind = (opened[1] or b"").lower() if opened else None
        if opened and kind not in unclosed:
            closed = _CLOSES[kind].search(page, opened.end())
            if closed:
                end = closed.end()
            else:
                unclosed.add(kind)
        if end < 0:
            end = page.find(b">", start) + 1
            if not end:
                break
        out.append(page[at:start])
        at = end
    return b" ".join([*out, page[at:]])


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """Pages declare the ``lang`` of their html tag; the host is the address's, the text what stands outside tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            text = [visible(x).decode("utf-8", "replace") for x in texts(batch, "html").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string()), batch.column("declared"), batch.column("host")], names=["id", "text", "declared", "host"])

    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "html", F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return rows.mapInArrow(tidy(run), "id long, text string, declared string, host string")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and whether it is kept."""
    docs = read(spark, sf_dir, "documents")
    found = identify(documents_as_rows(docs), fit(docs, "text", "lang", "doc_id"))
    return found.withColumnRenamed("id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every web page, by its text, markup and address; the text model is fitted on documents."""
    docs = read(spark, sf_dir, "documents")
    found = identify(pages_as_rows(read(spark, sf_dir, "pages")), fit(docs, "text", "lang", "doc_id"))
    return found.withColumnRenamed("id", "page_id")
