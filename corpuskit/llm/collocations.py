"""Phrases whose words stand together more often than alone, from count transducers.

A count transducer is a weighted acyclic automaton: a state for each phrase that
is frequent enough, its weight the phrase's count, an arc from the phrase without
its last word, and a link to the phrase without its first word. It grows by one
word at a time. Each shard of documents sorts its phrases of that length, which
it knows as pairs of states of the length before, and sends them with their
counts by ranges of those pairs; a range is united over all shards, sums the
weights, and numbers the frequent ones as new states; these go back to the
shards. So a phrase is only built where both its parts are frequent. Parts of
phrases are looked up by composing arcs and links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuskit.llm._text import byte_translated, groups, hash_words, mix, read, slices, small_batches, words
from corpuskit.plans.scratch import Scratch

#: Words of the longest phrase, how often a phrase occurs at least, and phrases of one language that are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of one shard, and words of all documents for each range of phrases.
SHARD_WORDS, RANGE_WORDS = 2_000_000, 4_000_000
#: Parts of one language that are ranked by themselves before they are ranked together.
PARTS = 64
#: Lower case for A-Z, a newline for what ends a piece, a blank for a tab.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _ENDS else 32 if c == 9 else c for c in range(256))

_SENT = "range int, shard long, words array<string>, left array<long>, right array<long>, counts array<int>, codes array<int>, langs array<string>, sizes array<long>"
_SENT_ARROW = pa.schema([("range", pa.int32()), ("shard", pa.int64()), ("words", pa.list_(pa.string())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64()))])
_SUMMED = "range int, shard long, to array<long>, words array<string>, left array<long>, right array<long>, state array<long>, f array<long>"
_SUMMED_ARROW = pa.schema([("range", pa.int32()), ("shard", pa.int64()), ("to", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("state", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])


def _table(schema: pa.Schema, columns: dict[str, tuple], n: int) -> pa.RecordBatch:
    """A batch of ``n`` rows; list columns as (flat values, offsets), others as arrays, missing ones null."""
    out = []
    for field in schema:
        value = columns.get(field.name)
        if value is None:
            out.append(pa.nulls(n, field.type))
        elif isinstance(value, tuple):
            flat, offsets = value
            flat = flat if isinstance(flat, pa.Array) else pa.array(np.asarray(flat), field.type.value_type)
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
        else:
            out.append(pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def pieces(array: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, which of them begin a piece, and the distinct words."""
    changed = byte_translated(array, _TABLE)
    codes, offsets, terms = words(changed, lower=False)
    begins = np.zeros(len(codes) + 1, bool)
    begins[offsets[:-1]] = True
    if len(codes):
        at = np.frombuffer(changed.buffers()[1], np.int32)[changed.offset : changed.offset + len(changed) + 1]
        data = np.frombuffer(changed.buffers()[2], np.uint8)[at[0] : at[-1]]
        seen = (data != 32) & (data != 10)
        first = seen.copy()
        first[1:] &= ~seen[:-1]
        row = (at - at[0])[:-1]
        row = row[row < len(seen)]
        first[row] = seen[row]
        begins[np.cumsum(first)[data == 10]] = True
    return codes, begins[:-1], terms


def _by_range(which: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by their range, the ranges that have any, and where each begins."""
    order = np.argsort(which, kind="stable")
    names, begin = np.unique(which[order], return_index=True)
    return order, names, np.append(begin, len(which))


def _first_level(docs: DataFrame, ranges: int) -> DataFrame:
    """Messages of each shard's words, and the shard's places as codes of them, -1 between pieces."""

    def closed(shard: int, parts: list, sizes: dict[str, int]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        terms, to = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order, names, begin = _by_range((hash_words(terms) % np.uint64(ranges)).astype(np.int64), ranges)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes, at = [], 0
        for part_terms, part_codes, begins in parts:
            mine = rank[to[at : at + len(part_terms)][part_codes]]
            codes.append(np.insert(mine, np.flatnonzero(begins), -1).astype(np.int32))
            at += len(part_terms)
        codes = np.concatenate(codes)
        counts = np.bincount(codes[codes >= 0], minlength=len(order))
        yield _table(_SENT_ARROW, {"range": names, "shard": np.full(len(names), shard), "words": (terms.take(pa.array(order)), begin), "counts": (counts, begin)}, len(names))
        langs = sorted(sizes)
        yield _table(_SENT_ARROW, {"range": [-1], "shard": [shard], "codes": (codes, [0, len(codes)]), "langs": (pa.array(langs, pa.string()), [0, len(langs)]), "sizes": ([sizes[x] for x in langs], [0, len(langs)])}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, sizes, held = TaskContext.get().partitionId() << 32, [], {}, 0
        for part in slices(batches):
            langs = part.column("lang").dictionary_encode()
            number = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                codes, begins, terms = pieces(part.column("text").filter(pa.array(number == i)))
                if len(codes):
                    parts.append((pc.binary_join_element_wise(pa.scalar(lang), terms, "\t"), codes.astype(np.int32), begins))
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                    held += len(codes)
            if held >= SHARD_WORDS:
                yield from closed(shard, parts, sizes)
                shard, parts, sizes, held = shard + 1, [], {}, 0
        if held:
            yield from closed(shard, parts, sizes)

    return docs.mapInArrow(run, _SENT)


def _next_level(rows: DataFrame, answers: DataFrame, ranges: int, last: bool) -> DataFrame:
    """Messages of each shard's phrases of one word more, as pairs of states, and their places unless ``last``."""

    def run(held: pa.Table, told: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([], schema=_SENT_ARROW)
        if not held.num_rows or not told.num_rows:
            return none
        shard = held.column("shard")[0].as_py()
        codes = np.concatenate([c.flatten().to_numpy() for c in held.column("codes").chunks]).astype(np.int64)
        told = told.sort_by("range")
        to = np.concatenate([c.flatten().to_numpy() for c in told.column("to").chunks])
        state = np.where(codes >= 0, to[codes], -1)
        live = (state[:-1] >= 0) & (state[1:] >= 0)
        left, right = state[:-1][live], state[1:][live]
        if not len(left):
            return none
        order = _pair_order(left, right)
        left, right = left[order], right[order]
        new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        begin = np.flatnonzero(new)
        counts, left, right = np.diff(np.append(begin, len(order))), left[begin], right[begin]
        key = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))
        by, names, cut = _by_range((key % np.uint64(ranges)).astype(np.int64), ranges)
        out = [_table(_SENT_ARROW, {"range": names, "shard": np.full(len(names), shard), "left": (left[by], cut), "right": (right[by], cut), "counts": (counts[by], cut)}, len(names))]
        if not last:
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            mine = np.empty(len(order), np.int64)
            mine[order] = rank[np.cumsum(new) - 1]
            codes = np.full(len(live), -1, np.int32)
            codes[live] = mine
            kept = codes >= 0
            kept[1:] |= codes[:-1] >= 0  # one place without a phrase stands for any number of them
            codes = codes[kept]
            out.append(_table(_SENT_ARROW, {"range": [-1], "shard": [shard], "codes": (codes, [0, len(codes)])}, 1))
        return pa.Table.from_batches(out)

    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, _SENT)


def _pair_order(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if max(left.max(), right.max()) < 1 << 31:
        return np.argsort(left << 32 | right)
    return np.lexsort((right, left))


def _united(messages: DataFrame, ranges: int, least: int) -> DataFrame:
    """For each range one row of the new states, and one for each shard with the state of each phrase it sent, -1 for rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ("range",)):
            number = batch.column("range")[0].as_py()
            sizes = batch.column("counts").value_lengths().to_numpy(zero_copy_only=False)
            counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
            if batch.column("words").null_count:
                left, right = batch.column("left").flatten().to_numpy(), batch.column("right").flatten().to_numpy()
                order = _pair_order(left, right)
                left, right = left[order], right[order]
                new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
                code = np.empty(len(order), np.int64)
                code[order] = np.cumsum(new) - 1
                names = {"left": left[new], "right": right[new]}
            else:
                coded = batch.column("words").flatten().dictionary_encode()
                code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), {"words": coded.dictionary}
                order = np.argsort(code, kind="stable")
                new = np.concatenate([[True], np.diff(code[order]) > 0])
            f = np.add.reduceat(counts[order], np.flatnonzero(new))
            kept = f >= least
            state = np.where(kept, (np.cumsum(kept) - 1) * ranges + number, -1)
            n, many = int(kept.sum()), batch.num_rows
            arcs = {k: ((v.filter(pa.array(kept)) if isinstance(v, pa.Array) else v[kept]), [0, n]) for k, v in names.items()}
            yield _table(_SUMMED_ARROW, arcs | {"range": [number], "state": (state[kept], [0, n]), "f": (f[kept], [0, n])}, 1)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            for i in range(0, many, 16):
                part = min(i + 16, many)
                cut = offsets[i : part + 1]
                yield _table(_SUMMED_ARROW, {"range": np.full(part - i, number), "shard": batch.column("shard").slice(i, part - i), "to": (state[code[cut[0] : cut[-1]]], cut - cut[0])}, part - i)

    sent = messages.repartition("range").sortWithinPartitions("range", "shard")
    return sent.select("range", "shard", "words", "left", "right", "counts").mapInArrow(run, _SUMMED)


def transducer(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """The levels of the count transducer, and ``(lang, n)``.

    Level 1 has ``(state, lang, word, f)``, level k the phrases of k words as
    ``(state, left, right, f)``: the states of the phrase without its last and
    without its first word. ``f`` counts all occurrences inside pieces, overlaps
    included, and is at least ``least``. Shards and ranges grow in number with
    the words, so a task holds one shard or one range.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    levels, ranges = [], max(4, 2 * rows.rdd.getNumPartitions())
    with small_batches(spark):
        sent = scratch.table(_first_level(rows, ranges), "sent1", "zstd", wide=True)
    with small_batches(spark, 8):
        places = sent.where("range < 0")
        totals = scratch.table(places.select(F.inline(F.arrays_zip("langs", "sizes"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("sizes").alias("n")), "totals")
        n = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        for k in range(1, longest + 1):
            summed = scratch.table(_united(sent.where("range >= 0"), ranges, least), f"summed{k}", "zstd", wide=True)
            arcs = summed.where("shard is null")
            if k == 1:
                arcs = arcs.select(F.inline(F.arrays_zip("state", "words", "f")))
                arcs = arcs.select("state", F.regexp_extract("words", "(?s)^(.*)\t", 1).alias("lang"), F.regexp_extract("words", "([^\t]*)$", 1).alias("word"), "f")
            else:
                arcs = arcs.select(F.inline(F.arrays_zip("state", "left", "right", "f")))
            levels.append(arcs)
            if k < longest:
                ranges = max(4, -(-n // RANGE_WORDS))
                following = _next_level(sent.where("range < 0").select("shard", "codes"), summed.where("shard is not null").select("shard", "range", "to"), ranges, k + 1 == longest)
                sent = scratch.table(following, f"sent{k + 1}", "zstd", wide=True)
                scratch.drop(f"sent{k}")
    return levels, totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language by score.

    Words are what blanks and tabs separate inside pieces, pieces what
    punctuation and newlines separate. A phrase of 2 to ``longest`` words that
    occurs ``a >= least`` times scores floor(1000 a n / (l r)) at its worst cut,
    the first of equal ones: l and r are the counts of the two parts, n of all
    words of the language. Phrases that stand in a longer one as often as alone
    are left out. Null texts are empty, a null language is ``und``; an empty
    table gives no rows. Other columns are not read; copies count as often as
    they are there.
    """
    levels, totals = transducer(docs, longest, least, text_col, lang_col)
    one = F.array(F.col("f"))
    scratch = Scratch(docs.sparkSession, "phrases")
    below = levels[0].select("state", "lang", F.array("word").alias("words"), one.alias("firsts"), one.alias("rests"))
    found = None
    for k, arcs in enumerate(levels[1:], 2):
        # Composing: counts of all first parts come along the arcs, those of all last parts along the links.
        a = below.select(F.col("state").alias("left"), "lang", F.col("words").alias("lw"), "firsts")
        b = below.select(F.col("state").alias("right"), F.col("words").alias("rw"), "rests")
        grams = arcs.join(a, "left").join(b, "right").select("state", "lang", F.concat("lw", F.slice("rw", -1, 1)).alias("words"), F.concat("firsts", one).alias("firsts"), F.concat("rests", one).alias("rests"), "f")
        grams = scratch.table(grams, f"grams{k}")
        below = grams.drop("f")
        kept = grams
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("state"), F.col("f").alias("more")).groupBy("state").agg(F.max("more").alias("more"))
            kept = grams.join(longer, "state", "left").where("more is null or more < f").drop("more")
        kept = kept.select("lang", "words", "firsts", "rests", F.col("f").alias("a"))
        found = kept if found is None else found.unionByName(kept)
    if found is None:
        raise ValueError("phrases have two words at least")
    big = lambda x: f"cast({x} as decimal(38,0))"
    cut = f"transform(sequence(1, size(words) - 1), k -> struct((1000 * {big('a')} * n) div ({big('firsts[k - 1]')} * rests[size(words) - k - 1]) as score, k, firsts[k - 1] as l, rests[size(words) - k - 1] as r))"
    scored = found.join(totals, "lang").withColumn("cut", F.expr(f"array_min({cut})"))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # A language may hold most phrases: parts of it are ranked first, so one task gets at most PARTS * top rows of it.
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of all documents."""
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = rf"""
WITH cut AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents
),
piece AS (SELECT doc_id, lang, unnest(p) AS t, generate_subscripts(p, 1) AS j FROM cut),
word AS (SELECT doc_id, lang, j, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece)),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
ahead AS (SELECT lang, list(w) OVER (PARTITION BY doc_id, j ORDER BY i ROWS BETWEEN CURRENT ROW AND {LONGEST - 1} FOLLOWING) AS k FROM word),
gram AS (
    SELECT lang, list_slice(k, 1, m) AS k, count(*) AS f FROM (SELECT lang, k, unnest(generate_series(1, len(k))) AS m FROM ahead)
    GROUP BY ALL HAVING count(*) >= {LEAST}
),
parts AS (
    SELECT g.lang, g.k, g.f AS a, c, list_slice(g.k, 1, c) AS kl, list_slice(g.k, c + 1, len(g.k)) AS kr
    FROM (SELECT *, unnest(generate_series(1, len(k) - 1)) AS c FROM gram WHERE len(k) > 1) AS g
),
scored AS (
    SELECT parts.lang, parts.k, a, c, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
    FROM parts JOIN gram x ON x.lang = parts.lang AND x.k = kl JOIN gram y ON y.lang = parts.lang AND y.k = kr JOIN total ON total.lang = parts.lang
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k ORDER BY score, c) = 1),
inner_part AS (
    SELECT DISTINCT lang, list_slice(k, s, s + m - 1) AS k, f
    FROM (SELECT *, unnest(generate_series(1, len(k) - m + 1)) AS s FROM (SELECT *, unnest(generate_series(2, len(k) - 1)) AS m FROM gram WHERE len(k) > 2))
),
kept AS (
    SELECT * FROM worst WHERE NOT EXISTS (SELECT 1 FROM inner_part p WHERE p.lang = worst.lang AND p.k = worst.k AND 100 * p.f >= 100 * worst.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(k, ' ')) AS rank, array_to_string(k, ' ') AS phrase,
    CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= {TOP}
"""
