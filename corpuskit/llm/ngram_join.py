"""Set-similarity join on word shingles that skips by set relations.

1. Texts become sets of shingle hashes; equal sets are one class.
2. *Families.* Sets whose sketches mostly agree with that of the smallest set
   that shares a minimum form families, linked or not. A family only says where
   a pair is compared, never whether it links.
3. *Inside a family* every set is checked against the leader. Sets that link
   with it share its component, so no two of them are compared. The others meet
   the rest of the family in blocks of bounded size inside tasks, where answers
   are derived from the leader's: only the differences from it travel and are
   multiplied, as |X ^ Y| = |X ^ L| + |Y ^ L| - 2 |(X ^ L) & (Y ^ L)|. A task
   emits a spanning forest of the links it finds.
4. *Across families* a prefix index finds the pairs. A set's prefix (the
   shingles of which a partner must hold one) is its least shingles in a global
   order that puts widely shared ones last. The list of a shingle is cut into
   blocks by set size and position. A list whose sets all lie in one family is
   skipped; of a mixed list only the sets outside its largest family probe, and
   only blocks whose size and position allow enough overlap.
5. These candidates are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuskit.llm._text import gram_hashes, hash_words, list_array, mix, read, slices, small_batches, texts, tidy, words
from corpuskit.operators.components import connected_components
from corpuskit.plans.scratch import Scratch

#: Minima of a sketch, and how far apart the ones lie that bring sets together.
BINS, SEAT_STEP = 32, 4
#: Share of equal minima from which two sets are of one family.
ALIKE = 0.4
#: Sets and shingles that one block of a family holds on average.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 500_000
#: Entries up to which a list is not cut into blocks.
SHORT_LIST = 128
#: Columns of one product of differences.
COLUMNS = 4096
#: Most shingles that are put last in the order; only the order depends on it, never the result.
LAST_SHINGLES = 200_000
#: Texts of one slice in which a shingle must occur to count as shared by many.
SHARED_BY = 4
#: Rows up to which a table of ids or keys is broadcast (24 bytes each); beyond it is a shuffled join.
BROADCAST_KEYS = 1_000_000
#: Bytes of text that a task holds as sets at a time.
SLICE = 3_000_000


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``n``-word shingles; fewer words are one shingle."""
    code, offsets, vocab = words(column)
    hashed = hash_words(vocab)[code] if len(code) else np.empty(0, np.uint64)
    grams = gram_hashes(hashed, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            h = np.sort(grams[a : b - n + 1])
            out.append(h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:
            out.append(gram_hashes(hashed[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
    return list_array(flat, np.cumsum([0, *map(len, sets)]), pa.int64())


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: two sums of differently mixed members."""
    with np.errstate(over="ignore"):
        a, b = mix(h).sum(dtype=np.uint64), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(59)


def _sketch(h: np.ndarray) -> np.ndarray:
    """The least of the mixed members in each of ``BINS`` ranges, as 31 bits; 0 for an empty range."""
    m = np.sort(mix(h ^ np.uint64(0xD1342543DE82EF95)))
    at = np.searchsorted(m, _EDGES)
    found = np.append(m, np.uint64(0))[at]
    full = np.diff(np.append(at, len(m))) > 0
    return np.where(full, (found >> np.uint64(28)) & np.uint64(0x7FFFFFFF), 0).astype(np.int32)


def _map_sets(docs: DataFrame, fn, schema: str, n: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``fn(batch, sets)`` on slices; it gives the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            yield from fn(batch, shingle_sets(texts(batch), n))

    return docs.select("id", "text", *carry).mapInArrow(tidy(run), schema)


def summarise(docs: DataFrame, n: int) -> DataFrame:
    """One row per text with size, digest and sketch, and rows with shingles that many texts of a slice share."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int32())), ("shingle", pa.int64()), ("df", pa.int64())])

    def fn(batch: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        digests = np.array([_digest(h) for h in sets], np.int64).reshape(-1, 2)
        sketches = list_array(np.concatenate([_sketch(h) for h in sets]), np.arange(len(sets) + 1) * BINS, pa.int32())
        none = pa.nulls(len(sets), pa.int64())
        columns = [batch.column("id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), sketches, none, none]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
        found, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count >= SHARED_BY
        empty = [pa.nulls(int(often.sum()), f.type) for f in list(schema)[:5]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(found[often].view(np.int64)), pa.array(count[often].astype(np.int64))], schema=schema)

    return _map_sets(docs, fn, "id long, n long, d1 long, d2 long, sketch array<int>, shingle long, df long", n)


def _put_last(summary: DataFrame, scratch: Scratch) -> np.ndarray:
    """The most shared shingles, sorted: all above the least power of two that leaves at most ``LAST_SHINGLES``."""
    shared = summary.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df"))
    shared = scratch.table(shared.withColumn("power", F.floor(F.log2("df"))), "shared")
    least, held = 64, 0
    for power, rows in sorted(((x["power"], x["rows"]) for x in shared.groupBy("power").agg(F.count("*").alias("rows")).collect()), reverse=True):  # at most 64 rows
        held += rows
        if held > LAST_SHINGLES:
            break
        least = power
    found = shared.where(F.col("power") >= least).select("shingle").toArrow()["shingle"]  # at most LAST_SHINGLES rows
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def index_sets(docs: DataFrame, n: int, num: int, den: int, last: np.ndarray) -> DataFrame:
    """``(id, n, family, prefix, shingles)``: a set's prefix in the global order, and the whole set if it has a family."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("family", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def prefix(h: np.ndarray) -> np.ndarray:
        size = len(h) - -(-num * len(h) // den) + 1 if len(h) else 0
        if len(last):
            shared = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
            h = np.concatenate([h[~shared][:size], h[shared]])
        return h[:size]

    def fn(batch: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        family = batch.column("family")
        whole = [h if f else h[:0] for h, f in zip(sets, family.is_valid().to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), family, _lists([prefix(h) for h in sets]), _lists(whole)], schema=schema)

    return _map_sets(docs, fn, "id long, n long, family long, prefix array<long>, shingles array<long>", n, ("n", "family"))


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """``(id, shingles)``"""

    def fn(batch: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(sets), 500):
            part = sets[a : a + 500]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, len(part)), _lists(part)], names=["id", "shingles"])

    return _map_sets(docs, fn, "id long, shingles array<long>", n)


def _bounded(keys: DataFrame) -> DataFrame:
    """A written key table as a broadcast side while it is small; a shuffled side otherwise."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _linked(num: int, den: int) -> Column:
    return F.expr(f"{den} * inter >= {num} * (na + nb - inter)")


def families(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, family)`` of the sets that have a family; it is named by its smallest id."""
    seats = reps.select("id", F.posexplode(F.expr(f"transform(sequence(0, {BINS - 1}, {SEAT_STEP}), i -> sketch[i])")).alias("k", "m")).where("m <> 0")
    chief = seats.groupBy("k", "m").agg(F.min("id").alias("chief"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = scratch.table(seats.join(chief, ["k", "m"]).where("id <> chief").select("id", "chief").distinct(), "stars")
    side = reps.select(F.col("id").alias("chief"), F.col("sketch").alias("other"))
    both = stars.join(reps.select("id", "sketch"), "id").join(side, "chief")
    agree = "size(filter(arrays_zip(sketch, other), x -> x.sketch = x.other and x.sketch <> 0))"
    held = "size(filter(arrays_zip(sketch, other), x -> x.sketch <> 0 or x.other <> 0))"
    edges = both.where(f"{agree} >= {ALIKE} * {held}").select("id", "chief")
    found = connected_components(edges, "id", "chief")
    return scratch.table(found.select(F.col("node").alias("id"), F.col("component").alias("family")), "families")


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left, ends = np.ones(len(link), bool), ([], [])
    for root in np.flatnonzero(link.any(axis=1)):
        front, left[root] = ([root] if left[root] else []), False
        while len(front):
            x = front.pop()
            new = np.flatnonzero(link[x] & left)
            left[new] = False
            ends[0].append(np.full(len(new), x))
            ends[1].append(new)
            front.extend(new.tolist())
    return tuple(np.concatenate(e) if e else np.empty(0, np.int64) for e in ends)


def differences(flat: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The size of the symmetric difference of every two sets; ``flat[i]`` is a member of set ``row[i]``.

    The sets may be themselves differences from one leader: what they differ in is the same.
    """
    column, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    used = np.cumsum(count > 1) - 1  # a member of one set alone takes no column
    keep = count[column] > 1
    row, at = row[keep], used[column[keep]]
    order = np.argsort(at, kind="stable")
    row, at, wide = row[order], at[order], int((count > 1).sum())
    common = np.zeros((len(size), len(size)), np.float32)
    for a in range(0, wide, COLUMNS):
        part = slice(*np.searchsorted(at, [a, a + COLUMNS]))
        block = np.zeros((len(size), min(COLUMNS, wide - a)), np.float32)
        block[row[part], at[part] - a] = 1
        common += block @ block.T
    return size[:, None] + size[None, :] - 2 * common


def _compare(num: int, den: int):
    """A spanning forest of the links that the sets of two blocks have."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, size = table["id"].to_numpy(), table["n"].to_numpy()
        lists = table["differs"].chunk(0)
        away = np.diff(lists.offsets.to_numpy())
        differ = differences(lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), away), away)
        both = size[:, None] + size[None, :]
        inter = (both - differ) / 2
        link = den * inter >= num * (both - inter)
        a, b = _forest(link)
        return pa.Table.from_arrays([pa.array(ids[a]), pa.array(ids[b])], schema=schema)

    return run


def inside_families(held: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``: links that connect whatever links connect inside the families of ``held``."""
    head = held.where("id = family").select("family", F.col("n").alias("nb"), F.col("shingles").alias("leader"))
    known = held.join(head, "family").withColumnRenamed("n", "na").withColumn("more", F.array_except("shingles", "leader"))
    known = known.withColumn("inter", F.col("na") - F.size("more")).withColumn("differs", F.concat("more", F.array_except("leader", "shingles")))
    cls = F.floor(F.log(F.col("na").cast("double")) / float(np.log(den / num)))
    known = scratch.table(known.select("id", "family", F.col("na").alias("n"), _linked(num, den).alias("settled"), cls.alias("cls"), "differs"), "known")

    # Blocks of like size; partners' sizes differ by a factor den / num at most, so they lie in the same or a next class.
    # A family that fits into one block is one.
    sizes = [F.count("*").alias("c"), F.sum(F.size("differs")).alias("s")]
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES, F.lit(1)))
    parts = known.groupBy("family", "cls", "settled").agg(*sizes).withColumn("m", blocks)
    plan = parts.groupBy("family").agg(F.collect_list(F.struct("cls", "settled", "m")).alias("g"), F.max(~F.col("settled")).alias("open"), F.sum("c").alias("c"), F.sum("s").alias("s"))  # g: one entry per size class
    plan = plan.where("open").select("family", "g", (blocks == 1).alias("one"))
    name = lambda x, b: f"{x}cls * {1 << 40} + if({x}settled, {1 << 39}, 0) + {b}"
    own = "filter(g, x -> x.cls = cls and x.settled = settled)[0].m"
    meets = f"flatten(transform(filter(g, x -> abs(x.cls - cls) <= 1 and not (x.settled and settled)), x -> transform(sequence(0L, x.m - 1), b -> {name('x.', 'b')})))"
    rows = known.join(plan, "family").withColumn("u", F.expr(f"if(one, 0L, {name('', f'pmod(xxhash64(id), {own})')})"))
    rows = rows.withColumn("v", F.explode(F.expr(f"if(one, array(0L), {meets})")))
    rows = rows.select("family", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "id", "n", "differs")
    pairs = rows.groupBy("family", "lo", "hi").applyInArrow(_compare(num, den), "a long, b long")
    return known.where("settled and id <> family").select(F.col("id").alias("a"), F.col("family").alias("b")).union(pairs)


def across_families(indexed: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``(a, na, b, nb)``: pairs of different families that may link."""
    family = F.coalesce("family", "id")
    entries = indexed.select("id", "n", family.alias("family"), F.size("prefix").alias("len"), F.posexplode("prefix").alias("pos", "shingle"))
    mixed = entries.groupBy("shingle").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi").select("shingle")
    lists = scratch.table(entries.join(_bounded(scratch.table(mixed, "mixed")), "shingle"), "lists")
    major = lists.groupBy("shingle", "family").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "family")).alias("x"), F.sum("c").alias("entries"))
    lists = lists.join(major.select("shingle", F.col("x.family").alias("major"), (F.col("entries") <= SHORT_LIST).alias("short")), "shingle")
    lists = scratch.table(lists.withColumn("light", F.col("family") != F.col("major")).drop("major"), "marked")
    scratch.drop("lists")

    # Blocks by size and position. How far partners' positions may lie apart follows from the overlap that sizes in the
    # block need.
    width, share = float(np.log(den / num)), num / (num + den)
    block = F.floor(F.log(F.col("n").cast("double")) / width)
    step = f"greatest(1D, ceil(exp((block + 1) * {width}) * {1 - num / den} / 2))"
    small, large = f"greatest(exp(block * {width}) - 1, na * {num / den}D - 1)", f"least(exp((block + 1) * {width}) + 1, na * {den / num}D + 1)"
    before, after = f"na - {share} * (na + {small}) + 1", f"{large} - {share} * (na + {large}) + 1"
    reach = f"sequence(cast(floor(greatest(0D, pa - ({before})) / {step}) as long), cast(floor(greatest(0D, pa + ({after})) / {step}) as long))"
    ends = lambda s: [F.col(c).alias(f"{x}{s}") for c, x in (("id", ""), ("n", "n"), ("pos", "p"), ("family", "f"), ("len", "k"))]
    probe = lists.where("light").select("shingle", "short", *ends("a"), F.explode(F.when(F.col("short"), F.array(F.lit(0).cast("long"))).otherwise(F.array(block - 1, block, block + 1))).alias("block"))
    probe = probe.where(f"short or {small} <= {large}").withColumn("at", F.explode(F.expr(f"if(short, array(0L), {reach})"))).drop("short")
    held = lists.select("shingle", "short", *ends("b"), F.col("light").alias("lb"), F.when(F.col("short"), 0).otherwise(block).alias("block"))
    held = held.withColumn("at", F.expr(f"if(short, 0L, cast(floor(pb / {step}) as long))")).drop("short")
    upper = "least(pa, pb) + 1 + least(na - pa - 1, nb - pb - 1)"
    fits = f"fa <> fb and (not lb or a < b) and ({num + den}) * ({upper}) >= {num} * (na + nb) and least(na, nb) * {den} >= greatest(na, nb) * {num}"
    hits = probe.join(held, ["shingle", "block", "at"]).where(fits)
    first = F.col("a") < F.col("b")
    ordered = [F.when(first if c == "a" else ~first, F.col(f"{x}a")).otherwise(F.col(f"{x}b")).alias(f"{x}{c}") for c in "ab" for x in ("n", "k")]
    hits = hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *ordered)
    # All that the sets share beyond their common prefix lies behind the prefix that ends first.
    enough = f"({num + den}) * (c + greatest(na - ka, nb - kb)) >= {num} * (na + nb)"
    return hits.groupBy("a", "b", "na", "nb", "ka", "kb").agg(F.count("*").alias("c")).where(enough).select("a", "na", "b", "nb")


def verify(docs: DataFrame, pairs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``(a, na, b, nb)`` pairs of ids and sizes with the size of their intersection as ``inter``."""
    wanted = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    with small_batches(docs.sparkSession):
        held = scratch.table(whole_sets(docs.join(_bounded(wanted), "id", "left_semi"), n), "wanted-sets")
    left = pairs.join(held.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(held.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "na", "b", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("inter"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id)`` of every row.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
    Two rows link when ``den * intersection >= num * union`` of their sets of
    ``n``-word shingles (fewer words are one shingle); ``component_id`` is the
    smallest id reachable by links. Null, empty and blank texts have no
    shingles and link with nothing. Ids are unique longs; a row with a null id
    stays, links with nothing and has a null component. Repeated rows stay and
    share a component; equal texts are linked through their class; other
    columns are not read; an empty table gives no rows. All decisions cover all
    rows: nothing is sampled or capped. Shingles are compared by 64-bit hashes
    and whole sets by 128 bits, so results are exact up to their collisions.
    """
    scratch = Scratch(docs.sparkSession, "ngram_join")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    with small_batches(docs.sparkSession):
        summary = scratch.table(summarise(docs, n), "summary")
    sets = summary.where("shingle is null").select("id", "n", "d1", "d2", "sketch")
    last = _put_last(summary, scratch)

    key = ["n", "d1", "d2"]
    reps = sets.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch"))
    reps = scratch.table(reps, "classes")
    member = sets.join(reps.select(*key, "rep"), key).where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    least = next(k for k in range(1, 10 * den) if den * k >= num * (k + 1)) + 1 if num < den else None  # below this size only equal sets can link
    able = reps.where(F.col("n") >= least - 1) if least else reps.limit(0)
    able = able.select(F.col("rep").alias("id"), "n", "sketch")

    chosen = scratch.table(able.select("id", "n").join(families(able, scratch), "id", "left"), "chosen")
    with small_batches(docs.sparkSession):
        indexed = scratch.table(index_sets(docs.join(_bounded(chosen), "id"), n, num, den, last), "indexed")
    near = scratch.table(inside_families(indexed.where("family is not null").select("id", "n", "family", "shingles"), num, den, scratch), "near")
    pairs = scratch.table(across_families(indexed.drop("shingles"), num, den, scratch), "pairs")
    far = scratch.table(verify(docs, pairs, n, scratch).where(_linked(num, den)).select("a", "b"), "far")

    final = connected_components(member.union(near).union(far))
    found = sets.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a Jaccard similarity of 0.85."""
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85, den=100)
