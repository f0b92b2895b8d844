"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Built from SQL functions alone, so texts never leave the JVM. Spark's
``regexp_extract_all`` gives matches without their places; splitting the text
at the same pattern gives the pieces between them, and the running sum of the
lengths of pieces and matches is each match's start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuskit.llm._text import read

# Each run of characters is taken whole (possessive) and only from its first
# character (look-behind, or \G right after the last match): the same leftmost
# matches as the plain pattern, without its quadratic retries on long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SHORT_CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,14}(?![0-9A-Za-z])"


@dataclass(frozen=True)
class Kind:
    """One sort of span. ``near`` are words within WINDOW characters before it; a span scores
    ``base`` alone and ``near_score`` beside such a word, and counts from KEEP_SCORE up."""

    name: str
    pattern: str
    hint: str
    near: str
    base: float
    near_score: float


#: Characters before a span in which context words count, and the least score of a reported span.
WINDOW, KEEP_SCORE = 40, 0.5
#: The first four are always reported when confirmed; the others need their checksum and, where base is low, context.
KINDS = (
    Kind("email", EMAIL, "@", r"(?i)\b(e-?mail|mailto|contact|write)\b", 0.9, 1.0),
    Kind("ip", IP, r"[0-9]\.[0-9]", r"(?i)\b(ip|host|address|server)\b", 0.6, 0.9),
    Kind("card", CARD, "[0-9](?:[ -]?[0-9]){15}", r"(?i)\b(card|visa|credit|payment)\b", 0.8, 1.0),
    Kind("phone", PHONE, r"\+[0-9]", r"(?i)\b(phone|tel|call|mobile|fax)\b", 0.7, 1.0),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", r"(?i)\b(iban|account|bank)\b", 0.9, 1.0),
    Kind("short_card", SHORT_CARD, "[0-9](?:[ -]?[0-9]){12}", r"(?i)\b(card|amex|credit|payment)\b", 0.3, 0.8),
)
BASE = ("email", "ip", "card", "phone")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i))
    return (n > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves remainder 1: letters count 10 to 35, head moved to the end."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c) - F.when(c.between("A", "Z"), F.lit(55)).otherwise(F.lit(48))
        return F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _confirm(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    digits = _digits(m)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "short_card":
        return F.when(F.length(digits).between(13, 15), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _confirmed(kind: str, m: Column) -> Column:
    """What a check confirms of a match, or null: an IBAN may end at any of the match's blanks, the longest is taken.

    The rest of such a match, further capitals and digits, is not searched again.
    """
    if kind != "iban":
        return F.when(_confirm(kind, m), m)
    words = F.split(m, " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    return F.try_element_at(F.filter(ends, lambda e: _confirm(kind, e)), F.lit(-1))


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


#: Matches of one text that are walked at a time, so that a text of many takes linear time: arrays grow by copying.
BLOCK = 256


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` and the lambdas in it name it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _blocks(items: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` entries; of an empty one a single empty block."""

    def cut(x: Column) -> Column:
        last = F.greatest(F.floor((F.size(x) - 1) / BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))

    return _once(items, cut)


def _likely(text: Column, k: Kind) -> Column:
    return F.contains(text, F.lit(k.hint)) if k.name == "email" else text.rlike(k.hint)


def _matches(text: Column, k: Kind) -> Column:
    """Blocks of pieces and the matches after them, each block with its length and its last characters; null if there are none."""
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    pairs = _once(found, lambda f: F.arrays_zip(F.slice(F.split(text, k.pattern, -1), F.lit(1), F.size(f)).alias("0"), f.alias("1")))

    def told(block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda a, x: a + F.length(x["0"]) + F.length(x["1"]))
        whole = F.array_join(F.transform(block, lambda x: F.concat(x["0"], x["1"])), "")
        return F.struct(block.alias("items"), size.alias("size"), F.right(whole, F.lit(WINDOW)).alias("tail"))

    return F.when(_likely(text, k), F.transform(_blocks(pairs), told))


def _spans(blocks: Column, k: Kind) -> Column:
    """The confirmed spans of one kind as structs, in order of their starts."""

    def walk(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        told = _confirmed(k.name, x["1"])
        span = F.struct(start.alias("start"), (start + F.length(told)).alias("end"), F.right(F.concat(acc["tail"], x["0"]), F.lit(WINDOW)).alias("before"))
        tail = F.right(F.concat(acc["tail"], x["0"], x["1"]), F.lit(WINDOW))
        return F.struct((start + F.length(x["1"])).alias("at"), tail.alias("tail"), F.when(told.isNotNull(), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,before:string>>")
    # Where each block begins and what stands before it; a full block is longer than WINDOW.
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<at:int,tail:string>>").alias("out"))
    ahead = F.aggregate(blocks, first, lambda a, t: F.struct((a["at"] + t["size"]).alias("at"), t["tail"].alias("tail"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), a["tail"].alias("tail")))).alias("out")))["out"]
    walked = F.flatten(F.zip_with(blocks, ahead, lambda t, c: F.aggregate(t["items"], F.struct(c["at"].alias("at"), c["tail"].alias("tail"), none.alias("out")), walk)["out"]))
    scored = F.transform(walked, lambda s: F.struct(F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.when(s["before"].rlike(k.near), F.lit(k.near_score)).otherwise(F.lit(k.base)).alias("score")))
    kept = scored if k.name in BASE else F.filter(scored, lambda s: s["score"] >= KEEP_SCORE)
    return F.coalesce(F.when(blocks.isNotNull(), kept.cast(SPAN)), F.array().cast(SPAN))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds one array of ``(kind, start, end, score)`` for each kind of KINDS, in code points.

    Columns are named ``pii_<kind>`` (a column of that name is replaced). Null
    and empty texts have empty arrays. Spans of one kind don't overlap; spans
    of different kinds may. A text of many matches takes time in proportion.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    met = docs.withColumns({f"_pii_{k.name}_blocks": _matches(text, k) for k in KINDS})
    return met.withColumns({f"pii_{k.name}": _spans(F.col(f"_pii_{k.name}_blocks"), k) for k in KINDS}).drop(*(f"_pii_{k.name}_blocks" for k in KINDS))


def _join(names: tuple[str, ...]) -> Column:
    every = F.concat(*(F.col(f"pii_{n}") for n in names))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by ``<KIND>``; overlapping spans become one, named by the first.

    Null texts stay null. Other columns are unchanged.
    """
    columns = docs.columns
    found = find_pii(docs, text_col)
    text = F.col(text_col)
    spans = F.array_sort(F.transform(F.concat(*(F.col(f"pii_{k.name}") for k in KINDS)), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("least"), s["kind"].alias("kind"), s["end"].alias("end"))))
    top = lambda block: F.coalesce(F.array_max(F.transform(block, lambda s: s["end"])), F.lit(0))
    found = found.withColumn("_pii_spans", F.transform(_blocks(spans), lambda block: F.struct(block.alias("items"), top(block).alias("top"))))
    blocks = F.col("_pii_spans")

    def step(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    none = F.array().cast("array<struct<from:int,to:int,kind:string>>").alias("out")
    ahead = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, t: F.struct(F.greatest(a["at"], t["top"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    pieces = F.flatten(F.zip_with(blocks, ahead, lambda t, at: F.aggregate(t["items"], F.struct(at.alias("at"), none), step)["out"]))
    found = found.withColumn("_pii_pieces", _blocks(pieces))

    def written(block: Column) -> Column:
        """Its pieces out of the part of the text that holds them all, which is cut out once."""
        low, high = F.try_element_at(block, F.lit(1))["from"], F.try_element_at(block, F.lit(-1))["to"]
        part = F.array(F.substring(text, low + 1, high - low))
        joined = lambda whole: F.array_join(F.transform(block, lambda p: F.concat(F.substring(whole, p["from"] - low + 1, p["to"] - p["from"]), F.lit("<"), F.upper(p["kind"]), F.lit(">"))), "")
        return F.element_at(F.transform(part, joined), 1)

    end = F.coalesce(F.array_max(F.transform(blocks, lambda t: t["top"])), F.lit(0))
    done = F.concat(F.array_join(F.transform("_pii_pieces", written), ""), F.substring(text, end + 1, F.length(text)))
    return found.withColumn(text_col, F.when(end > 0, done).otherwise(text)).select(*columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and spans of the base kinds, all spans, and the score of each."""
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [F.size(f"pii_{n}").cast("long").alias(f"n_{n}") for n in BASE]
    return found.select("doc_id", *counts, F.sha2(_join(BASE), 256).alias("base_sha256"), _join(tuple(k.name for k in KINDS)).alias("spans"), F.array_join(F.transform(F.concat(*(F.col(f"pii_{k.name}.score") for k in KINDS)), lambda s: s.cast("string")), ",").alias("scores"))
