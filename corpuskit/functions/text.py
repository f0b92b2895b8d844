"""Column functions over queries, names and paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from corpuskit.functions import constants as K


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


@F.pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normal form C, which Spark has no expression for."""
    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_query(c: Column, to_nfc: bool = True) -> Column:
    """Lower case, normal form C, collapsed white space. ``to_nfc=False`` stays in the JVM, for text known to be NFC."""
    return collapse(F.lower(nfc(c) if to_nfc else c))


def tokenise(c: Column) -> Column:
    """Tokens between white space and punctuation, hyphens inside words kept."""
    parts = F.split(c, r"""(?U)[\s,;:!?()\[\]{}<>"']+""")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, r"^-+|-+$", "")), lambda t: t != "")


def remove_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(K.STOP_WORDS))


def detect_intent(tokens: Column) -> Column:
    has = lambda words: F.arrays_overlap(tokens, _words(words))
    return F.when(has(K.COMPARISON_WORDS), "comparison").when(has(K.FACTUAL_WORDS), "factual").when(has(K.NAVIGATIONAL_WORDS), "navigational").otherwise("exploratory")


def looks_like_typo(t: Column) -> Column:
    """Three equal characters in a row, or a short token of mostly consonants."""
    consonants = F.length(F.regexp_replace(t, r"[^\p{L}]|[aeiou]", ""))
    return t.rlike(r"(.)\1{2,}") | (F.length(t).between(3, 6) & (consonants / F.length(t) > 0.7))


def has_typo_candidate(tokens: Column) -> Column:
    return F.exists(tokens, looks_like_typo)


def static_expansions(tokens: Column) -> Column:
    """New terms for known abbreviations, in order and without repeats or tokens that are there already."""
    table = F.create_map(*(x for k, v in K.EXPANSIONS.items() for x in (F.lit(k), _words(v))))
    every = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.filter(F.array_distinct(every), lambda e: ~F.array_contains(tokens, e))


def is_small_talk(c: Column, least_words: int = 3) -> Column:
    """Greetings and questions too short to search for."""
    return c.rlike(K.SMALL_TALK) | (F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) < least_words)


def canonical_name(c: Column) -> Column:
    """Normal form C in lower case without non-word characters at the ends, white space collapsed."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfc(c), r"(?U)^[\s\W]+|[\s\W]+$", ""), r"(?U)\s+", " "))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def filename_words(path: Column) -> Column:
    """Words of a file or folder name, in order: over two characters, no digits alone, no stop word."""
    words = F.split(F.lower(F.regexp_replace(stem(path), r"(?U)[_\-.\s]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(K.FILENAME_STOP_WORDS) & ~w.rlike(r"^\d+$"))


def filename_bigrams(path: Column) -> Column:
    words = filename_words(path)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def expand_term(term: Column) -> Column:
    """A term and, for one of several words, its words of over two characters."""
    words = F.split(F.lower(F.regexp_replace(term, r"(?U)[-\s]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(K.FILENAME_STOP_WORDS) & ~w.rlike(r"^\d+$"))
    return F.when(term.rlike("[ -]"), F.array_distinct(F.concat(F.array(term), kept))).otherwise(F.array(term))


def ancestors(path: Column, itself: bool = False) -> Column:
    """All folders above a path, nearest root first: an equi-join key where others compare prefixes."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if itself else 1)
    upto = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(upto, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def sanitize_name(c: Column, longest: int = 60) -> Column:
    """A folder name without forbidden characters, cut before the word that passes the limit."""
    clean = collapse(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', ""))
    cut = F.substring(clean, 1, longest)
    at_word = F.regexp_extract(cut, r"^(.+) [^ ]*$", 1)
    return F.trim(F.when(F.length(clean) <= longest, clean).when(at_word != "", at_word).otherwise(cut))


def deterministic_name(terms: Column) -> Column:
    """A folder name made of terms, in title case."""
    titled = F.transform(terms, lambda t: F.initcap(collapse(F.translate(t, "_-", "  "))))
    name = sanitize_name(F.array_join(F.filter(titled, lambda t: t != ""), " "))
    return F.when(F.coalesce(name, F.lit("")) == "", "New Folder").otherwise(name)


def bigrams(token: Column) -> Column:
    """Character bigrams of a token; a single character is its own."""
    n = F.length(token)
    upto = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n < 2, F.array(token)).otherwise(F.transform(upto, lambda i: F.substring(token, i, F.lit(2))))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))


def uuid5(name: Column, namespace: str = "6ba7b8129dad11d180b400c04fd430c8") -> Column:
    """The version 5 UUID of a name; the default name space is that of object identifiers."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.create_map(*(F.lit(x) for i in range(16) for x in ("%x" % i, "89ab"[i % 4]))), F.substring(h, 17, 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
