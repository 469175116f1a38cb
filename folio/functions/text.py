"""Text functions as columns: tokens, sentences, estimates, hashes.

Word characters are Unicode letters, digits and the underscore throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: a column that a lambda uses is computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space (Unicode) collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def plain_words(text: Column) -> Column:
    """The tokens made of a to z alone."""
    return F.array_remove(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]++)(?![\p{L}\p{N}_])|[\p{L}\p{N}_]++"), 1), "")


def parts(text: Column) -> Column:
    """The pieces between white space; none of a blank text."""
    return F.filter(F.split(squeezed(text), " "), lambda w: w != "")


def sentences(text: Column, abbreviations: str, least: int) -> Column:
    """Sentences ended by . ! or ? and white space; those of up to `least` characters are dropped.

    A dot and white space after one of the abbreviations ends no sentence.
    """
    first = "".join(sorted({a[0] for a in abbreviations.split("|")}))  # looked for before the word
    kept = F.regexp_replace(text, rf"(?=[{first}])\b({abbreviations})\.\s", "$1<DOT> ")
    pieces = F.filter(F.transform(F.split(kept, r"[.!?]+\s+"), stripped), lambda s: F.length(s) > least)
    return F.transform(pieces, lambda s: F.replace(s, F.lit("<DOT>"), F.lit(".")))


DETECTOR = r"Dr|Mr|Mrs|Ms|Prof|et al|i\.e|e\.g|vs|etc|Fig|Eq"
FINGERPRINT = r"Dr|Mr|Mrs|Ms|Prof|et al|i\.e|e\.g|vs|etc"


def detector_sentences(text: Column) -> Column:
    """Sentences for scoring a single text."""
    return sentences(text, DETECTOR, 3)


def fingerprint_sentences(text: Column) -> Column:
    """Sentences for the fingerprint of a corpus; figures and equations are no abbreviations."""
    return sentences(text, FINGERPRINT, 5)


def clauses(text: Column) -> Column:
    """Pieces between runs of . ! and ?, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), stripped), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    """Whole part of the mean of 1.3 a word and a quarter a character."""
    return ((F.size(parts(text)) * F.lit(1.3) + F.length(text) / F.lit(4.0)) / F.lit(2.0)).cast("int")


def stream_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 of the empty text."""
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4))).cast("int")


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def count_of(text: Column, pattern: str) -> Column:
    """Matches of a pattern; null of a null text."""
    return F.regexp_count(text, F.lit(pattern))


def count_with(text: Column, lower: Column, part: str, pattern: str) -> Column:
    """As `count_of`, looking for the pattern only where the lower-case text holds `part`, which all its matches do."""
    return F.when(~F.contains(lower, F.lit(part)), 0).otherwise(count_of(text, pattern))


def ngrams(words: Column, n: int) -> Column:
    """All runs of `n` words joined by blanks; none of fewer words.

    Elements are read one by one: `slice` copies the whole array at every call.
    """
    size = F.size(words)
    run = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n)))
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), run)).otherwise(F.array().cast("array<string>"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
