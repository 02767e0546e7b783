"""Text expressions shared by the operators. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, the no-break space included; Spark's trim() and Java's plain \s know fewer.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def utrim(c: Column) -> Column:
    """Trim any Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return utrim(F.regexp_replace(c, r"(?U)\s+", " "))


def lines_of(c: Column) -> Column:
    """Non-blank lines, trimmed, split at LF or CR LF."""
    return F.filter(F.transform(F.split(c, r"\r?\n", -1), utrim), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Split after . ? ! that white space follows; empty parts are dropped."""
    return F.filter(F.split(c, r"(?<=[.?!])\s+", -1), lambda x: x != "")


def numbers_in(c: Column) -> Column:
    """Figures of a text in order, duplicates kept, thousands commas dropped."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), 0), lambda n: F.replace(n, F.lit(","), F.lit("")))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by blanks; none where there are fewer than n words."""
    return let(
        words,
        lambda ws: F.when(
            F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(ws, i, n)))
        ).otherwise(F.array().cast("array<string>")),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection by size of the union; 0 where both are empty."""
    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda p: let(
            F.size(F.array_union(p["a"], p["b"])),
            lambda n: F.when(n > 0, F.size(F.array_intersect(p["a"], p["b"])) / n).otherwise(F.lit(0.0)),
        ),
    )


def char_trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")

    def of_word(w: Column) -> Column:
        return let(
            F.concat(F.lit("  "), w, F.lit(" ")),
            lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)),
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two texts' trigram sets."""
    return jaccard(char_trigrams(a), char_trigrams(b))
