"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelens.constants import EMPTY_TAGS, SENTINELS, SOURCE_MARKS

# A Latin word may carry digits, + and # (python3, c++, c#); a run of Han characters is cut in bigrams.
# Java looks characters below U+0100 up in one table where a class names them one by one; every range costs a call of its own for each
# character of a text, and the calls nest. Hence A-Za-zÀ-ÖØ-öø-ɏ is spelled out up to U+00FF.
_LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isascii() and c.isalpha() or c >= "À" and c not in "×÷")
_DIGITS = "0123456789"
LATIN_WORD = f"[{_LETTERS}Ā-ɏ][{_LETTERS}{_DIGITS}+#Ā-ɏ]*"
WORD_OR_GAP = f"[{_LETTERS}{_DIGITS}+#Ā-ɏ]+|[^{_LETTERS}{_DIGITS}+#Ā-ɏ]+"
# what a cleaned text holds: the table first, and only what lies beyond it meets the ranges
_SYMBOLS = rf"[^[{_LETTERS}{_DIGITS}+#.,;:!?%/\-][Ā-\x{{ffff}}&&[Ā-ɏ\x{{4e00}}-\x{{9fff}}，。；：！？、]]]+"
HAN_RUN = "[一-鿿]+"


# Characters taken off the ends of a text.
WHITE_SPACE = " \t\n\r\f\v\u00a0\u3000"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def sentinel_to_null(col: Column) -> Column:
    """Fold the texts that mean "no value" into NULL."""
    return F.when(strip(col).isin(SENTINELS), None).otherwise(col)


def join_tags(col: Column) -> Column:
    """Array to comma text; a null array gives the empty text."""
    return F.concat_ws(",", F.coalesce(col, F.array().cast("array<string>")))


def tags_or_default(col: Column, default: str = EMPTY_TAGS) -> Column:
    return F.when(F.size(F.coalesce(col, F.array().cast("array<string>"))) == 0, default).otherwise(F.concat_ws(",", col))


def has_description(col: Column, min_len: int = 10) -> Column:
    """True when the stripped text is longer than `min_len` and is not the text 'nan'."""
    text = strip(F.coalesce(col, F.lit("")))
    long_enough = F.length(text) > min_len
    # a text of more than three characters cannot be 'nan'
    return long_enough if min_len >= 3 else long_enough & (F.lower(text) != "nan")


def first_match(col: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern whose match is not blank; NULL when none is."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(col, p, 1)) for p in patterns])


def plain_text(html: Column) -> Column:
    """Drop tags, collapse white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def normalise_source(col: Column) -> Column:
    """Site key by substring; the empty text when no site is named."""
    out = F.lit("")
    for marks, key in reversed(SOURCE_MARKS):
        hit = F.contains(col, F.lit(marks[0]))
        for mark in marks[1:]:
            hit = hit | F.contains(col, F.lit(mark))
        out = F.when(hit, key).otherwise(out)
    return out


def any_term(terms: list[str]) -> str:
    """A pattern that finds any of the terms, ignoring case; terms are taken literally."""
    quoted = ["".join("\\" + ch if ch in r"\.[]{}()*+-?^$|#&~" else ch for ch in t) for t in terms]
    return "(?i)(" + "|".join(quoted) + ")"


def clean_symbols(col: Column) -> Column:
    """Line breaks and symbols to a blank, blanks collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(col, _SYMBOLS, " "))


def word_tokens(col: Column) -> Column:
    """Lower-case Latin words followed by the bigrams of every Han run (a single Han character stays)."""
    words = F.regexp_extract_all(F.lower(col), F.lit(LATIN_WORD), 0)
    runs = F.regexp_extract_all(col, F.lit(HAN_RUN), 0)
    bigrams = F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
                lambda i: F.substring(run, i, F.lit(2)),
            ),
        )
    )
    return F.concat(words, bigrams)
