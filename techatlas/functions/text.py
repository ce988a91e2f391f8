"""Text normalisation, tokens and word n-grams as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters that are decomposed into a letter and marks, and that letter, position by position.

    The combining marks stand last and have no counterpart: ``translate`` drops them, so that composed and decomposed
    spellings are the same. Letters without a decomposition (ø, ł, ß, ı) stay.
    """
    marked, plain = [], []
    for letter in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter == letter.lower():
            marked.append(letter)
            plain.append(base)
    return "".join(marked + [chr(c) for c in range(0x300, 0x370)]), "".join(plain)


ACCENTED, FOLDED = _folds()

#: Words of a title as the term extraction sees them: letters and digits of any script, and hyphens.
WORD_PATTERN = r"[\p{L}\p{N}-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Lower case, accents folded, every run of other characters one blank."""
    low = F.lower(_col(c))
    # texts of one byte a character have nothing to fold, and looking up every character is what costs most
    folded = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, ACCENTED, FOLDED))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column | str) -> Column:
    """Tokens of the normalised text; an empty array for null or blank text."""
    norm = normalize_text(c)
    return F.when(norm != "", F.split(norm, " ")).otherwise(F.array().cast("array<string>"))


def _windows(toks: Column, n: Column | int, render) -> Column:
    """``render(i)`` for the start of every n-token window, none if the text is shorter."""
    size = F.size(toks) - F.lit(n) + 1
    return F.when(size >= 1, F.transform(F.sequence(F.lit(1), size), render)).otherwise(
        F.array().cast("array<string>")
    )


def phrases(toks: Column, lengths: Column) -> Column:
    """All windows whose token count is in ``lengths`` (array<int>), one blank between tokens.

    A window of n tokens grows from the window of n - 1 tokens at the same place.
    """

    def grow(heads: Column, n: Column) -> Column:
        # heads: windows of n - 1 tokens; all but the last have a next token
        more = F.size(heads) - 1
        return F.when(
            more >= 1,
            F.zip_with(
                F.slice(heads, F.lit(1), more),
                F.slice(toks, n, more),
                lambda head, tok: F.concat(head, F.lit(" "), tok),
            ),
        ).otherwise(F.array().cast("array<string>"))

    def of_length(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(2), n), toks, grow)

    return F.flatten(F.transform(lengths, lambda n: F.when(n == 1, toks).otherwise(of_length(n))))


def phrase_heads(toks: Column, shapes: Column) -> Column:
    """First ``chars`` characters of all ``words``-token windows, for prefix search."""
    return F.flatten(
        F.transform(
            shapes,
            lambda s: _windows(
                toks,
                s["words"],
                lambda i: F.substring(F.array_join(F.slice(toks, i, s["words"]), " "), F.lit(1), s["chars"]),
            ),
        )
    )


def title_words(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(WORD_PATTERN), F.lit(0))


def word_ngrams(words: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Word n-grams in their original spelling."""

    def of_size(n: int) -> Column:
        return _windows(words, n, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.flatten(F.array(*[of_size(n) for n in sizes]))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def split_list(c: Column | str) -> Column:
    """Comma separated text to an array of trimmed, non-blank items."""
    return F.filter(
        F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda x: x != ""
    )
