"""Text expressions: all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without outer whitespace of any kind."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


#: Whitespace as Unicode has it, each turned into a space before a split on the single character, which needs no regular expression.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def tokens(c: str | Column) -> Column:
    """Lower-case words between whitespace; none for null."""
    x = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), _SPACES, " " * len(_SPACES))
    return F.array_remove(F.split(x, " "), "")


def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """Characters by the ASCII that their compatibility decomposition leaves: one to one, and one to many."""
    one, to, many = [], [], {}
    for lo, hi in ((0x80, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2070), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)):
        for i in range(lo, hi):
            left = unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()
            if len(left) == 1:
                one.append(chr(i)), to.append(left)
            elif left:
                many[chr(i)] = left
    return "".join(one), "".join(to), many


_ONE, _TO, _MANY = _ascii_forms()


def normalised(c: str | Column) -> Column:
    """Accents folded to ASCII, lower case, only letters and digits, single spaces."""
    x = col(c)
    for sign, left in _MANY.items():
        x = F.replace(x, F.lit(sign), F.lit(left))
    x = F.regexp_replace(F.translate(x, _ONE, _TO), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " "), r"\s+", " "))


def last_index(c: Column, needle: str) -> Column:
    """0-based place of the last occurrence, -1 for none."""
    at = F.locate(needle[::-1], F.reverse(c))
    return F.when(at == 0, -1).otherwise(F.length(c) - len(needle) + 1 - at)


def excerpt(c: str | Column, most: int = 200) -> Column:
    """At most `most` characters, cut after a sentence in the second half, else at a word with dots."""
    x = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    head = F.substring(x, 1, most)
    stop, space = last_index(head, ". "), last_index(head, " ")
    cut = F.when(stop > most // 2, F.substring(head, F.lit(1), stop + 1)).when(space > 0, F.concat(F.substring(head, F.lit(1), space), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(x) <= most, x).otherwise(cut)


def has_word(words: Column, among: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, among)))


def contains_any(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def count_words(c: str | Column, words: list[str]) -> Column:
    """How many of `words` occur between spaces."""
    low = F.concat(F.lit(" "), F.lower(col(c)), F.lit(" "))
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(F.concat(F.lit(" "), w, F.lit(" ")))))
