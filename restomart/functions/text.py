"""Text columns: trimming, casing, edit distance, regular expressions written for JavaScript."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from restomart.fixed_values import EMOJI_RANGES

# Unicode space (all separators plus the byte-order mark) and ASCII word edges.
SPACE = r"\s\p{Z}\x{FEFF}"
WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(text) -> Column:
    """Trim every Unicode space, not just blanks."""
    return F.regexp_replace(col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def lower_trim(text) -> Column:
    return trim_all(F.lower(col(text)))


def collapse_spaces(text) -> Column:
    return F.regexp_replace(col(text), f"[{SPACE}]+", " ")


def words(text) -> Column:
    return F.split(col(text), f"[{SPACE}]+")


def capitalize_words(text, lower_rest: bool = True) -> Column:
    """First letter of each blank-separated word in upper case."""
    def one(word: Column) -> Column:
        rest = F.substr(word, F.lit(2))
        return F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))),
                        F.lower(rest) if lower_rest else rest)
    return F.array_join(F.transform(F.split(col(text), " "), one), " ")


def is_proper_case(text) -> Column:
    """The first character is an upper-case letter."""
    first = F.substr(col(text), F.lit(1), F.lit(1))
    return (F.length(first) > 0) & (F.upper(first) == first) & (F.lower(first) != first)


def normalize_category(text) -> Column:
    ranges = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in EMOJI_RANGES)
    return capitalize_words(collapse_spaces(trim_all(F.regexp_replace(col(text), f"[{ranges}]", ""))))


def normalize_product_name(text) -> Column:
    return collapse_spaces(lower_trim(text))


def header_label(text) -> Column:
    """``total_units`` -> ``Total Units``; letters after the first keep their case."""
    spaced = F.replace(col(text), F.lit("_"), F.lit(" "))
    pieces = F.regexp_extract_all(spaced, F.lit(f"({WORD}+|[^A-Za-z0-9_]+)"), F.lit(1))
    up = lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(pieces, up), "")


def preview(text, size: int = 50) -> Column:
    return F.substr(col(text), F.lit(1), F.lit(size))


def leading_integer(text) -> Column:
    """Whole number at the start of a text ("2.5" -> 2), null if there is none."""
    return F.regexp_extract(col(text), f"^[{SPACE}]*([+-]?\\d+)", 1).try_cast("int")


def edit_distance(a, b, bound: int | None = None, case_sensitive: bool = False,
                  strip_accents: bool = False) -> Column:
    """Edit distance; beyond ``bound`` the result is ``bound + 1``.

    Against an empty text the result is the other length, bounded or not.
    """
    a, b = col(a), col(b)
    if not case_sensitive:
        a, b = F.lower(a), F.lower(b)
    if strip_accents:
        a, b = strip_diacritics(a), strip_diacritics(b)
    if bound is None:
        return F.levenshtein(a, b)
    near = F.levenshtein(a, b, bound)
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return (F.when(empty, F.length(a) + F.length(b))
            .when(near < 0, F.lit(bound + 1)).otherwise(near))


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose into one base letter and combining marks."""
    import unicodedata

    accented, plain = [], []
    for point in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFD", chr(point))
                if not 0x300 <= ord(c) <= 0x36F]
        if len(base) == 1 and base[0] != chr(point):
            accented.append(chr(point))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def strip_diacritics(text) -> Column:
    accented, plain = _accent_table()
    return F.regexp_replace(F.translate(col(text), accented, plain), r"[\x{300}-\x{36F}]", "")


def java_regex(pattern: str, flags: str = "") -> str:
    """A JavaScript pattern as a Java one: Unicode ``\\s``, ASCII ``\\b``, inline flags."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
            i += 2
        elif two == r"\b" and not in_class:
            out.append(EDGE)
            i += 2
        elif two.startswith("\\") and len(two) == 2:
            out.append(two)
            i += 2
        else:
            if two[0] == "[":
                in_class = True
            elif two[0] == "]":
                in_class = False
            out.append(two[0])
            i += 1
    inline = "".join(f for f in flags if f in "ims")
    if "i" in inline:
        inline += "u"
    body = "".join(out)
    return f"(?{inline}){body}" if inline else body


def replace_first(text, regex: str | Column, replacement: str = "") -> Column:
    """Replace the leftmost match only."""
    if isinstance(regex, Column):
        anchored = F.concat(F.lit(r"(?isu)^(.*?)"), regex)
        return F.regexp_replace(col(text), anchored, F.lit(f"$1{replacement}"))
    flags, body = re.match(r"(\(\?[imsu]+\))?(.*)$", regex, re.S).groups()
    inline = "".join(sorted(set((flags or "").strip("(?)") + "s")))
    # A pattern anchored at the start would not match after the lazy prefix.
    prefix = "^()" if body.startswith("^") else "^(.*?)"
    body = body[1:] if body.startswith("^") else body
    return F.regexp_replace(col(text), f"(?{inline}){prefix}(?:{body})", f"$1{replacement}")


def quoted(word: Column) -> Column:
    """A text as a literal regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
