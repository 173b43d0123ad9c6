"""Regex and literal helpers shared by the column builders."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


_CLASS = re.compile(r"\\[bBwWsSdD]")
_WORD_START = re.compile(r"(^|[|(])(\\b)([A-Za-z])(?![?*{])")
# letters that other characters fold to, so a case-blind guard must let those pass too
_FOLDED = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}


def _guarded(pattern: str, blind: bool) -> str:
    """Put a look at the first letter before each word boundary. It changes no match, and spares
    the costly Unicode boundary test at all other positions."""
    def guard(m):
        letter = m[3]
        if blind:
            letter = f"[{letter.lower()}{letter.upper()}{_FOLDED.get(letter.lower(), '')}]"
        return f"{m[1]}(?={letter}){m[2]}{m[3]}"

    return _WORD_START.sub(guard, pattern)


def java(pattern: str, flags: str = "") -> str:
    """Pattern text for the JVM: Unicode word classes, and only newline ends a line. The slower
    Unicode mode is left out where nothing in the pattern depends on it."""
    unicode = "U" if "i" in flags or _CLASS.search(pattern) else ""
    return f"(?{unicode}d{flags}){_guarded(pattern, 'i' in flags)}"


def required_literal(pattern: str) -> str | None:
    """Longest plain word that every match must hold, None when there is no sure one."""
    bare = re.sub(r"\[[^\]]*\][?*+]?|\{[^}]*\}", " ", re.sub(r"\\.[?*]?", " ", pattern))
    while "(" in bare:
        shorter = re.sub(r"\([^()]*\)[?*+]?", " ", bare)
        if shorter == bare:
            return None
        bare = shorter
    if "|" in bare:
        return None
    words = re.findall(r"[A-Za-z]+", re.sub(r"[A-Za-z][?*{]", " ", bare))
    return max(words, key=len, default=None)


def folded(text: Column) -> Column:
    """Case-folded text, for literal tests before case-blind patterns."""
    return F.lower(F.upper(text))


def bind(fields: dict[str, Column], build: Callable[[Column], Column]) -> Column:
    """Work out the fields once and hand them to `build` as a struct, however often it uses them."""
    one = F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.element_at(F.transform(one, build), 1)


def found(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(java(pattern, flags))


def occurrences(text: Column, pattern: str, flags: str = "", needs: str | None = None) -> Column:
    """Number of matches; `needs` is a literal every match holds, tested first as it is cheaper."""
    n = F.regexp_count(text, F.lit(java(pattern, flags)))
    return n if needs is None else F.when(text.contains(needs), n).otherwise(F.lit(0))


def any_word(text: Column, words: Iterable[str]) -> Column:
    """True when a whole word of the list is in the text (words may be small patterns)."""
    return found(text, r"\b(" + "|".join(words) + r")\b")


def any_literal(text: Column, literals: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(x) for x in literals])


def squeeze(text: Column) -> Column:
    """Trim all white space at both ends, line breaks included."""
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")


def ladder(steps: list[tuple[Column, object]], otherwise) -> Column:
    """First condition that holds wins."""
    first, *rest = steps
    chain = F.when(*first)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)
