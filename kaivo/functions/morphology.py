"""Compound analysis: word-base strings into morphs, and morphs into index lexemes.

A word-base string lists a word's morphs as ``+surface(base)``; the plus and the base may be missing, and several bases may
follow one surface. A morph with a base is a WORD, with a base that begins with + an AFFIX, without one BOUND. An equals sign in
a base marks a seam inside it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MORPH = re.compile(r"([^+(]*)(?:\(([^)]*)\))?")


class UnreadableMorphs(ValueError):
    """A word-base string outside the grammar; guessing would put junk into the index."""


def morphs(bases: str) -> list[tuple[str, str | None]]:
    """(surface, base or None) of each morph."""
    rest = bases
    found = []
    while rest := rest.lstrip("+"):
        m = _MORPH.match(rest)
        if not m.end():
            raise UnreadableMorphs(bases)
        found.append((m[1], m[2]))
        rest = rest[m.end() :]
    if not found or any(not surface and base is None for surface, base in found):
        raise UnreadableMorphs(bases)
    return found


def _word(m: tuple[str, str | None]) -> bool:
    return m[1] is not None and not m[1].startswith("+")


def plain(lexeme: str) -> str:
    return lexeme.replace("=", "").lower()


def distinct(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def safe(bases: str) -> list[str]:
    """Parts of a compound of words only, else none."""
    found = morphs(bases)
    return [plain(base) for _, base in found] if all(map(_word, found)) else []


def reassembled(bases: str) -> list[str]:
    """Parts with affixes and bound morphs folded into the word before them; bound morphs at the start go with the first word."""
    groups: list[list] = []
    for m in morphs(bases):
        opens = _word(m) and (not groups or any(map(_word, groups[-1])))
        if opens or not groups:
            groups.append([m])
        else:
            groups[-1].append(m)
    out: list[str] = []
    for group in groups:
        if len(group) == 1 and _word(group[0]):
            out += [plain(group[0][1]), *map(plain, group[0][1].split("="))]
        else:
            out.append(plain("".join(surface for surface, _ in group)))
    return distinct(out)


def reading_lexemes(baseform: str, bases: str | None, analyser: str) -> list[str]:
    """Lexemes of one reading: the base form always, then parts; the analysers base, safe and reasm nest."""
    parts = [] if analyser == "base" or bases is None else safe(bases) if analyser == "safe" else reassembled(bases)
    return distinct([plain(baseform), *parts])


def word_lexemes(word: str, readings: list[tuple[str, str | None]], analyser: str) -> list[str]:
    """Lexemes of a word over its readings (base form, bases). Without a reading, the word itself.

    For a word in lower case, readings of capitalised base forms (names) don't count unless there are no others.
    """
    if not readings:
        return [plain(word)]
    common = [r for r in readings if not r[0][:1].isupper()] if word[:1].islower() else readings
    return distinct([x for base, bases in common or readings for x in reading_lexemes(base, bases, analyser)])


def parts(bases: Column, analyser: str) -> Column:
    """array<string> of a compound's parts, by pandas UDF: for distinct words, not for each token."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else (safe if analyser == "safe" else reassembled)(v))

    return run(bases)
