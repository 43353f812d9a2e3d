"""Column functions: words, lexemes, slugs, addresses, repairs of extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Words that no analyser indexes; one decision for all analysers, so that they differ in one thing only.
STOPWORDS = tuple("the of and to in is a that it for was on are as with be by at from this le la de et les des en un une du die der das und el los las que y".split())
ANALYSERS = ("stem", "base", "split", "prefix")
CONTROL = "stem"
# Conjunctions before which a line-end hyphen is real.
CONJUNCTIONS = ("ja", "tai", "sekä", "seka", "eli", "että", "etta")


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def kept(text: Column) -> Column:
    """Words that are indexed, in order."""
    return F.filter(words(text), lambda w: ~w.isin(*STOPWORDS))


#: A URL, or letters and digits with hyphens between them, as one token.
WHOLE = r"https?://[^\s]*[\p{L}\p{N}/]|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def tokens(text: Column) -> Column:
    """Tokens in order, as a lexicon sees them: URLs and words with hyphens stay whole, case stays."""
    return F.regexp_extract_all(text, F.lit(WHOLE), F.lit(0))


SUFFIX = "(ing|tion|ment|ed|er|es|en|s)$"


def stem(w: Column) -> Column:
    """A light stem: one common suffix less, if three characters stay."""
    short = F.regexp_replace(w, SUFFIX, "")
    return F.when(F.length(short) >= 3, short).otherwise(w)


def _parts(w: Column) -> tuple[Column, Column, Column]:
    """Halves of a long word and the beginning of a longer one; null where there is none or it repeats another."""
    half = (F.length(w) / 2).cast("int")
    left, right, head = F.substring(w, F.lit(1), half), F.substring(w, half + 1, F.length(w)), F.substring(w, 1, 5)
    long = F.length(w) >= 10
    return F.when(long, left), F.when(long & (left != right), right), F.when((F.length(w) >= 6) & (~long | (head != left)), head)


def lexemes(w: Column, analysers: tuple[str, ...] = ANALYSERS) -> Column:
    """Array of (analyser, lexeme) of a word; a null lexeme is none. No lambda, so that it stays in generated code.

    stem: a light stem; base: the word; split: its halves too if it is long; prefix: its beginning too. The last three nest.
    """
    left, right, head = _parts(w)
    own = {"stem": (stem(w),), "base": (w,), "split": (w, left, right), "prefix": (w, left, right, head)}
    return F.array(*(F.struct(F.lit(a).alias("analyser"), x.alias("lexeme")) for a in analysers for x in own[a]))


def n_lexemes(w: Column, analyser: str) -> Column:
    """How many lexemes a word has."""
    left, right, head = _parts(w)
    extra = {"stem": (), "base": (), "split": (left, right), "prefix": (left, right, head)}[analyser]
    return sum((x.isNotNull().cast("int") for x in extra), F.lit(1))


def slug(text: Column) -> Column:
    """Lower case, a few accents folded, everything else but a-z and 0-9 as single hyphens, none at the ends."""
    folded = F.translate(F.lower(text), "äåöé", "aaoe")
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain_title(text: Column) -> Column:
    """A title for comparison: no white space, hyphens or dashes; lower case."""
    return F.lower(F.regexp_replace(text, r"[\s\-\x{2010}-\x{2015}]+", ""))


def address(authority: Column, date: Column, clause: Column, sub: Column) -> Column:
    """authority@date#clause, with .sub if there is one."""
    return F.concat(authority, F.lit("@"), date.cast("string"), F.lit("#"), clause.cast("string"), F.coalesce(F.concat(F.lit("."), sub), F.lit("")))


ADDRESS = r"^([a-z0-9-]+)@(\d{4}-\d{2}-\d{2})#([1-9]\d*)(?:\.([a-z0-9-]+))?$"


def parsed_address(raw: Column) -> Column:
    """struct(authority, date, clause, sub), or null if it isn't an address of a real day. White space around and case don't count."""
    clean = F.lower(F.trim(raw))
    part = [F.regexp_extract(clean, ADDRESS, k) for k in range(1, 5)]
    day = F.try_to_timestamp(part[1], F.lit("yyyy-MM-dd")).cast("date")
    return F.when(clean.rlike(ADDRESS) & day.isNotNull(), F.struct(part[0].alias("authority"), day.alias("date"), part[2].cast("int").alias("clause"), F.nullif(part[3], F.lit("")).alias("sub")))


PAGE_BREAK = r"(?m)^\f+([ \t]*[\p{Lu}•*])"


def page_breaks(text: Column) -> Column:
    """Form feeds at a line's beginning become a blank line where a new paragraph begins (upper case or a bullet), else nothing; others stay."""
    return F.regexp_replace(F.regexp_replace(text, PAGE_BREAK, "\n$1"), r"(?m)^\f+", "")


def n_page_breaks(text: Column) -> Column:
    """How many blank lines ``page_breaks`` puts in."""
    return F.regexp_count(text, F.lit(PAGE_BREAK)).cast("long")


def dehyphenated(text: Column) -> Column:
    """Joins words cut at a line's end, unless the next line begins with a conjunction (then the hyphen is real) or isn't lower case."""
    return F.regexp_replace(text, _JOIN, "")


_GUARD = f"(?:{'|'.join(CONJUNCTIONS)})(?=[\\s,.;:]|$)"
_JOIN = rf"-\n[ \t]*(?!{_GUARD})(?=\p{{Ll}})"


def n_joins(text: Column) -> Column:
    """How many words ``dehyphenated`` joins."""
    return F.regexp_count(text, F.lit(_JOIN)).cast("long")


def n_guards(text: Column) -> Column:
    """How many hyphens a conjunction keeps."""
    return F.regexp_count(text, F.lit(rf"-\n[ \t]*{_GUARD}")).cast("long")


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_key(token: Column) -> Column:
    """A capability token as typed: case and hyphens forgiven if eight letters and digits remain, else unchanged."""
    clean = F.upper(F.regexp_replace(F.trim(token), r"[\s-]+", ""))
    return F.when(clean.rlike("^[A-Z0-9]{8}$"), F.concat(F.substring(clean, 1, 4), F.lit("-"), F.substring(clean, 5, 4))).otherwise(token)
