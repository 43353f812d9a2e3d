"""Structured documents into addressed passages: sections, table of contents, clauses, definitions, dates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kaivo.functions import text as T

CLAUSE = re.compile(r"^\s*(\d+)\s*§\s*(.*)$")
ENTRY = re.compile(r"^(.*?)\s*\.{4,}\s*\d*\s*$")
CHAPTER = re.compile(r"^\s*(\d+)\s+luku\b\s*(.*)$", re.IGNORECASE)
#: A heading may run over so many lines more.
HEADING_LINES = 3
#: A definition's key has so many leading words at most.
KEY_WORDS = 5


class Unreadable(ValueError):
    """A document that isn't built as declared."""


def sections(documents: DataFrame) -> DataFrame:
    """doc_id, front, toc, body: before, between and after the first and last line with a dot leader; problem without any."""
    lines = F.split("text", "\n")
    leader = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\.{4,}"), i)), lambda i: i.isNotNull())
    d = documents.select("doc_id", lines.alias("l"), F.array_min(leader).alias("a"), F.array_max(leader).alias("b"))
    part = lambda lo, n: F.array_join(F.slice("l", lo, n), "\n")
    return d.select(
        "doc_id", F.when(F.col("a").isNotNull(), part(F.lit(1), F.col("a"))).alias("front"), F.when(F.col("a").isNotNull(), part(F.col("a") + 1, F.col("b") - F.col("a") + 1)).alias("toc"),
        F.when(F.col("a").isNotNull(), part(F.col("b") + 2, F.size("l"))).alias("body"), F.when(F.col("a").isNull(), "no table of contents").alias("problem"),
    )


def contents(toc: str) -> dict[int, str]:
    """Clause number -> title. Entries may be wrapped over lines; numbers run from 1 without holes or repeats."""
    titles: dict[int, str] = {}
    open_ = ""
    for line in toc.splitlines():
        open_ = f"{open_} {line.strip()}".strip()
        done = ENTRY.match(open_)
        if done:
            clause = CLAUSE.match(done[1])
            if clause:
                if int(clause[1]) in titles:
                    raise Unreadable(f"clause {clause[1]} twice in the table of contents")
                titles[int(clause[1])] = clause[2].strip()
            open_ = ""
    if sorted(titles) != list(range(1, len(titles) + 1)):
        raise Unreadable("holes in the table of contents")
    return titles


def _plain(title: str) -> str:
    return re.sub(r"[\s\-‐-―]+", "", title).lower()


def clauses(body: str, titles: dict[int, str]) -> list[tuple[int, str, str]]:
    """(number, title, text) of each clause: a heading counts only if its number is the next one due and its words are its title's."""
    lines = body.splitlines()
    marks: list[tuple[int, int]] = []  # line of the heading, first line of the text
    due = 1
    k = 0
    while k < len(lines):
        m = CLAUSE.match(lines[k])
        if m and int(m[1]) == due and due in titles:
            heading = m[2]
            for more in range(HEADING_LINES + 1):
                if _plain(heading) == _plain(titles[due]):
                    marks.append((k, k + more + 1))
                    due += 1
                    k += more
                    break
                if k + more + 1 < len(lines):
                    heading += f" {lines[k + more + 1].strip()}"
        k += 1
    if len(marks) != len(titles):
        raise Unreadable(f"{len(marks)} clauses of {len(titles)} found")
    ends = [a for a, _ in marks[1:]] + [len(lines)]
    return [(n, titles[n], "\n".join(x for x in lines[b:e] if not CHAPTER.match(x)).strip()) for n, ((_, b), e) in enumerate(zip(marks, ends, strict=True), 1)]


def split_clauses(parts: DataFrame) -> DataFrame:
    """doc_id, clause, title, text, problem of ``sections`` rows; a document that can't be read is one row with its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, toc, body in zip(batch["doc_id"], batch["toc"], batch["body"], strict=True):
                try:
                    out += [(d, n, title, text, None) for n, title, text in clauses(body or "", contents(toc or ""))]
                except Unreadable as e:
                    out.append((d, None, None, None, str(e)))
            frame = pd.DataFrame(out, columns=["doc_id", "clause", "title", "text", "problem"])
            yield frame.astype({"clause": "Int32"})

    return parts.select("doc_id", "toc", "body").mapInPandas(run, "doc_id long, clause int, title string, text string, problem string")


def definitions(rows: DataFrame) -> DataFrame:
    """doc_id, unit, text of a definitions clause (doc_id, text): blank-line paragraphs or bullets."""
    units = F.filter(F.transform(F.split("text", r"\n\s*\n|\n(?=[ \t]*•)"), lambda x: T.squeezed(F.regexp_replace(x, "^\\s*•\\s*", ""))), lambda x: x != "")
    return rows.select("doc_id", F.posexplode(units).alias("unit", "text"))


def unique_keys(units: DataFrame) -> DataFrame:
    """doc_id, unit, key: the shortest prefix of leading words whose slug no other unit of the document has at that length.

    Units with fewer words don't collide; key is null where KEY_WORDS words don't tell units apart.
    """
    w = F.filter(F.split(F.regexp_replace("text", r"[\s]+", " "), " "), lambda x: x != "")
    tried = units.select("doc_id", "unit", w.alias("w")).withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(KEY_WORDS), F.size("w"))))))
    tried = tried.select("doc_id", "unit", "n", T.slug(F.array_join(F.slice("w", 1, F.col("n")), " ")).alias("slug"))
    tried = tried.withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "n", "slug")))
    return tried.groupBy("doc_id", "unit").agg(F.min(F.when((F.col("same") == 1) & (F.col("slug") != ""), F.struct("n", "slug")))["slug"].alias("key"))


def key_problems(keys: DataFrame) -> DataFrame:
    """doc_id, unit, problem of ``unique_keys`` rows: units without a key, and units whose keys are equal though made of different numbers of words."""
    same = F.count("*").over(Window.partitionBy("doc_id", "key"))
    problem = F.when(F.col("key").isNull(), "no key tells it apart").when(same > 1, "key of another unit too")
    return keys.select("doc_id", "unit", problem.alias("problem")).where("problem is not null")


def dates(rows: DataFrame) -> DataFrame:
    """doc_id, dates: the distinct days written D.M.YYYY in a text (doc_id, text), in order."""
    found = F.regexp_extract_all("text", F.lit(r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b"), F.lit(1))
    return rows.select("doc_id", F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.try_to_timestamp(x, F.lit("d.M.yyyy")).cast("date")), lambda d: d.isNotNull()))).alias("dates"))


def chunks(parts: DataFrame, definitions_clause: int = 2) -> DataFrame:
    """doc_id, clause, sub, citation, text of ``split_clauses`` rows without a problem: a clause under its heading, and each definition by itself under its key."""
    good = parts.where("problem is null")
    heading = F.concat(F.col("clause").cast("string"), F.lit(" § "), "title")
    plain = good.where(F.col("clause") != definitions_clause).select("doc_id", "clause", F.lit(None).cast("string").alias("sub"), heading.alias("citation"), F.trim(F.concat(heading, F.lit("\n"), "text")).alias("text"))
    own = good.where(F.col("clause") == definitions_clause).select("doc_id", "clause", heading.alias("citation"), "text")
    units = definitions(own)
    keyed = units.join(unique_keys(units), ["doc_id", "unit"]).join(own.drop("text"), "doc_id")
    return plain.unionByName(keyed.select("doc_id", "clause", F.col("key").alias("sub"), "citation", "text"))
