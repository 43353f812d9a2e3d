"""Contracts on inputs and results: editions, inventories, questions, pairs, controls, publication. A broken one is a row that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaivo.functions import text as T
from kaivo.operators import index, structure

#: Raters must agree on so many units before what one of them judged is published.
AGREEMENT = 0.85


def effective_date(rows: DataFrame, by: str) -> DataFrame:
    """by, date, problem: the one day that a source's texts (by, doc_id, text) name; none or several are problems."""
    days = structure.dates(rows.select(F.struct(by, "doc_id").alias("doc_id"), "text")).select(F.col(f"doc_id.{by}").alias(by), F.explode_outer("dates").alias("day"))
    n = days.groupBy(by).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    problem = F.when(F.col("first").isNull(), "no date").when(F.col("first") < F.col("last"), "several dates")
    return n.select(by, F.when(problem.isNull(), F.col("first")).alias("date"), problem.alias("problem"))


def inventory(chunks: DataFrame) -> DataFrame:
    """authority, clauses, chunks, definitions of passages (authority, clause, sub)."""
    return chunks.groupBy("authority").agg(F.countDistinct("clause").alias("clauses"), F.count("*").alias("chunks"), F.count("sub").alias("definitions"))


def inventory_problems(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """authority, problem where two inventories differ or one has no such authority; empty means that the corpus is as declared."""
    counts = ("clauses", "chunks", "definitions")
    both = found.alias("f").join(pinned.alias("p"), F.col("f.authority").eqNullSafe(F.col("p.authority")), "full_outer")
    differ = F.concat_ws(", ", *(F.when(F.col(f"f.{c}") != F.col(f"p.{c}"), F.concat(F.lit(f"{c} "), F.col(f"f.{c}"), F.lit(" for "), F.col(f"p.{c}"))) for c in counts))
    problem = F.when(F.col("f.chunks").isNull(), "missing").when(F.col("p.chunks").isNull(), "undeclared").when(differ != "", differ)
    return both.select(F.coalesce("f.authority", "p.authority").alias("authority"), problem.alias("problem")).where("problem is not null")


def index_report(documents: DataFrame) -> DataFrame:
    """analyser, tokens, stopped, forms, lexemes, positions. Words are counted once by form; what analysers make of them follows from the forms."""
    forms = documents.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    stopped = F.col("w").isin(*T.STOPWORDS)
    total = forms.agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(stopped, F.col("n"))), F.lit(0)).alias("stopped"), F.count("*").alias("forms"))  # one row
    made = forms.where(~stopped).select("n", F.explode(T.lexemes(F.col("w"))).alias("x")).where("x.lexeme is not null")
    made = made.groupBy("x.analyser", "x.lexeme").agg(F.sum("n").alias("n")).groupBy("analyser").agg(F.count("*").alias("lexemes"), F.sum("n").alias("positions"))
    return made.join(F.broadcast(total)).select("analyser", "tokens", "stopped", "forms", "lexemes", "positions")


def question_problems(questions: DataFrame) -> DataFrame:
    """qid, problem of questions (qid, text, population: answerable or refusal, authority, required: addresses); one row for each rule broken.

    Ids are unique over both populations and a text stands in one of them; an answerable question needs passages, each once and
    of its own jurisdiction; a refusal needs none.
    """
    same = questions.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid", F.lit("repeated id").alias("problem"))
    mixed = questions.groupBy("text").agg(F.countDistinct("population").alias("n")).where("n > 1").select("text")
    both = questions.join(mixed, "text", "left_semi").select("qid", F.lit("text in both populations").alias("problem"))
    own: Column = F.col("population") == "answerable"
    n = F.size(F.coalesce("required", F.array().cast("array<string>")))
    broken = F.array(
        F.when(own & (n == 0), "nothing required"),
        F.when(F.size(F.array_distinct("required")) < n, "passage required twice"),
        F.when(own & F.exists("required", lambda a: ~F.startswith(a, F.concat("authority", F.lit("@")))), "passage of another jurisdiction"),
        F.when(~own & (n > 0), "refusal with passages"),
    )
    rules = questions.select("qid", F.explode(F.array_compact(broken)).alias("problem"))
    return rules.unionByName(same).unionByName(both).distinct()


def pair_problems(rows: DataFrame) -> DataFrame:
    """pair, problem of paired questions (pair, text, authority): two rows, one text, two jurisdictions."""
    n = rows.groupBy("pair").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.countDistinct("authority").alias("authorities"))
    problem = F.when(F.col("n") != 2, "not two rows").when(F.col("texts") != 1, "different texts").when(F.col("authorities") != 2, "one jurisdiction")
    return n.select("pair", problem.alias("problem")).where("problem is not null")


def control_floor(cases: DataFrame) -> DataFrame:
    """shape, total, caught, passed of known-bad cases (shape, caught), and the same over all (shape null): passed if there are cases and all are caught."""
    n = cases.rollup("shape").agg(F.count("*").alias("total"), F.count(F.when(F.col("caught"), 1)).alias("caught"))
    return n.withColumn("passed", (F.col("total") > 0) & (F.col("caught") == F.col("total")))


def publishable(agreed: DataFrame, floor: float = AGREEMENT) -> DataFrame:
    """``agreed`` (units, agreed, pending) with rate and published: enough agreement, and nothing left to label."""
    rate = F.col("agreed") / F.nullif("units", F.lit(0))
    return agreed.withColumn("rate", F.round(rate, 6)).withColumn("published", F.coalesce(rate >= floor, F.lit(False)) & (F.col("pending") == 0))


def contexts(hits: DataFrame, chunk: DataFrame) -> DataFrame:
    """item_id, asked_in, n, missing, context: bodies of a question's hits (position, doc_id) in the order of their ranks, a blank line between."""
    near = chunk.select("doc_id", "body").join(index.small(hits.select("doc_id").distinct()), "doc_id", "left_semi")  # other bodies stay where they are read
    x = hits.join(near, "doc_id", "left").groupBy("item_id", "asked_in")
    x = x.agg(F.count("*").alias("n"), F.count(F.when(F.col("body").isNull(), 1)).alias("missing"), F.array_sort(F.collect_list(F.struct("position", "doc_id", "body"))).alias("b"))
    return x.select("item_id", "asked_in", "n", "missing", F.array_join(F.transform("b", lambda s: F.coalesce(s["body"], F.lit(""))), "\n\n").alias("context"))


def resolve(asked: DataFrame, covers: DataFrame) -> DataFrame:
    """``asked`` (place, and more) with status and authority, by what authorities cover (place, authority, part; part is null for all of a place).

    blank, unknown, partial (only a part is covered, so nobody is answered from it), ambiguous (several authorities) or resolved, the
    only one with an authority. Case doesn't count.
    """
    whole = F.col("part").isNull()
    known = covers.groupBy(F.lower("place").alias("folded")).agg(F.countDistinct(F.when(whole, F.col("authority"))).alias("n"), F.min(F.when(whole, F.col("authority"))).alias("one"))
    x = asked.join(known, F.lower(asked["place"]) == known["folded"], "left")
    status = F.when(F.coalesce(asked["place"], F.lit("")).rlike(r"^\s*$"), "blank").when(F.col("n").isNull(), "unknown").when(F.col("n") == 0, "partial").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return x.select(*(asked[c] for c in asked.columns), status.alias("status"), F.when(status == "resolved", F.col("one")).alias("authority"))


def manifest_problems(covers: DataFrame) -> DataFrame:
    """place, problem of what authorities cover (place, authority, part): covered twice, or in whole and in part by one authority."""
    whole = F.col("part").isNull()
    per = covers.groupBy(F.lower("place").alias("place"), "authority").agg(F.count(F.when(whole, 1)).alias("w"), F.count(F.when(~whole, 1)).alias("p"))
    n = per.groupBy("place").agg(F.count(F.when(F.col("w") > 0, 1)).alias("authorities"), F.max("w").alias("w"), F.max(((F.col("w") > 0) & (F.col("p") > 0)).cast("int")).alias("both"))
    broken = F.array(F.when(F.col("authorities") > 1, "covered by several authorities"), F.when(F.col("w") > 1, "listed twice"), F.when(F.col("both") == 1, "covered in whole and in part"))
    return n.select("place", F.explode(F.array_compact(broken)).alias("problem"))


def edition_problems(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, problem: a declared day (doc_id, day) must stand in the document's front (doc_id, text)."""
    x = declared.join(structure.dates(rows), "doc_id", "left")
    problem = F.when(F.col("day").isNull(), "no day declared").when(F.size(F.coalesce("dates", F.array().cast("array<date>"))) == 0, "no day in the document").when(~F.array_contains("dates", F.col("day")), "another day in the document")
    return x.select("doc_id", problem.alias("problem")).where("problem is not null")
