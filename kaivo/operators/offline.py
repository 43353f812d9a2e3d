"""Recorded material scored without a model: answers against questions, hand labels against verdicts, controls, answer envelopes.

A broken contract is a row with a problem, so that one pass shows all of them; nothing is scored over fewer rows than were asked.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaivo.functions.stats import wilson

UNIT = ("qid", "unit", "idx")


def to_label(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, refused, units, forced, problem of questions (qid, n_branches, n_forbidden) with their recorded answers (qid, refused).

    Units under a refused answer are forced: nothing can be stated there, so labelling them tells nothing. A question without an answer is a problem.
    """
    x = questions.join(answers.select("qid", "refused").withColumn("there", F.lit(True)), "qid", "left")
    return x.select("qid", "refused", (F.col("n_branches") + F.col("n_forbidden")).alias("units"), F.coalesce("refused", F.lit(False)).alias("forced"), F.when(F.col("there").isNull(), "no answer").alias("problem"))


def forced_units(labelled: DataFrame) -> DataFrame:
    """One row: questions, informative ones, units, forced ones and questions without an answer of ``to_label``."""
    there = F.col("problem").isNull()
    return labelled.agg(
        F.count("*").alias("questions"), F.count(F.when(there & ~F.col("forced"), 1)).alias("informative"), F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units"),
        F.coalesce(F.sum(F.when(F.col("forced"), F.col("units"))), F.lit(0)).cast("long").alias("forced_units"), F.count("problem").alias("missing"),
    )


def judge_labels(human: DataFrame, verdicts: DataFrame) -> DataFrame:
    """qid, unit, idx, field, value, problem: a judge's verdicts (UNIT, stated, supported, asserted) for exactly the units that a human labelled (UNIT, stated).

    ``supported`` is in scope where the human, not the judge, says stated, so that the compared units don't depend on what is measured. A
    unit with no verdict or several is one row with its problem.
    """
    v = verdicts.groupBy(*UNIT).agg(F.count("*").alias("n"), *(F.first(c).alias(f"v_{c}") for c in ("stated", "supported", "asserted")))
    x = human.select(*UNIT, "stated").join(v, list(UNIT), "left")
    problem = F.when(F.col("n").isNull(), "no verdict").when(F.col("n") > 1, "several verdicts")
    own = F.col("unit") == "branch"
    said = lambda c: F.struct(F.lit(c).alias("field"), F.col(f"v_{c}").alias("value"))
    none = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("boolean").alias("value"))
    fields = F.when(problem.isNotNull(), F.array(none)).when(own & F.col("stated"), F.array(said("stated"), said("supported"))).when(own, F.array(said("stated"))).otherwise(F.array(said("asserted")))
    return x.select(*UNIT, problem.alias("problem"), F.explode(fields).alias("f")).select(*UNIT, "f.field", "f.value", "problem")


def refusal_outcomes(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, population, kind, refused, complete, problem of recorded answers (qid, population, refused, retrieved) to questions (qid, population, kind, required).

    Kind and population come from the questions, never from the recording. complete: all required passages were retrieved (null for a
    refusal). Problems: a refusal question without an answer, an answer to a refusal that isn't asked (left out by name), an answer to
    an unknown answerable question. An answerable question without an answer isn't scored and is no problem here.
    """
    a = answers.select("qid", F.col("population").alias("said"), "refused", "retrieved").withColumn("there", F.lit(True))
    x = questions.select("qid", "population", "kind", "required").join(a, "qid", "full_outer")
    problem = (
        F.when(F.col("there").isNull() & (F.col("population") == "refusal"), "not answered")
        .when((F.col("said") == "refusal") & (F.col("population").isNull() | (F.col("population") != "refusal")), "not asked")
        .when(F.col("there") & F.col("population").isNull(), "unknown question")
    )
    some = F.array().cast("array<string>")
    complete = F.when(F.col("population") == "answerable", F.size(F.array_except(F.coalesce("required", some), F.coalesce("retrieved", some))) == 0)
    return x.where(F.col("there") | (F.col("population") == "refusal")).select("qid", "population", "kind", "refused", complete.alias("complete"), problem.alias("problem"))


def refusals_by_kind(outcomes: DataFrame) -> DataFrame:
    """kind, refusals, correct, recall, low, high of ``refusal_outcomes`` without problems; kind null is all of them."""
    s = outcomes.where("problem is null and population = 'refusal'").rollup("kind").agg(F.count("*").alias("refusals"), F.count(F.when(F.col("refused"), 1)).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("refusals"))
    return s.where("refusals > 0").select("kind", "refusals", "correct", F.round(F.col("correct") / F.col("refusals"), 6).alias("recall"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def refusal_offenders(outcomes: DataFrame) -> DataFrame:
    """qid, kind, offence: refusals that were answered, and answerable questions that were refused although all passages were there."""
    offence = F.when((F.col("population") == "refusal") & ~F.col("refused"), "answered").when((F.col("population") == "answerable") & F.col("refused") & F.col("complete"), "refused with everything retrieved")
    return outcomes.where("problem is null").select("qid", "kind", offence.alias("offence")).where("offence is not null")


def control_problems(cases: DataFrame, expectations: DataFrame, questions: DataFrame, shapes: tuple[str, ...]) -> DataFrame:
    """case_id, problem of known-bad cases (case_id, qid, shape, answer), what must be caught (case_id, unit, idx) and questions (qid, authority, n_branches, n_forbidden).

    Each case needs an own id, a known question, a known shape, an answer and something to catch that its question has. Every shape has to
    come in every jurisdiction that the cases touch, and these are two at least: such a gap is a row without a case.
    """
    q = questions.select("qid", "authority", "n_branches", "n_forbidden").withColumn("asked", F.lit(True))
    x = cases.select("case_id", "qid", "shape", "answer").join(q, "qid", "left")
    size = expectations.groupBy("case_id").agg(F.count("*").alias("n"))
    broken = F.array(
        F.when(F.col("case_id").isNull() | (F.col("case_id") == ""), "no id"),
        F.when(F.col("asked").isNull(), "unknown question"),
        F.when(~F.coalesce(F.col("shape").isin(*shapes), F.lit(False)), "unknown shape"),
        F.when(F.coalesce("answer", F.lit("")).rlike(r"^\s*$"), "empty answer"),
        F.when(F.col("n").isNull(), "nothing to catch"),
    )
    rules = x.join(size, "case_id", "left").select("case_id", F.explode(F.array_compact(broken)).alias("problem"))
    limit = F.when(F.col("unit") == "branch", F.col("n_branches")).otherwise(F.col("n_forbidden"))
    far = expectations.select("case_id", "unit", "idx").join(x.where("asked"), "case_id").where((F.col("idx") < 1) | (F.col("idx") > limit)).select("case_id", F.lit("no such unit").alias("problem"))
    same = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("repeated id").alias("problem"))
    covered = x.where("asked").groupBy("authority").agg(F.collect_set(F.when(F.col("shape").isin(*shapes), F.col("shape"))).alias("has"))  # at most one value a shape
    gap = covered.select(F.lit(None).cast("string").alias("case_id"), "authority", F.explode(F.array_except(F.array(*map(F.lit, shapes)), "has")).alias("shape"))
    gap = gap.select("case_id", F.concat(F.lit("shape "), "shape", F.lit(" not covered in "), "authority").alias("problem"))
    lone = covered.agg(F.count("*").alias("n")).where("n < 2").select(F.lit(None).cast("string").alias("case_id"), F.lit("fewer than two jurisdictions").alias("problem"))
    return reduce(DataFrame.unionByName, (rules, far, same, gap, lone)).distinct()


def control_outcomes(cases: DataFrame, expectations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """case_id, shape, caught, missed: a case (case_id, shape) is caught if the verdict (case_id, unit, idx, field, value) is as expected (the same with expect) everywhere.

    An expectation without a verdict is missed; a case without expectations isn't caught.
    """
    key = ["case_id", "unit", "idx", "field"]
    met = expectations.join(verdicts.select(*key, "value"), key, "left").groupBy("case_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") == F.col("expect"), 1)).alias("met"))
    x = cases.select("case_id", "shape").join(met, "case_id", "left")
    return x.select("case_id", "shape", F.coalesce(F.col("n") == F.col("met"), F.lit(False)).alias("caught"), F.coalesce(F.col("n") - F.col("met"), F.lit(0)).alias("missed"))


def limited(answers: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n answers, with partial: whether any were left out, so that the result can't pass for a whole run."""
    if n < 1:
        raise ValueError(f"a limited run judges at least one answer, not {n}")
    total = answers.agg((F.count("*") > n).alias("partial"))  # one row
    return answers.orderBy(*order).limit(n).join(F.broadcast(total))


def blocks(agreed: DataFrame, floor: float) -> DataFrame:
    """field, block of agreement (field, units, agreed, pending, partial): what may be said of a field's figures.

    diagnostic: a partial run, or labels are pending; withheld: raters agree on less than the floor or on nothing; else published.
    """
    rate = F.col("agreed") / F.nullif("units", F.lit(0))
    return agreed.select("field", F.when(F.col("partial") | (F.col("pending") > 0), "diagnostic").when(F.coalesce(rate >= floor, F.lit(False)), "published").otherwise("withheld").alias("block"))


def envelopes(rows: DataFrame) -> DataFrame:
    """qid, refused, answer, citations, problem of raw answers (qid, raw): an object with a boolean, a string and a list of strings, and nothing guessed.

    Problems in this order: empty, not JSON, not an object, missing key, wrong type. Further keys don't matter.
    """
    v = F.try_parse_json("raw")
    x = rows.select("qid", "raw", v.alias("v"))
    keys = ("refused", "answer", "citations")
    part = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    kind: dict[str, Column] = {k: F.schema_of_variant(part(k)) for k in keys}
    x = x.select("qid", "raw", "v", F.schema_of_variant("v").alias("top"), *(kind[k].alias(f"t_{k}") for k in keys))
    typed = (F.col("t_refused") == "BOOLEAN", F.col("t_answer") == "STRING", F.col("t_citations").isin("ARRAY<STRING>", "ARRAY<VOID>"))
    # an array of nulls has the type of an empty one
    whole = (F.col("t_citations") != "ARRAY<VOID>") | (F.size(F.try_variant_get("v", "$.citations", "array<variant>")) == 0)
    held = F.col("t_citations") != "ARRAY<STRING>"
    full = held | ~F.exists(F.try_variant_get("v", "$.citations", "array<string>"), lambda c: c.isNull())
    problem = (
        F.when(F.coalesce("raw", F.lit("")).rlike(r"^\s*$"), "empty")
        .when(F.col("v").isNull(), "not JSON")
        .when(~F.col("top").startswith("OBJECT"), "not an object")
        .when(F.greatest(*(F.col(f"t_{k}").isNull() for k in keys)), "missing key")
        .when(~reduce(and_, (*typed, whole, full)), "wrong type")
    )
    x = x.withColumn("problem", problem)
    good = lambda k, t: F.when(F.col("problem").isNull(), F.try_variant_get("v", f"$.{k}", t)).alias(k)
    return x.select("qid", good("refused", "boolean"), good("answer", "string"), good("citations", "array<string>"), "problem")
