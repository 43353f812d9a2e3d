"""Arithmetic over judged answers: verdict envelopes, agreement of raters, citations, refusals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kaivo.functions import text as T
from kaivo.functions.stats import Z, wilson

VERDICT = "branches array<struct<index:int,stated:boolean,supported:boolean,quote:string>>, forbidden array<struct<index:int,asserted:boolean,quote:string>>"


@F.pandas_udf(DoubleType())
def _share_met(own: pd.Series, there: pd.Series) -> pd.Series:
    def share(a: Sequence[str] | None, b: Sequence[str] | None) -> float | None:
        if a is None or (len(a) and b is None):
            return None
        return (Counter(a) & Counter(b)).total() / len(a) if len(a) else 1.0

    return pd.Series([share(a, b) for a, b in zip(own, there, strict=True)], dtype="float64")


def quote_share(quote: Column, answer: Column) -> Column:
    """Share of a quote's words that the answer has, as multisets; 1 for an empty quote. Words are counted once, in time that grows with their number."""
    return _share_met(T.words(quote), T.words(answer))


def verdicts(rows: DataFrame) -> DataFrame:
    """Judge envelopes (qid, raw JSON, refused, answer, n_branches, n_forbidden) into one row per unit.

    problem: why an envelope can't be used (one row, no unit); such rows are contracts to raise on. What a judge says is data:
    supported without stated, or anything read out of a refusal, is set to false and counted as incoherent.
    """
    p = rows.withColumn("v", F.from_json("raw", VERDICT, {"mode": "PERMISSIVE"}))
    flags = lambda key, names: F.exists(f"v.{key}", lambda x: reduce(or_, (x[n].isNull() for n in names)))
    problem = (
        F.when(F.coalesce("raw", F.lit("")).rlike(r"^\s*$"), "empty")
        .when(~F.col("raw").rlike(r"^\s*\{") | F.col("v").isNull(), "not an object")
        .when(F.get_json_object("raw", "$.branches").isNull() | F.get_json_object("raw", "$.forbidden").isNull(), "missing key")
        .when(F.col("v.branches").isNull() | F.col("v.forbidden").isNull(), "wrong type")
        .when((F.size("v.branches") != F.col("n_branches")) | (F.size("v.forbidden") != F.col("n_forbidden")), "wrong count")
        .when(flags("branches", ("stated", "supported")) | flags("forbidden", ("asserted",)), "wrong type")
    )
    p = p.withColumn("problem", problem)
    bad = p.where("problem is not null").select("qid", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("idx"), *(F.lit(None).cast("boolean").alias(c) for c in ("stated", "supported", "asserted")), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("int").alias("incoherent"), "answer", "problem")
    good = p.where("problem is null")
    b = good.select("qid", "refused", "answer", F.posexplode("v.branches").alias("i", "x"))
    stated = F.col("x.stated") & ~F.col("refused")
    b = b.select("qid", F.lit("branch").alias("unit"), (F.col("i") + 1).alias("idx"), stated.alias("stated"), (F.col("x.supported") & stated).alias("supported"), F.lit(None).cast("boolean").alias("asserted"), F.when(F.col("refused"), "").otherwise(F.coalesce("x.quote", F.lit(""))).alias("quote"), ((F.col("x.supported") & ~F.col("x.stated")).cast("int") + (F.col("refused") & F.col("x.stated")).cast("int")).alias("incoherent"), "answer", F.lit(None).cast("string").alias("problem"))
    f = good.select("qid", "refused", "answer", F.posexplode("v.forbidden").alias("i", "x"))
    f = f.select("qid", F.lit("forbidden").alias("unit"), (F.col("i") + 1).alias("idx"), F.lit(None).cast("boolean").alias("stated"), F.lit(None).cast("boolean").alias("supported"), (F.col("x.asserted") & ~F.col("refused")).alias("asserted"), F.when(F.col("refused") & F.col("x.asserted"), "").otherwise(F.coalesce("x.quote", F.lit(""))).alias("quote"), (F.col("refused") & F.col("x.asserted")).cast("int").alias("incoherent"), "answer", F.lit(None).cast("string").alias("problem"))
    units = b.unionByName(f).unionByName(bad)
    found = (F.col("quote") != "") & F.contains(T.squeezed(F.col("answer")), T.squeezed(F.col("quote")))
    return units.withColumn("quote_found", found).withColumn("quote_words", F.round(quote_share(F.coalesce("quote", F.lit("")), F.coalesce("answer", F.lit(""))), 6)).drop("answer")


def judged_metrics(units: DataFrame) -> DataFrame:
    """Pooled over units: groundedness (null if nothing is stated), coverage, over-claiming answers, fabrications and splices."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    claim = yes(F.col("stated")) | yes(F.col("asserted"))
    per = units.where("problem is null").groupBy("qid").agg(
        F.count(F.when(F.col("unit") == "branch", 1)).alias("required"), F.count(F.when(yes(F.col("stated")), 1)).alias("stated"), F.count(F.when(yes(F.col("supported")), 1)).alias("supported"),
        F.count(F.when(yes(F.col("asserted")), 1)).alias("asserted"), F.count(F.when(F.col("unit") == "forbidden", 1)).alias("forbidden"),
        F.max((claim & ~F.col("quote_found") & (F.col("quote_words") < 1)).cast("int")).alias("fabricated"), F.max((claim & ~F.col("quote_found") & (F.col("quote_words") >= 1)).cast("int")).alias("spliced"),
    )
    return per.agg(
        F.count("*").alias("answers"), F.sum("required").alias("required"), F.sum("stated").alias("stated"), F.sum("supported").alias("supported"), F.sum("forbidden").alias("forbidden"),
        F.round(F.sum("supported") / F.nullif(F.sum("stated"), F.lit(0)), 6).alias("groundedness"), F.round(F.sum("stated") / F.nullif(F.sum("required"), F.lit(0)), 6).alias("coverage"),
        F.round(F.avg((F.col("asserted") > 0).cast("double")), 6).alias("over_claim_rate"), F.sum("fabricated").alias("fabrications"), F.sum("spliced").alias("splices"),
    )


def cluster_interval(per_cluster: DataFrame, *by: str) -> DataFrame:
    """by, clusters, units, agreed, rate, low, high, kind of per-cluster rows (by, agreed, units): a ratio estimator clustered by row.

    Var = m / ((m - 1) N^2) * sum (a - p n)^2 from three sums, in one pass. Without variance (within 1e-12) it is the Wilson
    interval over the clusters; with fewer than two clusters there is none.
    """
    a, n = F.col("agreed").cast("double"), F.col("units").cast("double")
    s = per_cluster.groupBy(*by).agg(F.count("*").alias("clusters"), F.sum("units").alias("units"), F.sum("agreed").alias("agreed"), F.sum(a * a).alias("aa"), F.sum(a * n).alias("an"), F.sum(n * n).alias("nn"), F.count(F.when(F.col("agreed") == F.col("units"), 1)).alias("whole"))
    p, m = F.col("agreed") / F.col("units"), F.col("clusters")
    variance = m / ((m - 1) * F.col("units") * F.col("units")) * (F.col("aa") - 2 * p * F.col("an") + p * p * F.col("nn"))
    s = s.withColumn("variance", F.when(m > 1, variance))
    low, high = wilson(F.col("whole"), m)
    spread = Z * F.sqrt(F.greatest("variance", F.lit(0.0)))
    flat = F.col("variance") <= 1e-12
    return s.select(
        *by, "clusters", "units", "agreed", F.round(p, 6).alias("rate"),
        F.round(F.when(m > 1, F.when(flat, low).otherwise(F.greatest(F.lit(0.0), p - spread))), 6).alias("low"),
        F.round(F.when(m > 1, F.when(flat, high).otherwise(F.least(F.lit(1.0), p + spread))), 6).alias("high"),
        F.when(m < 2, "none").when(flat, "wilson-over-clusters").otherwise("cluster-robust").alias("kind"),
    )


def agreement(first: DataFrame, second: DataFrame, key: tuple[str, ...] = ("qid", "unit", "idx", "field")) -> tuple[DataFrame, DataFrame]:
    """(units with both values, keys on one side only) of two raters' labels (key, value). The second must be empty to go on."""
    both = first.withColumnRenamed("value", "a").withColumn("left", F.lit(1)).join(second.withColumnRenamed("value", "b").withColumn("right", F.lit(1)), list(key), "full_outer")
    return both.where("left is not null and right is not null").drop("left", "right"), both.where("left is null or right is null").select(*key, F.when(F.col("left").isNull(), "second").otherwise("first").alias("only_in"))


def citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """cited (qid, authority, pos, raw) against retrieved (qid, address): raw, canonical address, bucket inside, outside, foreign or unparseable."""
    a = T.parsed_address(F.col("raw"))
    parsed = cited.withColumn("a", a).withColumn("address", T.address(F.col("a.authority"), F.col("a.date"), F.col("a.clause"), F.col("a.sub")))
    seen = retrieved.select("qid", "address").distinct().withColumn("seen", F.lit(True))
    bucket = F.when(F.col("a").isNull(), "unparseable").when(F.col("seen"), "inside").when(F.col("a.authority") != F.col("authority"), "foreign").otherwise("outside")
    return parsed.join(seen, ["qid", "address"], "left").select("qid", "pos", "raw", "address", bucket.alias("bucket"))


def refusal_metrics(rows: DataFrame) -> DataFrame:
    """One row of counts and intervals from outcomes (qid, population: refusal or answerable, kind, refused, complete).

    Precision's denominator is every refusal that was given; the restricted one leaves out those excused by incomplete retrieval.
    """
    refused = F.col("refused")
    s = rows.agg(
        F.count(F.when(F.col("population") == "refusal", 1)).alias("refusals"), F.count(F.when((F.col("population") == "refusal") & refused, 1)).alias("correct"),
        F.count(F.when(refused, 1)).alias("emitted"), F.count(F.when((F.col("population") == "answerable") & refused & ~F.col("complete"), 1)).alias("excused"),
    )
    low, high = wilson(F.col("correct"), F.col("refusals"))
    plow, phigh = wilson(F.col("correct"), F.col("emitted"))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return s.select(
        "refusals", "correct", "emitted", "excused", share(F.col("correct"), F.col("refusals")).alias("recall"), F.round(low, 6).alias("recall_low"), F.round(high, 6).alias("recall_high"),
        share(F.col("correct"), F.col("emitted")).alias("precision"), F.round(F.coalesce(plow, F.lit(0.0)), 6).alias("precision_low"), F.round(F.coalesce(phigh, F.lit(1.0)), 6).alias("precision_high"),
        share(F.col("correct"), F.col("emitted") - F.col("excused")).alias("restricted_precision"),
    )
