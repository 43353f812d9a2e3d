"""Label resolution, outcomes per question and cell, metrics, paired comparison, the regression gate."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaivo.functions import text as T
from kaivo.functions.stats import mcnemar
from kaivo.operators import index, rank

CELL = ("analyser", "norm")


class Violation(RuntimeError):
    """A contract is broken: a label without a passage, a foreign hit, a duplicate id. Bad content is data and never raises."""


def require_empty(df: DataFrame, message: str) -> None:
    some = df.limit(3).collect()
    if some:
        raise Violation(f"{message}: {[tuple(r) for r in some]}")


def population(ix: index.Index, benchmark: DataFrame) -> DataFrame:
    """item_id, asked_in, doc_id: the passages each question needs in each jurisdiction that has any."""
    found = index.required(ix, index.questions(benchmark))
    return found.where("authority is not null").select("item_id", F.col("authority").alias("asked_in"), "doc_id")


def present(ix: index.Index, benchmark: DataFrame, need: DataFrame) -> DataFrame:
    """item_id, asked_in: jurisdictions with a question's text, by either detector: as it stands in any case, or its kept words in order."""
    by_words = index.phrases_held(ix, benchmark.select(F.col("item_id").alias("phrase_id"), "text")).where("authority is not null").select(F.col("phrase_id").alias("item_id"), F.col("authority").alias("asked_in"))
    return need.select("item_id", "asked_in").unionByName(by_words).distinct()


def kinds(ix: index.Index, benchmark: DataFrame, need: DataFrame) -> DataFrame:
    """item_id, asked_in, kind: answerable there, out-of-jurisdiction (elsewhere only) or out-of-corpus."""
    there = present(ix, benchmark, need)
    few = index.fixed(there)  # texts are read once
    there = (there if few is None else few).withColumn("there", F.lit(True))
    anywhere = there.select("item_id").distinct().withColumn("anywhere", F.lit(True))
    grid = benchmark.select("item_id").join(F.broadcast(rank.authorities(ix)))  # a question is asked in each jurisdiction
    kind = F.when(F.col("there"), "answerable").when(F.col("anywhere"), "out-of-jurisdiction").otherwise("out-of-corpus")
    return grid.join(there, ["item_id", "asked_in"], "left").join(anywhere, "item_id", "left").select("item_id", "asked_in", kind.alias("kind"))


def absence_violations(found: DataFrame, claimed: DataFrame) -> DataFrame:
    """item_id, asked_in, violation: refusal questions (item_id, asked_in, kind) whose kind the corpus contradicts; found: ``kinds``."""
    at_home = found.withColumnRenamed("kind", "is")
    elsewhere = at_home.where("is = 'answerable'").select("item_id", F.col("asked_in").alias("there"))
    rows = claimed.join(at_home, ["item_id", "asked_in"])
    other = rows.join(elsewhere, "item_id").where("there <> asked_in").select("item_id", "asked_in", F.lit(True).alias("else")).distinct()
    rows = rows.join(other, ["item_id", "asked_in"], "left")
    violation = (
        F.when((F.col("kind") == "out-of-corpus") & (F.col("is") == "answerable"), "stands in its own jurisdiction")
        .when((F.col("kind") == "out-of-corpus") & F.col("else"), "stands in another jurisdiction")
        .when((F.col("kind") == "out-of-jurisdiction") & (F.col("is") == "answerable"), "answerable where it was asked")
        .when((F.col("kind") == "out-of-jurisdiction") & F.col("else").isNull(), "answerable nowhere")
    )
    return rows.select("item_id", "asked_in", violation.alias("violation")).where("violation is not null")


def shared(ix: index.Index, benchmark: DataFrame, need: DataFrame, analysers: tuple[str, ...] = T.ANALYSERS) -> DataFrame:
    """item_id, asked_in, analyser, doc_id, lexeme: lexemes of a question in a passage that it needs, whatever its rank."""
    queries = index.query_lexemes(index.questions(benchmark)).where(F.col("analyser").isin(*analysers))
    near = dataclasses.replace(ix, entries=ix.entries.join(index.small(need.select("doc_id").distinct()), "doc_id", "left_semi"))
    asked = index.small(queries.select("analyser", "lexeme").distinct())
    own = index.frequencies(near.counts, analysers).join(asked, ["analyser", "lexeme"], "left_semi").select("doc_id", "analyser", "lexeme").distinct()
    return own.join(need, "doc_id").join(queries, ["item_id", "analyser", "lexeme"]).select("item_id", "asked_in", "analyser", "doc_id", "lexeme")


def matching(ix: index.Index, benchmark: DataFrame, need: DataFrame) -> DataFrame:
    """item_id, analyser, doc_id, n_shared: needed passages that share a lexeme with their question."""
    return shared(ix, benchmark, need).groupBy("item_id", "asked_in", "analyser", "doc_id").agg(F.count("*").alias("n_shared"))


def outcomes(ix: index.Index, benchmark: DataFrame, need: DataFrame, hits: DataFrame, analysers: tuple[str, ...], norms: tuple[int, ...] = rank.NORMS) -> DataFrame:
    """One row per question, jurisdiction and cell: found, missed by kind, first position, leakage; need: ``population``.

    A miss is unreachable if the passage shares no lexeme with the question, else out-ranked. Leaked lexemes are the question's
    that stand in a passage it needs.
    """
    queries = index.query_lexemes(index.questions(benchmark))
    common = shared(ix, benchmark, need, analysers)
    shares = common.groupBy("item_id", "asked_in", "analyser", "doc_id").agg(F.count("*").alias("n_shared"))
    cells = need.sparkSession.createDataFrame([(a, n) for a in analysers for n in norms], "analyser string, norm int")
    grid = need.join(F.broadcast(cells))  # a fixed grid of cells
    grid = grid.join(hits.select("item_id", "asked_in", *CELL, "doc_id", "position"), ["item_id", "asked_in", *CELL, "doc_id"], "left")
    grid = grid.join(shares, ["item_id", "asked_in", "analyser", "doc_id"], "left")
    rows = grid.groupBy("item_id", "asked_in", *CELL).agg(
        F.count("*").alias("n_required"),
        F.count("position").alias("n_found"),
        F.min("position").alias("first_position"),
        F.count(F.when(F.col("position").isNull() & F.col("n_shared").isNull(), 1)).alias("n_unreachable"),
        F.count(F.when(F.col("position").isNull() & F.col("n_shared").isNotNull(), 1)).alias("n_outranked"),
    )
    leaked = common.groupBy("item_id", "asked_in", "analyser").agg(F.countDistinct("lexeme").alias("n_leaked"))
    sizes = queries.groupBy("item_id", "analyser").agg(F.count("*").alias("n_query"))
    return rows.join(sizes, ["item_id", "analyser"], "left").join(leaked, ["item_id", "asked_in", "analyser"], "left").na.fill(0, ["n_query", "n_leaked"])


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Complete-set recall (share of questions with all they need), recall per passage, MRR, misses by kind, leakage."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.sum("n_required").alias("required"),
        F.round(F.avg((F.col("n_found") == F.col("n_required")).cast("double")), 6).alias("complete_set_recall"),
        F.round(F.sum("n_found") / F.sum("n_required"), 6).alias("passage_recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first_position"), F.lit(0.0))), 6).alias("mrr"),
        F.sum("n_unreachable").alias("unreachable"),
        F.sum("n_outranked").alias("outranked"),
        F.round(F.coalesce(F.sum("n_leaked") / F.nullif(F.sum("n_query"), F.lit(0)), F.lit(0.0)), 6).alias("leakage"),
    )


def by_authority(rows: DataFrame) -> DataFrame:
    """Metrics of each cell, pooled (asked_in null) and by jurisdiction, from one pass."""
    rows = rows.withColumn("scope", F.explode(F.array(F.lit(None).cast("string"), F.col("asked_in"))))
    return metrics(rows, *CELL, "scope").withColumnRenamed("scope", "asked_in")


def discordance(rows: DataFrame) -> DataFrame:
    """Each pair of cells: questions that only one of them passes, and the exact McNemar p."""
    name = F.concat_ws("/", *CELL)
    passed = rows.select("item_id", "asked_in", name.alias("cell"), (F.col("n_found") == F.col("n_required")).alias("passed"))
    cells = passed.where("item_id is not null and asked_in is not null").groupBy("item_id", "asked_in").agg(F.collect_list(F.struct("cell", "passed")).alias("cells"))  # a fixed grid
    both = cells.select("cells", F.explode("cells").alias("a")).select("a", F.explode("cells").alias("b")).where("a.cell < b.cell")
    counts = both.groupBy(F.col("a.cell").alias("cell_a"), F.col("b.cell").alias("cell_b")).agg(
        F.count(F.when(F.col("a.passed") & ~F.col("b.passed"), 1)).alias("a_only"), F.count(F.when(~F.col("a.passed") & F.col("b.passed"), 1)).alias("b_only")
    )
    return counts.withColumn("p", F.round(mcnemar(F.col("a_only"), F.col("b_only")), 6))


HIGHER, LOWER = ("complete_set_recall", "passage_recall", "mrr"), ("leakage",)


def regressions(recorded: DataFrame, measured: DataFrame) -> DataFrame:
    """Problems of a run against a recorded one, with no tolerance; empty means that the gate is green.

    A changed set of cells, questions or labels comes first and alone: figures over different things aren't compared.
    """
    both = recorded.alias("r").join(measured.alias("m"), [F.col(f"r.{c}") == F.col(f"m.{c}") for c in CELL], "full_outer")
    cell = F.concat_ws("/", *(F.coalesce(f"r.{c}", f"m.{c}") for c in CELL))
    different = F.when(F.col("m.norm").isNull(), "not measured").when(F.col("r.norm").isNull(), "not recorded").when((F.col("r.questions") != F.col("m.questions")) | (F.col("r.required") != F.col("m.required")), "other labels")
    structure = both.select(cell.alias("cell"), different.alias("metric"), F.lit(None).cast("double").alias("was"), F.lit(None).cast("double").alias("now")).where("metric is not null")
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"r.{m}").alias("was"), F.col(f"m.{m}").alias("now"), F.lit(1.0 if m in HIGHER else -1.0).alias("sign")) for m in HIGHER + LOWER))
    worse = both.select(cell.alias("cell"), F.explode(values).alias("x")).where("x.sign * x.now < x.sign * x.was").select("cell", "x.metric", "x.was", "x.now")
    broken = structure.agg(F.count("*").alias("n_structural"))  # one row
    return structure.unionByName(worse.join(F.broadcast(broken)).where("n_structural = 0").drop("n_structural"))


def hits(ix: index.Index, benchmark: DataFrame, analysers: tuple[str, ...], norms: tuple[int, ...] = rank.NORMS, k: int = rank.K) -> DataFrame:
    return rank.best(ix, benchmark, rank.authorities(ix), analysers, norms, k)


def power(pairs: DataFrame) -> DataFrame:
    """Both triangles of ``discordance``: cell_a, cell_b, d (pairs that differ), p."""
    both = pairs.select("cell_a", "cell_b", "a_only", "b_only", "p").unionByName(pairs.select(F.col("cell_b").alias("cell_a"), F.col("cell_a").alias("cell_b"), F.col("b_only").alias("a_only"), F.col("a_only").alias("b_only"), "p"))
    return both.select("cell_a", "cell_b", (F.col("a_only") + F.col("b_only")).alias("d"), "p")
