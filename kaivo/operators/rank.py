"""Ranking: weighted term frequency without document frequency, inside a hard jurisdiction filter, over a grid of cells.

rank = 0.1 / |Q| * sum over matched lexemes of H2(tf) / zeta(2), divided by a function of the passage's length. Scores are rounded
before they order anything and ties fall to the smaller doc_id, so that the order of a floating sum can't change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kaivo.functions.stats import ZETA2, h2, length_divisor
from kaivo.operators import index, postings

K = 5
NORMS = (0, 1, 2)
POINTS = 1e9


def scored(ix: index.Index, benchmark: DataFrame, authorities: DataFrame | None, analysers: tuple[str, ...]) -> DataFrame:
    """item_id, asked_in, analyser, doc_id, authority, score (before length normalisation), length.

    authorities (asked_in): each question is asked under each; only passages of that jurisdiction are candidates: postings of others
    are left out before anything is counted. None: no jurisdiction at all (the negative control).
    """
    wanted = index.query_lexemes(index.questions(benchmark)).where(F.col("analyser").isin(*analysers))
    return summed(ix.counts, wanted, index.lexicon(ix, wanted, analysers), ix.lengths, authorities, analysers)


def summed(counts: DataFrame, wanted: DataFrame, made: DataFrame, lengths: DataFrame, authorities: DataFrame | None, analysers: tuple[str, ...]) -> DataFrame:
    """``scored`` from its parts: word counts, lexemes of questions (item_id, analyser, lexeme), words that yield them (word, analyser, lexeme), lengths.

    Postings are cut to what the questions ask and dealt by passage once; all that follows stays there, so that scores aren't shuffled.
    Analysers stand side by side in columns until their sums are made.
    """
    if authorities is not None:
        counts = counts.join(index.small(authorities), F.col("authority") == F.col("asked_in"), "left_semi")
    near = counts.join(index.small(made), "word").select("doc_id", "authority", "analyser", "lexeme", "n").repartition("doc_id")
    tf = near.groupBy("doc_id", "authority", "analyser", "lexeme").agg(F.sum("n").alias("tf"))
    met = tf.withColumn("w", h2(F.col("tf"))).join(index.small(wanted), ["analyser", "lexeme"])
    sums = met.groupBy("item_id", "doc_id", "authority").agg(*(F.sum(F.when(F.col("analyser") == a, F.col("w"))).alias(f"w_{a}") for a in analysers))
    sums = sums.join(index._wide(lengths, "doc_id", F.col("length"), analysers, "length"), "doc_id").join(index.small(index._wide(wanted, "item_id", F.lit(1), analysers, "n")), "item_id")
    cells = F.array(*(F.struct(F.lit(a).alias("analyser"), (0.1 * F.col(f"w_{a}") / ZETA2 / F.col(f"n_{a}")).alias("score"), F.col(f"length_{a}").alias("length")) for a in analysers))
    asked_in = F.lit(None).cast("string") if authorities is None else F.col("authority")
    return sums.select("item_id", asked_in.alias("asked_in"), "doc_id", "authority", F.explode(cells).alias("x")).where("x.score is not null").select("item_id", "asked_in", "x.analyser", "doc_id", "authority", "x.score", "x.length")


def ranked(scores: DataFrame, norms: tuple[int, ...] = NORMS, k: int = K) -> DataFrame:
    """item_id, asked_in, analyser, norm, position (from 1, to k), doc_id, authority, rank. Scores are made once for all norms."""
    return placed(pointed(scores, norms), k)


def pointed(scores: DataFrame, norms: tuple[int, ...]) -> DataFrame:
    """HIT columns and asked_in of ``scored``: points of each cell."""
    _checked(norms, 1)
    cells = scores.withColumn("norm", F.explode(F.array(*(F.lit(n) for n in norms))))
    # rounded to whole billionths: order is that of a long, and no decimal is made for the rows that don't stay
    points = F.floor(F.col("score") / length_divisor(F.col("norm"), F.col("length")) * POINTS + 0.5)
    return cells.select("item_id", "asked_in", "analyser", "norm", "doc_id", "authority", points.alias("points"))


#: Questions whose scores are summed in tables of passages and questions; more are joined.
DENSE_ITEMS = 20_000


def best(ix: index.Index, benchmark: DataFrame, authorities: DataFrame | None, analysers: tuple[str, ...], norms: tuple[int, ...] = NORMS, k: int = K) -> DataFrame:
    """``ranked`` of ``scored``: each task scores the passages it reads and keeps the best k of each list, so that neither postings nor scores are shuffled.

    authorities (asked_in): as in ``scored``.
    """
    _checked(norms, k)
    wanted = index.query_lexemes(index.questions(benchmark)).where(F.col("analyser").isin(*analysers)).where("item_id is not null")
    rows = wanted.limit(index.BROADCAST_ROWS + 1).collect()
    if len(rows) > index.BROADCAST_ROWS or len({r.item_id for r in rows}) > DENSE_ITEMS:
        return ranked(scored(ix, benchmark, authorities, analysers), norms, k)
    entries = ix.entries.where("doc_id is not null").select("doc_id", "authority", "words", "n", *(f"length_{a}" for a in analysers))
    if authorities is not None:
        entries = entries.join(index.small(authorities), F.col("authority") == F.col("asked_in"), "left_semi")
    run = postings.best(postings.wanted([tuple(r) for r in rows], analysers), analysers, norms, k, authorities is None)
    asked_in = F.lit(None).cast("string") if authorities is None else F.col("authority")
    return placed(entries.mapInArrow(run, HIT).withColumn("asked_in", asked_in), k)


HIT = "item_id long, analyser string, norm int, doc_id long, authority string, points long"


def placed(found: DataFrame, k: int) -> DataFrame:
    """The columns of ``ranked``, of points."""
    _checked((), k)
    # a number leads the sort key, so that rows of different lists are told apart without comparing strings
    keys = ("item_id", "asked_in", "analyser", "norm")
    order = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(F.desc("points"), F.asc("doc_id"))
    first = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return first.select(*keys, "position", "doc_id", "authority", F.round(F.col("points") / POINTS, 6).alias("rank"))


def _checked(norms: tuple[int, ...], k: int) -> None:
    if k < 1:
        raise ValueError("k must be 1 or more")
    if not set(norms) <= set(NORMS):
        raise ValueError(f"unknown normalisation among {norms}")


def authorities(ix: index.Index) -> DataFrame:
    """asked_in: every jurisdiction."""
    return ix.chunks.where("authority is not null").select(F.col("authority").alias("asked_in")).distinct()


def ask(documents: DataFrame, question: str, authority: str, analyser: str = "stem", norm: int = 0, k: int = K) -> DataFrame:
    """One ad-hoc question, by the ranking that is measured. A blank question or authority is refused."""
    if not question.strip() or not authority.strip():
        raise ValueError("a question and an authority are needed")
    spark = documents.sparkSession
    one = spark.createDataFrame([(0, question)], "item_id long, text string")
    where = spark.createDataFrame([(authority,)], "asked_in string")
    here = documents.where(F.col("lang") == authority)  # reaches the scan
    return best(index.of(here), one, where, (analyser,), (norm,), k)
