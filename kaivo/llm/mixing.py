"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the exponential key -ln(u) / w: u is uniform, from a hash of the document, and w is its quality weight. In
each source documents count in ascending key. A source whose target is above its size gives complete epochs first; the rest of
its target is a prefix of that order, cut inside the document where the budget ends. The prefix sums are taken in steps: over
BUCKETS ranges of keys, then over as many of the one range per source where the budget ends, then over the documents of the one
range of that, so that no task orders a whole source, whatever its keys; a document's share then follows from its own key and
its source's cut, without moving text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kaivo.llm.scratch import written

#: Weights of the sources in order of their names, repeating; a target is at most LIMIT times its source's size.
WEIGHTS, LIMIT = (5, 2, 1), 3
SEED = "mix-1"
#: Ranges of a source's keys in each of two steps.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1: the share of characters that aren't symbols, to the fourth power."""
    plain = F.length(F.translate(text, "#*$%&|<>!{}[]=_~^\\", "")) / F.greatest(F.length(text), F.lit(1))
    return F.round(F.coalesce(F.greatest(F.lit(0.1), plain * plain * plain * plain), F.lit(0.1)), 4)


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from the document alone."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, and w (the quality weight)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size(text).alias("size"), quality(text).alias("w"), uniform(F.col("doc_id").cast("long"), text).alias("u"))
    return rows.select("doc_id", "source", "size", (-F.log("u") / F.col("w")).alias("key"), "w")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """source, n, mean_w, source_size, weight, target: one row for each source.

    Targets share the sum of all sizes by weight; what is above limit * source_size is shared again among the others, until
    none is above. That ends with target = least(limit * source_size, level * weight) for one level: sources in order of
    limit * source_size / weight are filled up one after the other until the level of the rest lies below the next one's.
    """
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("w").alias("mean_w"), F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int")))
    sums = sums.withColumn("most", F.col("source_size") * float(limit)).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, from_here, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    sums = sums.withColumn("level", level)
    sums = sums.withColumn("level", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(whole))
    return sums.select("source", "n", "mean_w", "source_size", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))


def _ending(placed: DataFrame) -> DataFrame:
    """s, b, before, low, high: the bucket of each source in which its budget ends, what lies before it, and its smallest and largest key."""
    sums = placed.groupBy("source", "bucket", "budget", "before").agg(F.sum("size").alias("sum"), F.min("key").alias("low"), F.max("key").alias("high"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("sum").over(upto), F.lit(0))).where("before <= budget and budget < before + sum")
    return ends.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "low", "high")


def _inside(placed: DataFrame, ends: DataFrame) -> DataFrame:
    return placed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """One row for each source: source, source_size, target, epochs, cut (key where the budget ends) and cut_share (of the documents there).

    rows: as ``keyed`` gives them, a written table.
    """
    goals = written(targets(rows, weights, limit), "targets")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    goals = goals.withColumn("budget", F.greatest(F.lit(0).cast("long"), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    by = goals.select(F.col("source").alias("s"), "mean_w", "budget")
    at = F.least(F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("key") * F.col("mean_w")))), F.lit(BUCKETS - 1)).cast("long")
    placed = rows.join(F.broadcast(by) if goals.count() < 100_000 else by, F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", at).select("source", "bucket", "key", "size", "budget")
    first = _ending(placed.withColumn("before", F.lit(0).cast("long")))
    near = _inside(placed, first)
    fine = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0).cast("long")
    near = near.withColumn("bucket", fine)
    last = _inside(near.drop("before", "low", "high"), _ending(near))
    last = last.groupBy("source", "budget", "before", "key").agg(F.sum("size").alias("at_key"))
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = last.withColumn("sum", F.col("before") + F.coalesce(F.sum("at_key").over(inside), F.lit(0))).where("sum <= budget and budget < sum + at_key")
    cut = cut.select(F.col("source").alias("s"), F.col("key").alias("cut"), ((F.col("budget") - F.col("sum")) / F.col("at_key")).alias("cut_share"))
    # a source whose budget is all it has (by rounding) has no cut: everything counts
    return goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", F.coalesce("cut", F.when(F.col("budget") > 0, F.lit(float("inf"))).otherwise(F.lit(-1.0))).alias("cut"), F.coalesce("cut_share", F.lit(0.0)).alias("cut_share"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): what the mix takes of it.

    doc_id, size (words), source_size, target (its source's), epochs (complete copies), rest (words of one more, 0 to size), taken
    (epochs * size + rest), key. A null text has size 0; null is a source of its own, last in order. Repeated rows have one key:
    a cut among them takes the same share of each. An empty table gives no rows; other columns are ignored. Reruns agree.
    """
    rows = written(keyed(docs), "keys")
    goals = written(plan(rows, weights, limit), "plan").withColumnRenamed("source", "s")
    goals = F.broadcast(goals) if goals.count() < 100_000 else goals
    key, cut = F.col("key"), F.col("cut")
    rest = F.when(key < cut, F.col("size")).when(key == cut, F.round(F.col("size") * F.col("cut_share")).cast("long")).otherwise(F.lit(0))
    return rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "epochs", rest.cast("long").alias("rest"), (F.col("epochs") * F.col("size") + rest).cast("long").alias("taken"), "key")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as it takes them.

    A document's last copy may be cut to its first words (joined by single blanks); only where the budget ends. A document without
    words is in no source's budget and comes once.
    """
    names = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    text, doc_id, source = (F.col(f"row.`{c}`") for c in ("text", "doc_id", "source"))
    own = own.withColumn("size", size(text.cast("string"))).withColumn("key", -F.log(uniform(doc_id.cast("long"), text.cast("string"))) / quality(text.cast("string")))
    goals = written(plan(written(keyed(docs), "keys"), weights, limit), "plan")
    goals = F.broadcast(goals) if goals.count() < 100_000 else goals
    rest = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.round(F.col("size") * F.col("cut_share")).cast("long")).otherwise(F.lit(0)).cast("long")
    own = own.join(goals.withColumnRenamed("source", "s"), source.cast("string").eqNullSafe(F.col("s"))).withColumn("rest", rest)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int")
    own = own.withColumn("copies", copies).where("copies > 0").select("row", "size", "epochs", "rest", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    part = (F.col("copy") > F.col("epochs")) & (F.col("rest") < F.col("size"))
    cut_text = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, F.col("rest").cast("int")), " ")
    return own.select(*(F.when(part, cut_text).otherwise(text).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names))
