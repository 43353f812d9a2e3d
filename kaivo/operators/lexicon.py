"""A morphological lexicon as a table: readings of words by join, lexemes of compounds, phrases with alternatives, lemma cells of the grid.

Words are analysed once each, not at each place where they stand, so the lexicon meets a table of distinct words and the corpus only an
equi-join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaivo.functions import morphology as M
from kaivo.functions import text as T
from kaivo.operators import index, postings, rank
from kaivo.operators.evaluate import require_empty

ANALYSERS = ("base", "safe", "reasm")
ABSENCE = "base"


def readings(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, baseform, bases: every analysis (word, baseform, bases) of distinct words (word); one row of nulls for a word without any."""
    return words.select("word").distinct().join(lexicon.where("baseform is not null").select("word", "baseform", "bases").distinct(), "word", "left")


def lexemes(words: DataFrame, lexicon: DataFrame, analysers: tuple[str, ...] = ANALYSERS) -> DataFrame:
    """word, analyser, lexeme: distinct; a word without a reading is its own lexeme."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, a, x) for w, r in zip(batch["word"], batch["r"], strict=True) for a in analysers for x in M.word_lexemes(w, [(y["baseform"], y["bases"]) for y in r], a)]
            yield pd.DataFrame(rows, columns=["word", "analyser", "lexeme"])

    return _known(words, lexicon).mapInPandas(run, "word string, analyser string, lexeme string")


def _known(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, r: its readings, a few."""
    known = readings(words, lexicon).groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("baseform").isNotNull(), F.struct("baseform", "bases")))).alias("r"))
    return known.where("word is not null")


def _coded(words: DataFrame, lexicon: DataFrame, place: dict[str, dict[str, int]], base: int) -> DataFrame:
    """word, k, ids: how many lexemes each analyser makes of a word, and the codes (i * base + place, for the analyser i) of those that have a place."""
    analysers = tuple(place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, r in zip(batch["word"], batch["r"], strict=True):
                made = [M.word_lexemes(w, [(y["baseform"], y["bases"]) for y in r], a) for a in analysers]
                out.append((w, [len(x) for x in made], [i * base + at for i, (a, x) in enumerate(zip(analysers, made, strict=True)) for y in x if (at := place[a].get(y)) is not None]))
            yield pd.DataFrame(out, columns=["word", "k", "ids"])

    return _known(words, lexicon).mapInPandas(run, "word string, k array<int>, ids array<int>")


def _looked_up(entries: DataFrame, table: DataFrame) -> DataFrame:
    """Entries by block, each block behind what ``table`` makes of its words: words go to the table once a block, not once a passage, and postings not at all."""
    own = entries.select("block", "words").mapInArrow(postings.block_words, "block long, word string")
    met = own.join(table.hint("shuffle_hash"), "word").select("block", F.lit(0).alias("kind"), "word", "k", "ids")
    rows = entries.select("block", F.lit(1).alias("kind"), "doc_id", "authority", "words", "n")
    return met.unionByName(rows, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")


def gaps(probes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word: probe words that the lexicon can't read."""
    return readings(probes, lexicon).where("baseform is null").select("word")


def assert_present(probes: DataFrame, lexicon: DataFrame) -> None:
    """A lexicon that reads none of the probes, or is empty, would turn every lemma cell into a worse index of plain words: refused."""
    require_empty(gaps(probes, lexicon), "the lexicon is missing or damaged, it can't read")


def needle_lemmas(needles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """item_id, ord, lexeme: every lemma that a phrase's (item_id, text) word may have, in the order of its words; input of ``index.phrase_hits``."""
    placed = needles.select("item_id", F.posexplode(T.words(F.col("text"))).alias("ord", "word"))
    return placed.join(lexemes(placed, lexicon, (ABSENCE,)), "word").select("item_id", "ord", "lexeme")


def probe_table(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, baseform, reasm: what the analysers make of each word, sorted; reasm only where it differs."""
    x = lexemes(words, lexicon).groupBy("word").pivot("analyser", ["base", "reasm"]).agg(F.array_join(F.array_sort(F.collect_set("lexeme")), " "))
    return x.select("word", F.col("base").alias("baseform"), F.when(F.col("reasm") != F.col("base"), F.col("reasm")).alias("reasm"))


def positions(ix: index.Index, lexicon: DataFrame, analysers: tuple[str, ...] = ANALYSERS) -> DataFrame:
    """analyser, doc_id, length: index positions of each passage that has any, a word counting once for each of its lexemes."""
    table = _coded(ix.words, lexicon, {a: {} for a in analysers}, 1)
    n = _looked_up(ix.entries, table).mapInArrow(postings.lengths_by(analysers), f"analyser string, doc_id {dict(ix.entries.dtypes)['doc_id']}, length long")
    if ix.entries.where("shared").head(1):  # jurisdictions share ids
        n = n.groupBy("analyser", "doc_id").agg(F.sum("length").alias("length"))
    return n.where("length > 0")


def hits(ix: index.Index, benchmark: DataFrame, lexicon: DataFrame, norms: tuple[int, ...] = rank.NORMS, k: int = rank.K) -> DataFrame:
    """The grid's ranking with lemma analysers instead of the built-in ones: the columns of ``rank.ranked``.

    Questions' lexemes are found first, by their own words' readings; then each task ranks the blocks that it gets and keeps the best.
    """
    asked = benchmark.select("item_id", F.explode(T.kept(F.col("text"))).alias("word")).where("item_id is not null").distinct()
    near = lexicon.join(index.small(asked.select("word").distinct()), "word", "left_semi")
    wanted = asked.join(lexemes(asked, near), "word").select("item_id", "analyser", "lexeme").distinct()
    rows = wanted.limit(index.BROADCAST_ROWS + 1).collect()
    if len(rows) > index.BROADCAST_ROWS or len({r.item_id for r in rows}) > rank.DENSE_ITEMS:
        return rank.placed(_joined(ix, ix.counts, wanted, lexicon, norms), k)
    want = postings.wanted([tuple(r) for r in rows], ANALYSERS)
    place = {a: {x: i for i, x in enumerate(want.lexemes[a])} for a in ANALYSERS}
    base = 1 + max(map(len, place.values()))
    entries = ix.entries.where("authority is not null and doc_id is not null")
    alone = _looked_up(entries.where("not shared"), _coded(ix.words, lexicon, place, base)).mapInArrow(postings.best_by(want, ANALYSERS, norms, k, base), rank.HIT)
    found = alone.withColumn("asked_in", F.col("authority"))
    if entries.where("shared").head(1):
        found = found.unionByName(_joined(ix, index.Index(entries.where("shared"), ix.chunks).counts, wanted, lexicon, norms))
    return rank.placed(found, k)


def _joined(ix: index.Index, counts: DataFrame, wanted: DataFrame, lexicon: DataFrame, norms: tuple[int, ...]) -> DataFrame:
    """The same by joins: for more questions than fit a task's tables, and for ids that jurisdictions share."""
    made = lexemes(ix.words, lexicon).join(wanted, ["analyser", "lexeme"], "left_semi")
    return rank.pointed(rank.summed(counts, wanted, made, positions(ix, lexicon), rank.authorities(ix), ANALYSERS), norms)
