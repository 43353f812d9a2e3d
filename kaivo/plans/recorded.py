"""Registered queries on recorded answers, labels, controls, tokens and the lexicon, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaivo.functions import text as T
from kaivo.operators import contracts, judged, ledger, lexicon, offline, structure
from kaivo.plans import catalog, oracles
from kaivo.plans.catalog import query, table

SHAPES = ("0-0", "0-1", "1-0", "1-1")


def _to_label(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("qid"), (F.col("item_id") % 3 + 1).alias("n_branches"), (F.col("item_id") % 2).alias("n_forbidden"))
    return offline.to_label(q, b.where("item_id % 9 <> 4").select(F.col("item_id").alias("qid"), (F.col("item_id") % 4 == 0).alias("refused")))


@query
def questions_to_label(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark as questions; each ninth has no recorded answer, each fourth a refusal."""
    return _to_label(spark, d)


@query
def forced_units(spark: SparkSession, d: str) -> DataFrame:
    return offline.forced_units(_to_label(spark, d))


@query
def judge_unit_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels as a human's units, rules over ids as a judge's; some have no verdict, some two."""
    x = table(spark, d, "labels").select(F.col("doc_id").alias("qid"), "quality", "toxic")
    both = lambda branch, forbidden: F.explode(F.array(branch, forbidden))
    unit = lambda name, stated: F.struct(F.lit(name).alias("unit"), F.lit(1).alias("idx"), stated.alias("stated"))
    human = x.select("qid", both(unit("branch", F.col("quality") == 1), unit("forbidden", F.lit(None).cast("boolean"))).alias("u")).select("qid", "u.*")
    said = human.where("qid % 13 <> 0").select("qid", "unit", "idx", (F.col("qid") % 2 == 0).alias("stated"), (F.col("qid") % 3 == 0).alias("supported"), (F.col("qid") % 5 == 0).alias("asserted"))
    return offline.judge_labels(human, said.unionByName(said.where("qid % 17 = 0")))


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    i = F.col("item_id")
    passages = F.array(i.cast("string"), (i + 1).cast("string"))
    asked = b.select(i.alias("qid"), F.when(i % 3 == 0, "refusal").otherwise("answerable").alias("population"), F.when(i % 3 == 0, F.when(i % 2 == 0, "out-of-corpus").otherwise("out-of-jurisdiction")).alias("kind"), passages.alias("required"))
    said = b.where(i % 10 != 3).select(i.alias("qid"), F.when(i % 3 == 0, "refusal").otherwise("answerable").alias("population"), (i % 5 < 2).alias("refused"), F.when(i % 4 < 2, passages).otherwise(F.slice(passages, 1, 1)).alias("retrieved"))
    more = said.where("qid % 7 = 0").select((-F.col("qid") - 1).alias("qid"), F.when(F.col("qid") % 2 == 0, "refusal").otherwise("answerable").alias("population"), "refused", "retrieved")
    return offline.refusal_outcomes(asked, said.unionByName(more))


@query
def refusals_offline(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark as both populations against a recording with answers that lack or that nobody asked for."""
    return _recorded(spark, d)


@query
def refusals_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return offline.refusals_by_kind(_recorded(spark, d))


@query
def refusal_offenders(spark: SparkSession, d: str) -> DataFrame:
    return offline.refusal_offenders(_recorded(spark, d))


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "labels")
    i = F.col("doc_id")
    cases = x.select(i.cast("string").alias("case_id"), F.when(i % 23 == 0, -1).otherwise(i % 2).alias("qid"), F.when(i % 17 == 0, "other").otherwise(F.concat_ws("-", "quality", "toxic")).alias("shape"), F.when(i % 19 == 0, " ").otherwise("an answer").alias("answer"), "doc_id")
    must = x.where(i % 31 != 0).select(i.cast("string").alias("case_id"), F.lit("branch").alias("unit"), (i % 4).cast("int").alias("idx"), F.lit("stated").alias("field"), (F.col("toxic") == 1).alias("expect"))
    return cases, must


@query
def control_problems(spark: SparkSession, d: str) -> DataFrame:
    """Labels as known-bad cases, many of them broken; the last of two jurisdictions' shapes left out."""
    cases, must = _cases(spark, d)
    cases = cases.where("not (qid = 1 and shape = '0-1')")
    asked = spark.createDataFrame([(0, "a", 2, 0), (1, "b", 3, 0)], "qid long, authority string, n_branches int, n_forbidden int")
    twice = cases.where("doc_id % 29 = 0")
    return offline.control_problems(cases.unionByName(twice).drop("doc_id"), must.join(cases.select("case_id"), "case_id", "left_semi"), asked, SHAPES)


@query
def control_expectations(spark: SparkSession, d: str) -> DataFrame:
    """What must be caught against verdicts made from the ids: cases caught and missed expectations by shape."""
    cases, must = _cases(spark, d)
    said = must.where("idx > 0").select("case_id", "unit", "idx", "field", (F.col("idx") == 1).alias("value"))
    return offline.control_outcomes(cases, must, said).groupBy("shape").agg(F.count("*").alias("cases"), F.count(F.when(F.col("caught"), 1)).alias("caught"), F.sum("missed").alias("missed"))


@query
def limited_run(spark: SparkSession, d: str) -> DataFrame:
    """A run cut to ten answers says so."""
    return offline.limited(table(spark, d, "benchmark").select("item_id"), 10, "item_id")


@query
def judged_metrics(spark: SparkSession, d: str) -> DataFrame:
    return judged.judged_metrics(catalog._judged_units(spark, d))


@query
def judged_blocks(spark: SparkSession, d: str) -> DataFrame:
    units, _ = judged.agreement(*catalog._raters(spark, d))
    per = units.groupBy("field").agg(F.count("*").alias("units"), F.count(F.when(F.col("a").eqNullSafe(F.col("b")), 1)).alias("agreed"))
    runs = per.select("field", "units", "agreed", F.lit(0).alias("pending"), F.lit(False).alias("partial"))
    cut = per.select(F.concat("field", F.lit(" of a partial run")).alias("field"), "units", "agreed", F.lit(0).alias("pending"), F.lit(True).alias("partial"))
    none = per.select(F.concat("field", F.lit(" by nobody")).alias("field"), F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("agreed"), F.lit(0).alias("pending"), F.lit(False).alias("partial"))
    return offline.blocks(runs.unionByName(cut).unionByName(none), contracts.AGREEMENT)


@query
def answer_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as raw answers of ten forms, good and broken: what the strict contract makes of them."""
    t = table(spark, d, "conversations")
    h = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(10))
    answer = F.coalesce("text", F.lit(""))
    form = lambda refused, text, citations: F.to_json(F.struct(refused.alias("refused"), text.alias("answer"), citations.alias("citations")))
    some = F.array(F.lit("a@1"), F.lit("a@2"))
    good = form(h == 0, answer, F.when(h == 1, F.array().cast("array<string>")).otherwise(some))
    raw = F.when(h == 3, " ").when(h == 4, F.concat(F.lit("{"), F.substring(good, 2, 5))).when(h == 5, "[1]").when(h == 6, '{"refused": false, "answer": "x"}')
    raw = raw.when(h == 7, form(F.lit("yes"), answer, some)).when(h == 8, form(F.lit(False), F.lit(5), some)).when(h == 9, '{"refused": true, "answer": "x", "citations": [1]}').otherwise(good)
    x = offline.envelopes(t.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), raw.alias("raw")))
    return x.groupBy("problem", "refused").agg(F.count("*").alias("answers"), F.coalesce(F.sum(F.size("citations")), F.lit(0)).cast("long").alias("citations"), F.coalesce(F.sum(F.length("answer")), F.lit(0)).cast("long").alias("chars"))


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").alias("token"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") == "error").alias("refund"))
    first = e.groupBy("token").agg(F.min("ts").alias("issued_at")).where("token % 10 <> 9")
    return e, first.select("token", "issued_at", (F.col("issued_at") + F.expr("interval 20 days")).alias("expires_at"), F.when(F.col("token") % 7 == 0, F.col("issued_at") + F.expr("interval 5 days")).alias("revoked_at"))


@query
def token_gate(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests, errors as refunds; each tenth token is unknown, each seventh is revoked after five days."""
    requests, issued = _tokens(spark, d)
    return ledger.gate(requests, issued)


@query
def tokens_newest(spark: SparkSession, d: str) -> DataFrame:
    """The 20 tokens issued last, as a person lists them."""
    return ledger.newest(_tokens(spark, d)[1], 20).select("token", F.date_format("issued_at", "yyyy-MM-dd HH:mm:ss").alias("issued_at"))


@query
def addresses_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Passages in the order of their addresses; within a clause the one without a sub key first."""
    x = table(spark, d, "documents").select(F.col("lang").alias("authority"), F.col("source").alias("clause"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("sub"))
    return x.orderBy("authority", "clause", F.asc_nulls_first("sub"))


@query
def jurisdiction_status(spark: SparkSession, d: str) -> DataFrame:
    """Nations as places, regions as authorities; some are covered in part, by two, or by nobody."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("place"), F.col("n_regionkey").cast("string").alias("authority"), "n_nationkey")
    k = F.col("n_nationkey")
    covers = n.where(k % 5 != 3).withColumn("part", F.when(k % 5 == 1, "north")).unionByName(n.where(k % 5 == 2).withColumn("authority", F.lit("other")).withColumn("part", F.lit(None).cast("string")))
    asked = table(spark, d, "customer").join(n, F.col("c_nationkey") == k).select(F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.initcap("place")).alias("place"))
    return contracts.resolve(asked, covers.drop("n_nationkey")).groupBy("place", "status", "authority").agg(F.count("*").alias("asked"))


@query
def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("place"), F.col("n_regionkey").cast("string").alias("authority"), F.col("n_nationkey").alias("k"), F.lit(None).cast("string").alias("part"))
    extra = n.where("k % 5 = 1").withColumn("part", F.lit("north")).unionByName(n.where("k % 5 = 2").withColumn("authority", F.lit("other"))).unionByName(n.where("k % 5 = 3").withColumn("place", F.lower("place")))
    return contracts.manifest_problems(n.unionByName(extra).drop("k"))


@query
def edition_problems(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.translate("text", "0123456789", "")).otherwise(F.concat(F.translate(F.coalesce("text", F.lit("")), "0123456789", ""), F.lit(" from "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(".6.2024")))
    return contracts.edition_problems(x.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.lit("2024-06-02").cast("date")).alias("day")), x.select("doc_id", text.alias("text")))


@query
def passage_units(spark: SparkSession, d: str) -> DataFrame:
    """Clauses with their headings and definitions with their keys, as they are indexed."""
    x = structure.chunks(catalog.clause_split(spark, d))
    return x.select("doc_id", F.col("clause").cast("long").alias("clause"), "sub", "citation", F.md5("text").alias("text"))


@query
def phrasing_counts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.groupBy(F.when(F.contains("text", F.lit("?")), "question").when(F.contains("text", F.lit(",")), "clauses").otherwise("plain").alias("phrasing")).agg(F.count("*").alias("questions"))


@query
def authority_places(spark: SparkSession, d: str) -> DataFrame:
    """Each authority's places, sorted and distinct, as a person chooses from them."""
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("places"))


@query
def whole_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a number and an address that must stay whole."""
    t = T.tokens(F.concat("text", F.lit(" see 840-1 and https://example.org/a-b?c=1. End")))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query
def run_json(spark: SparkSession, d: str) -> DataFrame:
    """Each question's hits as nested JSON, as a run is written."""
    h = catalog._hits(spark, d, norms=(0,)).groupBy("item_id", "asked_in").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id"))).alias("hits"))  # k at most
    return h.select("item_id", "asked_in", F.to_json(F.struct("item_id", "asked_in", "hits")).alias("json"))


def _lexicon(words: DataFrame) -> DataFrame:
    """A stand-in lexicon over distinct words: a light stem as base form, halves of long words as parts, an ending as an affix; short words are unknown."""
    w, half = F.col("word"), (F.length("word") / 2).cast("int")
    left, right = F.substring(w, F.lit(1), half), F.substring(w, half + 1, F.length("word"))
    head, tail = F.substring(w, 1, 5), F.substring(w, F.lit(6), F.length("word"))
    two = F.concat(F.lit("+"), left, F.lit("("), left, F.lit(")+"), right, F.lit("("), right, F.lit(")"))
    ending = F.concat(F.lit("+"), head, F.lit("("), head, F.lit(")+"), tail, F.lit("(+"), tail, F.lit(")"))
    known = words.where("length(word) >= 4").select("word").distinct()
    first = known.select("word", T.stem(w).alias("baseform"), F.when(F.length("word") >= 10, two).when(F.length("word") >= 6, ending).alias("bases"))
    return first.unionByName(known.where("length(word) % 4 = 0").select("word", w.alias("baseform"), F.lit(None).cast("string").alias("bases")))


def _asked_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word"))


@query
def lexicon_readings(spark: SparkSession, d: str) -> DataFrame:
    w = _asked_words(spark, d)
    return lexicon.readings(w, _lexicon(w)).select("word", "baseform", "bases")


@query
def lexicon_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = _asked_words(spark, d)
    return lexicon.gaps(w, _lexicon(w))


@query
def needle_lemmas(spark: SparkSession, d: str) -> DataFrame:
    x = lexicon.needle_lemmas(table(spark, d, "benchmark"), _lexicon(_asked_words(spark, d)))
    return x.select("item_id", F.col("ord").cast("long").alias("ord"), "lexeme")


@query
def probe_table(spark: SparkSession, d: str) -> DataFrame:
    w = _asked_words(spark, d)
    return lexicon.probe_table(w, _lexicon(w))


@query
def lemma_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Index positions of each passage under the lemma analysers."""
    ix = catalog._with_words(spark, d)
    return lexicon.positions(ix, _lexicon(ix.words))


@query
def lemma_topk(spark: SparkSession, d: str) -> DataFrame:
    """The grid over the lemma analysers."""
    ix = catalog._with_words(spark, d)
    return lexicon.hits(ix, table(spark, d, "benchmark"), _lexicon(ix.words.unionByName(_asked_words(spark, d))))


_HALF = "(length(w) // 2)::INT"
_BASE = f"CASE WHEN length(w) < 4 THEN [w] WHEN length(w) % 4 = 0 THEN list_distinct([{oracles.STEM}, w]) ELSE [{oracles.STEM}] END"
_SAFE = f"CASE WHEN length(w) >= 10 THEN list_concat({_BASE}, [left(w, {_HALF}), substr(w, {_HALF} + 1)]) ELSE {_BASE} END"
_REASM = f"CASE WHEN length(w) BETWEEN 6 AND 9 THEN list_concat({_BASE}, [w]) ELSE {_SAFE} END"


def _lemmas(name: str, source: str, keys: str) -> str:
    parts = (f"SELECT {keys}, '{a}' AS analyser, unnest(list_distinct({x})) AS lexeme FROM {source}" for a, x in (("base", _BASE), ("safe", _SAFE), ("reasm", _REASM)))
    return f"{name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def _in_lemmas(sql: str) -> str:
    """The same SQL with the lemma analysers in the place of the built-in ones."""
    for name, source, keys in (("occ", "tok", "doc_id, authority, position"), ("qocc", "qtok", "item_id")):
        was = oracles.lexemes(name, source, keys)
        assert was in sql
        sql = sql.replace(was, _lemmas(name, source, keys))
    return sql


_ASKED = f"asked AS (SELECT DISTINCT unnest({oracles.words('text')}) AS w FROM benchmark)"
_OUTCOMES = """b AS (SELECT item_id AS i, item_id % 3 = 0 AS r, item_id % 5 < 2 AS refused FROM benchmark),
o AS (SELECT i AS qid, CASE WHEN r THEN 'refusal' ELSE 'answerable' END AS population, CASE WHEN r THEN CASE WHEN i % 2 = 0 THEN 'out-of-corpus' ELSE 'out-of-jurisdiction' END END AS kind,
        CASE WHEN i % 10 <> 3 THEN refused END AS refused, CASE WHEN NOT r THEN i % 4 < 2 END AS complete, CASE WHEN i % 10 = 3 THEN 'not answered' END AS problem FROM b WHERE i % 10 <> 3 OR r
    UNION ALL SELECT -i - 1, NULL, NULL, refused, NULL, CASE WHEN i % 2 = 0 THEN 'not asked' ELSE 'unknown question' END FROM b WHERE i % 7 = 0 AND i % 10 <> 3)"""
_LOW, _HIGH = oracles._wilson("correct", "refusals")
_CASES = """c AS (SELECT doc_id AS i, CASE WHEN doc_id % 23 = 0 THEN -1 ELSE doc_id % 2 END AS qid, CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE concat_ws('-', quality, toxic) END AS shape, toxic = 1 AS expect FROM labels)"""
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"

SQL = {
    "questions_to_label": """SELECT item_id AS qid, CASE WHEN item_id % 9 <> 4 THEN item_id % 4 = 0 END AS refused, item_id % 3 + 1 + item_id % 2 AS units, item_id % 9 <> 4 AND item_id % 4 = 0 AS forced, CASE WHEN item_id % 9 = 4 THEN 'no answer' END AS problem FROM benchmark""",
    "forced_units": """WITH q AS (SELECT item_id % 3 + 1 + item_id % 2 AS n, item_id % 9 = 4 AS missing, item_id % 9 <> 4 AND item_id % 4 = 0 AS forced FROM benchmark)
        SELECT count(*) AS questions, count(*) FILTER (NOT missing AND NOT forced) AS informative, sum(n)::BIGINT AS units, coalesce(sum(n) FILTER (forced), 0)::BIGINT AS forced_units, count(*) FILTER (missing) AS missing FROM q""",
    "judge_unit_labels": """WITH u AS (SELECT doc_id AS qid, unnest(['branch', 'forbidden']) AS unit, quality = 1 AS human FROM labels),
        p AS (SELECT *, CASE WHEN qid % 13 = 0 THEN 'no verdict' WHEN qid % 17 = 0 THEN 'several verdicts' END AS problem FROM u)
        SELECT qid, unit, 1 AS idx, NULL AS field, NULL::BOOLEAN AS value, problem FROM p WHERE problem IS NOT NULL
        UNION ALL SELECT qid, unit, 1, 'stated', qid % 2 = 0, NULL FROM p WHERE problem IS NULL AND unit = 'branch'
        UNION ALL SELECT qid, unit, 1, 'supported', qid % 3 = 0, NULL FROM p WHERE problem IS NULL AND unit = 'branch' AND human
        UNION ALL SELECT qid, unit, 1, 'asserted', qid % 5 = 0, NULL FROM p WHERE problem IS NULL AND unit = 'forbidden'""",
    "refusals_offline": f"WITH {_OUTCOMES} SELECT * FROM o",
    "refusals_by_kind": f"""WITH {_OUTCOMES}, s AS (SELECT kind, count(*) AS refusals, count(*) FILTER (refused) AS correct FROM o WHERE problem IS NULL AND population = 'refusal' GROUP BY ROLLUP (kind))
        SELECT kind, refusals, correct, round(correct / refusals, 6) AS recall, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM s WHERE refusals > 0""",
    "refusal_offenders": f"""WITH {_OUTCOMES} SELECT qid, kind, CASE population WHEN 'refusal' THEN 'answered' ELSE 'refused with everything retrieved' END AS offence FROM o
        WHERE problem IS NULL AND ((population = 'refusal' AND NOT refused) OR (population = 'answerable' AND refused AND complete))""",
    "control_problems": f"""WITH {_CASES}, k AS (SELECT * FROM c WHERE NOT (qid = 1 AND shape = '0-1')),
        r AS (SELECT i::VARCHAR AS case_id, unnest(list_filter([CASE WHEN qid < 0 THEN 'unknown question' END, CASE WHEN shape NOT IN {SHAPES} THEN 'unknown shape' END, CASE WHEN i % 19 = 0 THEN 'empty answer' END,
            CASE WHEN i % 31 = 0 THEN 'nothing to catch' END, CASE WHEN i % 31 > 0 AND qid >= 0 AND (i % 4 = 0 OR i % 4 > qid + 2) THEN 'no such unit' END, CASE WHEN i % 29 = 0 THEN 'repeated id' END], lambda x: x IS NOT NULL)) AS problem FROM k)
        SELECT * FROM r UNION SELECT NULL, 'shape ' || s || ' not covered in ' || chr((97 + q)::INT) FROM (SELECT DISTINCT qid AS q FROM k WHERE qid >= 0), (SELECT unnest({list(SHAPES)}) AS s) WHERE (q, s) NOT IN (SELECT (qid, shape) FROM k)
        UNION SELECT NULL, 'fewer than two jurisdictions' WHERE (SELECT count(DISTINCT qid) FROM k WHERE qid >= 0) < 2""",
    "control_expectations": f"""WITH {_CASES}, m AS (SELECT shape, i % 31 > 0 AS any_, i % 4 > 0 AND (i % 4 = 1) = expect AS met FROM c)
        SELECT shape, count(*) AS cases, count(*) FILTER (any_ AND met) AS caught, count(*) FILTER (any_ AND NOT met) AS missed FROM m GROUP BY 1""",
    "limited_run": "SELECT item_id, (SELECT count(*) FROM benchmark) > 10 AS partial FROM benchmark ORDER BY item_id LIMIT 10",
    "judged_metrics": f"""WITH {oracles._TURNS}, t AS (SELECT (conv_id * 7 + turn) % 9 AS h, coalesce(question, '') AS q, coalesce(answer, '') AS a FROM turns), g AS (SELECT *, {oracles.words("q")} AS qw, {oracles.words("a")} AS aw FROM t WHERE h NOT IN (5, 7, 8)),
        u AS (SELECT h % 2 = 0 AND h <> 6 AS stated, h = 0 AS supported, h = 4 AS asserted, a <> '' AS found_a, q <> '' AND contains({_SQUEEZED.format("a")}, {_SQUEEZED.format("q")}) AS found_q,
            CASE WHEN len(qw) = 0 THEN TRUE ELSE list_sum(list_transform(list_distinct(qw), lambda x: least(len(list_filter(qw, lambda y: y = x)), len(list_filter(aw, lambda y: y = x))))) >= len(qw) END AS all_q FROM g)
        SELECT count(*) AS answers, count(*) AS required, count(*) FILTER (stated) AS stated, count(*) FILTER (supported) AS supported, count(*) AS forbidden, round(count(*) FILTER (supported) / nullif(count(*) FILTER (stated), 0), 6) AS groundedness,
            round(count(*) FILTER (stated) / nullif(count(*), 0), 6) AS coverage, round(avg(asserted::INT), 6) AS over_claim_rate, count(*) FILTER (asserted AND NOT found_q AND NOT all_q) AS fabrications, count(*) FILTER ((stated AND NOT found_a) OR (asserted AND NOT found_q AND all_q)) AS splices FROM u""",
    "judged_blocks": f"""WITH {oracles._RATERS}, n AS (SELECT field, avg(same::INT) AS rate FROM units GROUP BY 1)
        SELECT field, CASE WHEN rate >= 0.85 THEN 'published' ELSE 'withheld' END AS block FROM n UNION ALL SELECT field || ' of a partial run', 'diagnostic' FROM n UNION ALL SELECT field || ' by nobody', 'withheld' FROM n""",
    "answer_envelopes": """WITH t AS (SELECT (conv_id * 7 + turn) % 10 AS h, length(coalesce(text, '')) AS n FROM conversations),
        e AS (SELECT h, n, CASE h WHEN 3 THEN 'empty' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'not an object' WHEN 6 THEN 'missing key' WHEN 7 THEN 'wrong type' WHEN 8 THEN 'wrong type' WHEN 9 THEN 'wrong type' END AS problem FROM t)
        SELECT problem, CASE WHEN problem IS NULL THEN h = 0 END AS refused, count(*) AS answers, coalesce(sum(CASE WHEN problem IS NULL AND h <> 1 THEN 2 ELSE 0 END), 0)::BIGINT AS citations, coalesce(sum(CASE WHEN problem IS NULL THEN n END), 0)::BIGINT AS chars FROM e GROUP BY 1, 2""",
    "token_gate": """WITH RECURSIVE f AS (SELECT user_id, min(ts) AS issued FROM events GROUP BY 1),
        e AS (SELECT user_id AS token, event_id AS seq, ts, event_type = 'error' AS refund, CASE WHEN user_id % 10 = 9 THEN 'unknown' WHEN event_type <> 'error' AND user_id % 7 = 0 AND ts >= issued + INTERVAL 5 DAY THEN 'revoked'
            WHEN event_type <> 'error' AND ts >= issued + INTERVAL 20 DAY THEN 'expired' END AS decision FROM events JOIN f USING (user_id)),
        p AS MATERIALIZED (SELECT token, seq, refund, row_number() OVER (PARTITION BY token ORDER BY ts, seq) AS n FROM e WHERE decision IS NULL),
        r AS (SELECT token, 0::BIGINT AS n, NULL::BIGINT AS seq, 0 AS used, NULL::VARCHAR AS decision FROM (SELECT DISTINCT token FROM p)
            UNION ALL SELECT p.token, p.n, p.seq, CASE WHEN refund THEN greatest(used - 1, 0) ELSE least(used + 1, 10) END, CASE WHEN refund THEN CASE WHEN used > 0 THEN 'refunded' ELSE 'nothing to refund' END WHEN used < 10 THEN 'accepted' ELSE 'over_cap' END
                FROM r JOIN p ON p.token = r.token AND p.n = r.n + 1)
        SELECT token, seq, decision FROM r WHERE n > 0 UNION ALL SELECT token, seq, decision FROM e WHERE decision IS NOT NULL""",
    "tokens_newest": "SELECT user_id AS token, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS issued_at FROM events WHERE user_id % 10 <> 9 GROUP BY 1 ORDER BY min(ts) DESC, 1 LIMIT 20",
    "addresses_in_order": "SELECT lang AS authority, source AS clause, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS sub FROM documents ORDER BY 1, 2, 3 NULLS FIRST",
    "jurisdiction_status": """WITH a AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE upper(n_name[1]) || lower(n_name[2:]) END AS place, CASE WHEN c_custkey % 10 = 0 THEN 'blank' ELSE CASE n_nationkey % 5 WHEN 1 THEN 'partial' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unknown' ELSE 'resolved' END END AS status, n_regionkey::VARCHAR AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT place, status, CASE WHEN status = 'resolved' THEN r END AS authority, count(*) AS asked FROM a GROUP BY ALL""",
    "manifest_problems": "SELECT lower(n_name) AS place, CASE n_nationkey % 5 WHEN 1 THEN 'covered in whole and in part' WHEN 2 THEN 'covered by several authorities' ELSE 'listed twice' END AS problem FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)",
    "edition_problems": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no day declared' WHEN doc_id % 4 = 0 THEN 'no day in the document' ELSE 'another day in the document' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 4 = 0 OR doc_id % 3 <> 1",
    "passage_units": """WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g')) AS x FROM documents WHERE doc_id % 4 > 0)
        SELECT doc_id, 1::BIGINT AS clause, NULL AS sub, '1 § Alpha' AS citation, md5(trim('1 § Alpha' || chr(10) || trim('A ' || x))) AS text FROM x UNION ALL SELECT doc_id, 2, 'b', '2 § Beta- rule', md5(trim('B ' || x)) FROM x""",
    "phrasing_counts": "SELECT CASE WHEN contains(text, '?') THEN 'question' WHEN contains(text, ',') THEN 'clauses' ELSE 'plain' END AS phrasing, count(*) AS questions FROM benchmark GROUP BY 1",
    "authority_places": "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS places FROM nation GROUP BY 1",
    "whole_tokens": r"""WITH t AS (SELECT doc_id, regexp_extract_all(text || ' see 840-1 and https://example.org/a-b?c=1. End', 'https?://[^\s]*[\p{L}\p{N}/]|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*') AS t FROM documents)
        SELECT doc_id, CASE WHEN t IS NOT NULL THEN len(t) END AS tokens, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "run_json": f"""WITH {oracles.hits(5, f"{oracles._CONTROL} AND norm = 0")} SELECT item_id, asked_in, to_json({{'item_id': item_id, 'asked_in': asked_in, 'hits': list({{'position': position, 'doc_id': doc_id}} ORDER BY position)}})::VARCHAR AS json FROM hit GROUP BY 1, 2""",
    "lexicon_readings": f"""WITH {_ASKED}, x AS (SELECT w AS word, {oracles.STEM} AS stem, left(w, {_HALF}) AS l, substr(w, {_HALF} + 1) AS r, left(w, 5) AS h, substr(w, 6) AS t FROM asked)
        SELECT DISTINCT word, CASE WHEN length(word) >= 4 THEN stem END AS baseform, CASE WHEN length(word) >= 10 THEN '+' || l || '(' || l || ')+' || r || '(' || r || ')' WHEN length(word) >= 6 THEN '+' || h || '(' || h || ')+' || t || '(+' || t || ')' END AS bases FROM x
        UNION SELECT word, word, NULL FROM x WHERE length(word) >= 4 AND length(word) % 4 = 0""",
    "lexicon_gaps": f"WITH {_ASKED} SELECT w AS word FROM asked WHERE length(w) < 4",
    "needle_lemmas": f"""WITH p AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS ord FROM (SELECT item_id, {oracles.words("text")} AS ws FROM benchmark)) SELECT item_id, ord, unnest(list_distinct({_BASE})) AS lexeme FROM p""",
    "probe_table": f"""WITH {_ASKED}, x AS (SELECT w AS word, array_to_string(list_sort(list_distinct({_BASE})), ' ') AS b, array_to_string(list_sort(list_distinct({_REASM})), ' ') AS r FROM asked) SELECT word, b AS baseform, CASE WHEN r <> b THEN r END AS reasm FROM x""",
    "lemma_lengths": f"WITH {oracles.INDEX.replace(oracles.lexemes('occ', 'tok', 'doc_id, authority, position'), _lemmas('occ', 'tok', 'doc_id, authority, position'))} SELECT * FROM len",
    "lemma_topk": f"WITH {_in_lemmas(oracles.hits())} SELECT * FROM hit",
}
