"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaivo.functions import stats as S
from kaivo.functions import text as T
from kaivo.operators import contracts, evaluate, index, judged, ledger, rank, structure
from kaivo.plans import oracles
from kaivo.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents; a table of fewer files than there are cores (never so at scale) is dealt out, as a file is one task."""
    docs, cores = table(spark, d, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores // 2 else docs


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark")


_folders: dict[tuple[str, ...], str] = {}


def _stored(spark: SparkSession, d: str, name: str, tables: tuple[str, ...], build: Callable[[str], object]) -> str:
    """A folder that ``build`` has filled from these tables, once a session: it lies in the shared folder and is made again if a table changes."""
    jvm, stamps = spark.sparkContext._jvm, []
    for t in tables:
        at = jvm.org.apache.hadoop.fs.Path(f"{d}/{t}.parquet")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stamps += [fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()]
    key = (spark.sparkContext.applicationId, d, name, *map(str, stamps))
    if key not in _folders:
        folder = f"{shared_dir(spark)}/kaivo-index/{name}-{uuid.uuid4().hex}"
        build(folder)
        _folders[key] = folder
    return _folders[key]


def _index(spark: SparkSession, d: str) -> index.Index:
    return index.load(spark, _stored(spark, d, "index", ("documents",), lambda folder: index.store(_docs(spark, d), folder)), table(spark, d, "documents"))


def _with_words(spark: SparkSession, d: str) -> index.Index:
    """The index with its distinct words stored."""
    ix = _index(spark, d)
    folder = _stored(spark, d, "words", ("documents",), lambda folder: ix.words.write.parquet(folder))
    return index.Index(ix.entries, ix.chunks, spark.read.schema("word string").parquet(folder))


def _need(spark: SparkSession, d: str) -> DataFrame:
    """Labels, found in the texts once."""
    folder = _stored(spark, d, "labels", ("documents", "benchmark"), lambda folder: evaluate.population(_index(spark, d), _asked(spark, d)).write.parquet(folder))
    return spark.read.schema("item_id long, asked_in string, doc_id long").parquet(folder)


def _hits(spark: SparkSession, d: str, analysers: tuple[str, ...] = (T.CONTROL,), norms: tuple[int, ...] = rank.NORMS, k: int = rank.K) -> DataFrame:
    """Hits, ranked once a session to the fifth place under all norms."""
    if k > rank.K:
        return evaluate.hits(_index(spark, d), _asked(spark, d), analysers, norms, k)
    folder = _stored(spark, d, f"hits-{'-'.join(analysers)}", ("documents", "benchmark"), lambda folder: evaluate.hits(_index(spark, d), _asked(spark, d), analysers).write.parquet(folder))
    found = spark.read.schema("item_id long, asked_in string, analyser string, norm int, position int, doc_id long, authority string, rank double").parquet(folder)
    return found.where(F.col("norm").isin(*norms) & (F.col("position") <= k))


@query
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("documents"), F.count("source").alias("with_source"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query
def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    p = index.postings(index.passages(_docs(spark, d)), positions=True).where(F.col("analyser") == T.CONTROL)
    return p.select("authority", "doc_id", "lexeme", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query
def lexeme_counts(spark: SparkSession, d: str) -> DataFrame:
    p = index.totals(_index(spark, d))
    control = p.where(F.col("analyser") == T.CONTROL).select(F.col("postings").alias("control"))  # one row
    return p.join(F.broadcast(control)).select("analyser", "postings", "positions", F.round(F.col("postings") / F.col("control"), 6).alias("ratio"))


@query
def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).lengths.select("analyser", "doc_id", F.col("length").cast("long").alias("length"))


@query
def empty_index(spark: SparkSession, d: str) -> DataFrame:
    """Passages without a lexeme, by analyser; a corpus is refused if there are any."""
    return _index(spark, d).lengths.where("length = 0").select("analyser", "doc_id")


@query
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select("lang", F.explode(T.words(F.col("text"))).alias("w"))
    stopped = F.col("w").isin(*T.STOPWORDS)
    return w.groupBy("lang").agg(F.count("*").alias("tokens"), F.count(F.when(stopped, 1)).alias("stopped"), F.countDistinct("w").alias("forms"), F.countDistinct(F.when(stopped, F.col("w"))).alias("stop_forms"))


@query
def query_lexemes(spark: SparkSession, d: str) -> DataFrame:
    return index.query_lexemes(index.questions(_asked(spark, d)))


@query
def index_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """16 hex digits over what the analysers make of the questions' words: a changed analyser can't pass unseen."""
    w = _asked(spark, d).select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    x = w.select("w", F.explode(T.lexemes(F.col("w"))).alias("x")).where("x.lexeme is not null").groupBy("w", "x.analyser").agg(F.array_join(F.array_sort(F.collect_list("x.lexeme")), chr(31)).alias("l"))
    lines = x.select(F.concat_ws("\t", "w", "analyser", "l").alias("line"))
    return lines.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), chr(30)), 256), 1, 16).alias("fingerprint"))


def _topk(norm: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _hits(spark, d, norms=(norm,)).drop("analyser", "norm", "authority")

    run.__name__ = f"lexical_topk_norm{norm}"
    return query(run)


lexical_topk = [_topk(n) for n in rank.NORMS]


@query
def topk_grid(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, T.ANALYSERS)


@query
def topk_without_jurisdiction(spark: SparkSession, d: str) -> DataFrame:
    """The negative control: hits of all jurisdictions, so that leaving the filter out is seen to matter."""
    found = rank.best(_index(spark, d), _asked(spark, d), None, (T.CONTROL,), (0,))
    return found.groupBy("authority").agg(F.count("*").alias("hits"))


@query
def one_authority(spark: SparkSession, d: str) -> DataFrame:
    """Hits outside the jurisdiction that was asked: none."""
    return _hits(spark, d, norms=(0,)).where("authority <> asked_in").select("item_id", "doc_id")


@query
def best_cell(spark: SparkSession, d: str) -> DataFrame:
    """The cell of highest complete-set recall; of equal ones the first of the grid's order."""
    m = evaluate.metrics(_outcomes(spark, d), *evaluate.CELL)
    order = F.struct(-F.col("complete_set_recall"), F.array_position(F.array(*map(F.lit, T.ANALYSERS)), F.col("analyser")), "norm")
    return m.select(F.min_by(F.struct("analyser", "norm", "complete_set_recall"), order).alias("x")).select("x.*", F.lit(1).alias("place"))


@query
def chunks_containing(spark: SparkSession, d: str) -> DataFrame:
    return index.required(_index(spark, d), index.questions(_asked(spark, d)))


@query
def resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    """Questions without any passage."""
    need = _need(spark, d)
    return _asked(spark, d).join(need, "item_id", "left_anti").select("item_id")


@query
def addresses_matching(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.matching(_index(spark, d), _asked(spark, d), _need(spark, d))


@query
def chunk_lexemes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lexemes of the passages that a question needs."""
    ix = _index(spark, d)
    own = index.Index(ix.entries.join(index.small(_need(spark, d).select("doc_id").distinct()), "doc_id", "left_semi"), ix.chunks).counts
    return index.frequencies(own, (T.CONTROL,)).groupBy("doc_id").agg(F.countDistinct("lexeme").alias("lexemes"))


@query
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all kept words of a question, adjacent and in order."""
    return index.phrases_held(_index(spark, d), _asked(spark, d).select(F.col("item_id").alias("phrase_id"), "text")).select("phrase_id", "doc_id")


@query
def presence_two_sided(spark: SparkSession, d: str) -> DataFrame:
    """Each question: jurisdictions that hold its text, by either detector, and the kind of refusal it would be elsewhere."""
    return evaluate.kinds(_index(spark, d), _asked(spark, d), _need(spark, d))


@query
def refusal_absence(spark: SparkSession, d: str) -> DataFrame:
    """Claims that a question is in no corpus (even ids) or in another one only (odd ids), in each jurisdiction: those that the corpus contradicts."""
    found = presence_two_sided(spark, d)
    claimed = found.select("item_id", "asked_in", F.when(F.col("item_id") % 2 == 0, "out-of-corpus").otherwise("out-of-jurisdiction").alias("kind"))
    return evaluate.absence_violations(found, claimed)


@query
def refusal_kinds(spark: SparkSession, d: str) -> DataFrame:
    return presence_two_sided(spark, d).groupBy("kind", "asked_in").agg(F.count("*").alias("questions"))


def _outcomes(spark: SparkSession, d: str, analysers: tuple[str, ...] = T.ANALYSERS, k: int = rank.K) -> DataFrame:
    ix, asked = _index(spark, d), _asked(spark, d)
    return evaluate.outcomes(ix, asked, _need(spark, d), _hits(spark, d, analysers, k=k), analysers)


@query
def required_found_missed(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d, (T.CONTROL,)).select("item_id", "asked_in", "norm", "n_required", "n_found", "first_position", "n_unreachable", "n_outranked")


@query
def lexical_leakage(spark: SparkSession, d: str) -> DataFrame:
    o = _outcomes(spark, d, (T.CONTROL,)).where("norm = 0")
    return o.select("item_id", "asked_in", "n_query", "n_leaked", F.round(F.col("n_leaked") / F.nullif(F.col("n_query"), F.lit(0)), 6).alias("leakage"))


@query
def grid_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(_outcomes(spark, d), *evaluate.CELL)


@query
def metrics_by_authority(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.by_authority(_outcomes(spark, d, (T.CONTROL,)))


@query
def pass_matrix(spark: SparkSession, d: str) -> DataFrame:
    o = _outcomes(spark, d, (T.CONTROL,), 1).withColumn("p", F.when(F.col("n_found") == F.col("n_required"), "P").otherwise("."))
    return o.groupBy("item_id", "asked_in").pivot("norm", [0, 1, 2]).agg(F.first("p")).select("item_id", "asked_in", F.col("0").alias("norm0"), F.col("1").alias("norm1"), F.col("2").alias("norm2"))


@query
def discordance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.discordance(_outcomes(spark, d, k=1))


@query
def power_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Differing pairs and p of each two cells, in both triangles, as a table of the control's cells."""
    x = evaluate.power(evaluate.discordance(_outcomes(spark, d, (T.CONTROL,), 1)))
    cells = [f"{T.CONTROL}/{n}" for n in rank.NORMS]
    return x.groupBy("cell_a").pivot("cell_b", cells).agg(F.first("d")).select(F.col("cell_a").alias("cell"), *(F.col(f"`{c}`").alias(f"d{k}") for k, c in enumerate(cells)))


@query
def baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    """The gate, with the run at k = 1 against the one at k = 5: what fell."""
    return evaluate.regressions(evaluate.metrics(_outcomes(spark, d, (T.CONTROL,), 5), *evaluate.CELL), evaluate.metrics(_outcomes(spark, d, (T.CONTROL,), 1), *evaluate.CELL))


@query
def run_drift(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of two runs (norms 0 and 1) as sets, by full outer join: missing, extra or drifted questions."""
    h = _hits(spark, d, norms=(0, 1))
    side = lambda n: h.where(F.col("norm") == n).groupBy("item_id", "asked_in").agg(F.array_sort(F.collect_list("doc_id")).alias(f"c{n}"))
    both = side(0).join(side(1), ["item_id", "asked_in"], "full_outer")
    state = F.when(F.col("c1").isNull(), "missing").when(F.col("c0").isNull(), "extra").when(F.col("c0") != F.col("c1"), "drifted").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("questions"))


@query
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    g = spark.range(0, 20).select(F.col("id").alias("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("b"))
    return g.select("a", "b", F.round(S.mcnemar(F.col("a"), F.col("b")), 6).alias("p"))


@query
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").cast("long").alias("good"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("good"), F.col("n"))
    return s.select("source", "good", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _raters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels as one rater, rules over the text as the other: qid, unit, idx, field, value."""
    docs = _docs(spark, d).select("doc_id", "source", "text")
    x = table(spark, d, "labels").join(docs, "doc_id")
    plain = F.length("text") - F.length(F.translate("text", "#*$%&|!", ""))
    rule = F.array(F.struct(F.lit("quality").alias("field"), (plain * 20 < F.length("text")).alias("value")), F.struct(F.lit("toxic").alias("field"), F.contains(F.lower("text"), F.lit("worthless")).alias("value")))
    label = F.array(F.struct(F.lit("quality").alias("field"), (F.col("quality") == 1).alias("value")), F.struct(F.lit("toxic").alias("field"), (F.col("toxic") == 1).alias("value")))
    side = lambda a: x.select(F.col("source").alias("qid"), F.lit("document").alias("unit"), F.col("doc_id").alias("idx"), F.explode(a).alias("x")).select("qid", "unit", "idx", "x.field", "x.value")
    return side(label), side(rule)


@query
def unit_agreement(spark: SparkSession, d: str) -> DataFrame:
    both, _ = judged.agreement(*_raters(spark, d))
    return both.groupBy("field").agg(F.count("*").alias("units"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("agreed"), F.countDistinct("qid").alias("clusters"))


@query
def cluster_robust_interval(spark: SparkSession, d: str) -> DataFrame:
    both, _ = judged.agreement(*_raters(spark, d))
    per = both.groupBy("field", "qid").agg(F.count("*").alias("units"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("agreed"))
    return judged.cluster_interval(per, "field")


@query
def pending_units(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("pending"))


def _cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Citations made of the ranking: as they are, in upper case with blanks, of another jurisdiction, of no day, and plain text."""
    h = _hits(spark, d, norms=(0,)).withColumn("qid", F.concat_ws("-", "item_id", "asked_in"))
    a = T.address(F.col("authority"), F.lit("2024-03-01"), F.col("doc_id") + 1, F.lit(None).cast("string"))
    raw = F.array(a, F.concat(F.lit("  "), F.upper(a), F.lit(" ")), F.concat(F.lit("xx"), F.substring(a, 3, 99)), F.replace(a, F.lit("-03-01"), F.lit("-13-41")), F.lit("see above"), F.concat(a, F.lit(".sub")))
    cited = h.select("qid", F.col("asked_in").alias("authority"), F.col("position").alias("hit"), F.posexplode(raw).alias("n", "raw")).select("qid", "authority", (F.col("hit") * 10 + F.col("n")).alias("pos"), "raw")
    return cited, h.select("qid", a.alias("address"))


@query
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    return judged.citations(*_cited(spark, d))


@query
def address_validity(spark: SparkSession, d: str) -> DataFrame:
    c = judged.citations(*_cited(spark, d))
    per = c.groupBy("qid").agg(F.count("*").alias("cited"), *(F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in ("inside", "outside", "foreign", "unparseable")))
    return per.agg(F.count("*").alias("answers"), *(F.sum(b).alias(b) for b in ("cited", "inside", "outside", "foreign", "unparseable")), F.round(F.sum("inside") / F.nullif(F.sum("cited"), F.lit(0)), 6).alias("validity"), F.round(F.avg((F.col("cited") == F.col("inside")).cast("double")), 6).alias("clean_answers"))


@query
def first_citation(spark: SparkSession, d: str) -> DataFrame:
    """The first retrieved passage of each jurisdiction, by question and position."""
    h = _hits(spark, d, norms=(0,))
    return h.groupBy("authority").agg(F.min(F.struct("item_id", "position", "doc_id")).alias("x")).select("authority", "x.item_id", "x.doc_id")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, question, answer: each assistant turn after a user turn."""
    w = rank.Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("question", F.lag("text").over(w)).withColumn("before", F.lag("role").over(w))
    return c.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


@query
def quote_words_present(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", F.contains(T.squeezed(F.col("answer")), T.squeezed(F.col("question"))).alias("quote_found"), F.round(judged.quote_share(F.col("question"), F.col("answer")), 6).alias("share"))


@query
def verdict_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes made of conversation turns, some of them broken, through the parser: units by kind and problem."""
    u = _judged_units(spark, d)
    return u.groupBy("unit", "problem").agg(F.count("*").alias("units"), F.count(F.when(F.col("stated"), 1)).alias("stated"), F.count(F.when(F.col("supported"), 1)).alias("supported"), F.count(F.when(F.col("asserted"), 1)).alias("asserted"), F.coalesce(F.sum("incoherent"), F.lit(0)).cast("long").alias("incoherent"))


def _judged_units(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    h = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(9))
    q = F.col("answer")
    good = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("index"), (h % 2 == 0).alias("stated"), (h % 3 == 0).alias("supported"), q.alias("quote"))).alias("branches"), F.array(F.struct(F.lit(1).alias("index"), (h == 4).alias("asserted"), F.col("question").alias("quote"))).alias("forbidden")))
    raw = F.when(h == 7, "").when(h == 8, "[1]").when(h == 5, '{"branches": []}').otherwise(good)
    rows = t.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), raw.alias("raw"), (h == 6).alias("refused"), "answer", F.lit(1).alias("n_branches"), F.lit(1).alias("n_forbidden"))
    return judged.verdicts(rows)


@query
def refusal_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Both populations; an answer counts as refused if the question has fewer than three hits' worth of score at the top."""
    kinds = presence_two_sided(spark, d)
    top = _hits(spark, d, norms=(0,), k=1).select("item_id", "asked_in", "rank", "doc_id")
    need = _need(spark, d)
    hit = need.join(top, ["item_id", "asked_in", "doc_id"]).select("item_id", "asked_in").distinct().withColumn("complete", F.lit(True))
    rows = kinds.join(top.drop("doc_id"), ["item_id", "asked_in"], "left").join(hit, ["item_id", "asked_in"], "left")
    rows = rows.select("kind", F.when(F.col("kind") == "answerable", "answerable").otherwise("refusal").alias("population"), (F.coalesce("rank", F.lit(0.0)) < 0.05).alias("refused"), F.coalesce("complete", F.lit(False)).alias("complete"))
    return judged.refusal_metrics(rows)


@query
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.slug(F.col("text")).alias("slug"), F.md5(T.plain_title(F.col("text"))).alias("title"))


@query
def address_parse(spark: SparkSession, d: str) -> DataFrame:
    a = T.address(F.col("lang"), F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0"), F.lit("-15")), F.col("doc_id") % 7, F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    x = T.parsed_address(a)
    return _docs(spark, d).select("doc_id", a.alias("address"), x["authority"].alias("authority"), x["date"].cast("string").alias("day"), x["clause"].cast("long").alias("clause"), x["sub"].alias("sub"))


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.concat(F.col("source"), F.lit(" ("), F.col("lang"), F.lit(")")).alias("citation"))


@query
def shortest_unique_prefix(spark: SparkSession, d: str) -> DataFrame:
    return structure.unique_keys(_docs(spark, d).select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("unit", "text"))).withColumn("unit", F.col("unit").cast("long"))


@query
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents given a front, contents and body by their lines: the sections that come out again."""
    line = F.split("text", "\n")
    made = F.concat(F.lit("front 1.2.2024\n"), F.element_at(line, 1), F.lit(" ........ 3\nmiddle\n"), F.element_at(line, -1), F.lit(" ..... 4\n"), F.col("text"))
    return structure.sections(_docs(spark, d).select("doc_id", made.alias("text"))).select("doc_id", "front", F.length("toc").cast("long").alias("toc_chars"), F.sha2("body", 256).alias("body"))


@query
def front_matter_dates(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("from "), (F.col("doc_id") % 31).cast("string"), F.lit("."), (F.col("doc_id") % 13).cast("string"), F.lit(".2024 and 1.5.2023, again 1.5.2023"))
    x = structure.dates(_docs(spark, d).select("doc_id", made.alias("text")))
    return x.select("doc_id", F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"))


@query
def page_breaks(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\f ")), F.lit(", "), F.lit(",\f ")), F.lit("\n\f  Next\f"))
    return _docs(spark, d).select("doc_id", F.md5(T.page_breaks(made)).alias("text"), T.n_page_breaks(made).alias("breaks"), F.length(made).cast("long").alias("before"))


@query
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    made = F.replace(F.replace(F.col("text"), F.lit("an"), F.lit("a-\nn")), F.lit("th"), F.lit("-\nja th"))
    return _docs(spark, d).select("doc_id", F.length(T.dehyphenated(made)).cast("long").alias("chars"), F.sha2(T.dehyphenated(made), 256).alias("sha256"), T.n_joins(made).alias("joins"), T.n_guards(made).alias("guards"))


@query
def municipality_status(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations as places, nations' regions as authorities: resolved, unknown, ambiguous or blank. Names fold case."""
    dim = table(spark, d, "nation").select(F.lower("n_name").alias("place"), "n_regionkey")
    dim = dim.unionByName(dim.where("n_regionkey = 1 and place like 'a%'").withColumn("n_regionkey", F.lit(2)))
    known = dim.groupBy("place").agg(F.count("*").alias("n"), F.min("n_regionkey").alias("authority"))
    asked = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.when(F.col("c_custkey") % 10 == 0, " ").when(F.col("c_custkey") % 10 == 1, "Atlantis").otherwise(F.initcap("n_name")).alias("place"))
    x = asked.join(F.broadcast(known), F.lower(asked["place"]) == known["place"], "left").select(asked["place"], "n", "authority")
    status = F.when(F.trim("place") == "", "blank").when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return x.groupBy("place", status.alias("status")).agg(F.count("*").alias("asked"))


@query
def pair_check(spark: SparkSession, d: str) -> DataFrame:
    """Texts under several jurisdictions, as paired questions: rows, distinct texts and jurisdictions of each source."""
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("text").alias("texts"), F.countDistinct("lang").alias("authorities"))


@query
def ledger_daily(spark: SparkSession, d: str) -> DataFrame:
    return ledger.daily(table(spark, d, "events")).withColumn("day", F.col("day").cast("string"))


@query
def ledger_monthly(spark: SparkSession, d: str) -> DataFrame:
    return ledger.monthly(table(spark, d, "events"))


@query
def ledger_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ledger.tokens(table(spark, d, "events")).select("user_id", F.date_format("issued_at", "yyyy-MM-dd HH:mm:ss").alias("issued_at"), F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"), "used", "asked", "cost")


@query
def budget_running(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_over(table(spark, d, "events"), 500.0).select("user_id", "event_id")


@query
def cap_replay(spark: SparkSession, d: str) -> DataFrame:
    return ledger.replay(table(spark, d, "events"))


@query
def gate_replay(spark: SparkSession, d: str) -> DataFrame:
    """With the day's and the month's caps: state that crosses tokens."""
    return ledger.replay_all(table(spark, d, "events"), per_day=20, per_month=2000.0)


@query
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count("props").alias("with_props"), F.countDistinct("user_id").alias("users"))


@query
def token_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" ab"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0").substr(1, 6), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", T.token_key(raw).alias("token"))


@query
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity").cast("double"), 2).alias("qty"), F.round(F.avg("l_extendedprice").cast("double"), 2).alias("avg_price"))


@query
def effective_date(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents that name no day, one, or two."""
    g = F.pmod("doc_id", F.lit(97))
    day = F.when(g % 3 == 0, "soon").when(g % 3 == 1, "in force 1.6.2024").otherwise(F.concat(F.lit("in force "), (F.col("doc_id") % 2 + 1).cast("string"), F.lit(".6.2024")))
    x = contracts.effective_date(_docs(spark, d).select(g.alias("group"), "doc_id", day.alias("text")), "group")
    return x.select("group", F.col("date").cast("string").alias("day"), "problem")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("lang").alias("authority"), F.col("source").alias("clause"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("sub"))


@query
def corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    return contracts.inventory(_chunks(spark, d))


@query
def inventory_problems(spark: SparkSession, d: str) -> DataFrame:
    """The corpus against a declaration that has one passage more where the language begins with e, and none of another one."""
    found = contracts.inventory(_chunks(spark, d))
    pinned = found.where("authority is null or authority <> 'de'").withColumn("chunks", F.col("chunks") + F.when(F.col("authority").startswith("e"), 1).otherwise(0))
    return contracts.inventory_problems(found, pinned)


@query
def index_report(spark: SparkSession, d: str) -> DataFrame:
    return contracts.index_report(_docs(spark, d))


@query
def question_problems(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark as questions with labels, some of them broken."""
    b, k = _asked(spark, d), F.col("item_id") % 5
    req = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("b@1"))).when(k == 2, F.array(F.lit("a@1"), F.lit("a@1"))).otherwise(F.array(F.lit("a@1")))
    q = b.select(F.col("item_id").alias("qid"), "text", F.lit("answerable").alias("population"), F.lit("a").alias("authority"), req.alias("required"))
    r = b.where("item_id % 7 = 0").select((-F.col("item_id") - 1).alias("qid"), "text", F.lit("refusal").alias("population"), F.lit("a").alias("authority"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a@1"))).alias("required"))
    return contracts.question_problems(q.unionByName(r).unionByName(q.where("qid % 11 = 0").withColumn("text", F.concat(F.lit("again "), "text"))))


@query
def pair_problems(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts in two languages as pairs: which aren't."""
    x = _docs(spark, d).where("text is not null").select(F.md5("text").alias("pair"), "text", F.col("lang").alias("authority"))
    return contracts.pair_problems(x).groupBy("problem").agg(F.count("*").alias("pairs"))


@query
def control_floor(spark: SparkSession, d: str) -> DataFrame:
    """Labels as known-bad cases of four shapes; all toxic ones count as caught, the others by their number."""
    return contracts.control_floor(table(spark, d, "labels").select(F.concat_ws("-", "quality", "toxic").alias("shape"), ((F.col("toxic") == 1) | (F.col("doc_id") % 2 == 0)).alias("caught")))


@query
def publication_rule(spark: SparkSession, d: str) -> DataFrame:
    units, _ = judged.agreement(*_raters(spark, d))
    per = units.groupBy("field").agg(F.count("*").alias("units"), F.count(F.when(F.col("a").eqNullSafe(F.col("b")), 1)).alias("agreed")).withColumn("pending", F.lit(0))
    return contracts.publishable(per).drop("pending")


@query
def context_format(spark: SparkSession, d: str) -> DataFrame:
    """What would be put before a model: bodies of the top three, as a digest."""
    top = _hits(spark, d, norms=(0,), k=3)
    return contracts.contexts(top, index.passages(_docs(spark, d))).select("item_id", "asked_in", "n", "missing", F.sha2("context", 256).alias("context"))


@query
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents made of two clauses; in each fourth the second heading has the wrong number."""
    x = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " "))
    second = F.when(F.col("doc_id") % 4 == 0, "3").otherwise("2")
    made = F.concat(F.lit("front\n1 § Alpha .... 1\n2 § Beta-\nrule ..... 2\n1 § Alpha\nA "), x, F.lit("\n"), second, F.lit(" § Beta\nrule\nB "), x)
    return structure.split_clauses(structure.sections(_docs(spark, d).select("doc_id", made.alias("text"))))


@query
def definition_units(spark: SparkSession, d: str) -> DataFrame:
    x = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " "))
    made = F.concat(F.lit("• A  "), x, F.lit("\n • B "), x, F.lit("\n \nC "), x)
    return structure.definitions(_docs(spark, d).select("doc_id", made.alias("text"))).withColumn("unit", F.col("unit").cast("long"))


def queries() -> dict[str, Query]:
    from kaivo.plans import recorded  # noqa: F401  its queries register themselves

    return dict(_found)


def oracle_sql() -> dict[str, str]:
    from kaivo.plans import recorded

    return {k: v for k, v in (oracles.SQL | recorded.SQL).items() if k in _found}
