import math

import pytest
from pyspark.sql import functions as F

from kaivo.functions import morphology as M
from kaivo.functions import stats as S
from kaivo.functions import text as T
from kaivo.operators import evaluate, index, judged, ledger, rank, structure
from kaivo.sources import records
from kaivo.streaming import ledger as stream

DATA = "/root/testdata/sf0.001"


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_mcnemar_matches_exact_binomials(spark):
    rows = spark.createDataFrame([(a, b) for a in range(12) for b in range(12)], "a long, b long").select("a", "b", S.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    for a, b, p in rows:
        n = a + b
        want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n)
        assert p == pytest.approx(want)


def test_mcnemar_of_many_pairs(spark):
    pairs = [(600, 600), (400, 700), (10_000, 9_900), (1, 2_000)]
    got = [r.p for r in spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "k int, a long, b long").select("k", S.mcnemar(F.col("a"), F.col("b")).alias("p")).orderBy("k").collect()]
    for (a, b), p in zip(pairs, got, strict=True):
        n = a + b
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(a, b) + 1))
        assert p == pytest.approx(min(1.0, 2 * tail), rel=1e-6)
    assert got[0] == 1.0


def test_labels_fold_case_and_need_no_whole_words(spark):
    docs = spark.createDataFrame([(1, "Bring Glass JARS here", "a"), (2, "ajars b glass jarsx", "a"), (3, "glass, jars", "b"), (4, None, "a")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "ring glass jar"), (2, "GLASS JARS"), (3, "jars"), (4, ""), (5, None), (6, "no such glass here")], "item_id long, question string")
    found = {(r.item_id, r.doc_id) for r in index.required(index.of(docs), asked).collect()}
    assert found == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)}


def test_stored_index_is_the_plan(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = index.of(docs), index.store(docs, f"file://{tmp_path}/ix")
    for part in ("counts", "words", "forms", "lengths"):
        x, y = getattr(a, part), getattr(b, part)
        y = y.select(*(F.col(f.name).cast(f.dataType) for f in x.schema))
        assert x.exceptAll(y).count() == 0 == y.exceptAll(x).count()
    with pytest.raises(ValueError):
        rank.ranked(spark.range(1), (3,))


def test_refusals_that_the_corpus_contradicts(spark):
    found = spark.createDataFrame([(1, "a", "answerable"), (1, "b", "out-of-jurisdiction"), (2, "a", "out-of-corpus"), (2, "b", "out-of-corpus")], "item_id long, asked_in string, kind string")
    said = lambda kind: {(r.item_id, r.asked_in): r.violation for r in evaluate.absence_violations(found, found.withColumn("kind", F.lit(kind))).collect()}
    assert said("out-of-corpus") == {(1, "a"): "stands in its own jurisdiction", (1, "b"): "stands in another jurisdiction"}
    assert said("out-of-jurisdiction") == {(1, "a"): "answerable where it was asked", (2, "a"): "answerable nowhere", (2, "b"): "answerable nowhere"}


def test_wilson_of_published_proportions(spark):
    low, high = values(spark, *S.wilson(F.lit(12), F.lit(19)))
    assert (round(low, 2), round(high, 2)) == (0.41, 0.81)
    assert values(spark, *S.wilson(F.lit(0), F.lit(0))) == (None, None)


def test_h2_saturates(spark):
    one, two, many = values(spark, *(S.h2(F.lit(n)) for n in (1, 2, 10_000)))
    assert (one, two) == (1.0, 1.25) and 1.6 < many < S.ZETA2


@pytest.mark.parametrize(
    ("bases", "safe", "whole"),
    [
        ("+talo(talo)+katto(katto)", ["talo", "katto"], ["talo", "katto"]),
        ("+esi+kuva(kuva)", [], ["esikuva"]),
        ("+laula(laulaa)+ja(+ja)", [], ["laulaja"]),
        ("+lento(len=to)", ["lento"], ["lento", "len", "to"]),
        ("+kulje(kulkea)tus(+tus)+reitti(reitti)", [], ["kuljetus", "reitti"]),
    ],
)
def test_compounds(bases, safe, whole):
    assert M.safe(bases) == safe and M.reassembled(bases) == whole


def test_words_without_reading_or_with_names():
    assert M.word_lexemes("Xyz=1", [], "base") == ["xyz1"]
    assert M.word_lexemes("kuusi", [("Kuusi", None), ("kuusi", None)], "base") == ["kuusi"]
    assert M.word_lexemes("aku", [("Aku", None)], "base") == ["aku"]
    with pytest.raises(M.UnreadableMorphs):
        M.morphs("+a(b")


def test_repairs_of_extracted_text(spark):
    made = values(spark, T.dehyphenated(F.lit("jäte-\n  huolto, öljy-\nja kaasu-\n\nx")), T.page_breaks(F.lit("a\n\fNew\n\fold\f")))
    assert made[0] == "jätehuolto, öljy-\nja kaasu-\n\nx" and made[1] == "a\n\nNew\nold\f"


def test_addresses_round_trip(spark):
    a = T.address(F.lit("town"), F.lit("2024-02-29"), F.lit(3), F.lit("key"))
    ok, back = values(spark, T.parsed_address(a), a)
    assert back == "town@2024-02-29#3.key" and (ok.authority, ok.clause, ok["sub"]) == ("town", 3, "key")
    assert values(spark, T.parsed_address(F.lit("town@2023-02-29#3")), T.parsed_address(F.lit("town@2024-01-01#0"))) == (None, None)


def test_analysers_nest(spark):
    rows = spark.createDataFrame([("containers",), ("ab",), ("abcdefabcdef",)], "w string").select("w", F.explode(T.lexemes(F.col("w"))).alias("x")).where("x.lexeme is not null").select("w", "x.*").collect()
    of = lambda w, a: [r.lexeme for r in rows if r.w == w and r.analyser == a]
    for w in ("containers", "ab", "abcdefabcdef"):
        assert set(of(w, "base")) <= set(of(w, "split")) <= set(of(w, "prefix"))
        assert all(len(of(w, a)) == len(set(of(w, a))) for a in T.ANALYSERS)


def test_jurisdiction_is_load_bearing(spark):
    docs = spark.createDataFrame([(1, "bins are emptied weekly", "a"), (2, "bins bins bins", "b")], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(7, "bins")], "item_id long, text string")
    inside = rank.ranked(rank.scored(index.of(docs), ask, spark.createDataFrame([("a",)], "asked_in string"), ("base",)), (0,)).collect()
    assert [(r.doc_id, r.authority) for r in inside] == [(1, "a")]
    assert rank.ranked(rank.scored(index.of(docs), ask, None, ("base",)), (0,)).first().doc_id == 2


def test_phrase_needs_adjacent_words_in_order(spark):
    chunk = index.of(spark.createDataFrame([(1, "x", "red car park"), (2, "x", "car red park"), (3, "x", "red big car")], "doc_id long, lang string, text string"))
    p = spark.createDataFrame([(9, 0, "red"), (9, 1, "car"), (9, 1, "cars")], "phrase_id long, ord int, lexeme string")
    assert [r.doc_id for r in index.phrase_hits(chunk, p).collect()] == [1]


def test_gate_reports_structure_first(spark):
    head = "analyser string, norm int, questions long, required long, complete_set_recall double, passage_recall double, mrr double, leakage double"
    was = spark.createDataFrame([("stem", 0, 5, 5, 0.8, 0.8, 0.7, 0.3)], head)
    assert evaluate.regressions(was, was).count() == 0
    worse = evaluate.regressions(was, spark.createDataFrame([("stem", 0, 5, 5, 0.8, 0.7, 0.7, 0.4)], head)).collect()
    assert sorted(r.metric for r in worse) == ["leakage", "passage_recall"]
    assert [r.metric for r in evaluate.regressions(was, spark.createDataFrame([("stem", 1, 5, 5, 0.1, 0.1, 0.1, 0.9)], head)).collect()] == ["not measured", "not recorded"]


def test_verdicts(spark):
    rows = [
        ("a", '{"branches":[{"index":1,"stated":false,"supported":true,"quote":""}],"forbidden":[{"index":1,"asserted":true,"quote":"b  c"}]}', False, "a b c", 1, 1),
        ("b", '{"branches":[{"index":1,"stated":true,"supported":true,"quote":"x"}],"forbidden":[]}', True, "no", 1, 0),
        ("c", "", False, "", 1, 1), ("d", "[]", False, "", 0, 0), ("e", '{"branches":[]}', False, "", 0, 0), ("f", '{"branches":[],"forbidden":[]}', False, "", 1, 0),
    ]
    u = judged.verdicts(spark.createDataFrame(rows, "qid string, raw string, refused boolean, answer string, n_branches int, n_forbidden int")).cache()
    got = {(r.qid, r.unit): r for r in u.collect()}
    assert got["a", "branch"].supported is False and got["a", "branch"].incoherent == 1 and got["a", "forbidden"].quote_found
    assert got["b", "branch"].stated is False and got["b", "branch"].incoherent == 1
    assert [got[q, None].problem for q in "cdef"] == ["empty", "not an object", "missing key", "wrong count"]
    m = judged.judged_metrics(u).first()
    assert m.answers == 2 and m.groundedness is None and m.over_claim_rate == 0.5


def test_cluster_interval_without_variance_is_wilson(spark):
    r = judged.cluster_interval(spark.createDataFrame([("f", 2, 2), ("f", 3, 3)], "field string, agreed long, units long"), "field").first()
    assert r.kind == "wilson-over-clusters" and r.rate == 1.0 and r.low < 1.0


def test_structure_of_a_document(spark):
    text = "Rules 1.2.2024\n1 § Terms ..... 3\n2 § Scope and\n  aims ........ 4\n1 § Terms\n• Bin means a box\n• Bin bag means a sack, see\n2 § below\n2 § Scope\nand aims\nAll of it.\n"
    parts = structure.sections(spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string"))
    assert {r.doc_id: r.problem for r in parts.collect()} == {1: None, 2: "no table of contents"}
    c = structure.split_clauses(parts.where("problem is null")).orderBy("clause").collect()
    assert [(r.clause, r.title) for r in c] == [(1, "Terms"), (2, "Scope and aims")] and "2 § below" in c[0].text and c[1].text == "All of it."
    units = structure.definitions(spark.createDataFrame([(1, c[0].text)], "doc_id long, text string"))
    assert sorted(r.key for r in structure.unique_keys(units).collect()) == ["bin-bag", "bin-means"]
    assert structure.key_problems(structure.unique_keys(units)).count() == 0
    alike = spark.createDataFrame([(1, 0, "bin-bag x"), (1, 1, "bin bag"), (1, 2, "bin box"), (1, 3, "lid"), (1, 4, "lid"), (2, 0, "lid")], "doc_id long, unit int, text string")
    assert {(r.doc_id, r.unit): r.problem for r in structure.key_problems(structure.unique_keys(alike)).collect()} == {(1, 3): "no key tells it apart", (1, 4): "no key tells it apart", (1, 0): "key of another unit too", (1, 1): "key of another unit too"}
    with pytest.raises(structure.Unreadable):
        structure.contents("1 § A .... 1\n3 § B .... 2")


def test_ledger_batch_and_stream_agree(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    whole = {(r.user_id, r.event_id, r.decision) for r in ledger.replay(events).collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.caps(stream.events(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("caps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.event_id, r.decision) for r in spark.table("caps").collect()} == whole
    caps = {(r.decision) for r in ledger.replay_all(events, per_day=3, per_month=50.0).collect()}
    assert "accepted" in caps and caps <= {"accepted", "expired", "over_cap", "day_cap", "month_cap"}


def test_recorded_runs(spark, tmp_path):
    good = '{"cell":"stem/0","k":5,"answered_at_commit":"abc-dirty","answers":[{"question_id":"q1","population":"answerable","refused":false,"text":"yes","retrieved":[],"citations":[]}]}'
    (tmp_path / "a.json").write_text(good)
    assert records.read_run(spark, str(tmp_path / "a.json")).first().dirty
    (tmp_path / "b.json").write_text(good.replace('"yes"', '""'))
    with pytest.raises(evaluate.Violation):
        records.read_run(spark, str(tmp_path / "b.json"))
    records.replace_table(spark.range(3), str(tmp_path / "t"))
    records.replace_table(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_contracts(spark):
    from kaivo.operators import contracts

    q = [(1, "x", "answerable", "a", ["a@1"]), (2, "y", "answerable", "a", []), (3, "z", "answerable", "a", ["b@1", "b@1"]), (4, "x", "refusal", "a", None), (5, "v", "refusal", "a", ["a@1"]), (5, "u", "answerable", "ab", ["a@1"])]
    found = contracts.question_problems(spark.createDataFrame(q, "qid long, text string, population string, authority string, required array<string>"))
    assert sorted(map(tuple, found.collect())) == [
        (1, "text in both populations"), (2, "nothing required"), (3, "passage of another jurisdiction"), (3, "passage required twice"), (4, "text in both populations"),
        (5, "passage of another jurisdiction"), (5, "refusal with passages"), (5, "repeated id"),
    ]
    pairs = spark.createDataFrame([("p", "t", "a"), ("p", "t", "b"), ("q", "t", "a"), ("r", "t", "a"), ("r", "u", "b"), ("s", "t", "a"), ("s", "t", "a")], "pair string, text string, authority string")
    assert sorted(map(tuple, contracts.pair_problems(pairs).collect())) == [("q", "not two rows"), ("r", "different texts"), ("s", "one jurisdiction")]
    days = spark.createDataFrame([("a", 1, "from 1.2.2024"), ("a", 2, None), ("b", 1, "31.2.2024"), ("c", 1, "1.2.2024"), ("c", 2, "2.2.2024")], "source string, doc_id long, text string")
    assert {r.source: (str(r.date), r.problem) for r in contracts.effective_date(days, "source").collect()} == {"a": ("2024-02-01", None), "b": ("None", "no date"), "c": ("None", "several dates")}
    empty = spark.createDataFrame([], "shape string, caught boolean")
    assert not any(r.passed for r in contracts.control_floor(empty).collect())
    assert {(r.shape, r.passed) for r in contracts.control_floor(spark.createDataFrame([("s", True), ("t", None)], empty.schema)).collect()} == {("s", True), ("t", False), (None, False)}
    rates = spark.createDataFrame([(20, 17, 0), (20, 16, 0), (20, 20, 1), (0, 0, 0)], "units long, agreed long, pending int")
    assert [r.published for r in contracts.publishable(rates).collect()] == [True, False, False, False]
    counted = contracts.inventory(spark.createDataFrame([("a", 1, None), ("a", 1, "s"), ("b", 1, None)], "authority string, clause int, sub string"))
    pinned = spark.createDataFrame([("a", 1, 3, 1), ("c", 1, 1, 0)], counted.schema)
    assert sorted(map(tuple, contracts.inventory_problems(counted, pinned).collect())) == [("a", "chunks 2 for 3"), ("b", "undeclared"), ("c", "missing")]
    hits = spark.createDataFrame([(1, "a", 2, 7), (1, "a", 1, 8), (1, "a", 3, 9)], "item_id long, asked_in string, position int, doc_id long")
    (one,) = contracts.contexts(hits, spark.createDataFrame([(7, "seven"), (8, "eight")], "doc_id long, body string")).collect()
    assert (one.n, one.missing, one.context) == (3, 1, "eight\n\nseven\n\n")


def test_answer_envelopes_are_strict(spark):
    from kaivo.operators import offline

    raw = {
        "ok": '{"refused": false, "answer": "x", "citations": ["a"], "more": 1}', "none": '{"refused": true, "answer": "", "citations": []}', "blank": " \n", "null": None, "text": "no", "list": "[]", "word": '"x"',
        "less": '{"refused": false, "answer": "x"}', "said": '{"refused": "true", "answer": "x", "citations": []}', "number": '{"refused": true, "answer": 5, "citations": []}', "mixed": '{"refused": true, "answer": "x", "citations": ["a", 1]}',
        "nulls": '{"refused": true, "answer": "x", "citations": [null]}', "hole": '{"refused": true, "answer": "x", "citations": ["a", null]}', "void": '{"refused": null, "answer": "x", "citations": []}', "one": '{"refused": true, "answer": "x", "citations": "a"}',
    }
    got = {r.qid: r for r in offline.envelopes(spark.createDataFrame(list(raw.items()), "qid string, raw string")).collect()}
    assert (got["ok"].refused, got["ok"].answer, got["ok"].citations, got["ok"].problem) == (False, "x", ["a"], None)
    assert (got["none"].refused, got["none"].citations) == (True, [])
    assert {k: r.problem for k, r in got.items() if r.problem} == {
        "blank": "empty", "null": "empty", "text": "not JSON", "list": "not an object", "word": "not an object", "less": "missing key",
        **dict.fromkeys(("said", "number", "mixed", "nulls", "hole", "void", "one"), "wrong type"),
    }
    assert all(r.refused is None and r.answer is None and r.citations is None for r in got.values() if r.problem)


def test_offline_scoring(spark):
    from kaivo.operators import offline

    asked = spark.createDataFrame([("r1", "refusal", "k", None), ("r2", "refusal", "k", None), ("a1", "answerable", None, ["x"]), ("a2", "answerable", None, ["x", "y"]), ("a3", "answerable", None, [])], "qid string, population string, kind string, required array<string>")
    said = spark.createDataFrame([("r1", "refusal", False, []), ("r9", "refusal", True, []), ("a1", "answerable", True, ["x", "z"]), ("a2", "answerable", True, ["x"]), ("a9", "answerable", False, None)], "qid string, population string, refused boolean, retrieved array<string>")
    out = offline.refusal_outcomes(asked, said)
    got = {r.qid: (r.kind, r.complete, r.problem) for r in out.collect()}
    assert got == {"r1": ("k", None, None), "r2": ("k", None, "not answered"), "r9": (None, None, "not asked"), "a1": (None, True, None), "a2": (None, False, None), "a9": (None, None, "unknown question")}
    assert {tuple(r) for r in offline.refusal_offenders(out).collect()} == {("r1", "k", "answered"), ("a1", None, "refused with everything retrieved")}
    assert [(r.refusals, r.correct) for r in offline.refusals_by_kind(out).collect()] == [(1, 0), (1, 0)]
    human = spark.createDataFrame([("q", "branch", 1, True), ("q", "branch", 2, False), ("q", "forbidden", 1, None), ("p", "branch", 1, True)], "qid string, unit string, idx int, stated boolean")
    verdicts = spark.createDataFrame([("q", "branch", 1, False, True, None), ("q", "branch", 2, True, True, None), ("q", "forbidden", 1, None, None, True), ("z", "branch", 1, True, True, None)], "qid string, unit string, idx int, stated boolean, supported boolean, asserted boolean")
    assert {tuple(r) for r in offline.judge_labels(human, verdicts).collect()} == {("q", "branch", 1, "stated", False, None), ("q", "branch", 1, "supported", True, None), ("q", "branch", 2, "stated", True, None), ("q", "forbidden", 1, "asserted", True, None), ("p", "branch", 1, None, None, "no verdict")}
    cases = spark.createDataFrame([("c1", "s"), ("c2", "s"), ("c3", "t")], "case_id string, shape string")
    must = spark.createDataFrame([("c1", "branch", 1, "stated", True), ("c1", "branch", 2, "stated", False), ("c2", "branch", 1, "stated", True)], "case_id string, unit string, idx int, field string, expect boolean")
    seen = spark.createDataFrame([("c1", "branch", 1, "stated", True), ("c1", "branch", 2, "stated", False)], "case_id string, unit string, idx int, field string, value boolean")
    assert sorted(map(tuple, offline.control_outcomes(cases, must, seen).collect())) == [("c1", "s", True, 0), ("c2", "s", False, 1), ("c3", "t", False, 0)]
    with pytest.raises(ValueError):
        offline.limited(cases, 0, "case_id")
    assert [r.partial for r in offline.limited(cases, 3, "case_id").collect()] == [False] * 3
    none = spark.createDataFrame([], out.schema)
    assert offline.refusals_by_kind(none).count() == offline.refusal_offenders(none).count() == 0


def test_gate_against_a_plain_loop(spark):
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), k, start + timedelta(minutes=rng.randrange(4000)), rng.random() < 0.3) for k in range(3000)]
    day = lambda n: start + timedelta(days=n)
    issued = {1: (day(9), None), 2: (day(1), None), 3: (day(9), day(2)), 4: (day(1), day(1))}
    want, used = {}, {}
    for token, seq, ts, refund in sorted(rows, key=lambda r: (r[2], r[1])):
        n = used.get(token, 0)
        expires, revoked = issued.get(token, (None, None))
        if token not in issued:
            want[seq] = "unknown"
        elif refund:
            want[seq] = "refunded" if n else "nothing to refund"
            used[token] = max(n - 1, 0)
        elif revoked and ts >= revoked:
            want[seq] = "revoked"
        elif ts >= expires:
            want[seq] = "expired"
        else:
            want[seq] = "accepted" if n < 10 else "over_cap"
            used[token] = min(n + 1, 10)
    requests = spark.createDataFrame(rows, "token long, seq long, ts timestamp, refund boolean")
    tokens = spark.createDataFrame([(t, *x) for t, x in issued.items()], "token long, expires_at timestamp, revoked_at timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert {r.seq: r.decision for r in ledger.gate(requests, tokens).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ledger.gate(requests.limit(0), tokens).count() == 0


def test_hand_written_files(spark, tmp_path):
    from kaivo.operators import contracts, offline
    from kaivo.operators.evaluate import Violation

    (tmp_path / "m.yaml").write_text("version: 1\nauthorities:\n- {key: a, name: A, places: [Turku, Raisio], partial: [{place: Salo, part: north}]}\n- {key: b, name: B, places: [Tampere]}\n")
    covers = records.read_manifest(spark, str(tmp_path / "m.yaml"))
    asked = spark.createDataFrame([("TURKU",), ("Salo",), ("Oulu",), (" ",), (None,)], "place string")
    assert {(r.place, r.status, r.authority) for r in contracts.resolve(asked, covers).collect()} == {("TURKU", "resolved", "a"), ("Salo", "partial", None), ("Oulu", "unknown", None), (" ", "blank", None), (None, "blank", None)}
    (tmp_path / "bad.yaml").write_text("version: 1\nauthorities:\n- {key: a, name: A, places: [Turku]}\n- {key: b, name: B, places: [turku]}\n")
    with pytest.raises(Violation):
        records.read_manifest(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.json").write_text('{"version": 1, "questions": [{"id": "q1", "question": "x?", "population": "answerable", "authority": "a", "required": ["a@1"], "branches": ["u", "v"]}]}')
    (tmp_path / "q" / "2.yml").write_text("version: 1\nquestions:\n- {id: q2, question: y, population: refusal, authority: b, kind: out-of-corpus}\n")
    questions = records.read_questions(spark, str(tmp_path / "q"))
    assert [(r.qid, r.required, r.n_branches, r.kind) for r in questions.orderBy("qid").collect()] == [("q1", ["a@1"], 2, None), ("q2", [], 0, "out-of-corpus")]
    (tmp_path / "c.json").write_text('{"version": 1, "cases": [{"id": "c1", "question_id": "q1", "shape": "s", "answer": "y", "must_catch": [{"unit": "branch", "index": 3, "field": "stated", "expect": true}]}]}')
    cases, must = records.read_control(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in offline.control_problems(cases, must, questions, ("s", "t")).collect()} == {("c1", "no such unit"), (None, "shape t not covered in a"), (None, "fewer than two jurisdictions")}
    (tmp_path / "old.json").write_text('{"version": 2}')
    for reader in (records.read_manifest, records.read_questions, records.read_control):
        with pytest.raises(Violation):
            reader(spark, str(tmp_path / "old.json"))


def test_files_of_runs(spark, tmp_path):
    import hashlib

    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    pins = [("a", hashlib.sha256(b"1").hexdigest()), ("b", "0"), ("c", "1")]
    assert sorted(r.path for r in records.pinned(files, spark.createDataFrame(pins, "path string, sha256 string")).collect()) == ["b", "c"]
    (tmp_path / "labels.json").write_text('{"version": 1, "sample": "s", "labels": [{"question_id": "q", "unit": "branch", "index": 1, "stated": false, "supported": true}, {"question_id": "q", "unit": "forbidden", "index": 1, "asserted": true}]}')
    assert {tuple(r) for r in records.read_labels(spark, str(tmp_path / "labels.json")).collect()} == {("q", "branch", 1, "stated", False), ("q", "forbidden", 1, "asserted", True)}
    nested = spark.createDataFrame([("q", ["a", "b"], None)], "question_id string, retrieved array<string>, text string")
    records.write_answers(nested, str(tmp_path / "run"), cell="stem/0", k=5)
    (back,) = spark.read.json(str(tmp_path / "run")).collect()
    assert (back.cell, back.k, back.question_id, back.retrieved, back.text) == ("stem/0", 5, "q", ["a", "b"], None)
    spark.createDataFrame([("stem", 0, 0.5)], "analyser string, norm int, mrr double").write.json(str(tmp_path / "base"))
    assert [(r.analyser, r.mrr, r.leakage) for r in records.read_baseline(spark, str(tmp_path / "base")).collect()] == [("stem", 0.5, None)]
    assert records.provenance(str(tmp_path)) == ""


def test_lexicon(spark):
    from kaivo.operators import lexicon
    from kaivo.operators.evaluate import Violation

    known = spark.createDataFrame([("biojätteet", "biojäte", "+bio(bio)+jätteet(jäte)"), ("kuusi", "kuusi", None), ("kuusi", "Kuusi", None), ("kuusi", "kuu", "+kuusi(kuu)")], "word string, baseform string, bases string")
    words = spark.createDataFrame([("biojätteet",), ("kuusi",), ("xyz",), ("xyz",)], "word string")
    got = {}
    for r in lexicon.lexemes(words, known).collect():
        got.setdefault((r.word, r.analyser), []).append(r.lexeme)
    assert {k: sorted(v) for k, v in got.items() if k[1] != "reasm"} == {("biojätteet", "base"): ["biojäte"], ("biojätteet", "safe"): ["bio", "biojäte", "jäte"], ("kuusi", "base"): ["kuu", "kuusi"], ("kuusi", "safe"): ["kuu", "kuusi"], ("xyz", "base"): ["xyz"], ("xyz", "safe"): ["xyz"]}
    assert [r.word for r in lexicon.gaps(words, known).collect()] == ["xyz"]
    with pytest.raises(Violation):
        lexicon.assert_present(words, known.limit(0))
    docs = spark.createDataFrame([(1, "Kuusi biojäte", "a"), (2, "biojäte kuu", "a")], "doc_id long, text string, lang string")
    needles = spark.createDataFrame([(7, "KUUSI biojätteet"), (8, None)], "item_id long, text string")
    lemmas = lexicon.needle_lemmas(needles, known).withColumnRenamed("item_id", "phrase_id")
    assert [(r.phrase_id, r.doc_id) for r in index.phrase_hits(index.of(docs), lemmas).collect()] == [(7, 1)]
    tokens = T.tokens(F.lit("See 840-1, https://x.fi/a?b=1. Bio-waste - and"))
    assert values(spark, tokens)[0] == ["See", "840-1", "https://x.fi/a?b=1", "Bio-waste", "and"]


def test_one_question(spark, capsys):
    from kaivo import cli

    docs = spark.createDataFrame([(1, "glass jars", "a"), (2, "glass", "b"), (3, None, "a")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in rank.ask(docs, "glass", "a").collect()] == [1]
    for blank in ((" ", "a"), ("glass", "")):
        with pytest.raises(ValueError):
            rank.ask(docs, *blank)
    assert cli.main(["queries"]) == 0 and "token_gate" in capsys.readouterr().out


def test_share_of_a_long_quote_takes_time_in_proportion(spark):
    import time

    own = " ".join(f"w{i}" for i in range(20_000)) + " w1 w1"
    rows = spark.createDataFrame([(0, own, own.replace("w0 ", "").removesuffix(" w1")), (1, "a a b", "A c a a"), (2, "", None), (3, "a", None), (4, None, "a")], "k int, q string, a string")
    began = time.perf_counter()
    got = {r.k: r.x for r in rows.select("k", judged.quote_share(F.col("q"), F.col("a")).alias("x")).collect()}
    assert time.perf_counter() - began < 30  # each word was looked for in all others, and the texts were split again for each
    assert got == {0: 20_000 / 20_002, 1: 2 / 3, 2: 1.0, 3: None, 4: None}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ODD = [(1, "Bins bins bin containers", "a"), (2, "glass jars, glassy jar", "a"), (2, "glass containers", "b"), (3, None, "a"), (4, "the of and", "a"), (5, "glass jars", None), (6, "glass jars", "a"), (7, "glass jars", "a"), (8, "bins " * 300, "b"), (9, "abcdefabcdef ñandúñandúx 12345 mments", "b"), (6, "more glass", "a")]


def _odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame([(1, "glass jars"), (2, "bins containers"), (3, "the of"), (4, "abcdefghij ñandúñandúy mment"), (5, None)], "item_id long, text string")


def test_entries_hold_the_corpus_without_a_shuffle_of_words(spark):
    docs, _ = _odd(spark)
    ix, chunk = index.of(docs), index.passages(docs)
    same = lambda x, y: x.exceptAll(y).count() == 0 == y.exceptAll(x).count()
    assert same(ix.counts, index.word_counts(chunk).select("word", "authority", "doc_id", "n"))
    assert same(ix.lengths, index.lengths(chunk).select("analyser", "doc_id", "length"))
    tf = index.frequencies(index.word_counts(chunk)).groupBy("analyser", "doc_id", "lexeme").agg(F.sum("n").alias("tf"))
    assert same(index.totals(ix), tf.groupBy("analyser").agg(F.count("*").alias("postings"), F.sum("tf").alias("positions")))
    once = index.of(docs.where("doc_id not in (2, 6)"))
    assert "Exchange hash" not in _plan(once.entries) and "Exchange range" not in _plan(once.counts)


def test_best_passages_are_those_of_the_joins(spark):
    docs, asked = _odd(spark)
    ix = index.of(docs)
    for where in (rank.authorities(ix), None):
        for k in (1, 2, 5):
            x = rank.best(ix, asked, where, T.ANALYSERS, k=k)
            y = rank.ranked(rank.scored(ix, asked, where, T.ANALYSERS), k=k)
            assert x.exceptAll(y).count() == 0 == y.exceptAll(x).count() and x.count() > 0
    alone = docs.where("doc_id not in (2, 6)")
    # tasks keep the best of what they read: joins of postings, and sums of scores, are gone
    assert "Join" not in _plan(rank.best(index.of(alone), asked, None, (T.CONTROL,), (0,)))


def test_best_passages_of_slices_and_flushes(spark, monkeypatch):
    from kaivo.operators import postings

    docs, asked = _odd(spark)
    ix = index.of(docs)
    want = postings.wanted([tuple(r) for r in index.query_lexemes(index.questions(asked)).collect()], T.ANALYSERS)
    rows = ix.entries.where("authority is not null").drop("block", "shared").toArrow().to_batches()

    def found(whole):
        x = [r for b in postings.best(want, T.ANALYSERS, rank.NORMS, 2, whole)(iter(rows)) for r in b.to_pylist()]
        by = lambda r: (r["item_id"], r["analyser"], r["norm"], None if whole else r["authority"])
        x.sort(key=lambda r: (str(by(r)), -r["points"], r["doc_id"]))
        return [r for i, r in enumerate(x) if i < 2 or by(x[i - 2]) != by(r)]

    wide = [found(w) for w in (False, True)]
    monkeypatch.setattr(postings, "SLICE_CELLS", 5)
    monkeypatch.setattr(postings, "SLICE_WORDS", 2)
    monkeypatch.setattr(postings, "HELD_ROWS", 3)
    assert [found(w) for w in (False, True)] == wide


def test_phrases_and_texts_stay_where_they_are_read(spark):
    docs, asked = _odd(spark)
    ix = index.of(docs)
    p = asked.select(F.col("item_id").alias("phrase_id"), F.posexplode(T.kept(F.col("text"))).alias("ord", "lexeme"))
    x = index.phrases_held(ix, asked.select(F.col("item_id").alias("phrase_id"), "text"))
    y = index.phrase_hits(ix, p)
    assert {tuple(r) for r in x.collect()} == {tuple(r) for r in y.collect()} and x.count() >= 4
    wide = index.required(ix, index.questions(asked))
    for df in (x, wide):
        assert "SortMergeJoin" not in _plan(df) and "ShuffledHashJoin" not in _plan(df)


def test_more_needles_than_can_be_broadcast(spark, monkeypatch):
    docs, asked = _odd(spark)
    ix = index.of(docs)
    both = lambda: [sorted(map(str, x.collect())) for x in (index.required(ix, index.questions(asked)), index.phrases_held(ix, asked.select(F.col("item_id").alias("phrase_id"), "text")))]
    few = both()
    monkeypatch.setattr(index, "FIXED_ROWS", 0)
    assert both() == few


def test_contexts_join_only_bodies_of_hits(spark):
    from kaivo.operators import contracts

    chunk = index.passages(_odd(spark)[0].where("doc_id <> 2"))
    hits = spark.createDataFrame([(1, "a", 1, 7), (1, "a", 2, 99)], "item_id long, asked_in string, position int, doc_id long")
    x = contracts.contexts(hits, chunk)
    assert [(r.n, r.missing, r.context) for r in x.collect()] == [(2, 1, "glass jars\n\n")]
    assert "LeftSemi" in _plan(x)


def test_pairs_of_cells_need_one_pass(spark):
    rows = spark.createDataFrame([(1, "x", "stem", 0, 1, 1), (1, "x", "stem", 1, 1, 0), (2, "x", "stem", 0, 2, 2), (2, "x", "stem", 1, 2, 2), (None, "x", "stem", 0, 1, 1)], "item_id long, asked_in string, analyser string, norm int, n_required long, n_found long")
    x = evaluate.discordance(rows)
    assert [(r.cell_a, r.cell_b, r.a_only, r.b_only, r.p) for r in x.collect()] == [("stem/0", "stem/1", 1, 0, 1.0)]
    assert "Join" not in _plan(x)


def test_lemmas_are_looked_up_by_block(spark, tmp_path):
    from kaivo.operators import lexicon
    from kaivo.plans.recorded import _lexicon

    docs, asked = _odd(spark)
    words = index.of(docs).words.unionByName(asked.select(F.explode(T.words(F.col("text"))).alias("word")))
    known = _lexicon(words)
    for rows in (docs, docs.where("doc_id not in (2, 6)")):
        ix = index.store(rows, f"file://{tmp_path}/{rows.count()}")
        table = lexicon.lexemes(ix.words, known)
        n = table.groupBy("word", "analyser").agg(F.count("*").alias("k"))
        joined = ix.counts.join(n, "word").groupBy("analyser", "doc_id").agg(F.sum(F.col("n") * F.col("k")).alias("length"))
        mine = lexicon.positions(ix, known)
        assert mine.exceptAll(joined).count() == 0 == joined.exceptAll(mine).count()
        items = asked.select("item_id", F.explode(T.kept(F.col("text"))).alias("word")).distinct()
        wanted = items.join(lexicon.lexemes(items, known), "word").select("item_id", "analyser", "lexeme").distinct()
        y = rank.ranked(rank.summed(ix.counts, wanted, table.join(wanted, ["analyser", "lexeme"], "left_semi"), joined, rank.authorities(ix), lexicon.ANALYSERS), k=2)
        x = lexicon.hits(ix, asked, known, k=2)
        assert x.exceptAll(y).count() == 0 == y.exceptAll(x).count() and x.count() > 9
    assert "hashpartitioning(block" in _plan(x)  # blocks go behind their dictionaries, postings to no table of words

