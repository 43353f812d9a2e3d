"""Readers and writers of recorded runs, verdicts, labels and baselines: explicit schemas, strict, atomic."""

from __future__ import annotations

import json
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaivo.operators.contracts import manifest_problems
from kaivo.operators.evaluate import Violation, require_empty

USAGE = "struct<prompt_tokens:int,completion_tokens:int,reasoning_tokens:int,total_tokens:int,cost_usd:double>"
ANSWER = f"struct<question_id:string,population:string,kind:string,question:string,municipality:string,authority_key:string,retrieved:array<string>,refused:boolean,text:string,citations:array<string>,finish_reason:string,usage:{USAGE}>"
RUN = f"cell string, k int, model string, reasoning boolean, commit string, answered_at_commit string, tokens bigint, cost_usd double, ceiling bigint, answers array<{ANSWER}>"
LABELS = "version int, sample string, labels array<struct<question_id:string,unit:string,index:int,stated:boolean,supported:boolean,asserted:boolean,note:string>>"
BASELINE = "analyser string, norm int, questions bigint, required bigint, complete_set_recall double, passage_recall double, mrr double, leakage double"
POPULATIONS = ("answerable", "refusal")
COVERS = "authority string, name string, place string, part string"
QUESTIONS = "qid string, text string, population string, authority string, kind string, required array<string>, n_branches int, n_forbidden int"
CASES = "case_id string, qid string, shape string, answer string, citations array<string>"
EXPECTATIONS = "case_id string, unit string, idx int, field string, expect boolean"
#: Written by hand, so read on the driver up to so many bytes together; more is refused.
HAND_WRITTEN = 64 << 20


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """One row per recorded answer, with the run's own columns; empty text, unknown population or a repeated id is refused."""
    run = spark.read.schema(RUN).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rows = run.select("cell", "k", F.coalesce("commit", "answered_at_commit").alias("commit"), F.explode("answers").alias("a")).select("cell", "k", "commit", "a.*")
    rows = rows.withColumn("dirty", F.coalesce(F.col("commit").endswith("-dirty") | (F.col("commit") == ""), F.lit(True)))
    require_empty(rows.where(~F.coalesce(F.col("population").isin(*POPULATIONS), F.lit(False))).select("question_id", "population"), "unknown population")
    require_empty(rows.where("not refused and trim(coalesce(text, '')) = ''").select("question_id"), "an answer without text")
    require_empty(rows.groupBy("question_id").count().where("count > 1"), "a question twice")
    return rows


def _hand_written(spark: SparkSession, path: str) -> list[tuple[str, dict]]:
    """(name, content) of a YAML or JSON file, or of a folder of such files in the order of their names. Each is an object of version 1."""
    files = spark.read.format("binaryFile").load(path)
    if (files.agg(F.sum("length")).first()[0] or 0) > HAND_WRITTEN:
        raise Violation(f"{path}: more than {HAND_WRITTEN} bytes")
    found = []
    for r in files.where(F.lower("path").rlike("[.](ya?ml|json)$")).orderBy("path").select("path", "content").collect():
        text = bytes(r.content).decode()
        if r.path.lower().endswith(".json"):
            value = json.loads(text)
        else:
            import yaml  # only where such files are read

            value = yaml.safe_load(text)
        if not isinstance(value, dict) or value.get("version") != 1:
            raise Violation(f"{r.path}: not an object of version 1")
        found.append((r.path, value))
    if not found:
        raise Violation(f"{path}: no YAML or JSON file")
    return found


def _listed(path: str, value: dict, key: str) -> list[dict]:
    rows = value.get(key)
    if not isinstance(rows, list) or not rows or not all(isinstance(x, dict) for x in rows):
        raise Violation(f"{path}: `{key}` must be a list of objects with one at least")
    return rows


def _required(path: str, row: dict, *keys: str) -> list[str]:
    missing = [k for k in keys if not str(row.get(k) or "").strip()]
    if missing:
        raise Violation(f"{path}: {missing} missing in {row}")
    return [str(row[k]) for k in keys]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """authority, name, place, part: what authorities cover, in whole (part null) or in part; doubtful coverage and repeated keys are refused."""
    rows, keys = [], []
    for at, value in _hand_written(spark, path):
        for a in _listed(at, value, "authorities"):
            key, name = _required(at, a, "key", "name")
            keys.append(key)
            rows += [(key, name, str(p), None) for p in a.get("places") or []]
            rows += [(key, name, *_required(at, p, "place", "part")) for p in a.get("partial") or []]
    if len(set(keys)) < len(keys):
        raise Violation(f"{path}: an authority twice")
    covers = spark.createDataFrame(rows, COVERS)
    require_empty(manifest_problems(covers), f"{path}: unclear coverage")
    return covers


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of both populations, one row each, from a file or a folder; what is wrong with their content is for ``question_problems``."""
    rows = []
    for at, value in _hand_written(spark, path):
        for q in _listed(at, value, "questions"):
            qid, text, population, authority = _required(at, q, "id", "question", "population", "authority")
            if population not in POPULATIONS:
                raise Violation(f"{at}: {qid} has population {population}")
            rows.append((qid, text, population, authority, q.get("kind"), [str(x) for x in q.get("required") or []], len(q.get("branches") or []), len(q.get("forbidden") or [])))
    return spark.createDataFrame(rows, QUESTIONS)


def read_control(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, what each must catch); ``offline.control_problems`` must be empty before they are used."""
    cases, must = [], []
    for at, value in _hand_written(spark, path):
        for c in _listed(at, value, "cases"):
            (case,) = _required(at, c, "id")
            cases.append((case, c.get("question_id"), c.get("shape"), c.get("answer"), [str(x) for x in c.get("citations") or []]))
            must += [(case, str(x.get("unit")), int(x.get("index") or 0), str(x.get("field")), bool(x.get("expect"))) for x in c.get("must_catch") or []]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(must, EXPECTATIONS)


def write_answers(answers: DataFrame, path: str, **run: object) -> None:
    """Answers with all their nested fields as JSON lines, each with its run's columns, beside each other in ``path``; nulls are kept."""
    answers.select(*(F.lit(v).alias(k) for k, v in run.items()), *answers.columns).write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """qid, unit, idx, field, value of hand labels; fields that don't apply have no row, and ``supported`` none unless stated."""
    x = spark.read.schema(LABELS).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.explode("labels").alias("x")).select("x.*")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("stated", F.col("stated")), ("supported", F.when(F.col("stated"), F.col("supported"))), ("asserted", F.col("asserted")))))
    return x.select(F.col("question_id").alias("qid"), "unit", F.col("index").alias("idx"), F.explode(fields).alias("f")).select("qid", "unit", "idx", "f.field", "f.value").where("value is not null")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE).json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside ``path`` and swaps, so that a failed run leaves the former table whole."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.rename(at, jvm.org.apache.hadoop.fs.Path(old))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(new), at):
        raise OSError(f"{new} can't be renamed to {path}")
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def pinned(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources (path, content) whose SHA-256 isn't the manifest's (path, sha256): must be empty before anything is read."""
    return files.select("path", F.sha2("content", 256).alias("found")).join(manifest, "path", "full_outer").where(~F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)))


def provenance(folder: str = ".") -> str:
    """The commit, with -dirty if the tree has changes; empty outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True).stdout.strip()
    head = git("rev-parse", "HEAD")
    return head + ("-dirty" if head and git("status", "--porcelain") else "")
