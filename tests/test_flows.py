"""Composed flows, streaming restarts and the driver contract."""

import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from changeloom import schemas
from changeloom.operators import label as L
from changeloom.plans import flows
from changeloom.streaming import intake

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

KEYS = "example_key string, diff string"


def write_batch(spark, folder, rows):
    spark.createDataFrame(rows, KEYS).coalesce(1).write.mode("append").parquet(folder)


def test_intake_takes_each_key_once_across_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    labelled = spark.createDataFrame([("done", "x")], KEYS)

    def run():
        stream = spark.readStream.schema(KEYS).parquet(source)
        intake.start_intake(stream, out, checkpoint, labelled=labelled).awaitTermination()
        return sorted(r.example_key for r in spark.read.parquet(out).collect())

    write_batch(spark, source, [("a", "1"), ("a", "1"), ("b", "2"), ("done", "3")])
    assert run() == ["a", "b"]
    write_batch(spark, source, [("b", "2"), ("c", "4"), ("done", "3")])
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]


def test_intake_with_a_fresh_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    labelled = spark.createDataFrame([("done", 1), ("open", None)], "example_key string, label int")
    for run, rows in enumerate(([("a", "1"), ("b", "2"), ("open", "9")], [("b", "2"), ("c", "3"), ("done", "4")])):
        write_batch(spark, f"{source}{run}", rows)
        stream = spark.readStream.schema(KEYS).parquet(f"{source}{run}")
        intake.start_intake(stream, out, str(tmp_path / f"checkpoint{run}"), labelled=labelled).awaitTermination()
    assert sorted(r.example_key for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "open"]


def test_intake_reads_nothing_back_that_it_wrote(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for i in range(6):
        write_batch(spark, source, [(f"k{i}", "x"), (f"k{i - 1}", "y"), (f"k{i}", "z")])
    stream = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", 1).parquet(source)
    read = []
    asked = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **o: read.append(paths) or asked(self, *paths, **o))
    query = intake.start_intake(stream, out, checkpoint)
    query.awaitTermination()
    assert not read
    progress = [p for p in query.recentProgress if p.numInputRows]
    # State grows by the new keys of a batch; a batch updates no more rows than it brings.
    state = [p.stateOperators[0] for p in progress]
    assert len(progress) >= 6 and max(s.numRowsUpdated for s in state) <= 2 and state[-1].numRowsTotal == 7
    assert sorted(r.example_key for r in spark.read.parquet(out).collect()) == sorted(f"k{i}" for i in range(-1, 6))
    # Another checkpoint meets these keys through the index, and the first one meets the other's.
    write_batch(spark, f"{source}2", [("k3", "x"), ("new", "y")])
    second = spark.readStream.schema(KEYS).parquet(f"{source}2")
    intake.start_intake(second, out, f"{checkpoint}2").awaitTermination()
    write_batch(spark, source, [("new", "x"), ("k9", "y")])
    intake.start_intake(stream, out, checkpoint).awaitTermination()
    assert sorted(r.example_key for r in spark.read.parquet(out).collect()) == sorted(
        [*(f"k{i}" for i in range(-1, 6)), "new", "k9"])


def test_counters_across_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    ddl = "model string, ok boolean, tokens bigint"

    def run(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        intake.start_counters(spark.readStream.schema(ddl).parquet(source), ["model"], out, checkpoint).awaitTermination()
        return {r.model: (r.ok, r.failed, r.total_tokens) for r in intake.newest_counters(spark, out, ["model"]).collect()}

    assert run([("m", True, 5), ("m", False, 9), ("n", True, 1)]) == {"m": (1, 1, 5), "n": (1, 0, 1)}
    assert run([("m", True, 2)]) == {"m": (2, 1, 7), "n": (1, 0, 1)}


def test_score_flow(spark):
    commit = {"subject": "fix: a", "files": ["a.py"], "body": "", "issues": []}
    label = {"commits": [commit], "gitignore": [], "model": "m", "usage": None}
    rows = [("r", None, f"b{i}", "h", 1, "d", ["a.py"], [], [], ["python"], True, ["x.pyc"], label) for i in range(3)]
    examples = spark.createDataFrame(rows, schemas.LABELLED).withColumn("example_key", L.example_key())
    good = json.dumps({"commits": [{"subject": "fix: b", "files": ["a.py", "b.py"]}], "gitignore": ["*.pyc"]})
    texts = {"b0": f"```json\n{good}\n```", "b1": "no json"}
    responses = spark.createDataFrame(
        [(f"r@{b}..h", json.dumps({"choices": [{"message": {"content": c}}]})) for b, c in texts.items()],
        "example_key string, response string")
    results, totals, languages = flows.score_predictions(examples, responses)
    got = {r.example_key: (r.parsed, r.file_grouping_f1, r.type_accuracy, r.junk_routing) for r in results.collect()}
    assert got == {"r@b0..h": (True, 0.5, 1.0, 1.0), "r@b1..h": (False, None, None, None),
                   "r@b2..h": (False, None, None, None)}
    total = totals.first()
    assert (total.n, total.n_parsed, total.n_file_grouping_f1) == (3, 1, 1)
    assert [(r.language, r.n) for r in languages.collect()] == [(None, 1), ("python", 1)]


def test_plan_check_and_context(spark):
    claims = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 0, "zz")], "plan int, commit_ix int, hunk string")
    hunks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "plan int, hunk string")
    skipped = spark.createDataFrame([(1, "b"), (1, "yy")], "plan int, hunk string")
    got = {(r.hunk, r.problem) for r in flows.check_plan(claims, hunks, skipped).collect()}
    assert got == {("zz", "unknown"), ("a", "double"), ("yy", "invalid_skip"), ("c", "unassigned")}
    rows = [(1, i, f"f::{i}", "f", "+" * n, False, False) for i, n in enumerate([60_000, 6_000, 100], 1)]
    hunk_rows = spark.createDataFrame(
        rows, "plan int, pos int, hunk_id string, file_path string, patch string, is_untracked boolean, is_binary boolean")
    shown = flows.model_context(hunk_rows, ["plan"], "pos").orderBy("pos").collect()
    assert [(r.needs_summary, r.charged, r.spent_before) for r in shown] == [(True, 0, 0), (False, 6000, 0), (False, 100, 6000)]


def test_label_round_trip(spark):
    examples = spark.createDataFrame([("r", "b", "h")], "repo_url string, base_commit string, head_commit string").select(
        "*", L.example_key().alias("example_key"))
    raw = '{"commits":[{"zeta":1,"subject":"fix: é","files":["a"]}],"gitignore":["x"]}'
    response = json.dumps({"choices": [{"message": {"content": raw}}], "usage": {"total_tokens": 7}})
    parsed = L.parse_responses(spark.createDataFrame([("r@b..h", response)], "example_key string, response string"))
    row = L.attach_labels(examples, parsed, "m").first()
    assert row.label.commits[0].subject == "fix: é" and row.label.usage.total_tokens == 7
    from changeloom.operators.prepare import assistant_text_of_json

    text = spark.createDataFrame([(row.label_json,)], "j string").select(assistant_text_of_json("j").alias("t")).first().t
    assert text == raw


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).groupBy("split").agg(F.sum("n")).count() >= 3
    assert set(contract.oracle_sql()) <= set(contract.queries())
