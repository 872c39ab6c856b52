import pytest
from pyspark.sql import functions as F

from docmill.operators import nested, search, tables
from docmill.plans import profiles, reports, view
from docmill.streaming import events


def test_profiles(spark):
    tasks = spark.createDataFrame([("a", "Extract revenue and profit from the financial table"), ("b", "合同 条款 甲方"), ("c", "zzz"), ("d", None)], "task_id string, task string")
    best = {r["task_id"]: r for r in profiles.profile_scores(tasks).where("rank = 1").collect()}
    assert best["a"]["profile"] == "financial_report" and best["a"]["hits"] == 4 and best["b"]["profile"] == "standard_or_contract"
    assert best["c"]["score"] == 0.0 and best["c"]["profile"] != "general_document" and best["d"]["score"] == 0.0
    assert profiles.profile_scores(tasks, {"recipe": ("Cooking", "zzz")}).where("rank = 1 and task_id = 'c'").first()["profile"] == "recipe"


def test_intents(spark):
    tasks = spark.createDataFrame([(1, "top growth"), (2, "hello"), (3, None)], "task_id int, task string")
    got = sorted((r["task_id"], r["intent"]) for r in profiles.intents(tasks).collect())
    assert got == [(1, "comparison"), (1, "growth_analysis"), (1, "ranking"), (2, "structured_extraction"), (3, "structured_extraction")]


def test_comparisons(spark):
    text = "| item | now | was |\n| a | 110 | 100 |\n| b | 5 | 0 |\n| c | x | 1 |\n| d | 1,200 | 1,000 |"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = profiles.comparisons(tables.tables(df))
    assert [(r["label"], r["delta"], r["percent_change"]) for r in found.orderBy("row_index").collect()] == [("a", 10.0, 10.0), ("b", 5.0, None), ("d", 200.0, 20.0)]
    assert profiles.top_growth(found).first()["label"] == "d"


def test_lexical_search(spark):
    chunks = spark.createDataFrame([("s", 1, "Alpha beta"), ("s", 2, "alpha  BETA gamma"), ("s", 3, None), ("t", 4, "alpha beta")], "scope string, chunk_ord int, text string")
    asked = spark.createDataFrame([(1, "s", "beta gamma"), (2, "t", None), (3, "none", "x")], "query_id int, scope string, query string")
    got = [(r["query_id"], r["chunk_ord"], r["score"]) for r in search.lexical_top_k(asked, chunks, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 102), (1, 1, 1), (2, 4, 100)]


def test_nearest_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [0.0, 0.0])], "vec_id int, vector array<double>")
    got = search.nearest_vectors(rows.where("vec_id = 3").withColumnRenamed("vec_id", "query_id"), rows, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [4, 2] or [r["vec_id"] for r in got] == [4, 5]


def test_memory(spark):
    data = [("p", i, ["x"], "cleanup" if i % 2 else "initial", "pass", 90) for i in range(10)] + [("p", 50, ["y"], "retry", "fail", None)]
    df = spark.createDataFrame(data, "profile string, id int, issue_codes array<string>, action string, status string, score int")
    got = {r["action"]: r for r in reports.memory_stats(df).collect()}
    assert got["cleanup"]["successes"] == 5 and got["cleanup"]["recommended"] and not got["initial"]["recommended"] and got["retry"]["success_rate"] == 0.0
    assert {r["action"] for r in reports.memory_stats(df, ["y"]).collect()} == {"retry"}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, s double")
    got = {r["k"]: r for r in reports.threshold_failures(reports.load_report(df, F.col("s") < 4, "s", ["k"]), 0.9, 2.0).collect()}
    assert got["a"]["p50_s"] == 2.0 and got["a"]["failures"] == "p95" and got["b"]["failures"] == "success_rate,p95"
    checks = spark.createDataFrame([("x", True, True), ("x", True, False), ("y", False, False)], "g string, expected boolean, predicted boolean")
    rows = {r["g"]: r for r in reports.evaluation(checks, ["g"]).collect()}
    assert (rows["x"]["precision"], rows["x"]["recall"], rows["y"]["f1"]) == (1.0, 0.5, 1.0)
    chunks = spark.createDataFrame([("f", "A b"), ("f", "a  B"), ("f", None), ("f", "")], "file string, text string")
    (row,) = reports.chunk_validation(chunks, "file", "text", ("text",)).collect()
    assert (row["chunks"], row["duplicates"], row["empty_texts"], row["missing_fields"]) == (4, 1, 2, 1)


@pytest.fixture()
def landed(spark, tmp_path):
    rows = [(1, "u", "a", "2026-01-01 00:00:00"), (2, "u", "b", "2026-01-01 00:10:00"), (2, "u", "b", "2026-01-01 00:10:00"), (3, "v", "a", "2026-01-01 05:00:00"), (4, "u", "c", "2026-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "id int, user string, state string, t string").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df.schema, str(tmp_path)


def test_streams(spark, landed):
    path, schema, tmp = landed
    stream = lambda: events.timed(events.file_stream(spark, path, schema), "ts", "12 hours")
    events.run_available(events.without_repeats(stream(), ["id"]), f"{tmp}/once", f"{tmp}/c1")
    assert spark.read.parquet(f"{tmp}/once").count() == 4

    def collected(df, mode, name):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    states = collected(events.running_state(stream(), "user", "state"), "complete", "states")
    assert {(u, s) for u, s, _ in states} == {("u", "c"), ("v", "a")}
    counts = collected(events.window_counts(stream(), "user"), "complete", "counts")
    assert sorted(n for _, _, n in counts) == [1, 1, 3]
    spells = collected(events.sessions(stream(), "user"), "complete", "spells")
    assert sorted(n for *_, n in spells) == [1, 1, 3]


def test_a_failing_batch_is_reported_and_passed(spark, landed):
    path, schema, tmp = landed
    failed = []

    def use(batch, batch_id):
        raise ValueError("bad")

    events.per_batch(events.file_stream(spark, path, schema), f"{tmp}/c2", use, lambda i, e: failed.append(str(e)))
    assert failed == ["bad"]


def test_full_view(spark):
    text = "# A\nKey: value 12 on 2026-01-02\n| a | b |\n| --- | --- |\n| x | 1 |\n风险 建议 见第 3 页"
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in view.full_view(df).collect()}
    one = got[1]
    assert (len(one["sections"]), len(one["tables"]), one["heading_count"], one["dates"][0]["date"]) == (1, 1, 1, "2026-01-02")
    assert one["key_values"][0]["key"] == "Key" and one["anomaly_lines"][0]["line_no"] == 6 and one["references"][0]["target_page"] == 3
    assert got[2]["sections"] is None and got[3]["fallback_count"] == 1


def test_counts_and_groups(spark):
    df = spark.createDataFrame([("a", "done", "ax", 1.0), ("a", None, "b", 2.0), ("b", "bad", "zz", None)], "k string, status string, name string, s double")
    got = {r["k"]: tuple(r)[1:] for r in reports.status_counts(df, ["k"], "status", ("done", "bad")).collect()}
    assert got == {"a": (2, 1, 0, 1), "b": (1, 0, 1, 0)}
    grouped = reports.prefix_groups(df, "name", [("a", "A"), ("ax", "AX"), ("b", "B")])
    assert [r["group"] for r in grouped.collect()] == ["A", "B", "other"]
    assert {r["group"]: r["total_seconds"] for r in reports.group_summary(grouped, "s", "s").collect()} == {"A": 1.0, "B": 2.0, "other": 0.0}
    chunks = spark.createDataFrame([("f", "text", 1, [1, 2]), ("f", "table", 2, []), ("f", None, 5, None)], "file string, content_type string, page_no int, pages array<int>")
    assert tuple(reports.chunk_stats(chunks, "file").first()) == ("f", 3, "table=1,text=1,unknown=1", 3)


def test_run_status_of_every_run(spark):
    step = '{"steps": [{"status": "%s"}]}'
    rows = [(1, "completed", step % "failed"), (2, None, step % "failed"), (3, None, step % "completed"), (4, None, "{}"), (5, "", "not json"), (6, "failed", None), (7, None, step % "running")]
    trace = spark.createDataFrame(rows, "trace_id bigint, status string, payload string")
    got = {r["record_id"]: (r["steps"], r["failed"], r["status"]) for r in reports.run_status(trace, nested.trace_steps(trace), "trace_id", "status").collect()}
    assert got == {
        1: (1, 1, "completed"), 2: (1, 1, "failed_inferred"), 3: (1, 0, "completed_inferred"), 4: (0, 0, "unknown"), 5: (0, 0, "unknown"), 6: (0, 0, "failed"), 7: (1, 0, "unknown"),
    }
