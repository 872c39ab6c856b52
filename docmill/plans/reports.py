"""Reports over saved runs: counters, rates, percentiles and histograms as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.rows import each

#: Outcomes of a profile that recovery memory looks back on, and actions it recommends.
LOOK_BACK, RECOMMENDED = 200, 3


def load_report(requests: DataFrame, ok: Column, seconds: str, by: list[str]) -> DataFrame:
    """by, n, success_rate, and the least, median, 95th percentile and most seconds: interpolated, exact."""
    s = F.col(seconds)
    rate = T.ratio(F.count_if(ok).cast("double"), F.count("*"), 0.0)
    return requests.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(rate, 6).alias("success_rate"), F.min(s).alias("min_s"),
        F.round(F.percentile(s, F.lit(0.5)), 6).alias("p50_s"), F.round(F.percentile(s, F.lit(0.95)), 6).alias("p95_s"), F.max(s).alias("max_s"),
    )


def threshold_failures(report: DataFrame, least_success: float, most_p95: float) -> DataFrame:
    """report with failures: the thresholds a row breaks."""
    checks = F.array(F.when(F.col("success_rate") < least_success, "success_rate"), F.when(F.col("p95_s") > most_p95, "p95"))
    return report.withColumn("failures", F.array_join(F.filter(checks, lambda x: x.isNotNull()), ","))


def run_status(runs: DataFrame, steps: DataFrame, id_col: str, status_col: str) -> DataFrame:
    """(record_id, steps, failed, status) of every run: its own status, or else what its steps, (record_id, status), tell.

    Runs without readable steps are unknown unless they have a status; repeated rows come out each.
    """
    n = steps.groupBy("record_id").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "completed").alias("done"))
    own = runs.select(F.col(id_col).alias("record_id"), F.when(F.col(status_col) != "", F.col(status_col)).alias("own"))
    every = own.join(n, "record_id", "left").fillna(0, ["steps", "failed", "done"])
    inferred = F.when(F.col("failed") > 0, "failed_inferred").when((F.col("steps") > 0) & (F.col("done") == F.col("steps")), "completed_inferred").otherwise("unknown")
    return every.select("record_id", "steps", "failed", F.coalesce("own", inferred).alias("status"))


def tool_report(calls: DataFrame) -> DataFrame:
    """(tool, calls, failed, total_seconds, max_seconds) over tool calls."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.sum("elapsed_seconds"), 3).alias("total_seconds"), F.round(F.max("elapsed_seconds"), 3).alias("max_seconds"),
    )


def long_document_report(ranges: DataFrame) -> DataFrame:
    """(case_id, ranges, completed, failed, success_rate, chunks, seconds) of page ranges."""
    done = F.count_if(F.col("status") == "completed")
    return ranges.groupBy("case_id").agg(
        F.count("*").alias("ranges"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(done / F.count("*"), 4).alias("success_rate"), F.coalesce(F.sum("retrieval_chunks"), F.lit(0)).alias("chunks"), F.round(F.sum("elapsed_seconds"), 3).alias("seconds"),
    )


def issue_histogram(rows: DataFrame, codes: str = "issue_codes") -> DataFrame:
    """(code, n): how often each code stands in the lists of codes."""
    return each(rows, [], codes, "at", "code").groupBy("code").agg(F.count("*").alias("n"))


def chunk_validation(chunks: DataFrame, by: str, text_col: str, need: tuple[str, ...]) -> DataFrame:
    """by, chunks, missing_fields, empty_texts, duplicates, min_chars, avg_chars, max_chars.

    A duplicate is a row beyond the first with the same normalised text in its group; texts are hashed before they are
    counted, so no group of texts is ever held.
    """
    missing = sum((F.col(c).isNull().cast("int") for c in need), F.lit(0))
    norm = T.normalized(F.coalesce(text_col, F.lit("")))
    rows = chunks.select(F.col(by).alias(by), missing.alias("missing"), F.nullif(norm, F.lit("")).alias("norm"), F.length(F.coalesce(text_col, F.lit(""))).alias("chars"))
    per_text = rows.groupBy(by, F.md5("norm").alias("h")).agg(
        F.count("*").alias("n"), F.sum("missing").alias("missing"), F.min("chars").alias("lo"), F.max("chars").alias("hi"), F.sum("chars").alias("chars")
    )
    return per_text.groupBy(by).agg(
        F.sum("n").alias("chunks"), F.sum("missing").alias("missing_fields"), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("empty_texts"),
        F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.min("lo").alias("min_chars"), F.round(F.sum("chars") / F.sum("n"), 4).alias("avg_chars"), F.max("hi").alias("max_chars"),
    )


def memory_stats(outcomes: DataFrame, issue_codes: list[str] | None = None, look_back: int = LOOK_BACK) -> DataFrame:
    """(profile, action, attempts, successes, success_rate, avg_score, rank, recommended) of (profile, id, issue_codes,
    action, status, score): how each action did among a profile's most recent outcomes.

    With issue_codes only outcomes that share one count. A success has status `pass` and isn't the initial attempt. Of
    the best ranked actions that ever succeeded the first RECOMMENDED are recommended.
    """
    recent = Window.partitionBy("profile").orderBy(F.desc("id"))
    rows = outcomes.withColumn("no", F.row_number().over(recent)).where(F.col("no") <= look_back)
    if issue_codes:
        rows = rows.where(F.arrays_overlap("issue_codes", F.array(*[F.lit(c) for c in issue_codes])))
    action = F.coalesce("action", F.lit("initial"))
    good = F.count_if((F.col("status") == "pass") & (action != "initial"))
    stats = rows.groupBy("profile", action.alias("action")).agg(
        F.count("*").alias("attempts"), good.alias("successes"), F.round(good / F.count("*"), 4).alias("success_rate"), F.round(F.avg(F.coalesce("score", F.lit(0))), 2).alias("avg_score")
    )
    order = Window.partitionBy("profile").orderBy(F.desc("success_rate"), F.desc("successes"), F.desc("avg_score"), "action")
    fit = (F.col("action") != "initial") & (F.col("successes") > 0)
    ranked = stats.withColumn("rank", F.row_number().over(order))
    place = F.count_if(fit).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("recommended", fit & (place <= RECOMMENDED))


def evaluation(checks: DataFrame, by: list[str]) -> DataFrame:
    """by, expected, matched, predicted, accuracy, precision, recall, f1 of checks (expected BOOLEAN, predicted BOOLEAN)."""
    both = F.count_if(F.col("expected") & F.col("predicted"))
    counts = checks.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("expected").alias("expected"), F.count_if("predicted").alias("predicted"), both.alias("matched"), F.count_if(F.col("expected") == F.col("predicted")).alias("right"))
    p, r = T.ratio(F.col("matched"), F.col("predicted"), 1.0), T.ratio(F.col("matched"), F.col("expected"), 1.0)
    return counts.select(*by, "n", "expected", "predicted", "matched", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(T.f1(p, r), 6).alias("f1"))


def pair_deltas(pairs: DataFrame, key: str, side: str, baseline: str, other: str, metric: str) -> DataFrame:
    """key, baseline and other values of metric and their delta: the rows of one side joined to those of the other."""
    a = pairs.where(F.col(side) == baseline).select(key, F.col(metric).alias("baseline_value"))
    b = pairs.where(F.col(side) == other).select(key, F.col(metric).alias("other_value"))
    return a.join(b, key, "left").withColumn("delta", F.col("other_value") - F.col("baseline_value"))


def repeated_tool(turns: DataFrame, key: str, order: list[str], tool: str, times: int = 3) -> DataFrame:
    """turns with repeated: whether the tool of a turn is that of the times - 1 turns before as well."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.lit(True)
    for i in range(1, times):
        same = same & (F.lag(tool, i).over(w) == F.col(tool))
    return turns.withColumn("repeated", F.coalesce(same, F.lit(False)))


def gated(turns: DataFrame, key: str, order: list[str], gate: Column) -> DataFrame:
    """turns with open: whether gate held at an earlier turn of the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("open", F.coalesce(F.max(gate).over(w), F.lit(False)))


def current_state(events: DataFrame, key: str, state: str, order: Column) -> DataFrame:
    """(key, state): the last state of each key by order."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state))


def status_counts(rows: DataFrame, by: list[str], column: str, values: tuple[str, ...]) -> DataFrame:
    """by, total, a count for each of values, and other: how often column has each value; null counts as other."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    known = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *counts, F.count_if(~known).alias("other"))


def chunk_stats(chunks: DataFrame, by: str) -> DataFrame:
    """by, total_chunks, types (`type=n` in order, joined by commas), pages: distinct pages named by chunks (content_type,
    page_no, pages)."""
    paged = chunks.select(by, F.coalesce("content_type", F.lit("unknown")).alias("type"), F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.array("page_no")).alias("pages"))
    typed = paged.groupBy(by, "type").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda t: F.concat_ws("=", t["type"], t["n"].cast("string"))), ",")
    pages = each(paged, [by], "pages", "at", "page").where("page is not null").groupBy(by).agg(F.countDistinct("page").alias("pages"))
    return typed.groupBy(by).agg(F.sum("n").alias("total_chunks"), listed.alias("types")).join(pages, by, "left").na.fill(0, ["pages"])


def prefix_groups(cases: DataFrame, column: str, prefixes: list[tuple[str, str]]) -> DataFrame:
    """cases with group: that of the first prefix column begins with, or `other`."""
    out = F.lit("other")
    for prefix, group in reversed(prefixes):
        out = F.when(F.col(column).startswith(prefix), group).otherwise(out)
    return cases.withColumn("group", F.coalesce(out, F.lit("other")))


def group_summary(cases: DataFrame, score: str, seconds: str) -> DataFrame:
    """(group, n, avg_score, total_seconds, avg_seconds) of cases with a group."""
    return cases.groupBy("group").agg(
        F.count("*").alias("n"), F.round(F.avg(score), 2).alias("avg_score"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 3).alias("total_seconds"), F.round(F.avg(seconds), 3).alias("avg_seconds")
    )


#: Fields that a chunk must have, and the kinds some of them must be of.
CHUNK_FIELDS = ("chunk_id", "page_no", "pages", "content_type", "section_title", "chunk_text", "image_path")


def chunk_errors(rows: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, error): what is wrong with a chunk kept as JSON: it is no object, lacks a field, or `pages` is no list,
    `page_no` no whole number or `chunk_text` no text. A field that is null is there, but of no kind."""
    value = rows.select(key, F.try_parse_json(json_col).alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    fields = value.select(key, F.try_variant_get("v", "$", "map<string,variant>").alias("fields"), kind("$.pages").alias("pages"), kind("$.page_no").alias("page_no"), kind("$.chunk_text").alias("chunk_text"))
    has = lambda name: F.coalesce(F.array_contains(F.map_keys("fields"), name), F.lit(False))
    wrong = lambda name, ok, error: F.when(has(name) & ~F.coalesce(ok, F.lit(False)), error)
    checks = [F.when(~has(name), f"missing:{name}") for name in CHUNK_FIELDS] + [
        wrong("pages", F.col("pages").startswith("ARRAY"), "pages_not_list"),
        wrong("page_no", F.col("page_no") == "BIGINT", "page_no_not_int"),
        wrong("chunk_text", F.col("chunk_text") == "STRING", "chunk_text_not_string"),
    ]
    found = F.when(F.col("fields").isNull(), F.array(F.lit("chunk is not an object"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))
    return each(fields, [key], found, "at", "error").drop("at")


def check_summary(checks: DataFrame) -> DataFrame:
    """(kind, expected, matched, failed, rate) of checks (kind, expected BOOLEAN, passed BOOLEAN), and a row `*` over all:
    how many of the expected ones passed. Checks that aren't expected count for nothing; a kind with none has rate 1."""
    counts = checks.rollup("kind").agg(F.count_if("expected").alias("expected"), F.count_if(F.col("expected") & F.col("passed")).alias("matched"), F.grouping("kind").alias("whole"))
    rate = F.round(T.ratio(F.col("matched"), F.col("expected"), 1.0), 6)
    return counts.select(F.when(F.col("whole") == 1, "*").otherwise(F.col("kind")).alias("kind"), "expected", "matched", (F.col("expected") - F.col("matched")).alias("failed"), rate.alias("rate"))


def matched_runs(rows: DataFrame, runs: DataFrame, key: str, first: str, second: str, run_key: str) -> DataFrame:
    """(key, run_key, matched_by): the run of each row: the least one with the same `first` value, or else with the same
    `second`; matched_by names which, null for neither. Runs are reduced to one per value before they are joined."""
    least = lambda by: runs.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(run_key).alias(f"by_{by}"))
    joined = rows.select(key, first, second).join(least(first), first, "left").join(least(second), second, "left")
    by = F.when(F.col(f"by_{first}").isNotNull(), first).when(F.col(f"by_{second}").isNotNull(), second)
    return joined.select(key, F.coalesce(f"by_{first}", f"by_{second}").alias(run_key), by.alias("matched_by"))
