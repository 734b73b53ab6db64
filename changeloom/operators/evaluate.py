"""Scoring predictions against labels.

Two shapes are served.  Nested records (one row per example) are scored by column expressions without any shuffle.
Long tables (one row per file) are scored through equi-joins on (example, file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.jsontext import commit_list_error, extract_json_object
from changeloom.functions.text import as_col, base_name, strip


def commit_type(subject: Column | str) -> Column:
    """Type of a conventional subject, '' without one."""
    return F.regexp_extract(strip(F.coalesce(as_col(subject), F.lit(""))), "^([a-z]+)[(:]", 1)


# -- long tables -------------------------------------------------------------------------------------------------


def grouping_f1(label_files: DataFrame, pred_files: DataFrame, example: str = "ex_id", label_ix: str = "label_ix",
                pred_ix: str = "pred_ix", file: str = "file", examples: DataFrame | None = None) -> DataFrame:
    """Mean over label commits of the best Jaccard overlap with any predicted commit.

    One row per example of ``examples``, or of either side where it is not given.  Without label commits the score is 0, or 1
    if there are no predicted ones either.  Only (label, predicted) pairs with a common file are ever formed; the rest score 0.
    """
    labels = label_files.select(example, label_ix, file).distinct()
    preds = pred_files.select(example, pred_ix, file).distinct()
    label_size = labels.groupBy(example, label_ix).agg(F.count(F.lit(1)).alias("_nl"))
    pred_size = preds.groupBy(example, pred_ix).agg(F.count(F.lit(1)).alias("_np"))
    common = labels.join(preds, [example, file]).groupBy(example, label_ix, pred_ix).agg(
        F.count(F.lit(1)).alias("_both"))
    overlap = common.join(pred_size, [example, pred_ix]).join(label_size, [example, label_ix])
    best = overlap.groupBy(example, label_ix).agg(
        F.max(F.col("_both") / (F.col("_nl") + F.col("_np") - F.col("_both"))).alias("_best"))
    scored = label_size.join(best, [example, label_ix], "left").groupBy(example).agg(
        F.avg(F.coalesce("_best", F.lit(0.0))).alias("_score"))
    every = labels.select(example, F.lit(0).alias("_pred")).unionByName(preds.select(example, F.lit(1).alias("_pred")))
    if examples is not None:
        every = every.unionByName(examples.select(example, F.lit(0).alias("_pred")))
    every = every.groupBy(example).agg(F.max("_pred").alias("_pred"))
    return every.join(scored, example, "left").select(
        example, F.coalesce("_score", F.when(F.col("_pred") == 1, 0.0).otherwise(1.0)).alias("file_grouping_f1"))


def type_accuracy(label_commits: DataFrame, pred_commits: DataFrame, example: str = "ex_id",
                  subject: str = "subject", examples: DataFrame | None = None) -> DataFrame:
    """Share of label commits whose type occurs in any predicted commit; untyped ones count as misses.

    One row per example of ``examples``, or of either side where it is not given; 1 without label commits.
    """
    wanted = label_commits.select(example, commit_type(subject).alias("_type"))
    seen = pred_commits.select(example, commit_type(subject).alias("_type")).where("_type <> ''").distinct()
    scored = wanted.join(seen.withColumn("_hit", F.lit(1.0)), [example, "_type"], "left").groupBy(example).agg(
        F.avg(F.coalesce("_hit", F.lit(0.0))).alias("_score"))
    every = label_commits.select(example).unionByName(pred_commits.select(example))
    if examples is not None:
        every = every.unionByName(examples.select(example))
    return every.distinct().join(scored, example, "left").select(example, F.coalesce("_score", F.lit(1.0)).alias("type_accuracy"))


# -- nested records ----------------------------------------------------------------------------------------------


def _files(commit: Column) -> Column:
    return F.array_distinct(F.coalesce(commit["files"], F.array().cast("array<string>")))


def grouping_f1_of(pred_commits: Column, label_commits: Column) -> Column:
    def jaccard(a, b):
        both = F.size(F.array_intersect(a, b))
        return F.when(both > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))

    preds = F.transform(pred_commits, _files)
    labels = F.filter(F.transform(label_commits, _files), lambda files: F.size(files) > 0)
    scores = F.transform(labels, lambda want: F.aggregate(
        preds, F.lit(0.0), lambda best, got: F.greatest(best, jaccard(want, got))))
    mean = F.aggregate(scores, F.lit(0.0), lambda total, s: total + s) / F.size(scores)
    return (
        F.when(F.size(label_commits) == 0, F.when(F.size(pred_commits) == 0, 1.0).otherwise(0.0))
        .when(F.size(scores) == 0, 0.0).otherwise(mean)
    )


def type_accuracy_of(pred_commits: Column, label_commits: Column) -> Column:
    seen = F.array_remove(F.transform(pred_commits, lambda c: commit_type(c["subject"])), "")
    hits = F.filter(label_commits, lambda c: F.array_contains(seen, commit_type(c["subject"])))
    return F.when(F.size(label_commits) == 0, 1.0).otherwise(F.size(hits) / F.size(label_commits))


def is_ignored(path: Column, rules: Column) -> Column:
    """Whether any rule matches: '*x' by ending, 'd/' as a component or a raw prefix, else by exact or base name."""

    def matches(rule):
        stem = F.substring(rule, F.lit(1), F.length(rule) - 1)
        inside = F.contains(F.concat(F.lit("/"), path), F.concat(F.lit("/"), rule))
        exact = (path == rule) | (base_name(path) == rule) | F.endswith(path, F.concat(F.lit("/"), rule))
        return (
            F.when(rule.startswith("*"), F.endswith(path, F.substring(rule, F.lit(2), F.length(rule))))
            .when(rule.endswith("/"), inside | F.startswith(path, stem)).otherwise(exact)
        )

    return F.exists(rules, matches)


def junk_routing_of(pred_commits: Column, rules: Column, injected: Column) -> Column:
    """Share of injected files that are ignored and not committed; NULL when nothing was injected."""
    committed = F.flatten(F.transform(pred_commits, _files))
    routed = F.filter(injected, lambda f: ~F.array_contains(committed, f) & is_ignored(f, rules))
    return F.when(F.size(injected) > 0, F.size(routed) / F.size(injected))


def prediction_status(responses: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``raw_json`` and ``parsed``: an object was found, decodes, and its commits are a list."""
    found = extract_json_object(responses, content)
    usable = F.col("json_error").isNull() & commit_list_error("raw_json", allow_empty=True).isNull()
    return found.withColumn("parsed", usable).drop("json_error")


def result_rows(examples: DataFrame, predictions: DataFrame, key: str = "example_key",
                verbose: bool = False) -> DataFrame:
    """One result per example; metrics are NULL unless the prediction was parsed.

    ``predictions`` holds (key, parsed, raw_json).  ``verbose`` keeps prediction and label.
    """
    from changeloom.schemas import LABEL_COMMIT

    none = F.array().cast(f"array<{LABEL_COMMIT}>")
    pred = F.from_json("raw_json", f"commits array<{LABEL_COMMIT}>, gitignore array<string>")
    joined = examples.join(predictions.select(key, "parsed", pred.alias("_pred")), key, "left").withColumn(
        "parsed", F.coalesce("parsed", F.lit(False)))
    got = F.coalesce("_pred.commits", none)
    want = F.coalesce("label.commits", none)
    rules = F.coalesce("_pred.gitignore", F.array().cast("array<string>"))
    injected = F.coalesce("injected_files", F.array().cast("array<string>"))
    extra = [F.when(F.col("parsed"), F.col("_pred")).alias("predicted"), F.col("label")] if verbose else []
    return joined.select(
        key, "repo_url", "languages", "noise_injected", "parsed", *extra,
        F.when(F.col("parsed"), grouping_f1_of(got, want)).alias("file_grouping_f1"),
        F.when(F.col("parsed"), type_accuracy_of(got, want)).alias("type_accuracy"),
        F.when(F.col("parsed"), junk_routing_of(got, rules, injected)).alias("junk_routing"))


# -- report ------------------------------------------------------------------------------------------------------

METRICS = ("file_grouping_f1", "type_accuracy", "junk_routing")


def report_totals(results: DataFrame) -> DataFrame:
    per_metric = [agg for m in METRICS for agg in (F.avg(m).alias(f"avg_{m}"), F.count(m).alias(f"n_{m}"))]
    return results.agg(F.count(F.lit(1)).alias("n"), F.count_if("parsed").alias("n_parsed"),
                       F.coalesce(F.avg(F.col("parsed").cast("double")), F.lit(0.0)).alias("parse_rate"), *per_metric)


def report_by_language(results: DataFrame) -> DataFrame:
    """Parsed results by first language, largest first, with the total in the NULL row (two grouping sets)."""
    first = F.coalesce(F.try_element_at("languages", F.lit(1)), F.lit("unknown"))
    return (
        results.where("parsed").select(first.alias("language"), "file_grouping_f1").rollup("language")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("file_grouping_f1").alias("avg_file_grouping_f1"))
        .orderBy(F.desc("n"), "language")
    )


def publishable(examples: DataFrame, private_repos: DataFrame, repo: str = "repo_url") -> DataFrame:
    """Drop examples of listed repositories.  Catalyst broadcasts the list only if its size allows."""
    return examples.join(private_repos.select(repo).distinct(), repo, "left_anti")
