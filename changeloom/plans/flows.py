"""Operators composed into the flows users run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.operators import conversations as M
from changeloom.operators import diffs as D
from changeloom.operators import evaluate as E
from changeloom.operators import label as L
from changeloom.operators import plans as C
from changeloom.operators import prepare as P
from changeloom.session import durable
from changeloom.sources import tables as T


def split_counts(examples: DataFrame, labels: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Count distinct examples by split and language: pending, bad label, train, val.

    ``examples`` holds (example_key, repo_url, language), possibly drawn twice; ``labels`` (example_key, label).
    """
    keyed = examples.groupBy("example_key").agg(F.min("repo_url").alias("repo_url"), F.min("language").alias("language"))
    state = keyed.join(labels, "example_key", "left").select(
        "example_key", "language", P.stratum(F.array("language")).alias("stratum"),
        F.when(F.col("label").isNull(), "pending").when(P.label_problem().isNotNull(), "bad_label").alias("state"))
    split = P.stratified_split(state.where("state IS NULL"), fraction, seed).select(
        F.substring_index("stratum", ":", 1).alias("language"), "split")
    rest = state.where("state IS NOT NULL").select("language", F.col("state").alias("split"))
    return split.unionByName(rest).groupBy("split", "language").agg(F.count(F.lit(1)).alias("n"))


def label_requests(examples: DataFrame, labelled: DataFrame, model: str, prompt: L.PromptSet = L.LABEL_PROMPT,
                   limit: int | None = None, seed: int = 42, effort: str | None = None) -> DataFrame:
    """Pending examples with noise and their request body.  The prompt is added last, as a constant."""
    pending = L.pending_examples(examples.withColumn("example_key", L.example_key()), labelled, limit)
    noisy = L.inject_noise(pending, seed=seed)
    return noisy.withColumn("request", L.request_body(L.build_messages(prompt), model, effort=effort))


def sft_records(labelled: DataFrame, variants: int = 1, fraction: float = 0.1, seed: int = 42,
                prompt: L.PromptSet = L.SFT_PROMPT, reference_compat: bool = False) -> DataFrame:
    """Labelled examples to chat records with their split.

    Example columns stay, because evaluation reads them; ``prepare.strip_metadata`` belongs to the export.
    """
    keyed = labelled.withColumn("example_key", L.example_key()).withColumn("stratum", P.stratum())
    usable = keyed.where(P.label_problem().isNull())
    split = P.split_then_augment(usable, variants, fraction, seed, reference_compat=reference_compat)
    return split.withColumn("messages", P.sft_messages(prompt))


def model_context(hunks: DataFrame, keys: list[str], position: str, summary: str | None = None) -> DataFrame:
    """What a model is shown of each change set: rendered hunks up to the character budget, one row each.

    Rows flagged ``needs_summary`` wait for an answer to ``diffs.summary_requests``; a notice about omitted hunks
    follows the row flagged ``closes``.
    """
    return D.budget_cut(D.render_context(hunks, summary), keys, position)


def check_plan(claims: DataFrame, hunks: DataFrame, skipped: DataFrame) -> DataFrame:
    """All problems of submitted plans as (plan, hunk, problem)."""
    on = ["plan", "hunk"]

    def named(df, problem):
        return df.select(*on, F.lit(problem).alias("problem"))

    return (
        named(C.unknown_hunks(claims, hunks), "unknown").unionByName(named(C.double_assigned(claims), "double"))
        .unionByName(named(C.invalid_skips(skipped, hunks), "invalid_skip"))
        .unionByName(named(C.unassigned_hunks(hunks, claims, skipped), "unassigned"))
    )


def score_predictions(examples: DataFrame, responses: DataFrame, key: str = "example_key") -> tuple[DataFrame, ...]:
    """(result rows, totals, breakdown by language) of raw responses against labelled examples."""
    answered = responses.select(key, L.response_content("response").alias("content"))
    results = E.result_rows(examples, E.prediction_status(answered), key)
    return results, E.report_totals(results), E.report_by_language(results)


def compact_store(spark, path: str, answers: DataFrame, target: int, pinned: str = "", **limits) -> DataFrame:
    """Summarise stored conversations until they fit, store the summaries as messages, and return the new rows.

    ``answers`` (conv_id, msg_id, short, shorter) holds the model's summaries.  What is summarised already keeps its
    summary, so a repeated run with the same answers stores nothing new.
    """
    log = T.read_messages(spark, path)
    view = M.current_view(log)
    chosen = M.compaction_candidates(view, target, **limits).select("conv_id", "msg_ix")
    asked = chosen.join(view.select("conv_id", "msg_ix", "msg_id", "content"), ["conv_id", "msg_ix"]).join(answers, ["conv_id", "msg_id"])
    accepted = asked.withColumn("content", M.accept_summary("msg_id", "content", "short", "shorter", F.lit(pinned))["content"])
    # The rows are read from the store that they are appended to, so they are cut off from it first.
    fresh = durable(M.summary_messages(log, accepted))
    T.append_messages(fresh, path)
    return fresh
