"""Incremental labelling through request and response tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import constants as K
from changeloom.functions.jsontext import commit_list_error, extract_json_object
from changeloom.functions.scale import first_row, hash_block, position_block, sum_before
from changeloom.functions.text import (as_col, bernoulli, hash_int, is_blank, seeded_hash, split_lines,
                                       truncate)

# -- pending work ------------------------------------------------------------------------------------------------


def example_key(repo_url="repo_url", base="base_commit", head="head_commit") -> Column:
    return F.concat(as_col(repo_url), F.lit("@"), as_col(base), F.lit(".."), as_col(head))


def pending_keys(examples: DataFrame, labelled: DataFrame, limit: int | None = None, key: str = "example_key",
                 position: str = "input_pos", seed: int = 42) -> DataFrame:
    """Keys still to label, each once, without those that already carry a label.

    Works on keys only.  The limit takes the first keys by input position, or by hash without one; the count is cut
    per hash block, so that no task sorts them all.
    """
    positioned = position in examples.columns
    order = F.min(position).cast("bigint") if positioned else F.lit(0).cast("bigint")
    wanted = examples.groupBy(key).agg(order.alias("first_pos"))
    done = labelled.where(F.col("label").isNotNull()).select(key)
    pending = wanted.join(done, key, "left_anti")
    if limit is None:
        return pending
    drawn = pending.withColumn("_draw", seeded_hash(seed, key))
    block = position_block("first_pos") if positioned else hash_block("_draw")
    placed = sum_before(drawn, [], block, [F.col("first_pos"), F.col("_draw")], F.lit(1), "_place")
    return placed.where(F.col("_place") < limit).drop("_draw", "_place")


def pending_examples(examples: DataFrame, labelled: DataFrame, limit: int | None = None, key: str = "example_key",
                     position: str = "input_pos") -> DataFrame:
    keys = pending_keys(examples, labelled, limit, key, position)
    if position not in examples.columns:
        return examples.dropDuplicates([key]).join(keys.select(key), key, "left_semi")
    return examples.join(keys.withColumnRenamed("first_pos", position), [key, position], "left_semi")


# -- noise -------------------------------------------------------------------------------------------------------


def junk_diff(path: Column, kind: Column, body: Column) -> Column:
    """Diff that adds one noise file."""
    lines = split_lines(F.coalesce(body, F.lit("")))
    lines = F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines)
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path,
                    F.lit("\nnew file mode 100644\nindex 0000000..deadbeef\n"))
    binary = F.concat(F.lit("Binary files /dev/null and b/"), path, F.lit(" differ\n"))
    text = F.concat(F.lit("--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"),
                    F.lit(" @@\n+"), F.array_join(lines, "\n+"), F.lit("\n"))
    return F.concat(head, F.when(kind == "binary", binary).otherwise(text))


def template_array(templates: list[tuple]) -> Column:
    """Noise templates as one constant array; the rule is NULL where a table has none."""
    rows = [
        F.struct(F.lit(t[0]).alias("path"), F.lit(t[1]).alias("kind"), F.lit(t[2]).cast("string").alias("body"),
                 F.lit(t[3] if len(t) > 3 else None).cast("string").alias("rule"))
        for t in templates
    ]
    return F.array(*rows)


def draw_templates(files: Column, templates: list[tuple], seed: int, *key: Column | str) -> Column:
    """One to three draws with replacement; repeated and already present paths are dropped, draw order is kept."""
    count = 1 + F.pmod(hash_int(seeded_hash(seed, *key, F.lit("count"))), F.lit(3))
    picks = [
        F.pmod(hash_int(seeded_hash(seed, *key, F.lit(f"draw{j}"))), F.lit(len(templates))).cast("int") for j in (1, 2, 3)
    ]
    drawn = F.array_distinct(F.slice(F.array(*picks), F.lit(1), count.cast("int")))
    table = template_array(templates)
    chosen = F.transform(drawn, lambda i: F.element_at(table, i + 1))
    return F.filter(chosen, lambda c: ~F.array_contains(files, c["path"]))


def append_noise(df: DataFrame, picks: str) -> DataFrame:
    """Append the picked noise files to ``changed_files`` and ``diff``; flag the row only if any was added."""
    added = F.size(picks) > 0
    text = F.array_join(F.transform(picks, lambda c: junk_diff(c["path"], c["kind"], c["body"])), "\n")
    return (
        df.withColumn("injected_files", F.col(picks)["path"])
        .withColumn("noise_injected", added)
        .withColumn("changed_files", F.concat("changed_files", "injected_files"))
        .withColumn("diff", F.when(added, F.concat(F.col("diff"), F.lit("\n"), text)).otherwise(F.col("diff")))
    )


def draws_noise(key: Column | str = "example_key", probability: float = K.NOISE_PROBABILITY, seed: int = 42) -> Column:
    """Seeded by the example, so that a resumed run decides as the first one did."""
    return bernoulli(seeded_hash(seed, key, F.lit("noise")), probability)


def inject_noise(examples: DataFrame, probability: float = K.NOISE_PROBABILITY, seed: int = 42,
                 key: str = "example_key") -> DataFrame:
    picks = F.when(draws_noise(key, probability, seed),
                   draw_templates(F.col("changed_files"), K.LABEL_NOISE, seed, key))
    empty = F.filter(template_array(K.LABEL_NOISE[:1]), lambda c: F.lit(False))
    return append_noise(examples.withColumn("_picks", F.coalesce(picks, empty)), "_picks").drop("_picks")


# -- requests ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PromptSet:
    """Texts of one prompt.  Bring the wording your model was tuned on; the default is a short one."""

    system: str = (
        "Group the changed files below into logical commits. Commit whole files only, keep tests and lock files with "
        "the code they belong to, and leave junk files out: propose ignore patterns for them instead. Subjects follow "
        "type(scope): description. Report suspicious code as issues.\n"
        "\nAnswer with one JSON object {\"commits\": [{\"subject\", \"files\", \"body\", \"issues\"}], "
        "\"gitignore\": []} and nothing else.\n"
    )
    sample: dict = field(default_factory=lambda: {
        "commits": [{"subject": "docs(readme): explain setup", "files": ["README.md"], "body": "", "issues": []}],
        "gitignore": ["*.pyc"],
    })
    max_diff_chars: int | None = None
    marker: str = ""

    @property
    def sample_text(self) -> str:
        return json.dumps(self.sample, indent=2)


LABEL_PROMPT = PromptSet()
SFT_PROMPT = PromptSet(max_diff_chars=K.MAX_PROMPT_DIFF_CHARS,
                       marker=f"\n\n... (diff truncated at {K.MAX_PROMPT_DIFF_CHARS} chars)")
EVAL_PROMPT = PromptSet(max_diff_chars=K.MAX_PROMPT_DIFF_CHARS, marker="\n... (truncated)")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_text(prompt: PromptSet, files: Column | str = "changed_files", diff: Column | str = "diff") -> Column:
    listing = F.array_join(F.transform(as_col(files), lambda f: F.concat(F.lit("  - "), f)), "\n")
    shown = as_col(diff) if prompt.max_diff_chars is None else truncate(diff, prompt.max_diff_chars, prompt.marker)
    return F.concat(F.lit(f"Sample Output:\n{prompt.sample_text}\n\nChanged files:\n"), listing,
                    F.lit("\n\nDiffs:\n"), shown)


def build_messages(prompt: PromptSet = LABEL_PROMPT, files="changed_files", diff="diff") -> Column:
    return F.array(message("system", F.lit(prompt.system)), message("user", user_text(prompt, files, diff)))


def request_body(messages: Column | str, model: str, max_tokens: int = 4096, effort: str | None = None) -> Column:
    """Request JSON; an unset effort is left out."""
    return F.to_json(F.struct(
        F.lit(model).alias("model"), as_col(messages).alias("messages"), F.lit(0.2).alias("temperature"),
        F.lit(max_tokens).alias("max_completion_tokens"), F.lit(effort).cast("string").alias("reasoning_effort")))


# -- responses ---------------------------------------------------------------------------------------------------


def response_content(response: Column | str) -> Column:
    """Message content, or the reasoning text where the content is blank."""
    content = F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit(""))
    reasoning = F.get_json_object(response, "$.choices[0].message.reasoning_content")
    return F.when(is_blank(content) & (F.coalesce(reasoning, F.lit("")) != ""), reasoning).otherwise(content)


def parse_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``content``, ``raw_json`` and ``error`` (NULL for a usable label)."""
    found = extract_json_object(responses.withColumn("content", response_content(response)), "content")
    return found.withColumn("error", F.coalesce("json_error", commit_list_error("raw_json"))).drop("json_error")


RETRY_TEXT = (
    "The last answer was not usable JSON: {error}\n"
    "Answer with one JSON object that matches the schema, without explanation or markdown."
)


def retry_requests(attempts: DataFrame, max_attempts: int = K.MAX_ATTEMPTS, key: str = "example_key",
                   text: str = RETRY_TEXT) -> DataFrame:
    """Next request of every example whose latest attempt failed: the original messages and one error turn.

    ``text`` words that turn; its ``{error}`` becomes the reason and the first 300 characters of the answer.
    """
    latest = first_row(attempts, [key], [F.desc("attempt")])
    detail = F.concat(F.col("error"), F.lit(" | content: "), F.substring("content", 1, 300))
    before, after = text.split("{error}")
    turn = message("user", F.concat(F.lit(before), detail, F.lit(after)))
    return latest.where(F.col("error").isNotNull() & (F.col("attempt") < max_attempts)).select(
        key, (F.col("attempt") + 1).alias("attempt"), F.concat("messages", F.array(turn)).alias("messages"))


def usage_of(response: Column | str) -> Column:
    def count(name):
        return F.coalesce(F.get_json_object(response, f"$.usage.{name}").cast("bigint"), F.lit(0)).alias(name)

    return F.struct(count("prompt_tokens"), count("completion_tokens"), count("total_tokens"))


def attach_labels(examples: DataFrame, parsed: DataFrame, model: str, key: str = "example_key") -> DataFrame:
    """Examples with a usable response get ``label`` and its JSON ``label_json``; failed ones give no row."""
    from changeloom.schemas import LABEL_COMMIT

    body = F.from_json("raw_json", f"commits array<{LABEL_COMMIT}>, gitignore array<string>")
    label = parsed.where(F.col("error").isNull()).select(key, F.col("raw_json"), body.alias("_body"),
                                                         usage_of("response").alias("_usage"))
    rules = F.coalesce("_body.gitignore", F.array().cast("array<string>"))
    return examples.join(label, key).withColumn("label", F.struct(
        F.col("_body.commits").alias("commits"), rules.alias("gitignore"), F.lit(model).alias("model"),
        F.col("_usage").alias("usage"))).withColumnRenamed("raw_json", "label_json").drop("_body", "_usage")


# -- counters ----------------------------------------------------------------------------------------------------


def progress(attempts: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """Done, failed, percentage of all pending work, and tokens of successful requests.

    ``attempts`` holds ``ok`` and ``tokens``.
    """
    done = F.count_if("ok")
    failed = F.count_if(~F.col("ok"))
    tokens = F.coalesce(F.sum(F.when(F.col("ok"), F.col("tokens"))), F.lit(0)).cast("bigint")
    total = pending.agg(F.count(F.lit(1))).scalar()
    counted = attempts.groupBy(*keys).agg(done.alias("ok"), failed.alias("failed"), tokens.alias("total_tokens"))
    return counted.withColumn("pct", (F.col("ok") + F.col("failed")) / total * 100)


def dry_run_counts(examples: DataFrame, labelled: DataFrame, key: str = "example_key") -> DataFrame:
    """Rows in the input, distinct labelled keys, and input rows still to label."""
    done = labelled.where(F.col("label").isNotNull()).select(key).distinct().withColumn("_done", F.lit(True))
    joined = examples.select(key, F.lit(True).alias("_in")).join(done, key, "full")
    return joined.agg(
        F.count("_in").alias("total"), F.count_distinct(F.when(F.col("_done"), F.col(key))).alias("labelled"),
        F.count_if(F.col("_in") & F.col("_done").isNull()).alias("to_label"))
