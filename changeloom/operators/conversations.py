"""Stored conversations: ids, sizes, compaction, and reading model responses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import constants as K
from changeloom.functions.jsontext import let
from changeloom.functions.scale import max_so_far, numbered, position_block, sum_before
from changeloom.functions.text import as_col, blank_to_null, escape_non_ascii, strip
from changeloom.session import durable

SUMMARY_MARK = "[Summarized"

# -- the message log ---------------------------------------------------------------------------------------------


def append_ids(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Adds ``msg_ix`` (0-based position) and ``msg_id`` ('m0', 'm1', ...) in append order."""
    placed = numbered(messages, [conv], position_block(turn), [F.col(turn)], "_no")
    return placed.withColumn("msg_ix", F.col("_no") - 1).withColumn(
        "msg_id", F.concat(F.lit("m"), F.col("msg_ix").cast("string"))).drop("_no")


def lookup(wanted: DataFrame, store: DataFrame, on: Sequence[str] = ("conv_id", "msg_id")) -> DataFrame:
    """Stored message of each wanted id; NULL columns for unknown ids."""
    return wanted.join(store, list(on), "left")


def root_originals(store: DataFrame, keys: Sequence[str] = (), msg: str = "msg_id", parent: str = "parent_id",
                   max_rounds: int = 64) -> DataFrame:
    """(keys, msg_id, root_id): follow parents to the original.  A chain that leaves the store has a NULL root.

    Pointer doubling: a chain of n links takes log2(n) rounds.
    """
    keys = list(keys)
    ids = store.select(*keys, F.col(msg).alias("_id"), F.lit(True).alias("_stored"))
    # NULL stands for a missing parent; roots point to themselves.
    linked = store.select(*keys, F.col(msg).alias("msg_id"), F.coalesce(parent, msg).alias("_up")).join(
        ids.withColumnRenamed("_id", "_up"), [*keys, "_up"], "left")
    root = F.when(F.col("_stored"), F.col("_up"))
    hops = durable(linked.select(*keys, "msg_id", root.alias("root_id"), (root.isNull() | (root == F.col("msg_id"))).alias("_done")))
    # Rows at their root leave the loop, so that no key gathers a whole tree again and again.
    finished, open_ = hops.where("_done"), hops.where("NOT _done")
    for _ in range(max_rounds):
        if open_.isEmpty():
            return finished.drop("_done")
        further = finished.unionByName(open_).select(
            *keys, F.col("msg_id").alias("root_id"), F.col("root_id").alias("_next"), F.col("_done").alias("_final"))
        stepped = durable(open_.select(*keys, "msg_id", "root_id").join(further, [*keys, "root_id"]).select(
            *keys, "msg_id", F.col("_next").alias("root_id"), F.col("_final").alias("_done")))
        finished, open_ = finished.unionByName(stepped.where("_done")), stepped.where("NOT _done")
    raise RuntimeError("parent links form a cycle")


def last_messages(messages: DataFrame, conv: str = "conv_id", position: str = "msg_ix", n: int = 20,
                  role: str | None = None) -> DataFrame:
    """The newest ``n`` messages per conversation, optionally of one role."""
    chosen = messages if role is None else messages.where(F.col("role") == role)
    window = Window.partitionBy(conv).orderBy(F.desc(position))
    return chosen.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def count_messages(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    return messages.groupBy(conv).agg(F.count(F.lit(1)).alias("n_messages"))


def tool_results(store: DataFrame) -> DataFrame:
    """Originals of the tool role, id to content."""
    return store.where((F.col("kind") == "original") & (F.col("role") == "tool")).select("conv_id", "msg_id", "content")


# -- sizes -------------------------------------------------------------------------------------------------------


def estimate_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded down; 0 for an empty or missing text."""
    return F.floor(F.coalesce(F.length(as_col(text)), F.lit(0)) / 4).cast("bigint")


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Plug in a tokenizer: runs on Arrow batches; empty and missing texts count 0."""

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: count(text) if text else 0).astype("int64")

    return lambda text: counted(F.coalesce(as_col(text), F.lit("")))


def conversation_size(messages: DataFrame, conv: str = "conv_id", content: str = "content",
                      tokens: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    return messages.groupBy(conv).agg(
        F.sum(F.coalesce(F.length(content), F.lit(0))).cast("bigint").alias("n_chars"),
        F.sum(tokens(F.col(content))).cast("bigint").alias("n_tokens"))


# -- compaction --------------------------------------------------------------------------------------------------


def compaction_candidates(messages: DataFrame, target: int, conv: str = "conv_id", position: str = "msg_ix",
                          summary_tokens: int = K.SUMMARY_TOKENS, recent_tokens: int = K.RECENT_TOOL_TOKENS,
                          tokens: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    """Messages to summarise, oldest first, until the conversation would fit into ``target`` tokens.

    Every candidate saves something, so "stop once it fits" is a filter on the exclusive running saving.
    """
    sized = messages.select(conv, position, "role", F.coalesce("content", F.lit("")).startswith(SUMMARY_MARK).alias("_done"),
                            tokens(F.col("content")).alias("n_tokens"))
    totals = sized.groupBy(conv).agg(F.sum("n_tokens").alias("_total"),
                                     F.max(F.when(F.col("role") == "tool", F.col(position))).alias("_last_tool"))
    over = totals.where(F.col("_total") > target)
    is_recent = (F.col(position) == F.col("_last_tool")) & (F.col("n_tokens") <= recent_tokens)
    eligible = ~F.col("_done") & (F.col("n_tokens") > summary_tokens) & (
        ((F.col("role") == "tool") & ~is_recent) | ((F.col("role") == "user") & (F.col(position) == 1)))
    open_rows = sized.join(over, conv).where(eligible)
    placed = sum_before(open_rows, [conv], position_block(position), [F.col(position)],
                        F.col("n_tokens") - summary_tokens, "saved_before")
    return placed.where(F.col("_total") - F.col("saved_before") > target).select(
        conv, position, "role", "n_tokens", "saved_before")


def threshold_state(sizes: DataFrame, soft: Column, hard: Column, legacy: Column, tokens: str = "n_tokens") -> DataFrame:
    """'hard', 'soft' or 'ok'; unset thresholds fall back to the legacy one."""
    return sizes.withColumn("state", F.when(F.col(tokens) > F.coalesce(hard, legacy), "hard").when(
        F.col(tokens) > F.coalesce(soft, legacy), "soft").otherwise("ok"))


def pinned_split(content: Column | str, marker: str | None) -> Column:
    """struct<pinned, rest>: text before the marker is kept as it is."""
    content = as_col(content)
    at = F.locate(marker, content) if marker else F.lit(0)
    return F.struct(F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise("").alias("pinned"),
                    F.when(at > 0, F.substring(content, at, F.length(content))).otherwise(content).alias("rest"))


def accept_summary(msg_id, rest, short, shorter, pinned=None,
                   tokens: Callable[[Column], Column] = estimate_tokens) -> Column:
    """struct<level, content>: the first summary that is smaller than the text, else the cut text."""
    rest, short, shorter = as_col(rest), strip(short), strip(shorter)
    header = F.concat(F.lit(f"{SUMMARY_MARK} — id: '"), as_col(msg_id),
                      F.lit("'. Use query_message to ask specific questions about the full output.]\n"))
    level = F.when(tokens(short) < tokens(rest), 1).when(tokens(shorter) < tokens(rest), 2).otherwise(3)
    cut = F.concat(F.substring(rest, 1, K.TRUNCATED_SUMMARY_CHARS),
                   F.lit("\n[Truncated — use query_message for full content]"))
    front = F.coalesce(as_col(pinned), F.lit("")) if pinned is not None else F.lit("")
    body = F.when(level == 1, short).when(level == 2, shorter).otherwise(cut)
    return F.struct(level.alias("level"), F.concat(front, header, body).alias("content"))


def summary_messages(log: DataFrame, accepted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Log rows of accepted summaries: role 'meta', kind 'summary', the summarised message as parent, ids that go on after the
    conversation's last.  A message that has a summary in the log already gets none, so a step may be run again.

    ``log`` holds stored messages with ``msg_ix``; ``accepted`` (conv, msg_id, msg_ix, content), a message once.
    """
    has_one = log.where("kind = 'summary'").select(conv, F.col("parent_id").alias("msg_id"))
    fresh = accepted.join(has_one, [conv, "msg_id"], "left_anti").select(conv, "msg_id", "msg_ix", "content")
    length = log.groupBy(conv).agg((F.max("msg_ix") + 1).alias("_next"))
    placed = numbered(fresh, [conv], position_block("msg_ix"), [F.col("msg_ix")], "_no").join(length, conv)
    at = (F.col("_next") + F.col("_no") - 1).cast("bigint")
    return placed.select(conv, F.concat(F.lit("m"), at.cast("string")).alias("msg_id"), F.lit("meta").alias("role"), "content",
                         F.lit(0).cast("bigint").alias("turn"), F.col("msg_id").alias("parent_id"), F.lit("summary").alias("kind"),
                         at.alias("msg_ix"))


def current_view(log: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Original messages, each with the text of its summary where the log has one."""
    newest = log.where("kind = 'summary'").groupBy(conv, F.col("parent_id").alias("msg_id")).agg(
        F.max_by("content", "msg_ix").alias("content"))
    return apply_replacements(log.where("kind = 'original'"), newest, (conv, "msg_id")).drop("applied")


def apply_replacements(messages: DataFrame, swaps: DataFrame, on: Sequence[str] = ("conv_id", "msg_ix")) -> DataFrame:
    """Swap in summaries; messages that are summaries already keep their text.  Adds ``applied``."""
    joined = messages.join(swaps.select(*on, F.col("content").alias("_new")), list(on), "left")
    swapped = F.col("_new").isNotNull() & ~F.coalesce("content", F.lit("")).startswith(SUMMARY_MARK)
    return joined.withColumn("applied", swapped).withColumn(
        "content", F.when(swapped, F.col("_new")).otherwise(F.col("content"))).drop("_new")


# -- responses ---------------------------------------------------------------------------------------------------

# Response fields that may carry reasoning, first non-blank wins.
REASONING_FIELDS = ("thinking", "reasoning", "reasoning_content")
# Where the two response dialects keep message and token counts.
DIALECTS = {
    "native": ("$.message", "$.prompt_eval_count", "$.eval_count"),
    "chat": ("$.choices[0].message", "$.usage.prompt_tokens", "$.usage.completion_tokens"),
}


def response_message(response: Column | str, dialect: str) -> Column:
    """The assistant message as JSON, '{}' if the response has none."""
    return F.coalesce(F.get_json_object(response, DIALECTS[dialect][0]), F.lit("{}"))


def response_usage(response: Column | str, dialect: str) -> Column:
    _, prompt, completion = DIALECTS[dialect]

    def count(path):
        return F.coalesce(F.get_json_object(response, path).cast("bigint"), F.lit(0))

    return F.struct(count(prompt).alias("prompt_tokens"), count(completion).alias("completion_tokens"))


def total_usage(usages: DataFrame, keys: Sequence[str], usage: str = "usage") -> DataFrame:
    prompt, completion = F.sum(f"{usage}.prompt_tokens"), F.sum(f"{usage}.completion_tokens")
    return usages.groupBy(*keys).agg(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
                                     (prompt + completion).alias("total_tokens"))


def reasoning_of(message: Column | str, fields: Sequence[str] = REASONING_FIELDS) -> Column:
    """First non-blank reasoning text, trimmed.  Values that are no strings are passed over."""

    def pick(parsed):
        texts = []
        for field in fields:
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            texts.append(F.when(F.schema_of_variant(value) == "STRING", blank_to_null(value.cast("string"))))
        return F.coalesce(*texts)

    return let(F.try_parse_json(as_col(message)), pick)


def tool_call_of(message: Column | str) -> Column:
    """struct<name, arguments, call_id> of the first tool call, arguments as JSON text; NULL without a call.

    A JSON path gives the same text for arguments sent as an object and as a quoted string.
    """

    def part(path):
        return F.get_json_object(as_col(message), f"$.tool_calls[0].{path}")

    return F.when(part("function.name").isNotNull(), F.struct(
        part("function.name").alias("name"), part("function.arguments").alias("arguments"),
        part("id").alias("call_id")))


def tool_result_message(content: Column | str, call_id: Column | str, dialect: str) -> Column:
    """Message, as JSON, that answers a tool call.  The chat dialect names the call, if it had an id."""
    named = [as_col(call_id).alias("tool_call_id")] if dialect == "chat" else []
    return F.to_json(F.struct(F.lit("tool").alias("role"), *named, as_col(content).alias("content")))


def text_of(message: Column | str) -> Column:
    return blank_to_null(F.coalesce(F.get_json_object(as_col(message), "$.content"), F.lit("")))


def tool_args_of(message: Column | str) -> Column:
    """Arguments of the tool call, else the content read as (possibly fenced) JSON; NULL if it is none."""
    bare = F.regexp_replace(text_of(message), "\\A(?:```json)?", "")
    bare = F.regexp_replace(bare, "\\A```", "")
    bare = strip(F.regexp_replace(strip(bare), "```\\z", ""))
    from_text = let(bare, lambda text: F.when(F.try_parse_json(text).isNotNull(), text))
    return F.coalesce(tool_call_of(message)["arguments"], from_text)


def brief_args(arguments: Column | str, limit: int = 80, ascii_only: bool = False) -> Column:
    """Compact JSON of the arguments, cut to ``limit`` characters; optionally with other characters than ASCII escaped."""
    text = F.get_json_object(as_col(arguments), "$")
    return let(escape_non_ascii(text) if ascii_only else text, lambda text: F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text))


def no_call_streaks(turns: DataFrame, keys: Sequence[str], position: str, has_call: str = "has_call",
                    escalate_at: int = 3) -> DataFrame:
    """Adds ``streak`` (turns without a tool call up to and including this one) and ``escalates``, true where the next
    turn is restricted because the streak has become long enough.

    The streak is the distance to the newest call, from two blocked passes, so one long history is no hot spot.
    """
    keys = list(keys)
    block = position_block(position)
    placed = numbered(turns, keys, block, [F.col(position)], "_no")
    marked = max_so_far(placed, keys, block, [F.col(position)], F.when(F.col(has_call), F.col("_no")), "_call")
    streak = (F.col("_no") - F.coalesce("_call", F.lit(0))).cast("bigint")
    return marked.withColumn("streak", streak).withColumn("escalates", streak >= escalate_at).drop("_no", "_call")
