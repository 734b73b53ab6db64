"""Diffs and hunks.

A diff is one row.  Splitting and measuring it are column expressions on that row, so diff text never shuffles; only
operators that follow several rows of a change set (budgets, patches, summaries) exchange data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import constants as K
from changeloom.functions.jsontext import let
from changeloom.functions.scale import first_row, position_block, preceding_values, scanned, sum_before
from changeloom.functions.text import (as_col, base_name, count_of, split_before, split_lines, split_lines_keep_ends,
                                       strip, truncate, unusual_breaks)

_BREAKS = "\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029"
_LINE_START = f"(?:^|(?<=[{_BREAKS}]))"
_AT_HEADER = f"(?<=[{_BREAKS}])(?=diff --git|index |--- |\\+\\+\\+ )"
_AT_HUNK = f"(?<=[{_BREAKS}])(?=@@)"
_AT_FILE = f"(?<=[{_BREAKS}])(?=diff --git)"
# Prefixes of header lines and of hunk lines.
_MARKS = ["@@", "diff --git", "index ", "--- ", "+++ "]
_RANGE = "^@@ -\\d+(?:,(\\d+))? \\+\\d+(?:,(\\d+))? @@"

# -- splitting ---------------------------------------------------------------------------------------------------


def _with_headers(cuts: Column) -> Column:
    """Hunk texts from cuts of a diff, struct<body, rest, restarts>, one per ``@@`` line and one for what comes before the first.

    ``rest`` is what follows a hunk up to the next one, header lines; where it ``restarts``, headers before it are forgotten.
    Headers change at the cuts with a rest only: those positions are found first, then the bodies between two of them are
    sliced out and get their header in front.  No array is copied for each hunk.
    """

    def up_to_next(array, i, field, last):
        return F.coalesce(field(F.get(array, i + 1)), last)

    def from_headers(marks):
        restarts = F.filter(F.transform(marks, lambda m, i: F.when((i == 0) | m["restarts"], i)), lambda i: i.isNotNull())
        runs = let(restarts, lambda at: F.transform(at, lambda r, i: F.slice(
            marks, r + 1, up_to_next(at, i, lambda x: x, F.size(marks)) - r)))
        heads = F.flatten(F.transform(runs, lambda run: F.transform(run, lambda m, i: F.struct(
            m["at"].alias("at"), F.array_join(F.slice(run["rest"], F.lit(1), i + 1), "").alias("header")))))
        return let(heads, lambda heads: F.flatten(F.transform(heads, lambda h, i: F.transform(
            F.slice(cuts, h["at"] + 2, up_to_next(heads, i, lambda x: x["at"], F.size(cuts) - 1) - h["at"]),
            lambda cut: F.concat(h["header"], cut["body"])))))

    marked = F.transform(cuts, lambda cut, i: F.when((i == 0) | (cut["rest"] != ""), F.struct(
        i.alias("at"), cut["rest"].alias("rest"), cut["restarts"].alias("restarts"))))
    return let(F.filter(marked, lambda m: m.isNotNull()), from_headers)


def split_hunks_compat(diff: Column | str) -> Column:
    """Hunks of a single-file diff by line prefixes alone; each is preceded by all header lines seen so far."""
    diff = as_col(diff)

    def cut(piece, i):
        # Header lines after a hunk, and what follows them, belong to the header.
        parts = split_before(piece, _MARKS[1:], _AT_HEADER)
        return let(parts, lambda parts: F.struct(
            F.when(piece.startswith("@@"), parts[0]).otherwise("").alias("body"),
            F.when(piece.startswith("@@"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "")).otherwise(piece).alias("rest"),
            F.lit(False).alias("restarts")))

    return _hunks_or_all(diff, cut)


def _hunks_or_all(diff: Column, cut) -> Column:
    """Hunks of the diff, or the whole diff where it has none."""
    none = F.struct(F.lit("").alias("body"), F.lit("").alias("rest"), F.lit(False).alias("restarts"))
    pieces = split_before(diff, ["@@"], _AT_HUNK)
    cuts = let(pieces, lambda p: F.concat(F.when(p[0].startswith("@@"), F.array(none)).otherwise(F.array()), F.transform(p, cut)))
    return let(let(cuts, _with_headers), lambda hunks: F.when(F.size(hunks) > 0, hunks).otherwise(F.array(diff)))


def _file_header(text: Column) -> Column:
    """struct<rest, restarts>: header lines from the last ``diff --git`` on, if there is one."""
    last = F.element_at(split_before(text, ["diff --git"], _AT_FILE), -1)
    return let(last, lambda last: F.struct(F.when(last.startswith("diff --git"), last).otherwise(text).alias("rest"),
                                           last.startswith("diff --git").alias("restarts")))


def _body_lines(lines: Column, old: Column, new: Column) -> Column:
    """How many lines after the ``@@`` line belong to the hunk, by its line counts."""
    start = F.struct(old.alias("old"), new.alias("new"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

    def step(state, line):
        mark = F.substring(line, 1, 1)
        left = (state["old"] > 0) | (state["new"] > 0)
        # A note about a missing final line break belongs to the line before it.
        takes = state["open"] & ((left & mark.isin(" ", "-", "+", "\n", "\r")) | (mark == "\\"))
        old_used = takes & mark.isin(" ", "-", "\n", "\r")
        new_used = takes & mark.isin(" ", "+", "\n", "\r")
        return F.struct(
            (state["old"] - old_used.cast("int")).alias("old"), (state["new"] - new_used.cast("int")).alias("new"),
            (state["taken"] + takes.cast("int")).alias("taken"), takes.alias("open"))

    return F.aggregate(lines, start, step, lambda state: state["taken"])


def split_hunks(diff: Column | str) -> Column:
    """Hunks of a diff over any number of files, each with the header of its own file.

    Hunk bodies follow the line counts of their ``@@`` line, so removed or added lines that look like a header stay in
    the body.
    """
    diff = as_col(diff)

    def count(line, group):
        text = F.regexp_extract(line, _RANGE, group)
        return F.when(text == "", 1).otherwise(text.cast("int"))

    def parts(lines):
        counted = _body_lines(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), count(lines[0], 1),
                              count(lines[0], 2)) + 1
        keep = F.when(lines[0].rlike(_RANGE), counted).otherwise(F.size(lines))
        return let(keep, lambda n: F.struct(
            F.array_join(F.slice(lines, F.lit(1), n), "").alias("body"),
            F.array_join(F.slice(lines, n + 1, F.size(lines)), "").alias("rest")))

    def cut(piece, i):
        whole = F.struct(F.lit("").alias("body"), piece.alias("rest"))
        found = F.when(piece.startswith("@@"), let(split_lines_keep_ends(piece), parts)).otherwise(whole)
        return let(found, lambda part: let(_file_header(part["rest"]), lambda header: F.struct(
            part["body"].alias("body"), header["rest"].alias("rest"), header["restarts"].alias("restarts"))))

    return _hunks_or_all(diff, cut)


def is_binary_diff(diff: Column | str) -> Column:
    diff = as_col(diff)
    # Two byte searches spare nearly all diffs the regular expression.
    hint = F.contains(diff, F.lit("Binary files")) | F.contains(diff, F.lit("GIT binary patch"))
    return hint & diff.rlike(
        f"{_LINE_START}(?:Binary files(?: [^{_BREAKS}]*)? differ(?=[{_BREAKS}]|\\z)|GIT binary patch)")


def collect_hunks(files: DataFrame, path: str = "path", diff: str = "diff", untracked: str = "is_untracked",
                  compat: bool = True) -> DataFrame:
    """Hunk rows ``path::i`` of per-file diffs.  Binary and untracked files give one hunk with an empty patch."""
    splitter = split_hunks_compat if compat else split_hunks
    nothing = F.array().cast("array<string>")
    whole = F.col(untracked) | is_binary_diff(F.coalesce(diff, F.lit("")))
    patches = (
        F.when(whole, F.array(F.lit("")))
        .when(strip(F.coalesce(diff, F.lit(""))) == "", nothing)
        .otherwise(splitter(diff))
    )
    rest = [c for c in files.columns if c not in (path, diff, untracked)]
    rows = files.select(
        *rest, F.col(path).alias("file_path"), F.col(untracked).alias("is_untracked"),
        (~F.col(untracked) & is_binary_diff(F.coalesce(diff, F.lit("")))).alias("is_binary"),
        F.posexplode(patches).alias("_i", "patch"))
    return rows.select(
        *rest, F.concat("file_path", F.lit("::"), (F.col("_i") + 1).cast("string")).alias("hunk_id"), "file_path",
        (F.col("_i") + 1).alias("hunk_no"), "patch", "is_untracked", "is_binary")


# -- measures ----------------------------------------------------------------------------------------------------


def old_range(patch: Column | str) -> Column:
    """struct<start, count> of the first well-formed ``@@`` line; NULL without one."""
    pattern = f"{_LINE_START}@@ -(\\d+)(?:,(\\d+))? \\+"
    start = F.regexp_extract(as_col(patch), pattern, 1)
    count = F.regexp_extract(as_col(patch), pattern, 2)
    return F.when(start != "", F.struct(
        start.cast("int").alias("start"), F.when(count == "", 1).otherwise(count.cast("int")).alias("count")))


def _lines_with(patch: Column, mark: str, pattern: str) -> Column:
    lines = F.concat(F.lit("\n"), patch)
    plain = count_of(lines, "\n" + mark) - count_of(lines, "\n" + mark * 3)
    return F.when(unusual_breaks(patch), F.regexp_count(patch, F.lit(pattern)).cast("bigint")).otherwise(plain)


def added_lines(patch: Column | str) -> Column:
    return _lines_with(as_col(patch), "+", f"{_LINE_START}\\+(?!\\+\\+)")


def removed_lines(patch: Column | str) -> Column:
    return _lines_with(as_col(patch), "-", f"{_LINE_START}-(?!--)")


def quick_added(patch: Column | str) -> Column:
    """Added lines by substring counting; the first line of the text is not seen."""
    return count_of(patch, "\n+") - count_of(patch, "\n+++")


def quick_removed(patch: Column | str) -> Column:
    return count_of(patch, "\n-") - count_of(patch, "\n---")


def is_generated(path: Column | str, globs: Sequence[str] = K.GENERATED_GLOBS) -> Column:
    """Machine-generated by name: one alternation over all globs."""
    pattern = "|".join(re.escape(g).replace("\\*", ".*") for g in globs)
    return base_name(path).rlike(f"(?s)^(?:{pattern})\\z")


def change_stats(hunks: DataFrame, keys: Sequence[str] = ("side", "file_path")) -> DataFrame:
    """Added and removed lines per side and file."""
    return hunks.groupBy(*keys).agg(F.sum(added_lines("patch")).cast("bigint").alias("added"),
                                    F.sum(removed_lines("patch")).cast("bigint").alias("removed"))


def change_metadata(hunks: DataFrame, keys: Sequence[str] = ("side", "file_path")) -> DataFrame:
    """Stats of changed files, then untracked files, which have none and their own side."""
    stats = change_stats(hunks.where("NOT is_untracked"), keys)
    fresh = hunks.where("is_untracked").withColumn("side", F.lit("Untracked")).select(*keys).distinct()
    return stats.unionByName(fresh, allowMissingColumns=True)


# -- context for a model -----------------------------------------------------------------------------------------


def hunk_line(hunk_id="hunk_id", patch="patch", untracked="is_untracked", binary="is_binary") -> Column:
    """One line of the hunk list."""
    size = F.concat(F.lit("(+"), quick_added(patch).cast("string"), F.lit("/-"), quick_removed(patch).cast("string"),
                    F.lit(")"))
    kind = F.when(as_col(untracked), "(new untracked file)").when(as_col(binary), "[binary file]").otherwise(size)
    return F.concat(F.lit("  "), as_col(hunk_id), F.lit("  "), kind)


def hunk_list(hunks: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The hunk list of a change set as rows: a title at position 0, then one line per hunk.

    Rows rather than one text, since a change set may hold any number of hunks.
    """
    lines = hunks.select(*keys, F.col(position).cast("bigint").alias("line_no"), hunk_line().alias("line"))
    title = hunks.select(*keys).distinct().select(
        *keys, F.lit(0).cast("bigint").alias("line_no"), F.lit("Available hunks:").alias("line"))
    return title.unionByName(lines)


def render_context(hunks: DataFrame, summary: str | None = None, limit: int = K.FILE_DIFF_CHARS) -> DataFrame:
    """Adds ``shown`` (text for the model), ``charged`` (characters it costs) and ``needs_summary``.

    A large hunk shows its summary; without one it is flagged and shows nothing.
    """
    size = F.length("patch")
    generated = F.concat(
        F.lit("[machine-generated lockfile — group with the dependency change that caused it] +"),
        quick_added("patch").cast("string"), F.lit("/-"), quick_removed("patch").cast("string"), F.lit(" lines"))
    given = F.col(summary) if summary else F.lit(None).cast("string")
    plain = ~F.col("is_untracked") & ~F.col("is_binary")
    body = (
        F.when(F.col("is_untracked"), "(new untracked file — no diff)").when(F.col("is_binary"), "[binary file]")
        .when(is_generated("file_path"), generated).when(size <= limit, F.col("patch")).otherwise(given)
    )
    charged = F.when(F.col("is_untracked"), K.UNTRACKED_CHARS).when(F.col("is_binary"), K.BINARY_CHARS).otherwise(
        F.coalesce(F.length("_body"), F.lit(0)))
    return (
        hunks.withColumn("_body", body)
        .withColumn("charged", charged.cast("bigint"))
        .withColumn("needs_summary", plain & F.col("_body").isNull())
        .withColumn("shown", F.concat(F.lit("--- "), F.col("hunk_id"), F.lit(" ---\n"), F.col("_body")))
        .drop("_body")
    )


def budget_cut(rows: DataFrame, keys: Sequence[str], position: str, size: str = "charged",
               cap: int = K.TOTAL_DIFF_CHARS) -> DataFrame:
    """Rows of each change set that start before the budget is spent; ``closes`` marks the one that spends it.

    A notice about omitted rows follows that row.  ``position`` is an integer.
    """
    placed = sum_before(rows, list(keys), position_block(position), [F.col(position)], F.col(size), "spent_before")
    return placed.where(F.col("spent_before") < cap).withColumn(
        "closes", F.col("spent_before") + F.col(size) >= cap)


# Fixed value: what follows the row that spends the budget.
OMITTED = "\n... (remaining hunks omitted — total size limit reached)"


def context_parts(rows: DataFrame, keys: Sequence[str], position: str, shown: str = "shown", size: str = "charged",
                  cap: int = K.TOTAL_DIFF_CHARS, notice: str = OMITTED) -> DataFrame:
    """(keys, position, part_no, part): what is shown of each change set, row by row, with the notice about omitted hunks
    after the row that spends the budget, also if that is the last one."""
    cut = budget_cut(rows, keys, position, size, cap)
    parts = F.array_compact(F.array(F.col(shown), F.when(F.col("closes"), F.lit(notice))))
    return cut.select(*keys, position, F.posexplode(parts).alias("part_no", "part"))


def file_view(diffs: DataFrame, keys: Sequence[str] = ("path",), staged: bool | None = None,
              limit: int = K.FILE_DIFF_CHARS) -> DataFrame:
    """Diff of a file: staged, unstaged, or both under titles; cut at ``limit`` characters.  ``side`` is given."""
    chosen = diffs if staged is None else diffs.where(F.col("side") == ("staged" if staged else "unstaged"))
    shown = F.when(strip("diff") != "", F.col("diff") if staged is not None else F.concat(
        F.lit("=== "), F.col("side"), F.lit(" ===\n"), F.col("diff")))
    sides = chosen.withColumn("_shown", shown).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "staged", F.col("_shown"))).alias("_staged"),
        F.max(F.when(F.col("side") == "unstaged", F.col("_shown"))).alias("_unstaged"))
    text = F.coalesce(F.nullif(F.concat_ws("\n", "_staged", "_unstaged"), F.lit("")),
                      F.concat(F.lit("No diff found for "), F.col(keys[-1])))
    return sides.select(*keys, truncate(text, limit, f"\n\n... (truncated at {limit} chars)").alias("view"))


def search_diff(diffs: DataFrame, pattern: str, context: int = 2, order: Sequence[str] = ("side_rank", "file_no"),
                limit: int = K.MAX_MATCHES) -> DataFrame:
    """First matching lines with context, in order of ``order`` and line number.

    A diff cannot give more than ``limit`` of the first ``limit`` matches, so each row is cut before the sort.
    """

    def matches(lines):
        found = F.transform(lines, lambda line, i: F.when(line.rlike(pattern), F.struct(
            (i + 1).alias("line_number"),
            F.array_join(F.slice(lines, F.greatest(i - context, F.lit(0)) + 1,
                                 i + context + 1 - F.greatest(i - context, F.lit(0))), "\n").alias("match_context"))))
        return F.slice(F.array_compact(found), 1, limit)

    rest = [c for c in diffs.columns if c != "diff"]
    return diffs.select(*rest, F.inline(let(split_lines("diff"), matches))).orderBy(*order, "line_number").limit(limit)


def _ended(text: Column) -> Column:
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def combined_patches(hunks: DataFrame, keys: Sequence[str], position: str = "hunk_no") -> DataFrame:
    """One patch per key (commit and file): hunks by old start, the header once, bodies from ``@@`` on."""
    start = F.coalesce(old_range("patch")["start"], F.lit(0))
    sorted_patches = F.sort_array(F.collect_list(F.struct(start.alias("s"), F.col(position).alias("p"), "patch")))

    def body(item):
        return _ended(F.regexp_extract(item["patch"], f"(?s){_LINE_START}@@.*", 0))

    grouped = hunks.groupBy(*keys).agg(sorted_patches.alias("_h"))
    first = F.col("_h")[0]["patch"]
    rest = F.array_join(F.transform(F.slice("_h", 2, 2**30), body), "")
    return grouped.select(*keys, F.size("_h").alias("n_hunks"), F.when(F.size("_h") == 1, first).otherwise(
        F.concat(_ended(first), rest)).alias("patch"))


def patch_pieces(hunks: DataFrame, keys: Sequence[str], position: str = "hunk_no", block_lines: int = 65536) -> DataFrame:
    """The pieces of ``combined_patches`` as rows (keys, piece_no, n_hunks, piece), one per hunk: read in order, they are the patch.

    Hunks are numbered by old start within blocks of lines, so no task holds a key's texts together and a patch may be of
    any size.  Hunks of the same start go by ``position``.
    """
    start = F.coalesce(old_range("patch")["start"], F.lit(0))
    one = F.lit(1).cast("bigint")
    keys = list(keys)
    placed = scanned(hunks.select(*keys, F.col(position).alias("_pos"), "patch", start.alias("_start")), keys,
                     position_block("_start", block_lines), [F.col("_start"), F.col("_pos")], {"piece_no": (one, "sum", 0)},
                     {"n_hunks": (one, "sum")})
    piece = F.when(F.col("n_hunks") == 1, F.col("patch")).when(F.col("piece_no") == 1, _ended(F.col("patch"))).otherwise(
        _ended(F.regexp_extract("patch", f"(?s){_LINE_START}@@.*", 0)))
    return placed.select(*keys, "piece_no", "n_hunks", piece.alias("piece"))


def ordered_union(values: DataFrame, keys: Sequence[str] = (), value: str = "value", source: str = "source_rank",
                  position: str = "pos") -> DataFrame:
    """Distinct values of several sources; each keeps its first place (source, then position)."""
    return first_row(values.where(F.coalesce(value, F.lit("")) != ""), [*keys, value],
                     [F.col(source), F.col(position)])


def summary_requests(hunks: DataFrame, keys: Sequence[str], prior: int = K.PRIOR_SUMMARIES) -> DataFrame:
    """Request text per hunk with the last summaries of the same file.

    ``hunk_no`` is dense from 1 and ``summary`` holds earlier answers; ``n_hunks`` is the file's total.
    """
    windowed = preceding_values(hunks, list(keys), "hunk_no", F.col("summary"), prior, "_prior")
    first = F.col("hunk_no") - F.size("_prior")
    lines = F.transform("_prior", lambda s, j: F.concat(F.lit("  Hunk "), (first + j).cast("string"), F.lit(": "), s))
    before = F.when(F.size("_prior") > 0, F.concat(
        F.lit("Previous hunks in this file:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")
    task = F.format_string("Describe hunk %s of %s from '%s' in one to three sentences.\n\n",
                           F.col("hunk_no").cast("string"), F.col("n_hunks").cast("string"), F.col("file_path"))
    return windowed.withColumn("request", F.concat(
        task, before, F.lit("Hunk "), F.col("hunk_no").cast("string"), F.lit(":\n"), F.col("patch"))).drop("_prior")


def batch_plan(files: DataFrame, total: int = K.TOTAL_DIFF_CHARS, limit: int = K.FILE_DIFF_CHARS) -> DataFrame:
    """Hunk batches of files that are large while the budget is short.

    ``files`` holds n_hunks, total_chars and remaining (budget; NULL or 0 counts as full).
    """
    ratio = F.when(F.coalesce("remaining", F.lit(0)) == 0, 1.0).otherwise(F.col("remaining") / total)
    size = F.greatest(F.lit(1), F.floor(F.col("n_hunks") / 3)).cast("int")
    tight = files.where((ratio < 0.3) & (F.col("total_chars") > 2 * limit)).withColumn("_size", size)
    return tight.withColumn("start_hunk", F.explode(F.sequence(F.lit(1), F.col("n_hunks"), F.col("_size")))).withColumn(
        "end_hunk", F.least(F.col("start_hunk") + F.col("_size") - 1, F.col("n_hunks"))).drop("_size")


def batch_requests(plan: DataFrame, hunks: DataFrame, keys: Sequence[str], wording: str = (
        "Describe hunks %s-%s of %s from '%s' in two to four sentences.\n\n")) -> DataFrame:
    """One request per batch of ``batch_plan``, with the texts of its hunks.

    ``hunks`` holds ``hunk_no`` (from 1) and ``patch``.  Hunks find their batch by its number, which follows from the batch's size.
    """
    keys = list(keys)
    size = F.max(F.col("end_hunk") - F.col("start_hunk") + 1)
    sized = plan.groupBy(*keys).agg(size.alias("_size"), F.max("n_hunks").alias("_of"))
    titled = F.concat(F.lit("Hunk "), F.col("hunk_no").cast("string"), F.lit(":\n"), F.col("patch"))
    start = (F.floor((F.col("hunk_no") - 1) / F.col("_size")) * F.col("_size") + 1).cast("int")
    texts = hunks.join(sized, keys).withColumn("start_hunk", start).groupBy(*keys, "start_hunk").agg(
        F.max("hunk_no").cast("int").alias("end_hunk"), F.max("_of").alias("n_hunks"),
        F.sort_array(F.collect_list(F.struct("hunk_no", titled.alias("text")))).alias("_texts"))
    task = F.format_string(wording, *[F.col(c).cast("string") for c in ("start_hunk", "end_hunk", "n_hunks")], F.col(keys[-1]))
    return texts.select(*keys, "start_hunk", "end_hunk", "n_hunks", F.concat(
        task, F.array_join("_texts.text", "\n\n")).alias("request"))


def batched_summary(answers: DataFrame, keys: Sequence[str], summary: str = "summary") -> DataFrame:
    """(keys, summary): the answers to a file's batches as one text, one line per batch."""
    line = F.format_string("  Hunks %s-%s: %s", F.col("start_hunk").cast("string"), F.col("end_hunk").cast("string"), strip(summary))
    lines = F.sort_array(F.collect_list(F.struct("start_hunk", line.alias("line"))))["line"]
    head = F.format_string("[batched summary — %s hunk(s)]\n", F.max("n_hunks").cast("string"))
    return answers.groupBy(*keys).agg(F.concat(head, F.array_join(lines, "\n")).alias("summary"))
