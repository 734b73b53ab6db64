"""Commit plans: which commit takes which hunk, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.constants import CONTEXT_LINES
from changeloom.functions.jsontext import let
from changeloom.functions.scale import first_row, position_block, scanned
from changeloom.functions.text import as_col, split_lines, strip
from changeloom.operators.diffs import added_lines, removed_lines
from changeloom.session import durable

# -- validation --------------------------------------------------------------------------------------------------


def unknown_hunks(claims: DataFrame, hunks: DataFrame, on: Sequence[str] = ("plan", "hunk")) -> DataFrame:
    """Claims of hunks that do not exist."""
    return claims.join(hunks.select(*on), list(on), "left_anti")


def double_assigned(claims: DataFrame, on: Sequence[str] = ("plan", "hunk"), commit: str = "commit_ix") -> DataFrame:
    """Hunks claimed by more than one commit.

    Rows are dealt by hunk before commits are counted, into as many parts as the session has shuffle partitions.  Adaptive
    execution would join parts by their compressed size, and columns of numbers are many times larger in memory.
    """
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    claims = claims.select(*on, commit).repartition(parts, *on)
    return claims.groupBy(*on).agg(F.count_distinct(commit).alias("n_commits")).where("n_commits > 1")


def unassigned_hunks(hunks: DataFrame, claims: DataFrame, skipped: DataFrame,
                     on: Sequence[str] = ("plan", "hunk")) -> DataFrame:
    """Hunks that are neither claimed nor skipped."""
    taken = claims.select(*on).unionByName(skipped.select(*on))
    return hunks.select(*on).distinct().join(taken, list(on), "left_anti")


def invalid_skips(skipped: DataFrame, hunks: DataFrame, on: Sequence[str] = ("plan", "hunk")) -> DataFrame:
    return skipped.select(*on).distinct().join(hunks.select(*on), list(on), "left_anti")


def remap_hunks(claims: DataFrame, hunks: DataFrame, keys: Sequence[str] = ("plan",)) -> DataFrame:
    """Resolve claimed ids: known ones stay, ``p::k`` falls back to an untracked ``p::1``, the rest is dropped.

    Adds ``resolved`` and ``remapped``.
    """
    known = hunks.select(*keys, F.col("hunk_id").alias("_known"))
    whole = hunks.where("is_untracked").select(*keys, F.col("hunk_id").alias("_whole"))
    keys = list(keys)
    direct = claims.join(known.withColumnRenamed("_known", "hunk_id").withColumn("_hit", F.lit(True)),
                         [*keys, "hunk_id"], "left")
    stem = F.regexp_extract("hunk_id", "(?s)^(.*)::", 1)
    asked = F.when(F.col("_hit").isNull() & F.contains("hunk_id", F.lit("::")), F.concat(stem, F.lit("::1")))
    fallback = direct.withColumn("_whole", asked).join(
        whole.withColumn("_found", F.lit(True)), [*keys, "_whole"], "left")
    resolved = F.when(F.col("_hit"), F.col("hunk_id")).when(F.col("_found"), F.col("_whole"))
    return fallback.withColumn("resolved", resolved).where("resolved IS NOT NULL").withColumn(
        "remapped", F.col("resolved") != F.col("hunk_id")).drop("_hit", "_found", "_whole")


# -- merging -----------------------------------------------------------------------------------------------------


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs directly under one node that hangs under none."""
    ends = edges.select("plan", F.col("v").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        edges.select("plan", F.col("u").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    state = ends.groupBy("plan", "x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return state.where("leaf > 1 OR (leaf > 0 AND centre > 0)").isEmpty()


def _star(edges: DataFrame, minimum: DataFrame) -> DataFrame:
    return edges.join(minimum, ["plan", "u"])


# Claims of a plan that one task links at a time; larger plans are linked by all tasks, in rounds.
PLAN_CLAIMS = 1 << 18


def overlap_components(claims: DataFrame, max_rounds: int = 50, most: int = PLAN_CLAIMS) -> DataFrame:
    """(plan, commit_ix, component): commits that share hunks, directly or through others.

    The component is named by its smallest commit, which is also the order of the merged plan.  Components never reach
    beyond their plan, so a plan of at most ``most`` claims is linked at once where its rows meet.  Larger plans take the
    rounds of ``_linked_in_rounds``.  ``claims`` is read more than once: hand over a stored table if it is costly.
    """
    claims = claims.select("plan", "commit_ix", "hunk")
    large = durable(claims.where("plan IS NOT NULL").groupBy("plan").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > most).select("plan"))
    # Claims of no plan link nothing.
    small = claims.where("plan IS NOT NULL")
    rows = [claims.where("plan IS NULL").select("plan", "commit_ix", F.col("commit_ix").alias("component")).distinct()]
    if not large.isEmpty():
        rows.append(_linked_in_rounds(small.join(F.broadcast(large), "plan", "left_semi"), max_rounds))
        small = small.join(F.broadcast(large), "plan", "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in claims.schema}
    linked = small.repartition("plan").sortWithinPartitions("plan", "hunk").mapInArrow(
        _linked, f"plan {kinds['plan']}, commit_ix {kinds['commit_ix']}, component {kinds['commit_ix']}")
    return reduce(DataFrame.unionByName, [linked, *rows])


# Rows in a batch that is handed on, at least, unless it is the last one.
LINKED_ROWS = 4096


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of plans whose claims come in order of plan and hunk, plan by plan."""
    kinds, out = [], ([], [], [])
    plan, hunk, near, above = None, None, None, {}

    def top(v):
        while above[v] != v:
            above[v] = v = above[above[v]]
        return v

    def close():
        commits = list(above)
        out[0].extend([plan] * len(commits))
        out[1].extend(commits)
        out[2].extend(map(top, commits))

    def taken():
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                           names=["plan", "commit_ix", "component"])
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        kinds = [batch.column(c).type for c in (0, 1, 1)]
        for p, v, h in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if p != plan:
                close()
                plan, hunk, above = p, None, {}
                if len(out[0]) >= LINKED_ROWS:
                    yield taken()
            if v not in above:
                above[v] = v
            if v is None or h is None:
                continue
            if h != hunk:
                hunk, near = h, v
                continue
            a, b = top(near), top(v)
            if a < b:
                above[b] = a
            elif b < a:
                above[a] = b
    close()
    if out[0]:
        yield taken()


def _linked_in_rounds(claims: DataFrame, max_rounds: int) -> DataFrame:
    """Components of plans of any size.

    Edges run from each claiming commit to the smallest claimant of the hunk, never between all pairs, and are contracted to
    stars in a logarithmic number of rounds (alternating large and small stars).  Every round is cut from its lineage.
    """
    nodes = claims.select("plan", F.col("commit_ix").alias("v")).distinct()
    smallest = claims.groupBy("plan", "hunk").agg(F.min("commit_ix").alias("u"))
    edges = durable(
        claims.join(smallest, ["plan", "hunk"]).where(F.col("commit_ix") != F.col("u"))
        .select("plan", F.col("commit_ix").alias("v"), "u").distinct())
    for _ in range(max_rounds):
        if _settled(edges):
            break
        # Large star: each neighbour above u hangs under the smallest node around u.
        both = edges.select("plan", "u", "v").unionByName(
            edges.select("plan", F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("plan", "u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = _star(both, around).where("v > u").select("plan", F.col("m").alias("u"), "v").where(
            "u <> v").distinct()
        # Small star: each node and its smaller neighbours hang under the smallest of them.
        down = large.select("plan", F.col("v").alias("u"), F.col("u").alias("v"))
        below = down.groupBy("plan", "u").agg(F.min("v").alias("m"))
        small = _star(down, below).select("plan", F.col("m").alias("u"), "v").where("u <> v").unionByName(
            below.select("plan", F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        edges = durable(small)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges, ["plan", "v"], "left").select(
        "plan", F.col("v").alias("commit_ix"), F.coalesce("u", "v").alias("component"))


def merge_groups(components: DataFrame) -> DataFrame:
    """Components of several commits, each of which needs a merged message; others stay as they are."""
    return components.groupBy("plan", "component").agg(F.count(F.lit(1)).alias("n_commits")).where("n_commits > 1")


def component_hunks(claims: DataFrame, components: DataFrame, position: str = "pos") -> DataFrame:
    """Distinct hunks of each component with the place where each was first seen.

    Rows, not arrays: a component may hold any number of hunks.
    """
    joined = claims.join(components, ["plan", "commit_ix"])
    return first_row(joined, ["plan", "component", "hunk"], [F.col("commit_ix"), F.col(position)]).select(
        "plan", "component", "hunk", F.col("commit_ix").alias("first_commit"), F.col(position).alias("first_pos"))


def component_issues(issues: DataFrame, components: DataFrame, position: str = "pos") -> DataFrame:
    """Issues of each component, distinct by path and message."""
    joined = issues.join(components, ["plan", "commit_ix"])
    keyed = joined.withColumn("path", F.coalesce("path", F.lit(""))).withColumn(
        "message", F.coalesce("message", F.lit("")))
    return first_row(keyed, ["plan", "component", "path", "message"], [F.col("commit_ix"), F.col(position)]).select(
        "plan", "component", "path", "message")


def merge_pair(a: Column, b: Column) -> Column:
    """Two commits as one: lists are concatenated, a's subject stays, different breaking notes are joined."""

    def text(value):
        return F.coalesce(value, F.lit(""))

    def kept(value):
        return F.when(strip(text(value)) != "", value)

    note_a, note_b = strip(text(a["breaking_change"])), strip(text(b["breaking_change"]))
    both = (note_a != "") & (note_b != "") & (note_a != note_b)
    return F.struct(
        a["subject"].alias("subject"), F.concat_ws("\n\n", kept(a["body"]), kept(b["body"])).alias("body"),
        F.concat(a["hunks"], b["hunks"]).alias("hunks"), F.concat(a["issues"], b["issues"]).alias("issues"),
        F.when(both, F.concat(note_a, F.lit("; "), note_b)).when(note_a != "", note_a).otherwise(note_b)
        .alias("breaking_change"))


def merge_commits(commits: DataFrame, pairs: DataFrame, key: str = "plan", index: str = "commit_ix") -> DataFrame:
    """Merge one pair (a, b) per plan; the merged commit takes the smaller index, other commits stay.

    ``commits`` holds a struct ``commit``.  Pairs that name one commit twice or a missing one change nothing.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    wanted = pairs.where("a <> b").select(key, low.alias("_lo"), high.alias("_hi"))
    partner = commits.select(key, F.col(index).alias("_hi"), F.col("commit").alias("_other"))
    found = wanted.join(partner, [key, "_hi"]).join(
        commits.select(key, F.col(index).alias("_lo")), [key, "_lo"])
    joined = commits.join(found, key, "left")
    commit = F.when(F.col(index) == F.col("_lo"), merge_pair(F.col("commit"), F.col("_other"))).otherwise(F.col("commit"))
    return joined.where(F.col("_hi").isNull() | (F.col(index) != F.col("_hi"))).select(
        key, index, commit.alias("commit"))


# -- conflicts ---------------------------------------------------------------------------------------------------


def dependent_splits(ranges: DataFrame, keys: Sequence[str] = ("plan", "file"), near: int = CONTEXT_LINES,
                     bucket: int = 64) -> DataFrame:
    """Pairs of hunks of one file in different commits whose old ranges overlap or nearly touch.

    A range join: the later range is looked up by the bucket of its start, the earlier one lies in every bucket it
    reaches.  Each pair meets in one bucket only, and ranges far apart never meet, however hot the file is.
    ``ranges`` holds commit_ix, pos (unique in the file), start_line and line_count.
    """
    keys = list(keys)
    ends = ranges.withColumn("end_line", F.col("start_line") + F.greatest(F.col("line_count") - 1, F.lit(0)))

    def bucket_of(line):
        return F.floor(line / F.lit(bucket)).cast("bigint")

    def side(prefix):
        return [F.col(c).alias(f"{prefix}_{c}") for c in ("commit_ix", "pos", "start_line", "end_line")]

    reach = F.sequence(bucket_of(F.col("start_line")), bucket_of(F.col("end_line") + near))
    early = ends.select(*keys, F.explode(reach).alias("_bucket"), *side("x"))
    late = ends.select(*keys, bucket_of(F.col("start_line")).alias("_bucket"), *side("y"))
    ordered = (F.col("x_start_line") < F.col("y_start_line")) | (
        (F.col("x_start_line") == F.col("y_start_line")) & (F.col("x_pos") < F.col("y_pos")))
    close = F.col("y_start_line") <= F.col("x_end_line") + near
    pairs = early.join(late, [*keys, "_bucket"]).where(
        ordered & close & (F.col("x_commit_ix") != F.col("y_commit_ix")))
    gap = F.greatest(F.col("y_start_line") - F.col("x_end_line"), F.col("x_start_line") - F.col("y_end_line"))
    first = F.col("x_pos") < F.col("y_pos")

    def pick(name, when_first, otherwise):
        return F.when(first, F.col(when_first)).otherwise(F.col(otherwise)).alias(name)

    return pairs.select(*keys, pick("commit_a", "x_commit_ix", "y_commit_ix"), pick("pos_a", "x_pos", "y_pos"),
                        pick("commit_b", "y_commit_ix", "x_commit_ix"), pick("pos_b", "y_pos", "x_pos"),
                        gap.cast("bigint").alias("gap"))


def _best_of_another(rows: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column,
                     commit: str, name: str) -> DataFrame:
    """Adds the greatest ``value`` (a struct with ``commit_ix``) among the rows before that belong to another commit.

    Two running maxima are enough.  The first is over all rows before.  Whenever a row and that maximum belong to different
    commits, the smaller of the two is a candidate; the greatest candidate is the best one outside the maximum's own commit,
    as the maximum of another commit that it displaced is a candidate, too.
    """
    valued = scanned(rows.withColumn("_value", value), keys, block, order, {"_top": (F.col("_value"), "max", -1)})
    other = F.when(F.col("_value.commit_ix") != F.col("_top.commit_ix"), F.least("_value", "_top"))
    second = scanned(valued, keys, block, order, {"_second": (other, "max", 0)})
    # The candidate made by the row itself counts only if it isn't the row's own value.
    own = second.withColumn("_before", F.when(F.col("_top.commit_ix") != F.col(commit), F.col("_top")).otherwise(
        F.when(F.col("_second.commit_ix") != F.col(commit), F.col("_second"))))
    return own.withColumnRenamed("_before", name).drop("_value", "_top", "_second")


def nearest_conflicts(ranges: DataFrame, keys: Sequence[str] = ("plan", "file"), near: int = CONTEXT_LINES,
                      block_lines: int = 4096) -> DataFrame:
    """Hunks whose old range overlaps or nearly touches one of another commit, one row each.

    ``before_*`` is the range that reaches furthest among those that start earlier (by start line, then pos), ``after_*`` the
    first that starts later; each is NULL if it is not within ``near`` lines.  ``gap`` is the smaller distance, negative
    where ranges overlap.  The output is linear in the hunks, also where a file's ranges all overlap; ``dependent_splits`` lists
    all pairs.  A sweep in order of start line, block by block.
    """
    keys = list(keys)
    ends = ranges.select(*keys, "commit_ix", "pos", "start_line", (F.col("start_line") + F.greatest(
        F.col("line_count") - 1, F.lit(0))).alias("end_line"))
    block = position_block("start_line", block_lines)
    reach = F.struct("end_line", (-F.col("pos")).alias("tie"), "commit_ix", "pos", "start_line")
    begin = F.struct((-F.col("start_line")).alias("up"), (-F.col("pos")).alias("tie"), "commit_ix", "pos", "start_line", "end_line")
    swept = _best_of_another(ends, keys, block, [F.col("start_line"), F.col("pos")], reach, "commit_ix", "_b")
    swept = _best_of_another(swept, keys, -block, [F.desc("start_line"), F.desc("pos")], begin, "commit_ix", "_a")

    def gap(early_start, early_end, late_start, late_end):
        return F.greatest(late_start - early_end, early_start - late_end).cast("bigint")

    start, end = F.col("start_line"), F.col("end_line")
    before = F.when(start - F.col("_b.end_line") <= near, F.col("_b"))
    after = F.when(F.col("_a.start_line") - end <= near, F.col("_a"))
    return swept.withColumn("_b", before).withColumn("_a", after).where("_a IS NOT NULL OR _b IS NOT NULL").select(
        *keys, "commit_ix", "pos", F.col("_b.commit_ix").alias("before_commit"), F.col("_b.pos").alias("before_pos"),
        F.col("_a.commit_ix").alias("after_commit"), F.col("_a.pos").alias("after_pos"),
        F.least(gap(F.col("_b.start_line"), F.col("_b.end_line"), start, end),
                gap(start, end, F.col("_a.start_line"), F.col("_a.end_line"))).alias("gap"))


# -- display and messages ----------------------------------------------------------------------------------------


def file_rollup(claims: DataFrame, hunks: DataFrame, keys: Sequence[str] = ("plan",),
                commit: str = "commit_ix") -> DataFrame:
    """Files of each commit with line totals and a marker: '+' new, '×' pure deletion, '~' otherwise.

    Hunk lines are counted before the shuffle, so patches do not travel.
    """
    keys = list(keys)
    counted = hunks.select(*keys, "hunk_id", "file_path", "is_untracked", added_lines("patch").alias("_a"),
                           removed_lines("patch").alias("_r"), F.lit(True).alias("_known"))
    joined = claims.join(counted, [*keys, "hunk_id"], "left")
    path = F.coalesce("file_path", F.regexp_extract("hunk_id", "(?s)^(.*)::", 1))
    path = F.when(F.col("file_path").isNull() & ~F.contains("hunk_id", F.lit("::")), F.col("hunk_id")).otherwise(path)
    rolled = joined.withColumn("_path", path).groupBy(*keys, commit, F.col("_path").alias("file_path")).agg(
        F.sum("_a").cast("bigint").alias("added"), F.sum("_r").cast("bigint").alias("removed"),
        F.bool_or("is_untracked").alias("_new"), F.count("_known").alias("n_hunks"))
    marker = (
        F.when(F.col("n_hunks") == 0, "~").when(F.col("_new"), "+")
        .when((F.col("added") == 0) & (F.col("removed") > 0), "×").otherwise("~")
    )
    return rolled.withColumn("marker", marker).drop("_new")


def strip_breaking_trailer(body: Column | str) -> Column:
    """Body without BREAKING CHANGE trailers; each reaches up to the next blank line."""
    none = F.array().cast("array<struct<first:int,after:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("open"), none.alias("cuts"))

    def step(state, line):
        opens = line.rlike("(?i)^BREAKING[- ]CHANGE\\s*:")
        ends = (state["open"] >= 0) & ~opens & (strip(line) == "")
        # Only where a trailer ends is something added, so the fold is linear in the lines.
        cut = F.array(F.struct(state["open"].alias("first"), state["at"].alias("after")))
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(ends, -1).when(opens & (state["open"] < 0), state["at"]).otherwise(state["open"]).alias("open"),
            F.when(ends, F.concat(state["cuts"], cut)).otherwise(state["cuts"]).alias("cuts"))

    def cuts_of(state):
        last = F.array(F.struct(state["open"].alias("first"), state["at"].alias("after")))
        return F.when(state["open"] >= 0, F.concat(state["cuts"], last)).otherwise(state["cuts"])

    def without(lines):
        return let(F.aggregate(lines, start, step, cuts_of), lambda cuts: F.filter(
            lines, lambda line, i: ~F.exists(cuts, lambda cut: (i >= cut["first"]) & (i < cut["after"]))))

    return strip(F.array_join(let(split_lines(body), without), "\n"))


def commit_message(subject="subject", body="body", breaking="breaking_change", signature: str | None = None) -> Column:
    """Subject, body and trailers, separated by blank lines; empty parts are left out."""
    text = F.nullif(strip_breaking_trailer(strip(F.coalesce(as_col(body), F.lit("")))), F.lit(""))
    note = F.nullif(strip(F.coalesce(as_col(breaking), F.lit(""))), F.lit(""))
    trailers = F.nullif(F.concat_ws("\n", F.concat(F.lit("BREAKING CHANGE: "), note),
                                    F.lit(signature).cast("string")), F.lit(""))
    return F.concat_ws("\n\n", as_col(subject), text, trailers)


def edited_message(message: Column | str) -> Column:
    """struct<subject, body> of an edited text, split at its first blank line."""
    parts = F.split(as_col(message), "\n\n", 2)
    return F.struct(strip(parts[0]).alias("subject"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("body"))


def new_patterns(suggested: DataFrame, existing_lines: DataFrame, keys: Sequence[str] = (),
                 pattern: str = "pattern", line: str = "line") -> DataFrame:
    """Suggested ignore patterns that no non-comment line has yet."""
    known = existing_lines.select(*keys, strip(line).alias(pattern)).where(
        (F.col(pattern) != "") & ~F.col(pattern).startswith("#"))
    return suggested.join(known, [*keys, pattern], "left_anti")


def plan_counts(hunks: DataFrame, keys: Sequence[str] = ("plan",), hunk: str = "hunk_id",
                file: str = "file_path") -> DataFrame:
    return hunks.groupBy(*keys).agg(F.count_distinct(hunk).alias("n_hunks"), F.count_distinct(file).alias("n_files"))
