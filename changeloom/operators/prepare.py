"""Labelled examples to chat training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import constants as K
from changeloom.functions.scale import hash_block, scanned, sum_before
from changeloom.functions.text import as_col, escape_non_ascii, seeded_hash
from changeloom.operators.label import SFT_PROMPT, PromptSet, append_noise, build_messages, draw_templates, message


def label_problem(label: Column | str = "label") -> Column:
    """'no_label', 'no_commits' or NULL for a usable label."""
    label = as_col(label)
    return F.when(label.isNull(), "no_label").when(F.coalesce(F.size(label["commits"]), F.lit(0)) <= 0, "no_commits")


def assistant_text(commits: Column, gitignore: Column) -> Column:
    """Compact JSON of a label.  Missing fields of a commit are left out, as they were in its source."""
    return F.to_json(F.struct(commits.alias("commits"), F.coalesce(
        gitignore, F.array().cast("array<string>")).alias("gitignore")))


def assistant_text_of_json(raw: Column | str) -> Column:
    """The same from the label's own JSON, which keeps fields that no schema names and the order of all."""
    def part(name):
        return F.get_json_object(raw, f"$.{name}")

    return F.concat(F.lit('{"commits":'), part("commits"), F.lit(',"gitignore":'),
                    F.coalesce(part("gitignore"), F.lit("[]")), F.lit("}"))


def sft_messages(prompt: PromptSet = SFT_PROMPT, label: str = "label", label_json: str | None = None,
                 ascii_only: bool = False) -> Column:
    """Chat triple.  The answer comes from ``label``, or from the raw ``label_json`` where that column is named; optionally with
    other characters than ASCII escaped."""
    text = assistant_text_of_json(label_json) if label_json else assistant_text(
        F.col(label)["commits"], F.col(label)["gitignore"])
    answer = message("assistant", escape_non_ascii(text) if ascii_only else text)
    return F.concat(build_messages(prompt), F.array(answer))


def augment(examples: DataFrame, variants: int = 1, seed: int = 42, key: str = "example_key") -> DataFrame:
    """Noisy variants of clean examples.  Commits stay, ignore rules grow; variants without new files are dropped."""
    clean = examples.where(~F.coalesce("noise_injected", F.lit(False)))
    spread = clean.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    drawn = spread.withColumn("_picks", draw_templates(
        F.col("changed_files"), K.AUGMENT_NOISE, seed, key, F.col("variant"))).where(F.size("_picks") > 0)
    known = F.coalesce(F.col("label")["gitignore"], F.array().cast("array<string>"))
    rules = F.array_sort(F.array_union(known, F.col("_picks")["rule"]))
    return (
        append_noise(drawn, "_picks").withColumn("is_augmented", F.lit(True))
        .withColumn("label", F.col("label").withField("gitignore", rules)).drop("_picks")
    )


def stratum(languages: Column | str = "languages", repo: Column | str = "repo_url") -> Column:
    first = F.coalesce(F.try_element_at(as_col(languages), F.lit(1)), F.lit("unknown"))
    return F.concat(first, F.lit(":"), as_col(repo))


def stratified_split(examples: DataFrame, fraction: float = 0.1, seed: int = 42, key: str = "example_key",
                     stratum_col: str = "stratum", augmented: str | None = None) -> DataFrame:
    """(key, stratum, split).  Every stratum of two or more gives at least one row to validation.

    With ``augmented`` set, those rows go to train and are not counted.  Ranks are taken per block of hashes, so a
    stratum that holds most of the rows is still ranked by many tasks.
    """
    drawn = examples.select(key, stratum_col, (F.col(augmented) if augmented else F.lit(False)).alias("_grown"),
                            seeded_hash(seed, key).alias("_draw"))
    counted = F.when(~F.col("_grown"), F.lit(1).cast("bigint"))
    ranked = scanned(drawn, [stratum_col], hash_block("_draw"), [F.col("_draw"), F.col(key)], {"_rank": (counted, "sum", 0)},
                     {"_n": (counted, "sum")})
    to_val = ~F.col("_grown") & (F.col("_n") > 1) & (F.col("_rank") <= F.greatest(F.lit(1), F.rint(F.col("_n") * fraction)))
    return ranked.select(key, stratum_col, F.when(to_val, "val").otherwise("train").alias("split"))


def seeded_order(df: DataFrame, seed: int = 42, key: str = "example_key", digits: int = 3) -> DataFrame:
    """Shuffle position of every row (0-based), without a global sort in one task."""
    drawn = df.withColumn("_draw", seeded_hash(seed, key))
    placed = sum_before(drawn, [], hash_block("_draw", digits), [F.col("_draw"), F.col(key)], F.lit(1), "shuffle_pos")
    return placed.drop("_draw")


def strip_metadata(df: DataFrame) -> DataFrame:
    return df.drop("languages", "repo_url", "is_augmented")


def render_chat(messages: Column | str, begin: str = "<|im_start|>", end: str = "<|im_end|>\n") -> Column:
    """Messages as one training text."""
    return F.array_join(F.transform(as_col(messages), lambda m: F.concat(
        F.lit(begin), m["role"], F.lit("\n"), m["content"], F.lit(end))), "")


def pack_plan(sequences: DataFrame, key: str = "example_key", tokens: str = "n_tokens", seed: int = 42,
              length: int = K.SEQUENCE_TOKENS, digits: int = 3) -> DataFrame:
    """Pack and offset of every sequence in one long stream of tokens, cut every ``length`` tokens."""
    drawn = sequences.select(key, tokens).withColumn("_draw", seeded_hash(seed, key))
    placed = sum_before(drawn, [], hash_block("_draw", digits), [F.col("_draw"), F.col(key)], F.col(tokens), "_start")
    return placed.select(key, tokens, F.floor(F.col("_start") / length).cast("bigint").alias("pack_id"),
                         F.pmod("_start", F.lit(length)).cast("bigint").alias("pack_offset"))


def counters() -> dict[str, Column]:
    """Aggregates over prepared rows, of which ``problem``, ``is_augmented`` and ``split`` are given."""
    base = ~F.col("is_augmented")
    return {"loaded": F.count_if(base), "skipped": F.count_if(base & F.col("problem").isNotNull()),
            "augmented": F.count_if(F.col("is_augmented")), "train": F.count_if(F.col("split") == "train"),
            "val": F.count_if(F.col("split") == "val")}


def prep_counters(prepared: DataFrame) -> DataFrame:
    """One row of counts.  Where the rows are written anyway, ``tables.write_counted`` takes the counts in the same pass."""
    return prepared.agg(*[value.alias(name) for name, value in counters().items()])


def leaked_keys(split: DataFrame, base_key: str = "base_key") -> DataFrame:
    """Base examples that occur in both splits."""
    sides = split.groupBy(base_key).agg(F.bool_or(F.col("split") == "train").alias("_t"),
                                        F.bool_or(F.col("split") == "val").alias("_v"))
    return sides.where("_t AND _v").select(base_key)


def split_then_augment(examples: DataFrame, variants: int = 1, fraction: float = 0.1, seed: int = 42,
                       key: str = "example_key", reference_compat: bool = False) -> DataFrame:
    """Base rows and variants with their split.

    By default only training rows are augmented.  ``reference_compat`` augments all of them and sends every variant
    to train, which leaks validation examples (``leaked_keys`` shows them).
    """
    split = stratified_split(examples, fraction, seed, key).drop("stratum")
    base = examples.join(split, key).withColumn("is_augmented", F.lit(False)).withColumn("variant", F.lit(None).cast("int"))
    source = base if reference_compat else base.where("split = 'train'")
    grown = augment(source, variants, seed, key).withColumn("split", F.lit("train"))
    return base.unionByName(grown, allowMissingColumns=True)
