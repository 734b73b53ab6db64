"""Finding and checking JSON inside model output, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.text import BLANKS, strip

_BLANK = "[" + "".join(f"\\u{ord(c):04X}" for c in BLANKS) + "]"
# Code fences, removed wherever a line starts or ends with one.
OPENING_FENCE = f"(?md)^```(?:json)?{_BLANK}*\\n?"
CLOSING_FENCE = f"(?md)\\n?```{_BLANK}*$"
_PIECES = '(?s)\\\\.|["{}]|[^"\\\\{}]+|\\\\'


def strip_fences(text: Column) -> Column:
    opened = F.regexp_replace(strip(text), OPENING_FENCE, "")
    return strip(F.regexp_replace(opened, CLOSING_FENCE, ""))


def _first_object_end(pieces: Column) -> Column:
    """Index of the piece that closes the first object, 0 if it stays open."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state, piece):
        quoted, done = state["quoted"], state["end"] > 0
        # A backslash escapes inside strings only; outside, the character after it counts.
        toggles = (piece == '"') | ((piece == '\\"') & ~quoted)
        opens = ~quoted & piece.isin("{", "\\{")
        closes = ~quoted & piece.isin("}", "\\}")
        depth = state["depth"] + opens.cast("int") - closes.cast("int")
        at = state["at"] + 1
        moved = F.struct(
            depth.alias("depth"), (quoted != toggles).alias("quoted"), at.alias("at"),
            F.when(closes & (depth == 0), at).otherwise(0).alias("end"))
        return F.when(done, state).otherwise(moved)

    return F.aggregate(pieces, start, step, lambda state: state["end"])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times."""
    return F.transform(F.array(value), body)[0]


def first_object(text: Column) -> Column:
    """struct<raw, error>: the first balanced ``{...}``, honouring strings and escapes."""

    def pieces_of(clean):
        brace = F.locate("{", clean)
        body = F.when(brace > 0, F.substring(clean, brace, F.length(clean)))
        return F.regexp_extract_all(body, F.lit(_PIECES), 0)

    def outcome(pieces):
        return let(_first_object_end(pieces), lambda end: F.struct(
            F.when(end > 0, F.array_join(F.slice(pieces, F.lit(1), F.greatest(end, F.lit(0))), "")).alias("raw"),
            F.when(pieces.isNull(), "none").when(end == 0, "incomplete").alias("error")))

    return let(strip_fences(F.coalesce(text, F.lit(""))), lambda clean: let(pieces_of(clean), outcome))


def extract_json_object(df: DataFrame, text: str, raw: str = "raw_json", error: str = "json_error") -> DataFrame:
    """Adds the first JSON object of a text.  ``error`` is 'none' without any, 'incomplete' if it never closes.

    The scan sits in a generator, which no later filter can pull apart and run again.
    """
    return df.select("*", F.inline(F.array(first_object(F.col(text)))).alias(raw, error))


def commit_list_error(raw: Column | str, allow_empty: bool = False) -> Column:
    """Why a JSON object is no usable label: 'invalid', 'not_a_list', 'empty'; NULL if it is usable."""

    def reason(parsed):
        commits = F.try_variant_get(parsed, "$.commits", "array<variant>")
        found = F.when(parsed.isNull(), "invalid").when(commits.isNull(), "not_a_list")
        return found if allow_empty else found.when(F.size(commits) == 0, "empty")

    return let(F.try_parse_json(raw), reason)
