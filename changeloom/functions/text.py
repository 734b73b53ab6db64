"""Column helpers for text, paths and seeded hashing.  Everything here stays on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries and blank characters that a universal-newline text reader recognises.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"
AFTER_LINE_BREAK = "(?<=\\n)|(?<=\\r)(?!\\n)|(?<=[\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029])"
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _no_lines() -> Column:
    return F.array().cast("array<string>")


# A noncharacter: marks cut points in texts that do not hold it themselves.
CUT = "\ufdd0"
UNUSUAL = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", CUT]


def unusual_breaks(text: Column) -> Column:
    """Whether a text has line breaks other than '\\n' (or the cut mark).  Almost none has, and those that do not are
    split by plain byte searches.  Ten such searches cost a tenth of one character class."""
    found = F.lit(False)
    for mark in UNUSUAL:
        found = found | F.contains(text, F.lit(mark))
    return found


def split_lines(text: Column | str) -> Column:
    """Lines without their ends; '' has no lines, and a final line break opens no extra line."""
    text = as_col(text)
    plain = F.split(F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n", -1)
    any_break = F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)
    return F.when(text == "", _no_lines()).when(unusual_breaks(text), any_break).otherwise(plain)


def split_before(text: Column, marks: list[str], pattern: str) -> Column:
    """Cut a text at every line start that is followed by one of the marks; ``pattern`` does the same for any breaks."""
    cut = text
    for mark in marks:
        cut = F.replace(cut, F.lit("\n" + mark), F.lit("\n" + CUT + mark))
    return F.when(unusual_breaks(text), F.split(text, pattern, -1)).otherwise(F.split(cut, CUT, -1))


def split_lines_keep_ends(text: Column | str) -> Column:
    text = as_col(text)
    cut = F.replace(text, F.lit("\n"), F.lit("\n" + CUT))
    plain = F.split(F.when(text.endswith("\n"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut), CUT, -1)
    any_break = F.split(text, f"(?:{AFTER_LINE_BREAK})(?!\\z)", -1)
    return F.when(text == "", _no_lines()).when(unusual_breaks(text), any_break).otherwise(plain)


def strip(text: Column | str) -> Column:
    return F.btrim(as_col(text), F.lit(BLANKS))


def is_blank(text: Column | str) -> Column:
    return strip(text) == ""


def blank_to_null(text: Column | str) -> Column:
    """The stripped text, or NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.rtrim(as_col(path), F.lit("/")), "/", -1)


def parent_dir(path: Column | str) -> Column:
    """Directory part, '' for a top-level path."""
    return F.regexp_extract(as_col(path), "^(.*)/[^/]*$", 1)


def suffix(path: Column | str) -> Column:
    """Last extension with its dot; '' for dot files and names without one."""
    return F.regexp_extract(base_name(path), "^.+(\\.[^.]+)$", 1)


def count_of(text: Column | str, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    text = as_col(text)
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle)))
    return (removed / F.lit(len(needle))).cast("bigint")


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """Hex digest used wherever a seeded random choice is needed; the same key always draws the same value."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys]))


def hash_int(digest: Column, start: int = 1, width: int = 8) -> Column:
    return F.conv(F.substring(digest, start, width), 16, 10).cast("bigint")


def bernoulli(digest: Column, probability: float) -> Column:
    """True with the given probability, decided by the first 32 bits of the digest."""
    threshold = int(probability * 2**32)
    return hash_int(digest) < F.lit(threshold)


def truncate(text: Column | str, limit: int, marker: str) -> Column:
    text = as_col(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def escape_non_ascii(text: Column | str) -> Column:
    """Other characters than ASCII as \\uXXXX (two of them beyond the first 65,536), as JSON writers do by default."""
    def unit(code):
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def shown(character):
        code = F.ascii(character).cast("bigint")
        rest = code - 0x10000
        pair = F.concat(unit(F.shiftright(rest, 10) + 0xD800), unit(rest.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(F.length(character) == 6, F.lower(character)).when(code < 128, character).when(rest < 0, unit(code)).otherwise(pair)

    text = as_col(text)
    # Escapes that are there already are written alike; an escaped backslash begins none.
    characters = F.regexp_extract_all(text, F.lit("(?s)\\\\\\\\|\\\\u[0-9A-Fa-f]{4}|."), 0)
    return F.when(text.rlike("^\\p{ASCII}*$") & ~F.contains(text, F.lit("\\u")), text).otherwise(F.array_join(F.transform(characters, shown), ""))
