"""Structural profiles of large files, by extension."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from changeloom.functions import constants as K
from changeloom.functions.jsontext import let
from changeloom.functions.text import as_col, is_blank, split_lines, split_lines_keep_ends, suffix

JS_SUFFIXES = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
# Line patterns of script files.
JS_IMPORT = "(?mdU)^(?:import|export\\s+\\{[^}]*\\}|export\\s+\\*)\\s+.*"
JS_FUNCTION = "(?mdU)^(?:export\\s+)?(?:async\\s+)?function\\s+(\\w+)\\s*\\("
JS_CLASS = "(?mdU)^(?:export\\s+)?class\\s+(\\w+)"
JS_ARROW = "(?mdU)^(?:export\\s+)?const\\s+(\\w+)\\s*=\\s*(?:async\\s+)?(?:\\(|[\\w]+\\s*=>)"


def _grouped(number: Column) -> Column:
    return F.format_number(number, 0)


def _header(path: Column, content: Column) -> Column:
    return F.concat(F.lit("[structural summary of "), path, F.lit(" — "), _grouped(F.length(content)),
                    F.lit(" chars; use query_tool_result to retrieve specifics]\n"))


# -- JSON --------------------------------------------------------------------------------------------------------


def _type_name(value: Column, text: Column) -> Column:
    """Type of a JSON value in the words of the reader.  The text tells 1.0 from 1."""
    kind = F.schema_of_variant(value)
    number = F.when(text.rlike("[.eE]"), "float").otherwise("int")
    return (
        F.when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType")
        .when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict").otherwise(number)
    )


def _quoted(name: Column) -> Column:
    """A name in quotes as the reader shows it: single quotes unless only those occur inside, escapes for the rest."""
    shown = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    for code in [*range(32), 127]:
        shown = F.replace(shown, F.lit(chr(code)), F.lit({9: "\\t", 10: "\\n", 13: "\\r"}.get(code, f"\\x{code:02x}")))
    single = F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(name, F.lit("'")) & ~F.contains(name, F.lit('"')), F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(single)


def describe_json(document: Column, note: Column) -> Column:
    """Keys and types of an object, or length and element type of an array; NULL for anything else."""

    def of_object(values, texts):
        # A repeated key keeps its first place and its last value.
        keys = F.array_distinct(F.map_keys(values))
        backwards = F.reverse(F.map_keys(values))

        def last(entries, key):
            return F.get(F.reverse(F.map_values(entries)), F.array_position(backwards, key).cast("int") - 1)

        shown = F.transform(F.slice(keys, 1, 20), lambda k: F.concat(
            _quoted(k), F.lit(" ("), _type_name(last(values, k), last(texts, k)), F.lit(")")))
        more = F.when(F.size(keys) > 20, F.concat(F.lit(" … (+"), (F.size(keys) - 20).cast("string"), F.lit(" more)")))
        return F.concat(F.lit("Object with "), F.size(keys).cast("string"), F.lit(" keys"), note, F.lit(": "),
                        F.array_join(shown, ", "), F.coalesce(more, F.lit("")))

    def of_array(items):
        # The element's own text: a variant no longer tells 1.0 from 1.
        text = F.get(F.from_json(document, "array<string>"), F.lit(0))
        each = F.concat(F.lit(" (each: "), _type_name(F.get(items, F.lit(0)), text), F.lit(")"))
        return F.concat(F.lit("Array of "), _grouped(F.size(items)), F.lit(" items"), note,
                        F.when(F.size(items) > 0, each).otherwise(""))

    def pick(parsed):
        kind = F.schema_of_variant(parsed)
        as_object = of_object(F.from_json(document, "map<string,variant>"), F.from_json(document, "map<string,string>"))
        return F.when(kind.startswith("OBJECT"), as_object).when(
            kind.startswith("ARRAY"), of_array(F.try_variant_get(parsed, "$", "array<variant>")))

    return let(F.try_parse_json(document), pick)


def _jsonl(content: Column) -> Column:
    def of_lines(lines):
        note = F.concat(F.lit(" ("), _grouped(F.size(lines)), F.lit(" lines)"))
        return describe_json(F.coalesce(F.get(lines, F.lit(0)), F.lit("{}")), note)

    return let(F.filter(split_lines(content), lambda line: ~is_blank(line)), of_lines)


# -- CSV and scripts ---------------------------------------------------------------------------------------------


def _csv(content: Column) -> Column:
    # A line break inside quotes belongs to the header: lines are added until the quotes are even.
    def add(head, line):
        more = F.concat(head["text"], line)
        quotes = F.length(more) - F.length(F.replace(more, F.lit('"')))
        return F.when(head["done"], head).otherwise(F.struct(more.alias("text"), (quotes % 2 == 0).alias("done")))

    lines = split_lines_keep_ends(F.substring(content, 1, 8192))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    head = F.when(F.size(lines) > 0, F.rtrim(F.aggregate(lines, start, add)["text"], F.lit("\r\n")))
    # Quoted header cells keep their commas; doubled quotes stand for one.  Every cell follows a comma, the first one too.
    cells = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), head), F.lit(',("(?:[^"]++|"")*+"|[^,]*)'), 1),
        lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    rows = F.length(content) - F.length(F.replace(content, F.lit("\n")))

    def text(names):
        more = F.when(F.size(names) > 30, F.concat(F.lit(" … (+"), (F.size(names) - 30).cast("string"), F.lit(" more)")))
        return F.concat(F.lit("CSV: "), F.size(names).cast("string"), F.lit(" columns, ~"), _grouped(rows),
                        F.lit(" rows\nColumns: "), F.array_join(F.slice(names, 1, 30), ", "), F.coalesce(more, F.lit("")))

    return F.when(head.isNotNull(), let(cells, text))


def _script(content: Column) -> Column:
    def names(pattern, group, limit):
        return F.slice(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), group)), 1, limit)

    listed = F.array_join(F.transform(names(JS_IMPORT, 0, 20), lambda line: F.concat(F.lit("  "), line)), "\n")
    named = F.array_join(F.array_distinct(F.concat(
        names(JS_FUNCTION, 1, 20), names(JS_CLASS, 1, 20), names(JS_ARROW, 1, 10))), ", ")
    return F.concat_ws("\n\n", F.lit(""), F.when(listed != "", F.concat(F.lit("Imports:\n"), listed)),
                       F.when(named != "", F.concat(F.lit("Exports/definitions: "), named)))


# -- Python ------------------------------------------------------------------------------------------------------


def _signature(node) -> str:
    if not isinstance(node, ast.ClassDef):
        return f"def {node.name}({ast.unparse(node.args)}): ..."
    inner = [f"  def {n.name}(...)" for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return f"class {node.name}({', '.join(map(ast.unparse, node.bases))}):\n" + ("\n".join(inner[:10]) or "  ...")


def _sections(source: str) -> str | None:
    try:
        return _outline(ast.parse(source).body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        # The last two are what the parser raises on very deep nesting.
        return None


def _outline(body) -> str:
    imports = dict.fromkeys(ast.unparse(n) for n in body if isinstance(n, (ast.Import, ast.ImportFrom)))
    named = {}
    for n in body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            named.setdefault(n.name, n)
    parts = [("Imports", list(imports)), ("Top-level definitions", [_signature(n) for n in named.values()])]
    return "".join(f"\n\n{title}:\n" + "\n".join(f"  {x}" for x in items[:30]) for title, items in parts if items)


@F.pandas_udf(StringType())
def python_outline(sources: pd.Series) -> pd.Series:
    """Imports and top-level definitions; NULL where the source does not parse.  The one branch that needs a parser."""
    return sources.map(lambda s: None if s is None else _sections(s))


# -- entry points ------------------------------------------------------------------------------------------------


def add_profiles(files: DataFrame, path: str = "path", content: str = "content", name: str = "profile",
                 min_chars: int = -1) -> DataFrame:
    """Adds the profile of each file longer than ``min_chars``; NULL if its kind has none or it does not parse.

    Only Python sources reach a Python worker; every other branch stays in the JVM.
    """
    text, kind = F.col(content), F.lower(suffix(path))
    large = F.length(text) > min_chars
    outlined = files.withColumn("_outline", python_outline(F.when(large & (kind == ".py"), text)))
    body = (
        F.when(kind == ".py", F.col("_outline"))
        .when(kind == ".json", describe_json(text, F.lit("")))
        .when(kind == ".jsonl", _jsonl(text))
        .when(kind == ".csv", _csv(text))
        .when(kind.isin(*JS_SUFFIXES), _script(text))
    )
    return outlined.withColumn(name, F.when(large, F.concat(_header(as_col(path), text), body))).drop("_outline")


def readable_content(files: DataFrame, path: str = "path", content: str = "content", name: str = "shown",
                     limit: int = K.READ_FILE_CHARS) -> DataFrame:
    """Text of raw files: a note for binary ones, a profile or a prefix for long ones.  ``content`` is binary."""
    size = F.octet_length(content)
    binary = F.contains(F.col(content), F.unhex(F.lit("00")))
    decoded = files.withColumn("_text", F.when(~binary, F.make_valid_utf8(F.col(content).cast("string"))))
    profiled = add_profiles(decoded, path, "_text", "_profile", min_chars=limit)
    cut = F.concat(F.substring("_text", 1, limit), F.lit("\n\n[truncated — file is "), _grouped(size),
                   F.lit(" bytes; showing first "), _grouped(F.lit(limit)), F.lit(" chars]"))
    shown = (
        F.when(binary, F.concat(F.lit("[binary file — "), _grouped(size), F.lit(" bytes, cannot display]")))
        .when(F.length("_text") > limit, F.coalesce("_profile", cut)).otherwise(F.col("_text"))
    )
    return profiled.withColumn(name, shown).drop("_text", "_profile")
