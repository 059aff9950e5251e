"""Call arguments as source text: their parts, their literals, the names in them, their shape."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that are no values, and parts of names that hint at an endpoint. Fixed values.
STOPWORDS = ("f", "rb", "br", "r", "b", "u", "True", "False", "None", "null", "undefined", "str", "int", "format", "join", "encode", "decode")
HINTS = ("url", "host", "endpoint", "service", "base", "addr", "uri", "target", "api")

#: Patterns of names and whole literals. Fixed values.
_NAME = r"[A-Za-z_$][\w$]*"
_WHOLE_STRING = r"""^[fFrRbBuU]{0,2}(['"])((?s:\\.|(?!\1)[^\\])*)\1$"""
_WHOLE_TEMPLATE = r"(?s)^`([^`]*)`$"
_PAIRS = {")": "(", "]": "[", "}": "{"}


def split_arguments(text: str | None) -> list[str]:
    """Parts of an argument list at commas outside brackets and quotes, trimmed. No text, no part; a trailing comma ends with an empty part."""
    if not text:
        return []
    parts, begin, open_, quote, skip = [], 0, [], "", False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            open_.append(c)
        elif c in _PAIRS:
            if open_ and open_[-1] == _PAIRS[c]:
                open_.pop()
        elif c == "," and not open_:
            parts.append(text[begin:i].strip())
            begin = i + 1
    last = text[begin:].strip()
    return [*parts, last] if last or parts else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_top_level(text: pd.Series) -> pd.Series:
    """split_arguments as a column; a bracket stack is beyond regular expressions."""
    return text.map(split_arguments)


@F.pandas_udf(T.StringType())
def first_argument(text: pd.Series) -> pd.Series:
    """The first part, '' if there is none."""
    return text.map(lambda x: next(iter(split_arguments(x)), ""))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_bare_identifier(c: Column) -> Column:
    return F.coalesce(stripped(c).rlike(f"^{_NAME}$"), F.lit(False))


def string_literal_value(c: Column) -> Column:
    """The body of an expression that is one string or template literal as a whole, else null."""
    x = stripped(c)
    return F.when(x.rlike(_WHOLE_STRING), F.regexp_extract(x, _WHOLE_STRING, 2)).when(x.rlike(_WHOLE_TEMPLATE), F.regexp_extract(x, _WHOLE_TEMPLATE, 1))


def identifier_roots(c: Column, limit: int = 6) -> Column:
    """Names in an expression that may hold its value, at most `limit`: no stopwords, no called names; endpoint-like names first, then longer ones, then in order."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({_NAME}+(?:\.{_NAME}+)*+(?!\())"), 1))
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.filter(found, lambda x: ~F.array_contains(stop, x) & ~F.array_contains(stop, F.substring_index(x, ".", 1)))
    hint = lambda x: F.when(F.lower(x).rlike("|".join(HINTS)), 0).otherwise(1)
    ranked = F.array_sort(F.transform(kept, lambda x, i: F.struct(hint(x).alias("hint"), (-F.length(x)).alias("size"), i.alias("ord"), x.alias("name"))))
    return F.coalesce(F.slice(F.transform(ranked, lambda x: x["name"]), 1, limit), F.array().cast("array<string>"))


def classify(c: Column) -> Column:
    """One of graphlens.schema.SHAPES, the first that fits."""
    x = stripped(c)
    return (
        F.when(c.isNull() | (c == ""), "empty").when(x == "<expr>", "opaque_placeholder").when(string_literal_value(c).isNotNull(), "string_literal")
        .when(x.rlike(f"^{_NAME}$"), "bare_identifier").when(x.rlike(r"^self\.\w+$"), "self_attribute").when(x.rlike(rf"^{_NAME}(?:\.{_NAME})+$"), "dotted_name")
        .when(x.contains("+") | x.contains("%") | x.contains(".format("), "concatenation").when(x.rlike("^[fF]['\"]"), "fstring").when(x.startswith("`"), "template_literal")
        .when(x.contains("("), "call_expression").otherwise("other_expression")
    )


def tail_name(c: Column) -> Column:
    """What is behind the last dot."""
    return F.substring_index(c, ".", -1)


def head_name(c: Column) -> Column:
    """What is before the first dot."""
    return F.substring_index(c, ".", 1)


def enclosing_class(caller: Column) -> Column:
    """The class of a caller path::Class.method, null for functions and modules."""
    return F.nullif(F.regexp_extract(F.substring_index(caller, "::", -1), r"^(.+)\.[^.]+$", 1), F.lit(""))
