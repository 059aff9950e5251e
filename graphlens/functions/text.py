"""Files, lines and reports as text."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders whose files are others' code; extensions and names of configuration and of languages. Fixed values.
SKIP_DIRS = (".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", "venv", ".mypy_cache", ".next", "coverage")
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "rb": "ruby", "java": "java", "cs": "csharp", "php": "php"}
PARSED = ("python", "javascript", "typescript")
CONFIG_EXTENSIONS = ("yml", "yaml", "json", "env", "toml", "ini", "properties")
CONFIG_HINTS = ("docker-compose", "k8s", "deployment", "service", "configmap", "kustomiz", "helm")
#: Limits in bytes, and the shape of minified code: at least so long, with longer lines than that. Fixed values.
MAX_SOURCE_BYTES, MAX_OTHER_BYTES = 2_000_000, 400_000
MINIFIED_BYTES, MINIFIED_LINE = 50_000, 300


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension(path: Column) -> Column:
    """The lower-case extension; a name's first dot doesn't begin one."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    """The language by extension, else 'other'."""
    ext = extension(path)
    return reduce(lambda c, kv: c.when(ext == kv[0], kv[1]), LANGUAGES.items(), F.when(F.lit(False), "")).otherwise("other")


def is_config(path: Column) -> Column:
    """Configuration by extension or name; source by extension never is; hints in the path decide for the rest."""
    name, ext = file_name(path), extension(path)
    source = [e for e, lang in LANGUAGES.items() if lang in PARSED]
    return F.when(ext.isin(*CONFIG_EXTENSIONS) | (name == "dockerfile") | (name == ".env") | name.startswith(".env."), True).when(ext.isin(*source), False).otherwise(F.lower(path).rlike("|".join(CONFIG_HINTS)))


def config_format(path: Column) -> Column:
    """The reader for a configuration file, null if there is none."""
    name, ext = file_name(path), extension(path)
    return (
        F.when(ext.isin("yml", "yaml"), "yaml").when(ext == "json", "json").when(ext == "toml", "toml").when((ext == "env") | (name == ".env") | name.startswith(".env."), "env")
        .when(ext.isin("ini", "properties", "cfg", "conf"), "ini").when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile")
    )


def in_vendored_dir(path: Column) -> Column:
    """A folder of the path is one of others' code."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, SKIP_DIRS)))


def line_count(text: Column) -> Column:
    """Line feeds and one; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)


def looks_minified(text: Column) -> Column:
    """Long, with very long lines on average."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return (F.length(text) >= MINIFIED_BYTES) & (F.length(text) / lines > MINIFIED_LINE)


def parent_of(qualified_name: Column) -> Column:
    """Without the last part behind ::, null if there is one part."""
    return F.when(qualified_name.contains("::"), F.regexp_replace(qualified_name, "(?s)::((?!::).)*$", ""))


def context_window(lines: Column, line: Column, before: int = 12, after: int = 4) -> Column:
    """Numbered lines around a line."""
    first = F.greatest(line - before, F.lit(1))
    part = F.slice(lines, first, F.least(line + after, F.size(lines)) - first + 1)
    return F.array_join(F.transform(part, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def append_note(notes: Column, note: Column) -> Column:
    """notes | note, without saying it twice."""
    return F.when(F.coalesce(notes, F.lit("")) == "", note).when(note.isNull() | notes.contains(note), notes).otherwise(F.concat_ws(" | ", notes, note))


def shorten(c: Column, most: int) -> Column:
    """At most so many characters, the last three being dots where some are left out."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def json_object(text: str | None) -> str | None:
    """The first balanced {...} of a text that is a JSON object; braces inside strings don't count."""
    text = text or ""
    at = text.find("{")
    while at >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            else:
                depth += {"{": 1, "}": -1}.get(c, 0)
                if not depth:
                    try:
                        if isinstance(json.loads(text[at : i + 1]), dict):
                            return text[at : i + 1]
                    except ValueError:
                        pass
                    break
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    return text.map(json_object)
