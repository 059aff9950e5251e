"""Hosts in URLs, configuration values and literals, made comparable."""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose value is a host even without a dot. Fixed values.
HOST_KEYS = ("host", "hostname", "server", "endpoint", "url", "uri", "addr", "address", "domain", "upstream", "target", "backend", "broker", "bootstrap_servers")
#: What stands for an interpolated part of a literal.
HOLE = "\0"

#: Patterns of URLs, host names, host keys, destinations and environment lookups. Fixed values.
_URL = r"\b[A-Za-z][A-Za-z0-9+.\-]*://[^\s\"'`,;<>()\[\]{}]+"
_DOTTED = r"^(?=.{1,253}$)(?:[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\.)+[A-Za-z][A-Za-z0-9-]{0,61}$"
_IPV4 = r"^(?:\d{1,3}\.){3}\d{1,3}$"
_LABEL = r"^[A-Za-z][A-Za-z0-9_-]{2,62}$"
_HOST_KEY = rf"(?i)(?:^|[._-])(?:{'|'.join(HOST_KEYS)})s?$"
_PLAUSIBLE = r"^(?:[a-zA-Z][\w+.-]*://.+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+.*|[A-Za-z0-9-]+:\d{2,5}(?:/.*)?|(?:localhost|127\.0\.0\.1)(?::\d+)?.*)$"
_ENV = (
    r"""(?:os\.environ\.get|os\.getenv|System\.getenv|os\.Getenv|getenv|Environment\.GetEnvironmentVariable)\s*\(\s*['"]([\w.-]+)['"]""",
    r"""os\.environ\s*\[\s*['"]([\w.-]+)['"]\s*\]""",
    r"""process\.env\.([A-Za-z_]\w*)""",
    r"""process\.env\s*\[\s*['"]([\w.-]+)['"]\s*\]""",
    r"""ENV\s*\[\s*['"]([\w.-]+)['"]\s*\]""",
)


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def url_authority(c: Column) -> Column:
    """What a URL has between :// and its path, query or fragment (user and port included); null without ://. Odd input never raises."""
    return _or_null(F.regexp_extract(c, r"://([^/?#]*)", 1))


def normalize_host(c: Column) -> Column:
    """A host without scheme, user, port, brackets, last dots and capitals; null where none is usable: empty, with blanks, a slash, or a placeholder."""
    # Each step uses the one before it once: expressions that used it twice would double with every step.
    steps = (
        (r"^\s+|\s+$", ""), (r"^[\"']+|[\"']+$", ""), (r"^\s+|\s+$", ""), (r"(?s)^[^:/?#]*://([^/?#]*).*$", "$1"), (r"(?s)^.*@", ""),
        (r"(?s)^\[([^\]]*)\].*$", "$1"), (r"^([^:]*):[^:]*$", "$1"), (r"^\s+|\s+$", ""), (r"\.+$", ""),
    )
    t = F.lower(reduce(lambda x, step: F.regexp_replace(x, *step), steps, c))
    return F.when((t != "") & ~t.rlike(r"[\s/\x00{}$<>%]"), t)


def hosts_in_value(value: Column, key_path: Column) -> Column:
    """array<string> of all hosts that one configuration value declares: those of its URLs, and the value itself if it is a dotted host, an IPv4 address, localhost, or a single label under a key that names a host. Longer values than 2048 characters declare none."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    urls = F.transform(F.regexp_extract_all(v, F.lit(f"({_URL})"), 1), normalize_host)
    own = normalize_host(v)
    leaf = F.substring_index(key_path, ".", -1)
    single = F.when(own.rlike(_DOTTED) | own.rlike(_IPV4) | (own == "localhost") | (own.rlike(_LABEL) & leaf.rlike(_HOST_KEY)), own)
    found = F.array_distinct(F.array_compact(F.concat(urls, F.array(single))))
    return F.when((v != "") & (F.length(v) <= 2048), found).otherwise(F.array().cast("array<string>"))


def service_dns_names(name: Column, namespace: Column) -> Column:
    """The names under which a declared service answers."""
    n, ns = F.lower(name), F.lower(F.coalesce(_or_null(namespace), F.lit("default")))
    return F.array(n, F.concat_ws(".", n, ns), F.concat_ws(".", n, ns, F.lit("svc")), F.concat_ws(".", n, ns, F.lit("svc.cluster.local")))


def is_plausible_host(c: Column) -> Column:
    """A literal that may be a network destination."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.coalesce((F.length(t) >= 4) & ~t.contains(" ") & t.rlike(_PLAUSIBLE), F.lit(False))


def literal_text(c: Column) -> Column:
    """A literal node's source text without prefix and quotes; null if it is no string."""
    t = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^(?i:rb|br|fr|rf|f|r|b|u)(?=[\"'])", "")
    return F.when(t.rlike(r"""(?s)^(["'`]).*\1$""") & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2))


def env_key(c: Column) -> Column:
    """The variable of an environment lookup in any of its spellings, null without one."""
    return F.coalesce(*(_or_null(F.regexp_extract(c, p, 1)) for p in _ENV))


def masked_static(argument: str, body: str) -> str:
    """A literal's body with a HOLE for each interpolation: read from the syntax tree of a Python f-string, else by brace depth."""
    try:
        node = ast.parse(argument, mode="eval").body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        node = None
    if isinstance(node, ast.JoinedStr):
        return "".join(str(v.value) if isinstance(v, ast.Constant) else HOLE for v in node.values)
    out, depth, i = [], 0, 0
    while i < len(body):
        if depth:
            depth += {"{": 1, "}": -1}.get(body[i], 0)
        elif body[i] == "{" or body.startswith("${", i):
            i += body[i] == "$"
            depth = 1
            out.append(HOLE)
        else:
            out.append(body[i])
        i += 1
    return "".join(out)


def authority(text: str) -> str | None:
    """url_authority of one string."""
    if "://" not in text:
        return None
    rest = text.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return rest[:cut] or None


@F.pandas_udf(T.StructType([T.StructField("host", T.StringType()), T.StructField("reason", T.StringType())]))
def static_host(argument: pd.Series, body: pd.Series) -> pd.DataFrame:
    """The host of a literal if no interpolation touches it, else why there is none. Null bodies have neither."""
    rows = []
    for a, b in zip(argument, body, strict=True):
        if b is None:
            rows.append((None, None))
            continue
        masked = masked_static(a or "", b)
        host = authority(masked if HOLE in masked else b)
        if HOLE not in masked:
            rows.append((host, None))
        elif host and HOLE not in host:
            rows.append((host, None))
        else:
            rows.append((None, "host_is_interpolated" if host else "no_static_host_in_interpolated_literal"))
    return pd.DataFrame(rows, columns=["host", "reason"], dtype=object)
