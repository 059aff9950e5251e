"""Names as tokens in texts, against a regular expression for each pair."""

import re

from pyspark.sql import functions as F

from graphlens.operators import joins
from graphlens.sources.configs import token_boundary

NAMES = ["api.example.com", "example.com", "db", "cache-1", "a.b:80", "::1", "fe80::2", "x_y", "münchen.example", "::", "*.wild.example", "com", "a..b", "é.x"]
TEXTS = [
    "see http://api.example.com/x and API.Example.Com.", "notapi.example.com", "example.com-old example.community", "host=db;port", "my-db db_1 .db db.", "cache-1.internal", "cache-10", "at a.b:80 now", "a.b:8080", "[::1]:9 fe80::2",
    "x_y", "x_yz", "http://münchen.example/", "*.wild.example", "www.wild.example", "a..b", "é.x", "Kexample.com", "", None, "." * 500, "example.com\nexample.com", "DB", "::",
]


def test_against_every_pair(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "host string")
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, value string").repartition(3)
    found = joins.token_hits(names, "host", texts, "value", token_boundary(F.col("host")))
    got = sorted((r.host, r.id) for r in found.collect())
    token = lambda n, t: re.search(rf"(?<![\w.\-]){re.escape(n)}(?![\w\-])", t, re.ASCII | re.IGNORECASE)
    want = sorted((n, i) for n in NAMES if re.search(r"\w", n, re.ASCII) for i, t in enumerate(TEXTS) if t is not None and n in t.lower() and token(n, t))
    assert got == want and len(got) > 12
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert joins.token_hits(names.limit(0), "host", texts, "value", token_boundary(F.col("host"))).count() == 0
