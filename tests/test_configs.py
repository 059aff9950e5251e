"""Configuration readers: lines and directives with Spark's own functions, trees with one walker."""

from pyspark.sql import functions as F

from graphlens.sources import configs

FILES = {
    ".env": "# a comment\nexport API_HOST='api.example.com'\nPORT=80 # inline\n\nnot a pair\r\nURL: \"http://x.y/z\"\n",
    "app.ini": "top = 1\n[ db ]\nhost = db.internal\n; host = no\n[cache]\nhost: \"c.internal\"\n[x] y\n",
    "Dockerfile": "FROM python:3\nENV A=1 B=\"two words\" \\\n  # in between\n  C=c.d\nENV OLD style value\nARG ONLY\nRUN pip install x && \\\n\n    echo \"y=1\"\nLABEL a.b='c'\nunknown line\nCMD [\"x\"]\n",
    "a.yaml": "services:\n  web:\n    image: x\n    ports: [80, '81']\n---\nkind: Service\nmetadata: {name: api, namespace: prod}\n",
    "b.json": '{"a": {"b": ["one", 2, "two"]}, "c": "one", "": "x"}',
    "c.toml": 'a = "v"\n[t]\nb = ["w", 3]\n',
    "bad.json": '{"a": \n host: h.example.com, # why\n // no\n',
    "k8s/other.txt": "host = h.example.com\n# no\nfree text\n",
}


def rows(spark, what):
    files = spark.createDataFrame([(p, x, True, False) for p, x in FILES.items()], "path string, text string, is_config boolean, skipped boolean")
    out = {}
    for r in configs.config_rows(files).where(F.col("what") == what).orderBy("path", "ord").collect():
        out.setdefault(r.path, []).append(r)
    return out


def test_values(spark):
    got = {p: [(r.key_path, r.value, r.line) for r in x] for p, x in rows(spark, "value").items()}
    assert got == {
        ".env": [("API_HOST", "api.example.com", 2), ("PORT", "80", 3), ("URL", "http://x.y/z", 6)],
        "app.ini": [("top", "1", 1), ("db.host", "db.internal", 3), ("cache.host", "c.internal", 6)],
        "Dockerfile": [("FROM", "python:3", 1), ("ENV.A", "1", 2), ("ENV.B", "two words", 2), ("ENV.C", "c.d", 2), ("ENV.OLD", "style value", 5), ("ARG", "ONLY", 6), ("RUN", 'pip install x &&     echo "y=1"', 7), ("LABEL.a.b", "c", 10), ("CMD", '["x"]', 12)],
        "a.yaml": [("services.web.image", "x", 3), ("services.web.ports[0]", "80", 4), ("services.web.ports[1]", "81", 4), ("kind", "Service", 6), ("metadata.name", "api", 7), ("metadata.namespace", "prod", 7)],
        "b.json": [("a.b[0]", "one", 1), ("a.b[2]", "two", 1), ("c", "one", 1), ("", "x", 1)],
        "c.toml": [("a", "v", 1), ("t.b[0]", "w", 3)],
    }


def test_services_and_fallbacks(spark):
    assert {p: [(r.value, r.key_path, r.extra) for r in x] for p, x in rows(spark, "service").items()} == {"a.yaml": [("web", "docker-compose service", ""), ("api", "k8s Service metadata.name", "prod")]}
    fallback = {p: (x[0].value, x[0].extra.split(":")[0]) for p, x in rows(spark, "text_fallback").items()}
    assert fallback == {"bad.json": ("json", "json parse failed"), "k8s/other.txt": ("unknown", "no parser for this file type")}
    text = {p: [(r.key_path, r.value, r.line) for r in x] for p, x in rows(spark, "text").items()}
    assert text == {"bad.json": [("", '{"a":', 1), ("host", "h.example.com,", 2)], "k8s/other.txt": [("host", "h.example.com", 1), ("", "free text", 3)]}
    assert sorted(rows(spark, "parsed")) == sorted(set(FILES) - set(fallback))
