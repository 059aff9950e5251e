"""Repositories as tables: a data source over a folder, discovery rules, and URLs of repositories."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphlens.functions.text import MAX_OTHER_BYTES, MAX_SOURCE_BYTES, PARSED, SKIP_DIRS, in_vendored_dir, is_config, language_of, looks_minified

#: Hosts whose repositories are taken; a fixed value.
HOSTS = ("github.com",)
#: Files of one repository that are parsed; more are listed as gaps.
MAX_FILES = 400

RAW = "path string, size_bytes long, text string, error string"


def normalize_repo_url(url: str | None, strict: bool = True) -> str:
    """https://github.com/owner/repo.git for owner/repo, git@ and https spellings. Strict rejects other schemes and hosts, users, odd ports, control characters and dot parts; a blank url is an error always."""
    text = (url or "").strip()
    if not text:
        raise ValueError("a repository URL is needed")
    if strict and re.search(r"[\x00-\x20\x7f\\]", text):
        raise ValueError("the URL has blanks, control characters or backslashes")
    if m := re.fullmatch(r"git@([^:/]+):(.+)", text):
        text = f"https://{m[1]}/{m[2]}"
    elif re.fullmatch(r"[\w.-]+/[\w.-]+", text):
        text = f"https://{HOSTS[0]}/{text}"
    if strict:
        parts = urlsplit(text)
        names = parts.path.strip("/").split("/")
        if parts.scheme != "https" or (parts.hostname or "").lower() not in HOSTS:
            raise ValueError("only https URLs of known hosts are taken")
        if parts.username is not None or parts.password is not None or parts.port not in (None, 443) or parts.query or parts.fragment:
            raise ValueError("the URL has a user, a port, a query or a fragment")
        if len(names) != 2 or any(n in (".", "..", "", ".git") for n in names):
            raise ValueError("the URL is not that of one repository")
        text = f"https://{parts.hostname.lower()}/{'/'.join(names)}"
    text = text.rstrip("/")
    return text if text.endswith(".git") else f"{text}.git"


class _Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class RepositoryReader(DataSourceReader):
    """Every file below root, whatever its name (names that begin with a dot or an underscore too). Links that lead outside root are left out. The walk lists names on the driver; tasks read the bytes."""

    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = os.path.realpath(root), per_task

    def partitions(self) -> list[InputPartition]:
        names = []
        for folder, dirs, files in os.walk(self.root):
            dirs[:] = sorted(x for x in dirs if x != ".git" and not os.path.islink(os.path.join(folder, x)))
            names += (os.path.relpath(os.path.join(folder, x), self.root) for x in files)
        names.sort()
        return [_Part(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        for name in part.names:
            at = os.path.realpath(os.path.join(self.root, name))
            if os.path.commonpath([at, self.root]) != self.root:
                continue
            try:
                size = os.path.getsize(at)
            except OSError as e:
                yield name, 0, None, f"stat_error: {e.strerror}"
                continue
            if size > MAX_SOURCE_BYTES:
                yield name, size, None, None
                continue
            try:
                with open(at, "rb") as f:
                    yield name, size, f.read().decode("utf-8", errors="ignore"), None
            except OSError as e:
                yield name, size, None, f"read_error: {e.strerror}"


class RepositorySource(DataSource):
    """spark.read.format("repository").option("filesPerTask", n).load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options["path"], int(self.options.get("filesPerTask", "200")))


def read_repository(spark: SparkSession, root: str, files_per_task: int = 200) -> DataFrame:
    """RAW rows of a folder."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("filesPerTask", str(files_per_task)).load(root)


def classified(raw: DataFrame, max_source: int = MAX_SOURCE_BYTES, max_other: int = MAX_OTHER_BYTES) -> DataFrame:
    """RAW rows outside vendored folders as graphlens.schema.FILES: language, kind, and why a file is not parsed."""
    path, text = F.col("path"), F.col("text")
    config = is_config(path)
    language = F.when(config, "config").otherwise(language_of(path))
    limit = F.when(language.isin(*PARSED), max_source).otherwise(max_other)
    failed = F.substring_index("error", ":", 1)
    reason = F.when(F.col("error").isNotNull(), failed).when(F.col("size_bytes") > limit, "too_large").when(text.isNull(), "read_error").when(~config & language.isin(*PARSED) & looks_minified(text), "minified")
    detail = F.when(F.col("error").isNotNull(), F.col("error")).when(reason == "too_large", F.concat(F.col("size_bytes").cast("string"), F.lit(" > "), limit.cast("string"), F.lit(" bytes")))
    made = raw.where(~in_vendored_dir(path)).select("path", language.alias("language"), config.alias("is_config"), "text", "size_bytes", reason.alias("skip_reason"), detail.alias("skip_detail"))
    return made.select("path", "language", "is_config", F.when(F.col("skip_reason").isNull(), text).alias("text"), "size_bytes", F.col("skip_reason").isNotNull().alias("skipped"), "skip_reason", "skip_detail")


def discover(raw: DataFrame, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(files, gaps): classified files, the first max_files of them by path taken, the rest counted with ten samples; vendored folders and skipped files are gaps too."""
    from graphlens.operators.gaps import gap

    files = classified(raw)
    kept = files.orderBy("path").limit(max_files)
    beyond = files.select("path").join(kept.select("path"), "path", "left_anti")
    samples = beyond.orderBy("path").limit(10).agg(F.array_sort(F.collect_list("path")).alias("samples"))
    over = beyond.agg(F.count("*").alias("count")).where(F.col("count") > 0).crossJoin(samples)  # one row each
    parts = F.split("path", "/")
    vendored = raw.where(in_vendored_dir(F.col("path"))).withColumn("dir", F.element_at(F.filter(parts, lambda x: x.isin(*SKIP_DIRS)), 1)).groupBy("dir").agg(F.count("*").alias("count"))
    gaps = gap(vendored, "discover", "repo", "vendored_dir", detail=F.col("dir"), impact="files of others are not analysed", count=F.col("count"))
    gaps = gaps.unionByName(gap(over, "discover", "repo", "file_cap", detail=F.lit(f"more than {max_files} files"), impact="these files are missing from the graph", count=F.col("count"), samples=F.col("samples")))
    skipped = kept.where("skipped")
    gaps = gaps.unionByName(gap(skipped, "discover", "file", F.col("skip_reason"), path=F.col("path"), detail=F.col("skip_detail"), impact="the file's definitions and calls are missing"))
    return kept, gaps


def split_kinds(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, configuration) among files."""
    return files.where(~F.col("is_config") & ~F.col("language").isin("other", "unknown")), files.where("is_config")

