"""Folders listed in tasks: rounds over a frontier of folders, so that the driver holds no list of files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.sources.repository import RAW, RepositoryReader, _Part

ENTRIES = "path string, kind string, detail string"
#: Entries that a task lists before it leaves folders to the next round, folders of a task, files whose bytes a task reads.
BUDGET, FOLDERS, FILES = 20_000, 50, 200


def _walk(root: str, folders: list[str], budget: int) -> Iterator[tuple[str, str, str | None]]:
    """ENTRIES below the folders: files, folders that the next round has to list, folders that can't be listed. Each given folder is listed whole, those below while the budget lasts. Links to folders are not followed, .git is left out."""
    todo, seen = list(reversed(folders)), 0
    given = len(todo)
    while todo:
        folder = todo.pop()
        if seen >= budget and len(todo) >= given:
            yield folder, "folder", None
            continue
        given = min(given, len(todo))
        try:
            with os.scandir(os.path.join(root, folder)) as entries:
                for x in entries:
                    seen += 1
                    path = os.path.join(folder, x.name)
                    if x.is_dir(follow_symlinks=False):
                        if x.name != ".git":
                            todo.append(path)
                    elif not (x.is_symlink() and os.path.isdir(x.path)):
                        yield path, "file", None
        except OSError as e:
            yield folder, "failed", f"stat_error: {e.strerror}"


def list_folder(spark: SparkSession, root: str, out: str, budget: int = BUDGET, folders: int = FOLDERS) -> DataFrame:
    """ENTRIES (path, kind 'file' or 'failed', detail) of all that is below root, a folder that all machines see, written round by round below `out`, which they share.

    A round lists the folders that the round before left; within a task the walk goes down until its budget of entries is used up, so a small tree
    is one round and a deep one has about depth / budget of them. Names go from task to task through the written tables alone: the driver sees a
    count for each round. Paths are relative to root. Links to folders and .git are left out, as are folders named so that they aren't UTF-8.
    """
    root = os.path.realpath(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for row in _walk(root, pdf["path"].tolist(), budget):
                rows.append(row)
                if len(rows) == 10_000:
                    yield _encodable(pd.DataFrame(rows, columns=names))
                    rows = []
            yield _encodable(pd.DataFrame(rows, columns=names))

    frontier, n, made = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        path = os.path.join(out, f"round={len(made)}")
        frontier.select("path").repartition(-(-n // folders)).mapInPandas(run, ENTRIES).write.mode("overwrite").parquet(path)
        made.append(path)
        frontier = spark.read.schema(ENTRIES).parquet(path).where("kind = 'folder'")
        n = frontier.count()
    return spark.read.schema(ENTRIES).parquet(*made).where("kind <> 'folder'")


def _encodable(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows whose names are UTF-8."""
    return rows[[p.encode(errors="replace").decode() == p for p in rows["path"]]]


def read_files(entries: DataFrame, root: str, per_task: int = FILES) -> DataFrame:
    """RAW rows of listed files, read in tasks of about per_task files, which are dealt out by the hash of their paths; a folder that couldn't be listed is a row with an error. A file that is gone meanwhile, or a link that leads outside, is as in sources.repository."""
    reader = RepositoryReader(root, per_task)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RAW.split(", ")]
        for pdf in batches:
            rows, held = [], 0
            for path, kind, detail in zip(pdf["path"], pdf["kind"], pdf["detail"], strict=True):
                for row in [(path, 0, None, detail)] if kind == "failed" else reader.read(_Part([path])):
                    rows.append(row)
                    held += len(row[2] or "")
                if held > 16 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    tasks = -(-max(1, entries.count()) // per_task)
    return entries.repartition(tasks, F.xxhash64("path")).mapInPandas(run, RAW)
