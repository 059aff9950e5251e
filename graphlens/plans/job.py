"""The job around a plan: stages with a state each, a status file that is replaced whole, timings, and the result of its branches."""

from __future__ import annotations

import json
import logging
import threading
import time
import traceback
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from datetime import UTC, datetime

from graphlens.operators.gaps import write_atomic

#: The stage that runs here, for log records.
STAGE: ContextVar[str | None] = ContextVar("stage", default=None)
STATES = ("pending", "running", "ok", "failed", "skipped")


@dataclass
class Job:
    """States and seconds of a job's stages. The status file is rewritten at each change; that it can't be written stops nothing."""

    job_id: str
    status_path: str | None = None
    stages: dict[str, dict] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def set(self, name: str, state: str, **more) -> None:
        if state not in STATES:
            raise ValueError(f"no such state: {state}")
        with self._lock:
            self.stages.setdefault(name, {}).update(state=state, at=datetime.now(UTC).isoformat(timespec="seconds"), **more)
            text = json.dumps({"job_id": self.job_id, "stages": self.stages}, indent=2, sort_keys=True)
            if self.status_path:
                try:
                    write_atomic(self.status_path, text + "\n")
                except OSError:
                    pass

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Time a stage and note how it ended; an error goes on."""
        began, token = time.time(), STAGE.set(name)
        self.set(name, "running")
        try:
            yield
        except Exception as e:
            self.set(name, "failed", seconds=round(time.time() - began, 3), error=f"{type(e).__name__}: {e}"[:300])
            raise
        finally:
            STAGE.reset(token)
        self.set(name, "ok", seconds=round(time.time() - began, 3))

    def slowest(self, n: int = 3) -> list[tuple[str, float]]:
        done = [(k, s["seconds"]) for k, s in self.stages.items() if "seconds" in s]
        return sorted(done, key=lambda x: (-x[1], x[0]))[:n]


def run_branches(job: Job, prepare: Callable[[], object], branches: dict[str, Callable[[object], object]]) -> dict:
    """prepare, then all branches at once: ok if all are, partial if some are, failed if none is or prepare isn't."""
    try:
        with job.stage("prepare"):
            base = prepare()
    except Exception as e:  # noqa: BLE001
        for name in branches:
            job.set(name, "skipped")
        return {"status": "failed", "error": f"{type(e).__name__}: {e}", "results": {}}

    def one(name: str) -> tuple[str, object, str | None]:
        try:
            with job.stage(name):
                return name, branches[name](base), None
        except Exception:  # noqa: BLE001  a branch's failure leaves the others
            return name, None, traceback.format_exc(limit=1)

    with ThreadPoolExecutor(max_workers=max(1, len(branches))) as pool:
        done = list(pool.map(one, branches))
    bad = [name for name, _, e in done if e]
    status = "ok" if not bad else "failed" if len(bad) == len(done) else "partial"
    return {"status": status, "error": "; ".join(bad) or None, "results": {name: value for name, value, e in done if not e}}


class JsonLines(logging.Formatter):
    """Log records as JSON lines with the run and stage they belong to; long fields are cut."""

    def __init__(self, run_id: str, most: int = 120):
        super().__init__()
        self.run_id, self.most = run_id, most

    def format(self, record: logging.LogRecord) -> str:
        more = {k: (v if isinstance(v, (int, float, bool)) or v is None else str(v)[: self.most]) for k, v in getattr(record, "fields", {}).items()}
        return json.dumps({"ts": datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds"), "level": record.levelname.lower(), "run": self.run_id, "stage": STAGE.get(), "message": record.getMessage()} | more, sort_keys=True)
