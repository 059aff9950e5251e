"""Clones into a workspace: a driver's task, with git kept from prompts, hooks, other protocols and configuration."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
from collections.abc import Callable
from dataclasses import asdict, dataclass

from graphlens.operators.gaps import write_atomic
from graphlens.sources.repository import normalize_repo_url

#: Seconds that git may take and bytes that a repository may have; fixed values.
SECONDS, MAX_BYTES = 120, 500_000_000

Git = Callable[[list[str]], str]


@dataclass(frozen=True)
class Handle:
    """A clone in a workspace."""

    root: str
    url: str
    commit_sha: str
    branch: str
    job_id: str

    def save(self, path: str) -> None:
        write_atomic(path, json.dumps(asdict(self), indent=2, sort_keys=True) + "\n")

    @classmethod
    def load(cls, path: str) -> Handle:
        """A saved handle; anything else is an error."""
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
        if not isinstance(value, dict) or set(value) != set(cls.__dataclass_fields__) or not all(isinstance(v, str) for v in value.values()):
            raise ValueError("not a saved clone")
        return cls(**value)


def run_git(args: list[str]) -> str:
    """git's output, with an environment of its own."""
    env = {"PATH": os.environ.get("PATH", ""), "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_ALLOW_PROTOCOL": "https", "GIT_LFS_SKIP_SMUDGE": "1", "HOME": os.devnull}
    done = subprocess.run(["git", "-c", "core.hooksPath=/dev/null", "-c", "core.symlinks=false", *args], env=env, capture_output=True, text=True, timeout=SECONDS, check=False)
    if done.returncode:
        raise RuntimeError((done.stderr.strip().splitlines() or ["git failed"])[-1][:300])
    return done.stdout.strip()


def _bytes(root: str) -> int:
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, files in os.walk(root) for f in files)


def clone(url: str, workspace: str, job_id: str, git: Git = run_git, most: int = MAX_BYTES) -> Handle:
    """A shallow clone of one branch in workspace/job_id, with its handle beside it; whatever fails leaves nothing behind."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", job_id):
        raise ValueError("a job id has letters, digits, - and _")
    url, base = normalize_repo_url(url), os.path.realpath(workspace)
    root = os.path.join(base, job_id)
    if os.path.exists(root):
        raise FileExistsError(root)
    os.makedirs(base, exist_ok=True)
    try:
        git(["clone", "--depth", "1", "--single-branch", "--no-tags", "--", url, root])
        if (size := _bytes(root)) > most:
            raise ValueError(f"the repository has {size} bytes, more than {most}")
        made = Handle(root, url, git(["-C", root, "rev-parse", "HEAD"]), git(["-C", root, "rev-parse", "--abbrev-ref", "HEAD"]), job_id)
        made.save(f"{root}.json")
        return made
    except BaseException:
        shutil.rmtree(root, ignore_errors=True)
        raise


def remove(handle: Handle, workspace: str) -> None:
    """Delete a clone of this workspace and its handle."""
    base = os.path.realpath(workspace)
    if os.path.commonpath([os.path.realpath(handle.root), base]) != base or os.path.realpath(handle.root) == base:
        raise ValueError("the clone is outside the workspace")
    shutil.rmtree(handle.root, ignore_errors=True)
    if os.path.exists(f"{handle.root}.json"):
        os.unlink(f"{handle.root}.json")
