"""A git repository's first-parent history as a Spark data source.

Register with ``spark.dataSource.register(GitHistory)``, then
``spark.read.format("git_history").option("repo", path).load()``. Each row is a
changed path of a commit; a null content is a deletion. Commits are dealt out
in ranges, and each range reads its own changes and contents, through one git
process for all contents. The repository must lie at the same path for the driver and every executor,
and belong to the user that they run as.

Options: ``branch``; ``exclude``, shell patterns of paths to leave out besides the
usual ones, joined by commas; ``since``, an ISO time: the first commit at or
after it has every file of its tree; ``after``, a commit that an earlier run
stopped at: an error if the branch doesn't have it any more.
"""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.functions.scalars import RELEVANT

#: Commits of a partition.
RANGE = 64
#: Paths that aren't a project's own documented surface.
EXCLUDED = (
    "tests/*", "test/*", "*/tests/*", "*/test/*", "conftest.py", "*/conftest.py", "build/*", "dist/*", ".venv/*", "venv/*", "node_modules/*", "*/node_modules/*",
    ".git/*", "*/__pycache__/*", "docs/_build/*",
)


def _command(repo: str, *args: str) -> dict:
    """How to call git with no configuration but the repository's own, no hooks and no prompts."""
    quiet = {"GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C", "PATH": os.environ.get("PATH", "")}
    return {"args": ["git", "-c", "core.hooksPath=/dev/null", "-c", "core.fsmonitor=false", "-C", repo, *args], "env": quiet, "stdout": subprocess.PIPE}


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(**_command(repo, *args), check=True).stdout


class Commit(NamedTuple):
    seq: int
    sha: str
    at: datetime
    whole: bool


class Commits(InputPartition):
    def __init__(self, commits: list[Commit]):
        super().__init__(None)
        self.commits = commits


class Contents:
    """Blobs of a repository, asked for one after another through one process."""

    def __init__(self, repo: str):
        self.process = subprocess.Popen(**_command(repo, "cat-file", "--batch"), stdin=subprocess.PIPE)

    def read(self, blob: str) -> bytes:
        self.process.stdin.write(blob.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3:
            raise FileNotFoundError(f"object {blob}")
        return self.process.stdout.read(int(head[2]) + 1)[:-1]

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


def history(repo: str, branch: str, since: datetime | None = None, after: str | None = None) -> list[Commit]:
    """Commits of the branch, oldest first, each later than the one before it."""
    found, clock = [], datetime.min.replace(tzinfo=UTC)
    for seq, line in enumerate(git(repo, "log", "--first-parent", "--reverse", "--format=%H %ct", branch).decode().splitlines(), 1):
        sha, seconds = line.split()
        clock = max(datetime.fromtimestamp(int(seconds), UTC), clock + timedelta(microseconds=1))
        if since is None or clock >= since:
            found.append(Commit(seq, sha, clock, since is not None and not found))
    if after is None:
        return found
    for k, c in enumerate(found):
        if c.sha == after:
            return found[k + 1 :]
    raise ValueError(f"commit {after} isn't on the branch any more")


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.branch = options["repo"], options.get("branch", "HEAD")
        self.excluded = [*EXCLUDED, *(x for x in options.get("exclude", "").split(",") if x)]
        since = options.get("since")
        self.since = datetime.fromisoformat(since) if since else None
        if self.since and not self.since.tzinfo:
            self.since = self.since.replace(tzinfo=UTC)
        self.after = options.get("after")

    def partitions(self) -> list[Commits]:
        commits = history(self.repo, self.branch, self.since, self.after)
        return [Commits(commits[i : i + RANGE]) for i in range(0, len(commits), RANGE)]

    def _relevant(self, path: str) -> bool:
        return bool(re.search(RELEVANT, path)) and not any(fnmatch.fnmatchcase(path, x) for x in self.excluded)

    def _changes(self, commit: Commit) -> Iterator[tuple[str, str | None]]:
        """Paths with their blobs, null where deleted."""
        if commit.whole:
            for entry in git(self.repo, "ls-tree", "-r", "-z", commit.sha).decode("utf-8", "surrogateescape").split("\0")[:-1]:
                about, path = entry.split("\t", 1)
                yield path, about.split()[2]
            return
        listed = git(self.repo, "diff-tree", "-r", "-z", "--no-commit-id", "--no-renames", "--root", "-m", "--first-parent", commit.sha).decode("utf-8", "surrogateescape").split("\0")
        for about, path in zip(listed[::2], listed[1::2]):
            *_, blob, status = about.split()
            yield path, None if status == "D" else blob

    def read(self, partition: Commits) -> Iterator[tuple]:
        contents = Contents(self.repo)
        try:
            for commit in partition.commits:
                for path, blob in self._changes(commit):
                    if self._relevant(path):
                        yield commit.seq, commit.sha, commit.at, path, None if blob is None else contents.read(blob)
        finally:
            contents.close()


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "seq long, sha string, committed_at timestamp, path string, content binary"

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def repo_slug(url: str, folder: str) -> str:
    """``owner/name`` of a repository's address, or ``local/folder`` without one."""
    parts = [x for x in re.sub(r"\.git/?$", "", url or "").replace(":", "/").split("/") if x]
    return "/".join(parts[-2:]) if len(parts) >= 2 else f"local/{folder}"
