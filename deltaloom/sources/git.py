"""A repository as a source: snapshots, commits, the working tree's sources and refs, read by the git binary."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.inbox import BASES

#: Extensions of the files that have a parser.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs")


class GitError(RuntimeError):
    """git could not do what was asked; names the repository or the ref."""


def git(path: str, *args: str) -> bytes:
    run = subprocess.run(["git", "-C", path, *args], capture_output=True)
    if run.returncode:
        raise GitError(f"git {' '.join(args)} in {path}: {run.stderr.decode(errors='replace').strip()}")
    return run.stdout


def discover(path: str = ".") -> str:
    """The top folder of the repository that path is in."""
    return git(path, "rev-parse", "--show-toplevel").decode().strip()


def resolve(path: str, ref: str) -> str:
    try:
        return git(path, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip()
    except GitError as e:
        raise GitError(f"ref not found: {ref}") from e


def current_branch(path: str) -> str:
    return git(path, "symbolic-ref", "--short", "HEAD").decode().strip()


def is_clean(path: str) -> bool:
    """No staged, changed or untracked file."""
    return not git(path, "status", "--porcelain", "--untracked-files=normal").strip()


def detect_base(path: str) -> str:
    """The first of the usual base branches that exists."""
    for name in BASES:
        try:
            resolve(path, name)
            return name
        except GitError:
            continue
    raise GitError("no base branch found")


class _Slice(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = options.get("table", "snapshot")
        self.slices = int(options.get("slices", "8"))
        self.since = options.get("since", "")
        self.ref = options.get("ref", "HEAD")
        self.commit = resolve(self.path, self.ref)

    def partitions(self) -> list[InputPartition]:
        if self.kind == "snapshot":
            names = [x for x in git(self.path, "ls-tree", "-r", "-z", "--name-only", self.commit).decode(errors="replace").split("\0") if x]
        elif self.kind == "commits":
            # newest first; the walk ends at the first commit before since
            names = []
            for row in git(self.path, "log", "--date-order", "--format=%H %ct", self.commit).decode().split("\n"):
                if row and self.since and int(row.split()[1]) < float(self.since):
                    break
                names += [row.split()[0]] if row else []
        else:
            listed = git(self.path, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode(errors="replace").split("\0")
            names = [x for x in listed if x.rpartition(".")[2] in SOURCE_EXTENSIONS and not any(p.startswith(".") for p in x.split("/"))]
        n = max(1, -(-len(names) // self.slices))
        return [_Slice(names[i : i + n]) for i in range(0, len(names), n)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for name in partition.names:
            if self.kind == "snapshot":
                yield self.ref, name, git(self.path, "show", f"{self.commit}:{name}").decode("utf-8", "replace")
            elif self.kind == "commits":
                author, when = git(self.path, "show", "-s", "--format=%an%x00%ct", name).decode(errors="replace").strip().split("\0")
                for path in git(self.path, "diff-tree", "-r", "-z", "--root", "-m", "--first-parent", "--no-commit-id", "--name-only", name).decode(errors="replace").split("\0"):
                    if path.strip():
                        yield name, int(when), author or "unknown", path.strip("\n")
            elif os.path.isfile(full := os.path.join(self.path, name)):
                with open(full, encoding="utf-8") as f:  # a file in another encoding fails the scan
                    yield name, f.read()


class GitSource(DataSource):
    """spark.read.format("git").options(path=..., table="snapshot" | "commits" | "worktree", ref=..., since=...)."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return {"snapshot": "ref string, path string, content string", "commits": "sha string, epoch long, author string, path string", "worktree": "path string, content string"}[self.options.get("table", "snapshot")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def snapshot(spark: SparkSession, path: str, ref: str) -> DataFrame:
    register(spark)
    return spark.read.format("git").options(table="snapshot", ref=ref).load(path)


def commits(spark: SparkSession, path: str, since: float | None = None) -> DataFrame:
    """A row for each file of each commit, newest commits first up to the first one before since (epoch seconds)."""
    register(spark)
    from pyspark.sql import functions as F

    found = spark.read.format("git").options(table="commits", since="" if since is None else str(since)).load(path)
    return found.select("sha", F.timestamp_seconds("epoch").alias("ts"), "author", "path")


def worktree(spark: SparkSession, path: str) -> DataFrame:
    """Source files of the working tree, without ignored and hidden ones."""
    register(spark)
    return spark.read.format("git").options(table="worktree").load(path)
