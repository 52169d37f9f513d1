"""Repositories through the git program: listings on the driver, contents in the tasks."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import paths
from lectern.session import with_fields


def git(repo: str, *args: str) -> str:
    run = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace")
    if run.returncode:
        raise OSError(run.stderr.strip() or f"git {args[0]} failed")
    return run.stdout


def is_repo(path: str) -> bool:
    try:
        return bool(git(path, "rev-parse", "--git-dir"))
    except OSError:
        return False


def discover(root: str) -> list[str]:
    """Repositories at or below the root; below a repository none is looked for."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    if is_repo(root):
        return [root]
    found: list[str] = []
    for here, folders, _ in os.walk(root):
        if ".git" in folders:
            found.append(here)
            folders[:] = []
        else:
            folders[:] = sorted(f for f in folders if not f.startswith("."))
    return found


def resolve(roots: list[str]) -> list[str]:
    return list(dict.fromkeys(os.path.abspath(r) for root in roots for r in discover(os.path.expanduser(root))))


def head(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").strip()


def tracked(spark: SparkSession, repo: str) -> DataFrame:
    """(path) of tracked files that are code and not excluded."""
    names = [(p,) for p in git(repo, "ls-files", "-z").split("\0") if p]
    return spark.createDataFrame(names, "path string").where(paths.is_indexable_code(F.col("path")))


def changed_since(repo: str, mark: str | None) -> list[str] | None:
    """Names changed since the mark; None if everything must be read, as without or with a vanished mark."""
    if not mark:
        return None
    try:
        git(repo, "cat-file", "-t", mark)
    except OSError:
        return None
    return [p for p in git(repo, "diff", "--name-only", "-z", mark, "HEAD").split("\0") if p]


def read_files(files: DataFrame, repo: str) -> DataFrame:
    """``files`` (path) with language, hash and text, read where the tasks run."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame["path"]:
                try:
                    with open(os.path.join(repo, p), "rb") as f:
                        out.append((p, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["path", "content"])

    rows = files.select("path").mapInPandas(read, "path string, content binary")
    return rows.select("path", paths.code_language(F.col("path")).alias("language"), F.sha2("content", 256).alias("file_hash"), F.decode("content", "UTF-8").alias("text"))


def commits(spark: SparkSession, repo: str, since: str | None = None, months: int = 12) -> DataFrame:
    """(sha, author_name, author_email, author_date, subject), oldest first, merges left out."""
    span = [f"{since}..HEAD"] if since and changed_since(repo, since) is not None else [f"--since={months} months ago"]
    out = git(repo, "log", "--no-merges", "--reverse", "--pretty=format:%H%x00%an%x00%ae%x00%aI%x00%s", *span)
    rows = [tuple(line.split("\0")) for line in out.split("\n") if line.count("\0") == 4]
    return spark.createDataFrame(rows, "sha string, author_name string, author_email string, author_date string, subject string")


def not_blacklisted(rows: DataFrame, starts: list[str]) -> DataFrame:
    hit = F.lit(False)
    for s in starts:
        hit = hit | F.col("subject").startswith(s)
    return rows.where(~hit)


def file_changes(rows: DataFrame, repo: str) -> DataFrame:
    """One row per text file of each commit with its counts and diff; git runs twice a commit, in the tasks."""
    schema = with_fields(rows.schema, path=T.StringType(), additions=T.IntegerType(), deletions=T.IntegerType(), diff=T.StringType())

    def show(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                counts = [line.split("\t", 2) for line in git(repo, "show", "--numstat", "--format=", r.sha).split("\n") if line.count("\t") >= 2]
                top, *parts = re.split(r"(?m)^(?=diff --git )", git(repo, "show", r.sha))
                for k, (plus, minus, path) in enumerate(counts):
                    if plus != "-":
                        # one diff a file in the order of the counts, as a rule
                        diff = top + parts[k].rstrip("\n") + "\n" if len(parts) == len(counts) else git(repo, "show", r.sha, "--", path)
                        out.append((*r, path, int(plus), int(minus), diff))
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(show, schema)
