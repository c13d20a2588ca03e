"""Changes of a working tree, listed by git, as a DataFrame."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> list[str]:
    out = subprocess.run(["git", "-c", "core.quotepath=false", "-C", root, *args], capture_output=True, text=True, check=True).stdout
    return [x for x in out.split("\n") if x]


def changed_files(spark: SparkSession, root: str, base: str = "main") -> DataFrame:
    """(path) of files that differ from the base, are changed in the working tree, or are not tracked."""
    names = {*_git(root, "diff", "--name-only", f"{base}...HEAD"), *_git(root, "diff", "--name-only", "HEAD"), *_git(root, "ls-files", "--others", "--exclude-standard")}
    return spark.createDataFrame([(n,) for n in sorted(names)], "path string")


def head(root: str) -> str | None:
    """The commit of HEAD, read from the repository's files."""
    git = Path(root) / ".git"
    if git.is_file():
        git = (Path(root) / git.read_text().partition("gitdir:")[2].strip()).resolve()
    if not (git / "HEAD").exists():
        return None
    ref = (git / "HEAD").read_text().strip()
    if not ref.startswith("ref: "):
        return ref or None
    name = ref[5:]
    common = git / (git / "commondir").read_text().strip() if (git / "commondir").exists() else git
    for place in (git, common):
        if (place / name).exists():
            return (place / name).read_text().strip()
    packed = common / "packed-refs"
    lines = packed.read_text().splitlines() if packed.exists() else []
    return next((x.split()[0] for x in lines if x.endswith(f" {name}")), None)
