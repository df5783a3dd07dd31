"""Which files of a repository count: ignore rules, built-in folders and a glob list, as column expressions over paths.

Ignore rules are ordered; of those that match a path the last one decides, and a rule with `!` takes a path back. A rule holds
below the folder of its file. A path below an ignored folder is ignored whatever later rules say, so every ancestor
of a path is judged as a folder. The rule list is configuration: it is compiled into one expression, files stay in place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import glob_match
from cairn.operators.keys import first_by

# Folders that never count.
EXCLUDED_FOLDERS = [".git", ".dev-context", ".idea", "bin", "obj"]


@dataclass(frozen=True)
class Rule:
    """A compiled ignore rule: a Java pattern over whole paths, whether it holds for folders only, and whether it takes back."""

    regex: str
    folders_only: bool
    takes_back: bool


def compile_rule(line: str, folder: str = "") -> Rule | None:
    """A line of an ignore file that stands in `folder`; None for blank lines and comments."""
    text = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    takes_back = text.startswith("!")
    text = text[1:] if takes_back else text
    folders_only = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    text = text.removeprefix("/")
    kinds = {"**/": "(?:.*/)?", "/**": "/.*", "**": "[^/]*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.findall(r"\\.|\[[!^]?\]?[^\]/]*\]|/\*\*$|\*\*/|\*\*|\*|\?|[^\\*?\[/]+|.", text)

    def piece(p: str) -> str:
        if p in kinds:
            return kinds[p]
        if p.startswith("[") and len(p) > 2:
            inner = p[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            return f"[{'^/' + inner[1:] if inner[0] in '!^' else inner}]"
        return re.sub(r"([^\w/ -])", r"\\\1", p[1:] if p.startswith("\\") and len(p) > 1 else p)

    below = re.sub(r"([^\w/ -])", r"\\\1", folder.strip("/"))
    return Rule("^" + (below + "/" if below else "") + ("" if anchored else "(?:.*/)?") + "".join(map(piece, pieces)) + "$", folders_only, takes_back)


def is_ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether ordered rules leave a file's path out, by itself or by one of its folders."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")

    def out(n: Column) -> Column:
        node = F.array_join(F.slice(parts, F.lit(1), n), "/")
        decided = F.lit(False)
        for r in rules:
            hit = node.rlike(r.regex)
            decided = F.when(hit & (n < F.size(parts)) if r.folders_only else hit, not r.takes_back).otherwise(decided)
        return decided

    return F.exists(F.sequence(F.lit(1), F.size(parts)), out)


def inventory(files: DataFrame, rules: list[Rule], globs: list[str], tracked: DataFrame | None = None, folders: list[str] = EXCLUDED_FOLDERS) -> DataFrame:
    """The files (path, ...) that count, once for each path in any case of separators, by path.

    Files in tracked (path) are never ignored by rules, only by folders and globs, as a tracked file stays tracked. Absolute and
    empty paths do not count.
    """
    named = files.withColumn("path", F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")).where("path <> ''").where(~F.col("path").rlike("^(?:/|[A-Za-z]:)"))
    parts = F.split("path", "/")
    kept = named.where(~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(folders)) & ~glob_match(F.col("path"), globs))
    if tracked is None:
        kept = kept.where(~is_ignored(F.col("path"), rules))
    else:
        known = tracked.select(F.col("path").alias("path"), F.lit(True).alias("__tracked")).distinct()
        kept = kept.join(known, "path", "left").where(F.col("__tracked").isNotNull() | ~is_ignored(F.col("path"), rules)).drop("__tracked")
    rest = [c for c in kept.columns if c != "path"]
    return first_by(kept, ["path"], rest or ["path"])
