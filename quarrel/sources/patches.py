"""Unified diffs as rows, and what they do to files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def entries(text: str | None) -> list[tuple[str | None, str | None, int]]:
    """(old path, new path, lines added and removed) of each file of a diff; a path is None where the file is created or deleted. The body of a
    hunk is as long as its header says, so a line in it that looks like a header is none."""

    def path(line: str, lead: str) -> str | None:
        name = line[4:].split("\t")[0].strip()
        return None if name in ("/dev/null", "") else name.removeprefix(lead)

    out: list[list] = []
    old: tuple[str | None] | None = None
    minus = plus = 0
    for line in (text or "").splitlines():
        if minus or plus:
            if line[:1] != "\\":
                out[-1][2] += line[:1] in ("-", "+")
                minus -= minus > 0 and line[:1] != "+"
                plus -= plus > 0 and line[:1] != "-"
        elif (m := _HUNK.match(line)) and out:
            minus, plus = int(m[1] or 1), int(m[2] or 1)
        elif line.startswith("--- "):
            old = (path(line, "a/"),)
        elif line.startswith("+++ ") and old is not None:
            out.append([old[0], path(line, "b/"), 0])
            old = None
    return [tuple(e) for e in out]


def parsed(patches: DataFrame) -> DataFrame:
    """id, old, new, changed for patches(id, patch), a row for each file; a patch that is no diff has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *e) for i, t in zip(b["id"], b["patch"], strict=True) for e in entries(t)]
            yield pd.DataFrame(rows, columns=["id", "old", "new", "changed"])

    return patches.select("id", "patch").mapInPandas(run, "id string, old string, new string, changed long")


def classified(found: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """id, path, what (modified, created or deleted) for the files of interest; a rename is a deletion and a creation."""
    keep = lambda c: F.coalesce(F.col(c).rlike("(?:" + "|".join(map(re.escape, extensions)) + ")$"), F.lit(False))
    same = F.col("old").eqNullSafe(F.col("new"))
    of = lambda cond, c, what: found.where(cond & keep(c)).select("id", F.col(c).alias("path"), F.lit(what).alias("what"))
    return of(same, "old", "modified").union(of(~same, "old", "deleted")).union(of(~same, "new", "created")).distinct()


def changed_lines(found: DataFrame, measured: DataFrame) -> DataFrame:
    """id, changed: lines added and removed in files that measured(id, path) holds."""
    return found.select("id", F.coalesce("new", "old").alias("path"), "changed").join(measured.select("id", "path").distinct(), ["id", "path"], "left_semi").groupBy("id").agg(F.sum("changed").alias("changed"))


def outcome(n_entries: Column, n_files: Column, applied: Column, broken: Column) -> Column:
    """What became of a patch, the first that holds: not_a_diff, no_measurable_files, apply_failed, broke_syntax, ok."""
    return F.when(n_entries == 0, "not_a_diff").when(n_files == 0, "no_measurable_files").when(~applied, "apply_failed").when(broken > 0, "broke_syntax").otherwise("ok")


def measured(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and the changes of each figure over the files of both sides: before and after are id, path, max_cc, high_risk, dead. The greatest
    complexity is the greatest of any file, the others are sums."""
    side = lambda df, p: df.groupBy("id").agg(F.max("max_cc").alias(f"{p}_max"), F.sum("high_risk").alias(f"{p}_high"), F.sum("dead").alias(f"{p}_dead"))
    both = side(before, "b").join(side(after, "a"), "id")
    return both.select("id", *[(F.col(f"a_{k}") - F.col(f"b_{k}")).alias(f"d_{k}") for k in ("max", "high", "dead")])
