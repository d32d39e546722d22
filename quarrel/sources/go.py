"""Facts out of Go sources: packages, imports, types, functions with their decisions, nesting and uses of their receiver, and the package graph.

Comments and literals are blanked first, at equal length, so that brackets and words can be found by regular expressions and lines keep
their numbers. A function literal belongs to the function around it. A file without a package clause is a row of kind error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_FUNC = re.compile(r"^func\s*(?:\(\s*(?:(?P<self>\w+)\s+)?[(*\s]*(?P<of>\w+)[^)]*\)+\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?\(", re.M)
_TYPE = re.compile(r"(?:^type\s+|^\s+)(?P<name>\w+)(?:\[[^\]\n]*\])?\s+(?:=\s*)?(?P<what>struct|interface|func|map|chan|\*|\[|\w)", re.M)
_IMPORT = re.compile(r"(?:^|[\n;(])\s*(?P<name>[\w.]+\s+)?(?P<path>\"[^\"\n]+\"|`[^`\n]+`)")
_DECISIONS = {"if": r"\bif\b", "for": r"\bfor\b", "case": r"\bcase\b", "and": r"&&", "or": r"\|\|"}
SCHEMA = "path string, kind string, name string, owner string, detail string, a long, b long, line long, end_line long"


def blanked(text: str) -> str:
    """The text with comments and literals as spaces."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closing(bare: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
    opened, closed = bare[at], pairs[bare[at]]
    for m in re.compile(f"[{re.escape(opened + closed)}]").finditer(bare, at):
        depth += 1 if m[0] == opened else -1
        if not depth:
            return m.end()
    return len(bare)


def imports(text: str, bare: str) -> list[tuple[str, str, int]]:
    """(local name, path, line)."""
    out = []
    for m in re.finditer(r"^import\b", bare, re.M):
        at = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip(" \t"))
        stop = _closing(bare, at) if bare[at : at + 1] == "(" else (bare.find("\n", at) + 1 or len(bare))
        part = re.sub(r"//[^\n]*|/\*.*?\*/", lambda c: re.sub(r"[^\n]", " ", c[0]), text[at:stop], flags=re.S)
        for i in _IMPORT.finditer("\n" + part):
            out.append(((i["name"] or "").strip(), i["path"][1:-1], text.count("\n", 0, at + max(i.start("path") - 1, 0)) + 1))
    return out


def _nesting(body: str) -> int:
    """How deep control statements stand in one another; else if is no deeper than its if."""
    deepest, stack = 0, []
    for m in re.finditer(r"\b(if|for|switch|select)\b|\belse\s+if\b|[{}]", body):
        if m[0] == "{":
            stack.append(stack.pop() if stack and stack[-1] == "next" else "plain")
            if stack[-1] == "next":
                stack[-1] = "deep"
                deepest = max(deepest, stack.count("deep"))
        elif m[0] == "}":
            if stack:
                stack.pop()
        elif not stack or stack[-1] != "next":
            stack.append("next")
    return deepest


def _body(bare: str, at: int) -> int:
    """Where the body of a function opens whose parameters end at `at`; -1 if it has none. Types of results may hold brackets."""
    m = re.compile(r"\s*\(").match(bare, at)
    at = _closing(bare, m.end() - 1) if m else at
    while m := re.compile(r"[^\n{]*\{").match(bare, at):
        if not re.search(r"\b(?:struct|interface)\s*\{$", m[0]):
            return m.end() - 1
        at = _closing(bare, m.end() - 1)
    return -1


def facts_of(path: str, text: str | None) -> list[tuple]:
    """Rows of SCHEMA: package, import (detail its path), type (detail interface or other), function (owner its receiver, a complexity, b
    nesting), decision (detail its kind, a their number), member (owner the method, detail field or call), test and error."""
    text = text or ""
    bare = blanked(text)
    line = lambda at: bare.count("\n", 0, at) + 1
    found = re.search(r"^[ \t]*package[ \t]+(\w+)", bare, re.M)
    if not found:
        return [(path, "error", "", "", "no package clause", 0, 0, 1, 1)]
    out = [(path, "package", found[1], "", "", 0, 0, line(found.start()), line(found.end()))]
    out += [(path, "import", name, "", source, 0, 0, at, at) for name, source, at in imports(text, bare)]
    spans = []
    for m in re.finditer(r"^type\b\s*(\()?", bare, re.M):
        stop = _closing(bare, m.end() - 1) if m[1] else bare.find("\n", m.end()) if bare.find("\n", m.end()) > 0 else len(bare)
        part, depth = "", 0
        for c in bare[m.start() if not m[1] else m.end() : stop]:  # names of fields are inside brackets
            depth += c == "{"
            part += c if not depth or c in "\n" else " "
            depth -= c == "}"
        for t in _TYPE.finditer(part):
            if t["name"] != "type":
                out.append((path, "type", t["name"], "", "interface" if t["what"] == "interface" else "other", 0, 0, line(m.start()) + part.count("\n", 0, t.start("name")), 0))
    methods: dict[str, set[str]] = {}
    for m in _FUNC.finditer(bare):
        if m["of"]:
            methods.setdefault(m["of"], set()).add(m["name"])
    for m in _FUNC.finditer(bare):
        args = _closing(bare, m.end() - 1)
        head = _body(bare, args)
        if head < 0:
            continue
        stop = _closing(bare, head)
        body, name = bare[head:stop], f"{m['of']}.{m['name']}" if m["of"] else m["name"]
        spans.append((head, stop))
        counts = {k: len(re.findall(p, body)) for k, p in _DECISIONS.items()}
        out.append((path, "function", name, m["of"] or "", m["self"] or "", 1 + sum(counts.values()), _nesting(body), line(m.start()), line(stop)))
        out += [(path, "decision", name, m["of"] or "", k, n, 0, line(m.start()), 0) for k, n in counts.items() if n]
        if m["of"] and m["self"] and m["self"] != "_":
            used = {}
            for u in re.finditer(rf"(?<![\w.]){m['self']}\.(\w+)(\s*\()?", body):
                call = bool(u[2]) and u[1] in methods.get(m["of"], ())
                used[u[1]] = used.get(u[1], False) or call
            out += [(path, "member", field, name, "call" if call else "field", 0, 0, line(m.start()), 0) for field, call in sorted(used.items())]
    if path.endswith("_test.go"):
        out.append((path, "test", "", "", "", 0, 0, 1, line(len(bare))))
    return out


def facts(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, text in zip(b["path"], b["content"], strict=True) for r in facts_of(path, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def module_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """folder, module of the go.mod files among files(path, content): the path of the first module directive; files without one are left out."""
    name = F.regexp_extract("content", r"(?m)^[ \t]*module[ \t]+[\"`]?([^\s\"`/][^\s\"`]*)", 1)
    return files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select(folder_of(F.col("path")).alias("folder"), name.alias("module")).where("module <> ''")


def packages(files: DataFrame, modules: DataFrame) -> DataFrame:
    """path, package of files(path): the module of the nearest folder above that has one, and the way down from there. Folders that the build leaves
    out (vendor, testdata, names that begin with a dot or an underscore) and files without a module are not among them."""
    folder = folder_of(F.col("path"))
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.select("path", folder.alias("at")).select("path", "at", F.explode(F.array_distinct(above)).alias("folder"))
    near = each.join(modules, "folder").groupBy("path", "at").agg(F.max_by(F.struct("folder", "module"), F.length("folder")).alias("m"))
    rest = F.ltrim(F.substring("at", F.length("m.folder") + 1, F.length("at")), F.lit("/"))
    met = near.select("path", rest.alias("rest"), F.col("m.module").alias("module"))
    left_out = F.exists(F.split("rest", "/"), lambda d: d.isin("vendor", "testdata") | d.startswith(".") | d.startswith("_"))
    return met.where(~left_out).select("path", F.when(F.col("rest") == "", F.col("module")).otherwise(F.concat_ws("/", "module", "rest")).alias("package"))


def package_graph(found: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(node, name, abstractness) and edges(src, dst, weight) out of facts() and packages(): an edge weighs the files that import its target;
    tests, imports of other modules and of a package itself are left out; abstractness is the share of exported types that are interfaces."""
    own = found.join(places, "path").where(~F.col("path").endswith("_test.go"))
    exported = (F.col("kind") == "type") & F.substring("name", 1, 1).rlike(r"\p{Lu}")
    share = F.count(F.when(exported & (F.col("detail") == "interface"), 1)) / F.greatest(F.count(F.when(exported, 1)), F.lit(1))
    nodes = own.groupBy(F.col("package").alias("node")).agg(F.min(F.when(F.col("kind") == "package", F.col("name"))).alias("name"), F.round(share, 6).alias("abstractness"))
    links = own.where("kind = 'import'").select(F.col("package").alias("src"), F.col("detail").alias("dst"), "path").distinct()
    known = nodes.select(F.col("node").alias("dst"))
    return nodes, links.where("src <> dst").join(known, "dst", "left_semi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
