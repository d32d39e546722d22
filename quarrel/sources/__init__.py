"""Files as tables, and reports as files."""

from __future__ import annotations

import csv
import fnmatch
import html
import io
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a walk leaves out.
SKIPPED = ("node_modules", "vendor", "target", "build", "dist", "third_party")


def glob_pattern(globs: list[str]) -> str:
    """One regular expression for any of the globs."""
    return "|".join(f"(?:{fnmatch.translate(g)})" for g in globs).replace(r"\Z", r"\z").replace("(?s:", "(?:") or "(?!)"


def read_files(spark: SparkSession, roots: list[str], extensions: dict[str, str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, lang, content of the files below roots whose extension is known. Skipped folders and dot-folders below a root, and names
    that the globs rule out, go before contents are decoded; a root given by name is never skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "content")
    rel = F.col("path")
    for root in roots:
        rel = F.regexp_replace(rel, "^(file:)?/*" + re.escape(root.strip("/")) + "/", "")
    folders = F.slice(F.split(rel, "/"), F.lit(1), F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    base, ext = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"(\.[^./]+)$", 1)
    keep = ext.isin(*extensions) & ~F.exists(folders, lambda d: d.isin(*SKIPPED) | d.startswith("."))
    if include:
        keep &= base.rlike(glob_pattern(include))
    if exclude:
        keep &= ~base.rlike(glob_pattern(exclude))
    lang = F.create_map(*[F.lit(x) for kv in extensions.items() for x in kv])[ext]
    return files.where(keep).dropDuplicates(["path"]).select("path", lang.alias("lang"), F.decode("content", "UTF-8").alias("content"))


# Names of languages by extension.
LANGUAGES = {".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript", ".go": "Go", ".rs": "Rust", ".cc": "C++", ".cpp": "C++", ".h": "C++"}


def language(path: Column) -> Column:
    """The display name of a file's language by its extension, in any case; null if it is none of LANGUAGES."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def _segment(glob: str) -> str:
    """A glob of one path segment as a regular expression; a malformed one matches nothing."""
    if glob.count("[") != glob.count("]"):
        return "(?!)"
    return fnmatch.translate(glob).replace("(?s:", "(?:", 1).removesuffix(r"\Z").removesuffix(r"\z").replace(".*", "[^/]*").replace("(?>[^/]*?", "(?:[^/]*?").replace("(?:.)", "[^/]")


def path_pattern(pattern: str) -> str:
    """A regular expression, for lower-case relative paths with slashes: a pattern without slashes names the file or any folder above it; one with
    slashes is a run of segments anywhere, and all that lies below it; ** is any number of segments."""
    parts = pattern.lower().replace("\\", "/").strip("/").split("/")
    if parts == [""]:
        return "(?!)"
    if len(parts) == 1 and parts[0] != "**":
        return f"(?:^|/){_segment(parts[0])}(?:/|$)"
    out = "(?:^|/)"
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        out += "" if p == "**" and last else "(?:[^/]+/)*" if p == "**" else _segment(p) + ("(?:/|$)" if last else "/")
    return out


def matches_paths(path: Column, patterns: list[str]) -> Column:
    """Any of the patterns; names and patterns in any case."""
    found = "|".join(f"(?:{path_pattern(p)})" for p in patterns if p.strip("/"))
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(found) if found else F.lit(False)


def ignored(path: Column, gitignore: str) -> Column:
    """Whether a .gitignore at the root leaves a relative path out: the last pattern that matches decides, ! takes back."""
    out = F.lit(False)
    for raw in gitignore.splitlines():
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.lstrip("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        rooted, parts, body = "/" in line, line.lstrip("/").split("/"), ""
        for i, p in enumerate(parts):
            more = i + 1 < len(parts)
            body += _segment(p) + "/" * more if p != "**" else "(?:[^/]+/)*" if more else ""
        end = "" if parts[-1] == "**" else "/" if folder else "(?:/|$)"
        out = F.when(path.rlike(("^" if rooted else "(?:^|/)") + body + end), not back).otherwise(out)
    return out


def read_scripts(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path (relative), lang, content, error of the scripts below root: what its .gitignore and exclude leave out goes before contents are decoded,
    include (all if none) chooses. A file that is not UTF-8 is a row with an error and without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.strip("/")) + "/", "")
    files = files.select(rel.alias("path"), "content").where(language(F.col("path")).isin("JavaScript", "TypeScript"))
    rules = _text_of(spark, f"{root.rstrip('/')}/.gitignore")
    keep = ~ignored(F.col("path"), rules) & ~matches_paths(F.col("path"), exclude or [])
    return snapshot(files.where(keep & matches_paths(F.col("path"), include) if include else keep))


def _text_of(spark: SparkSession, path: str) -> str:
    """One small file, which may be hidden, by the file system of its path; '' if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def snapshot(files: DataFrame) -> DataFrame:
    """path, lang, content, error for files(path, content as bytes): read once for all analyses, errors as rows."""
    good = F.is_valid_utf8("content")
    text = F.when(good, F.decode("content", "UTF-8"))
    return files.select("path", language(F.col("path")).alias("lang"), text.alias("content"), F.when(~good, "not UTF-8").alias("error"))


def accounting(snap: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """total, analyzed, partial (with a parse error of parse_errors(path)), skipped (unreadable) and the messages, sorted, of a snapshot."""
    bad = parse_errors.select("path").distinct().withColumn("bad", F.lit(True))
    message = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "path", "error")).when(F.col("bad"), F.concat_ws(": ", "path", F.lit("syntax error")))
    met = snap.join(bad, "path", "left")
    n = lambda c: F.count(F.when(c, 1))
    return met.agg(F.count(F.lit(1)).alias("total"), n(F.col("error").isNull()).alias("analyzed"), n(F.col("bad")).alias("partial"), n(F.col("error").isNotNull()).alias("skipped"), F.array_join(F.sort_array(F.collect_list(message)), "\n").alias("messages"))


def same_paths(asked: DataFrame, snap: DataFrame) -> bool:
    """Do the request and the snapshot hold the same paths?"""
    a, b = asked.select("path").distinct(), snap.select("path").distinct()
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


# ---- reports ----


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def yaml_text(value, indent: int = 0) -> str:
    """A document of maps, lists and scalars as YAML."""
    lead = "  " * indent
    if isinstance(value, dict):
        return "".join(f"{lead}{k}:{_under(v, indent)}" for k, v in value.items()) or f"{lead}{{}}\n"
    if isinstance(value, (list, tuple)):
        return "".join(f"{lead}-{_under(v, indent)}" for v in value) or f"{lead}[]\n"
    return f"{lead}{_scalar(value)}\n"


def _under(value, indent: int) -> str:
    deep = isinstance(value, (dict, list, tuple)) and value
    return "\n" + yaml_text(value, indent + 1) if deep else " " + ("{}" if value == {} else "[]" if value in ([], ()) else _scalar(value)) + "\n"


def _scalar(value) -> str:
    return json.dumps(value, ensure_ascii=False) if value is None or isinstance(value, (bool, int, float, str)) else json.dumps(str(value))


def _number(value) -> str:
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else f"{value:.2f}" if isinstance(value, float) else str(value)


def report_text(summary: dict, sections: dict[str, list[dict]], kind: str) -> str:
    """A report of a summary and sections of rows as json, yaml, text, html, csv (each section under its name) or cli (the summary alone).

    For what is small: summaries and top lists that a query has cut. Whole tables go through write_report.
    """
    if kind == "json":
        return json.dumps({"summary": _plain(summary), **_plain(sections)}, indent=2, ensure_ascii=False, default=str) + "\n"
    if kind == "yaml":
        return yaml_text({"summary": summary, **sections})
    if kind == "csv":
        out = io.StringIO()
        for name, rows in {"summary": [summary], **sections}.items():
            out.write(f"# {name}\n")
            if rows:
                w = csv.DictWriter(out, list(rows[0]), lineterminator="\n")
                w.writeheader()
                w.writerows(rows)
            out.write("\n")
        return out.getvalue()
    if kind == "html":
        cell = lambda v, tag: f"<{tag}>{html.escape(_number(v))}</{tag}>"
        table = lambda rows: "<table><tr>" + "".join(cell(c, "th") for c in rows[0]) + "</tr>" + "".join("<tr>" + "".join(cell(v, "td") for v in r.values()) + "</tr>" for r in rows) + "</table>" if rows else "<p>none</p>"
        return "<!DOCTYPE html><meta charset=utf-8><title>Report</title>" + "".join(f"<h2>{html.escape(n)}</h2>{table(r)}" for n, r in {"summary": [summary], **sections}.items()) + "\n"
    if kind in ("text", "cli"):
        lines = [f"{k}: {_number(v)}" for k, v in summary.items()]
        for name, rows in sections.items() if kind == "text" else ():
            lines += ["", name.upper(), *("  " + "  ".join(_number(v) for v in r.values()) for r in rows)]
        return "\n".join(lines) + "\n"
    raise ValueError(f"no such format: {kind}")


def write_records(df: DataFrame, meta: dict, path: str) -> None:
    """Records and one metadata record as JSON lines; appended, so that a run that is taken up again adds to them."""
    spark = df.sparkSession
    df.write.mode("append").json(f"{path}/records")
    spark.createDataFrame([(json.dumps({"record_type": "meta", **meta}, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/meta")


def read_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict]:
    """The records of several sets of JSON lines (plain or gzip) pooled, and their metadata merged; sets of different analyzers do not mix, and
    one without records is an error."""
    pooled, metas = None, []
    for p in paths:
        lines = spark.read.option("recursiveFileLookup", True).text(p).where(F.trim("value") != "")
        is_meta = F.coalesce(F.get_json_object("value", "$.record_type") == "meta", F.lit(False))
        metas += [json.loads(r[0]) for r in lines.where(is_meta).limit(100).collect()]  # one a set
        records = _from_lines(spark, lines.where(~is_meta), p)
        pooled = records if pooled is None else pooled.unionByName(records, allowMissingColumns=True)
    builds = {m["analyzer"] for m in metas if m.get("analyzer")}
    if len(builds) > 1:
        raise ValueError(f"sets of different analyzers: {sorted(builds)}")
    return pooled, {"analyzer": next(iter(builds), None), "n_instances": sum(m.get("n_instances", 0) for m in metas), "repo": ", ".join(sorted({m["repo"] for m in metas if m.get("repo")}))}


def _from_lines(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    if not lines.take(1):
        raise ValueError(f"{path} holds no records")
    return lines.select(F.from_json("value", _schema(lines)).alias("r")).select("r.*")


def _schema(lines: DataFrame) -> str:
    """The union of the fields of all lines: names with the type that each has first in order of names and types."""
    found = lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")).where("v is not null")
    number = F.when(F.col("v").rlike(r"^-?\d+$"), "bigint").when(F.col("v").rlike(r"^-?\d[\d.eE+-]*$"), "double").when(F.col("v").isin("true", "false"), "boolean").otherwise("string")
    kinds = found.groupBy("k").agg(F.collect_set(number).alias("s")).collect()  # one row a field
    pick = lambda s: s[0] if len(s) == 1 else "double" if set(s) == {"bigint", "double"} else "string"
    return ", ".join(f"`{r.k}` {pick(r.s)}" for r in sorted(kinds))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report table as json, csv or parquet."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[kind](path)
