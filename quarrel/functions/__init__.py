"""Column functions over text and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loc(text: Column) -> Column:
    """Lines of a text: line feeds and one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def code_lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")) != "")).cast("long")


def url_path(url: Column) -> Column:
    """The path of a URL without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://[^/]*", "")


def module_of(path: Column) -> Column:
    """The first segment of a relative path, leading ./ and ../ and slashes dropped; '' if none."""
    return F.regexp_extract(path, r"^(?:\.{0,2}/)*([^/]*)", 1)


def base(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The last segment without its last extension."""
    return F.regexp_extract(base(path), r"^(.*?)(?:\.[^.]*)?$", 1)


def is_test(path: Column) -> Column:
    return base(path).rlike(r"(^|\.)(test|spec)(\.|$)") | path.contains("__tests__")


def is_entry(path: Column) -> Column:
    return stem(path).isin("index", "main", "app", "server")


def is_config(path: Column) -> Column:
    return base(path).rlike(r"(^|\.)(config|setup)(\.|$)")


def suffixes(path: Column, most: int = 5) -> Column:
    """The runs of one to `most` trailing segments."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.least(F.size(parts), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).otherwise(F.array().cast("array<string>"))


def count_bin(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").when(n <= 15, "8-15").otherwise("16+")


def source_kind(spec: Column) -> Column:
    """What an import names: relative, absolute, alias, url or package."""
    return F.when(spec.rlike(r"^\.{1,2}(/|$)"), "relative").when(spec.startswith("/"), "absolute").when(spec.rlike("^[@~]/"), "alias").when(spec.rlike("^[a-z]+://"), "url").otherwise("package")


def axis_ceiling(top: Column) -> Column:
    """The least of 1, 2, 3, 5, 6 and 10 times the power of ten below a whole number that reaches it; 3 at least."""
    mag = F.pow(F.lit(10.0), F.length(top.cast("string")) - 1)
    steps = F.when(top <= 3, 3.0)
    for k in (1, 2, 3, 5, 6):
        steps = steps.when(top <= k * mag, k * mag)
    return steps.otherwise(10 * mag).cast("long")


def compatible(a: Column, b: Column) -> Column:
    """Two sets of signals meet; an empty one meets all."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def disjoint(a: Column, b: Column) -> Column:
    """Both hold two signals or more and share none."""
    return (F.size(a) >= 2) & (F.size(b) >= 2) & ~F.arrays_overlap(a, b)


def strip_comments(text: Column, opened: str, closed: str) -> Column:
    """The text without what stands from a mark to the next closing mark; an unclosed comment stays."""
    return F.regexp_replace(text, rf"(?s)\Q{opened}\E.*?\Q{closed}\E", "")


def band(score: Column) -> Column:
    """ok, watch or poor."""
    return F.when(score >= 75, "ok").when(score >= 60, "watch").otherwise("poor")


def joined_snippets(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows(key, order..., text) with again (the first line repeats the line before it and goes) and kept (the text less such a line).
    The rows of a key stay rows: no task gathers a whole key's text."""
    lines = F.split("text", "\n")
    before = F.lag(F.element_at(lines, -1)).over(Window.partitionBy(key).orderBy(*order))
    again = F.coalesce(before == F.element_at(lines, 1), F.lit(False))
    marked = rows.withColumn("again", again)
    return marked.withColumn("kept", F.when(F.col("again"), F.regexp_replace("text", r"(?s)^[^\n]*\n?", "")).otherwise(F.col("text")))


# Files and exports that a framework calls by their names.
CONVENTIONS = ("page", "layout", "template", "loading", "error", "not-found", "default", "route")
FRAMEWORK_NAMES = ("default", "generateMetadata", "metadata", "generateViewport", "viewport", "generateStaticParams", "dynamic", "dynamicParams", "revalidate", "fetchCache", "runtime", "preferredRegion", "maxDuration")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def is_convention(path: Column) -> Column:
    return path.contains("/app/") & stem(path).isin(*CONVENTIONS)


def is_route(path: Column) -> Column:
    return path.contains("/app/") & (stem(path) == "route")


def is_reserved(path: Column, name: Column) -> Column:
    """An export that a framework takes out of a file by its name."""
    return is_convention(path) & (name.isin(*FRAMEWORK_NAMES) | (is_route(path) & name.isin(*VERBS)))


def declares_callable(kind: Column) -> Column:
    """A declaration of a function or a class, by the name of its syntax node."""
    return kind.contains("Function") | kind.contains("Class")


def glob_regex(glob: str) -> str:
    """A regular expression for a glob of one name: * and ? stop at slashes."""
    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "_ " else c for c in glob) + "$"


def matches_names(name: Column, patterns: list[str]) -> Column:
    """Any pattern: as a glob where it has a wildcard, else equal in any case."""
    out = F.lit(False)
    for p in patterns:
        out = out | (name.rlike(glob_regex(p)) if any(c in p for c in "*?") else F.lower(name) == p.lower())
    return out


def in_folders(path: Column, names: list[str]) -> Column:
    """One of the folders above the file has one of the names."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(names))


def is_external(kind: Column) -> Column:
    return kind.isin("package", "builtin", "url")


def package_of(spec: Column) -> Column:
    """The package that an import names: ./ and ../ at its start are dropped, a scope keeps two segments, others one."""
    bare = F.regexp_replace(F.regexp_replace(spec, r"^(\./)+", ""), r"^(\.\./)+", "")
    return F.when(bare.startswith("@"), F.regexp_extract(bare, "^([^/]*/?[^/]*)", 1)).otherwise(F.regexp_replace(bare, "(?s)^([^/]+)/.*$", "$1"))


def abstractness(exports: Column) -> Column:
    """Grows with the number of exports up to 1 at ten."""
    return F.least(exports / 10, F.lit(1.0))


def is_exported(name: Column) -> Column:
    """The first character is an upper-case letter."""
    first = F.substring(name, 1, 1)
    return (first != F.lower(first)) & (first == F.upper(first))


def unquoted(literal: Column) -> Column:
    """The text of a quoted literal; null for other text and for a template with a placeholder."""
    inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
    first = F.substring(literal, 1, 1)
    whole = (F.length(literal) >= 2) & (first == F.substring(literal, -1, 1)) & first.isin("'", '"', "`")
    return F.when(whole & ~((first == "`") & inner.contains("${")), inner)


def relative_to(path: Column, root: str) -> Column:
    """path without root where it lies below it, with forward slashes."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    lead = root.rstrip("/") + "/"
    return F.when(flat.startswith(lead), F.substring(flat, F.lit(len(lead) + 1), F.length(flat))).otherwise(flat)


def last_part(name: Column, separator: str) -> Column:
    return F.element_at(F.split(name, "\\Q" + separator + "\\E"), -1)


def type_only_lines(text: Column) -> Column:
    """Numbers, from 1, of the lines that begin a type-only import."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(F.trim(x).startswith("import type "), i + 1))
    return F.filter(lines, lambda x: x.isNotNull())


def label_base(label: Column) -> Column:
    """A node's label without the detail in brackets behind it."""
    return F.regexp_replace(label, r"(?s)\(.*\)$", "")


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def reason_text(reason: Column) -> Column:
    """A reason of dead code as a sentence."""
    texts = {"unreachable": "Code that no path reaches", "after_return": "Code after a return", "after_throw": "Code after a throw", "after_break": "Code after a break", "after_continue": "Code after a continue"}
    out = F.when(F.lit(False), "")
    for k, v in texts.items():
        out = out.when(reason == k, v)
    return out.otherwise("Code that never runs")


def at_least_severity(severity: Column, least: str) -> Column:
    level = lambda c: F.when(c == "info", 1).when(c == "warning", 2).when(c == "critical", 3).otherwise(0)
    return level(severity) >= level(F.lit(least))
