"""Imports resolved to files, and what nobody uses: over facts(path, kind, name, detail, source, line, ...) of sources/js.py.

A relative source names one file: the first known of itself, itself with an extension, and an index file in it. Another source may be an alias, whose
segments behind the first stand for every file whose path ends with them; a package has no file. What no path resolves stays out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrel import functions as fn
from quarrel.operators import graph, metrics
from quarrel.plans import written

# Extensions in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")


def joined_path(folder: Column, source: Column) -> Column:
    """source below folder, with . and .. taken out."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(source, "/")), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.when(folder.startswith("/"), "/").otherwise(""), F.array_join(up, "/"))


def resolved(found: DataFrame) -> DataFrame:
    """path, target, name, kind, line, source for every import (and re-export) that names known files."""
    files = written(found.select("path").distinct(), "files")
    uses = found.where("kind LIKE 'import_%' or (kind LIKE 'export_%' and detail = 're_export')").select("path", "kind", "name", "source", "line").where("source <> ''")
    kind = fn.source_kind(F.col("source"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    near = uses.where(kind.isin("relative", "absolute")).withColumn("base", F.when(kind == "absolute", F.col("source")).otherwise(joined_path(folder, F.col("source"))))
    names = ["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)]
    tried = near.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.concat("base", F.lit(e)).alias("target")) for i, e in enumerate(names)])))
    met = tried.select("path", "kind", "name", "line", "source", "base", "c.i", "c.target").join(files.withColumnRenamed("path", "target"), "target", "left_semi")
    one = met.groupBy("path", "kind", "name", "line", "source", "base").agg(F.min(F.struct("i", "target"))["target"].alias("target")).drop("base")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.[cm]?[jt]sx?$", ""), "/index$", "")
    ends = files.select(F.col("path").alias("target"), F.explode(fn.suffixes(bare(F.col("path")), 5)).alias("suffix"))
    far = uses.where(kind == "alias").withColumn("suffix", bare(F.regexp_replace("source", "^[@~]/", "")))
    many = far.join(ends, "suffix").select("path", "kind", "name", "line", "source", "target")
    return one.select("path", "target", "name", "kind", "line", "source").union(many.select("path", "target", "name", "kind", "line", "source"))


def imported_names(uses: DataFrame) -> DataFrame:
    """file, name: what is imported of each file; * stands for all of it. A call of require or import takes no name."""
    named = F.col("kind").isin("import_import", "import_type_only", "export_named", "export_default", "export_all")
    return uses.where(named).select(F.col("target").alias("file"), "name").distinct()


def unused_imports(found: DataFrame) -> DataFrame:
    """path, name, line: imported names that stand nowhere else in their file."""
    local = found.where("kind IN ('import_import', 'import_type_only') and detail <> ''").select("path", F.col("detail").alias("name"), "line")
    used = found.where("kind = 'ident'").select("path", "name")
    listed = found.where("kind LIKE 'export_%' and detail = 'list'").select("path", "name")
    return local.join(used.union(listed).distinct(), ["path", "name"], "left_anti")


def unused_exports(found: DataFrame, uses: DataFrame) -> DataFrame:
    """path, name, line, reason, severity: exports that no known file imports. Entry and test files, re-exports and what a framework takes by name are
    left out, as are files imported whole; functions and classes are a warning, other names information."""
    skipped = fn.is_entry(F.col("file")) | fn.is_test(F.col("file")) | (F.col("detail") == "re_export") | fn.is_reserved(F.col("file"), F.col("name"))
    exports = found.where("kind IN ('export_named', 'export_default', 'export_commonjs')").select(F.col("path").alias("file"), "name", "detail", "line")
    left = metrics.unused(exports, imported_names(uses), skipped)
    callable_ = fn.declares_callable(F.col("detail"))
    return left.select(F.col("file").alias("path"), "name", "line", F.when(callable_, "unused_exported_function").otherwise("unused_export").alias("reason"), F.when(callable_, "warning").otherwise("info").alias("severity"))


def orphans(found: DataFrame, uses: DataFrame) -> DataFrame:
    """path of the files that no entry leads to: entries are named so, or nobody imports them. Test and settings files are neither found nor do
    their imports count."""
    helper = lambda c: fn.is_test(F.col(c)) | fn.is_config(F.col(c))
    files = written(found.select("path").distinct().where(~helper("path")), "files")
    links = written(uses.where(~helper("path") & ~helper("target")).select(F.col("path").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct(), "links")
    used = uses.where("path <> target").select(F.col("target").alias("path")).distinct()
    starts = files.where(fn.is_entry(F.col("path"))).union(files.join(used, "path", "left_anti")).select(F.col("path").alias("node"))
    return files.join(graph.reachable(links, starts).withColumnRenamed("node", "path"), "path", "left_anti")


def file_coupling(found: DataFrame) -> DataFrame:
    """class (a file), cbo, deps, by_kind, risk (to 7 low, to 14 medium): names that a file imports from packages or files, constructs, calls or
    names as types; files without any have 0. A name counts once, whatever kinds it is of."""
    imports = found.where("kind IN ('import_import')").select(F.col("path").alias("class"), fn.package_of(F.col("source")).alias("dep"), F.lit("import").alias("kind"))
    deps = found.where("kind = 'dep'").select(F.col("path").alias("class"), F.col("name").alias("dep"), F.col("detail").alias("kind"))
    per = metrics.cbo(imports.union(deps)).drop("risk")
    every = found.select(F.col("path").alias("class")).distinct().join(per, "class", "left")
    full = every.select("class", F.coalesce("cbo", F.lit(0)).alias("cbo"), F.coalesce("deps", F.lit("")).alias("deps"), F.coalesce("by_kind", F.lit("")).alias("by_kind"))
    return full.withColumn("risk", metrics.risk(F.col("cbo"), (7, 14)))


def module_tables(found: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with external ones and edges with kind and weight (the names it takes) of the modules; an import that no file answers keeps its
    package or its source as its target."""
    kinds = F.when(F.col("kind") == "import_dynamic", "dynamic").when(F.col("kind") == "import_type_only", "type_only").otherwise("import")
    known = uses.select("path", "target", kinds.alias("kind"), "line")
    key = ["path", "kind", "source", "line"]
    lost = found.where("kind LIKE 'import_%' and source <> ''").select(key).join(uses.select(key).distinct(), key, "left_anti")
    lost = lost.select("path", F.when(fn.source_kind(F.col("source")) == "package", fn.package_of(F.col("source"))).otherwise(F.col("source")).alias("target"), kinds.alias("kind"), "line")
    per = known.union(lost).groupBy(F.col("path").alias("src"), "target", "kind", "line").agg(F.count(F.lit(1)).alias("names"))
    return graph.module_graph(per, found.select(F.col("path").alias("node")).distinct())
