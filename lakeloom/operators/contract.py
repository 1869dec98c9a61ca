"""The contract of a documentation corpus: navigation, links, slugs, page order and the rendered indexes.

A corpus is a table of files (repo, path, content).  Markdown is read by
expressions over lines and matches, one row per link, heading or entry, so a
corpus of any number of files is checked by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fn

#: Fenced code, then inline code.
CODE = r"(?ms)^(?:```.*?^```|~~~.*?^~~~)|`[^`\n]*`"
LINK = r"\[([^\]\n]*)\]\(([^)\s]+)\)"
ENTRY = r"^- \[([^\]]*)\]\(([^)]*)\)(?: — (.*))?$"
NAV_HEADING = "## All pages"


def without_code(c: Column) -> Column:
    return F.regexp_replace(c, CODE, "")


def code_ranges(c: Column) -> Column:
    """(start, length) in characters of every fenced or inline code, in order."""
    found = F.regexp_extract_all(c, F.lit(CODE), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(acc, m):
        start = F.position(m, c, acc["at"] + 1)
        return F.struct((start - 1 + F.length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct((start - 1).alias("start"), F.length(m).alias("length")))).alias("out"))
    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def resolve_path(base: Column, target: Column) -> Column:
    """Struct (path, escapes): the target from a folder, with ``.`` and ``..`` folded; escapes if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(base, F.lit("")), target), "/"), lambda s: (s != "") & (s != "."))
    zero = F.struct(F.array().cast("array<string>").alias("s"), F.lit(False).alias("e"))

    def fold(acc, x):
        up = x == ".."
        empty = F.size(acc["s"]) == 0
        s = F.when(up & empty, acc["s"]).when(up, F.slice(acc["s"], 1, F.greatest(F.size(acc["s"]) - 1, F.lit(0)))).otherwise(F.concat(acc["s"], F.array(x)))
        return F.struct(s.alias("s"), (acc["e"] | (up & empty)).alias("e"))

    return F.aggregate(parts, zero, fold, lambda acc: F.struct(F.array_join(acc["s"], "/").alias("path"), acc["e"].alias("escapes")))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def nav(files: DataFrame, index: str = "index.md") -> DataFrame:
    """(repo, pos, grp, title, path, description) of the entries below the index's list of all pages."""
    lines = files.where(F.col("path") == index).select("repo", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    w = Window.partitionBy("repo").orderBy("pos")
    open_ = F.last(F.when(F.col("line").startswith("## "), F.col("line") == NAV_HEADING), ignorenulls=True).over(w)
    grp = F.last(F.when(F.col("line").startswith("### "), F.substring("line", 5, 1 << 20)), ignorenulls=True).over(w)
    rows = lines.withColumns({"_open": open_, "grp": grp}).where(F.coalesce("_open", F.lit(False)) & F.col("line").rlike(ENTRY))
    part = lambda i: F.regexp_extract("line", ENTRY, i)
    return rows.select("repo", "pos", "grp", part(1).alias("title"), resolve_path(folder(F.lit(index)), part(2))["path"].alias("path"), part(3).alias("description"))


def slugs(files: DataFrame) -> DataFrame:
    """Distinct (repo, path, slug) of the headings outside code."""
    heads = files.select("repo", "path", F.explode(F.regexp_extract_all(without_code(F.col("content")), F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1))).alias("h"))
    return heads.select("repo", "path", fn.github_slug(F.col("h")).alias("slug")).distinct()


def links(files: DataFrame) -> DataFrame:
    """(repo, path, target, to_path, anchor, escapes) of the links outside code that stay in the corpus."""
    found = files.select("repo", "path", F.explode(F.regexp_extract_all(without_code(F.col("content")), F.lit(LINK), F.lit(2))).alias("target"))
    found = found.where(~F.col("target").rlike(r"^[a-z][a-z0-9+.\-]*:|^//"))
    file = F.regexp_replace("target", "#.*$", "")
    to = resolve_path(folder(F.col("path")), file)
    found = found.withColumn("r", F.when(file == "", F.struct(F.col("path").alias("path"), F.lit(False).alias("escapes"))).otherwise(to))
    return found.select("repo", "path", "target", F.col("r.path").alias("to_path"), F.nullif(F.regexp_extract("target", "#(.*)$", 1), F.lit("")).alias("anchor"), F.col("r.escapes").alias("escapes"))


def findings(files: DataFrame, index: str = "index.md") -> DataFrame:
    """(repo, path, rule, detail, severity): broken links and anchors, and pages that the navigation does not name."""
    found = links(files)
    pages = files.select("repo", F.col("path").alias("to_path"))
    gone = found.join(pages, ["repo", "to_path"], "left_anti").select("repo", "path", F.lit("broken_link").alias("rule"), F.col("target").alias("detail"), F.lit("error").alias("severity"))
    there = found.where("anchor is not null").join(pages, ["repo", "to_path"], "left_semi")
    anchors = slugs(files).select("repo", F.col("path").alias("to_path"), F.col("slug").alias("anchor"))
    lost = there.join(anchors, ["repo", "to_path", "anchor"], "left_anti").select("repo", "path", F.lit("broken_anchor").alias("rule"), F.col("target").alias("detail"), F.lit("error").alias("severity"))
    orphan = files.where((F.col("path") != index) & F.col("path").endswith(".md")).join(nav(files, index).select("repo", "path"), ["repo", "path"], "left_anti")
    orphan = orphan.select("repo", "path", F.lit("orphan_page").alias("rule"), F.col("path").alias("detail"), F.lit("warn").alias("severity"))
    return gone.unionByName(lost).unionByName(orphan).distinct()


def ordered_pages(files: DataFrame, index: str = "index.md") -> DataFrame:
    """(repo, path, place): pages in the order of the navigation, then the others by path; translations are left out."""
    first = nav(files, index).groupBy("repo", "path").agg(F.min("pos").alias("pos"))
    pages = files.where(F.col("path").endswith(".md") & ~F.col("path").contains("zh-TW") & (F.col("path") != index)).select("repo", "path")
    w = Window.partitionBy("repo").orderBy(F.col("pos").isNull(), F.col("pos"), F.col("path"))
    return pages.join(first, ["repo", "path"], "left").withColumn("place", F.row_number().over(w)).select("repo", "path", "place")


def llms_index(files: DataFrame, base: str) -> DataFrame:
    """(repo, text): one line for each entry of the navigation under its group."""
    n = nav(files)
    tail = F.when(F.col("description") == "", F.lit("")).otherwise(F.concat(F.lit(": "), "description"))
    line = F.concat(F.lit("- ["), "title", F.lit("]("), F.lit(base), F.col("repo"), F.lit("/"), F.col("path"), F.lit(")"), tail)
    groups = n.groupBy("repo", "grp").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("## "), "grp", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    out = groups.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("first", body.alias("body")))).alias("b"))
    return out.select("repo", F.concat(F.lit("# "), "repo", F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["body"]), "\n\n")).alias("text"))


def llms_full(files: DataFrame) -> DataFrame:
    """(repo, text): all pages in their order, each with its path before it."""
    rows = ordered_pages(files).join(files, ["repo", "path"])
    page = F.concat(F.lit("--- "), "path", F.lit(" ---\n"), F.trim("content"))
    out = rows.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", page.alias("page")))).alias("p"))
    return out.select("repo", F.array_join(F.transform("p", lambda x: x["page"]), "\n\n").alias("text"))
