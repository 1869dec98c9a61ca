"""Import targets, aliases, inherited calls and crawl frontiers on relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch

#: Folders and endings under which an import may lie, in the order in which they are tried (fixed values).
PREFIXES = ("", "src/", "libs/", "include/")
ENDINGS = ("", ".rs", ".ts", ".js", ".py", ".go", ".java", ".cs", ".sh")


def rewrite_alias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports with ``target`` rewritten by the longest alias that it begins with.

    ``aliases`` (alias, replacement) is a project's configuration, a few rows,
    and is broadcast as one array.
    """
    table = aliases.agg(F.collect_list(F.struct("alias", "replacement")).alias("_a"))
    j = imports.join(F.broadcast(table), how="inner")  # one row
    fits = F.filter("_a", lambda a: F.col("target").startswith(a["alias"]))
    best = F.array_max(F.transform(fits, lambda a: F.struct(F.length(a["alias"]).alias("n"), a["replacement"].alias("r"))))
    cut = F.concat(best["r"], F.expr("substring(target, _n + 1)"))
    return j.withColumn("_b", best).withColumn("_n", F.coalesce(F.col("_b.n"), F.lit(0))).withColumn("target", F.when(F.col("_b").isNotNull(), F.concat(F.col("_b.r"), F.expr("substring(target, _n + 1)"))).otherwise(F.col("target"))).drop("_a", "_b", "_n")


def import_targets(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_name, module_path, target, resolved): the first candidate of an import that is a module of its repository.

    Candidates: the path as it is, below the usual folders, with the usual
    endings; relative ones from the importing file's folder.
    """
    here = F.regexp_extract("module_path", r"^(.*)/[^/]*$", 1)
    plain = F.regexp_replace("target", r"^\./", "")
    base = F.when(F.col("target").startswith("./"), F.concat(here, F.lit("/"), plain)).otherwise(F.col("target"))
    tries = F.array(*[F.struct(F.lit(i * len(ENDINGS) + k).alias("rank"), F.concat(F.lit(p), base, F.lit(e)).alias("path")) for i, p in enumerate(PREFIXES) for k, e in enumerate(ENDINGS)])
    c = imports.withColumn("c", F.explode(tries)).select("repo_name", "module_path", "target", "c.rank", "c.path")
    hit = c.join(modules.select("repo_name", "path").distinct(), ["repo_name", "path"])
    return hit.groupBy("repo_name", "module_path", "target").agg(F.min_by("path", "rank").alias("resolved"))


def inherited(spark: SparkSession, calls: DataFrame, supers: DataFrame, defines: DataFrame, levels: int = 8) -> DataFrame:
    """(src, method, dst, depth, confidence): for a call of (src, method, type), the nearest supertypes that define the method.

    ``supers``: (type, super); ``defines``: (type, method).  Each level goes on
    only with the calls that are not answered yet.
    """
    s = Scratch(spark, "inherited")
    open_, out = s.save(calls.select("src", "method", "type").distinct(), "open"), None
    d = defines.distinct().select(F.col("type").alias("super"), "method", F.lit(True).alias("_d"))
    for depth in range(1, levels + 1):
        up = open_.join(supers.select("type", "super").distinct(), "type").select("src", "method", "super").distinct()
        up = s.save(up.join(d, ["super", "method"], "left"), "up")
        hit = up.where("_d").groupBy("src", "method").agg(F.min("super").alias("dst")).withColumn("depth", F.lit(depth))
        out = hit if out is None else out.unionByName(hit)
        open_ = up.where("_d is null").join(hit.select("src", "method"), ["src", "method"], "left_anti").select("src", "method", F.col("super").alias("type"))
        if depth < levels and open_.limit(1).count() == 0:
            break
    return out.select("src", "method", "dst", "depth", F.lit(0.9).alias("confidence"))


def crawl(spark: SparkSession, seeds: DataFrame, links: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """(site, url, depth) in the order of a breadth-first visit: no address twice, ``depth`` at most, ``budget`` requests a site.

    ``links`` (site, url, to) are those of the pages, normalised; a budget of
    None has no bound.  Within a level addresses go in their order.
    """
    s = Scratch(spark, "crawl")
    level = s.save(seeds.select("site", "url").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    for k in range(1, depth + 1):
        nxt = level.select("site", "url").join(links, ["site", "url"]).select("site", F.col("to").alias("url")).distinct()
        level = s.save(nxt.join(seen.select("site", "url"), ["site", "url"], "left_anti").withColumn("depth", F.lit(k)), "level")
        if level.limit(1).count() == 0:
            break
        seen = seen.unionByName(level)
    if budget is None:
        return seen
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("depth", "url"))).where(F.col("_n") <= budget).drop("_n")


def html_links(html: Column, base: Column, host: Column) -> Column:
    """Absolute links of a page that stay on the host: no fragment, no assets, duplicates kept."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1))
    root = F.concat(F.lit("https://"), host)
    here = F.regexp_replace(base, r"[^/]*$", "")
    full = F.transform(found, lambda u: F.when(u.rlike("^https?://"), u).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(here, u)))
    return F.filter(full, lambda u: u.startswith(F.concat(root, F.lit("/"))) & ~u.rlike(r"(?i)\.(?:png|jpe?g|gif|svg|ico|css|js|woff2?|ttf|eot|pdf|zip|gz|tar|mp4|mp3|webp|xml|json)$"))


#: Elements that are dropped whole, and those that make a block of their own (fixed values).
DROPPED = ("nav", "footer", "header", "aside", "script", "style", "noscript", "svg", "iframe")
BLOCKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### ", "p": "", "li": "- ", "blockquote": "> ", "pre": ""}


def markdown_of(html: str) -> str:
    """The blocks of a page as markdown; of nested blocks the outermost counts."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.text, self.block, self.depth, self.off = [], [], None, 0, 0

        def handle_starttag(self, tag, attrs):
            if tag in DROPPED:
                self.off += 1
            elif not self.off and self.block is None and tag in BLOCKS:
                self.block, self.depth, self.text = tag, 1, []
            elif self.block == tag:
                self.depth += 1

        def handle_endtag(self, tag):
            if tag in DROPPED:
                self.off = max(0, self.off - 1)
            elif self.block == tag:
                self.depth -= 1
                if self.depth == 0:
                    self.close_block()

        def handle_data(self, data):
            if self.block is not None and not self.off:
                self.text.append(data)

        def close_block(self):
            text = "".join(self.text)
            text = "```\n" + text.strip("\n") + "\n```" if self.block == "pre" else " ".join(text.split())
            if text.strip():
                self.out.append(BLOCKS[self.block] + text)
            self.block = None

    r = Reader()
    r.feed(html)
    r.close()
    if r.block is not None:
        r.close_block()
    return "\n\n".join(r.out)


def html_to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, markdown) of pages, by Arrow batches; a null page is empty."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [markdown_of(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "markdown"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, markdown string")
