"""Scalar functions of texts, paths, URLs and signatures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def github_slug(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}_\- ]", ""), F.lit(" "), F.lit("-"))


def camel_split(c: Column) -> Column:
    """A space before every capital letter but the first character."""
    return F.regexp_replace(c, r"(?<!^)(?=\p{Lu})", " ")


def _some(c: Column, most: int | None) -> Column:
    return c if most is None else F.slice(c, 1, most)


def chunk_tags(name: Column, kind: Column, most: int | None = 10) -> Column:
    """Sorted distinct lower-case words of a name longer than two bytes, with the type; ``most`` of them, None for all."""
    words = F.filter(F.split(F.lower(camel_split(F.regexp_replace(name, "[_-]", " "))), r"\s+"), lambda w: F.octet_length(w) > 2)
    return _some(F.array_sort(F.array_distinct(F.concat(words, F.array(F.lower(kind))))), most)


def section_tags(content: Column, most: int | None = 10) -> Column:
    """Identifiers in back-ticks, lower case, in order of appearance; ``most`` of them, None for all."""
    return _some(F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit("`([A-Za-z_][A-Za-z0-9_:]*)`"), F.lit(1)), F.lower)), most)


def skill_name(c: Column) -> Column:
    """Lower-case letters and digits of ASCII, all else one dash; 64 at most."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, 64), "-+$", "")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the ASCII bytes and two for each other character."""
    ascii_only = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return (F.floor(ascii_only / 4) + 2 * (F.length(c) - ascii_only)).cast("long")


def normalize_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/$", "")


def url_title(c: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(c, "^[a-z]+://[^/]*", ""), "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("index"))


def version_of_url(c: Column) -> Column:
    """The first segment or dashed part that is v and a number."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[/\-])(v\d+(?:\.\d+)*)(?:$|[/\-])", 1), F.lit(""))


def glob_to_regex(pattern: str) -> str:
    """A pattern in which only the star is special, anchored at both ends."""
    import re

    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def encode_path(c: Column) -> Column:
    """Percent-encoding that keeps unreserved characters and slashes."""
    coded = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def safe_path(c: Column) -> Column:
    """Relative, without parent segments, drive letters or NUL."""
    return ~(c.startswith("/") | c.rlike(r"(^|/)\.\.(/|$)") | c.rlike(r"^[A-Za-z]:") | c.contains("\x00") | (F.length(c) == 0))


def wikitext_to_text(c: Column) -> Column:
    rules = [
        (r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:File|Image|Category):[^\]]*\]\]", ""),
        (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"\[https?://\S+ ([^\]]*)\]", "$1"), (r"'''?", ""), (r"(?m)^(=+)\s*(.*?)\s*\1\s*$", "$2"), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n"),
    ]
    for a, b in rules:
        c = F.regexp_replace(c, a, b)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def base_type(c: Column) -> Column:
    """A type's plain name: no reference, lifetime, generics or path."""
    c = F.regexp_replace(F.trim(c), r"^(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?(?:dyn\s+)?", "")
    c = F.trim(F.regexp_replace(c, r"<.*$", ""))
    return F.regexp_replace(c, r"^.*::", "")


def return_type(signature: Column) -> Column:
    """What stands after the arrow of a signature's first line."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(signature, r"^[^\n]*?\)\s*->\s*([^\n]+?)\s*(?:\{|:|where\b|$)", 1), r"\s+$", "")), F.lit(""))


def go_receiver(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"func\s*\(\s*\w*\s*\*?\s*(\w+)\s*\)", 1), F.lit(""))


def entry_point(content: Column, name: Column, language: Column) -> Column:
    """main, test, api_handler, event_listener or null; the first rule that holds."""
    lang = F.lower(F.coalesce(language, F.lit("")))
    return (
        F.when((lang == "rust") & (name == "main"), "main")
        .when((lang == "rust") & content.rlike(r"#\[(?:tokio::)?test"), "test")
        .when((lang == "rust") & content.rlike(r"#\[(?:get|post|put|delete)\("), "api_handler")
        .when(lang.isin("typescript", "javascript") & content.rlike(r"\b(?:app|router)\.(?:get|post|put|delete)\("), "api_handler")
        .when(lang.isin("typescript", "javascript") & content.rlike(r"\.(?:on|addEventListener)\("), "event_listener")
        .when(lang.isin("typescript", "javascript") & content.startswith("export default"), "module_entry")
        .when((lang == "python") & (name == "main"), "main")
        .when((lang == "python") & name.startswith("test_"), "test")
        .when((lang == "go") & (name == "main"), "main")
    )


#: File names of manifests, and of files that a program begins with (fixed values).
MANIFESTS = ("package.json", "cargo.toml", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "composer.json", "gemfile")
ENTRIES = ("main.rs", "lib.rs", "main.go", "main.py", "__init__.py", "index.ts", "index.js", "mod.rs", "app.py", "main.ts", "main.java")


def file_priority(path: Column) -> Column:
    """1 manifests and markdown, 2 headers, 3 entry files, 4 the rest."""
    b = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return F.when(b.isin(*MANIFESTS) | b.endswith(".md") | b.endswith(".rst"), 1).when(b.endswith(".h") | b.endswith(".hpp") | b.endswith(".d.ts"), 2).when(b.isin(*ENTRIES), 3).otherwise(4)


#: File endings and the extractor that reads them; the first that fits counts (fixed values).
EXTRACTORS = (
    (".d.ts", "typescript"), (".tsx", "tsx"), (".ts", "typescript"), (".mjs", "javascript"), (".jsx", "javascript"), (".js", "javascript"), (".py", "python"), (".rs", "rust"), (".go", "go"), (".java", "java"), (".cs", "csharp"),
    (".kt", "kotlin"), (".rb", "ruby"), (".php", "php"), (".swift", "swift"), (".scala", "scala"), (".lua", "lua"), (".dart", "dart"), (".hpp", "cpp"), (".cpp", "cpp"), (".cc", "cpp"), (".h", "c"), (".c", "c"), (".sh", "bash"),
    (".vue", "vue"), (".md", "markdown"), (".tf", "hcl"), ("dockerfile", "dockerfile"), ("makefile", "makefile"), ("package.json", "package_json"), ("cargo.toml", "cargo_toml"), ("pyproject.toml", "pyproject_toml"), (".gitlab-ci.yml", "gitlab_ci"),
)


def extractor(path: Column) -> Column:
    p = F.lower(path)
    return F.coalesce(*[F.when(p.endswith(e), F.lit(x)) for e, x in EXTRACTORS], F.lit("fallback"))


def http_method(c: Column) -> Column:
    m = F.regexp_replace(F.upper(c), "MAPPING$", "")
    return F.when(m.isin("REQUEST", "ROUTE", ""), "ANY").otherwise(m)


def url_path(c: Column) -> Column:
    """The path of a URL; null where part of it is interpolated."""
    p = F.regexp_replace(F.regexp_replace(c, r"^[a-z][a-z0-9+.]*://[^/]*", ""), r"[?#].*$", "")
    return F.when(~c.rlike(r"\$\{|\{\{|%s"), F.when(p == "", "/").otherwise(p))


def normal_text(c: Column) -> Column:
    """Lower case with white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def version_header(c: Column) -> Column:
    """Struct (major, minor, patch) of a header's defines, null if one of them is missing."""
    part = [F.nullif(F.regexp_extract(c, rf"(?m)^\s*#\s*define\s+\w*{p}\s+(\d+)", 1), F.lit("")).cast("int") for p in ("MAJOR", "MINOR", "PATCH")]
    return F.when(part[0].isNotNull() & part[1].isNotNull() & part[2].isNotNull(), F.struct(*[p.alias(n) for p, n in zip(part, ("major", "minor", "patch"))]))


def file_route(path: Column) -> Column:
    """The route that a file's place stands for: groups in parentheses and an index are left out; null for other files."""
    svelte = F.regexp_extract(path, r"(?:^|/)routes/(.*?)/?\+(?:page|server)\.[^/]*$", 1)
    nuxt = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)pages/(.*)\.vue$", 1), r"(^|/)index$", "")
    of = lambda p: F.concat(F.lit("/"), F.array_join(F.filter(F.split(p, "/"), lambda x: (x != "") & ~x.rlike(r"^\(.*\)$")), "/"))
    return F.when(path.rlike(r"(?:^|/)routes/.*\+(?:page|server)\."), of(svelte)).when(path.rlike(r"(?:^|/)pages/.*\.vue$"), of(nuxt))


def dyn_trait(c: Column) -> Column:
    """The trait of ``dyn T``, plain or in a pointer; null for other types."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"^\s*(?:&\s*(?:'\w+\s+)?(?:mut\s+)?|(?:\w+::)*(?:Box|Arc|Rc)<\s*)?dyn\s+([\w:]+)", 1), r"^.*::", ""), F.lit(""))
