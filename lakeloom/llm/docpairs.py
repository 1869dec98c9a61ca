"""Functions paired with their documentation.

Source texts are lexed in the JVM and exploded into token rows.  Windows
over the rows of a text do the rest: running sums give every token its place,
its depth of braces and of parentheses; the tokens of one depth are cut into
statements, so a header is a statement of any length that ends with its block,
its arrow or its sign; running sums over code and blank lines number islands of
comments, so a comment belongs to the header that ends its island; the statement
after a header may be its docstring.  A function ends where the braces of its block
close, where a line is indented no deeper, or with its statement.  Documentation
counts if it says something: at least four words that are no part of the
function's name, no marker, directive, separator, bare tag, pointer, notice or
disabled code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch

LEAST_WORDS = 4

#: Ways of writing comments and strings, by a file's ending (fixed values).  Files of other endings go by their
#: language, else as those with braces.
HASH_EXT = ("py", "pyi", "pyx", "sh", "bash", "zsh", "fish", "rb", "pl", "pm", "r", "tcl", "ex", "exs", "jl", "nim", "coffee", "cr", "ps1", "mk", "cmake", "gd")
DASH_EXT = ("lua", "hs", "elm", "sql", "adb", "ads", "vhd", "vhdl")
#: Single quotes are strings here; elsewhere they hold one character, or begin a lifetime.
QUOTE_EXT = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "vue", "svelte", "php", "dart", "groovy", "gradle", "css", "scss", "less", "html", "htm")
CHAR_EXT = ("rs", "go", "java", "kt", "kts", "c", "h", "cc", "cpp", "cxx", "hh", "hpp", "cs", "swift", "scala", "m", "mm", "zig", "proto", "d", "v", "sol")
#: Files of prose, data and settings, which have no functions.
TEXT_EXT = ("md", "markdown", "rst", "txt", "adoc", "json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "lock", "xml", "csv", "tsv", "properties", "config", "tf", "hcl", "log", "po", "svg")
#: Of the files with hashes, those in which braces hold values and may go over lines.
BRACES_ARE_VALUES = ("py", "pyi", "pyx", "nim", "jl", "coffee", "gd")

# All repetitions are possessive: the JVM's matcher then needs no stack.
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'"
_GAP = r"\n[ \t\r\n]*+"
_C_COMMENTS = r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*+|"
_C_REST = r"|`[^`]*+`|" + _GAP + r"|[{}]|[^\n{};" + "\"'`/" + r"]*+;|[^\n{};" + "\"'`/" + r"]++|[" + "\"'`/" + "]"
LEXERS = {
    "quote": _C_COMMENTS + _DOUBLE + "|" + _SINGLE + _C_REST,
    "char": _C_COMMENTS + _DOUBLE + "|" + _CHAR + _C_REST,
    "hash": r'(?s)[rRbBuUfF]{0,2}+(?:""".*?(?:"""|\z)' + r"|'''.*?(?:'''|\z))|#[^\n]*+|" + _DOUBLE + "|" + _SINGLE + "|" + _GAP + r"|[{}]|[^\n{}#" + "\"'" + r"]++|[" + "\"'" + "]",
    "dash": r"(?s)--\[\[.*?(?:\]\]|\z)|--[^\n]*+|" + _DOUBLE + "|" + _SINGLE + "|" + _GAP + r"|[{}]|[^\n{}\-" + "\"'" + r"]++|[\-" + "\"'" + "]",
}

#: Words that begin no type, or stand before a parenthesis without being a function's name (fixed values).
_CONTROL = "if|for|while|switch|catch|return|else|do|try|match|with|lock|using|foreach|synchronized|when|new|throw|await|super|this|typeof|sizeof|function|fn|func|loop|unless|until|assert|print|defer|go|select|case|in|of|and|or|not|yield|delete|echo|raise|import|from|package|goto|break|continue"
_NO_TYPE = _CONTROL + "|class|interface|enum|struct|record|object|trait|impl|namespace|module|extends|implements"
_MODIFIERS = r"(?:(?!(?:" + _NO_TYPE + r")\b)[\w.<>\[\],?&*:@]++(?:\([^()]*\))? )*+"
_ARROW = r"(?:async ?)?(?:<[^<>]*> ?)?(?:\(.*?\)|[A-Za-z_$][\w$]*) ?(?::[^=]+)?=>"
#: A function's header by its beginning.
HASH_HEADER = r"^(?:async )?(?:def|sub|local function|function) ?([A-Za-z_][\w.:\-]*[?!]?)|^([A-Za-z_][\w.\-]*) ?\( ?\)(?: ?\{.*)?$"
_KEYWORD = r"^(?:[\w()]+ )*?fn ([A-Za-z_]\w*)|^func (?:\([^()]*\) ?)?([A-Za-z_]\w*) ?[(\[<]|^(?:export )?(?:default )?(?:async )?(?:[\w]+ )*?function ?\*? ?&?([A-Za-z_$][\w$]*)|^(?:[\w@]+ )*?fun (?:<[^<>]*> )?(?:[\w<>?, ]+\.)?([A-Za-z_]\w*) ?\("
BRACE_HEADER = (
    rf"(?s){_KEYWORD}|^(?:export )?(?:const|let|var) ([A-Za-z_$][\w$]*) ?(?::[^=]+)?= ?(?:{_ARROW}|(?:async )?function)|^(?:(?:public|private|protected|static|readonly) )*([A-Za-z_$#][\w$]*) ?(?::[^=]+)?= ?{_ARROW}"
    rf"|^{_MODIFIERS}(?!(?:{_CONTROL})\b)([A-Za-z_$~#][\w$]*) ?(?:<[^<>()]*>)? ?\(.*\)[^;=]*\{{$"
)
#: Headers without a block: an arrow, a keyword, a type after or before the name.
ARROW_HEADER = rf"(?s)^(?:export )?(?:const|let|var) ([A-Za-z_$][\w$]*) ?(?::[^=]+)?= ?{_ARROW}|^{_MODIFIERS}(?!(?:{_CONTROL})\b)([A-Za-z_]\w*) ?(?:<[^<>()]*>)? ?\([^()]*\) ?=>"
OPEN_HEADER = rf"(?s){_KEYWORD}|^{_MODIFIERS}(?!(?:{_CONTROL})\b)([A-Za-z_$][\w$]*) ?(?:<[^<>()]*>)? ?\([^()]*(?:\([^()]*\)[^()]*)*\) ?(?::[^;=]+|throws [^;=]+|const)?;$"
_CALL = r"^[\w$.]+ ?(?:<[^<>()]*>)? ?\(.*\) ?;$"
#: Nothing but annotations, or the beginning of one whose arguments follow.
_ANNOTATION = r"^\s*(?:@[\w.]+\s*(?:\([^()]*\))?\s*)+$|^\s*@[\w.]+\s*\([^()]*$|^\s*#!?\[[^\]]*\]?\s*$|^\s*\[[A-Z]\w*[^\]]*\]?\s*$"
#: A line that goes on with the statement of the line before: by its beginning, or by that line's end.
_GOES_ON = r"^\s*(?:\{|\.|\?\.|=>|->|=|:|,|\)|&&|\|\||\+|\?|where\b|throws\b|extends\b|implements\b|override\b|noexcept\b)"
_NOT_DONE = r"(?:[,(=:.+?&|<]|=>|->|\bwhere)\s*$"


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    """The first group that is filled in a match, null without a match."""
    parts = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, groups + 1)]
    return F.coalesce(*parts)


def texts(chunks: DataFrame) -> DataFrame:
    """(id, in_file, name, lexer, values, text) of functions, methods and files of code, one row per id; a null content is none."""
    ext = F.lower(F.regexp_extract("module_path", r"\.([A-Za-z0-9]+)$", 1))
    lang = F.coalesce(F.lower("language"), F.lit(""))
    lexer = (
        F.when(ext.isin(*HASH_EXT), "hash").when(ext.isin(*DASH_EXT), "dash").when(ext.isin(*QUOTE_EXT), "quote").when(ext.isin(*CHAR_EXT), "char")
        .when(lang.isin("python", "bash", "shell", "ruby", "perl", "r", "elixir", "julia"), "hash").when(lang.isin("lua", "haskell", "sql"), "dash").when(lang.isin("javascript", "typescript", "php", "dart"), "quote").otherwise("char")
    )
    values = ext.isin(*BRACES_ARE_VALUES) | (lang == "python")
    in_file = F.col("chunk_type") == "file"
    rows = chunks.where("id is not null and content is not null and chunk_type in ('function', 'method', 'file')").where(~in_file | F.coalesce(~ext.isin(*TEXT_EXT), F.lit(True)))
    rows = rows.select("id", F.struct(in_file.alias("in_file"), F.when(~in_file, F.col("name")).alias("name"), lexer.alias("lexer"), values.alias("values"), F.regexp_replace("content", "\r\n", "\n").alias("text")).alias("c"))
    return rows.groupBy("id").agg(F.first("c").alias("c")).select("id", "c.*")


def tokens(one: DataFrame) -> DataFrame:
    """Token rows (id, in_file, name, braces, values, pos, token, kind) of the texts; together they are the text.

    kind: C comment, S string, G gap with line ends, { and }, B blank, X other code.
    """
    lexed = None
    for name, pattern in LEXERS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        lexed = F.when(F.col("lexer") == name, found) if lexed is None else lexed.when(F.col("lexer") == name, found)
    out = one.select("id", "in_file", "name", F.col("lexer").isin("quote", "char").alias("braces"), "values", "lexer", F.posexplode(lexed).alias("pos", "token"))
    t, head = F.col("token"), F.substring("token", 1, 1)
    kind = (
        F.when(head == "\n", "G")
        .when(F.col("braces") & (head == "/") & (t.startswith("//") | t.startswith("/*")), "C")
        .when((F.col("lexer") == "hash") & (head == "#"), "C")
        .when((F.col("lexer") == "dash") & t.startswith("--"), "C")
        .when(t.isin("{", "}"), t)
        .when(head.isin(*"rRbBuUfF\"'`") & (t.rlike(r"""(?s)^[rRbBuUfF]{0,2}["'`].*["'`]$""") | t.rlike("""^[rRbBuUfF]{0,2}(?:\"\"\"|''')""")), "S")
        .when(F.trim(t) == "", "B")
        .otherwise("X")
    )
    return out.withColumn("kind", kind).drop("lexer")


def units(toks: DataFrame) -> DataFrame:
    """One row per statement: text with strings emptied, first token, place, block and the comments above.

    The tokens of one depth of braces are a row of statements; a block is seen
    there as the brace that closes it.  A statement ends with its block, its
    sign, or its line, unless the next one goes on with it.  Comments and
    annotations before a statement are counted to it; the comments that stand
    above it without code or a blank line in between are its documentation.
    """
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.length("token") - F.length(F.replace(F.col("token"), F.lit(c)))
    kind, code, values = F.col("kind"), F.col("kind") == "X", F.col("values")
    block = F.col("braces") & kind.isin("{", "}")
    step = F.when(block, F.when(kind == "{", 1).otherwise(-1)).otherwise(0)
    # Where braces hold values, brackets and braces count as parentheses.
    parens = F.when(code, count("(") - count(")") + F.when(values, count("[") - count("]")).otherwise(0)).when(values & (kind == "{"), 1).when(values & (kind == "}"), -1).otherwise(0)
    rows = toks.withColumn("parens", parens).withColumns({"to": F.sum(F.length("token")).over(w), "level": F.sum(step).over(w), "pc": F.sum("parens").over(w)})
    own = Window.partitionBy("id", "level").orderBy("pos")
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = block & (kind == "{"), block & (kind == "}")
    solid = kind.isin("X", "S", "{", "}") & ~opens
    base = F.coalesce(F.last(F.when(opens, F.col("pc")), ignorenulls=True).over(before), F.lit(0))
    rows = rows.withColumns({
        "rel": F.col("pc") - F.col("parens") - base, "after": F.col("pc") - base, "solid": solid, "opens": opens, "closes": closes, "last_kind": F.lag("kind").over(own), "last_but_one": F.lag("kind", 2).over(own),
        "gap": F.last(F.when(kind == "G", F.struct("pos", F.length(F.regexp_extract("token", r"\n([ \t]*)$", 1)).alias("indent"))), ignorenulls=True).over(before),
    })
    done = F.col("opens") | ((F.col("after") <= 0) & F.col("braces") & (F.col("closes") | (code & F.col("token").endswith(";"))))
    rows = rows.withColumn("prev", F.last(F.when(F.col("solid") | F.col("opens"), F.struct("pos", F.coalesce(done, F.lit(False)).alias("done"), (code & F.col("token").rlike(_NOT_DONE)).alias("open"))), ignorenulls=True).over(before))
    line = (F.col("gap.pos") > F.col("prev.pos")) & (F.col("rel") <= 0)
    goes_on = F.col("braces") & (F.col("prev.open") | F.col("closes") | F.col("token").rlike(_GOES_ON))
    starts = F.col("solid") & (F.col("prev").isNull() | F.coalesce(F.col("prev.done"), F.lit(False)) | (F.coalesce(line, F.lit(False)) & ~F.coalesce(goes_on, F.lit(False))))
    rows = rows.withColumn("starts", starts)
    note = F.coalesce(F.last(F.when(F.col("starts"), code & F.col("token").rlike(_ANNOTATION)), ignorenulls=True).over(upto), F.lit(False)) & F.col("solid") & ~F.col("closes")
    rows = rows.withColumn("note", note)
    blank = (kind == "G") & F.col("token").rlike(r"\n[ \t\r]*\n")
    begun = F.sum(F.when(F.col("starts") & ~F.col("note"), 1).otherwise(0)).over(upto)
    breaks = F.sum(F.when(F.col("opens") | blank | (F.col("solid") & ~F.col("note")), 1).otherwise(0)).over(before)
    fresh = F.coalesce(F.col("last_kind"), F.lit("G")).isin("G", "C", "{") | ((F.col("last_kind") == "B") & F.coalesce(F.col("last_but_one"), F.lit("G")).isin("G", "C", "{"))
    rows = rows.withColumns({"unit": begun + F.when((kind == "C") | F.col("note"), 1).otherwise(0), "island": F.coalesce(breaks, F.lit(0)), "comment": (kind == "C") & fresh})
    rows = rows.where("(solid and not note) or comment")
    part = F.when(kind == "S", F.lit('""')).when(F.col("closes"), F.lit("{")).otherwise(F.col("token"))
    main = F.col("solid") & ~F.col("note")
    out = rows.groupBy("id", "in_file", "name", "braces", "level", "unit").agg(
        F.min(F.when(main, F.struct("pos", (F.col("to") - F.length("token")).alias("at"), "island", F.coalesce("gap.indent", F.lit(0)).alias("indent"), "kind", F.when(kind == "S", F.col("token")).alias("string")))).alias("first"),
        F.max(F.when(main, F.struct("pos", "to", ((F.col("after") <= 0) & F.col("closes")).alias("block")))).alias("end"), F.count_if(main).alias("n"),
        F.array_sort(F.collect_list(F.when(main, F.struct("pos", part.alias("t"))))).alias("parts"), F.array_sort(F.collect_list(F.when(F.col("comment"), F.struct("pos", "island", "token")))).alias("above"),
    ).where("first is not null")
    text = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["t"]), " "), r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r" ?([(),;]) ?", "$1"), r"^(?:@[\w.]+(?:\([^()]*\))? |#!?\[[^\]]*\] ?|\[[A-Z][^\]]*\] ?)+", "")
    doc = F.array_join(F.transform(F.filter("above", lambda x: x["island"] == F.col("first.island")), lambda x: x["token"]), "\n")
    return out.select(
        "id", "in_file", "name", "braces", "level", "unit", F.col("first.pos").alias("pos"), F.col("first.at").alias("at"), F.col("end.to").alias("to"), F.col("end.block").alias("block"), F.col("first.indent").alias("indent"),
        F.when(F.col("n") == 1, F.col("first.string")).alias("string"), text.alias("text"), F.nullif(doc, F.lit("")).alias("doc"),
    )


def functions(stmts: DataFrame) -> DataFrame:
    """The statements that are a function's header, as (id, name, in_file, braces, pos, at, end, indent, doc, docstring).

    end: the end of a function with braces; null for one that ends by its
    indentation or with the text.  A chunk that is a function is all code and
    has one header, its first code.
    """
    t = F.col("text")
    blocked = F.when(F.col("block"), _first_group(t, BRACE_HEADER, 7))
    arrow = F.when(t.contains("=>"), _first_group(t, ARROW_HEADER, 2))
    open_ = F.when(~t.rlike(_CALL), _first_group(t, OPEN_HEADER, 5))
    named = F.when(F.col("braces"), F.coalesce(blocked, F.when(~F.col("block"), F.coalesce(arrow, open_)))).otherwise(_first_group(t, HASH_HEADER, 2))
    fn = F.when(F.col("in_file"), F.when(t.rlike(r"\w"), named)).otherwise(F.when((F.col("level") == 0) & (F.col("unit") == 1), F.col("name")))
    following = F.lead("string").over(Window.partitionBy("id").orderBy("pos"))
    docstring = F.when(~F.col("braces") & t.rlike(":$"), following)
    end = F.when(F.col("in_file") & F.col("braces"), F.col("to"))
    at = F.when(F.col("in_file"), F.col("at")).otherwise(0)
    out = stmts.withColumns({"fn": fn, "docstring": docstring}).where("fn is not null")
    return out.select("id", F.col("fn").alias("name"), "in_file", "braces", "pos", at.cast("long").alias("at"), end.cast("long").alias("end"), "indent", "doc", "docstring")


def documented(fns: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, name, at, end, indent, doc) of each text that may be a function's documentation: above, inside, or in the column ``doc``."""
    both = fns.select("id", "name", "at", "end", F.when(F.col("in_file") & ~F.col("braces"), F.col("indent")).alias("indent"), F.explode(F.array("doc", "docstring")).alias("doc")).where("doc is not null")
    column = chunks.where("id is not null and name is not null and chunk_type in ('function', 'method') and length(trim(doc)) > 0")
    column = column.select("id", "name", F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("int").alias("indent"), "doc")
    return both.unionByName(column)


# --- what a documentation says ---------------------------------------------

_EDGE = re.compile(r"^\s*(?:///?|//!|/\*+!?|\*+/?|#+!?|--(?:\[\[)?-?|;+|[rRbBuUfF]{0,2}(?:\"\"\"|'''|\"|'))?\s?|\s*(?:\*+/|\"\"\"|'''|(?<=[.\w ])[\"'])\s*$")
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
#: Lines that describe nothing (fixed values).
_NOTHING = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|hack|bug|tbd|wip|note to self)\b|^\W*(?:noqa|pylint|flake8|mypy|type:\s*ignore|pragma|fmt:|isort|eslint|tslint|jshint|jslint|prettier|@ts-|istanbul|c8 ignore|nolint|go:|lint:|rustfmt|clippy|shellcheck|sonar|nosec|codeql|noinspection|"
    r"suppress|checkstyle|pmd|resharper|region\b|endregion\b|swiftlint|phpcs|rubocop|coverage:|-\*-|vim:|spdx)|"
    r"\b(?:licen[cs]ed under|licen[cs]e:|copyright|all rights reserved|©|\(c\) \d{4})|\{?@?inherit_?doc\}?|^\W*(?:see (?:above|below|also\b.*|the (?:interface|parent|base|super)\w*.*|@?[\w.#:]+\W*)|same as .*|as above|ditto|refer to .*|@see .*|@link .*|\{@link .*)\W*$|auto-?generated (?:method|function|constructor|stub)|^\W*(?:n/?a|none|empty|undocumented|no description)\W*$"
)
_PARAM = re.compile(r"(?i)^\W*(?:[@\\:](?:params?|arg(?:ument)?s?|tparam|typeparam|returns?|raises?|throws?|exception|type|rtype|yields?|since|author|version|deprecated|category|module|private|public|internal|override|async|static|template)\b|(?:args?|arguments|parameters|params|returns?|raises|throws|yields|example|examples|usage|notes?)\s*:|[-=~]{3,})(.*)$")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:let|var|const|return|if|for|while|import|from|def|fn|func|print|auto|int|else)\b.*[=(;:{]|^\s*[\w.\[\]]+\s*(?:[-+*/|&]?=|:=)\s*\S+.*$|^\s*[\w.]+\([^)]*\);?\s*$|=>|->\s*\w+\s*\{|</?\w+[^>]*>$")
_WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def name_words(name: str) -> set[str]:
    """Lower-case words of a name in camel, pascal, snake or kebab case, and the whole."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)
    return {p.lower() for p in parts} | {name.lower(), name.lower().replace("_", "")}


def description(doc: str) -> str:
    """The describing lines of a comment or docstring, without its signs."""
    out = []
    for line in doc.replace("\r", "").split("\n"):
        line = _EDGE.sub("", line)
        line = _TAGS.sub(" ", _EDGE.sub("", line)).strip()
        if not line or _NOTHING.search(line):
            continue
        tag = _PARAM.match(line)
        if tag:
            continue
        if _CODE.search(line) and not re.search(r"[a-z] [a-z]+ [a-z]+ [a-z]+", re.sub(r"\(.*?\)", "", line)):
            continue
        out.append(line)
    return "\n".join(out)


def said(doc: str, name: str) -> int:
    """Words of description beyond the function's name."""
    text = description(doc)
    own = name_words(name)
    n = sum(1 for w in _WORDS.findall(_CJK.sub(" ", text)) if w.lower() not in own)
    return n + len(_CJK.findall(text)) // 2


def telling(candidates: DataFrame) -> DataFrame:
    """The candidates whose documentation says something, with its describing text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, docs = b.column("name").to_pylist(), b.column("doc").to_pylist()
            keep = [said(d, n) >= LEAST_WORDS for n, d in zip(names, docs)]
            b = b.filter(pa.array(keep, pa.bool_()))
            text = [description(d) for d in b.column("doc").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "name", "at", "end", "indent")), pa.array(text, pa.string())], ["id", "name", "at", "end", "indent", "description"])

    return candidates.select("id", "name", "at", "end", "indent", "doc").mapInArrow(run, "id string, name string, at long, end long, indent int, description string")


def found(chunks: DataFrame) -> DataFrame:
    """Distinct (id, name) of the functions with telling documentation."""
    return telling(documented(functions(units(tokens(texts(chunks)))), chunks)).select("id", "name").distinct()


def pairs(chunks: DataFrame) -> DataFrame:
    """(id, name, code, description): one row per function with telling documentation.

    The code is cut out of the text by the function's place.  A function without
    braces ends before the next statement that is indented no deeper.  A function
    chunk without content has a null code.
    """
    one = texts(chunks)
    stmts = Scratch(chunks.sparkSession, "docpairs").save(units(tokens(one)).drop("above"), "statements")
    docs = telling(documented(functions(stmts), chunks))
    # A function may be documented above and inside; a chunk's own header and its column are one function.
    docs = docs.groupBy("id", "name", "at").agg(F.max("end").alias("end"), F.max("indent").alias("indent"), F.max("description").alias("description"))
    lines = stmts.where("not braces and in_file").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "indent"))).alias("lines"))
    stop = F.try_element_at(F.filter("lines", lambda x: (x["at"] > F.col("at")) & (x["indent"] <= F.col("indent"))), F.lit(1))["at"]
    docs = docs.join(lines, "id", "left").withColumn("end", F.coalesce("end", stop))
    code = F.expr("substring(text, cast(at + 1 as int), cast(coalesce(end, length(text)) - at as int))")
    return docs.join(one.select("id", "text"), "id", "left").select("id", "name", code.alias("code"), "description")
