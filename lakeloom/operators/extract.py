"""Extraction of chunks, imports and calls from sources, and resolution of calls to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def python_chunks(files: DataFrame) -> DataFrame:
    """(id, kind, name, fqn, parent_fqn, start_line, end_line, doc, is_async) of Python files by their syntax tree.

    A file that does not parse, or whose content is null, has no rows.
    """
    import pandas as pd

    def run(batches):
        import ast
        import warnings

        warnings.simplefilter("ignore")
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["content"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                stack = [(tree, "")]
                while stack:
                    node, scope = stack.pop()
                    for c in ast.iter_child_nodes(node):
                        if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            kind = "class" if isinstance(c, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                            fqn = f"{scope}.{c.name}" if scope else c.name
                            rows.append((key, kind, c.name, fqn, scope or None, c.lineno, c.end_lineno, ast.get_docstring(c), isinstance(c, ast.AsyncFunctionDef)))
                            stack.append((c, fqn))
                        else:
                            stack.append((c, scope))
            yield pd.DataFrame(rows, columns=["id", "kind", "name", "fqn", "parent_fqn", "start_line", "end_line", "doc", "is_async"])

    return files.mapInPandas(run, "id string, kind string, name string, fqn string, parent_fqn string, start_line int, end_line int, doc string, is_async boolean")


#: Import statements by language, the imported module in the first group (fixed values).
IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+)\s*;?\s*$|use\s+([\w:]+)|using\s+([\w.]+)\s*;|import\s+.*?from\s+['\"]([^'\"]+)['\"]|import\s+\"([^\"]+)\"|.*\brequire\(['\"]([^'\"]+)['\"]\))"


def imports(files: DataFrame) -> DataFrame:
    """(id, module_path, target): one row per distinct import of a file."""
    lines = files.select("id", "module_path", F.explode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(0))).alias("line"))
    target = F.coalesce(*[F.nullif(F.regexp_extract("line", IMPORT, i), F.lit("")) for i in range(1, 8)])
    return lines.select("id", "module_path", target.alias("target")).where("target is not null").distinct()


#: Words before a parenthesis that call nothing (fixed values).
NO_CALL = ("if", "for", "while", "switch", "catch", "return", "match", "with", "def", "fn", "func", "function", "sizeof", "typeof", "and", "or", "not", "in", "lambda", "print", "super", "await", "throw")


def calls(functions: DataFrame) -> DataFrame:
    """(id, callee, receiver, n): distinct calls in the text of a function, without its own name."""
    found = functions.select("id", "name", F.explode(F.regexp_extract_all("content", F.lit(r"(?:[A-Za-z_]\w*(?:\.|::|->))?[A-Za-z_]\w*\s?\("), F.lit(0))).alias("c"))
    parts = F.regexp_extract("c", r"^(?:([A-Za-z_]\w*)(?:\.|::|->))?([A-Za-z_]\w*)\s?\($", 2), F.regexp_extract("c", r"^(?:([A-Za-z_]\w*)(?:\.|::|->))?([A-Za-z_]\w*)\s?\($", 1)
    found = found.withColumns({"callee": parts[0], "receiver": parts[1]}).where(~F.col("callee").isin(*NO_CALL) & (F.col("callee") != F.coalesce("name", F.lit(""))))
    return found.groupBy("id", "callee", "receiver").agg(F.count(F.lit(1)).alias("n"))


def resolve_calls(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, dst, confidence, method) of calls: the first tier that knows exactly one target.

    type_qualified: the receiver names the type that holds the method (0.9);
    same_file: the name stands once in the file (0.8); heuristic: it stands once
    in the repository (0.6).  Ambiguous names resolve to nothing in a tier.
    """
    defs = chunks.where("chunk_type in ('function', 'method')").select("id", "repo_name", "module_path", "name", F.regexp_extract("parent_fqn", r"([^.:]+)$", 1).alias("owner"))
    src = chunks.select(F.col("id"), F.col("repo_name").alias("repo"), F.col("module_path").alias("path"))
    e = edges.join(src, "id").withColumnRenamed("id", "src")

    def tier(keys: list[str]) -> DataFrame:
        return defs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.min("id").alias("_d")).where("_k = 1").drop("_k")

    a = tier(["repo_name", "owner", "name"]).select(F.col("repo_name").alias("repo"), F.col("owner").alias("receiver"), F.col("name").alias("callee"), F.col("_d").alias("d1")).where("receiver <> ''")
    b = tier(["repo_name", "module_path", "name"]).select(F.col("repo_name").alias("repo"), F.col("module_path").alias("path"), F.col("name").alias("callee"), F.col("_d").alias("d2"))
    c = tier(["repo_name", "name"]).select(F.col("repo_name").alias("repo"), F.col("name").alias("callee"), F.col("_d").alias("d3"))
    j = e.join(a, ["repo", "receiver", "callee"], "left").join(b, ["repo", "path", "callee"], "left").join(c, ["repo", "callee"], "left")
    hit: Column = F.coalesce(*[F.when(F.col(d).isNotNull(), F.struct(F.col(d).alias("dst"), F.lit(w).alias("confidence"), F.lit(m).alias("method"))) for d, w, m in (("d1", 0.9, "type_qualified"), ("d2", 0.8, "same_file"), ("d3", 0.6, "heuristic"))])
    j = j.select("src", hit.alias("h")).where("h is not null").select("src", "h.*").where("src <> dst")
    return j.groupBy("src", "dst").agg(F.max(F.struct("confidence", "method")).alias("h")).select("src", "dst", "h.*")


def structural_implements(methods: DataFrame) -> DataFrame:
    """(repo_name, iface, impl): types whose method names hold all those of another type of the repository."""
    m = methods.distinct()
    need = m.groupBy("repo_name", "t").agg(F.count(F.lit(1)).alias("n"))
    j = m.withColumnRenamed("t", "iface").join(m.withColumnRenamed("t", "impl"), ["repo_name", "name"]).where("iface <> impl")
    j = j.groupBy("repo_name", "iface", "impl").agg(F.count(F.lit(1)).alias("k")).join(need.withColumnRenamed("t", "iface"), ["repo_name", "iface"])
    return j.where("k = n").select("repo_name", "iface", "impl")
