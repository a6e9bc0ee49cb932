"""Files as tables: a recursive read with ignore rules, languages by extension, whole texts, symbols of source files."""

from __future__ import annotations

import sys
import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T

# workers get this module's functions with the task: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Languages by file extension.
LANGUAGES = {"py": "python", "rs": "rust", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "sh": "bash", "md": "markdown", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "sql": "sql", "html": "html", "css": "css"}
#: How lines of an outline begin where no parser is at hand.
OUTLINE_PREFIXES = ["# ", "## ", "### ", "fn ", "pub fn ", "async fn ", "pub async fn ", "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "impl ", "class ", "def ", "async def ", "function ", "export "]


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: * and ? stay within a folder, ** goes across folders, [..] is a class."""
    out, at = "", 0
    while at < len(glob):
        rest = glob[at:]
        if rest.startswith("**/"):
            out, at = out + "(?:.*/)?", at + 3
        elif rest.startswith("**"):
            out, at = out + ".*", at + 2
        elif found := re.match(r"\[([!^]?)([^\]]+)\]", rest):
            out, at = out + f"[{'^' if found[1] else ''}{found[2]}]", at + found.end()
        elif rest.startswith("\\") and len(rest) > 1:
            out, at = out + re.escape(rest[1]), at + 2
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(rest[0], re.escape(rest[0])), at + 1
    return out


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the rules of an ignore file leave a file out: the last rule that matches it decides, a rule that begins
    with ! takes it back; if none matches, its folder decides, and so on up. A rule that ends in / is for folders only."""
    known = [r.strip() for r in rules if r.strip() and not r.strip().startswith("#")]
    if not known:
        return F.lit(False)
    parts = F.split(path, "/")

    def decision(level: Column) -> Column:
        cases = []
        for rule in reversed(known):
            body = rule.removeprefix("!")
            anchored = "/" in body.rstrip("/")
            match = level["path"].rlike(("^" if anchored else "^(?:.*/)?") + glob_pattern(body.strip("/")) + "$")
            cases.append(F.when(match & level["folder"] if body.endswith("/") else match, F.lit(not rule.startswith("!"))))
        return F.coalesce(*cases)

    levels = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), (k < F.size(parts)).alias("folder")))
    return F.coalesce(F.try_element_at(F.filter(F.transform(levels, decision), lambda x: x.isNotNull()), F.lit(1)), F.lit(False))


def visible(path: Column, rules: list[str] = (), own: str = ".tracewell") -> Column:
    """Neither hidden nor ignored nor in the engine's own folder."""
    return ~path.rlike(r"(^|/)\.[^/]") & ~ignored(path, [*rules, f"{own}/"])


def language(path: Column) -> Column:
    """By the extension; null where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(T.extension(path)))


def tracked_files(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """path (below root), language, size, mtime of the files to index. Contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("full"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    prefix = re.sub("^file:/*", "/", root).rstrip("/")
    rows = base.select(F.expr("substring(full, %d)" % (len(prefix) + 2)).alias("path"), "size", "mtime")
    return rows.withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull() & visible(F.col("path"), rules))


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path, text, content_hash of the given files only; bytes that are no UTF-8 are replaced."""
    prefix = re.sub("^file:/*", "/", root).rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.select(F.expr("substring(regexp_replace(path, '^file:/*', '/'), %d)" % (len(prefix) + 2)).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return raw.join(paths.select("path"), "path", "left_semi").withColumn("content_hash", T.content_hash(F.col("text")))


def outline_lines(text: Column) -> Column:
    """Lines that look like declarations or headings, trimmed."""
    pattern = "^(" + "|".join(map(re.escape, OUTLINE_PREFIXES)) + ")"
    return F.filter(T.non_blank(text), lambda x: F.concat(x, F.lit(" ")).rlike(pattern))


SYMBOLS = "path string, tag string, kind string, name string, line int, col int, end_line int"
HEURISTIC = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+|export\s+|async\s+|static\s+|public\s+|private\s+)*(fn|struct|enum|trait|impl|class|def|function|interface|type|use|import|from)\s+([A-Za-z_][\w.:]*)")
KINDS = {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "impl": "impl_item", "class": "class_declaration", "def": "function_definition", "function": "function_declaration", "interface": "class_declaration", "type": "struct_item"}


def python_symbols(text: str) -> list[tuple]:
    """Definitions, calls and imports of a Python source: tag, kind, name, line, col, end line."""
    out = []
    for node in ast.walk(ast.parse(text)):
        at = (getattr(node, "lineno", 1), getattr(node, "col_offset", 0) + 1, getattr(node, "end_lineno", None))
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(("symbol", "function_definition", node.name, *at))
        elif isinstance(node, ast.ClassDef):
            out.append(("symbol", "class_declaration", node.name, *at))
        elif isinstance(node, ast.Call):
            out.append(("ref", "call", ast.unparse(node.func), *at))
        elif isinstance(node, ast.Import):
            out += [("ref", "import", a.name, *at) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("ref", "import", a.name, *at) for a in node.names]
    return out


def line_symbols(text: str) -> list[tuple]:
    """The same by the look of lines, for languages without a parser at hand."""
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        if found := HEURISTIC.match(line):
            word, name = found.groups()
            tag, kind = ("symbol", KINDS[word]) if word in KINDS else ("ref", "import")
            out.append((tag, kind, name, number, found.start(1) + 1, number))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols and references of files (path, language, text), parsed file by file. Text that doesn't parse is read by lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, kind, text in zip(rows["path"], rows["language"], rows["text"], strict=True):
                try:
                    found = python_symbols(text or "") if kind == "python" else line_symbols(text or "")
                except (SyntaxError, ValueError):
                    found = line_symbols(text or "")
                out += [(path, *x) for x in found]
            yield pd.DataFrame(out, columns=["path", "tag", "kind", "name", "line", "col", "end_line"])

    return files.select("path", "language", "text").mapInPandas(run, SYMBOLS)
