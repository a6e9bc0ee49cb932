"""The code graph: files, nodes, edges, unresolved references as tables; resolution, lookups, snapshots, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Syntax kinds that are symbols, and the relation that each referring kind is.
SYMBOL_KINDS = ["function_item", "function_declaration", "function_definition", "method_definition", "method_declaration", "class_declaration", "struct_item", "enum_item", "trait_item", "impl_item"]
RELATIONS = {"call_expression": "call", "call": "call", "import_statement": "import", "import_from_statement": "import", "import_declaration": "import", "use_declaration": "import"}


def is_symbol(kind: Column) -> Column:
    return kind.isin(SYMBOL_KINDS)


def relation(kind: Column) -> Column:
    """call, import or null."""
    calls, imports = ([k for k, v in RELATIONS.items() if v == r] for r in ("call", "import"))
    return F.when(kind.isin(calls), F.lit("call")).when(kind.isin(imports), F.lit("import"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str] | str) -> DataFrame:
    """Rows of `new`, and those of `existing` whose key is not among them."""
    keys = [key] if isinstance(key, str) else key
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def purge(table: DataFrame, removed: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose columns (keys of `on`) match no removed row's (values)."""
    gone = removed.select(*[F.col(b).alias(a) for a, b in on.items()]).distinct()
    return table.join(gone, list(on), "left_anti")


def purge_files(graph: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """The graph without some files (column id): what hangs on them goes too, edges with either end."""
    files, nodes = purge(graph["files"], removed, {"id": "id"}), purge(graph["nodes"], removed, {"file_id": "id"})
    gone = graph["nodes"].join(removed.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi").select("id")
    edges = purge(purge(graph["edges"], gone, {"from_node_id": "id"}), gone, {"to_node_id": "id"})
    return {"files": files, "nodes": nodes, "edges": edges, "refs": purge(graph["refs"], removed, {"file_id": "id"})}


def file_nodes(files: DataFrame) -> DataFrame:
    """A node of kind file for each file, named by its path."""
    one = F.lit(1)
    return files.select("project_id", F.col("id").alias("file_id"), F.lit("file").alias("kind"), F.col("path").alias("name"), one.alias("start_line"), one.alias("start_col"), one.alias("end_line"), one.alias("end_col"))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """From each file's node to the symbols in it."""
    own = nodes.filter("kind = 'file'").select("project_id", "file_id", F.col("id").alias("from_node_id"))
    inner = nodes.filter("kind <> 'file'").select("project_id", "file_id", F.col("id").alias("to_node_id"), F.col("start_line").alias("line"))
    return own.join(inner, ["project_id", "file_id"]).select("project_id", "from_node_id", "to_node_id", F.lit("contains").alias("kind"), "line")


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the file of each reference to every symbol of that name in its project.

    Common names are skewed on both sides; the joins are plain equi-joins that adaptive execution may split.
    """
    own = nodes.filter("kind = 'file'").select("project_id", "file_id", F.col("id").alias("from_node_id"))
    named = nodes.filter("kind <> 'file'").select("project_id", F.col("name").alias("ref_text"), F.col("id").alias("to_node_id"))
    kind = F.when(F.col("ref_kind") == "call", F.lit("calls")).otherwise(F.lit("imports"))
    wanted = refs.filter(F.col("ref_kind").isin("call", "import"))
    return wanted.join(own, ["project_id", "file_id"]).join(named, ["project_id", "ref_text"]).select("project_id", "from_node_id", "to_node_id", kind.alias("kind"), "line")


def references(graph: dict[str, DataFrame], symbol: str, kind: str = "all", declaration: bool = False) -> DataFrame:
    """file, line, ref_kind, symbol, sym_kind of what refers to a symbol or is referred to by it.

    `all` takes both directions as two equi-joins, not one join on a choice of ends; an edge from a node to itself
    counts once, as inbound.
    """
    nodes, edges = graph["nodes"], graph["edges"]
    files = graph["files"].select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    target = nodes.filter((F.col("name") == symbol) & (F.col("kind") != "file"))
    other = nodes.select(F.col("id").alias("other"), "file_id", F.col("name").alias("symbol"), F.col("kind").alias("sym_kind"))

    def side(near: str, far: str, rows: DataFrame, label: Column) -> DataFrame:
        ends = rows.join(target.select(F.col("id").alias(near)), near)
        return ends.withColumnRenamed(far, "other").join(other, "other").join(files, "file_id").select("file", "line", label.alias("ref_kind"), "symbol", "sym_kind")

    inbound, outbound = ("to_node_id", "from_node_id"), ("from_node_id", "to_node_id")
    if kind == "callers":
        out = side(*inbound, edges.filter("kind = 'calls'"), F.lit("caller"))
    elif kind == "callees":
        out = side(*outbound, edges.filter("kind = 'calls'"), F.lit("callee"))
    elif kind == "imports":
        out = side(*inbound, edges.filter("kind = 'imports'"), F.lit("import"))
    else:
        both = edges.filter(F.col("kind").isin("calls", "imports"))
        # against a symbol with several nodes an edge between two of them counts for each
        once = both.filter("from_node_id <> to_node_id")
        out = side(*inbound, both, F.concat("kind", F.lit(":inbound"))).unionByName(side(*outbound, once, F.concat("kind", F.lit(":outbound"))))
    if declaration:
        own = target.join(files, "file_id").select("file", F.col("start_line").alias("line"), F.lit("declaration").alias("ref_kind"), F.col("name").alias("symbol"), F.col("kind").alias("sym_kind"))
        out = out.unionByName(own)
    return out.dropDuplicates(["file", "line", "ref_kind", "symbol"]).orderBy("file", "line")


def outline(graph: dict[str, DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols by line, and imports by line, of one file."""
    own = graph["files"].filter(F.col("path") == path).select(F.col("id").alias("file_id"))
    symbols = graph["nodes"].filter("kind <> 'file'").join(F.broadcast(own), "file_id")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_async", "is_static", "is_abstract") if c in symbols.columns]
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("signature", "visibility", "doc") if c in symbols.columns]
    symbols = symbols.select("kind", "name", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), *flags, *texts).orderBy("start_line", "name")
    imports = graph["refs"].filter("ref_kind = 'import'").join(F.broadcast(own), "file_id").select("ref_text", "line").orderBy("line", "ref_text")
    return symbols, imports


def outlines(graph: dict[str, DataFrame]) -> DataFrame:
    """path and its symbols as an array by line, one row for each file."""
    symbols = graph["nodes"].filter("kind <> 'file'").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "name", "kind"))).alias("symbols"))
    return graph["files"].join(symbols, graph["files"]["id"] == symbols["file_id"], "left").select("path", F.coalesce("symbols", F.array().cast("array<struct<start_line:int,name:string,kind:string>>")).alias("symbols"))


def outline_texts(graph: dict[str, DataFrame]) -> DataFrame:
    """path and text: each file's name and language, what it imports and its symbols, both by line."""
    nodes = graph["nodes"].filter("kind <> 'file'")
    flag = lambda c, word: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(word)).otherwise(F.lit("")) if c in nodes.columns else F.lit("")
    public = F.when(F.col("visibility").isin("public", "pub"), F.lit("pub ")).otherwise(F.lit("")) if "visibility" in nodes.columns else F.lit("")
    named = F.coalesce(F.nullif(F.col("signature"), F.lit("")), F.col("name")) if "signature" in nodes.columns else F.col("name")
    line = F.concat(F.lit("    "), F.col("start_line").cast("string"), F.lit(": "), public, flag("is_async", "async "), flag("is_static", "static "), F.lit("["), F.col("kind"), F.lit("] "), named)
    listed = lambda order, text, to: F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("text")))), lambda x: x["text"]).alias(to)
    symbols = nodes.groupBy("file_id").agg(listed(("start_line", "name"), line, "symbols"))
    imports = graph["refs"].filter("ref_kind = 'import'").groupBy("file_id").agg(listed(("line", "ref_text"), F.col("ref_text"), "imports"))
    files = graph["files"].join(symbols.withColumnRenamed("file_id", "id"), "id", "left").join(imports.withColumnRenamed("file_id", "id"), "id", "left")
    language = F.coalesce(F.col("language"), F.lit("unknown")) if "language" in files.columns else F.lit("unknown")
    head = F.concat(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(" ["), language, F.lit("]"))
    brought = F.when(F.col("imports").isNotNull(), F.concat(F.lit("  imports: "), F.array_join("imports", ", ")))
    held = F.when(F.col("symbols").isNotNull(), F.concat(F.lit("  symbols:\n"), F.array_join("symbols", "\n"))).when(F.col("imports").isNull(), F.lit("  (no indexed symbols)"))
    return files.select("path", F.concat_ws("\n", head, brought, held).alias("text"))


def references_text(found: DataFrame, symbol: str, kind: str) -> DataFrame:
    """One row with the text of what references() found."""
    line = F.format_string("%s:%s [%s] %s — %s", "file", F.coalesce(F.col("line").cast("string"), F.lit("0")), "sym_kind", "symbol", "ref_kind")
    rows = found.agg(F.sort_array(F.collect_list(F.struct("file", "line", "ref_kind", "symbol", line.alias("text")))).alias("rows"))
    head = F.concat(F.lit(f"References for `{symbol}` (kind={kind}): "), F.size("rows").cast("string"), F.lit(" result(s)\n"))
    text = F.array_join(F.concat(F.array(head), F.transform("rows", lambda x: x["text"])), "\n")
    return rows.select(F.when(F.size("rows") == 0, F.lit(f"No references found for `{symbol}` (kind={kind}).")).otherwise(text).alias("text"))


# ---- snapshots ----


def changed_stat(tracked: DataFrame, disk: DataFrame) -> DataFrame:
    """Files of the disk whose size or time differ from what is tracked, and new ones: only these are read and hashed."""
    old = tracked.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    both = disk.join(old, "path", "left")
    return both.filter(~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime")))).drop("old_size", "old_mtime")


def diff(tracked: DataFrame, disk: DataFrame) -> DataFrame:
    """path, status (added, modified, removed, unchanged), stat_update; from path, size, mtime, content_hash of both.

    The disk's hash may be null where size and time are as tracked: such files weren't read.
    """
    old = tracked.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "content_hash")], F.lit(True).alias("was"))
    new = disk.select("path", "size", "mtime", "content_hash", F.lit(True).alias("is"))
    both = old.join(new, "path", "full_outer")
    same_stat = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    same = same_stat | (F.col("content_hash") == F.col("old_content_hash"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"), F.coalesce((status == "unchanged") & ~same_stat, F.lit(False)).alias("stat_update"))


def sync_counts(found: DataFrame) -> DataFrame:
    """One row: added, modified, removed, unchanged."""
    return found.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "removed", "unchanged")])


def next_snapshot(tracked: DataFrame, disk: DataFrame) -> DataFrame:
    """The tracked table after a sync: removed files gone, unread ones with their old hash."""
    old = tracked.select("path", F.col("content_hash").alias("old_hash"))
    return disk.join(old, "path", "left").select("path", "size", "mtime", F.coalesce("content_hash", "old_hash").alias("content_hash"))


# ---- owners ----


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, shortest last."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    count = F.size(parts)
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, F.lit(1), count - i), "/"))


def owners(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the longest root that it lies in; without one it isn't there.

    Every path is beside its ancestors, so this is an equi-join, not a comparison with all roots.
    """
    steps = paths.select(path, F.explode(ancestors(F.col(path))).alias(root)).distinct()
    found = steps.join(roots.select(root).distinct(), root)
    return found.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
