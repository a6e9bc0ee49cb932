"""Small cases of the operators that have no SQL twin, and their invariants."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import argv as A
from tracewell.functions import text as T
from tracewell.operators import graph, metrics, reads, search, state
from tracewell.sources import files as source_files


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_lines_and_text(spark):
    assert one(spark, T.lines(F.lit("a\r\nb\n\n")), T.lines(F.lit("")), T.non_blank(F.lit(" a \n\n b"))) == [["a", "b", ""], [], ["a", "b"]]
    assert one(spark, T.truncated(F.lit("abcdef"), 4), T.one_space(F.lit(" a \t b ")), T.duration_ms(F.lit("1s then 2.5 s"))) == ["abc…", "a b", 2500]
    assert one(spark, T.extension(F.lit("a/.env")), T.extension(F.lit("a/b.tar.gz")), T.normal_reference(F.lit("use a::b.c(d)"))) == [None, "gz", "d"]
    assert one(spark, T.shell_quoted(F.lit("it's")), T.uri_path(F.lit("file:///a%20b")), T.printed_version(F.lit("tool 1.2.3"))) == ["'it'\\''s'", "/a b", "1.2.3"]
    assert one(spark, T.semantic_version(F.lit("v1.10.2-rc")) > T.semantic_version(F.lit("1.9")))[0]
    assert len(one(spark, T.around_match(F.lit("x" * 300 + "Needle" + "y" * 300), F.lit("needle")))[0]) == 166


def test_redaction(spark):
    argv = F.array(*map(F.lit, ["curl", "--token", "abc", "-H", "Authorization: x", "--user=me", "http://h/p?api_key=1&q=2", "--password", ""]))
    assert one(spark, T.redacted_argv(argv))[0] == ["curl", "--token", "[REDACTED]", "-H", "[REDACTED]", "--user=[REDACTED]", "http://h/p?api_key=[REDACTED]&q=2", "--password", ""]
    assert one(spark, T.env_value(F.lit("MY_TOKEN"), F.lit("x")), T.redacted_source(F.lit("https://u:p@h/x?y"))) == ["***", "https://h/x"]


def test_argv(spark):
    assert A.split_simple("a 'b c' \"d\\\"e\" f\\ g") == ["a", "b c", 'd"e', "f g"]
    assert A.split_simple("a | b") is None and A.split_simple("a 'b") is None and A.split_simple("  ") is None
    args = F.array(*map(F.lit, ["-C", "/x", "--git-dir=y", "status", "--", "-z"]))
    assert one(spark, A.positional(args, ("-C", "--git-dir")))[0] == ["status", "-z"]
    assert one(spark, A.without_env(F.array(F.lit("env"), F.lit("A=1"), F.lit("ls"))), A.sed_range(F.lit("5,9p")))[1] == 5


def test_metrics_empty_and_bad_json(spark):
    schema = "tool string, result_ok boolean, duration_ms long, estimated_origin_tokens long, actual_tokens long, estimated_origin_size long, actual_size long, params string, ts timestamp, project string"
    empty = metrics.summary(metrics.measured(spark.createDataFrame([], schema))).first()
    assert empty["total_calls"] == 0 and empty["success_rate"] == 0.0 and empty["tokens_saved"] == 0
    rows = [("read", True, 5, 10, 20, None, None, "no json", None, None), ("read", True, None, 10, 4, None, None, '{"mode":"full"}', None, None), ("search", False, 1, 10, 4, None, None, None, None, None), ("shell", True, 1, 9, 4, 9, 4, '{"argv":[1,"sed","-n"]}', None, "p")]
    df = metrics.measured(spark.createDataFrame(rows, schema))
    s = metrics.summary(df).first()
    # a missing mode counts for savings; a search saves but is no hit
    assert (s["tokens_saved"], s["compression_hits"], s["compression_eligible_calls"], s["bytes_saved"]) == (11, 1, 2, 5)
    assert metrics.top_commands(df, 0).collect()[0]["command"] == "sed -n"
    assert '"top_shell_commands":[{"command":"sed -n"' in metrics.as_json(df, "all").first()[0]


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "Beta gämma beta"), (3, ""), (4, None)], "id long, body string")
    posts, sizes = search.postings(docs, "id", ["body"]), search.lengths(docs, "id", ["body"])
    assert [r["key"] for r in search.search(posts, sizes, "alp AND 'beta_ga'", {"body": 1.0}).collect()] == [1, 2]
    assert search.search(posts, sizes, "AND (", {"body": 1.0}).count() == 0
    assert search.scan(docs, "id", "body", "nothing").count() == 0


def test_graph(spark):
    files = spark.createDataFrame([(1, 1, "a.py"), (2, 1, "b.py")], "id long, project_id long, path string")
    nodes = spark.createDataFrame([(10, 1, 1, "file", "a.py", 1), (11, 1, 1, "function_definition", "f", 2), (12, 1, 2, "function_definition", "f", 3), (20, 1, 2, "file", "b.py", 1)], "id long, project_id long, file_id long, kind string, name string, start_line int")
    refs = spark.createDataFrame([(1, 2, "call", "f", 9), (1, 2, "call", "gone", 9), (1, 1, "import", "f", None)], "project_id long, file_id long, ref_kind string, ref_text string, line int")
    edges = graph.resolve(refs, nodes)
    assert sorted((r["from_node_id"], r["to_node_id"], r["kind"]) for r in edges.collect()) == [(10, 11, "imports"), (10, 12, "imports"), (20, 11, "calls"), (20, 12, "calls")]
    g = {"files": files, "nodes": nodes, "edges": edges.unionByName(spark.createDataFrame([(1, 11, 11, "calls", 4)], edges.schema)), "refs": refs}
    got = sorted((r["file"], r["ref_kind"]) for r in graph.references(g, "f", "all", declaration=True).collect())
    # the edge of f to itself is inbound once
    assert got == [("a.py", "calls:inbound"), ("a.py", "declaration"), ("a.py", "imports:inbound"), ("b.py", "calls:inbound"), ("b.py", "declaration")]
    assert graph.contains_edges(nodes).count() == 2
    left = graph.purge_files(g, files.filter("id = 1"))
    assert (left["nodes"].count(), left["edges"].count(), left["refs"].count()) == (2, 1, 2)


def test_snapshot(spark):
    schema = "path string, size long, mtime long, content_hash string"
    old = spark.createDataFrame([("same", 1, 1, "h"), ("stat", 1, 1, "h"), ("mod", 1, 1, "h"), ("gone", 1, 1, "h")], schema)
    new = spark.createDataFrame([("same", 1, 1, None), ("stat", 1, 2, "h"), ("mod", 2, 2, "i"), ("new", 1, 1, "j")], schema)
    found = {r["path"]: (r["status"], r["stat_update"]) for r in graph.diff(old, new).collect()}
    assert found == {"same": ("unchanged", False), "stat": ("unchanged", True), "mod": ("modified", False), "gone": ("removed", False), "new": ("added", False)}
    assert list(graph.sync_counts(graph.diff(old, new)).first()) == [1, 1, 1, 2]
    again = graph.diff(graph.next_snapshot(old, new), new)
    assert list(graph.sync_counts(again).first()) == [0, 0, 0, 4]


def test_state(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    reads = spark.createDataFrame([("c", "w", at(1), "f", "h", False), ("c", "w", at(2), "f", "x", True), ("c", "w", at(3), "f", "h", False), ("c", "w", at(5), "f", "h", False)], "connection_id string, cw_id string, ts timestamp, path string, content_hash string, is_excerpt boolean")
    resets = spark.createDataFrame([(None, "w", at(4))], "connection_id string, cw_id string, ts timestamp")
    assert [r["unchanged"] for r in state.unchanged_reads(reads, resets).orderBy("ts").collect()] == [False, False, True, False]
    log = spark.createDataFrame([("watch", "/a", "c", "1", at(1)), ("watch", "/a", "c", "2", at(2)), ("unwatch", "/a", "c", "1", at(3)), ("watch", "/b", "c", "2", at(3)), ("close", None, "c", "2", at(4)), ("watch", "/b", "c", "3", at(5))], "action string, root string, client string, session_id string, ts timestamp")
    registry = state.watch_registry(log)
    assert [(r["root"], r["ref_count"], r["consumers"]) for r in registry.collect()] == [("/b", 1, ["c:3"])]
    assert state.status_lines(registry).first()["line"] == "/b: 1 consumers [c:3]"
    spool = spark.createDataFrame([("a", at(1), 50), ("b", at(2), 50), ("c", at(3), 60), ("d", at(4), 30)], "run_id string, mtime timestamp, total_bytes long")
    assert sorted(r["run_id"] for r in state.retained(spool, F.lit(at(5)), 24, 100).collect()) == ["c", "d"]


def test_running_sum_of_a_hot_key(spark):
    rows = [("hot" if k % 3 else None if k % 2 else f"k{k % 7}", k * 37 % 400, k, k % 5 - 1 if k % 11 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "key string, t int, id int, v int")
    want, sums = {}, {}
    for key, _, id_, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[id_] = sums[key] = sums.get(key, 0) + (v or 0)
    got = state.running_sum(df, ["key"], [F.desc("t"), F.col("id")], F.col("v"), "total")
    assert got.columns == [*df.columns, "total"] and {r["id"]: r["total"] for r in got.collect()} == want
    assert state.running_sum(df.limit(0), ["key"], [F.col("t")], F.col("v"), "total").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nclass A:\n    def f(self):\n        return os.getcwd()\n")
    (tmp_path / "src" / "b.rs").write_text("pub fn run() {}\nuse x::y;\n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "c.py").write_text("")
    (tmp_path / ".hidden.py").write_text("")
    tracked = source_files.tracked_files(spark, str(tmp_path), ["build/"])
    assert sorted(r["path"] for r in tracked.collect()) == ["src/a.py", "src/b.rs"]
    texts = source_files.contents(spark, str(tmp_path), tracked).join(tracked.select("path", "language"), "path")
    got = {(r["path"], r["kind"], r["name"]) for r in source_files.symbols(texts).collect()}
    assert got == {("src/a.py", "import", "os"), ("src/a.py", "class_declaration", "A"), ("src/a.py", "function_definition", "f"), ("src/a.py", "call", "os.getcwd"), ("src/b.rs", "function_item", "run"), ("src/b.rs", "import", "x::y")}


def test_reads_and_store(spark, tmp_path):
    from tracewell.operators import reads
    from tracewell.sources import store

    text = F.lit("a\nb\nc")
    assert one(spark, reads.excerpt(text, 2, 9, numbered=True), reads.excerpt(text, 3), reads.token_counter()(text)) == ["2: b\n3: c", "c", 5]
    assert one(spark, reads.run_text(F.lit("x"), F.lit(2)), reads.absolute(F.lit("a"), F.lit("/r/")), reads.simple_query(F.lit("a.*"))) == ["x\nexit code: 2", "/r/a", False]
    runs = spark.createDataFrame([("1", b"abcdef", None, 0, True)], "run_id string, stdout binary, stderr binary, exit_code int, timed_out boolean")
    r = store.captured(runs, 4).first()
    assert (r["stdout"], r["stderr"], r["exit_code"], r["raw_output_complete"], r["capture"]["stdout_bytes"]) == ("abcd", "", 124, False, 6)
    rows = lambda p, n: spark.createDataFrame([(p, i) for i in range(n)], "project_id int, id int")
    root = str(tmp_path / "graph")
    store.write_project({k: rows(1, 3).union(rows(2, 2)) for k in store.GRAPH_TABLES}, root)
    store.write_project({k: rows(1, 1) for k in store.GRAPH_TABLES}, root)
    assert store.read_graph(spark, root, 1)["nodes"].count() == 1 and store.read_graph(spark, root)["nodes"].count() == 3
    path = str(tmp_path / "t")
    store.swap(rows(1, 3), path)
    store.swap(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_ignore_rules(spark):
    rules = ["# notes", "*.log", "!keep.log", "build/", "/top.txt", "docs/**/draft.md", "!build/keep.me", "tmp*"]
    cases = {"a.log": True, "keep.log": False, "x/keep.log": False, "x/b.log": True, "build/a.py": True, "x/build/a.py": True, "build": False, "build/keep.me": False, "top.txt": True, "x/top.txt": False, "docs/draft.md": True, "docs/a/b/draft.md": True, "tmp1/x": True, "src/a.py": False}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r["path"]: r["out"] for r in df.select("path", source_files.ignored(F.col("path"), rules).alias("out")).collect()} == cases
    assert [r["ok"] for r in df.select(source_files.visible(F.col("path")).alias("ok")).distinct().collect()] == [True]


def test_results_of_runs(spark):
    runs = spark.createDataFrame([("r1", ["ls"], 0, "compressed", (1, 2)), ("r2", ["ls"], 1, "raw_fallback", (3, 4))], "run_id string, argv array<string>, exit_code int, mode string, capture struct<stdout_bytes:long,stderr_bytes:long>")
    out = [json.loads(r["result"]) for r in reads.run_results(runs).sort("run_id").collect()]
    assert [x["content_kind"] for x in out] == ["compressed_summary", "raw_output"] and out[1]["stdout_bytes"] == 3 and out[0]["argv"] == ["ls"] and out[0]["raw_output_available"]
    assert json.loads(reads.spool_results(runs, "why").first()["result"])["reason"] == "why"


def test_metrics_as_text(spark):
    from tracewell.plans.queries import event_log

    text = metrics.as_text(metrics.measured(event_log(spark, "/root/testdata/sf0.001")), "all", "p", 2)
    lines = text.split("\n")
    assert lines[0] == "Metrics (all) — p" and lines[3].startswith("Total calls") and "By Tool" in lines and "Top Shell Commands (top 2 by token savings)" in lines
    assert len({line.index("Calls") for line in lines if line.startswith("Tool")}) == 1


def test_vocabulary_counter(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(reads.vocabulary_counter(path)(F.col("text"))).collect()]
    assert got == [len(Tokenizer.from_file(path).encode("one two three", add_special_tokens=False).ids), None, 0]


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma"), (3, "delta")], "doc_id long, text string")
    search.write_index(docs, "doc_id", ["text"], str(tmp_path))
    found = lambda q: [r["key"] for r in search.search(*search.read_index(spark, str(tmp_path)), q, {"text": 1.0}).collect()]
    direct = search.search(search.postings(docs, "doc_id", ["text"]), search.lengths(docs, "doc_id", ["text"]), "beta", {"text": 1.0})
    assert sorted(found("beta")) == sorted(r["key"] for r in direct.collect()) == [1, 2]
    search.write_index(spark.createDataFrame([(2, "epsilon"), (4, "beta")], docs.schema), "doc_id", ["text"], str(tmp_path), call=1)
    assert sorted(found("beta")) == [1, 4] and found("epsilon") == [2] and found("gamma") == []
    posts = search.read_index(spark, str(tmp_path))[0].filter(F.col("term") == "beta")
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,beta)" in posts._jdf.queryExecution().toString()
