"""Usage metrics over an event log: one pass of conditional aggregates, by tool, top commands, windows of time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T

#: Days that a window looks back; None: all.
WINDOWS = {"24h": 1, "7d": 7, "all": None}


@dataclass(frozen=True)
class Tools:
    """The names under which the log has the three tools whose output is compressed."""

    shell: str = "shell"
    search: str = "search"
    read: str = "read"


def windowed(events: DataFrame, window: str, anchor: Column | None = None, ts: str = "ts") -> DataFrame:
    """Events of the window that ends at `anchor`, now if none is given."""
    days = WINDOWS[window]
    if days is None:
        return events
    return events.filter(F.col(ts) >= (F.current_timestamp() if anchor is None else anchor) - F.expr(f"INTERVAL {days} DAYS"))


def of_project(events: DataFrame, project: str | None) -> DataFrame:
    return events if project is None else events.filter(F.col("project") == project)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or less."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def measured(events: DataFrame, tools: Tools = Tools()) -> DataFrame:
    """The columns that the metrics need: nulls as 0, which calls count for savings and for hits, what they saved."""
    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    mode = F.when(F.col("tool") == tools.read, F.get_json_object("params", "$.mode"))
    read = (F.col("tool") == tools.read) & ~mode.eqNullSafe("full")
    hit = (F.col("tool") == tools.shell) | read
    saving = hit | (F.col("tool") == tools.search)
    return events.select(
        "tool",
        F.coalesce(F.col("result_ok"), F.lit(False)).alias("ok"),
        number("duration_ms").alias("duration_ms"),
        F.greatest(number("estimated_origin_tokens"), F.lit(0)).alias("origin_tokens"),
        F.greatest(number("estimated_origin_tokens") - number("actual_tokens"), F.lit(0)).alias("saved_tokens"),
        F.greatest(number("estimated_origin_size") - number("actual_size"), F.lit(0)).alias("saved_bytes"),
        saving.alias("saving"),
        hit.alias("hit"),
        F.when(F.col("tool") == tools.shell, F.col("params")).alias("shell_params"),
    )


def _sum(value: Column, when: Column | None = None) -> Column:
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("long")


def summary(rows: DataFrame) -> DataFrame:
    """One row over what measured() gave."""
    calls = F.count("*")
    saved, origin = _sum(F.col("saved_tokens"), F.col("saving")), _sum(F.col("origin_tokens"), F.col("saving"))
    hits, eligible = F.count_if(F.col("hit") & (F.col("saved_tokens") > 0)), F.count_if(F.col("hit"))
    return rows.agg(
        calls.alias("total_calls"),
        ratio(F.count_if(F.col("ok")), calls).alias("success_rate"),
        ratio(_sum(F.col("duration_ms")), calls).alias("avg_latency_ms"),
        saved.alias("tokens_saved"),
        _sum(F.col("saved_bytes"), F.col("saving")).alias("bytes_saved"),
        ratio(hits, eligible).alias("compression_hit_rate"),
        hits.alias("compression_hits"),
        eligible.alias("compression_eligible_calls"),
        ratio(saved, origin).alias("savings_ratio"),
    )


def by_tool(rows: DataFrame) -> DataFrame:
    """Most calls first, ties by name."""
    out = rows.groupBy("tool").agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("ok")).alias("errors"),
        ratio(_sum(F.col("duration_ms")), F.count("*")).alias("avg_latency_ms"),
        _sum(F.col("saved_tokens"), F.col("saving")).alias("tokens_saved"),
        _sum(F.col("saved_bytes"), F.col("saving")).alias("bytes_saved"),
    )
    return out.orderBy(F.desc("calls"), "tool")


def top_commands(rows: DataFrame, top: int = 10, tools: Tools = Tools()) -> DataFrame:
    """The commands that saved most tokens, ties by calls, then by name."""
    shell = rows.filter(F.col("tool") == tools.shell).withColumn("command", command_label(F.col("shell_params")))
    out = shell.groupBy("command").agg(
        F.count("*").alias("calls"),
        _sum(F.col("saved_tokens")).alias("tokens_saved"),
        ratio(_sum(F.col("saved_tokens")), _sum(F.col("origin_tokens"))).alias("saved_ratio"),
        ratio(_sum(F.col("duration_ms")), F.count("*")).alias("avg_latency_ms"),
    )
    return out.orderBy(F.desc("tokens_saved"), F.desc("calls"), "command").limit(max(top, 1))


def command_label(params: Column) -> Column:
    """The label under which a shell call is counted, from its JSON parameters.

    Only string arguments count. Searches tell --files and -n apart, git and cargo their first argument, shells have
    the given family; others are known by their first two words. Without arguments the family, else unknown.
    """
    value = F.try_parse_json(params)
    items = F.coalesce(F.try_variant_get(value, "$.argv", "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    argv = F.transform(kept, lambda x: F.try_variant_get(x, "$", "string"))
    named = F.try_variant_get(value, "$.family", "variant")
    family = F.when(F.schema_of_variant(named) == "STRING", F.try_variant_get(named, "$", "string"))
    return _label(argv, family)


def _label(argv: Column, family: Column) -> Column:
    program, second = F.try_element_at(argv, F.lit(1)), F.try_element_at(argv, F.lit(2))

    def has(flag: str) -> Column:
        return F.array_contains(argv, flag)

    pair = F.concat_ws(" ", program, second)
    return (
        F.when(F.coalesce(F.size(argv), F.lit(0)) <= 0, F.coalesce(family, F.lit("unknown")))
        .when(program.isin("rg", "grep") & has("--files"), F.concat(program, F.lit(" --files")))
        .when(program.isin("rg", "grep") & has("-n"), F.concat(program, F.lit(" -n")))
        .when(program.isin("rg", "grep"), program)
        .when((program == "git") & (second == "status") & has("--short"), F.lit("git status --short"))
        .when(program == "sed", F.when(has("-n"), F.lit("sed -n")).otherwise(F.lit("sed")))
        .when(program.isin("find", "cat", "head", "tail"), program)
        .when(program.isin("sh", "bash", "zsh"), F.coalesce(family, program))
        .otherwise(pair)
    )


def as_json(rows: DataFrame, window: str, project: str | None = None, top: int = 10, tools: Tools = Tools()) -> DataFrame:
    """The whole report as one JSON text: summary, tools, top commands. The parts are a few rows each."""
    parts = summary(rows).select(F.struct("*").alias("summary"))
    tool = by_tool(rows).agg(F.sort_array(F.collect_list(F.struct((-F.col("calls")).alias("order"), F.struct("*").alias("row")))).alias("by_tool"))
    top_rows = top_commands(rows, top, tools).agg(F.sort_array(F.collect_list(F.struct((-F.col("tokens_saved")).alias("order"), (-F.col("calls")).alias("then"), "command", F.struct("*").alias("row")))).alias("top"))
    joined = parts.join(F.broadcast(tool)).join(F.broadcast(top_rows))
    of = lambda c: F.transform(c, lambda x: x["row"])
    report = F.struct(F.lit(window).alias("window"), F.lit(project).alias("project"), "summary", of("by_tool").alias("by_tool"), of("top").alias("top_shell_commands"))
    return joined.select(F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def summary_text(report: DataFrame) -> DataFrame:
    """place, label, value of a summary() as it is shown."""
    rows = (
        ("Total calls", F.col("total_calls").cast("string")),
        ("Success rate", percent(F.col("success_rate"))),
        ("Avg latency", F.format_string("%.0fms", "avg_latency_ms")),
        ("Token saved", T.human_number(F.col("tokens_saved"))),
        ("Bytes saved", T.human_bytes(F.col("bytes_saved"))),
        ("Compression hits", F.concat(F.col("compression_hits").cast("string"), F.lit("/"), F.col("compression_eligible_calls").cast("string"), F.lit(" ("), percent(F.col("compression_hit_rate")), F.lit(")"))),
        ("Savings ratio", F.concat(T.progress_bar(F.col("savings_ratio"), 24), F.lit(" "), percent(F.col("savings_ratio")))),
    )
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(label).alias("label"), value.alias("value")) for k, (label, value) in enumerate(rows)])
    return report.select(F.inline(each))


def tool_text(report: DataFrame) -> DataFrame:
    """by_tool() as texts, for a table."""
    return report.select("tool", F.col("calls").cast("string").alias("calls"), F.col("errors").cast("string").alias("errors"), T.human_number(F.col("tokens_saved")).alias("tokens_saved"), T.human_bytes(F.col("bytes_saved")).alias("bytes_saved"))


def command_text(report: DataFrame) -> DataFrame:
    """top_commands() as texts, for a table."""
    return report.select(T.truncated_middle(F.col("command"), 42).alias("command"), F.col("calls").cast("string").alias("calls"), T.human_number(F.col("tokens_saved")).alias("tokens_saved"), percent(F.col("saved_ratio")).alias("saved_ratio"), F.format_string("%.0f", "avg_latency_ms").alias("avg_latency_ms"))


def aligned(head: tuple[str, ...], rows: list[tuple]) -> str:
    """A table of text, columns two spaces apart under a ruled heading."""
    wide = [max(map(len, column)) for column in zip(head, *rows, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)).rstrip()
    return "\n".join([line(head), line(tuple("-" * w for w in wide)), *map(line, rows)])


def as_text(rows: DataFrame, window: str, project: str | None = None, top: int = 10, tools: Tools = Tools()) -> str:
    """The whole report as text; its parts, a few rows each, come to the driver."""
    first = [(r["label"], r["value"]) for r in summary_text(summary(rows)).orderBy("place").collect()]
    wide = max(len(label) for label, _ in first)
    tool = [tuple(r) for r in tool_text(by_tool(rows)).collect()]
    commands = [(str(k), *r) for k, r in enumerate(command_text(top_commands(rows, top, tools)).collect(), 1)]
    heading = f"Metrics ({window})" + (f" — {project}" if project else "")
    parts = [heading, "", "Summary", *[f"{label:<{wide}}  {value}" for label, value in first], "", "By Tool", aligned(("Tool", "Calls", "Errors", "Tokens saved", "Bytes saved"), tool)]
    parts += ["", f"Top Shell Commands (top {len(commands)} by token savings)", aligned(("#", "Command", "Calls", "Tokens saved", "Saved%", "Avg ms"), commands)]
    return "\n".join(parts)


def shown(report: DataFrame) -> DataFrame:
    """Counts of a by-tool or top-commands table in short form."""
    return report.withColumns({"calls_text": T.human_number(F.col("calls")), "saved_text": T.human_number(F.col("tokens_saved"))})
