"""Linters and type checkers: issues parsed from lines or JSON, counted by rule and file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import one_space, plural, truncated
from tracewell.operators.summarize.base import ARGS, EXIT, LINES, NOTHING, OUT, Summary, begins, count, cut, find, first, found, paths_below, rules_and_files, say, section, take, tallied

PYTHON_ROOTS = ("src", "lib", "tests")
CODE_ROOTS = ("src", "lib", "pkg", "cmd", "internal")
FLAT = F.transform(LINES, one_space)
#: How an issue looks in each tool's output. A rule of ruff may have several letters.
RUFF = r"^(.+?):(\d+):(\d+):\s+([A-Z]+\d+)\s+(.+)$"
MYPY = r"^(.+?):(\d+)(?::\d+)?:\s+(error|warning|note):\s+(.+?)(?:\s+\[([^\]]+)\])?$"
ESLINT = r"^(.+?):\d+:\d+:\s+.+\s+\[(Error|Warning)/([^\]]+)\]$"
BIOME = r"^(.+?):\d+:\d+\s+([\p{Alnum}/_-]+)\s+.+$"
GOLANGCI = r"^(.+?):\d+:\d+:\s+(.+?)(?:\s+\(([^()]+)\))?$"
GOLANGCI_JSON = "Issues array<struct<FromLinter:string,Text:string,SourceLines:array<string>,Pos:struct<Filename:string>>>"
PRETTIER_ENDS = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|json|md|css|scss|html|yml|yaml)$"


def _files(issues: Column) -> Column:
    return F.size(F.array_distinct(F.transform(issues, lambda i: i["file"])))


def _parsed(pattern: str, **groups: int) -> Column:
    """Lines that match, as structs of the named groups."""
    hits = F.filter(FLAT, lambda x: x.rlike(pattern))
    return F.transform(hits, lambda x: F.struct(*[F.regexp_extract(x, pattern, k).alias(n) for n, k in groups.items()]))


def ruff() -> Summary:
    out = F.lower(OUT)
    formatting = found(ARGS, lambda x: x == "format") | F.coalesce(out.contains("would reformat") | out.contains("left unchanged"), F.lit(False))
    issues = _parsed(RUFF, file=1, line=2, col=3, rule=4, message=5)
    n, files = F.size(issues), _files(issues)
    violations = F.transform(take(issues, 20), lambda i: say("  {}:{}:{} {} {}", paths_below(i["file"], PYTHON_ROOTS), i["line"], i["col"], i["rule"], truncated(i["message"], 100)))
    over = F.when(n > 20, F.array(say("  ... +{} more", n - 20))).otherwise(NOTHING)
    details = F.concat(rules_and_files(issues, PYTHON_ROOTS, say_more=False), section("Violations:", F.concat(violations, over), gap=True))
    clean = F.coalesce(find(FLAT, lambda x: x == "All checks passed!"), F.when(EXIT == 0, F.lit("Ruff: No issues found")), first(FLAT), F.lit("Ruff: failed"))
    check_line = F.when(n == 0, clean).otherwise(F.concat(say("Ruff: {} issues in {} ", n, files), plural(files, "file", "files")))
    would = F.transform(F.filter(FLAT, lambda x: x.rlike(r"^[Ww]ould reformat:")), lambda x: F.trim(F.regexp_replace(x, r"^[Ww]ould reformat:", "")))
    fine = F.when((F.size(would) == 0) & found(FLAT, lambda x: x.contains("left unchanged")), F.lit("Ruff format: All files formatted correctly"))
    format_line = F.when(F.size(would) > 0, F.concat(say("Ruff format: {} ", F.size(would)), plural(F.size(would), "file", "files"), F.lit(" need formatting"))).otherwise(F.coalesce(fine, first(FLAT), F.lit("Ruff format: failed")))
    format_over = F.when(F.size(would) > 10, F.array(say("... +{} more files", F.size(would) - 10))).otherwise(NOTHING)
    format_details = F.concat(F.transform(take(would, 10), lambda p: paths_below(p, PYTHON_ROOTS)), format_over)
    return Summary(F.when(formatting, format_line).otherwise(check_line), F.when(formatting, format_details).when(n == 0, NOTHING).otherwise(details), plain=True)


def mypy() -> Summary:
    """Notes stand below the issue before them if it is of the same file. Errors and warnings are told apart."""
    kind = "array<struct<file:string,line:string,severity:string,message:string,code:string,notes:array<string>>>"

    def step(state: Column, line: Column) -> Column:
        group = lambda k: F.regexp_extract(line, MYPY, k)
        hit, issues = line.rlike(MYPY), state["issues"]
        size = F.size(issues)
        previous = F.try_element_at(issues, F.lit(-1))
        note = hit & (group(3) == "note")
        own = note & F.coalesce(previous["file"] == group(1), F.lit(False))
        new = F.struct(group(1).alias("file"), group(2).alias("line"), group(3).alias("severity"), group(4).alias("message"), group(5).alias("code"), NOTHING.alias("notes"))
        noted = F.struct(*[previous[c].alias(c) for c in ("file", "line", "severity", "message", "code")], F.concat(previous["notes"], F.array(group(4))).alias("notes"))
        skip = begins(line, "Found ", "Success:")
        grown = F.when(own, F.concat(F.slice(issues, F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(noted))).when(hit & ~note & ~skip, F.concat(issues, F.array(new))).otherwise(issues)
        loose = ~skip & ((note & ~own) | (~hit & line.contains("error:")))
        return F.struct(grown.alias("issues"), F.when(loose, F.concat(state["loose"], F.array(line))).otherwise(state["loose"]).alias("loose"))

    state = F.aggregate(LINES, F.struct(F.array().cast(kind).alias("issues"), NOTHING.alias("loose")), step)
    issues, loose = state["issues"], state["loose"]
    n, files = F.size(issues), _files(issues)
    errors = count(issues, lambda i: i["severity"] == "error")
    codes = tallied(F.filter(F.transform(issues, lambda i: i["code"]), lambda c: c != ""))
    top = F.array_join(F.transform(take(codes, 5), lambda t: say("{} ({}x)", t["key"], t["n"])), ", ")
    by_file = tallied(F.transform(issues, lambda i: i["file"]))

    def of_file(f: Column) -> Column:
        own = F.filter(issues, lambda i: i["file"] == f["key"])
        rows = F.flatten(F.transform(own, lambda i: F.concat(F.array(F.concat(say("  L{}: ", i["line"]), F.when(i["code"] != "", say("[{}] ", i["code"])).otherwise(F.lit("")), truncated(one_space(i["message"]), 120))), F.transform(i["notes"], lambda t: F.concat(F.lit("    "), truncated(one_space(t), 120))))))
        return F.concat(F.array(say("{} ({} errors)", paths_below(f["key"], PYTHON_ROOTS), f["n"])), rows)

    gap = F.when((F.size(loose) > 0) & (n > 0), F.array(F.lit(""))).otherwise(NOTHING)
    tops = F.when(F.size(codes) > 1, F.array(F.concat(F.lit("Top codes: "), top), F.lit(""))).otherwise(NOTHING)
    warned = F.when(n > errors, say(", {} warnings", n - errors)).otherwise(F.lit(""))
    headline = F.when(n == 0, F.lit("mypy: No issues found")).otherwise(F.concat(say("mypy: {} errors", errors), warned, say(" in {} ", files), plural(files, "file", "files")))
    return Summary(headline, F.concat(loose, gap, tops, F.flatten(F.transform(by_file, of_file))), plain=True)


def _fallback(name: str) -> Column:
    return F.when(EXIT == 0, F.lit(f"{name}: No issues found")).otherwise(F.coalesce(first(FLAT), F.lit(f"{name}: failed")))


def eslint() -> Summary:
    issues = _parsed(ESLINT, file=1, severity=2, rule=3)
    errors = count(issues, lambda i: i["severity"] == "Error")
    warnings, files = F.size(issues) - errors, _files(issues)
    headline = F.concat(say("ESLint: {} ", errors), plural(errors, "error", "errors"), say(", {} ", warnings), plural(warnings, "warning", "warnings"), say(" in {} ", files), plural(files, "file", "files"))
    return Summary(F.when(F.size(issues) == 0, _fallback("ESLint")).otherwise(headline), rules_and_files(issues, CODE_ROOTS), plain=True)


def biome() -> Summary:
    issues = _parsed(BIOME, file=1, rule=2)
    return Summary(F.when(F.size(issues) == 0, _fallback("Biome")).otherwise(say("Biome: {} issues in {} files", F.size(issues), _files(issues))), rules_and_files(issues, CODE_ROOTS), plain=True)


def prettier() -> Summary:
    said = begins
    named = F.filter(FLAT, lambda x: ~said(x, "Checking formatting", "All matched", "Code style issues found", "Ignored unknown option", "[error]"))
    files = F.filter(F.transform(named, lambda x: F.regexp_replace(x, r"^\[(warn|write)\] ", "")), lambda x: x.rlike(PRETTIER_ENDS))
    check, n = found(ARGS, lambda x: x.isin("--check", "-c", "--list-different")), F.size(files)
    noun = plural(n, "file", "files")
    headline = (
        F.when(F.size(LINES) == 0, F.lit("Prettier: no output"))
        .when((n == 0) & (EXIT == 0), F.lit("Prettier: All files formatted correctly"))
        .when((n > 0) & check, F.concat(say("Prettier: {} ", n), noun, F.when(n == 1, F.lit(" needs formatting")).otherwise(F.lit(" need formatting"))))
        .when(n > 0, F.concat(say("Prettier: {} ", n), noun, F.lit(" formatted")))
        .otherwise(F.coalesce(F.regexp_replace(first(FLAT), r"^\[(warn|error)\] ", ""), F.lit("Prettier: failed")))
    )
    return Summary(headline, cut(files, 8, "files"))


def golangci() -> Summary:
    kind = "array<struct<file:string,rule:string,example:string>>"
    payload = F.coalesce(F.when(F.try_parse_json(OUT).isNotNull(), OUT), F.when(F.try_parse_json(F.regexp_extract(OUT, r"(?s)\{.*\}", 0)).isNotNull(), F.regexp_extract(OUT, r"(?s)\{.*\}", 0)))
    from_json = F.transform(F.coalesce(F.from_json(payload, GOLANGCI_JSON)["Issues"], F.array()), lambda i: F.struct(F.coalesce(i["Pos"]["Filename"], F.lit("")).alias("file"), F.coalesce(i["FromLinter"], F.lit("")).alias("rule"), F.coalesce(F.nullif(one_space(F.try_element_at(i["SourceLines"], F.lit(1))), F.lit("")), i["Text"]).alias("example")))
    from_text = F.transform(F.filter(FLAT, lambda x: x.rlike(GOLANGCI)), lambda x: F.struct(F.regexp_extract(x, GOLANGCI, 1).alias("file"), F.coalesce(F.nullif(F.regexp_extract(x, GOLANGCI, 3), F.lit("")), F.lit("unknown")).alias("rule"), F.regexp_extract(x, GOLANGCI, 2).alias("example")))
    issues = F.when(payload.isNotNull(), from_json.cast(kind)).otherwise(from_text.cast(kind))
    linters = F.transform(take(tallied(F.transform(issues, lambda i: i["rule"])), 10), lambda t: say("  {} ({}x)", t["key"], t["n"]))
    files = tallied(F.transform(issues, lambda i: i["file"]))

    def of_file(f: Column) -> Column:
        own = F.filter(issues, lambda i: i["file"] == f["key"])
        groups = take(tallied(F.transform(own, lambda i: i["rule"])), 3)
        rows = F.flatten(F.transform(groups, lambda t: F.array(say("    {} ({})", t["key"], t["n"]), F.concat(F.lit("      -> "), truncated(one_space(first(F.filter(own, lambda i: i["rule"] == t["key"]))["example"]), 80)))))
        return F.concat(F.array(say("  {} ({} issues)", paths_below(f["key"], CODE_ROOTS), f["n"])), rows)

    over = F.when(F.size(files) > 10, F.array(F.lit(""), say("... +{} more files", F.size(files) - 10))).otherwise(NOTHING)
    details = F.concat(section("Top linters:", linters, gap=False), section("Top files:", F.flatten(F.transform(take(files, 10), of_file)), gap=True), over)
    return Summary(F.when(F.size(issues) == 0, _fallback("golangci-lint")).otherwise(say("golangci-lint: {} issues in {} files", F.size(issues), F.size(files))), details, plain=True)


SUMMARIES = {"python.ruff": ruff, "python.mypy": mypy, "lint.eslint": eslint, "lint.biome": biome, "lint.prettier": prettier, "lint.golangci-lint": golangci}
