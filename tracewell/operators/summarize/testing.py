"""Test runs: totals, failures with their messages, duration; from JSON reports or from text."""

from __future__ import annotations

import sys
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import duration_ms, one_space, plural, trim, truncated, without_ansi
from tracewell.operators.summarize.base import EXIT, LINES, NOTHING, OUT, BOTH, PREVIEW, RAW, Summary, begins, count, cut, find, first, found, has, joined_blocks, last, matching, number, part, rest, say, section, take

# workers get this module's functions with the task: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAILURE = "array<struct<name:string,lines:array<string>>>"
NO_FAILURES = F.array().cast(FAILURE)
#: Columns that read() adds to a run.
CLEAN, CLEAN_LINES, PAYLOAD, KEPT = F.col("clean"), F.col("clean_lines"), F.col("payload"), F.col("kept_lines")
#: The shape of the reports.
JS_REPORT = "testResults array<struct<name:string,assertionResults:array<struct<fullName:string,status:string,failureMessages:array<string>>>>>, numPassedTests long, numFailedTests long, numPendingTests long"
GO_EVENT = "Action string, Package string, Test string, Output string, Elapsed double"
RSPEC_REPORT = "examples array<struct<full_description:string,status:string,file_path:string,line_number:int,exception:struct<class:string,message:string,backtrace:array<string>>>>, summary struct<duration:double,example_count:long,failure_count:long,pending_count:long,errors_outside_of_examples_count:long>"


def totals(passed: Column, failed: Column, skipped: Column) -> Column:
    return F.concat(say("PASS ({}) FAIL ({})", passed, failed), F.when(skipped > 0, say(" skipped ({})", skipped)).otherwise(F.lit("")))


def read(runs: DataFrame) -> DataFrame:
    """Test runs with the columns that their reports are read from, and then with the report itself.

    Steps are columns of their own, so that no expression holds another several times.
    """
    clean = runs.withColumns({"clean": without_ansi(OUT), "payload": F.nullif(F.regexp_extract(OUT, r"(?s)\{.*\}", 0), F.lit("")), "suites": suites(F.when(F.col("label") == "test.playwright", OUT))})
    clean = clean.withColumns({"clean_lines": F.filter(F.transform(F.split("clean", r"\r?\n"), trim), lambda x: x != ""), "kept_lines": F.when(F.col("label") == "test.rspec", without_noise(F.split("clean", r"\r?\n")))})
    cases = None
    for label, report in REPORTS.items():
        headline, failures, millis = report()
        value = F.struct(headline.alias("headline"), failures.cast(FAILURE).alias("failures"), millis.cast("long").alias("millis"))
        cases = F.when(F.col("label") == label, value) if cases is None else cases.when(F.col("label") == label, value)
    return clean.withColumn("report", cases)


def presented() -> Summary:
    """Five failures with their messages, how many more there are, the time."""
    headline, failures, millis = (F.col(f"report.{c}") for c in ("headline", "failures", "millis"))
    rows = F.flatten(F.transform(take(failures, 5), lambda f, i: F.concat(F.array(F.concat((i + 1).cast("string"), F.lit(". "), truncated(f["name"], 140))), F.transform(f["lines"], lambda x: F.concat(F.lit("   "), x)))))
    over = F.when(F.size(failures) > 5, F.array(say("... +{} more failures", F.size(failures) - 5))).otherwise(NOTHING)
    body = F.concat(rows, over)
    time = F.when(millis.isNull(), NOTHING).otherwise(F.concat(F.when(F.size(body) > 0, F.array(F.lit(""))).otherwise(NOTHING), F.array(say("Time: {}ms", millis))))
    return Summary(headline, F.concat(body, time), NOTHING, plain=True)


def _failures(blocks: Column, name: Callable = lambda x: x) -> Column:
    """Blocks of lines as failures: the first line names it."""
    return F.transform(blocks, lambda b: F.struct(name(F.substring_index(b, "\n", 1)).alias("name"), rest(F.split(b, "\n")).alias("lines")))


def _numbered(line: Column) -> Column:
    return line.rlike(r"^[0-9].*\)")


def javascript(label: str) -> tuple[Column, Column, Column]:
    report = F.from_json(F.when(F.try_parse_json(PAYLOAD).isNotNull(), PAYLOAD), JS_REPORT)
    zero = lambda c: F.coalesce(c, F.lit(0))

    def messages(file: Column, test: Column) -> Column:
        text = F.concat_ws("\n", F.nullif(file["name"], F.lit("")), *[F.array_join(F.transform(test["failureMessages"], without_ansi), "\n")])
        return F.filter(F.transform(F.filter(F.transform(F.split(text, r"\r?\n"), trim), lambda x: x != ""), one_space), lambda x: ~x.startswith("FAIL "))

    json_failures = F.flatten(F.transform(F.coalesce(report["testResults"], F.array()), lambda file: F.transform(F.filter(F.coalesce(file["assertionResults"], F.array()), lambda t: t["status"] == "failed"), lambda t: F.struct(t["fullName"].alias("name"), messages(file, t).alias("lines")))))
    one, two = r"Tests?:\s*(?:(\d+)\s+failed,\s*)?(\d+)\s+passed(?:,\s*(\d+)\s+skipped)?", r"Tests?\s+(?:(\d+)\s+failed\s+\|\s+)?(\d+)\s+passed(?:\s+\|\s+(\d+)\s+skipped)?"
    line = find(CLEAN_LINES, lambda x: x.rlike(one) | x.rlike(two))
    of = lambda k: F.when(line.rlike(one), number(line, one, k)).otherwise(number(line, two, k))
    failed = F.when(line.isNull(), has(CLEAN, "FAIL", "failed").cast("long")).otherwise(of(1))
    passed, skipped = F.when(line.isNull(), F.lit(0)).otherwise(of(2)), F.when(line.isNull(), F.lit(0)).otherwise(of(3))
    blocks = joined_blocks(CLEAN_LINES, lambda x: begins(x, "FAIL ", "×", "✖", "❯"), lambda x: begins(x, "Tests", "Test Files", "Snapshots", "Duration", "Time:"))
    text_line = F.when((passed == 0) & (failed == 0) & (skipped == 0), F.lit(f"{label}: no tests found")).otherwise(totals(passed, failed, skipped))
    is_json = report.isNotNull() & F.try_parse_json(PAYLOAD).isNotNull()
    json_line = totals(zero(report["numPassedTests"]), zero(report["numFailedTests"]), zero(report["numPendingTests"]))
    return (F.when(is_json, json_line).otherwise(text_line), F.when(is_json, json_failures.cast(FAILURE)).otherwise(_failures(blocks).cast(FAILURE)), F.when(~is_json, duration_ms(CLEAN)))


def walked_suites(report: str | None) -> dict | None:
    """Totals and failures of a report whose suites hold suites to any depth; None for other texts."""
    try:
        data = json.loads(report[report.index("{") : report.rindex("}") + 1])
        stats, open_suites = data["stats"], list(reversed(data.get("suites", [])))
    except (AttributeError, KeyError, TypeError, ValueError):
        return None
    failures = []
    while open_suites:
        suite = open_suites.pop()
        if not isinstance(suite, dict):
            return None
        place = suite.get("file") or suite.get("title", "")
        for spec in suite.get("specs", []):
            if not spec.get("ok"):
                attempts = [a for t in spec.get("tests", []) if t.get("status") == "unexpected" for a in t.get("results", []) if a.get("status") in ("failed", "timedOut")]
                text = [line for a in attempts for e in a.get("errors", []) for line in e.get("message", "").splitlines()]
                lines = [" ".join(x.split()) for x in text if x.strip()]
                failures.append({"name": f"{place} > {spec.get('title', '')}", "lines": [x for x in lines if not x.startswith("FAIL ")]})
        open_suites += reversed(suite.get("suites", []))
    count = lambda k: int(stats.get(k, 0))
    return {"passed": count("expected"), "failed": count("unexpected"), "skipped": count("skipped"), "millis": count("duration"), "failures": failures}


@F.pandas_udf(f"passed long, failed long, skipped long, millis long, failures {FAILURE}")
def suites(reports: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """walked_suites() of each report: recursion has no schema."""
    names = ["passed", "failed", "skipped", "millis", "failures"]
    for batch in reports:
        yield pd.DataFrame([walked_suites(x) or dict.fromkeys(names) for x in batch], columns=names)


def _playwright_lines(rows: Column) -> Column:
    """Lines that tell what went wrong, twelve at most: errors, calls, attachments, code; all others if none of these does."""
    inner = F.filter(rows, lambda x: ~x.rlike(r"^\[.*\]$"))
    tells = lambda x: has(x, "Error:", "AssertionError", "Timeout", "Timed out", "waiting for ", "locator(") | begins(x, "expect(", "Expected", "Received", "Call log:", "-", "+", "attachment #", "screenshot #", ">", "|", "attempting ", "navigating to ", "clicking ") | x.rlike(r"\.(png|jpe?g|webm|zip|trace)") | x.rlike(r"^\d.* \|")
    kept = F.array_distinct(F.filter(inner, tells))
    detail = found(kept, lambda x: has(x, "Error:", "AssertionError") | x.rlike(r"^(expect\(|(Expected|Received)[: ])"))
    more = F.array_distinct(F.concat(kept, F.filter(inner, lambda x: ~x.startswith("at "))))
    return take(F.when(detail, kept).otherwise(more), 12)


def playwright() -> tuple[Column, Column, Column]:
    report = F.col("suites")
    header = r"^[✘×]\s+\d+\s+(?:\[[^\]]+\]\s+)?›\s+(.+?\.spec\.[tj]sx?)(?::\d+:\d+)?\s+›\s+(.+)$"
    total = lambda x: has(x, " passed", " failed", " skipped", "flaky")
    blocks = joined_blocks(CLEAN_LINES, lambda x: x.rlike(header), total)
    named = F.transform(blocks, lambda b: F.struct(say("{} > {}", part(F.substring_index(b, "\n", 1), header, 1), part(F.substring_index(b, "\n", 1), header, 2)).alias("name"), _playwright_lines(rest(F.split(b, "\n"))).alias("lines")))
    plain = _failures(joined_blocks(CLEAN_LINES, lambda x: begins(x, "✘", "×", "Error:"), total))
    text_failures = F.when(F.size(blocks) > 0, named.cast(FAILURE)).otherwise(plain.cast(FAILURE))
    of = lambda word: F.coalesce(last(F.regexp_extract_all(CLEAN, F.lit(rf"(\d+)\s+{word}"), F.lit(1))).try_cast("long"), F.lit(0))
    none = (of("passed") == 0) & (of("failed") == 0) & (of("skipped") == 0)
    text_line = F.when(none, F.lit("Playwright: no tests found")).otherwise(totals(of("passed"), of("failed"), of("skipped")))
    is_json = report["passed"].isNotNull()
    return (F.when(is_json, totals(report["passed"], report["failed"], report["skipped"])).otherwise(text_line), F.when(is_json, report["failures"]).otherwise(text_failures), F.when(is_json, report["millis"]).otherwise(duration_ms(CLEAN)))


def go() -> tuple[Column, Column, Column]:
    events = F.filter(F.transform(LINES, lambda x: F.from_json(F.when(F.try_parse_json(x).isNotNull(), x), GO_EVENT)), lambda e: e["Action"].isNotNull())
    stream = F.coalesce(first(LINES).startswith("{") & first(LINES).contains('"Action"'), F.lit(False))
    of = lambda action: count(events, lambda e: (e["Action"] == action) & e["Test"].isNotNull())
    place = F.transform(events, lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    fails = F.filter(place, lambda p: (p["e"]["Action"] == "fail") & p["e"]["Test"].isNotNull())
    same = lambda a, b: a["e"]["Package"].eqNullSafe(b["e"]["Package"]) & (a["e"]["Test"] == b["e"]["Test"])

    def failure(f: Column) -> Column:
        # what the test printed since it last failed
        before = F.coalesce(last(F.transform(F.filter(fails, lambda g: same(f, g) & (g["i"] < f["i"])), lambda g: g["i"])), F.lit(-1))
        said = F.filter(place, lambda p: (p["e"]["Action"] == "output") & same(f, p) & (p["i"] < f["i"]) & (p["i"] > before))
        rows = F.filter(F.transform(said, lambda p: trim(p["e"]["Output"])), lambda x: (x != "") & ~x.startswith("=== RUN"))
        package = F.coalesce(f["e"]["Package"], F.lit(""))
        return F.struct(F.when(package == "", f["e"]["Test"]).otherwise(say("{}::{}", package, f["e"]["Test"])).alias("name"), rows.alias("lines"))

    elapsed = F.array_max(F.transform(events, lambda e: F.floor(e["Elapsed"] * 1000).cast("long")))
    none = (of("pass") == 0) & (of("fail") == 0) & (of("skip") == 0)
    stream_line = F.when(none, F.lit("Go test: no tests found")).otherwise(totals(of("pass"), of("fail"), of("skip")))
    lines_of = lambda word: count(CLEAN_LINES, lambda x: x.startswith(f"--- {word}: "))
    blocks = joined_blocks(CLEAN_LINES, lambda x: x.startswith("--- FAIL: "), lambda x: begins(x, "--- ", "ok ") | (x == "FAIL"))
    text_none = (lines_of("PASS") == 0) & (lines_of("FAIL") == 0) & (lines_of("SKIP") == 0)
    text_line = F.when(text_none, F.when(has(CLEAN, "FAIL", "failed"), F.lit("Go test: failed")).otherwise(F.lit("Go test: ok"))).otherwise(totals(lines_of("PASS"), lines_of("FAIL"), lines_of("SKIP")))
    text_failures = _failures(blocks, lambda x: part(x, r"^--- FAIL: (\S+)"))
    return (F.when(stream, stream_line).otherwise(text_line), F.when(stream, F.transform(fails, failure).cast(FAILURE)).otherwise(text_failures.cast(FAILURE)), F.when(stream, elapsed).otherwise(duration_ms(CLEAN)))


def _gem(x: Column) -> Column:
    return has(x, "/gems/", "lib/rspec", "vendor/bundle", "lib/ruby/")


def without_noise(raw: Column) -> Column:
    """Lines without loader messages and coverage reports, which go on to the next empty line; screenshots by their path."""
    covers = lambda x: has(F.lower(x), "coverage report", "simplecov", "coverage/") | (F.lower(x).contains("all files") & F.lower(x).contains("lines"))

    def step(state: Column, line: Column) -> Column:
        noise = F.lower(line).contains("running via spring preloader") | begins(trim(line), "DEPRECATION WARNING:", "Finished in ")
        opens = ~noise & covers(line)
        inside = F.when(opens, F.lit(True)).when(state["inside"] & ~noise & (trim(line) == ""), F.lit(False)).otherwise(state["inside"])
        keep = ~noise & ~opens & ~state["inside"]
        shot = part(line, r"saved screenshot to (.*)$")
        return F.struct(inside.alias("inside"), F.when(keep, F.concat(state["out"], F.array(F.coalesce(say("[screenshot: {}]", trim(shot)), line)))).otherwise(state["out"]).alias("out"))

    return F.aggregate(raw, F.struct(F.lit(False).alias("inside"), NOTHING.alias("out")), step, lambda s: s["out"])


def rspec() -> tuple[Column, Column, Column]:
    kept = KEPT
    text = F.array_join(kept, "\n")
    rows = F.filter(F.transform(kept, trim), lambda x: x != "")
    payload = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    report = F.from_json(F.when(F.try_parse_json(payload).isNotNull(), payload), RSPEC_REPORT)
    own, is_json = report["summary"], report["summary"]["example_count"].isNotNull()
    outside = F.coalesce(own["errors_outside_of_examples_count"], F.lit(0))

    def example(e: Column) -> Column:
        error = e["exception"]
        trace = find(F.transform(F.coalesce(error["backtrace"], NOTHING), trim), lambda x: ~_gem(x))
        said = F.array(say("{}:{}", e["file_path"], e["line_number"]), F.when(error.isNotNull(), say("{}: {}", F.substring_index(error["class"], "::", -1), F.substring_index(error["message"], "\n", 1))), trace)
        return F.struct(e["full_description"].alias("name"), F.filter(said, lambda x: x.isNotNull()).alias("lines"))

    broken = F.array(F.struct(F.lit("RSpec errors outside of examples").alias("name"), F.array(F.concat(say("{} loader/runtime ", outside), plural(outside, "error", "errors"), F.lit(" prevented specs from running"))).alias("lines")))
    json_failures = F.when(own["example_count"] > 0, F.transform(F.filter(report["examples"], lambda e: e["status"] == "failed"), example).cast(FAILURE)).when(outside > 0, broken.cast(FAILURE)).otherwise(NO_FAILURES)
    json_passed = F.greatest(own["example_count"] - own["failure_count"] - own["pending_count"], F.lit(0))
    json_line = F.when(own["example_count"] > 0, totals(json_passed, own["failure_count"], own["pending_count"])).when(outside > 0, totals(F.lit(0), outside, F.lit(0))).otherwise(F.lit("RSpec: no examples found"))
    shape = r"(\d+)\s+examples?,\s+(\d+)\s+failures?(?:,\s+(\d+)\s+pending)?"
    total, failed, skipped = (number(text, shape, k) for k in (1, 2, 3))
    passed = F.greatest(total - failed - skipped, F.lit(0))
    text_line = F.when((passed == 0) & (failed == 0) & (skipped == 0), F.lit("RSpec: no examples found")).otherwise(totals(passed, failed, skipped))
    blocks = joined_blocks(rows, _numbered, lambda x: x.rlike(shape) | (x == "Failed examples:"))
    named = F.transform(_failures(blocks, lambda x: F.coalesce(F.nullif(F.trim(F.regexp_replace(x, r"^[^)]*\)", "")), F.lit("")), x)), lambda f: F.struct(f["name"].alias("name"), F.filter(f["lines"], lambda x: ~x.startswith("rspec ") & ~_gem(x)).alias("lines")))
    return (F.when(is_json, json_line).otherwise(text_line), F.when(is_json, json_failures).otherwise(named.cast(FAILURE)), F.when(is_json, F.floor(own["duration"] * 1000).cast("long")).otherwise(duration_ms(text)))


def minitest() -> tuple[Column, Column, Column]:
    shape = r"(\d+)\s+runs,\s+\d+\s+assertions,\s+(\d+)\s+failures?,\s+(\d+)\s+errors?,\s+(\d+)\s+skips?"
    total, failures, errors, skipped = (number(CLEAN, shape, k) for k in (1, 2, 3, 4))
    failed = failures + errors
    passed = F.greatest(total - failed - skipped, F.lit(0))
    blocks = F.filter(joined_blocks(CLEAN_LINES, _numbered, lambda x: x.rlike(shape)), lambda b: has(F.substring_index(b, "\n", 1), "Failure", "Error"))

    def block(b: Column) -> Column:
        rows = F.split(b, "\n")
        kind = F.when(first(rows).contains("Failure"), F.lit("Failure")).otherwise(F.lit("Error"))
        return F.struct(F.coalesce(F.try_element_at(rows, F.lit(2)), kind).alias("name"), rest(rows, 2).alias("lines"))

    none = (passed == 0) & (failed == 0) & (skipped == 0)
    return (F.when(none, F.lit("Minitest: no tests found")).otherwise(totals(passed, failed, skipped)), F.transform(blocks, block).cast(FAILURE), duration_ms(CLEAN))


def pytest() -> Summary:
    total = last(F.filter(LINES, lambda x: has(x, " passed", " failed", " skipped", " xfailed", " xpassed") & x.contains(" in ")))
    of = lambda word: F.coalesce(last(F.regexp_extract_all(total, F.lit(rf"(\d+)\s+{word}"), F.lit(1))).try_cast("long"), F.lit(0))
    passed, failed, skipped, xfailed, xpassed = (of(w) for w in ("passed", "failed", "skipped", "xfailed", "xpassed"))
    none = (passed == 0) & (failed == 0) & (skipped == 0) & (xfailed == 0) & (xpassed == 0)
    more = F.concat(*[F.when(n > 0, say(", {} " + w, n)).otherwise(F.lit("")) for n, w in ((skipped, "skipped"), (xfailed, "xfailed"), (xpassed, "xpassed"))])
    only = (failed == 0) & (skipped == 0) & (xfailed == 0) & (xpassed == 0)
    empty = F.when(has(OUT, "no tests ran", "collected 0 items"), F.lit("Pytest: No tests collected")).when(EXIT == 0, F.lit("Pytest: passed")).otherwise(F.lit("Pytest: failed"))
    headline = F.when(none, empty).when(only, say("Pytest: {} passed", passed)).otherwise(F.concat(say("Pytest: {} passed, {} failed", passed, failed), more))
    part_of = F.regexp_extract(OUT, r"(?sm)^\s*=== ?=*\s*FAILURES.*?$(.*?)(?:^\s*=+ short test summary|\z)", 1)
    body = F.filter(F.transform(F.split(part_of, r"\r?\n"), trim), lambda x: x != "")
    header = r"^_+\s+.+\s+_+$"
    blocks = joined_blocks(body, lambda x: x.rlike(header), lambda x: F.lit(False))
    tells = lambda x: begins(x, "E", ">") | has(x, "assert", ".py:", "AssertionError")
    failures = F.transform(blocks, lambda b: F.array_join(F.concat(F.array(F.trim(F.regexp_replace(F.substring_index(b, "\n", 1), r"^_+|_+$", ""))), F.filter(rest(F.split(b, "\n")), tells)), " | "))
    failures = F.when(F.size(failures) > 0, failures).otherwise(F.filter(LINES, lambda x: begins(x, "FAILED ", "ERROR ")))
    expected = F.filter(LINES, lambda x: begins(x, "XFAIL", "XPASS"))
    expected_rows = F.concat(F.transform(take(expected, 10), lambda x: F.concat(F.lit("  "), truncated(x, 140))), F.when(F.size(expected) > 10, F.array(say("  ... +{} more", F.size(expected) - 10))).otherwise(NOTHING))
    failure_rows = F.concat(F.transform(take(failures, 5), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), truncated(x, 140))), F.when(F.size(failures) > 5, F.array(say("... +{} more failures", F.size(failures) - 5))).otherwise(NOTHING))
    details = F.concat(section("Expected-failure outcomes:", expected_rows, gap=False), F.when(F.size(expected) > 0, section("Failures:", failure_rows, gap=True)).otherwise(section("Failures:", failure_rows, gap=False)))
    return Summary(headline, details, plain=True)


# ---- cargo ----


def _errors(rows: Column) -> Column:
    return count(rows, lambda x: x.startswith("error") | x.contains(": error["))


def _warnings(rows: Column) -> Column:
    return count(rows, lambda x: x.startswith("warning") | x.contains(": warning["))


def _build_like(headline: Column) -> Summary:
    clean = (_errors(BOTH) == 0) & (_warnings(BOTH) == 0)
    acts = F.filter(BOTH, lambda x: begins(x, "error", "warning") | has(x, "Finished", "Installed package"))
    said = F.filter(BOTH, lambda x: begins(x, "error", "warning"))
    stderr = F.when((EXIT == 0) & clean, NOTHING).when(F.size(said) > 0, take(said, 6)).otherwise(PREVIEW)
    return Summary(headline, F.when(clean, take(F.filter(BOTH, lambda x: x.contains("Finished")), 1)).otherwise(take(acts, 6)), stderr)


def cargo_build(name: str) -> Summary:
    counts = say(f"cargo {name}: {{}} errors, {{}} warnings", _errors(BOTH), _warnings(BOTH))
    clean = (_errors(BOTH) == 0) & (_warnings(BOTH) == 0) & (EXIT == 0)
    ok = F.lit("cargo clippy: No issues found" if name == "clippy" else f"cargo {name}: ok")
    installed = first(matching(BOTH, r"^Installed package `([^`(]*?)(?: \([^`]*)?`")) if name == "install" else F.lit(None).cast("string")
    return _build_like(F.coalesce(F.when(EXIT == 0, F.concat(F.lit(f"cargo {name}: installed "), F.trim(installed))), F.when(clean, ok), counts))


def cargo_test(label: str) -> Summary:
    results = F.filter(BOTH, lambda x: x.startswith("test result:"))
    summed = lambda word: F.aggregate(F.transform(results, lambda x: number(x, rf"(\d+) {word}")), F.lit(0).cast("long"), lambda a, b: a + b)
    times = F.transform(F.filter(F.transform(results, lambda x, i: F.struct(F.coalesce(F.regexp_extract(x, r"finished in ([0-9.]+)s", 1).try_cast("double"), F.lit(-1.0)).alias("s"), (-i).alias("i"), part(x, r"finished in ([^;]*?)\.?$").alias("text"))), lambda t: t["text"].isNotNull()), lambda t: t)
    longest = F.array_max(times)["text"]
    run = F.concat(say("{} passed; {} failed; {} ignored; {} measured; {} filtered out", *[summed(w) for w in ("passed", "failed", "ignored", "measured", "filtered out")]), F.coalesce(F.concat(F.lit("; finished in "), longest), F.lit("")))
    opens = lambda x: F.ltrim(x).startswith("error[")
    goes_on = lambda x: x.rlike(r"^[ \t]") | begins(F.ltrim(x), "--> ", "|", "= note:", "= help:", "note:", "help:", "For more information")
    closes = lambda x: has(x, "could not compile", "aborting due to")
    compile_blocks = joined_blocks(F.transform(RAW, lambda x: F.when(opens(x) | closes(x), F.ltrim(x)).otherwise(x)), opens, lambda x: ~goes_on(x) & ~closes(x))
    broken = F.size(compile_blocks) > 0
    crates = count(RAW, lambda x: begins(F.ltrim(x), "Compiling", "Checking"))
    broken_line = F.concat(say(f"{label}: {{}} errors, {{}} warnings", F.size(compile_blocks), _warnings(BOTH)), F.when(crates > 0, say(" ({} crates)", crates)).otherwise(F.lit("")))
    headline = F.when(F.size(results) > 0, F.concat(F.lit(f"{label}: "), run)).when(broken, broken_line).otherwise(say(f"{label}: {{}} errors, {{}} warnings", _errors(BOTH), _warnings(BOTH)))
    ok_names = matching(BOTH, r"^test (.*) \.\.\. ok$")
    failed_names = F.transform(matching(BOTH, r"^---- (.*)$"), lambda x: F.regexp_replace(x, r"( stdout ----)+$", ""))
    blocks = joined_blocks(F.filter(BOTH, lambda x: begins(x, "error[", "error:", "warning", "test result:", "-->", "For more information") | x.contains("could not compile")), lambda x: begins(x, "error[", "error:"), lambda x: begins(x, "warning", "test result:"), " | ")
    details = F.when((EXIT == 0) & (F.size(ok_names) > 0) & (F.size(ok_names) <= 20), ok_names).when(F.size(failed_names) > 0, take(failed_names, 6)).when(broken, cut(compile_blocks, 15, "issues")).otherwise(take(blocks, 6))
    acts = F.filter(BOTH, lambda x: begins(x, "error", "warning") | has(x, "Finished", "Installed package"))
    shown = F.when(F.size(blocks) > 0, blocks).otherwise(acts)
    stderr = F.when(((EXIT == 0) & (F.size(details) == 0)) | broken, NOTHING).when(F.size(shown) > 0, take(shown, 6)).otherwise(PREVIEW)
    return Summary(headline, details, stderr, plain=broken)


REPORTS = {"test.jest": lambda: javascript("Jest"), "test.vitest": lambda: javascript("Vitest"), "test.playwright": playwright, "test.go": go, "test.rspec": rspec, "test.minitest": minitest}
SUMMARIES = {
    **dict.fromkeys(REPORTS, presented), "python.pytest": pytest,
    **{f"rust.cargo-{n}": (lambda n=n: cargo_build(n)) for n in ("build", "check", "install", "clippy")},
    "rust.cargo-test": lambda: cargo_test("cargo test"), "rust.cargo-nextest": lambda: cargo_test("cargo nextest"),
}
