"""Containers, clusters, code hosting, package managers and builds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.argv import positional
from tracewell.functions.text import lines, one_space, table_columns, trim, truncated, words
from tracewell.operators.summarize.base import ARGS, BOTH, ERR_LINES, EXIT, LINES, NOTHING, OUT, OUT_LINES, PREVIEW, STDOUT, Summary, begins, count, cut, find, first, has, last, matching, rest, say, take

#: Lines of a table without its header.
ROWS = F.filter(F.transform(rest(lines(STDOUT)), trim), lambda x: x != "")
#: Flags of the log command that take a value.
LOG_FLAGS = ("-n", "--namespace", "-c", "--container", "--context", "--selector", "-l", "--field-selector", "--tail", "--since")


def low(line: Column, word: str) -> Column:
    return F.lower(line).contains(word)


def _up(row: Column) -> Column:
    return find(table_columns(row), lambda c: (c == "Up") | begins(c, "Up ", "Exited "))


def _container(row: Column) -> Column:
    c = table_columns(row)
    long = say("{} — {} ({})", last(c), F.try_element_at(c, F.lit(2)), F.coalesce(_up(row), one_space(row)))
    three = say("{} — {} ({})", first(c), F.try_element_at(c, F.lit(2)), F.try_element_at(c, F.lit(3)))
    return F.when(F.size(c) <= 1, F.coalesce(first(c), F.lit(""))).when(F.size(c) == 3, three).otherwise(long)


def ps() -> Summary:
    running = count(ROWS, lambda r: F.coalesce((_up(r) == "Up") | _up(r).startswith("Up "), F.lit(False)))
    return Summary(say("{} containers; {} running", F.size(ROWS), running), F.transform(take(ROWS, 8), _container))


def _megabytes(size: Column) -> Column:
    value = F.coalesce(F.regexp_extract(size, r"(?i)^\s*([0-9.]+)\s*(?:gb|mb|kb|b)\s*$", 1).try_cast("double"), F.lit(0.0))
    unit = F.lower(F.regexp_extract(size, r"(?i)(gb|mb|kb|b)\s*$", 1))
    return value * F.when(unit == "gb", 1024.0).when(unit == "mb", 1.0).when(unit == "kb", 1 / 1024).otherwise(1 / 1048576)


def images() -> Summary:
    total = F.aggregate(F.transform(ROWS, lambda r: _megabytes(last(table_columns(r)))), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    text = F.when(total >= 1024, F.format_string("%.1fGB", total / 1024)).when(total >= 1, F.format_string("%.0fMB", total)).when(total > 0, F.format_string("%.1fkB", total * 1024)).otherwise(F.lit("?"))

    def row(r: Column) -> Column:
        c = table_columns(r)
        at = lambda k: F.try_element_at(c, F.lit(k))
        tagged = say("{}:{}", at(1), at(2))
        return F.when(F.size(c) <= 1, F.coalesce(at(1), F.lit(""))).when(F.size(c) == 2, tagged).when(F.size(c) >= 5, say("{} — {} ({})", tagged, at(3), at(5))).otherwise(say("{} — {}", tagged, at(3)))

    return Summary(say("{} images ({})", F.size(ROWS), text), F.transform(take(ROWS, 8), row))


def _ports(text: Column) -> Column:
    each = F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_extract(F.substring_index(p, "->", 1), r"([^:]*)$", 1)))
    few = F.array_join(each, ", ")
    return F.when(F.trim(text).isin("", "-"), F.lit("-")).when(F.size(each) <= 3, few).otherwise(say("{}, … +{}", F.array_join(take(each, 2), ", "), F.size(each) - 2))


def compose() -> Summary:
    table = F.coalesce(first(LINES).contains("NAME") & first(LINES).contains("IMAGE") & first(LINES).contains("STATUS"), F.lit(False))

    def row(r: Column) -> Column:
        c = table_columns(r)
        at = lambda k: F.try_element_at(c, F.lit(k))
        base = say("{} ({}) {}", at(1), F.regexp_extract(at(2), r"([^/]*)$", 1), at(3))
        ports = _ports(at(4))
        return F.when(F.size(c) < 4, _container(r)).when(ports == "-", base).otherwise(say("{} [{}]", base, ports))

    headline = F.when(table, say("{} services", F.size(LINES) - 1)).otherwise(say("compose output: {} lines", F.size(LINES)))
    return Summary(headline, F.when(table, F.transform(take(rest(LINES), 20), row)).otherwise(take(LINES, 6)))


def _source(skip: str, other: str) -> Column:
    return F.coalesce(last(F.filter(ARGS, lambda x: ~x.startswith("-") & (x != skip))), F.lit(other))


def _log_headline(source: Column, rows: Column) -> Column:
    errors, warnings = count(rows, lambda x: low(x, "error")), count(rows, lambda x: low(x, "warn"))
    return F.when((errors > 0) | (warnings > 0), say("logs for {}: {} errors, {} warnings", source, errors, warnings)).otherwise(say("logs for {}: {} lines", source, F.size(rows)))


def docker_logs() -> Summary:
    """Error lines first."""
    errors = F.filter(LINES, lambda x: low(x, "error"))
    return Summary(_log_headline(_source("logs", "docker"), LINES), take(F.when(F.size(errors) > 0, errors).otherwise(LINES), 8))


def docker_build() -> Summary:
    steps = F.filter(LINES, lambda x: x.startswith("Step ") | (x.startswith("#") & has(x, "[", "exporting to image")))
    stages = F.size(F.array_distinct(matching(LINES, r"^(#\S*) ")))
    services = F.filter(F.array_distinct(matching(LINES, r"\[\s*([^\]\s]+)[^\]]*\]")), lambda x: x != "+")
    done = last(F.filter(LINES, lambda x: has(x, "Successfully tagged", "writing image") | (x.contains("naming to ") & ~x.contains("sha256:"))))
    state = F.coalesce(done, find(LINES, lambda x: x.contains("Building") & x.contains("FINISHED")), F.lit("build completed"))
    more = F.when(F.size(services) > 0, F.array(F.concat(F.lit("services: "), F.array_join(services, ", ")))).otherwise(NOTHING)
    headline = F.when(EXIT == 0, F.lit("Build successful")).otherwise(say("{}; stages={}", state, stages))
    return Summary(headline, F.concat(take(steps, 6), more), F.when(F.size(OUT_LINES) == 0, NOTHING).otherwise(PREVIEW))


def inspect() -> Summary:
    value = F.try_parse_json(OUT)
    kind = F.schema_of_variant(value)
    many = F.try_variant_get(value, "$", "array<variant>")
    is_list, is_map = kind.startswith("ARRAY"), kind.startswith("OBJECT")
    one = F.when(is_list, F.try_element_at(many, F.lit(1))).when(is_map, value)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(one, path, "variant")) == "STRING", F.try_variant_get(one, path, "string"))
    known = F.filter(F.array(F.concat(F.lit("name="), F.regexp_replace(text("$.Name"), "^/+", "")), F.concat(F.lit("id="), F.substring(text("$.Id"), 1, 12)), F.concat(F.lit("image="), F.substring(text("$.Image"), 1, 20)), F.concat(F.lit("status="), text("$.State.Status"))), lambda x: x.isNotNull())
    keys = F.coalesce(F.json_object_keys(F.to_json(one)), NOTHING)
    details = F.when(F.size(known) > 0, known).otherwise(take(keys, 6))
    headline = F.when(is_list & (F.size(details) > 0), say("{} inspect objects; {}", F.size(many), first(details))).when(is_list, say("{} inspect objects", F.size(many))).when(is_map, F.coalesce(first(details), say("inspect keys={}", F.size(keys)))).otherwise(say("lines={}", F.size(LINES)))
    return Summary(headline, F.when(is_list | is_map, rest(details)).otherwise(take(LINES, 6)))


def docker_pull() -> Summary:
    layers = take(F.filter(LINES, lambda x: has(x, ": Pulling", ": Download", ": Extracting", "Downloaded newer image", "Image is up to date")), 8)
    source = _source("pull", "image")
    done = F.coalesce(find(LINES, lambda x: x.contains("Downloaded newer image")), find(LINES, lambda x: x.contains("Image is up to date")))
    return Summary(F.coalesce(say("{} ok | {}", source, done), say("{} pull | {} layer updates", source, F.size(layers))), layers)


# ---- clusters ----


def pods() -> Summary:
    rows = F.transform(ROWS, words)
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    of = lambda *names: count(rows, lambda c: F.coalesce(at(c, 3).isin(*names), F.lit(False)))
    restarts = F.aggregate(F.transform(rows, lambda c: F.when(at(c, 4).rlike(r"^\d+$"), at(c, 4).try_cast("long"))), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0)))

    def row(c: Column) -> Column:
        again = F.when(at(c, 4) != "0", say(" ({} restarts)", at(c, 4)))
        return F.concat(at(c, 1), F.lit(" "), F.coalesce(at(c, 3), F.lit("unknown")), F.coalesce(again, F.lit("")))

    failed = of("Error", "Failed", "CrashLoopBackOff", "ImagePullBackOff")
    return Summary(say("{} pods | running={} pending={} failed={} restarts={}", F.size(rows), of("Running"), of("Pending"), failed, restarts), F.transform(take(rows, 8), row))


def services() -> Summary:
    rows = F.transform(ROWS, words)
    at = lambda c, k, other: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(other))
    return Summary(say("{} services", F.size(rows)), F.transform(take(rows, 8), lambda c: say("{} {} [{}]", at(c, 1, "service"), at(c, 2, "ClusterIP"), at(c, 5, "-"))))


def kube_logs() -> Summary:
    """The first lines, errors or not."""
    target = F.coalesce(find(positional(ARGS, LOG_FLAGS), lambda x: x != "logs"), F.lit("pod"))
    return Summary(_log_headline(target, OUT_LINES), take(OUT_LINES, 8))


def describe() -> Summary:
    known = take(F.transform(F.filter(OUT_LINES, lambda x: begins(x, "Name:", "Namespace:", "Status:", "Node:", "Replicas:", "Image:", "Reason:")), one_space), 8)
    at = F.array_position(F.transform(OUT_LINES, lambda x: x.startswith("Events:")), F.lit(True)).cast("int")
    events = F.when(at > 0, F.filter(F.slice(OUT_LINES, at + 1, F.size(OUT_LINES)), lambda x: ~begins(x, "Type", "----", "Events:"))).otherwise(NOTHING)
    events = F.transform(F.slice(events, F.greatest(F.size(events) - 1, F.lit(1)), F.lit(2)), one_space)
    details = F.concat(known, events)
    name, state = first(matching(details, r"^Name:\s*(.*)$")), first(matching(details, r"^Status:\s*(.*)$"))
    return Summary(F.coalesce(say("{} {}", name, state), first(details), say("describe: {} lines", F.size(OUT_LINES))), rest(details))


def _ends(word: str):
    return lambda x: x.endswith(word)


def apply() -> Summary:
    kinds = ("created", "configured", "unchanged", "deleted")
    counts = {k: count(OUT_LINES, _ends(f" {k}")) for k in kinds}
    parts = F.filter(F.array(*[F.when(n > 0, say("{} " + k, n)) for k, n in counts.items()]), lambda x: x.isNotNull())
    return Summary(F.when(F.size(parts) > 0, F.concat(F.lit("kubectl apply: "), F.array_join(parts, ", "))).otherwise(say("kubectl apply: {} lines", F.size(OUT_LINES))), take(OUT_LINES, 8))


# ---- code hosting ----


def _hosting(noun: str, none: str, row) -> Summary:
    """All rows count; ten are shown."""
    rows = F.transform(F.filter(OUT_LINES, lambda x: ~x.startswith("Showing ")), row)
    listing = F.coalesce(F.try_element_at(ARGS, F.lit(2)) == "list", F.lit(False))
    shown = take(rows, 10)
    headline = F.when(F.size(rows) == 0, F.lit(none)).when(listing, say("{} " + noun, F.size(rows))).otherwise(truncated(first(shown), 120))
    return Summary(headline, F.when(listing, shown).otherwise(rest(shown)))


def _cells(line: Column) -> Column:
    return F.when(line.contains("\t"), F.split(line, "\t")).otherwise(words(line))


def pull_requests() -> Summary:
    return _hosting("PRs", "No PRs", lambda x: say("#{} {}", F.regexp_replace(first(_cells(x)), "^#+", ""), F.coalesce(F.try_element_at(_cells(x), F.lit(2)), x)))


def issues() -> Summary:
    return _hosting("issues", "No issues", lambda x: say("#{} {}", F.regexp_replace(first(_cells(x)), "^#+", ""), F.coalesce(F.try_element_at(_cells(x), F.lit(3)), F.try_element_at(_cells(x), F.lit(2)), x)))


def runs() -> Summary:
    def row(x: Column) -> Column:
        c = F.split(x, "\t")
        end = F.nullif(F.try_element_at(c, F.lit(2)), F.lit(""))
        base = say("{} ({})", F.coalesce(F.try_element_at(c, F.lit(3)), x), F.coalesce(end, first(c)))
        number_ = find(c, lambda v: v.rlike(r"^\d*$"))
        return F.when(x.contains("\t"), F.coalesce(say("{} [{}]", base, number_), base)).otherwise(one_space(x))

    return _hosting("runs", "No runs", row)


# ---- package managers and builds ----


def node() -> Summary:
    noise = lambda x: begins(x, ">", "npm WARN", "npm notice", "WARN ", "Done in 0.0", "Packages: ", "Progress: ", "Resolving: ", "Downloading ", "[1/", "[2/", "[3/", "[4/", "Already up to date")
    rows = F.filter(F.transform(F.filter(OUT_LINES, lambda x: ~begins(x, ">", "npm WARN", "npm notice", "WARN ", "Done in 0.0")), one_space), lambda x: ~noise(x))
    errors = take(F.transform(F.filter(ERR_LINES, lambda x: ~x.startswith("$ ")), one_space), 5)
    return Summary(F.coalesce(truncated(first(rows), 120), F.lit("ok")), cut(rest(rows), 30, "lines"), errors)


def package_tool(name: str) -> Summary:
    """The count of what isn't shown is taken before the last filters."""
    rows = F.filter(F.transform(LINES, one_space), lambda x: ~begins(x, "Downloading ", "Prepared ", "Resolved ", "Uninstalled "))
    key = find(rows, lambda x: begins(x, "Successfully installed", "Requirement already satisfied", "No dependencies to install or update", "Package operations:", "Installing dependencies from lock file", "Installed ", "Using Python ", "error:", "ERROR:"))
    headline = F.coalesce(key, first(rows), F.lit(f"{name}: ok"))
    others = F.filter(rows, lambda x: x != headline)
    shown = F.filter(others, lambda x: ~begins(x, "Collecting ", "Using cached ", "Installing collected packages"))
    return Summary(headline, cut(shown, 8, "lines", F.size(others)))


def tsc() -> Summary:
    errors = F.transform(F.filter(BOTH, lambda x: x.contains(" error TS")), one_space)
    files = F.size(F.array_distinct(F.transform(errors, lambda x: F.substring_index(x, "(", 1))))
    return Summary(F.when(F.size(errors) == 0, F.lit("TypeScript: No errors found")).otherwise(say("TypeScript: {} errors in {} files", F.size(errors), files)), take(errors, 8))


def web_build(name: str) -> Summary:
    done = truncated(find(BOTH, lambda x: has(x, "built in", "Compiled successfully")), 120)
    return Summary(F.coalesce(done, F.lit(f"{name} build: complete")), take(F.filter(BOTH, lambda x: begins(x, "dist/", "Route", "├", "└")), 8))


def make() -> Summary:
    return Summary(F.coalesce(find(BOTH, lambda x: has(x, "Nothing to be done", "Error")), F.lit("make: ok")), take(BOTH, 6))


def build_tool(name: str) -> Summary:
    state = F.coalesce(find(BOTH, lambda x: has(x, "BUILD SUCCESSFUL", "BUILD FAILED")), find(BOTH, lambda x: has(x, "SUCCESS", "FAILURE")), F.lit(f"{name}: done"))
    return Summary(state, take(F.filter(BOTH, lambda x: x.startswith("> Task") | has(x, "ERROR", "FAILURE")), 8))


def dotnet(name: str) -> Summary:
    state = find(BOTH, lambda x: has(x, "Build succeeded", "Build FAILED", "Passed!", "Restore completed", "No files were formatted"))
    return Summary(F.coalesce(state, F.lit(f"dotnet {name}: done")), take(F.filter(BOTH, lambda x: begins(x, "error", "warning") | has(x, "Passed!", "Failed!")), 8))


SUMMARIES = {
    "docker.ps": ps, "docker.images": images, "docker.compose": compose, "docker.logs": docker_logs, "docker.build": docker_build, "docker.inspect": inspect, "docker.pull": docker_pull,
    "k8s.kubectl-pods": pods, "k8s.kubectl-services": services, "k8s.kubectl-logs": kube_logs, "k8s.kubectl-describe": describe, "k8s.kubectl-apply": apply,
    "gh.pr": pull_requests, "gh.issue": issues, "gh.run": runs,
    "python.pip": lambda: package_tool("pip"), "python.uv": lambda: package_tool("uv"), "python.poetry": lambda: package_tool("poetry"),
    "build.tsc": tsc, "build.next": lambda: web_build("Next"), "build.vite": lambda: web_build("Vite"), "build.make": make,
    **{f"node.{n}": node for n in ("npm", "pnpm", "yarn", "bun", "npx")},
    **{f"build.{n}": (lambda n=n: build_tool(n)) for n in ("gradle", "maven", "cmake")},
    **{f"build.dotnet-{n}": (lambda n=n: dotnet(n)) for n in ("build", "test", "restore", "format")},
}
