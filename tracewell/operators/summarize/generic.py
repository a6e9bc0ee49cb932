"""Listings, searches, streams, environments, excerpts, and whatever has no summary of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.argv import search_query
from tracewell.functions.text import around_match, extension, lines, non_empty, rendered_full, trim, truncated, words
from tracewell.operators.summarize.base import ARGS, ARGV, ERR_LINES, LINES, NOTHING, OUT, OUT_LINES, PREVIEW, STDERR, STDOUT, Summary, begins, count, cut, first, found, held, last, matching, runs_of, say, take, tallied

PER_FILE, HITS = 25, 200
#: Environment variables by class; a class has a quota.
LANGUAGE_KEYS = ["RUSTUP_HOME", "CARGO_HOME", "RUST_LOG", "GOENV", "GOMOD", "GOPATH", "PYTHONPATH", "VIRTUAL_ENV", "BUNDLE_PATH", "GEM_HOME", "NODE_ENV", "NVM_DIR"]
OTHER_KEYS = ["HOME", "USER", "SHELL", "PWD", "LANG", "EDITOR", "TMPDIR"]
QUOTAS = {"path": 2, "language": 3, "cloud": 3, "tool": 3, "other": 3}
PERMISSIONS = r"^[-dlbcps]\S{9,}$"


def env_class(key: Column) -> Column:
    """path, language, cloud, tool, other or null."""
    return (
        F.when(key.contains("PATH"), F.lit("path"))
        .when(key.isin(LANGUAGE_KEYS), F.lit("language"))
        .when(begins(key, "AWS_", "AZURE_", "GCP_", "GOOGLE_", "CLOUD_"), F.lit("cloud"))
        .when(begins(key, "DOCKER_", "KUBECONFIG", "GIT_", "CI", "TERM"), F.lit("tool"))
        .when(key.isin(OTHER_KEYS), F.lit("other"))
    )


def _of_class(name: str):
    return lambda p: env_class(p["k"]) == name


def env() -> Summary:
    pairs = F.transform(F.filter(OUT_LINES, lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "(?s)^[^=]*=", "").alias("v")))

    def value(p: Column) -> Column:
        secret = F.upper(p["k"]).rlike("TOKEN|SECRET|PASSWORD|KEY|CREDENTIAL")
        return F.when(secret, F.lit("***")).when(p["k"] == "PATH", say("{} entries", F.size(F.split(p["v"], ":")))).otherwise(truncated(p["v"], 60))

    shown = [F.transform(take(F.filter(pairs, _of_class(c)), n), lambda p: say("{}={}", p["k"], value(p))) for c, n in QUOTAS.items()]
    details = F.concat(*shown)
    return Summary(say("vars={}; shown={}", F.size(OUT_LINES), F.size(details)), details)


def capped_hits(hits: Column) -> Column:
    """The first hits in order, 25 of a file and 200 in all at most."""
    placed = F.array_sort(F.transform(hits, lambda h, i: F.struct(F.substring_index(h, ":", 1).alias("file"), i.alias("at"), h.alias("hit"))))

    def first(ordered: Column) -> Column:
        of_file = F.transform(runs_of(ordered, lambda x: x["file"]), lambda r: F.slice(ordered, r["at"] + 1, F.least(r["n"], F.lit(PER_FILE))))
        return F.flatten(of_file)

    back = F.array_sort(F.transform(held(placed, first), lambda x: F.struct(x["at"].alias("at"), x["hit"].alias("hit"))))
    return take(F.transform(back, lambda x: x["hit"]), HITS)


def search() -> Summary:
    hits = F.filter(lines(STDOUT), lambda x: trim(x) != "")
    query = F.coalesce(F.trim(search_query(F.slice(ARGV, 2, F.greatest(F.size(ARGV), F.lit(1))), ("-e", "--regexp", "-f", "--file", "-g", "--glob", "-t", "--type", "-A", "-B", "-C", "-m", "--max-count"))), F.lit(""))
    shown = capped_hits(hits)
    pattern = r"(?s)^([^:]*:[^:]*:)(.*)$"
    rows = F.transform(shown, lambda h: F.when(h.rlike(pattern), F.concat(F.regexp_extract(h, pattern, 1), around_match(F.regexp_extract(h, pattern, 2), query))).otherwise(around_match(h, query)))
    more = F.when(F.size(hits) > F.size(shown), F.array(say("+ {} more matches", F.size(hits) - F.size(shown)))).otherwise(NOTHING)
    return Summary(F.when(F.size(hits) == 0, F.lit("0 matches")).otherwise(F.lit("")), F.concat(rows, more), plain=True)


def file_list() -> Summary:
    return Summary(F.lit(""), cut(lines(STDOUT), 200, "files"), plain=True)


def find_paths() -> Summary:
    paths = non_empty(STDOUT)
    folders = F.size(F.array_distinct(F.transform(paths, lambda p: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(p, "(?<=.)/+$", ""), r"/?[^/]*$", ""), F.lit("")), F.when(p.startswith("/"), F.lit("/")), F.lit(".")))))
    ends = tallied(F.transform(paths, lambda p: F.coalesce(F.concat(F.lit("."), extension(p)), F.lit("no-ext"))))
    top = F.array_join(F.transform(take(ends, 5), lambda t: say("{} {}", t["n"], t["key"])), ", ")
    return Summary(F.when(F.size(paths) == 0, F.lit("0 paths")).otherwise(say("{} paths in {} dirs ({})", F.size(paths), folders, top)), cut(paths, 80, "paths"))


def listed_size(raw: Column) -> Column:
    """Plain bytes in short form; other texts as they are."""
    n = raw.try_cast("double")
    return F.when(~raw.rlike(r"^\d+$") | n.isNull(), raw).when(n < 1024, F.concat(raw, F.lit("B"))).when(n < 1024**2, F.format_string("%.1fK", n / 1024)).when(n < 1024**3, F.format_string("%.1fM", n / 1024**2)).otherwise(F.format_string("%.1fG", n / 1024**3))


def listing() -> Summary:
    """Short lists by name; long ones by kind with sizes and extensions.

    Which names of a short list are folders is in the column `dir_names` if the runs have it (from a table of
    files); nothing is looked up on a disk.
    """
    flags = found(ARGS, lambda x: (x == "--format=long") | x.rlike(r"^-[^-]*[lgo]"))
    long_row = lambda x: (F.size(words(x)) >= 9) & F.coalesce(first(words(x)).rlike(PERMISSIONS), F.lit(False))
    long = flags | found(OUT_LINES, long_row)
    rows = F.filter(OUT_LINES, lambda x: ~x.startswith("total ") & ~(long_row(x) & F.coalesce(F.try_element_at(words(x), F.lit(9)).isin(".", ".."), F.lit(False))))

    def parsed(x: Column) -> Column:
        c = words(x)
        mode = first(c)
        kind = F.when(~long_row(x), F.lit("other")).when(mode.startswith("d"), F.lit("dir")).when(begins(mode, "-", "l"), F.lit("file")).otherwise(F.lit("other"))
        name = F.when(long_row(x), F.array_join(F.slice(c, 9, F.greatest(F.size(c), F.lit(1))), " ")).otherwise(x)
        return F.struct(kind.alias("kind"), name.alias("name"), F.coalesce(F.try_element_at(c, F.lit(5)), F.lit("")).alias("size"), (long_row(x) & name.startswith(".")).alias("hidden"))

    items = F.transform(rows, parsed)
    of = lambda kind, show: F.array_sort(F.transform(F.filter(items, lambda i: i["kind"] == kind), show))
    dirs, files, others = of("dir", lambda i: F.concat(i["name"], F.lit("/"))), of("file", lambda i: say("{}  {}", i["name"], listed_size(i["size"]))), of("other", lambda i: i["name"])
    ends = F.array_sort(F.transform(tallied(F.filter(F.transform(F.filter(items, lambda i: i["kind"] == "file"), lambda i: extension(i["name"])), lambda e: e.isNotNull())), lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))))
    hidden = count(items, lambda i: i["hidden"])
    by_end = F.array_join(F.transform(ends, lambda t: say("{} .{}", t["n"], t["key"])), ", ")
    long_line = F.concat(say("Summary: {} files, {} dirs", F.size(files), F.size(dirs)), F.when(hidden > 0, say(" ({} hidden)", hidden)).otherwise(F.lit("")), F.when(F.size(ends) > 0, say(" ({})", by_end)).otherwise(F.lit("")))
    known = F.coalesce(F.col("dir_names"), NOTHING)
    folders = F.array_sort(F.transform(F.filter(OUT_LINES, lambda x: F.array_contains(known, x)), lambda x: F.concat(x, F.lit("/"))))
    plain = F.array_sort(F.filter(OUT_LINES, lambda x: ~F.array_contains(known, x)))
    names, dots = F.concat(folders, plain), count(OUT_LINES, lambda x: x.startswith("."))
    short_line = F.concat(say("entries={}", F.size(OUT_LINES)), F.when(F.size(known) > 0, say("; dirs={}; files={}", F.size(folders), F.size(plain))).otherwise(F.lit("")), F.when(dots > 0, say("; hidden={}", dots)).otherwise(F.lit("")))
    short = F.when(F.size(names) <= 20, names).otherwise(cut(names, 35, "entries"))
    return Summary(F.when(long, long_line).otherwise(short_line), F.when(long, cut(F.concat(dirs, files, others), 120, "entries")).otherwise(short))


def stream_source(args: Column) -> Column:
    """The last argument that is no flag, without user and query."""
    source = last(F.filter(args, lambda x: ~x.startswith("-")))
    plain = F.regexp_replace(F.regexp_replace(source, r"(?<=://)[^/?@]+@", "[REDACTED]@"), r"(?s)^([^?]*://[^?]*)\?.*$", "$1?…")
    return truncated(F.when(source.contains("Authorization:") | source.contains("authorization:"), F.lit("[REDACTED]")).otherwise(plain), 50)


def _stream() -> Summary:
    n = F.size(OUT_LINES)
    source = F.coalesce(stream_source(ARGS), first(ARGV))
    headline = F.concat(say("{} ok | {} lines | {}B", source, n, F.octet_length(STDOUT)), F.when(F.size(ERR_LINES) > 0, say("; stderr_lines={}", F.size(ERR_LINES))).otherwise(F.lit("")))
    over = F.when(n > 20, F.array(say("+ {} more lines", n - 10))).otherwise(NOTHING)
    return Summary(headline, F.concat(take(OUT_LINES, 10), over))


def _json(text: Column) -> Column:
    return text.rlike(r'(?s)^(\{.*\}|\[.*\]|".*")$')


def curl() -> Summary:
    body, stream = trim(STDOUT), _stream()
    return Summary(F.when(_json(body), say("json response | {}B", F.octet_length(body))).otherwise(stream.headline), F.when(_json(body), take(OUT_LINES, 12)).otherwise(stream.details))


def wget() -> Summary:
    stream = _stream()
    flag = F.array_position(F.transform(ARGS, lambda x: x.isin("-O", "--output-document")), F.lit(True)).cast("int")
    named = F.coalesce(F.when(flag > 0, F.try_element_at(ARGS, flag + 1)), first(matching(ARGS, r"^-O(.+)$")))
    saved = F.trim(first(matching(lines(STDERR), r"(?:Saving to|Sauvegarde en)[^'«]*['«]([^'»]*)['»]")))
    address = F.regexp_replace(F.regexp_extract(last(F.filter(ARGS, lambda x: ~x.startswith("-"))), r"([^/]*)$", 1), r"\?.*$", "")
    file = F.coalesce(named, saved, F.when(address == "", F.lit("index.html")).otherwise(address), F.lit("download"))
    size = F.coalesce(F.trim(first(matching(ERR_LINES, r"saved \[([^\]]*)\]"))), F.lit("?"))
    quiet = F.size(OUT_LINES) == 0
    return Summary(F.when(quiet, say("{} ok | {} | {}", F.coalesce(stream_source(ARGS), first(ARGV)), file, size)).otherwise(stream.headline), F.when(quiet, NOTHING).otherwise(stream.details))


def _text() -> Column:
    return F.when(STDOUT != "", STDOUT).otherwise(OUT)


def excerpt(name: str) -> Summary:
    return Summary(say(f"{name}_lines={{}}; bytes={{}}", F.when(STDOUT != "", F.size(OUT_LINES)).otherwise(F.size(LINES)), F.octet_length(STDOUT)), take(F.when(STDOUT != "", OUT_LINES).otherwise(LINES), 8))


def verbatim() -> Summary:
    return Summary(F.lit(""), lines(_text()), plain=True)


def fallback() -> Summary:
    """Short outputs as they are; of others a headline and the first lines, more for programs that transform text."""
    program, n = first(ARGV), F.size(LINES)
    limit = F.when(program.isin("jq", "sed"), 120).when(program.isin("sh", "bash", "zsh"), 80).otherwise(40)
    as_is = (n > 0) & (n <= limit)
    size, out, err = F.octet_length(rendered_full(STDOUT, STDERR)), F.size(OUT_LINES), F.size(ERR_LINES)
    counted = F.when(n == 1, F.lit("1 line")).otherwise(say("{} lines", n))
    headline = (
        F.when(n == 0, F.lit("no output"))
        .when((program == "jq") & _json(trim(STDOUT)), F.when(n == 1, say("JSON output | {}B", size)).otherwise(say("JSON output | {} lines | {}B", n, size)))
        .when((err > 0) & (out == 0), say("{} stderr lines | {}B", err, size))
        .when((out > 0) & (err == 0), F.concat(counted, say(" | {}B", size)))
        .otherwise(say("{} lines | {} stderr lines | {}", n, err, truncated(first(LINES), 80)))
    )
    over = F.when(n > limit, F.array(say("+ {} more lines", n - limit))).otherwise(NOTHING)
    details = F.concat(F.slice(LINES, F.lit(1), limit), over)
    return Summary(F.when(as_is, F.lit("")).otherwise(headline), F.when(as_is, lines(OUT)).otherwise(details), F.when(as_is, NOTHING).otherwise(PREVIEW), as_is)


SUMMARIES = {
    "generic.ls": listing, "generic.find": find_paths, "generic.rg": search, "generic.grep": search, "generic.rg-files": file_list, "generic.curl": curl, "generic.wget": wget, "generic.env": env,
    **{f"generic.{n}": (lambda n=n: excerpt(n)) for n in ("cat", "head", "tail")}, "generic.text-excerpt": verbatim, "unknown": fallback,
}
__all__ = ["SUMMARIES", "capped_hits", "env_class", "listed_size"]
