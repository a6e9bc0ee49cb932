"""Version control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import lines, one_space, strings, trim, truncated
from tracewell.operators.summarize.base import ARGS, ERR_LINES, LINES, NOTHING, OUT_LINES, STDOUT, Summary, begins, count, find, first, found, has, last, matching, number, part, rest, say, take

#: All lines of both outputs, an error line only where the output hasn't it.
EVERY = F.when(F.size(OUT_LINES) > 0, F.concat(OUT_LINES, F.filter(ERR_LINES, lambda x: ~F.array_contains(OUT_LINES, x)))).otherwise(ERR_LINES)
#: The codes that the sections of a long status stand for.
HEADS = {"Changes to be committed:": "staged", "Changes not staged for commit:": "unstaged", "Untracked files:": "untracked"}


def change_stats(array: Column) -> Column:
    """ok N files, +a/-d from the first line that tells; null without one."""
    line = find(array, lambda x: x.rlike(r"(^|, ?)\d+ files? changed"))
    return F.when(line.isNotNull(), say("ok {} files, +{}/-{}", number(line, r"(\d+) files? changed"), number(line, r"(\d+) insertions?\(\+\)"), number(line, r"(\d+) deletions?\(-\)")))


def status() -> Summary:
    """Branch and changed files as two-letter codes, from the short or the long form."""
    all_lines = lines(STDOUT)

    def code(line: Column, at: Column) -> Column:
        body = trim(line)
        spot = F.when(at == "staged", F.lit("M ")).when(at == "untracked", F.lit("??")).otherwise(F.lit(" M"))
        file = trim(F.regexp_replace(body, r"^(modified|new file|deleted|renamed):", ""))
        change = (
            F.when(body.startswith("modified:"), F.when(at == "staged", F.lit("M ")).otherwise(F.lit(" M")))
            .when(body.startswith("new file:"), F.when(at == "untracked", F.lit("??")).otherwise(F.lit("A ")))
            .when(body.startswith("deleted:"), F.when(at == "staged", F.lit("D ")).otherwise(F.lit(" D")))
            .when(body.startswith("renamed:"), F.lit("R "))
            .when(line.startswith("\t") & (at != ""), spot)
        )
        return F.when(line.rlike(r"^[ MADRCU?!]{2} ") & ~line.rlike(r"[^\x00-\x7F]"), line).when(change.isNotNull(), F.concat(change, F.lit(" "), file))

    def step(state: Column, line: Column) -> Column:
        body = trim(line)
        head = F.coalesce(*[F.when(body == k, F.lit(v)) for k, v in HEADS.items()])
        branch = F.coalesce(part(line, r"^## (.*)$"), part(line, r"^On branch (.*)$"))
        skip = head.isNotNull() | branch.isNotNull() | (body == "") | body.startswith('(use "git ')
        shown = F.when(~skip, code(line, state["at"]))
        return F.struct(F.coalesce(head, state["at"]).alias("at"), F.coalesce(trim(branch), state["branch"]).alias("branch"), F.when(shown.isNotNull(), F.concat(state["out"], F.array(shown))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit("").alias("at"), F.lit(None).cast("string").alias("branch"), NOTHING.alias("out"))
    state = F.aggregate(all_lines, start, step)
    out, branch = state["out"], state["branch"]
    headline = F.when(branch.isNotNull(), F.concat(F.lit("* "), branch)).when(F.size(out) == 0, F.lit("Clean working tree")).otherwise(first(out))
    clean = F.when(F.size(out) == 0, strings("clean — nothing to commit")).otherwise(out)
    return Summary(headline, F.when(branch.isNotNull(), clean).otherwise(rest(out)), plain=True)


def diff_files(text: Column) -> Column:
    """Files of a diff in order: label, added, removed, hunks, kind, evidence. A removed line that begins with -- counts as a header."""
    blocks = F.filter(F.split(text, r"(?m)^(?=diff --git a/)"), lambda b: b.rlike(r"^diff --git a/.* b/"))

    def file(block: Column) -> Column:
        rows = lines(block)
        added, removed = (lambda x: x.startswith("+") & ~x.startswith("+++")), (lambda x: x.startswith("-") & ~x.startswith("---"))
        hunks = F.filter(rows, lambda x: x.startswith("@@"))
        changes = F.filter(F.transform(F.filter(rows, lambda x: added(x) | removed(x)), one_space), lambda x: F.octet_length(x) > 1)
        source, target = first(matching(rows, r"^rename from (.*)$")), last(matching(rows, r"^rename to (.*)$"))
        path = F.coalesce(trim(target), trim(part(first(rows), r"^diff --git a/(.*?) b/")))
        # the last line that tells the kind counts
        kind = last(F.filter(F.transform(rows, lambda x: F.when(x.startswith("new file mode"), F.lit("new")).when(x.startswith("deleted file mode"), F.lit("deleted")).when(begins(x, "rename from ", "rename to "), F.lit("renamed")).when(x.startswith("Binary files "), F.lit("binary"))), lambda x: x.isNotNull()))
        evidence = F.concat(F.transform(take(hunks, 1), lambda x: truncated(trim(x), 80)), F.transform(take(changes, 3), lambda x: truncated(x, 90)))
        label = F.when(source.isNotNull(), F.concat(trim(source), F.lit(" -> "), path)).otherwise(path)
        return F.struct(label.alias("label"), count(rows, added).alias("added"), count(rows, removed).alias("removed"), F.size(hunks).alias("hunks"), kind.alias("kind"), evidence.alias("evidence"))

    return F.transform(blocks, file)


def _ranked(files: Column) -> Column:
    """One line for each file, largest change first, ties in order; all tell evidence if they are eight or fewer, else four do."""
    weight = lambda f: f["added"] + f["removed"] + 4 * f["hunks"]
    order = F.array_sort(F.transform(files, lambda f, i: F.struct((-weight(f)).alias("order"), i.alias("i"), f.alias("f"))))

    def render(item: Column, place: Column) -> Column:
        f = item["f"]
        parts = F.filter(F.array(F.when((f["added"] > 0) | (f["removed"] > 0), say("+{}/-{}", f["added"], f["removed"])), F.when(f["hunks"] > 0, F.concat(f["hunks"].cast("string"), F.when(f["hunks"] == 1, F.lit(" hunk")).otherwise(F.lit(" hunks")))), f["kind"]), lambda x: x.isNotNull())
        base = F.when(F.size(parts) > 0, say("{} ({})", f["label"], F.array_join(parts, ", "))).otherwise(f["label"])
        tells = ((F.size(files) <= 8) | (place < 4)) & (F.size(f["evidence"]) > 0)
        return F.when(tells, say("{} — {}", base, F.array_join(f["evidence"], " | "))).otherwise(base)

    return F.transform(order, render)


def _diff_headline(files: Column) -> Column:
    rows = lines(STDOUT)
    hunks = count(rows, lambda x: x.startswith("@@"))
    added = count(rows, lambda x: x.startswith("+") & ~x.startswith("+++"))
    removed = count(rows, lambda x: x.startswith("-") & ~x.startswith("---"))
    return say("{} files changed, {} hunks, +{}/-{}", F.size(files), hunks, added, removed)


def diff() -> Summary:
    files = diff_files(STDOUT)
    return Summary(_diff_headline(files), _ranked(files))


def _commits(array: Column) -> Column:
    """hash subject of each commit, from one-line or raw form."""
    short = F.transform(F.filter(array, lambda x: x.rlike(r"^[0-9a-fA-F]{7,40}( |$)")), one_space)
    blocks = F.split(F.array_join(array, "\n"), r"(?m)^(?=commit )")

    def raw(block: Column) -> Column:
        rows = F.split(block, "\n")
        subject = find(rest(rows), lambda x: ~begins(x, "Author:", "Date:", "Merge:"))
        return F.trim(F.concat(F.substring(F.trim(part(first(rows), r"^commit (.*)$")), 1, 7), F.lit(" "), F.coalesce(subject, F.lit(""))))

    return F.when(found(array, lambda x: x.startswith("commit ")), F.transform(F.filter(blocks, lambda b: b.startswith("commit ")), raw)).otherwise(short)


def log() -> Summary:
    entries = _commits(LINES)
    return Summary(say("{} commits", F.size(entries)), take(entries, 6))


def branch() -> Summary:
    local = F.filter(LINES, lambda x: ~x.startswith("remotes/"))
    names = F.array_distinct(F.transform(local, lambda x: F.regexp_replace(x, r"^(\* )+", "")))
    remote = F.array_sort(F.array_distinct(F.filter(matching(LINES, r"^remotes/[^/]+/(.*)$"), lambda x: ~x.contains("->"))))
    only = F.array_except(remote, names)
    current = F.coalesce(last(matching(LINES, r"^\* (.*)$")), F.lit("unknown"))
    more = F.when(F.size(only) > 0, F.array(say("remote-only ({}): {}", F.size(only), F.array_join(only, ", ")))).otherwise(NOTHING)
    return Summary(say("current={}; local={}; remote_only={}", current, F.size(names), F.size(only)), F.concat(take(local, 6), more))


def remote() -> Summary:
    rows = F.filter(LINES, lambda x: x.rlike(r"^\S+\s+\S+"))
    names = F.array_distinct(F.transform(rows, lambda x: part(x, r"^(\S+)")))
    pairs = F.array_distinct(F.transform(rows, lambda x: say("{}: {}", part(x, r"^(\S+)"), part(x, r"^\S+\s+(\S+)"))))
    return Summary(say("{} remotes", F.size(names)), take(pairs, 6))


def show() -> Summary:
    files = diff_files(STDOUT)
    at = F.array_position(F.transform(LINES, lambda x: x.startswith("commit ")), F.lit(True)).cast("int")
    name = F.substring(F.trim(part(F.try_element_at(LINES, F.nullif(at, F.lit(0))), r"^commit (.*)$")), 1, 7)
    after = F.when(at > 0, F.slice(LINES, at + 1, F.size(LINES)))
    subject = find(after, lambda x: ~begins(x, "Author:", "Date:", "Merge:", "diff --git "))
    changes = F.when(F.size(files) > 0, _diff_headline(files)).otherwise(F.coalesce(change_stats(LINES), _diff_headline(files)))
    headline = F.coalesce(say("{} {}; {}", name, subject, changes), changes)
    return Summary(headline, F.when(F.size(files) > 0, _ranked(files)).otherwise(take(LINES, 6)))


def fetch() -> Summary:
    new = F.transform(F.filter(EVERY, lambda x: x.contains("[new ") & x.contains("->")), lambda x: F.trim(F.try_element_at(F.split(x, "->"), F.lit(2))))
    updated = F.filter(EVERY, lambda x: x.contains("->") & ~x.contains("[new "))
    headline = F.when(F.size(new) > 0, say("ok fetched ({} new refs)", F.size(new))).when(F.size(updated) > 0, say("ok fetched ({} updated refs)", F.size(updated))).otherwise(F.lit("ok fetched"))
    return Summary(headline, take(F.when(F.size(new) > 0, new).otherwise(updated), 6), NOTHING)


def pull() -> Summary:
    headline = F.when(found(EVERY, lambda x: x.contains("Already up to date")), F.lit("ok (up-to-date)")).otherwise(F.coalesce(change_stats(EVERY), F.lit("ok pull")))
    return Summary(headline, F.filter(EVERY, lambda x: has(x, "file changed", "files changed")), NOTHING)


def push() -> Summary:
    update = find(EVERY, lambda x: x.contains("->"))
    target = part(F.trim(F.try_element_at(F.split(update, "->"), F.lit(2))), r"(\S+)$")
    headline = F.when(found(EVERY, lambda x: x.contains("Everything up-to-date")), F.lit("ok (up-to-date)")).otherwise(F.coalesce(F.concat(F.lit("ok "), target), F.lit("ok push")))
    return Summary(headline, take(F.filter(EVERY, lambda x: x.contains("->")), 3), NOTHING)


def transition() -> Summary:
    return Summary(F.concat(F.lit("transition="), F.coalesce(first(EVERY), F.lit("no output"))), take(EVERY, 6), NOTHING)


def commit() -> Summary:
    return Summary(F.coalesce(first(LINES), F.lit("no output")), take(LINES, 6))


def add() -> Summary:
    paths = count(rest(ARGS), lambda x: ~x.startswith("-"))
    return Summary(F.when(paths == 0, F.lit("ok staged")).otherwise(say("ok staged ({} paths)", paths)), take(LINES, 6))


def clone() -> Summary:
    return Summary(F.coalesce(F.concat(F.lit("ok cloned "), first(matching(EVERY, r"^Cloning into (.*)$"))), F.lit("ok cloned")), take(EVERY, 6), NOTHING)


def merge() -> Summary:
    conflicts = count(LINES, lambda x: x.contains("CONFLICT"))
    failed = (conflicts > 0) | found(LINES, lambda x: x.contains("Automatic merge failed"))
    same = F.when(found(LINES, lambda x: x.contains("Already up to date")), F.lit("ok merge (up-to-date)"))
    headline = F.when(failed, say("merge conflict ({} conflicts)", conflicts)).otherwise(F.coalesce(change_stats(LINES), same, first(LINES), F.lit("ok merge")))
    return Summary(headline, take(LINES, 6))


def tag() -> Summary:
    shown = F.when(F.size(LINES) <= 10, LINES).otherwise(take(LINES, 5))
    return Summary(F.when(F.size(LINES) == 0, F.lit("ok tag")).otherwise(say("{} ({} tags)", F.array_join(shown, ", "), F.size(LINES))), take(LINES, 6))


def reset() -> Summary:
    at = F.array_position(F.transform(LINES, lambda x: x.startswith("Unstaged changes after reset:")), F.lit(True)).cast("int")
    paths = F.when(at > 0, F.array_sort(F.array_distinct(F.filter(F.slice(LINES, at + 1, F.size(LINES)), lambda x: ~x.startswith("Unstaged changes after reset:"))))).otherwise(NOTHING)
    return Summary(F.when(F.size(paths) == 0, F.lit("reset ok")).otherwise(say("reset ok ({} files unstaged)", F.size(paths))), take(paths, 6))


def stash() -> Summary:
    sub = find(rest(ARGS), lambda x: ~x.startswith("-"))
    marked = count(LINES, lambda x: begins(x, "+", "-"))
    shown = F.coalesce(F.regexp_replace(change_stats(LINES), "^ok ", ""), F.when(marked > 0, say("{} changes", marked)), F.lit("no output"))
    headline = F.when(sub == "list", say("{} stash entries", F.size(LINES))).when(sub == "show", say("stash show ({})", shown)).when(sub.isin("pop", "apply", "drop"), F.concat(F.lit("ok stash "), sub)).otherwise(F.lit("ok stashed"))
    entries = F.transform(LINES, lambda x: F.regexp_replace(x, r"^(.*?): .*?: (.*)$", "$1: $2"))
    return Summary(headline, take(F.when(sub == "list", entries).otherwise(LINES), 6))


SUMMARIES = {
    "git.status": status, "git.diff": diff, "git.log": log, "git.branch": branch, "git.remote": remote, "git.show": show, "git.fetch": fetch, "git.pull": pull, "git.push": push,
    "git.checkout": transition, "git.switch": transition, "git.commit": commit, "git.add": add, "git.clone": clone, "git.merge": merge, "git.tag": tag, "git.reset": reset, "git.stash": stash,
}
