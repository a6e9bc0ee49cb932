"""What the summaries share: the columns of a run, and small functions over arrays of lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import strings

#: Columns that prepared() adds to a run.
STDOUT, STDERR, OUT = F.col("stdout"), F.col("stderr"), F.col("out")
LINES, OUT_LINES, ERR_LINES, BOTH = F.col("lines"), F.col("out_lines"), F.col("err_lines"), F.col("both_lines")
RAW = F.col("raw_lines")
ARGV, ARGS, EXIT = F.col("argv"), F.col("args"), F.col("exit_code")
PREVIEW = F.slice(ERR_LINES, 1, 5)
NOTHING = strings()


@dataclass(frozen=True)
class Summary:
    """A headline, lines of detail, lines of the error output, and whether details get bullets."""

    headline: Column
    details: Column
    stderr: Column = field(default_factory=lambda: PREVIEW)
    plain: Column | bool = False

    def column(self) -> Column:
        plain = self.plain if isinstance(self.plain, Column) else F.lit(self.plain)
        style = F.when(plain, F.lit("plain")).otherwise(F.lit("bulleted"))
        return F.struct(self.headline.alias("summary"), self.details.alias("details"), self.stderr.alias("stderr_preview"), style.alias("style"))


def say(pattern: str, *values: Column) -> Column:
    """A text with each {} replaced by a value."""
    parts = pattern.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


def has(line: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(p) for p in parts])


def begins(line: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [line.startswith(p) for p in parts])


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def rest(array: Column, skip: int = 1) -> Column:
    return F.slice(array, skip + 1, F.greatest(F.size(array), F.lit(1)))


def find(array: Column, test: Callable) -> Column:
    """The first item that passes."""
    return first(F.filter(array, test))


def count(array: Column, test: Callable) -> Column:
    return F.size(F.filter(array, test))


def found(array: Column, test: Callable) -> Column:
    return F.exists(array, test)


def take(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def cut(array: Column, n: int, label: str, total: Column | None = None) -> Column:
    """The first n items, and a line that says how many more there are."""
    total = F.size(array) if total is None else total
    return F.when(total > n, F.concat(take(array, n), F.array(say("+ {} more " + label, total - n)))).otherwise(take(array, n))


def part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern; null where it doesn't match or is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(part(text, pattern, group).try_cast("long"), F.lit(0))


def matching(array: Column, pattern: str, group: int = 1) -> Column:
    """A group of each item that matches."""
    return F.filter(F.transform(array, lambda x: part(x, pattern, group)), lambda x: x.isNotNull())


def held(value: Column, body: Callable) -> Column:
    """What `body` makes of a value that is computed once, however often the body's lambdas name it."""
    return F.transform(F.array(value), body)[0]


def runs_of(ordered: Column, key: Callable) -> Column:
    """Where equal keys stand side by side in an ordered array: array of (at, n), the place from 0 and the length of each run."""

    def found(items: Column) -> Column:
        places = F.transform(items, lambda x, i: F.struct(i.alias("at"), ((i == 0) | ~key(x).eqNullSafe(key(F.get(items, i - 1)))).alias("opens")))
        opened = F.filter(places, lambda p: p["opens"])
        return held(opened, lambda o: F.transform(o, lambda p, k: F.struct(p["at"].alias("at"), (F.coalesce(F.get(o, k + 1)["at"], F.size(items)) - p["at"]).alias("n"))))

    return held(ordered, found)


def tallied(keys: Column) -> Column:
    """Each distinct key with how often it stands there, most frequent first, ties by key: array of (n, key)."""

    def counted(ordered: Column) -> Column:
        pairs = F.transform(runs_of(ordered, lambda x: x), lambda r: F.struct((-r["n"]).alias("order"), F.get(ordered, r["at"]).alias("key")))
        return F.transform(F.array_sort(pairs), lambda p: F.struct((-p["order"]).alias("n"), p["key"].alias("key")))

    return held(F.array_sort(keys), counted)


def section(title: str, items: Column, gap: bool) -> Column:
    """A titled part of the details, after an empty line if something comes before; nothing without items."""
    head = strings("", title) if gap else strings(title)
    return F.when(F.size(items) > 0, F.concat(head, items)).otherwise(NOTHING)


def paths_below(text: Column, roots: tuple[str, ...]) -> Column:
    """From the last of the known folders on, by order of the roots; else the file's name."""
    path = F.replace(text, F.lit("\\"), F.lit("/"))
    inner = [part(path, rf"^.*/({root}/.*)$") for root in roots]
    return F.when(reduce(lambda a, b: a | b, [path.startswith(f"{r}/") for r in roots]), path).otherwise(F.coalesce(*inner, F.regexp_extract(path, r"([^/]*)$", 1)))


def rules_and_files(issues: Column, roots: tuple[str, ...], rule_title: str = "Top rules:", say_more: bool = True) -> Column:
    """Details of issues (array of file, rule): ten rules, ten files with three rules each."""
    rules = F.transform(take(tallied(F.transform(issues, lambda i: i["rule"])), 10), lambda t: say("  {} ({}x)", t["key"], t["n"]))
    files = tallied(F.transform(issues, lambda i: i["file"]))

    def of_file(f: Column) -> Column:
        own = tallied(F.transform(F.filter(issues, lambda i: i["file"] == f["key"]), lambda i: i["rule"]))
        return F.concat(F.array(say("  {} ({} issues)", paths_below(f["key"], roots), f["n"])), F.transform(take(own, 3), lambda t: say("    {} ({})", t["key"], t["n"])))

    shown = F.flatten(F.transform(take(files, 10), of_file))
    over = F.when(F.size(files) > 10, F.array(F.lit(""), say("... +{} more files", F.size(files) - 10))).otherwise(NOTHING)
    out = F.concat(section(rule_title, rules, gap=False), section("Top files:", shown, gap=True))
    return F.concat(out, over) if say_more else out


def joined_blocks(array: Column, start: Callable, stop: Callable, separator: str = "\n") -> Column:
    """Blocks of lines: one begins where `start` holds and goes on until the next start or a line where `stop` holds."""

    def whole(rest: Column) -> Column:
        ends = F.coalesce(F.array_position(F.transform(F.slice(rest, F.lit(2), F.size(rest)), stop), True), F.lit(0))
        return F.array_join(F.slice(rest, F.lit(1), F.when(ends == 0, F.size(rest)).otherwise(ends.cast("int"))), separator)

    def split(items: Column) -> Column:
        places = F.transform(items, lambda x, i: F.when(start(x), i))
        opened = F.filter(places, lambda i: i.isNotNull())
        until = lambda o, k, i: F.coalesce(F.get(o, k + 1), F.size(items)) - i
        return held(opened, lambda o: F.transform(o, lambda i, k: held(F.slice(items, i + 1, until(o, k, i)), whole)))

    return held(array, split)
