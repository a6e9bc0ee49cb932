"""Column functions over argument lists, and the quote-aware tokenizer, which needs state for each character."""

from __future__ import annotations

from collections.abc import Iterator

import sys
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracewell.functions.text import strings

# workers get this module's functions with the task: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASSIGNMENT = r"^[A-Za-z0-9_]+=(?s).*"
#: Characters that make a command more than simple words.
SPECIAL = set("|&;<>`$()")


def positional_sql(args: str, valued: tuple[str, ...] = ()) -> str:
    """positional() of a column by name, as one SQL expression: quicker to build where there are many."""
    flags = "array(" + ", ".join(f"'{v}'" for v in valued) + ")" if valued else "CAST(array() AS ARRAY<STRING>)"
    long = [v for v in valued if v.startswith("--")]
    joined = f" AND NOT x RLIKE '^({'|'.join(long)})='" if long else ""
    keep = f"s.every OR (NOT s.skip AND NOT array_contains({flags}, x){joined} AND NOT startswith(x, '-'))"
    step = f"named_struct('kept', IF({keep}, concat(s.kept, array(x)), s.kept), 'skip', NOT s.every AND NOT s.skip AND array_contains({flags}, x), 'every', s.every OR (NOT s.skip AND x = '--'))"
    return f"aggregate({args}, named_struct('kept', CAST(array() AS ARRAY<STRING>), 'skip', false, 'every', false), (s, x) -> {step}, s -> s.kept)"


def positional(args: Column, valued: tuple[str, ...] = ()) -> Column:
    """Arguments that are no flags: what follows a valued flag is its value, after -- all count."""
    flags = strings(*valued)
    long = [v for v in valued if v.startswith("--")]

    def step(state: Column, arg: Column) -> Column:
        free = ~state["every"] & ~state["skip"]
        takes = free & F.array_contains(flags, arg)
        plain = ~arg.startswith("-") & ~F.array_contains(flags, arg)
        if long:
            plain = plain & ~arg.rlike(f"^({'|'.join(long)})=")
        kept = F.when(state["every"] | (~state["skip"] & plain), F.concat(state["kept"], F.array(arg))).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), takes.alias("skip"), (state["every"] | (free & (arg == "--"))).alias("every"))

    start = F.struct(strings().alias("kept"), F.lit(False).alias("skip"), F.lit(False).alias("every"))
    return F.aggregate(args, start, step, lambda state: state["kept"])


def first_positional(args: Column, valued: tuple[str, ...] = ()) -> Column:
    return F.try_element_at(positional(args, valued), F.lit(1))


def split_simple(command: str | None) -> list[str] | None:
    """The words of a command that is nothing but quoted or plain words; None for pipes, expansions, open quotes."""
    if command is None or "\n" in command or "\r" in command:
        return None
    out: list[str] = []
    word, quote, letters = "", "", iter(command)
    for c in letters:
        if c == "\\" and quote != "'":
            word += next(letters, "")
        elif quote:
            if c == quote:
                quote = ""
            else:
                word += c
        elif c in "'\"":
            quote = c
        elif c in " \t":
            if word:
                out.append(word)
            word = ""
        elif c in SPECIAL:
            return None
        else:
            word += c
    if word:
        out.append(word)
    return None if quote or not out else out


@F.pandas_udf(ArrayType(StringType()))
def simple_command(commands: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """split_simple() of each command."""
    for batch in commands:
        yield batch.map(split_simple)


def without_env(argv: Column) -> Column:
    """Without a leading `env` and the assignments before the program."""
    body = F.when(F.try_element_at(argv, F.lit(1)) == "env", F.slice(argv, F.lit(2), F.greatest(F.size(argv) - 1, F.lit(0)))).otherwise(argv)
    first = F.try_element_at(F.filter(F.transform(body, lambda x, i: F.when(~x.rlike(ASSIGNMENT), i)), lambda i: i.isNotNull()), F.lit(1))
    return F.when(first.isNull(), strings()).otherwise(F.slice(body, first + 1, F.size(body)))


def with_env(argv: Column) -> Column:
    """With `env` before leading assignments."""
    return F.when(F.try_element_at(argv, F.lit(1)).rlike(ASSIGNMENT), F.concat(strings("env"), argv)).otherwise(argv)


def shell_script(argv: Column) -> Column:
    """The command text of `sh -c` and its kind; null for other programs."""
    args = F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(1)))
    at = F.try_element_at(F.filter(F.transform(args, lambda x, i: F.when(x.startswith("-") & x.contains("c"), i)), lambda i: i.isNotNull()), F.lit(1))
    return F.when(F.try_element_at(argv, F.lit(1)).isin("sh", "bash", "zsh"), F.try_element_at(args, (at + 2).cast("int")))


def search_query(args: Column, valued: tuple[str, ...] = ("-e", "-g", "--glob", "-t", "--type", "-A", "-B", "-C", "-m", "--max-count")) -> Column:
    """What a search command looks for: its first argument that is no flag."""
    return first_positional(args, valued)


def sed_range(script: Column) -> Column:
    """Lines that a script `a,bp` prints, 1 for `ap`; null for others."""
    low, high = F.regexp_extract(script, r"^(\d+)(?:,(\d+))?p$", 1), F.regexp_extract(script, r"^(\d+)(?:,(\d+))?p$", 2)
    start, end = F.nullif(low, F.lit("")).try_cast("int"), F.nullif(high, F.lit("")).try_cast("int")
    return F.when(start.isNull(), None).when(end.isNull(), 1).otherwise(F.greatest(end - start + 1, F.lit(0)))
