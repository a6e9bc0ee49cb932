"""From captured runs to summaries: one branch for each family, so that a plan holds its own patterns only."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators.classify import FAMILIES, UNKNOWN
from tracewell.operators.summarize import checks, generic, ops, testing, vcs
from tracewell.sources.work import stored

SUMMARIES = vcs.SUMMARIES | ops.SUMMARIES | checks.SUMMARIES | testing.SUMMARIES | generic.SUMMARIES


def prepared(runs: DataFrame) -> DataFrame:
    """Classified runs with the lines that the summaries look at. Null outputs count as empty."""
    runs = runs.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("stdout", "stderr")})
    if "dir_names" not in runs.columns:
        runs = runs.withColumn("dir_names", F.lit(None).cast("array<string>"))
    both = F.concat("stdout", F.lit("\n"), "stderr")
    runs = runs.withColumns({"out": T.preferred(F.col("stdout"), F.col("stderr")), "args": F.slice("argv", 2, F.greatest(F.size("argv"), F.lit(1))), "exit_code": F.coalesce("exit_code", F.lit(0))})
    return runs.withColumns({
        "lines": T.non_blank(F.col("out")),
        "out_lines": T.non_blank(F.col("stdout")),
        "err_lines": T.non_blank(F.col("stderr")),
        "both_lines": T.non_blank(both),
        "raw_lines": F.filter(T.lines(both), lambda x: T.trim(x) != ""),
    })


@functools.cache
def _pattern(label: str, application: str) -> Column:
    """What a label's pattern makes of a prepared run, built once for an application."""
    return SUMMARIES.get(label, generic.fallback)().column()


def _family(label: str) -> str:
    return "generic" if label == UNKNOWN else label.split(".")[0]


def summarized(runs: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Classified runs with `summary`: struct of summary, details, stderr_preview, style.

    The classification is written once, partitioned by family, so that its rules aren't planned again in each
    branch. Each family that occurs is a branch over its own partition; `families` restricts the branches. A label
    without a pattern of its own gets the fallback.
    """
    held = stored(runs, "classified-runs", "family").select(*runs.columns)
    # one row for each label at most: only the patterns that occur are planned
    labels = {r["label"] for r in held.select("label").distinct().collect()}
    parts, application = [], held.sparkSession.sparkContext.applicationId
    for family in FAMILIES:
        own = sorted(k for k in labels if _family(k) == family)
        if not own or (families and family not in families):
            continue
        rows = prepared(held.filter(F.col("family") == family))
        if family == "test":
            rows = testing.read(rows)
        cases = reduce(lambda c, k: c.when(F.col("label") == k, _pattern(k, application)), own, F.when(F.lit(False), _pattern(own[0], application)))
        parts.append(rows.withColumn("summary", cases).select(*runs.columns, "summary"))
    if not parts:
        return held.withColumn("summary", F.lit(None).cast("struct<summary:string,details:array<string>,stderr_preview:array<string>,style:string>"))
    return reduce(DataFrame.unionByName, parts)


def rendered(summary: str = "summary"):
    """A summary as text: headline, details with or without bullets, the error output's lines."""
    s = F.col(summary)
    rows = F.transform(s["details"], lambda x: F.when(s["style"] == "bulleted", F.concat(F.lit("- "), x)).otherwise(x))
    err = F.transform(s["stderr_preview"], lambda x: F.concat(F.lit("- "), x))
    head = F.when(s["summary"] == "", T.strings()).otherwise(F.array(s["summary"]))
    tail = F.when(F.size(err) > 0, F.concat(T.strings("stderr:"), err)).otherwise(T.strings())
    every = F.concat(head, rows, tail)
    return F.when(F.size(every) == 0, F.lit("")).otherwise(F.concat(F.array_join(every, "\n"), F.lit("\n")))


def output_modes(runs: DataFrame) -> DataFrame:
    """With `text` and `mode`: the summary if it has fewer bytes than the whole output, else the output itself."""
    full = T.rendered_full(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    short = rendered()
    smaller = F.octet_length(short) < F.octet_length(full)
    return runs.withColumn("text", F.when(smaller, short).otherwise(full)).withColumn("mode", F.when(smaller, F.lit("compressed")).otherwise(F.lit("raw_fallback")))
