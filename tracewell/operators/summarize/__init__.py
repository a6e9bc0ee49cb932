"""Summaries of captured runs, one module for each group of commands. All are Column expressions over one run's row.

The modules hold Columns, which need a session: they are imported with the first call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def summarized(runs: DataFrame, families: list[str] | None = None) -> DataFrame:
    """See run.summarized()."""
    from tracewell.operators.summarize import run

    return run.summarized(runs, families)


def rendered(summary: str = "summary") -> Column:
    """See run.rendered()."""
    from tracewell.operators.summarize import run

    return run.rendered(summary)


def output_modes(runs: DataFrame) -> DataFrame:
    """See run.output_modes()."""
    from tracewell.operators.summarize import run

    return run.output_modes(runs)
