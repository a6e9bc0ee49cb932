"""Reading files: line ranges, notices for unchanged ones, token counts, results as JSON or text."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracewell.functions import text as T

# workers get this module's functions with the task: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pieces by which tokens are estimated: words of up to six characters, signs, line feeds.
PIECE = r"(?U)\w{1,6}|[^\w\s]|\n"


def excerpt(text: Column, start: int, end: int | None = None, numbered: bool = False) -> Column:
    """Lines start to end (from 1, both included; one line without an end), with numbers if asked for."""
    end = start if end is None else end
    kept = F.slice(T.lines(text), start, max(0, end - start + 1))
    if numbered:
        kept = F.transform(kept, lambda x, i: F.concat((i + start).cast("string"), F.lit(": "), x))
    return F.array_join(kept, "\n")


def approximate_tokens(text: Column) -> Column:
    """An estimate, no tokenizer's count."""
    return F.regexp_count(text, F.lit(PIECE))


def token_counter(count: Callable[[list[str]], list[int]] | None = None):
    """A column function that counts tokens with any counter, which gets the texts of a batch at once; without one, the
    estimate."""
    if count is None:
        return approximate_tokens

    @F.pandas_udf(LongType())
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = iter(count(batch.dropna().tolist()))
            yield pd.Series([None if x is None else next(found) for x in batch], dtype="Int64")

    return counted


def vocabulary_counter(path: str):
    """Counts by a tokenizer file, the same path on every machine."""

    def count(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]

    return token_counter(count)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def read_results(reads: DataFrame) -> DataFrame:
    """Reads (path, text, unchanged) with `result`: JSON with the text, or a notice where nothing has changed."""
    notice = F.concat(F.lit("unchanged since last read: "), F.col("path"))
    return reads.withColumn("result", F.to_json(F.struct("path", F.when(F.col("unchanged"), notice).otherwise(F.col("text")).alias("text"), "unchanged")))


#: What a result says about the kept output.
SUMMARY_KIND, RAW_KIND = "compressed_summary", "raw_output"


def run_results(runs: DataFrame) -> DataFrame:
    """Summarised runs (with text and mode) with `result`: JSON of the command, its end and what the text is.

    `full` asks for the output itself; so does a summary that isn't shorter. Capture bounds come along if there are any.
    """
    full = F.coalesce(F.col("full"), F.lit(False)) if "full" in runs.columns else F.lit(False)
    raw = full | (F.col("mode") == "raw_fallback")
    fields = ["run_id", "argv"] + [c for c in ("cwd",) if c in runs.columns] + ["exit_code"]
    source = F.when(raw, "current_text_content").otherwise(SUMMARY_KIND).alias("preferred_response_source")
    more = [F.col(f"capture.{f.name}").alias(f.name) for f in runs.schema["capture"].dataType.fields] if "capture" in runs.columns else []
    always = [F.lit(v).alias(k) for k, v in (("raw_output_available", True), ("should_fetch_raw_output", False), ("output_is_in_text", True), ("rerun_not_needed_if_text_sufficient", True))]
    whole = F.struct(*fields, full.alias("full"), F.col("mode").alias("output_mode"), F.when(raw, RAW_KIND).otherwise(SUMMARY_KIND).alias("content_kind"), source, *always, *more)
    return runs.withColumn("result", F.to_json(whole, {"ignoreNullFields": "false"}))


def spool_results(runs: DataFrame, reason: str) -> DataFrame:
    """Kept outputs with `result`: JSON that says where the text comes from and why it was asked for."""
    fields = ["run_id", "argv"] + [c for c in ("cwd",) if c in runs.columns] + ["exit_code"]
    whole = F.struct(*fields, F.lit(RAW_KIND).alias("content_kind"), F.lit("spool").alias("source"), F.lit(reason).alias("reason"), F.lit(True).alias("output_is_in_text"), F.lit(True).alias("rerun_not_needed_if_text_sufficient"))
    return runs.withColumn("result", F.to_json(whole, {"ignoreNullFields": "false"}))


def run_text(text: Column, exit_code: Column) -> Column:
    """An output with its exit code if that isn't 0."""
    return F.when(exit_code != 0, F.concat(text, F.lit("\nexit code: "), exit_code.cast("string"))).otherwise(text)


def absolute(path: Column, root: Column) -> Column:
    """A path below a root, unless it is absolute."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))


def only_project(registry: DataFrame, client: str, session_id: str) -> str:
    """The one root that a session watches; an error if there is none or more than one."""
    own = registry.filter(F.exists("consumers", lambda c: c == f"{client}:{session_id}")).select("root").limit(2).collect()
    if len(own) != 1:
        raise ValueError("no project is watched" if not own else "several projects are watched: name one")
    return own[0]["root"]


def plain_client(client: Column) -> Column:
    """Whether a client shows text only."""
    return F.lower(F.trim(client)).contains("codex")


def simple_query(query: Column) -> Column:
    """Whether a search is for a plain text: no sign of a pattern."""
    return ~query.rlike(r"[\\^$*+?()\[\]{}|]")


def meaningful(changes: DataFrame, ignored: Column) -> DataFrame:
    """File changes that count: created, modified or removed, and not all paths ignored. `ignored` is a condition on path."""
    kinds = changes.filter(F.col("kind").isin("create", "modify", "remove"))
    return kinds.withColumn("path", F.explode("paths")).filter(~ignored)
