"""The pipeline: each stage's decisions take effect, clean documents stay."""

from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from tracewell.llm import shared
from tracewell.llm.secrets import base_spans
from tracewell.llm.shared import written


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, SF), name)
    return out


def test_stages(stages):
    columns = stages["documents"].columns
    frames = {k: v.toPandas() for k, v in stages.items()}
    for name in ("toxicity", "near_duplicates", "secrets", "mix"):
        assert list(frames[name].columns) == columns
    assert set(frames["near_duplicates"].doc_id) <= set(frames["toxicity"].doc_id) <= set(frames["documents"].doc_id)
    assert frames["near_duplicates"].text.duplicated().sum() == 0 or not frames["near_duplicates"].text[frames["near_duplicates"].text.duplicated()].str.strip().any()
    assert not any(base_spans(t) for t in frames["secrets"].text)
    clean = [not base_spans(t) for t in frames["near_duplicates"].text]
    same = frames["near_duplicates"][clean].set_index("doc_id").text
    assert frames["secrets"].set_index("doc_id").text[same.index].equals(same)
    assert frames["mix"].doc_id.value_counts().max() <= 3
    assert len(frames["tokens"]) == len(frames["mix"]) and sorted(frames["tokens"].doc_id) == sorted(frames["mix"].doc_id)


def test_clean_documents_stay(stages):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    clean = set(labels[labels.toxic == 0].doc_id)
    kept = set(stages["toxicity"].toPandas().doc_id)
    assert len(clean & kept) >= 0.98 * len(clean)


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs.select(*columns), no_docs.select(*columns)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
        assert docs.count() >= 0


def folders(made):
    """Paths of the tables among the work folders made that still stand; files that executors fetch are not tables."""
    return {p for p in map(lambda x: urlparse(x).path, made) if Path(p).is_dir() and not Path(p).name.startswith("share-")}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_leave_only_tables_that_their_results_read(spark, monkeypatch, name):
    monkeypatch.setattr(shared, "_made", made := [])
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert folders(made) <= {str(Path(urlparse(f).path).parent) for f in out.inputFiles()}
    assert out.count() > 0


def test_run_leaves_only_what_the_stages_return(spark, monkeypatch):
    monkeypatch.setattr(shared, "_made", made := [])
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert sorted(Path(p).name.rpartition("-")[0] for p in folders(made)) == sorted(f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES)


def test_settled_rows_stay_and_inner_tables_go(spark, monkeypatch):
    monkeypatch.setattr(shared, "_made", made := [])

    def make():
        first = written(spark.range(5), "first")
        return shared.settled(spark, lambda: written(first.filter("id > 0"), "inner").filter("id < 4"), "second").filter("id <> 2")

    before = written(spark.range(3), "before")
    out = shared.settled(spark, make, "out")
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        written(spark.range(2), "failed").count() / 0
    assert sorted(r["id"] for r in out.collect()) == [1, 3] and before.count() == 3
    assert {Path(p).name.rpartition("-")[0] for p in folders(made)} == {"before", "out"}
    shared.release(spark)
    assert not folders(made) and not made
