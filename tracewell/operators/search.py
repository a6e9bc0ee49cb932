"""Ranked full-text search over a postings table, and the plain scan for what has no index."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T

#: Accented letters and the plain ones they are searched as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
#: Constants of the ranking function.
K1, B = 1.2, 0.75
#: Weights by column. The first are what the positions of the reference's weights come to, the second what a reader expects.
POSITIONAL = {"name": 0.0, "fq_name": 20.0, "signature": 5.0, "doc": 1.0, "path": 2.0}
BY_NAME = {"name": 20.0, "fq_name": 10.0, "signature": 5.0, "doc": 1.0, "path": 2.0}
MOST = 200


def terms(text: Column) -> Column:
    """Search terms: lower case, without accents, cut at everything but letters and digits."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each term of each column: key, column, pos, term. Write it sorted by term: a search then reads few row groups."""
    parts = []
    for c in columns:
        found = terms(F.coalesce(F.col(c).cast("string"), F.lit("")))
        parts.append(docs.select(F.col(key).alias("key"), F.lit(c).alias("column"), F.posexplode(found).alias("pos", "term")))
    return reduce(DataFrame.unionByName, parts)


def lengths(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and size, the terms of all its columns; documents without any too."""
    size = reduce(lambda a, b: a + b, [F.size(terms(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns])
    return docs.select(F.col(key).alias("key"), size.cast("long").alias("size"))


def write_index(docs: DataFrame, key: str, columns: list[str], folder: str, call: int = 0) -> None:
    """Stores postings in the order of terms, so that a search reads few row groups, and the documents' lengths.

    Changed documents are added with a larger `call`: of a key only the rows of the largest one count. A document
    without text takes back its terms.
    """
    ordered = postings(docs, key, columns).repartitionByRange("term", "key").sortWithinPartitions("term", "key")
    ordered.withColumn("call", F.lit(call)).write.mode("append").parquet(f"{folder}/postings")
    lengths(docs, key, columns).withColumn("call", F.lit(call)).write.mode("append").parquet(f"{folder}/lengths")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of a stored index."""
    posts, sizes = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")
    last = sizes.groupBy("key").agg(F.max(F.struct("call", "size")).alias("last")).select("key", "last.*")
    # the filter on terms reaches the scan below the join
    return posts.join(last.select("key", "call"), ["key", "call"], "left_semi").drop("call"), last.drop("call")


def phrases(query: str) -> list[list[str]]:
    """The phrases of a query: operators and signs dropped, each word a phrase of its terms, the last one a prefix."""
    words = [w for w in re.sub(r"['\"*():^]", "", query.replace("::", " ")).split() if w.upper() not in ("AND", "OR", "NOT", "NEAR")]
    found = [[t for t in re.split(r"[^\w]|_", w.lower().translate(str.maketrans(ACCENTED, PLAIN))) if t] for w in words]
    return [p for p in found if p]


def search(posts: DataFrame, sizes: DataFrame, query: str, weights: dict[str, float], k: int = 20) -> DataFrame:
    """key and score of the k best documents, best first, ties by key; nothing for an empty query.

    Only postings of the query's terms are read. A document's score sums, over the phrases it holds, a phrase's
    rarity by its weighted hits, damped by the document's length. The statistics are one row.
    """
    found = phrases(query)
    if not found:
        return posts.select("key", F.lit(0.0).alias("score")).limit(0)
    # one pass over the postings: each gives a row for every place of the query that it matches
    marks = []
    for number, phrase in enumerate(found):
        for at, term in enumerate(phrase):
            match = F.col("term").startswith(term) if at == len(phrase) - 1 else F.col("term") == term
            marks.append((match, F.struct(F.lit(number).alias("phrase"), F.lit(at).alias("at"))))
    known = posts.filter(reduce(lambda a, b: a | b, [match for match, _ in marks]))
    each = F.filter(F.array(*[F.when(match, mark) for match, mark in marks]), lambda x: x.isNotNull())
    hits = known.select("key", "column", "pos", F.inline(each)).select("phrase", "at", "key", "column", (F.col("pos") - F.col("at")).alias("start"))
    long = F.element_at(F.array(*[F.lit(len(p)) for p in found]), F.col("phrase") + 1)
    if max(map(len, found)) > 1:
        hits = hits.groupBy("phrase", "key", "column", "start").agg(F.count_distinct("at").alias("parts")).filter(F.col("parts") == long)
    weight = reduce(lambda c, item: c.when(F.col("column") == item[0], F.lit(float(item[1]))), weights.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))
    freq = hits.groupBy("phrase", "key").agg(F.sum(weight).alias("freq"))
    docs = freq.groupBy("phrase").agg(F.count("*").alias("docs"))  # a row for each phrase
    whole = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    rare = F.log((F.col("n") - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    rare = F.when(rare <= 0, F.lit(1e-6)).otherwise(rare)
    rows = freq.join(F.broadcast(docs), "phrase").join(sizes, "key").join(F.broadcast(whole))
    part = rare * F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return rows.groupBy("key").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "key").limit(min(k, MOST))


def stats(found: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Sums over the distinct files that a search found: files, tokens, bytes."""
    hit = files.join(found.select(F.col("key").alias(key)).distinct(), key, "left_semi")
    return hit.agg(F.count("*").alias("files"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("token_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def scan_terms(query: str) -> list[str]:
    """What a plain scan looks for: the parts around OR without quotes, else the phrase as it is."""
    parts = query.split(" OR ") if " OR " in query else [query]
    return [t for t in (p.strip().strip('"').rstrip("*").strip('"') for p in parts) if t]


def scan(docs: DataFrame, key: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """Lines that hold one of the terms, case as it is: key, pos (from 1), line."""
    rows = docs.select(F.col(key).alias("key"), F.posexplode(T.lines(F.col(text))).alias("pos", "line"))
    test = reduce(lambda a, b: a | b, [F.col("line").contains(t) for t in scan_terms(query)], F.lit(False))
    rows = rows.filter(test).select("key", (F.col("pos") + 1).alias("pos"), "line")
    return rows if limit is None else rows.limit(limit)


def complete(found: DataFrame, limit: int) -> DataFrame:
    """count, and whether that is all there is: fewer than the limit."""
    return found.agg(F.count("*").alias("shown")).withColumn("complete", F.col("shown") < limit)
