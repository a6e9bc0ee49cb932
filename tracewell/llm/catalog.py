"""The queries of this folder by name, with DuckDB SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import ann, bpe, langid, minhash, mixing, secrets, sharding, tokenids, topk, toxicity
from tracewell.llm.shared import crc_remainder, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "ids")
    token_of = tokenids.write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder, end=2)
    return tokenids.read_index(spark, folder, token_of)


@query
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto(table(spark, sf_dir, "documents"))


def pareto(docs: DataFrame) -> DataFrame:
    return mixing.pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")
    return bpe_digest(bpe.encode_decode(docs, path, bpe.build_lexicon(docs, path)))


def bpe_digest(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id")) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    predicted = (F.col("score") >= toxicity.DECISION).cast("int").alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


@query
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_digest(secrets.scan(docs, secrets.train(docs)))


def secret_digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str):
        return F.filter("spans", lambda x: x["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = joined(F.filter("spans", lambda x: x["kind"] != "crf"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs, crc_remainder(F.col("doc_id")) != 1))
    return out.select("doc_id", (crc_remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query
def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLE["op8_near_duplicates"] = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLE["op10_top_k"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 5"""

#: The checksum goes byte by byte through a table of 256 entries that is made from its polynomial.
ORACLE["op9_byte_shards"] = r"""WITH t AS (SELECT list(c ORDER BY n) AS crcs FROM (SELECT n, list_reduce(list_concat([CAST(n AS BIGINT)], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS n))),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size FROM documents),
b AS (SELECT doc_id, size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(concat('0x', h) AS BIGINT))), lambda c, x: xor(crcs[xor(c % 256, x) + 1], c // 256)), 4294967295) AS text_crc32 FROM d, t),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS every FROM b),
p AS (SELECT *, CAST(least(23, (24 * (2 * upto - size)) // (2 * every)) AS INT) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""
