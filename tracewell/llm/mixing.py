"""Mixing of sources to target weights by Pareto order sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import written

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and so each of its documents, is taken so many times at most.
MOST_COPIES = 3
#: Bins of the rank in which the cut is searched before rows are ordered; the bin that holds it is cut into as many again.
BINS = 4096
#: Odds of one more copy fall with a document's size to this power: repeats go to short documents rather than long ones.
SIZE_POWER = -0.5
#: Steps of halving that find how large the odds must be.
HALVINGS = 60
#: Times that what the first document beyond the cut left open goes to the next ones in rank that fit.
FILLS = 3
#: Tables of sources up to so many rows are broadcast; larger ones are joined by exchange.
BROADCAST_ROWS = 50_000
#: Name of the column that tells rows apart.
KEY = "__mix_row"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row for each source: source, source_size, target.

    The targets share all words by weight. A source stops at `most` times its size; what it leaves is shared by
    weight among the others until none is above. The sources that stop are the first ones in the order of size
    over weight, so sums along that order give the answer without rounds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (n % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "left_words": F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * most).over(ahead), F.lit(0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)),
        "ratio_place": F.row_number().over(by_ratio),
    })
    stops = (F.col("source_size") * most).cast("decimal(19,0)") * F.col("left_weight").cast("decimal(19,0)") <= F.col("left_words").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
    per = per.withColumn("free_place", F.min(F.when(~stops, F.col("ratio_place"))).over(every))
    free = F.col("free_place").isNotNull() & (F.col("ratio_place") >= F.col("free_place"))
    words = F.max(F.when(F.col("ratio_place") == F.col("free_place"), F.col("left_words"))).over(every)
    weight = F.max(F.when(F.col("ratio_place") == F.col("free_place"), F.col("left_weight"))).over(every)
    return per.select("source", "source_size", F.when(free, words.cast("double") * F.col("weight") / weight).otherwise((F.col("source_size") * most).cast("double")).alias("target"))


def _with(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of a table that has one row for each source; null is a source like any other."""
    table = table.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def odds(sizes: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """source, scale: a document's odds of one more copy, p / (1 - p), are scale * weight_of(size).

    The scale is the one with which the expected words, the sum of p * size, are the source's open words. It is found
    by halving over a table of the source's sizes, an eighth of a power of two apart.
    """
    step = F.round(8 * F.log2(F.greatest("size", F.lit(1)))).cast("int")
    per = sizes.groupBy("source", step.alias("step")).agg(F.sum("size").alias("words"))
    per = per.groupBy("source").agg(F.collect_list(F.struct(_weight(F.col("step")).alias("weight"), F.col("words").cast("double").alias("words"))).alias("steps"))
    rows = _with(per, plan.filter("open > 0").select("source", "open"), small)

    def expected(log_scale):
        return F.aggregate("steps", F.lit(0.0), lambda total, x: total + x["words"] * (1 - 1 / (1 + F.exp(log_scale) * x["weight"])))

    def halve(state, _):
        middle = (state["low"] + state["high"]) / 2
        over = expected(middle) > F.col("open")
        return F.struct(F.when(over, state["low"]).otherwise(middle).alias("low"), F.when(over, middle).otherwise(state["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(-60.0).alias("low"), F.lit(60.0).alias("high")), halve, lambda state: F.exp(state["low"]))
    return rows.select("source", found.alias("scale"))


def _weight(step: Column) -> Column:
    return F.pow(F.lit(2.0), SIZE_POWER * step / 8)


def weight_of(size: Column) -> Column:
    """What a document's size makes of its odds; sizes an eighth of a power of two apart have one weight."""
    return _weight(F.round(8 * F.log2(F.greatest(size, F.lit(1)))).cast("int"))


def _cut(rows: DataFrame, table: DataFrame, fine: int, small: bool) -> DataFrame:
    """Of each source whose rows don't all fit: source, room, the bin of rank (of `fine`) in which the room ends, and the
    words ahead of that bin."""
    rows = _with(rows.withColumn("bin", F.floor(F.col("rank") * fine).cast("long")), table, small)
    fill = rows.groupBy("source", "bin", "room", "ahead").agg(F.sum("size").alias("words"))
    fill = fill.withColumn("run", F.col("ahead") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))).filter("run > room")
    cut = fill.groupBy("source", "room").agg(F.min_by(F.struct("bin", (F.col("run") - F.col("words")).alias("sure")), "bin").alias("cut"))
    return cut.select("source", "room", F.col("cut.bin").alias("cut"), F.col("cut.sure").cast("long").alias("ahead"))


def _fit(rows: DataFrame, room: DataFrame, small: bool, name: str) -> DataFrame:
    """Of each source the first rows by rank whose words fit into its room: the rows' columns and `fits`.

    A histogram of the ranks finds the bin that holds the cut, a second one of that bin its part; only that part's rows
    are ordered, so no source however large meets in one task. The cuts are written, a row for each source: as part of
    one plan each of them would stand in it once for every use of it, and the driver pays for the size of a plan.
    """
    columns = rows.columns
    coarse = written(_cut(rows, room.withColumn("ahead", F.lit(0).cast("long")), BINS, small), f"mix-coarse-{name}")
    inside = _with(rows, coarse.select("source", "cut"), small).filter(F.floor(F.col("rank") * BINS).cast("long") == F.col("cut")).select(*columns)
    cuts = written(_cut(inside, coarse.drop("cut"), BINS * BINS, small), f"mix-cut-{name}").withColumnRenamed("source", "__source")
    # a source without a cut fits as a whole; BINS is a power of two, so bins of both sizes stand in one order
    rows = rows.join(F.broadcast(cuts) if small else cuts, F.col("source").eqNullSafe(F.col("__source")), "left")
    rows = rows.withColumn("bin", F.floor(F.col("rank") * (BINS * BINS)).cast("long"))
    whole = rows.filter("cut is null or bin <> cut").select(*columns, F.coalesce(F.col("bin") < F.col("cut"), F.lit(True)).alias("fits"))
    upto = F.col("ahead") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "size", KEY).rowsBetween(Window.unboundedPreceding, 0))
    parted = rows.filter("bin = cut").withColumn("upto", upto).select(*columns, (F.col("upto") <= F.col("room")).alias("fits"))
    return whole.unionByName(parted)


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken so that the sources' words come to their targets.

    A source whose target is t times its size takes every document floor(t) times for certain. The open words are a
    Pareto sample with unequal odds: a document's inclusion odds p / (1 - p) fall with its size (SIZE_POWER), as large
    as the expected words ask for. Documents stand by their random odds over their inclusion odds,
    (u / (1 - u)) / (p / (1 - p)), u from a hash of seed, id and text, and the first ones whose words fill the open
    words are taken: a sample of fixed size in words, in which each document is included with odds near p. What the
    first document that doesn't fit leaves open goes to the next ones in rank that do, FILLS times, and at last to one
    more document if that comes nearer to the target.

    Returns doc_id, source, size (words), source_size, target, copies, taken (words, repeats counted), and the row
    key of documents that have one: then the copies are those of that very row.
    Nulls: a null text has no words, a null source is the last source, a null id has a hash like any other. Rows
    are told apart by a key, so each row of a repeated id is judged by itself; rows equal in id and text have one rank.
    A source without words has target 0. An empty table gives no rows. Other columns are not read.
    """
    keyed_docs = KEY in docs.columns
    sizes = docs.select(
        F.col(KEY) if keyed_docs else F.monotonically_increasing_id().alias(KEY),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("digest"),
    )
    u = (F.shiftrightunsigned("digest", 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    sizes = written(sizes.select(KEY, "doc_id", "source", "size", u.alias("u")), "mix-sizes")
    targets = written(source_targets(sizes, weights), "mix-targets")
    small = targets.count() <= BROADCAST_ROWS

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.select("source", "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("open", F.col("target") - F.col("whole") * F.col("source_size"))
    scales = written(odds(sizes, plan, small), "mix-odds")
    ranked = _with(sizes.filter("size > 0"), scales, small)
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("scale") * weight_of(F.col("size")))
    rows = ranked.select(KEY, "source", "size", (q / (1 + q)).alias("rank"))
    room, taken = plan.filter("open > 0").select("source", F.col("open").alias("room")), None
    for k in range(1 + FILLS):
        fitted = written(_fit(rows, room, small, str(k)), f"mix-fit-{k}")
        more = fitted.filter("fits")
        taken = more if taken is None else taken.unionByName(more)
        if k == 0:
            beyond = fitted.filter("not fits").drop("fits")
        used = more.groupBy("source").agg(F.sum("size").alias("used")).withColumnRenamed("source", "__source")
        left = room.join(F.broadcast(used) if small else used, F.col("source").eqNullSafe(F.col("__source")), "left")
        room = written(left.select("source", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")), f"mix-room-{k}")
        rows = _with(fitted.filter("not fits"), room, small).filter("size <= room").select(KEY, "source", "size", "rank")
    # one more for each source if that comes nearer to its target than none
    near = _with(beyond, room, small).filter("size < 2 * room").join(taken.select(KEY), KEY, "left_anti")
    last = near.groupBy("source").agg(F.min_by(KEY, F.struct(F.abs(F.col("size") - F.col("room")), "rank", "size", KEY)).alias(KEY))
    extra = taken.select(KEY).unionByName(last.select(KEY)).withColumn("extra", F.lit(1))
    out = _with(sizes.join(extra, KEY, "left"), plan, small)
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies")
    return out.select(*([KEY] if keyed_docs else []), "doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a row key, written, so that the key stays."""
    return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "mix-keyed")


def mixed(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, without their row key.

    keyed() documents and their mix meet row by row: null and repeated ids are rows like any other. Without keys
    they meet by id, which must then be unique and not null.
    """
    by, of = (KEY, KEY) if KEY in docs.columns and KEY in mix.columns else (id_col, "doc_id")
    copies = mix.filter("copies > 0").select(F.col(of).alias("__mix_id"), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("__mix_copies"))
    # a written mix is small as a file, not as a broadcast table
    joined = docs.join(copies.hint("merge"), docs[by] == copies["__mix_id"])
    return joined.withColumn("__mix_n", F.explode("__mix_copies")).select(*[c for c in docs.columns if c != KEY])
