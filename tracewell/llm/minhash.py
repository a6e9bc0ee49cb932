"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i < T every shingle falls by a hash into one of T bins with a value that begins with i; a bin keeps
its least value, so a later round only fills what is still empty. In round T + j all shingles fall into bin j. So every
coordinate fills, and two sets agree in a coordinate with the odds of their similarity, sharply concentrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.shared import blocks, bounded_arrow, settled, text_bytes, written

#: Bands and coordinates of a band. A pair of similarity 0.8 shares no band with odds (1 - 0.8 ** 6) ** 40, about 5e-6.
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
WIDTH = 5
#: Sets of a block that are compared with those of another.
BLOCK = 256
EMPTY = np.uint64(2**64 - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, end to end, and where each text's begin.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. A text of fewer words than `width` has its whole sequence
    as one shingle, a text without words none.
    """
    data = words.lower(data)
    begins, ends, before = words.spans(data, offsets)
    key = words.keys(data, begins, ends)
    lanes = words.folded(key), words.folded(key[:, ::-1])
    first, last, text, cuts = _places(before, width)
    out = np.full(len(first), 0x243F6A8885A308D3, np.uint64)
    other = np.full(len(first), 0x13198A2E03707344, np.uint64)
    for k in range(width):
        at = first + k
        some = at < last
        out[some] = words.mix(out[some] * np.uint64(0x9E3779B97F4A7C15) + lanes[0][at[some]])
        other[some] = (other[some] ^ lanes[1][at[some]]) * np.uint64(0xD6E8FEB86659FD93) + out[some]
    out = words.mix(out ^ other >> np.uint64(32) ^ other << np.uint64(32))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.concatenate(([0], np.cumsum(new)))[cuts]


def _places(before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each shingle its first word, the end of its text and its text; and where each text's shingles begin."""
    count = np.diff(before)
    many = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), many)
    return words.gather(before[:-1], many), before[1:][text], text, np.concatenate(([0], np.cumsum(many)))


def numbered(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted numbers, end to end, and where each text's begin.

    Of these texts equal shingles, and only these, have equal numbers: words are numbered, then pairs of number and
    next word, and so on. Nothing rests on a hash of a shingle.
    """
    data = words.lower(data)
    begins, ends, before = words.spans(data, offsets)
    word, kinds, _ = words.distinct(data, begins, ends)
    first, last, text, cuts = _places(before, width)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    number = word[first]
    for k in range(1, width):
        at = first + k
        following = np.where(at < last, word[np.minimum(at, len(word) - 1)] + 1, 0)
        number, _ = pd.factorize(number * (len(kinds) + 1) + following)
    most = int(number.max()) + 1
    flat = np.unique(text * most + number)
    return flat % most, np.searchsorted(flat // most, np.arange(len(cuts)))


def alike(both: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many common items are linked."""
    return 100 * both >= PERCENT * (one + other - both)


def prints(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint of each set in two 64-bit integers."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k, salt in enumerate((0x452821E638D01377, 0xBE5466CF34E90C6C)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(flat ^ np.uint64(salt)))))
        out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    return out


def sketches(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BINS coordinates of each set; of an empty set all are EMPTY."""
    count = np.diff(offsets)
    out = np.full((len(count), BINS), EMPTY, np.uint64)
    cells = out.reshape(-1)
    text = np.repeat(np.arange(len(count)), count)
    items = flat
    for k in range(2 * BINS):
        if not len(items):
            break
        value = words.mix(items ^ words.mix(np.array([k + 1], np.uint64)))
        cell = (value >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32) if k < BINS else np.uint64(k - BINS)
        ranked = np.uint64(k << 32) | value & np.uint64(0xFFFFFFFF)
        np.minimum.at(cells, text * BINS + cell.astype(np.int64), ranked)
        open_texts = (out == EMPTY).any(axis=1)
        if not open_texts[text].all():
            still = open_texts[text]
            items, text = items[still], text[still]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A key of each band of each sketch; equal only for equal coordinates of the same band."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                flat, offsets = shingles(*text_bytes(part.column(1)), width)
                keys = bands(sketches(flat, offsets)).astype(np.int64).reshape(-1)
                own = prints(flat, offsets).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(offsets)) * BANDS, pa.int32()), pa.array(keys))
                yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), pa.array(own[:, 0]), pa.array(own[:, 1]), lists], ["doc_id", "n", "p", "q", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                flat, offsets = shingles(*text_bytes(part.column(1)), width)
                own = prints(flat, offsets).astype(np.int64)
                yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), pa.array(own[:, 0]), pa.array(own[:, 1]), part.column(1)], ["doc_id", "n", "p", "q", "text"])

    return run


def confirmed(one: pa.Array, other: pa.Array, width: int) -> np.ndarray:
    """Whether the texts of each pair are linked, by their whole sets of shingles."""
    many = len(one)
    (data, offsets), (more, on) = text_bytes(one), text_bytes(other)
    flat, cuts = numbered(np.concatenate((data, more)), np.concatenate((offsets, on[1:] + offsets[-1])), width)
    size = np.diff(cuts)
    own = np.repeat(np.arange(2 * many) % many, size) * (int(flat.max(initial=0)) + 1) + flat
    common = np.intersect1d(own[: cuts[many]], own[cuts[many] :], assume_unique=True)
    both = np.bincount(common // (int(flat.max(initial=0)) + 1), minlength=many)
    return alike(both, size[:many], size[many:])


def _verified(pairs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """Of pairs a, b those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "of_a"):
                yield part.select(["a", "b"]).filter(pa.array(confirmed(part.column(2), part.column(3), width)))

    full = pairs.join(sets.select(F.col("c").alias("b"), F.col("text").alias("of_b")), "b").join(sets.select(F.col("c").alias("a"), F.col("text").alias("of_a")), "a")
    return full.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def linked(c: np.ndarray, component: np.ndarray, outside: np.ndarray, offsets: np.ndarray, items: np.ndarray) -> list[tuple[int, int]]:
    """Links of the sets `outside` (a mask) with the others, one for each set and other component: whole sets compared.

    The sets (items: the shingles' numbers) lie end to end. Each outside set marks its items in a table; a sum over the marks of all items gives
    its intersections with all sets at once.
    """
    codes, _ = pd.factorize(items)
    size, out = np.diff(offsets), []
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    for k in np.flatnonzero(outside).tolist():
        own = codes[offsets[k] : offsets[k + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[codes], offsets[:-1], dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(alike(both, size, size[k]) & (component != component[k]))
        if len(near):
            near = near[np.unique(component[near], return_index=True)[1]]
            out += [(min(int(c[k]), int(c[i])), max(int(c[k]), int(c[i]))) for i in near.tolist()]
    return out


def _linked_block(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of one block: rows of outside classes beside rows of members; a class may be both."""
        table = table.sort_by([("c", "ascending"), ("outside", "descending")]).combine_chunks()
        c = table.column("c").to_numpy()
        keep = np.ones(len(c), bool)
        keep[1:] = c[1:] != c[:-1]  # a class that is both stands as outside
        table = table.filter(pa.array(keep))
        items, offsets = numbered(*text_bytes(table.column("text")), width)
        pairs = linked(c[keep], table.column("component").to_numpy(), table.column("outside").to_numpy(zero_copy_only=False), offsets, items)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run


def _checked_blocks(left: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """Links a, b between the members of a bucket outside its main component and all its members.

    A bucket's members fall by a hash into blocks of about BLOCK, and so do those outside; each pair of blocks is a
    group of its own, so a bucket of any size is many groups.
    """
    columns = ["bucket", "c", "component"]
    left = left.withColumns({"blocks": F.ceil(F.col("size") / BLOCK).cast("int"), "others": F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")})
    place = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = left.select(*columns, F.lit(False).alias("outside"), place("blocks").alias("m"), every("others").alias("o"))
    outside = left.filter("component <> main").select(*columns, F.lit(True).alias("outside"), place("others").alias("o"), every("blocks").alias("m"))
    rows = inside.unionByName(outside).join(sets, "c")
    return rows.groupBy("bucket", "m", "o").applyInArrow(_linked_block(width), "a long, b long").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge a, b.

    Each round every node takes the least label among its own and its neighbours', then its label's label; a third
    of a chain's length goes with each. Labels are written between rounds.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        moved = written(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("component"), (F.least("low", F.coalesce("further", "low")) < F.col("component")).alias("moved")), f"{name}-labels")
        labels = moved.select("node", "component")
        if moved.filter("moved").isEmpty():
            return labels


def _class_components(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """n, p, q and component_id of every class of the sketched rows; the tables that it writes serve for nothing else."""
    key = ["n", "p", "q"]
    # a class is known by its least id and its prints: ids may stand on several texts
    classes = rows.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "near-classes")

    member = classes.select("c", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("many"), F.min(F.struct("c", "n")).alias("lead")).filter("many > 1")
    members = written(member.join(shared.select("bucket", F.col("lead.c").alias("lead"), F.col("lead.n").alias("lead_n")), "bucket"), "near-members")
    wanted = classes.join(members.select("c").distinct(), "c").select("c", *key, "least")
    found = texts.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id").mapInArrow(_sets(width), "doc_id long, n long, p long, q long, text string")
    found = found.dropDuplicates(["doc_id", *key]).join(wanted.withColumnRenamed("least", "doc_id"), ["doc_id", *key])
    sets = written(found.select("c", "text"), "near-sets")

    links = None
    labels = None

    def labelled(df: DataFrame) -> DataFrame:
        """With the component of c so far."""
        if labels is None:
            return df.withColumn("component", F.col("c"))
        return df.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))

    def check(pairs: DataFrame, step: str) -> bool:
        """Verifies pairs a, b and adds their links; False if there was none to verify."""
        nonlocal links, labels
        pairs = written(pairs, f"near-pairs-{step}")
        if pairs.isEmpty():
            return False
        new = written(_verified(pairs, sets, width), f"near-links-{step}")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links, f"near-{step}")
        return True

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs a, b whose ends are not in one component yet, once each."""
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if labels is None:
            return pairs
        for end in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}")), end, "left")
        return pairs.filter("coalesce(component_a, a) <> coalesce(component_b, b)").select("a", "b")

    # the first member of each bucket: first against one class of each bucket's rest, then against all that are apart
    # pairs whose sizes alone rule a link out need no look at their sets
    starred = members.filter(f"c <> lead and 100 * least(n, lead_n) >= {PERCENT} * greatest(n, lead_n)")
    first = starred.groupBy(F.col("c").alias("b")).agg(F.min("lead").alias("a"))
    check(apart(first), "0")
    check(apart(starred.select(F.col("lead").alias("a"), F.col("c").alias("b"))), "1")
    # buckets whose other members are in several components yet: what is outside the largest one against all others
    left = labelled(members.filter("c <> lead").select("bucket", "c"))
    sizes = left.groupBy("bucket", "component").agg(F.count("*").alias("own"))
    spread = sizes.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("own").alias("size"), F.max("own").alias("most"), F.max_by("component", F.struct("own", "component")).alias("main")).filter("kinds > 1")
    left = written(left.join(spread.drop("kinds"), "bucket"), "near-left")
    if not left.isEmpty():
        new = written(_checked_blocks(left, sets, width), "near-links-2")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links, "near-2")

    named = labelled(classes.select("c", *key, "least"))
    component = F.min("least").alias("component_id")
    least = named.groupBy("component").agg(component)
    return named.select(*key, "component").join(least, "component").select(*key, "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Texts with equal shingle sets are one class and stand under one number. Classes that share a band of their
    sketches are candidates. Within such a bucket pairs are not all made: its members are checked against its first
    member; if all are then in one component it is done. Else those outside its largest component are checked
    against all its members, in blocks of BLOCK by BLOCK, and only links come out. So each pair of a bucket has been
    checked or is linked already. A check compares the full sets, shingle by shingle, from the texts. Nothing is
    capped or dropped. Texts count as one class by a 128-bit print of their sets.

    component_id is the least id reachable over links, the row's own included. Texts without words, and null texts,
    link with nothing: their component is their own id. So is a row with a null id: its component is null. Rows with
    equal ids are each judged by their text. An empty table gives no rows. Other columns are not read.
    """
    bounded_arrow(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(texts.mapInArrow(_sketched(width), "doc_id long, n long, p long, q long, bands array<long>"), "near-sketches")
    key = ["n", "p", "q"]
    final = settled(docs.sparkSession, partial(_class_components, rows, texts, width), "near-components")
    judged = rows.select("doc_id", *key).filter("n > 0 and doc_id is not null").join(final, key)
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", *key, F.col("doc_id").alias("component_id"))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def kept(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that have their component's least id; those without words stay.

    Each row is judged by its own text, under a row key in place of its id. A null id is above all others; of a
    component without any other id the first row stays. Rows of one component that share its least id all stay.
    """
    row = "__near_row"
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-keyed")
    found = settled(docs.sparkSession, partial(near_duplicates, docs, width, row, text_col), "near-found").withColumnRenamed("doc_id", row)
    member = found.filter("n_shingles > 0").join(docs.select(row, F.col(id_col).alias("id")), row)
    best = member.groupBy("component_id").agg(F.min("id").alias("least"), F.min(row).alias("first")).withColumnRenamed("component_id", "of")
    # by component and id, so that a large component meets in many tasks
    best = member.join(best, (F.col("component_id") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))).filter(F.col("least").isNotNull() | (F.col(row) == F.col("first")))
    stay = best.select(row).unionByName(found.filter("n_shingles = 0").select(row))
    return docs.join(stay, row, "left_semi").select(*[c for c in docs.columns if c != row])
