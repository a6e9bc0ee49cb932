"""Token ids in binary files: frequency ranks in 1 to 4 bytes, lengths apart in control bytes, four ids to each.

A file is a run of blocks, each ended by a line feed. A block, all numbers little-endian:

    4 bytes   b"TWI1"
    uint32    n, documents
    uint64    m, ids of all documents
    uint64    d, data bytes
    int64 * n     ids of the documents
    uint8 * n     1 where the id of the document is null
    uint32 * n    ids of each document
    uint8 * ceil(m / 4)   control bytes: 2 bits for each id, lowest first, its data bytes less one
    uint8 * d     the rank of each id, without its high zero bytes, lowest byte first

ranks.bin beside the files holds the token ids in the order of their ranks as uint32.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.shared import blocks, bounded_arrow, remove, text_bytes, work_folder, written

MAGIC = b"TWI1"
#: Ids that a block has at least, but for the last one of a file; it ends with a document.
BLOCK_IDS = 1 << 20
#: Ids that a file has on average, at most.
FILE_IDS = 1 << 24
#: Distinct pieces of text that a worker remembers, and ids of all of them; beyond either it begins anew.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 8_000_000

# ---- the code ----

#: Of each control byte, which of the 4 * 4 bytes of four ids are there.
PRESENT = (np.arange(4)[None, None, :] <= ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3)[:, :, None]).reshape(256, 16)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    control[: len(ranks)] = more
    control = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks, by a table that tells for each control byte where its data bytes go."""
    present = PRESENT[control].reshape(-1, 4)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[present] = data
    return out.reshape(-1).view("<u4")


def block_bytes(doc_ids: list, lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = MAGIC + np.uint32(len(doc_ids)).tobytes() + np.uint64(len(ranks)).tobytes() + np.uint64(len(data)).tobytes()
    ids = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return head + ids + np.array(lengths, "<u4").tobytes() + control + data


def read_blocks(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of each block of a file: ids of its documents, their numbers of ids, all ranks."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        n = int.from_bytes(content[at + 4 : at + 8], "little")
        m, d = (int.from_bytes(content[at + k : at + k + 8], "little") for k in (8, 16))
        take = lambda kind, count, at: np.frombuffer(content, kind, count, at)
        at += 24
        doc_ids, at = take("<i8", n, at), at + 8 * n
        nulls, at = take(np.uint8, n, at), at + n
        lengths, at = take("<u4", n, at), at + 4 * n
        control, at = take(np.uint8, -(-m // 4), at), at + -(-m // 4)
        data, at = take(np.uint8, d, at), at + d
        yield [None if z else x for x, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], lengths.astype(np.int64), decode_ranks(control, data, m)
        if content[at : at + 1] != b"\n":
            raise ValueError(f"a block doesn't end at byte {at}")
        at += 1


# ---- texts to ids ----

ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Encoder:
    """Encodes whole texts with a byte-level tokenizer whose tokens hold a space at their begin only.

    Such a text falls apart before each single space, at each line feed and after ASCII letters: the tokenizer's own
    pattern always ends a word there. A piece is encoded alone, with the space before it, to the same ids. So each
    distinct piece goes through the tokenizer once and its ids are remembered.
    Texts with other white space beside a space or line feed, or with an added token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import json

        self.tokenizer = tokenizer(path)
        kinds = json.loads(self.tokenizer.to_str())
        pre = kinds["pre_tokenizer"] or {}
        self.pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and kinds["normalizer"] is None
        self.added = [x["content"].encode() for x in kinds["added_tokens"]]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.pieces = self.pieces and self.line is not None
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.memory, self.lists = words.Memory(REMEMBERED), words.Ragged(np.uint32)
        if self.pieces:  # number 0 is the line feed
            self.memory.add(np.zeros((1, 2), np.uint64))
            self.lists.add(np.array([self.line], np.uint32), np.array([1]))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces that aren't known, many at a time, told apart by line feeds."""
        for at in range(0, len(pieces), 8192):
            part = pieces[at : at + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            line = ids == self.line
            ends = np.concatenate((np.flatnonzero(line), [len(ids)]))
            if len(ends) != len(part):
                raise ValueError("a piece holds a line feed")
            self.lists.add(ids[~line], np.diff(ends, prepend=-1) - 1)

    def apart(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts can't be taken apart."""
        out = np.zeros(len(offsets) - 1, bool)
        if not len(data):
            return out
        blank = words.WHITE.copy()
        blank[0x1C:0x20] = True
        odd = blank[data]
        wide = np.zeros(len(data), bool)  # first bytes of other white space: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000
        if (data >= 0xC2).any():
            a, b = data[:-1], data[1:]
            wide[:-1] = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)
        white = odd | wide
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        bad = (data != 0x20) & (data != 0x0A) & odd | wide
        bad[:-1] |= white[:-1] & white[1:]  # two beside each other
        bad |= white & (edge[:-1] | edge[1:])  # at the begin or end of a text
        out[np.unique(np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1)] = True
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return out

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the pieces: cut before spaces, at line feeds, and where an ASCII letter ends and no letter follows."""
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        line, letter = data == 0x0A, ASCII_LETTERS[data]
        edge[:-1] |= (data == 0x20) | line
        edge[1:-1] |= line[:-1] | letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
        edge[-1] = True
        cuts = np.flatnonzero(edge)
        begins, ends = cuts[:-1], cuts[1:]
        words_only = ~line[begins]
        return begins[words_only], ends[words_only]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text."""
        whole = self.apart(data, offsets) if self.pieces else np.ones(len(offsets) - 1, bool)
        out: list = [None] * len(whole)
        if whole.any():
            raw, at = data.tobytes(), np.flatnonzero(whole).tolist()
            for k, ids in zip(at, self.whole([raw[offsets[k] : offsets[k + 1]].decode() for k in at]), strict=True):
                out[k] = ids
        if whole.all():
            return out
        begins, ends = self.cut(data, offsets)
        keep = ~whole[np.searchsorted(offsets, begins, "right") - 1]
        begins, ends = begins[keep], ends[keep]
        codes, first, keys = words.distinct(data, begins, ends)
        if self.memory.count > REMEMBERED or self.lists.used > REMEMBERED_IDS:
            self.forget()
        number = self.memory.find(keys)
        new = np.flatnonzero(number < 0)
        number[new] = self.memory.add(keys[new])
        self.learn(words.pieces(data, begins[first[new]], ends[first[new]]))
        lines = np.flatnonzero(data == 0x0A)
        lines = lines[~whole[np.searchsorted(offsets, lines, "right") - 1]]
        at = np.concatenate((begins, lines))
        order = np.argsort(at, kind="stable")
        ids, lengths = self.lists.take(np.concatenate((number[codes], np.zeros(len(lines), np.int64)))[order])
        cut = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(at[order], offsets)]
        for k in np.flatnonzero(~whole).tolist():
            out[k] = ids[cut[k] : cut[k + 1]]
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _staged(path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(enc.tokenizer.get_vocab_size() + (end or 0) + 1, np.int64)
        for batch in batches:
            for part in blocks(batch):
                ids = enc.encode(*text_bytes(part.column(1)))
                if end is not None:
                    ids = [np.append(x, np.uint32(end)) for x in ids]
                if not ids:
                    continue
                counts += np.bincount(np.concatenate(ids), minlength=len(counts))
                packed = [pack.compress(x.astype("<u4" if enc.kind == np.uint32 else "<u2").tobytes()) for x in ids]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(ids), pa.int32())], STAGED_NAMES)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.nulls(len(seen), pa.int64()), pa.array(counts[seen]), pa.nulls(len(seen), pa.binary()), pa.array(seen.astype(np.int32))], STAGED_NAMES)

    return run


STAGED_NAMES = ["doc_id", "n", "packed", "token"]


def _file_blocks(rank_of: bytes, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ranks, unpack = np.frombuffer(rank_of, "<u4"), zstandard.ZstdDecompressor()
        doc_ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        count = 0

        def block() -> pa.RecordBatch:
            return pa.record_batch([pa.array([block_bytes(doc_ids, lengths, np.concatenate(held))], pa.binary())], ["block"])

        for batch in batches:
            for doc_id, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                size = n * (4 if wide else 2)
                ids = np.frombuffer(unpack.decompress(packed.as_py(), max_output_size=size), "<u4" if wide else "<u2")
                doc_ids.append(doc_id)
                lengths.append(n)
                held.append(ranks[ids])
                count += n
                if count >= BLOCK_IDS:
                    yield block()
                    doc_ids, lengths, held, count = [], [], [], 0
        if doc_ids:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, folder: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Encodes every text, appends the end id if there is one, writes files in ascending order of ids to `folder`.

    One pass tokenizes and counts each id over all documents; the counts, one for each entry of the vocabulary,
    give the ranks. The ids then go through one range exchange into sorted files of about FILE_IDS ids. Returns
    the token ids by rank.

    Nulls: a null text is empty, a null id comes first. An empty text has only the end id. Rows with equal ids
    are all written, in the order of their packed ids. An empty table writes no block. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    vocabulary = tokenizer(path).get_vocab_size()
    wide = vocabulary > 1 << 16
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stage = work_folder(spark, "ids-stage")
    schema = "doc_id long, n long, packed binary, token int"
    texts.mapInArrow(_staged(path, end), schema).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.schema(schema).parquet(stage)
    counts = staged.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token")
    by_rank = [(r["token"], r["n"]) for r in counts.collect()]  # one row for each entry of the vocabulary at most
    token_of = np.array([t for t, _ in by_rank], "<u4")
    rank_of = np.zeros(max(vocabulary, int(token_of.max(initial=0)) + 1), "<u4")
    rank_of[token_of] = np.arange(len(token_of), dtype="<u4")
    files = max(1, -(-sum(n for _, n in by_rank) // FILE_IDS))
    ordered = staged.filter("token is null").select("doc_id", "n", "packed").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "n", "packed")
    made = ordered.mapInArrow(_file_blocks(rank_of.tobytes(), wide), "block binary")
    made.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)
    remove(spark, stage)
    return token_of


def _decoded(token_of: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.frombuffer(token_of, "<u4")
        for batch in batches:
            for k in range(batch.num_rows):
                part, start = batch.column(0)[k].as_py(), 0
                for doc_ids, lengths, ranks in read_blocks(batch.column(1)[k].as_buffer().to_pybytes()):
                    ids = tokens[ranks]
                    ends = np.cumsum(lengths)
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                    yield pa.record_batch([pa.array([part] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + start), pa.array(lengths), pa.array(crcs, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])
                    start += int(ends[-1]) if len(ends) else 0

    return run


def read_index(spark: SparkSession, folder: str, token_of: np.ndarray) -> DataFrame:
    """Reads all files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the decoded ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("part"), "content")
    got = written(files.mapInArrow(_decoded(token_of.astype("<u4").tobytes()), "part long, doc_id long, at long, n_tokens long, ids_crc32 long"), "ids-index")
    totals = got.groupBy("part").agg(F.sum("n_tokens").alias("ids"))  # one row for each file
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("before"))
    return got.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(content: bytes, token_of: np.ndarray) -> dict:
    """The ids of each document of one file, by document."""
    out = {}
    for doc_ids, lengths, ranks in read_blocks(content):
        ends = np.cumsum(lengths)
        out |= {d: token_of[ranks[e - n : e]] for d, n, e in zip(doc_ids, lengths, ends, strict=True)}
    return out
