"""Byte-pair encoding of whole texts with a lexicon of frequent words, and decoding.

Exact for tokenizers whose pre-tokenizer drops white space and whose normalizer leaves the parts between ASCII white
space apart (NFC, white space to one space, lower case): such a part is encoded the same wherever it stands.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.shared import blocks, bounded_arrow, fitted, scratch, share, text_bytes, written
from tracewell.llm.tokenids import tokenizer
from tracewell.llm.transducer import Lexicon, build, open_lexicon

#: Parts whose words make the lexicon, at most; how often one must occur in all documents.
LEXICON_WORDS, LEAST_TIMES = 1 << 16, 4
#: Bytes of a part for the lexicon, at most: longer ones are merged.
LEXICON_BYTES = 64
#: Distinct parts of texts that a worker remembers, and ids of all of them; beyond either it begins anew.
REMEMBERED, REMEMBERED_IDS = 600_000, 8_000_000
#: Words of up to so many bytes are merged many at a time.
SHORT = 40
NEVER = np.int32(2**31 - 1)
#: Fixed value: the split pattern that the quick path for ASCII text equals.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
#: Below this character NFC changes nothing, and lower case and classes are as old as Unicode. U+0130 becomes two characters.
LATIN_END = "\u0130"


@functools.cache
def latin_split():
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0d\x20\x85\xa0\p{L}\p{N}]+")


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable, else the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordBPE:
    """Vocabulary, merges and word splitting of one tokenizer file."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        kinds = json.loads(self.library.to_str())
        model = kinds["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or model["byte_fallback"]:
            raise ValueError("this encoder is for BPE with word ends over bytes")
        self.decoder = kinds["decoder"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = byte_chars()
        self.of_char = {c: b for b, c in enumerate(chars)}
        self.inside = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = np.array([*pairs.values()], np.int32).reshape(-1, 2)[order].T.copy()
        added = {x["content"]: x["id"] for x in kinds["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in kinds["added_tokens"]):
            raise ValueError("added tokens must be plain")
        self.added = added
        self.cut = re.compile("|".join(f"({re.escape(x)})" for x in sorted(added, key=len, reverse=True))) if added else None
        self.cut_bytes = [x.encode() for x in added]
        pre = (kinds["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.quick = [x.get("type") for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"].get("Regex") == SPLIT and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
        size = max([*vocab.values(), *added.values()]) + 1
        self.tokens = np.array([""] * size, object)
        for token, k in (vocab | added).items():
            self.tokens[k] = token

    def split(self, part: bytes) -> list[bytes | int]:
        """The words of a text part without ASCII white space; an added token as its id."""
        if part.isalpha() and self.quick:  # ASCII letters only
            return [part.lower()]
        plain = self.quick and (b"<" not in part or not any(x in part for x in self.cut_bytes))
        if plain and part.isascii():
            if part[:-1].isalpha() and part[-1:] in (b".", b",", b";", b":", b"!", b"?"):
                return [part[:-1].lower(), part[-1:]]
            return [x.encode() for x in ASCII_SPLIT.findall(part.decode().lower())]
        text = part.decode("utf-8", "replace")
        if plain and max(text) < LATIN_END:
            return [x.encode() for x in ([text.lower()] if text.isalpha() else latin_split().findall(text.lower()))]
        out: list[bytes | int] = []
        for piece in filter(None, self.cut.split(text) if self.cut else [text]):
            if piece in self.added:
                out.append(self.added[piece])
            else:
                normal = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
                out += [bytes(map(self.of_char.__getitem__, word)) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.made[at]

    def merge(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of words by the merges: always the pair of lowest rank, the leftmost of equals."""
        out: list = [None] * len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        for low in range(0, SHORT, 8):
            at = np.flatnonzero((lengths > low) & (lengths <= low + 8))
            for k in range(0, len(at), 50_000):
                some = at[k : k + 50_000]
                for i, ids in zip(some.tolist(), self._merge_many([parts[i] for i in some], low + 8), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = self._merge_long(parts[i])
        return out

    def _merge_many(self, parts: list[bytes], width: int) -> list[list[int]]:
        n = len(parts)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(n, width)
        lengths = np.fromiter(map(len, parts), np.int64, n)
        ids = self.inside[raw]
        ids[np.arange(n), lengths - 1] = self.final[raw[np.arange(n), lengths - 1]]
        ranks = np.full((n, width), NEVER, np.int32)  # of the pair that begins here
        for k in range(width - 1):
            some = np.flatnonzero(lengths > k + 1)
            ranks[some, k] = self.rank_of(ids[some, k], ids[some, k + 1])[0]
        rows = np.arange(n)
        cols = np.arange(width)
        a, r, size = ids.copy(), ranks, lengths.copy()
        done: list = [None] * n
        while len(rows):
            best = r.argmin(axis=1)
            each = np.arange(len(rows))
            more = r[each, best] < NEVER
            for i, x, m in zip(rows[~more].tolist(), a[~more].tolist(), size[~more].tolist(), strict=True):
                done[i] = x[:m]
            rows, best, a, r, size = rows[more], best[more], a[more], r[more], size[more]
            if not len(rows):
                break
            each = np.arange(len(rows))
            new = self.rank_of(a[each, best], a[each, best + 1])[1]
            take = np.minimum(cols + (cols > best[:, None]), width - 1)
            a, r = np.take_along_axis(a, take, 1), np.take_along_axis(r, take, 1)
            r[:, -1] = NEVER
            a[each, best] = new
            size = size - 1
            left = np.flatnonzero(best > 0)
            r[left, best[left] - 1] = self.rank_of(a[left, best[left] - 1], new[left])[0]
            r[each, best] = NEVER
            right = np.flatnonzero(best + 1 < size)
            r[right, best[right]] = self.rank_of(new[right], a[right, best[right] + 1])[0]
        return done

    def _merge_long(self, part: bytes) -> list[int]:
        """The same for one word of any length: a heap of pairs over a linked list."""
        ids = self.inside[np.frombuffer(part, np.uint8)].tolist()
        ids[-1] = int(self.final[part[-1]])
        following, previous = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.pairs[pair], k, pair) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in self.pairs]
        heap = [(rank, k, pair, new) for rank, new, k, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, k, pair, new = heapq.heappop(heap)
            after = following[k] if ids[k] == pair[0] else -1
            if after < 0 or ids[after] != pair[1]:
                continue
            ids[k], ids[after] = new, -1
            following[k] = following[after]
            if following[k] >= 0:
                previous[following[k]] = k
            for x, y in ((previous[k], k), (k, following[k])):
                if x >= 0 and y >= 0 and (found := self.pairs.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, (ids[x], ids[y]), found[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode() gives, special tokens included."""
        if self.decoder is None:
            return " ".join(self.tokens[ids].tolist())
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


class Encoder:
    """Encodes texts: each distinct part once, its words by the lexicon, other words by the merges."""

    def __init__(self, bpe: WordBPE, lexicon: Lexicon | None):
        self.bpe, self.lexicon = bpe, lexicon
        self.forget()

    def forget(self) -> None:
        self.memory, self.lists = words.Memory(REMEMBERED), words.Ragged(np.int32)

    def words(self, parts: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words."""
        out: dict[bytes, list[int]] = {}
        if self.lexicon is not None and parts:
            places = self.lexicon.places(parts).tolist()
            out = {w: self.lexicon.output(p) for w, p in zip(parts, places, strict=True) if p >= 0}
            parts = [w for w, p in zip(parts, places, strict=True) if p < 0]
        out.update(zip(parts, self.bpe.merge(parts), strict=True))
        return out

    def learn(self, parts: list[bytes]) -> None:
        split = [self.bpe.split(x) for x in parts]
        ids_of = self.words(list(dict.fromkeys(w for x in split for w in x if type(w) is bytes)))
        flat: list[int] = []
        ends = [0]
        for x in split:
            for w in x:
                if type(w) is bytes:
                    flat += ids_of[w]
                else:
                    flat.append(w)
            ends.append(len(flat))
        self.lists.add(np.array(flat, np.int32), np.diff(ends))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        begins, ends, before = words.spans(data, offsets)
        codes, first, keys = words.distinct(data, begins, ends)
        if self.memory.count > REMEMBERED or self.lists.used > REMEMBERED_IDS:
            self.forget()
        number = self.memory.find(keys)
        new = np.flatnonzero(number < 0)
        number[new] = self.memory.add(keys[new])
        self.learn(words.pieces(data, begins[first[new]], ends[first[new]]))
        ids, lengths = self.lists.take(number[codes])
        return ids, np.concatenate(([0], np.cumsum(lengths)))[before]


@functools.cache
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


@functools.cache
def encoder(path: str, lexicon: str | None) -> Encoder:
    return Encoder(word_bpe(path), open_lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = text_bytes(part.column(0))
                begins, ends, _ = words.spans(data, offsets)
                codes, first, _ = words.distinct(data, begins, ends)
                data, offsets = words.cut(data, begins[first], ends[first])
                yield pa.record_batch([words.binary(data, offsets), pa.array(np.bincount(codes, minlength=len(first)))], ["part", "n"])

    return run


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compiles the words of the most frequent parts between white space, counted over all documents, with their ids.

    The `size` most frequent parts of up to LEXICON_BYTES bytes, ties by their bytes. Classes of counts a twelfth apart
    tell where the cut lies, so that only the class that holds it is ordered. One task of an executor compiles these
    parts; the driver gets the file only. Gives the name of the shared file. The lexicon makes encoding quicker and
    changes no id.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_counted(path), "part binary, n long").filter(F.octet_length("part") <= LEXICON_BYTES).groupBy("part").agg(F.sum("n").alias("n"))
    with scratch(spark):
        counts = written(counts.filter(F.col("n") >= LEAST_TIMES).withColumn("bin", F.floor(8 * F.log2("n")).cast("int")), "bpe-counts")
        room, edge = size, None
        for k, many in sorted(((r["bin"], r["count"]) for r in counts.groupBy("bin").count().collect()), reverse=True):  # some hundred rows
            edge = k
            if many >= room:
                break
            room -= many

        def compiled(table: pa.Table) -> bytes:
            bpe = word_bpe(path)
            frequent = sorted({w for x in table.column("part").to_pylist() for w in bpe.split(x) if type(w) is bytes})
            return build(frequent, bpe.merge(frequent))

        chosen = counts.select("part").limit(0)
        if edge is not None:
            last = counts.filter(F.col("bin") == edge).orderBy(F.desc("n"), "part").limit(room)
            chosen = counts.filter(F.col("bin") > edge).select("part").unionByName(last.select("part"))
        return share(spark, "lexicon", fitted(chosen, compiled))


def _encoded(path: str, lexicon: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, lexicon)
        for batch in batches:
            for part in blocks(batch):
                ids, offsets = enc.encode(*text_bytes(part.column(1)))
                decoded = [enc.bpe.decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, lexicon: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every whole text, each distinct part of a text encoded once.

    Special tokens are not added; where a text holds one literally it is that token, as in the library. Nulls: a
    null text is empty and has no ids, a null id stays. Rows with equal ids are all kept. An empty table gives no
    rows. Other columns are not read. `lexicon` is what build_lexicon() gave; without one all words are merged.
    """
    bounded_arrow(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_encoded(path, lexicon), "doc_id long, ids array<int>, decoded string")
