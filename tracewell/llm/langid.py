"""Language identification by cross-parsing: how few phrases of a language's own text does a text fall into.

A phrase is the longest stretch that occurs somewhere in the language's training text; a suffix automaton finds its
end in one step for each byte.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import blocks, bounded_arrow, share, stretch, text_bytes

#: Bounds of the training sample for each language: documents, characters of a text (of a longer one a hashed stretch);
#: of how many documents one goes to the own rate.
SAMPLE_DOCS, SAMPLE_CHARS, RATE_EVERY = 48, 4000, 4
#: Symbols of a piece of a text: all pieces of a block take a step at once, and are then joined to whole parses.
PIECE = 256
#: How sharply the score falls with a runner-up's distance.
SHARPNESS = 25.0
#: Languages up to so many are broadcast with their sample bounds; more are joined by exchange.
BROADCAST_ROWS = 50_000
#: Bytes of tables that a worker keeps; with more languages they are made anew when needed.
TABLE_BYTES = 256 << 20
UNKNOWN = "und"
#: Symbols: 0 white (all ASCII but letters, runs as one), 1 to 26 letters in lower case, 27 to 154 bytes from 0x80, 155 the end of a training text.
WHITE, END, SYMBOLS = 0, 155, 156
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[0x41:0x5B] = SYMBOL[0x61:0x7B] = np.arange(1, 27)
SYMBOL[0x80:] = np.arange(27, 155)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts end to end without repeated white, and where each text's begin."""
    out = SYMBOL[data]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != WHITE) | (out[:-1] != WHITE)
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence; state 0 reads nothing."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return following


def arcs(following: list[dict[int, int]]) -> np.ndarray:
    """The automaton as rows of state, symbol, next state; those of a text's end are left out."""
    return np.array([(state, c, to) for state, out in enumerate(following) for c, to in out.items() if c != END], np.int32).reshape(-1, 3)


class Language:
    """The automaton of one language's text as a table: step[state, class] is the next state and, from bit 29 on, how many
    phrases end with the step."""

    def __init__(self, name: str, rate: float, arcs: np.ndarray):
        self.name, self.rate = name, rate
        used = np.unique(arcs[:, 1])
        self.classes = np.zeros(SYMBOLS, np.int64)  # class 0: a symbol that the language hasn't
        self.classes[used] = np.arange(1, len(used) + 1)
        table = np.full((int(arcs[:, [0, 2]].max(initial=0)) + 1, len(used) + 1), 2 << 29, np.int32)  # a phrase ends, and the symbol alone is another
        table[0] = 1 << 29
        starts = arcs[arcs[:, 0] == 0]
        table[:, self.classes[starts[:, 1]]] = starts[:, 2] | 1 << 29
        table[arcs[:, 0], self.classes[arcs[:, 1]]] = arcs[:, 2]
        self.step, self.width = table.reshape(-1), table.shape[1]

    def phrases(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each whole text: greedy longest matches from its begin to its end.

        The pieces of all texts are parsed side by side, each as if a phrase began with it. Then each piece but a
        text's first is parsed on from where the one before it ended, until the state is the one it had there: from
        then on both parses agree. A piece that never agrees ends in another state, and the next one is parsed
        again. So the result is that of one parse of the whole text.
        """
        lengths = np.diff(offsets)
        parts = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = offsets[:-1][text] + nth * PIECE
        sizes = np.minimum(PIECE, offsets[1:][text] - begins)
        n, cls, step, width = len(begins), self.classes[flat], self.step, self.width
        trace = np.zeros(len(flat), np.int32)
        count, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(-sizes, kind="stable")
        live = np.searchsorted(-sizes[order], -np.arange(PIECE), "left")  # pieces longer than the step's number
        state, at = np.zeros(n, np.int64), begins[order]
        for k in range(int(sizes.max(initial=0))):
            m = int(live[k])
            got = step[state[:m] * width + cls[at[:m] + k]]
            trace[at[:m] + k] = got
            count[order[:m]] += got >> 29
            state[:m] = got & 0x1FFFFFFF
        last[order] = state
        again = np.flatnonzero(nth > 0)
        again = again[last[again - 1] != 0]
        while len(again):
            entry = last[again - 1]
            open_, state, ended = again, entry, []
            for k in range(PIECE):
                going = sizes[open_] > k
                ended.append((open_[~going], state[~going]))
                open_, state = open_[going], state[going]
                if not len(open_):
                    break
                place = begins[open_] + k
                got, old = step[state * width + cls[place]], trace[place]
                count[open_] += (got >> 29) - (old >> 29)
                trace[place] = got
                state = got.astype(np.int64) & 0x1FFFFFFF
                apart = state != (old & 0x1FFFFFFF)
                open_, state = open_[apart], state[apart]
            else:
                ended.append((open_, state))
            which, now = (np.concatenate(x) for x in zip(*ended, strict=True))
            which, now = which[last[which] != now], now[last[which] != now]
            last[which] = now
            following = which + 1
            again = following[(following < n)]
            again = np.sort(again[nth[again] > 0])
        ends = np.cumsum(parts) - 1
        out = np.bincount(text, count, len(lengths))
        some = parts > 0
        out[some] += last[ends[some]] != 0  # the phrase that is open at the end
        return out


class Model:
    """The automata of all languages; their tables are made when they are needed."""

    def __init__(self, langs: list[str], rates: list[float], arcs: list[np.ndarray]):
        self.langs, self.rates, self.arcs = langs, rates, arcs
        self.tables: dict[int, Language] = {}

    @staticmethod
    def learned(texts: dict[str, list[np.ndarray]], apart: dict[str, list[np.ndarray]]) -> Model:
        """From symbol sequences of each language for the automata, and others for the languages' own rates."""
        made = [one_language(k, texts[k], apart[k]) for k in sorted(texts)]
        return Model(sorted(texts), [rate for rate, _ in made], [a for _, a in made])

    def language(self, k: int) -> Language:
        if k not in self.tables:
            if sum(t.step.nbytes for t in self.tables.values()) > TABLE_BYTES:
                self.tables.clear()
            self.tables[k] = Language(self.langs[k], self.rates[k], self.arcs[k])
        return self.tables[k]

    def dump(self) -> bytes:
        out = [struct.pack("<q", len(self.langs))]
        for name, rate, rows in zip(self.langs, self.rates, self.arcs, strict=True):
            raw = name.encode()
            out.append(struct.pack("<qdq", len(raw), rate, len(rows)) + raw.ljust(-(-len(raw) // 8) * 8, b"\0") + rows.astype("<i4").tobytes())
        return b"".join(out)

    @staticmethod
    def load(raw: np.ndarray) -> Model:
        langs, rates, rows = [], [], []
        (many,), at = struct.unpack("<q", raw[:8].tobytes()), 8
        for _ in range(many):
            n, rate, count = struct.unpack("<qdq", raw[at : at + 24].tobytes())
            langs.append(raw[at + 24 : at + 24 + n].tobytes().decode())
            at += 24 + -(-n // 8) * 8
            rates.append(rate)
            rows.append(np.frombuffer(raw, "<i4", 3 * count, at).reshape(-1, 3))
            at += 12 * count
        return Model(langs, rates, rows)

    def phrases(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each whole text in each language."""
        return np.stack([self.language(k).phrases(flat, offsets) for k in range(len(self.langs))], axis=1)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language that needs the fewest phrases against its own rate, ties to the first name; a score from 0 to 1."""
        flat, at = symbols(data, offsets)
        if not self.langs:
            return [UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
        need = self.phrases(flat, at) / np.array(self.rates) / np.maximum(1, np.diff(at))[:, None]
        best = need.argmin(axis=1)
        sure = 1 / np.exp(-SHARPNESS * (need - need.min(axis=1, keepdims=True))).sum(axis=1)
        return [self.langs[k] for k in best.tolist()], sure


def one_language(name: str, texts: list[np.ndarray], apart: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """A language's own rate and its arcs.

    The rate is phrases for each symbol in the middle one of the texts that the automaton hasn't seen, by symbols (where
    there are none, of its own): so copies of what it has seen don't lower it.
    """
    found = arcs(automaton(np.concatenate([np.append(x, END) for x in texts] or [np.zeros(0, np.uint8)])))
    some = [x for x in apart or texts if len(x)]
    if not some:
        return 1.0, found
    size = np.array([len(x) for x in some])
    each = Language(name, 1.0, found).phrases(np.concatenate(some), np.concatenate(([0], np.cumsum(size)))) / size
    order = np.argsort(each, kind="stable")
    middle = int(np.searchsorted(np.cumsum(size[order]), size.sum() / 2))
    return max(1e-6, float(each[order[middle]])), found


def _learned_language(table: pa.Table) -> pa.Table:
    """The automaton of one language's sample. Every RATE_EVERY-th document, in the order of hashes, goes to the rate."""
    table = table.sort_by([("dice", "ascending"), ("text", "ascending")])
    texts: tuple[list, list] = ([], [])
    for place, text in enumerate(table.column("text").to_pylist(), 1):
        data = np.frombuffer(text.encode(), np.uint8)
        texts[place % RATE_EVERY == 0].append(symbols(data, np.array([0, len(data)]))[0])
    name = table.column("lang")[0].as_py()
    rate, rows = one_language(name, *texts)
    return pa.table({"lang": pa.array([name], pa.string()), "rate": pa.array([rate], pa.float64()), "arcs": pa.array([rows.astype("<i4").tobytes()], pa.binary())})


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> str:
    """Learns from the rows for which `learn` holds and whose text and language aren't null; gives the model's shared name.

    The sample has about SAMPLE_DOCS documents of each language, drawn by a hash of id and text; rows of equal id and
    text teach once. Texts are whole up to SAMPLE_CHARS characters; of longer ones so many from a hashed place take
    part. Each language is learned in a task of its own; its automaton, of bounded size, comes to the driver.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    rows = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).filter(F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("dice"), F.col(text_col).alias("text"))
    many = rows.groupBy("lang").agg(F.greatest(F.approx_count_distinct("dice"), F.lit(1)).alias("many"))
    # a language's share of hashes that holds about so many of its distinct rows, in whole parts of 2**40
    part = F.least(F.lit(1 << 40), F.floor(F.lit(float(SAMPLE_DOCS)) * (1 << 40) / F.col("many"))).alias("part")
    bound = many.select(F.col("lang").alias("of"), part)
    if many.count() <= BROADCAST_ROWS:
        bound = F.broadcast(bound)
    sample = rows.join(bound, F.col("lang") == F.col("of")).filter(F.pmod(F.xxhash64("dice", F.lit("langid")), F.lit(1 << 40)) < F.col("part"))
    sample = sample.select("lang", "dice", stretch(F.col("text"), SAMPLE_CHARS, "place").alias("text")).distinct()
    made = sample.groupBy("lang").applyInArrow(_learned_language, "lang string, rate double, arcs binary").collect()
    made = sorted(made, key=lambda r: r["lang"])
    arcs_of = [np.frombuffer(bytes(r["arcs"]), "<i4").reshape(-1, 3) for r in made]
    return share(spark, "langid", Model([r["lang"] for r in made], [r["rate"] for r in made], arcs_of).dump())


@functools.cache
def _model(name: str) -> Model:
    return Model.load(np.memmap(SparkFiles.get(name), np.uint8, "r"))


def predict(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every whole text.

    A text that is null or has no letter is `und` with score 0. Rows with equal ids are all kept, a null id stays,
    an empty table gives no rows, other columns are not read. Without any language learned all are `und`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                langs, scores = _model(model).predict(*text_bytes(part.column(1)))
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), part.column(2)], ["doc_id", "lang_pred", "score", "letters"])

    bounded_arrow(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("letters", F.col("text").rlike(r"\p{L}"))
    out = texts.mapInArrow(run, "doc_id long, lang_pred string, score double, letters boolean")
    return out.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))
