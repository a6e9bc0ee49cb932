"""Secret scans: three fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of ASCII letters, digits, + / _ - and bytes from 0x80. The field tags each token as begin, inside or
outside of a secret, by its shape, the characters beside it, the words around it and features of the whole text.
"""

from __future__ import annotations

import functools
import io
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.shared import blocks, bounded_arrow, fitted, hash_sample, share, stretch, text_bytes

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns of the first three kinds, and how long a match, or its value, must be.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What stands for a secret that was taken out.
MARK = "[secret]"
LEAST = {"assign": 8, "access": 16, "hex": 32}
HINTS = (b"passw", b"secret", b"token", b"api")

#: Bounds of the training sample: documents looked at, sequences with and without a pattern's match, made-up ones, tokens of a sequence.
SAMPLE_DOCS, FOUND_WINDOWS, PLAIN_WINDOWS, MADE_WINDOWS, WINDOW = 12_000, 600, 1600, 600, 60
PASSES, RATE, DECAY = 50, 0.08, 1e-5
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
BITS = 12

TOKEN = np.zeros(256, bool)
TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "+/_-"]] = True
TOKEN[0x80:] = True
DIGIT, LOWER, UPPER, SIGN, HIGH = range(1, 6)
KIND = np.zeros(256, np.uint8)
KIND[[ord(c) for c in string.digits]] = DIGIT
KIND[[ord(c) for c in string.ascii_lowercase]] = LOWER
KIND[[ord(c) for c in string.ascii_uppercase]] = UPPER
KIND[[ord(c) for c in "+/_-"]] = SIGN
KIND[0x80:] = HIGH
HEXADECIMAL = np.zeros(256, bool)
HEXADECIMAL[[ord(c) for c in "0123456789abcdef"]] = True
#: Classes of the characters beside a token: white or none, = , : , quotes, full stop, others.
BESIDE = np.full(256, 5, np.uint8)
BESIDE[[9, 10, 11, 12, 13, 32]] = 0
BESIDE[[ord(c) for c in "=:\"'`."]] = [1, 2, 3, 3, 3, 4]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, begin and end (code points) of the fixed patterns' matches, by begin, then in the order of kinds."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def covered(a: int, b: int, spans: list[tuple[str, int, int]]) -> bool:
    """Whether spans, sorted by begin, cover all of a to b."""
    for _, x, y in spans:
        if x <= a:
            a = max(a, y)
    return a >= b


def hinted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts may hold a fixed pattern: a word of the assignments, an access prefix, a run of hexadecimal digits."""
    out = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return out
    raw, low = data.tobytes(), words.lower(data).tobytes()
    for held, hint in [(low, h) for h in HINTS] + [(raw, b"AKIA")]:
        at = held.find(hint)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            out[k] |= at + len(hint) <= int(offsets[k + 1])  # not if the next text completes it
            at = held.find(hint, int(offsets[k + 1]))  # on with the next text
    ends = np.flatnonzero(~HEXADECIMAL[data])
    gaps = np.diff(np.concatenate(([-1], ends, [len(data)]))) - 1
    long = np.flatnonzero(gaps >= LEAST["hex"])
    begins = np.concatenate(([-1], ends))[long] + 1
    for b, n in zip(begins.tolist(), gaps[long].tolist(), strict=True):
        out[int(np.searchsorted(offsets, b, "right")) - 1 : int(np.searchsorted(offsets, b + n, "left"))] = True
    return out


# ---- features ----

#: Sizes of the feature tables: shape, make-up, beside, previous words, next word, shapes around, whole text.
SHAPES, MAKEUPS, SIDES, WHOLE = 1024, 128, 36, 32
TABLES = (SHAPES, MAKEUPS, SIDES, 1 << BITS, 1 << BITS, 1 << BITS, SHAPES, SHAPES, WHOLE)
STARTS = np.concatenate(([0], np.cumsum(TABLES)))[:-1]
SIZE = sum(TABLES)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return words.spans(data, offsets, ~TOKEN)


def features(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each token its entry in each feature table."""
    n, kind, size = len(begins), KIND[data], ends - begins
    out = np.zeros((n, len(TABLES)), np.int32)
    if not n:
        return out

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return sums[ends] - sums[begins]

    bucket = np.searchsorted([4, 8, 12, 16, 24, 32, 40], size, "right")
    digits = within(kind == DIGIT)
    shape = bucket.copy()
    for k, count in enumerate((digits, within(kind == LOWER), within(kind == UPPER), within(kind == SIGN), within(kind == HIGH))):
        shape |= (count > 0).astype(np.int64) << (3 + k)
    shape |= (within(HEXADECIMAL[data]) == size).astype(np.int64) << 8
    first = kind[begins] == UPPER
    shape |= first.astype(np.int64) << 9
    turns = np.zeros(len(data), bool)
    turns[1:] = kind[1:] != kind[:-1]
    changes = within(turns) - turns[begins]
    makeup = np.minimum(3, 4 * digits // size) * 32 + np.searchsorted([2, 4, 8], changes, "right") * 8 + bucket
    left = np.where((begins > 0) & ~np.isin(begins, offsets), BESIDE[data[begins - 1]], 0)
    right = np.where((ends < len(data)) & ~np.isin(ends, offsets), BESIDE[data[np.minimum(ends, len(data) - 1)]], 0)
    named = words.hashes(words.lower(data), begins, ends) & np.uint64((1 << BITS) - 1)
    named = np.maximum(named.astype(np.int64), 1)  # 0: no word there
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    place = np.arange(n) - before[text]
    many = np.diff(before)[text]

    def beside(values: np.ndarray, by: int) -> np.ndarray:
        moved = np.zeros(n, np.int64)
        if by > 0:
            moved[by:] = values[:-by]
            return np.where(place >= by, moved, 0)
        moved[:by] = values[-by:]
        return np.where(place < many + by, moved, 0)

    lengths = np.diff(offsets)
    hint = hinted(data, offsets)
    share_of_digits = np.zeros(len(lengths))
    sums = np.concatenate(([0], np.cumsum(kind == DIGIT)))
    share_of_digits = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, lengths)
    whole = hint * 16 + np.searchsorted([0.005, 0.02, 0.1], share_of_digits, "right") * 4 + np.searchsorted([200, 2000, 10000], lengths, "right")
    for k, column in enumerate((shape, makeup, left * 6 + right, beside(named, 1), beside(named, 2), beside(named, -1), beside(shape, 1), beside(shape, -1), whole[text])):
        out[:, k] = column
    return out


class Field:
    """Weights of features and of transitions between tags. A text begins and ends outside."""

    def __init__(self):
        self.weights = np.zeros((SIZE, 3), np.float32)
        self.moves = np.zeros((3, 3))

    def emissions(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros((len(found), 3), np.float32)
        for k, start in enumerate(STARTS.tolist()):
            out += self.weights[found[:, k] + start]
        return out

    def train(self, found: np.ndarray, tags: np.ndarray) -> None:
        """Maximises the likelihood of tag sequences of equal length (features: sequence, place, table; -1: none) by Adam."""
        many, length, _ = found.shape
        index = np.where(found >= 0, found + STARTS, SIZE)
        gold = np.eye(3)[tags]
        gold_moves = np.einsum("stk,stl->kl", np.concatenate((np.eye(3)[np.zeros((many, 1), int)], gold), axis=1), np.concatenate((gold, np.eye(3)[np.zeros((many, 1), int)]), axis=1))
        weights = np.zeros((SIZE + 1, 3))
        state = [np.zeros_like(x) for x in (weights, weights, self.moves, self.moves)]
        flat = index.reshape(-1)
        for step in range(1, PASSES + 1):
            scores = weights[index].sum(axis=2)
            ahead, back = np.zeros((many, length, 3)), np.zeros((many, length, 3))
            ahead[:, 0] = scores[:, 0] + self.moves[OUTSIDE]
            for t in range(1, length):
                ahead[:, t] = scores[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.moves, axis=1)
            back[:, -1] = self.moves[:, OUTSIDE]
            for t in range(length - 2, -1, -1):
                back[:, t] = np.logaddexp.reduce((scores[:, t + 1] + back[:, t + 1])[:, None, :] + self.moves, axis=2)
            total = np.logaddexp.reduce(ahead[:, -1] + self.moves[:, OUTSIDE], axis=1)
            odds = np.exp(ahead + back - total[:, None, None])
            pairs = np.exp(ahead[:, :-1, :, None] + self.moves + (scores + back)[:, 1:, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
            pairs[OUTSIDE] += odds[:, 0].sum(axis=0)
            pairs[:, OUTSIDE] += odds[:, -1].sum(axis=0)
            slope = np.repeat((odds - gold).reshape(-1, 3), found.shape[2], axis=0)
            grad = np.stack([np.bincount(flat, slope[:, k], SIZE + 1) for k in range(3)], axis=1) / many + DECAY * weights
            grad[SIZE] = 0
            grads = (grad, (pairs - gold_moves) / many + DECAY * self.moves)
            for k, (p, g) in enumerate(zip((weights, self.moves), grads, strict=True)):
                state[2 * k] += 0.1 * (g - state[2 * k])
                state[2 * k + 1] += 0.01 * (g * g - state[2 * k + 1])
                p -= RATE * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
        self.weights = weights[:SIZE].astype(np.float32)

    def decode(self, scores: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The best tags of each text.

        Where outside leads by more than any change of the two moves beside it can make up, the best path is
        outside; these tokens cut a text into stretches that are decoded on their own, with the same result.
        """
        m = self.moves
        reach = max(m[a, s] + m[s, b] - m[a, OUTSIDE] - m[OUTSIDE, b] for a in range(3) for b in range(3) for s in (BEGIN, INSIDE))
        open_at = np.flatnonzero(scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) <= reach)
        tags = np.zeros(len(scores), np.uint8)
        if not len(open_at):
            return tags
        text = np.searchsorted(before, open_at, "right")
        cuts = np.flatnonzero((np.diff(open_at) > 1) | (np.diff(text) > 0)) + 1
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(open_at)])).tolist(), strict=True):
            low, high = int(open_at[a]), int(open_at[b - 1]) + 1
            best = m[OUTSIDE] + scores[low]
            came = []
            for t in range(low + 1, high):
                ways = best[:, None] + m
                came.append(ways.argmax(axis=0))
                best = ways.max(axis=0) + scores[t]
            tag = int((best + m[:, OUTSIDE]).argmax())
            for t in range(high - 1, low - 1, -1):
                tags[t] = tag
                if t > low:
                    tag = int(came[t - low - 1][tag])
        return tags

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, weights=self.weights, moves=self.moves)
        return held.getvalue()

    @staticmethod
    def load(path: str) -> Field:
        held, out = np.load(path), Field()
        out.weights, out.moves = held["weights"], held["moves"]
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """All spans of each text in code points: the fixed patterns' and those of the field's that these don't cover wholly."""
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        raw = data.tobytes()
        for k in np.flatnonzero(hinted(data, offsets)).tolist():
            out[k] = base_spans(raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"))
        begins, ends, before = tokens(data, offsets)
        tags = self.decode(self.emissions(features(data, offsets, begins, ends, before)), before)
        at = np.flatnonzero(tags)
        if not len(at):
            return out
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        text = np.searchsorted(before, at, "right") - 1
        runs: list[tuple[int, int, int]] = []
        for i, k in zip(at.tolist(), text.tolist(), strict=True):
            if runs and tags[i] == INSIDE and runs[-1][2] == i - 1 and runs[-1][0] == k:
                runs[-1] = (k, runs[-1][1], i)
            else:
                runs.append((k, i, i))
        found: dict[int, list] = {}
        for k, i, j in runs:
            start = points[offsets[k]]
            a, b = int(points[begins[i]] - start), int(points[ends[j]] - start)
            if not covered(a, b, out[k]):
                found.setdefault(k, []).append(("crf", a, b))
        for k, more in found.items():
            out[k] = sorted(out[k] + more, key=lambda x: (x[1], KINDS.index(x[0])))
        return out


# ---- training ----


def made_up(dice: np.random.Generator) -> tuple[str, str]:
    """A made-up secret and what stands before it."""
    letters, low, big = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits
    draw = lambda chars, a, b: "".join(dice.choice(list(chars), int(dice.integers(a, b))))
    secret = (lambda: draw("0123456789abcdef", 18, 64), lambda: draw(letters + "+/", 20, 60), lambda: "AKIA" + draw(big, 16, 17), lambda: draw(low, 16, 40), lambda: "ghp_" + draw(letters, 36, 37), lambda: "sk-" + draw(letters, 32, 48), lambda: draw(letters + "_-", 24, 50))[int(dice.integers(0, 7))]()
    lead = ("", "", "", 'key = "', "auth: ", "credential=", 'PRIVATE_KEY="', "bearer ", "Authorization: Bearer ", "pwd: ", "access_key=")[int(dice.integers(0, 11))]
    return secret, lead


def sequences(texts: list[str], dice: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of windows of tokens: around matches of the fixed patterns, without any, and with made-up secrets.

    In half of the windows with secrets the words around are withheld, so that the shape must tell.
    """
    rows, tags, counts = [], [], {"found": 0, "plain": 0, "made": 0}
    most = {"found": FOUND_WINDOWS, "plain": PLAIN_WINDOWS, "made": MADE_WINDOWS}

    def add(kind: str, text: str, secret: list[tuple[int, int]]) -> None:
        data, offsets = text_bytes(pa.array([text], pa.large_string()))
        begins, ends, before = tokens(data, offsets)
        if not len(begins):
            return
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        a, b = points[begins], points[ends]
        own = np.zeros(len(begins), np.int64)
        for x, y in secret:
            inside = np.flatnonzero((a >= x) & (b <= y))
            own[inside] = INSIDE
            own[inside[:1]] = BEGIN
        middle = int(np.flatnonzero(own)[0]) if own.any() else int(dice.integers(0, len(own)))
        low = max(0, min(middle - int(dice.integers(1, WINDOW - 1)), len(own) - WINDOW))
        found = features(data, offsets, begins, ends, before)[low : low + WINDOW]
        if kind != "plain" and counts[kind] % 2:
            found[:, 3:6] = -1
        row = np.full((WINDOW, len(TABLES)), -1, np.int32)
        row[: len(found)] = found
        tag = np.zeros(WINDOW, np.int64)
        tag[: len(found)] = own[low : low + WINDOW]
        rows.append(row)
        tags.append(tag)
        counts[kind] += 1

    for text in texts:
        base = base_spans(text)
        kind = "found" if base else "plain"
        if counts[kind] < most[kind]:
            values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
            add(kind, text, values + [(x, y) for k, x, y in base if k != "assign" and not any(u < y and x < v for u, v in values)])
        if not base and counts["made"] < most["made"] and dice.random() < 0.5:
            secret, lead = made_up(dice)
            gaps = [m.end() for m in re.finditer(" ", text)] or [0]
            at = gaps[int(dice.integers(0, len(gaps)))]
            add("made", text[:at] + lead + secret + " " + text[at:], [(at + len(lead), at + len(lead) + len(secret))])
    return np.array(rows).reshape(-1, WINDOW, len(TABLES)), np.array(tags).reshape(-1, WINDOW)


def learned(texts: list[str], seed: int = 11) -> Field:
    field = Field()
    found, tags = sequences(texts, np.random.default_rng(seed))
    if len(tags) and tags.any():
        field.train(found, tags)
    else:  # nothing to learn from: all is outside
        field.moves[:, 1:] = -10
    return field


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 4000) -> str:
    """Learns from about SAMPLE_DOCS distinct documents, drawn by a hash of id and text; gives the field's shared name.

    The fixed patterns' matches and made-up secrets are its labels. Of a text longer than `most_chars` characters so
    many from a hashed place take part. Rows of equal id and text teach once, a null text nothing."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = hash_sample(docs.filter(F.col(text_col).isNotNull()), row, SAMPLE_DOCS, docs.count(), "secrets")
    rows = rows.select(row.alias("dice"), stretch(F.col(text_col), most_chars, "secrets").alias("text")).distinct()

    def fit(table: pa.Table) -> bytes:
        return learned(table.sort_by([("dice", "ascending"), ("text", "ascending")]).column("text").to_pylist()).dump()

    return share(docs.sparkSession, "secrets", fitted(rows, fit))


@functools.cache
def _field(name: str) -> Field:
    return Field.load(SparkFiles.get(name))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, field: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive) of every whole text.

    A null text counts as empty and has no spans. Rows with equal ids are all scanned, a null id stays, an empty
    table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in blocks(batch):
                found = _field(field).spans(*text_bytes(part.column(1)))
                spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)
                yield pa.record_batch([part.column(0), spans], ["doc_id", "spans"])

    bounded_arrow(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame, field: str, text_col: str = "text", length_col: str = "n_chars", mark: str = MARK) -> DataFrame:
    """The rows with every span of their texts replaced by a mark; all columns stay, an integer column of lengths follows the text.

    Spans that overlap are replaced as one. A null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                at = part.schema.get_field_index(text_col)
                found = _field(field).spans(*text_bytes(part.column(at)))
                if any(found):
                    texts = part.column(at).to_pylist()
                    for k, spans in enumerate(found):
                        if spans:
                            texts[k] = without(texts[k], spans, mark)
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                    n = part.schema.get_field_index(length_col)
                    if n >= 0 and pa.types.is_integer(part.schema.field(n).type):
                        old = part.column(n).to_pylist()
                        lengths = [len(texts[k]) if spans else old[k] for k, spans in enumerate(found)]
                        part = part.set_column(n, part.schema.field(n), pa.array(lengths, part.schema.field(n).type))
                yield part

    bounded_arrow(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def without(text: str, spans: list[tuple[str, int, int]], mark: str = MARK) -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
