"""Toxicity: a convolutional text classifier over hashed word embeddings, trained with numpy.

A word is a run of letters in lower case (A-Z; bytes from 0x80 count as letters). Its vector is the sum of two rows,
of the hash of the word and of the hash of its first bytes. Filters of several widths run over a text's words; the
largest value of each filter goes into a logistic output. Thresholds are calibrated by language: a text's language
for this is the most likely one by its words, never a column, and its threshold is moved to DECISION on the score.

All labelled rows teach, with whole texts. Up to TASK_CHARS characters one task learns; beyond that all tasks count the
words and train, each over its own rows, and their weights are averaged after every pass.
"""

from __future__ import annotations

import functools
import io
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.shared import blocks, bounded_arrow, fitted, scratch, share, text_bytes, written

#: Characters from which a text counts as a long one; such texts teach as a whole, too.
SAMPLE_CHARS = 10_000
#: Characters of all labelled texts up to which one task learns.
TASK_CHARS = 24_000_000
#: Parts of the labelled rows: each is scored by a network that didn't see it, to calibrate the thresholds.
FOLDS = 3
#: Parts in which a network's weights are averaged; steps of a logit that are told apart where many tasks learn.
PIECES, BINS = 8, 1024
#: Documents in which a hash must occur for a row of its own; rows at most; bits of a row's slot.
LEAST_DOCS, MOST_ROWS, SLOT_BITS = 3, 60_000, 20
PREFIX = 5
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
#: Passes over the labelled rows, at least, and steps of training, at least.
EPOCHS, STEPS, BATCH, RATE = 3, 150, 64, 0.01
#: Where between the last toxic and the next clean logit a threshold lies.
GAP = 0.3
#: A language's own threshold counts by its toxic documents, the common one as much as so many.
COMMON_TOXIC = 12
#: Share of the clean documents that a threshold may leave above it, at most.
CLEAN_ABOVE = 0.02
DECISION = 0.7
#: Words that are convolved at a time.
STRETCH = 1 << 16
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of all texts, and the number of words before each text (one more entry than texts)."""
    data = words.lower(data)
    begins, ends, before = words.spans(data, offsets, NO_LETTER)
    heads = words.hashes(data, begins, np.minimum(ends, begins + PREFIX)) ^ np.uint64(0x5DEECE66D)
    return np.stack([words.hashes(data, begins, ends), heads], axis=1), before


class Network:
    """Rows of known hashes and the weights. Row 0 is any other hash, the last row the padding behind a text."""

    def __init__(self, keys: np.ndarray, dice: np.random.Generator):
        self.keys = keys
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        slot = (keys & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        self.slots[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)  # of two in a slot the more frequent has it
        self.rows = dice.normal(0, 0.05, (len(keys) + 2, DIM)).astype(np.float32)
        self.rows[[0, -1]] = 0
        self.filters = {w: dice.normal(0, 0.05, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w, f in self.filters.items():
            for k in range(FILTERS):
                f[k % w, 0, k] += 0.6
        self.bias = np.full(len(WIDTHS) * FILTERS, -0.2, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.constant = np.full(1, -2.0, np.float32)
        self.langs: list[str] = []
        self.lang_rows = np.zeros((len(keys) + 2, 0), np.float32)
        self.thresholds = np.zeros(1)  # of the logit, by language; the last one for texts of no known language

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash."""
        if not len(self.keys):
            return np.zeros(hashes.shape, np.int32)
        at = self.slots[(hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]
        return np.where((at >= 0) & (self.keys[at] == hashes), at + 1, 0).astype(np.int32)

    def padded(self, rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with padding behind each text, the places where filters begin, and how many of them come before each text.

        A text without words has one place, on the padding.
        """
        count = np.diff(before)
        places = np.maximum(count, 1)
        begins = np.cumsum(count + max(WIDTHS)) - count - max(WIDTHS)
        seq = np.full((int((count + max(WIDTHS)).sum()), 2), len(self.keys) + 1, np.int32)
        seq[words.gather(begins, count)] = rows
        return seq, words.gather(begins, places), np.concatenate(([0], np.cumsum(places)))

    def pooled(self, seq: np.ndarray, places: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The largest value of each filter over each text, by tables of what every row gives at every place of a filter."""
        tables = [[self.rows @ f[k] for k in range(w)] for w, f in self.filters.items()]
        out = np.full((len(before) - 1, len(self.bias)), -np.inf, np.float32)
        for at in range(0, len(places), STRETCH):
            some = places[at : at + STRETCH]
            values = np.concatenate([sum(t[seq[some + k, 0]] + t[seq[some + k, 1]] for k, t in enumerate(ts)) for ts in tables], axis=1)
            first = int(np.searchsorted(before, at, "right")) - 1
            last = int(np.searchsorted(before, at + len(some), "left"))
            cuts = np.maximum(before[first:last] - at, 0)
            out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(values, cuts, axis=0))
        return out + self.bias

    def logits(self, seq: np.ndarray, places: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(seq, places, before), 0) @ self.out + self.constant

    def languages(self, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The likeliest language of each text by its words; the number of languages if none speaks for one."""
        known = np.flatnonzero(rows[:, 0] > 0)
        text = np.searchsorted(before, known, "right") - 1
        sums = np.stack([np.bincount(text, self.lang_rows[rows[known, 0], k], len(before) - 1) for k in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(before) - 1, 1))
        return np.where(np.bincount(text, minlength=len(before) - 1) > 0, sums.argmax(axis=1), len(self.langs)) if self.langs else np.zeros(len(before) - 1, np.int64)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, before = word_hashes(data, offsets)
        rows = self.lookup(hashes)
        logit = self.logits(*self.padded(rows, before)) - self.thresholds[self.languages(rows, before)]
        return 1 / (1 + np.exp(-np.clip(logit + math.log(DECISION / (1 - DECISION)), -500, 500)))

    def params(self) -> dict[str, np.ndarray]:
        return {"rows": self.rows, "bias": self.bias, "out": self.out, "constant": self.constant} | {f"f{w}": f for w, f in self.filters.items()}

    def weights(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params().values()])

    def stepper(self, n_toxic: int, n_clean: int) -> Callable[[list[np.ndarray], np.ndarray], None]:
        """A step of Adam against the log loss for some texts, both classes with equal weight."""
        of_class = (n_toxic + n_clean) * 0.5 / np.maximum(1, [n_clean, n_toxic])
        params = self.params()
        mean, square = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
        done = 0

        def step(seqs: list[np.ndarray], labels: np.ndarray) -> None:
            nonlocal done
            done += 1
            grads = {k: np.zeros_like(p) for k, p in params.items()}
            count = np.array([len(x) for x in seqs])
            before = np.concatenate(([0], np.cumsum(count)))
            seq, places, before = self.padded(np.concatenate(seqs), before)
            x = self.rows[seq[:, 0]] + self.rows[seq[:, 1]]
            best = []
            pooled = np.empty((len(seqs), len(self.bias)), np.float32)
            for n, (w, f) in enumerate(self.filters.items()):
                values = sum(x[places + k] @ f[k] for k in range(w))
                where = np.stack([values[a:b].argmax(axis=0) + a for a, b in zip(before[:-1], before[1:], strict=True)])
                pooled[:, n * FILTERS : (n + 1) * FILTERS] = np.take_along_axis(values, where, 0)
                best.append(places[where])
            pooled += self.bias
            active = np.maximum(pooled, 0)
            slope = (1 / (1 + np.exp(-np.clip(active @ self.out + self.constant, -60, 60))) - labels) * of_class[labels.astype(np.int64)] / len(seqs)
            grads["out"] += active.T @ slope
            grads["constant"] += slope.sum()
            back = slope[:, None] * self.out * (pooled > 0)
            grads["bias"] += back.sum(axis=0)
            for n, (w, f) in enumerate(self.filters.items()):
                own, where = back[:, n * FILTERS : (n + 1) * FILTERS], best[n]
                for k in range(w):
                    at_k = x[where + k]
                    grads[f"f{w}"][k] += np.einsum("dfe,df->ef", at_k, own)
                    to = own[:, :, None] * f[k].T[None]
                    for side in range(2):
                        np.add.at(grads["rows"], seq[where + k, side].reshape(-1), to.reshape(-1, DIM))
            grads["rows"][[0, -1]] = 0
            for k, p in params.items():
                mean[k] += 0.1 * (grads[k] - mean[k])
                square[k] += 0.001 * (grads[k] ** 2 - square[k])
                p -= RATE * (mean[k] / (1 - 0.9**done)) / (np.sqrt(square[k] / (1 - 0.999**done)) + 1e-8)

        return step

    def train(self, seqs: list[tuple], labels: np.ndarray, dice: np.random.Generator) -> None:
        """Passes over all texts in random order."""
        step = self.stepper(int(labels.sum()), int((1 - labels).sum()))
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(BATCH, len(labels))))):
            order = dice.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                step([seqs[i] for i in some], labels[some])

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, keys=self.keys, rows=self.rows, bias=self.bias, out=self.out, constant=self.constant, langs=np.array(self.langs, dtype="U"), lang_rows=self.lang_rows, thresholds=self.thresholds, **{f"f{w}": f for w, f in self.filters.items()})
        return held.getvalue()

    @staticmethod
    def load(path: str) -> Network:
        held = np.load(path)
        net = Network(held["keys"], np.random.default_rng(0))
        net.rows, net.bias, net.out, net.constant, net.lang_rows, net.thresholds = (held[k] for k in ("rows", "bias", "out", "constant", "lang_rows", "thresholds"))
        net.langs, net.filters = held["langs"].tolist(), {w: held[f"f{w}"] for w in WIDTHS}
        return net


def cutoff(logits: np.ndarray, labels: np.ndarray, docs: np.ndarray | None = None) -> float:
    """The threshold of the best F1 with CLEAN_ABOVE of the clean ones above it at most: between the last logit that counts
    as toxic and the next one, by GAP from the first. With `docs`, so many texts have a logit, `labels` of them toxic."""
    docs = np.ones(len(logits), np.int64) if docs is None else docs
    order = np.argsort(-logits, kind="stable")
    hits, many = np.cumsum(labels[order]), np.cumsum(docs[order])
    f1 = 2 * hits / (many + labels.sum())
    f1[many - hits > CLEAN_ABOVE * (docs - labels).sum()] = 0
    k = int(f1.argmax())
    if f1[k] == 0:  # a clean one leads
        return float(logits[order[0]] + 1)
    return float(logits[order[k]] - GAP * (logits[order[k]] - logits[order[k + 1]])) if k + 1 < len(order) else float(logits[order[k]] - 1)


def occurrences(hashes: np.ndarray, before: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of some of the texts once for every text that has it, and the text, by hash."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    both, owner = hashes.reshape(-1), np.repeat(text, 2)
    keep = part[owner]
    order = np.lexsort((owner[keep], both[keep]))
    key, owner = both[keep][order], owner[keep][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new]


def started(keys: np.ndarray, docs: np.ndarray, toxic: np.ndarray, n_toxic: int, n_clean: int, dice: np.random.Generator) -> Network:
    """An untrained network of the hashes in most documents, which begin with what they say about the classes."""
    order = np.argsort(-docs, kind="stable")
    order = order[docs[order] >= LEAST_DOCS][:MOST_ROWS]
    net = Network(keys[order], dice)
    odds = np.log((toxic[order] + 0.5) / (n_toxic + 1)) - np.log((docs[order] - toxic[order] + 0.5) / (n_clean + 1))
    net.rows[1:-1, 0] += np.clip(odds, -4, 4) / 4
    return net


def fitted_network(hashes: np.ndarray, before: np.ndarray, labels: np.ndarray, part: np.ndarray, dice: np.random.Generator) -> tuple[Network, list[np.ndarray]]:
    """A network trained on some of the texts, and the rows of all."""
    key, owner = occurrences(hashes, before, part)
    keys, begins, docs = np.unique(key, return_index=True, return_counts=True)
    toxic = np.add.reduceat(labels[owner], begins) if len(keys) else np.zeros(0)
    n_toxic, n_clean = labels[part].sum(), (1 - labels[part]).sum()
    net = started(keys, docs, toxic, n_toxic, n_clean, dice)
    rows = net.lookup(hashes)
    seqs = [rows[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]
    if 0 < n_toxic < part.sum():
        net.train([seqs[i] for i in np.flatnonzero(part)], labels[part].astype(np.float32), dice)
    return net, seqs


def learned(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 5) -> Network:
    """A network from labelled texts; their languages only calibrate thresholds.

    Each of FOLDS parts is scored by a network trained on the others. The scores of all texts give the common
    threshold and each language's own, which shrinks to the common one the fewer toxic texts the language has.
    """
    dice = np.random.default_rng(seed)
    hashes, before = word_hashes(*text_bytes(pa.array(texts, pa.large_string())))
    every = np.ones(len(texts), bool)
    net, seqs = fitted_network(hashes, before, labels, every, dice)
    net.langs = sorted({x for x in langs if x is not None})
    own = np.array([net.langs.index(x) if x is not None else -1 for x in langs], np.int64)
    counts = np.zeros((len(net.keys) + 2, len(net.langs)))
    for k in range(len(net.langs)):
        counts[:, k] = np.bincount(np.concatenate([seqs[i][:, 0] for i in np.flatnonzero(own == k)]), minlength=len(counts))
    net.lang_rows = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))).astype(np.float32)
    net.thresholds = np.zeros(len(net.langs) + 1)
    if not 0 < labels.sum() < len(labels):
        return net
    fold = np.empty(len(texts), np.int64)  # both classes spread over the parts
    for label in (0, 1):
        at = np.flatnonzero(labels == label)
        fold[at] = np.arange(len(at)) % FOLDS
    logits = np.empty(len(texts))
    for k in range(FOLDS):
        other, rows = fitted_network(hashes, before, labels, fold != k, np.random.default_rng(seed + 1 + k))
        for i in np.flatnonzero(fold == k):
            logits[i] = other.logits(*other.padded(rows[i], np.array([0, len(rows[i])])))[0]
    general = cutoff(logits, labels)
    net.thresholds[:] = general
    for k in range(len(net.langs)):
        some = own == k
        toxic = int(labels[some].sum())
        if 0 < toxic < some.sum():
            net.thresholds[k] = (toxic * cutoff(logits[some], labels[some]) + COMMON_TOXIC * general) / (toxic + COMMON_TOXIC)
    return net


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have a hash: by part, clean and toxic ones."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        counts = np.zeros((len(keys), 2 * FOLDS), np.int64)
        np.add.at(counts, place, np.concatenate([n for _, n in held]))
        return keys, counts

    for batch in batches:
        for some in blocks(batch, "__text"):
            hashes, before = word_hashes(*text_bytes(some.column(0)))
            kind = 2 * np.asarray(some.column(2)) + np.asarray(some.column(1))
            key, owner = occurrences(hashes, before, np.ones(some.num_rows, bool))
            keys, place = np.unique(key, return_inverse=True)
            held.append((keys, np.bincount(place * 2 * FOLDS + kind[owner], minlength=2 * FOLDS * len(keys)).reshape(-1, 2 * FOLDS)))
            if sum(len(k) for k, _ in held) > 1 << 20:
                held = [merged()]
    if held:
        keys, counts = merged()
        for at in range(0, len(keys), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield pa.record_batch([pa.array(keys[some].view(np.int64)), *(pa.array(c) for c in counts[some].T)], ["word", *(f"n{k}" for k in range(2 * FOLDS))])


def _passed(names: list[str], classes: list[tuple[int, int]], by_language: bool):
    """A pass of each network over a task's rows outside its part: their number and what the weights have moved by, in
    pieces (most rows of a network don't move, and zeros take no room on their way); with
    `by_language` also how often each row of the last network, the one of all parts, occurs in a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = [Network.load(SparkFiles.get(name)) for name in names]
        starts = [net.weights() for net in nets]
        steps = [net.stepper(*of) for net, of in zip(nets, classes, strict=True)]
        seqs, labels, many = ([[] for _ in nets], [[] for _ in nets], [0] * len(nets))
        words_of: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(nets[-1].keys) + 2))

        def step(k: int) -> None:
            if min(classes[k]):
                steps[k](seqs[k], np.array(labels[k], np.float32))
            many[k] += len(seqs[k])
            seqs[k], labels[k] = [], []

        for batch in batches:
            for some in blocks(batch, "__text"):
                hashes, before = word_hashes(*text_bytes(some.column(0)))
                label, fold, langs = (some.column(i).to_pylist() for i in (1, 2, 3))
                for k, net in enumerate(nets):
                    rows = net.lookup(hashes)
                    for i in range(some.num_rows):
                        own = rows[before[i] : before[i + 1]]
                        if by_language and k == FOLDS and langs[i] is not None:
                            words_of[langs[i]] += np.bincount(own[:, 0], minlength=len(net.keys) + 2)
                        if fold[i] != k:
                            seqs[k].append(own)
                            labels[k].append(label[i])
                            if len(seqs[k]) == BATCH:
                                step(k)
        for k in range(len(nets)):
            if seqs[k]:
                step(k)
        made = [(f"net{k}", many[k], net.weights() - starts[k]) for k, net in enumerate(nets) if many[k]]
        for name, weight, values in [*made, *((f"lang{x}", 1, n) for x, n in words_of.items())]:
            for k, piece in enumerate(np.array_split(values.astype(np.float32), PIECES)):
                yield pa.record_batch([pa.array([name]), pa.array([k], pa.int32()), pa.array([weight], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["name", "piece", "weight", "made"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights and of the weighted values of each piece."""
    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held = sums.setdefault((row["name"], row["piece"]), [0, 0.0])
            held[0] += row["weight"]
            held[1] = held[1] + row["weight"] * np.frombuffer(row["made"], np.float32).astype(np.float64)
    for (name, piece), (weight, total) in sums.items():
        yield pa.record_batch([pa.array([name]), pa.array([piece], pa.int32()), pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["name", "piece", "weight", "made"])


def _binned(names: list[str]):
    """How many documents, and toxic ones, of a language have a logit of the network that didn't see them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for some in blocks(batch, "__text"):
                hashes, before = word_hashes(*text_bytes(some.column(0)))
                label, langs, fold = some.column(1).to_pylist(), some.column(3).to_pylist(), np.asarray(some.column(2))
                for k, name in enumerate(names):
                    own, net = np.flatnonzero(fold == k), _network(name)
                    count = np.diff(before)[own]
                    rows = net.lookup(hashes[words.gather(before[own], count)])
                    logits = net.logits(*net.padded(rows, np.concatenate(([0], np.cumsum(count))))) if len(own) else np.zeros(0)
                    for i, x in zip(own.tolist(), np.floor(BINS * logits.astype(np.float64)).astype(np.int64).tolist(), strict=True):
                        held = found[langs[i], x]
                        held[0] += 1
                        held[1] += label[i]
        if found:
            yield pa.record_batch([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64()), *(pa.array([n[k] for n in found.values()], pa.int64()) for k in (0, 1))], ["lang", "bin", "docs", "toxic"])

    return run


def learned_by_all(rows: DataFrame, seed: int = 5) -> Network:
    """What `learned` does, by all tasks. rows: __text, __toxic, fold, __lang, in random order.

    The words are counted in every row. Each task passes over its rows from the shared weights on, and the weights are
    averaged by rows, EPOCHS times; a task's share is what Spark reads in one. Of every row one cross-validated logit counts, to a BINS-th.
    """
    spark = rows.sparkSession
    names = [f"n{k}" for k in range(2 * FOLDS)]
    counted = rows.mapInArrow(_counted, ", ".join(f"{c} long" for c in ["word", *names])).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    docs_of = [sum(F.col(c) for i, c in enumerate(names) if i // 2 != k) for k in range(FOLDS + 1)]
    counted = written(counted.filter(docs_of[-1] >= LEAST_DOCS), "toxicity-words")
    enough = F.lit(False)
    for docs in docs_of:
        most, least = 0, None
        for r in counted.filter(docs >= LEAST_DOCS).groupBy(docs.alias("docs")).count().sort(F.desc("docs")).collect():
            most += r["count"]
            if most > MOST_ROWS:
                break
            least = r["docs"]
        enough = enough | (docs >= least) if least else enough
    table = counted.filter(enough).sort("word").toArrow()
    keys = np.asarray(table.column("word").combine_chunks()).astype(np.int64).view(np.uint64)
    counts = np.stack([np.asarray(table.column(c).combine_chunks()) for c in names], axis=1).astype(np.int64)
    classes = {(r["fold"], r["__toxic"]): r["count"] for r in rows.groupBy("fold", "__toxic").count().collect()}
    nets, of = [], []
    for k in range(FOLDS + 1):
        others = [2 * j for j in range(FOLDS) if j != k]
        of.append(tuple(sum(classes.get((j // 2, label), 0) for j in others) for label in (1, 0)))
        toxic = counts[:, [j + 1 for j in others]].sum(axis=1)
        nets.append(started(keys, counts[:, others].sum(axis=1) + toxic, toxic, *of[k], np.random.default_rng(seed + k)))
    schema = "name string, piece int, weight long, made binary"
    totals: dict[str, np.ndarray] = {}
    for epoch in range(EPOCHS):
        shared = [share(spark, "toxicity-fit", net.dump()) for net in nets]
        made = rows.mapInArrow(_passed(shared, of, epoch == 0), schema).repartition(PIECES * len(nets), "name", "piece").mapInArrow(_added, schema)
        pieces: dict[str, list] = defaultdict(list)
        for r in sorted(made.collect(), key=lambda r: (r["name"], r["piece"])):
            pieces[r["name"]].append(np.frombuffer(r["made"]) / (r["weight"] if r["name"].startswith("net") else 1))
        totals |= {name: np.concatenate(x) for name, x in pieces.items()}
        for k, net in enumerate(nets):
            at = 0
            for p in net.params().values():
                p += totals[f"net{k}"][at : at + p.size].reshape(p.shape).astype(np.float32)
                at += p.size
    net = nets[FOLDS]
    net.langs = sorted(x.removeprefix("lang") for x in totals if x.startswith("lang"))
    found = np.stack([totals[f"lang{x}"] for x in net.langs], axis=1) if net.langs else np.zeros((len(net.keys) + 2, 0))
    net.lang_rows = np.log((found + 0.5) / (found.sum(axis=0) + 0.5 * len(found))).astype(np.float32)

    shared = [share(spark, "toxicity-fit", x.dump()) for x in nets[:FOLDS]]
    binned = rows.mapInArrow(_binned(shared), "lang string, bin long, docs long, toxic long").groupBy("lang", "bin").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).sort("lang", "bin").collect()

    def threshold(some: list) -> tuple[float, int, int]:
        bins, place = np.unique([r["bin"] for r in some], return_inverse=True)
        docs, toxic = (np.bincount(place, [r[c] for r in some]).astype(np.int64) for c in ("docs", "toxic"))
        return cutoff((bins + 0.5) / BINS, toxic, docs), int(toxic.sum()), int(docs.sum())

    general = threshold(binned)[0]
    net.thresholds = np.full(len(net.langs) + 1, general)
    for k, lang in enumerate(net.langs):
        own, toxic, docs = threshold([r for r in binned if r["lang"] == lang])
        if 0 < toxic < docs:
            net.thresholds[k] = (toxic * own + COMMON_TOXIC * general) / (toxic + COMMON_TOXIC)
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", task_chars: int = TASK_CHARS) -> str:
    """Learns from all labelled rows for which `learn` (a condition on the id) holds; gives the model's shared name.

    Whole texts take part. Up to `task_chars` characters one task learns, beyond that all tasks do. Rows with a null
    id, text or label teach nothing; a document with several labels counts by the largest; of several texts with one id
    the one of the least hash teaches. Without both classes the model calls nothing toxic.
    """
    bounded_arrow(docs.sparkSession)
    known = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("long").alias("__toxic"))
    rows = docs.filter(learn & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    one = F.min_by(F.struct("__text", "__lang"), F.struct(F.xxhash64("__text"), "__lang")).alias("one")
    rows = rows.join(known, "__id").groupBy("__id", "__toxic").agg(one)
    fold = F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(FOLDS)).alias("fold")
    rows = rows.select(F.xxhash64("__id", F.lit("order")).alias("dice"), F.col("one.__text").alias("__text"), "__toxic", fold, F.col("one.__lang").alias("__lang"))
    with scratch(docs.sparkSession):
        rows = written(rows.sortWithinPartitions("dice"), "toxicity-rows")
        size = rows.agg(F.sum(F.length("__text")).alias("chars"), F.countDistinct("__toxic").alias("classes")).first()

        def fit(table: pa.Table) -> bytes:
            table = table.sort_by([("dice", "ascending"), ("__text", "ascending")])
            labels = np.array(table.column("__toxic").to_pylist(), np.int64)
            net = learned(table.column("__text").to_pylist(), labels, table.column("__lang").to_pylist())
            if len(set(labels.tolist())) < 2:
                net.out[:], net.constant[:], net.thresholds[:] = 0, -4, 0
            return net.dump()

        if size["classes"] < 2:
            return share(docs.sparkSession, "toxicity", fitted(rows.limit(0), fit))
        if size["chars"] <= task_chars:
            return share(docs.sparkSession, "toxicity", fitted(rows, fit))
        return share(docs.sparkSession, "toxicity", learned_by_all(rows.select("__text", "__toxic", "fold", "__lang")).dump())


@functools.cache
def _network(name: str) -> Network:
    return Network.load(SparkFiles.get(name))


def score(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; DECISION or more is toxic.

    A null text counts as empty; empty texts get the score of no words. Rows with equal ids are all scored, a null
    id stays, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.record_batch([part.column(0), pa.array(_network(model).scores(*text_bytes(part.column(1))), pa.float64())], ["doc_id", "score"])

    bounded_arrow(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """The rows whose whole text scores below DECISION, all columns as they are. A null text is clean if empty texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                scores = _network(model).scores(*text_bytes(part.column(part.schema.get_field_index(text_col))))
                yield part.filter(pa.array(scores < DECISION))

    bounded_arrow(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
