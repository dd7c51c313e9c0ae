"""Quality classifier by co-training of a text view and a metadata view.

The text view sees hashed facts of a text: its words, their first four and five
bytes, the last three bytes of each token, and coarse statistics (repetition,
capitals, symbols, word length).  The metadata view sees source, language and
length class.  Each view is a ridge logistic regression over the facts that
speak for the class with a log-likelihood gain of ``EVIDENCE`` or more.
Documents that agree in all of ``SKETCH`` min-hashes of their words, as copies do,
share the weight of one document, so that a large group of copies can't make its
words evidence.

Over ``ROUNDS`` rounds each view scores all unlabelled rows, and of those that it is
confident of, ``exchange`` documents of either class, drawn by hashed id, train the
other view as well.  Scores of both views are calibrated on labelled rows held back
from training, and a logistic combination of the calibrated views scores all
documents.  This is done once for low quality and once for toxicity; a document is
kept if neither probability reaches ``threshold``.

Models are fitted on the driver, a block of documents at a time, from at most
``labelled`` labelled rows, those with the least hashed ids, and ``8 * exchange``
pseudo-labelled ones a round; both bounds are parameters.  A round is one pass over
all rows, whole texts, without a shuffle of texts, as is the scoring.

Null texts count as empty; null metadata, or a missing column of it, is a value of
its own.  Labelled rows with a null or without a document are left out; of
contradicting labels the worse counts.  Of rows with the same doc_id the least text
stands for the document when models are fitted; all are scored, one by one.  Where
the labels lack a class, nothing is rejected for it; an empty table gives an empty
one.  Other columns, of any name, are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Written, by_slices, quoted

BITS = 20
LABELLED, EXCHANGE, ROUNDS = 8000, 500, 3
#: Documents that the driver works on at a time, and bytes of text that a task does.
BLOCK, SLICE = 512, 1 << 19
EVIDENCE, FACTS, STEPS, RIDGE = 11.0, 3000, 200, 0.3
CONFIDENT, THRESHOLD = 0.99, 0.5
SKETCH = 8
FAST_STEP = 0x9E3779B97F4A7C15


def _slot(values: np.ndarray, salt: int) -> np.ndarray:
    return (K.mix(values ^ np.uint64((salt * FAST_STEP) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BITS)).astype(np.int32)


def text_facts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fact, text) of each fact of each text, repeats included."""
    starts, ends, ranges = K.words(data, off)
    doc = K.owners(ranges)
    facts, of = [], []
    tails = K.word_hashes(data, np.maximum(starts, ends - 3), ends)
    facts.append(_slot(tails, 1))
    of.append(doc)
    tokens = K.word_hashes(data, starts, ends)
    a, b, inner = K.words(data, off, K.ALNUM)
    inner_doc = K.owners(inner)
    for salt, stop in ((2, b), (3, np.minimum(a + 4, b)), (4, np.minimum(a + 5, b))):
        facts.append(_slot(K.word_hashes(data, a, stop, lower=True), salt))
        of.append(inner_doc)
    n = len(off) - 1
    count = np.maximum(np.diff(ranges), 1)
    size = np.maximum(np.diff(off), 1)
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    same = np.zeros(len(tokens), bool)
    same[1:] = (tokens[1:] == tokens[:-1]) & (doc[1:] == doc[:-1])
    upper = per_text((data >= 0x41) & (data <= 0x5A)) / size
    symbols = per_text(~K.ALNUM[data] & ~K.SPACES[data]) / size
    repeats = np.bincount(doc, weights=same, minlength=n) / count
    kinds = np.unique(doc.astype(np.uint64) << np.uint64(40) | tokens >> np.uint64(24))
    distinct = np.bincount((kinds >> np.uint64(40)).astype(np.int64), minlength=n) / count
    for salt, stat in ((10, upper), (11, symbols), (12, repeats), (13, distinct), (14, np.diff(ranges) * 4 / size)):
        step = (np.clip(stat, 0, 1) * 20).astype(np.int64)
        for up, base, counts in ((0, np.zeros(n, np.int64), step + 1), (100, step, 21 - step)):  # at least, and at most, each step
            facts.append(_slot(K.ranges_of(base, counts).astype(np.uint64), salt + up))
            of.append(np.repeat(np.arange(n), counts))
    return np.concatenate(facts), np.concatenate(of)


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text one hash of ``SKETCH`` min-hashes of its lower-cased words, or tokens where it has no words; equal for copies and most near copies."""
    out = np.zeros(len(off) - 1, np.uint64)
    for kind in (K.words(data, off), K.words(data, off, K.ALNUM)):  # the second overrides
        starts, ends, ranges = kind
        has = np.flatnonzero(np.diff(ranges))
        hashes = K.word_hashes(data, starts, ends, lower=True)
        made = np.zeros(len(has), np.uint64)
        for salt in range(SKETCH if len(has) else 0):
            made = K.mix(made ^ np.minimum.reduceat(K.mix(hashes ^ np.uint64(((salt + 1) * FAST_STEP) & 0xFFFFFFFFFFFFFFFF)), ranges[has]))
        out[has] = made
    return out


def meta_facts(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = len(rows)
    out = []
    columns = {c: [str(x) for x in rows.column(c).to_pylist()] for c in ("source", "lang")}
    chars = [str(x.bit_length()) if x is not None else "None" for x in rows.column("n_chars").to_pylist()]
    for salt, values in ((20, columns["source"]), (21, columns["lang"]), (22, chars), (23, [f"{a}\0{b}" for a, b in zip(columns["lang"], chars, strict=True)])):
        raw = [v.encode() for v in values]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        out.append(_slot(K.word_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]), salt))
    return np.concatenate(out), np.tile(np.arange(n), len(out))


def _distinct(facts: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(of.astype(np.int64) << BITS | facts)
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(n + 1))


@dataclass
class Facts:
    """The distinct facts of each document, as bytes of 32-bit integers; never joined but for a block of documents."""

    of: list[memoryview]

    @property
    def n(self) -> int:
        return len(self.of)

    def blocks(self):
        """(first, end, facts, the document of each fact from first on)."""
        for at in range(0, self.n, BLOCK):
            part = self.of[at : at + BLOCK]
            yield at, at + len(part), np.frombuffer(b"".join(part), np.int32), np.repeat(np.arange(len(part), dtype=np.int32), [len(x) // 4 for x in part])


@dataclass
class View:
    """Weights of the facts and the calibration of their sum."""

    chosen: np.ndarray
    values: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    @property
    def weights(self) -> np.ndarray:
        """The weights of all facts; made once in each process and never sent."""
        if "_table" not in self.__dict__:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.chosen] = self.values
        return self._table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def raw(self, facts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        hit = np.flatnonzero(self.weights[facts])
        kept, ranges = _distinct(facts[hit], of[hit], n)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[kept], dtype=np.float64)])
        return self.bias + sums[ranges[1:]] - sums[ranges[:-1]]

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(self.scale[0] * raw + self.scale[1], -30, 30)

    def logit(self, facts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return self.calibrated(self.raw(facts, of, n))

    def raw_of(self, rows: Facts) -> np.ndarray:
        out = np.empty(rows.n)
        for at, to, facts, own in rows.blocks():
            out[at:to] = self.bias + np.bincount(own, weights=self.weights[facts], minlength=to - at)
        return out


@dataclass
class Judge:
    """Both views of one target and their combination."""

    text: View
    meta: View
    mix: np.ndarray

    def logits(self, text: tuple, meta: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(*text, n), self.meta.logit(*meta, n)
        return a, b, np.clip(self.mix[0] + self.mix[1] * a + self.mix[2] * b, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression with an intercept by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.01, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def _evidence(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Twice the log-likelihood gained by giving each class its own rate of a fact."""

    def part(count: np.ndarray, total: float, rate: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            yes = np.where(count > 0, count * np.log(count / total / rate), 0)
            no = np.where(total - count > 0, (total - count) * np.log((1 - count / total) / (1 - rate)), 0)
        return yes + no

    rate = np.clip((pos + neg) / (n_pos + n_neg), 1e-12, 1 - 1e-12)
    return 2 * (part(pos, n_pos, rate) + part(neg, n_neg, rate))


def _train(facts: Facts, y: np.ndarray, use: np.ndarray, share: np.ndarray) -> View:
    """A view from the documents in ``use`` with labels y; ``share`` is the weight of each document."""
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for at, to, values, own in facts.blocks():
        for sums, value in ((pos, 1), (neg, 0)):
            weight = np.where(use[at:to] & (y[at:to] == value), share[at:to], 0)[own]
            some = np.flatnonzero(weight)
            if len(some):
                sums += np.bincount(values[some], weights=weight[some], minlength=1 << BITS)
    n_pos, n_neg = float(share[use & (y == 1)].sum()), float(share[use & (y == 0)].sum())
    able = np.flatnonzero(pos * n_neg > 2 * neg * n_pos)  # facts that speak for the class only
    gain = _evidence(pos[able], neg[able], n_pos, n_neg)
    best = np.argsort(-gain, kind="stable")[:FACTS]
    chosen = able[best[gain[best] >= EVIDENCE]]
    del pos, neg
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows = np.flatnonzero(use)
    number = np.cumsum(use, dtype=np.int32) - 1
    columns, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at, to, values, own in facts.blocks():
        found = place[values]
        hit = np.flatnonzero((found >= 0) & use[at:to][own])
        columns.append(found[hit])
        owners.append(number[at:to][own[hit]])
    column, row = np.concatenate(columns), np.concatenate(owners)
    target, weight = (y[rows] == 1).astype(float), share[rows]
    start = float(np.log((n_pos + 0.5) / (n_neg + 0.5)))
    w, bias = np.zeros(len(chosen)), start
    ahead_w, ahead_b, pace = w, bias, 1.0
    reach = np.bincount(column, weights=weight[row], minlength=len(chosen))
    for _ in range(STEPS if len(chosen) else 0):  # accelerated gradient steps, scaled by each fact's weight
        miss = (_sigmoid(ahead_b + np.bincount(row, weights=ahead_w[column], minlength=len(rows))) - target) * weight
        held_back = np.bincount(column, weights=miss[row], minlength=len(chosen)) + RIDGE * ahead_w
        new_w = ahead_w - held_back / (0.5 * reach + RIDGE)
        new_b = ahead_b - miss.sum() / (0.5 * weight.sum())
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead_w, ahead_b = new_w + (pace - 1) / faster * (new_w - w), new_b + (pace - 1) / faster * (new_b - bias)
        w, bias, pace = new_w, new_b, faster
    return View(chosen, w.astype(np.float32), float(bias))


@dataclass
class Model:
    low: Judge | None
    toxic: Judge | None


TARGETS, VIEWS = ("low", "toxic"), ("text", "meta")


@dataclass
class Sample:
    """Documents that models are fitted on: facts of both views, labels (-1 where unknown) and what the views told of them."""

    ids: list[str]
    sketch: np.ndarray
    label: dict[str, np.ndarray]
    told: np.ndarray
    facts: dict[str, Facts]

    def __add__(self, other: Sample) -> Sample:
        label = {t: np.concatenate([self.label[t], other.label[t]]) for t in TARGETS}
        return Sample(self.ids + other.ids, np.concatenate([self.sketch, other.sketch]), label, np.concatenate([self.told, other.told]), {v: Facts(self.facts[v].of + other.facts[v].of) for v in VIEWS})


def _columns(docs: DataFrame) -> list:
    """The columns that are read, as the types that are expected; a missing one is null."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]


def _gather(docs: DataFrame, marks: DataFrame) -> Sample:
    """The documents of the ids in ``marks(doc_id, quality, toxic, told)``, of which there are few, in order of id."""
    names = ["text", "source", "lang", "n_chars"]
    rows = docs.select("doc_id", *_columns(docs)).join(F.broadcast(marks), "doc_id").groupBy("doc_id", "quality", "toxic", "told").agg(F.min(F.struct(*names)).alias("one")).select("doc_id", "quality", "toxic", "told", "one.*")

    def packed(facts: np.ndarray, ranges: np.ndarray) -> pa.Array:
        return K.binary_column([facts[a:b].tobytes() for a, b in zip(ranges[:-1], ranges[1:], strict=True)])

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        lists = [packed(*_distinct(*facts, len(rows))) for facts in (text_facts(data, off), meta_facts(rows))]
        return pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.string()), *[rows.column(c).cast(pa.int64()) for c in ("quality", "toxic", "told")], pa.array(sketches(data, off).view(np.int64)), *lists], names=["doc_id", "quality", "toxic", "told", "sketch", *VIEWS])

    made = by_slices(rows, "text", work, "doc_id string, quality bigint, toxic bigint, told bigint, sketch bigint, text binary, meta binary", SLICE)
    # A partition at a time, into one buffer for each view, which is given back whole.
    buffers, got = [bytearray() for _ in VIEWS], []
    for r in made.toLocalIterator():
        at = [len(x) for x in buffers]
        for i, buffer in enumerate(buffers):
            buffer += r[5 + i]
        got.append((*tuple(r)[:5], [(a, len(x)) for a, x in zip(at, buffers, strict=True)]))
    got.sort(key=lambda r: r[0])
    number = lambda i, other: np.array([other if r[i] is None else r[i] for r in got], np.int64)
    label = {"low": 1 - number(1, 2), "toxic": number(2, -1)}
    whole = [memoryview(x) for x in buffers]
    return Sample([r[0] for r in got], number(4, 0), label, number(3, 0), {v: Facts([whole[i][slice(*r[5][i])] for r in got]) for i, v in enumerate(VIEWS)})


def _bit(target: str, view: str, value: int) -> int:
    return 1 << (4 * TARGETS.index(target) + 2 * VIEWS.index(view) + value)


def confident(docs: DataFrame, labels: DataFrame, views: dict[str, dict[str, View]], exchange: int, salt: int) -> DataFrame:
    """(doc_id, told): unlabelled documents of which a view is sure, ``exchange`` for each target, view and class; told has their bits."""

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        facts, n = {"text": text_facts(data, off), "meta": meta_facts(rows)}, len(rows)
        told = np.zeros(n, np.int64)
        for target, both in views.items():
            for name, view in both.items():
                p = _sigmoid(view.logit(*facts[name], n))
                told |= np.where(p >= CONFIDENT, _bit(target, name, 1), np.where(1 - p >= CONFIDENT, _bit(target, name, 0), 0))
        sure = np.flatnonzero(told)
        return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(sure)), pa.array(told[sure])], names=["doc_id", "told"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sure = by_slices(docs.where("doc_id IS NOT NULL").select("doc_id", *_columns(docs)), "text", work, f"doc_id {kind}, told bigint", SLICE)
    # Rows of one document that differ tell only what they agree in.
    sure = sure.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.bit_and("told").alias("told"))
    sure = Written(docs.sparkSession).put(sure, "sure")
    out = None
    for bit in (_bit(t, v, y) for t in views for v in VIEWS for y in (0, 1)):
        part = sure.where(F.col("told").bitwiseAND(F.lit(bit)) != 0).orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(exchange).select("doc_id", F.lit(bit).cast("bigint").alias("told"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id").agg(F.bit_or("told").alias("told"))


def _fold(ids: list[str]) -> np.ndarray:
    """Which documents are held back for calibration: a quarter, by hashed id."""
    raw = [x.encode() for x in ids]
    at = np.concatenate([[0], np.cumsum([len(i) for i in raw])]).astype(np.int64)
    return K.mix(K.word_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])) % np.uint64(4) == 0


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, exchange: int = EXCHANGE, rounds: int = ROUNDS) -> Model:
    """Co-train on a bounded sample of labelled rows and on what the views tell of all others; ids sent to all executors are at most ``labelled`` or ``8 * exchange``."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    few = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    sample = _gather(docs, few.withColumn("told", F.lit(0).cast("bigint")))
    known, held = np.ones(len(sample.ids), bool), _fold(sample.ids) if sample.ids else np.zeros(0, bool)
    targets = [t for t in TARGETS if all((sample.label[t][m] == v).any() for m in (known & ~held, held) for v in (0, 1))]
    views: dict[str, dict[str, View]] = {t: {} for t in targets}
    raw: dict[str, dict[str, np.ndarray]] = {t: {} for t in targets}
    for turn in range(rounds + 1 if targets else 0):
        n = len(sample.ids)
        _, group, copies = np.unique(sample.sketch, return_inverse=True, return_counts=True)
        share = 1.0 / copies[group]
        first = np.arange(n) < len(known)
        back = np.zeros(n, bool)
        back[: len(held)] = held
        for t in targets:
            for v, other in (("text", "meta"), ("meta", "text")):
                y = np.where(first, sample.label[t], -1)
                for value in (0, 1):
                    y[~first & (sample.told & _bit(t, other, value) != 0)] = value
                view = _train(sample.facts[v], y, (y >= 0) & ~back, share)
                raw[t][v] = view.raw_of(sample.facts[v])[: len(held)][held]
                w = _logistic(raw[t][v][:, None] / 10, sample.label[t][: len(held)][held])
                views[t][v] = View(view.chosen, view.values, view.bias, (max(w[1], 0.0) / 10, w[0]))
        if turn < rounds:
            marks = confident(docs, told, views, exchange, turn)
            nothing = F.lit(None).cast("bigint")
            sample += _gather(docs, marks.select("doc_id", nothing.alias("quality"), nothing.alias("toxic"), "told"))
    judges = {}
    for t in targets:
        logits = np.column_stack([views[t][v].calibrated(raw[t][v]) for v in VIEWS])
        judges[t] = Judge(views[t]["text"], views[t]["meta"], _logistic(logits, sample.label[t][: len(held)][held], ridge=0.1))
    return Model(judges.get("low"), judges.get("toxic"))


def _scores(model: Model, rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    text, meta, n = text_facts(data, off), meta_facts(rows), len(rows)
    out = {}
    for name, judge in (("low", model.low), ("toxic", model.toxic)):
        parts = judge.logits(text, meta, n) if judge else (np.full(n, -30.0),) * 3
        for view, logit in zip(("_text", "_meta", ""), parts, strict=True):
            out[f"p_{name}{view}"] = np.round(_sigmoid(logit), 6)
    return out


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row doc_id, the calibrated probabilities of both views and of their combination, and kept."""
    names = [f"p_{t}{v}" for t in ("low", "toxic") for v in ("_text", "_meta", "")]

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        p = _scores(model, rows, data, off)
        kept = (p["p_low"] < threshold) & (p["p_toxic"] < threshold)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(p[c]) for c in names], pa.array(kept)], names=["doc_id", *names, "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slices(docs.select("doc_id", *_columns(docs)), "text", work, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in names) + ", kept boolean", SLICE)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``score`` keeps, all their columns as they are."""
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("row"), *_columns(docs))

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        p = _scores(model, rows, data, off)
        return rows.select(["row", "text"]).filter(pa.array((p["p_low"] < threshold) & (p["p_toxic"] < threshold)))

    kept = by_slices(packed, "text", work, packed.select("row", "text").schema, SLICE)
    return kept.select(*[(F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
