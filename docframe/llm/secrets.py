"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The base kinds are patterns with leftmost non-overlapping matches; matches that
are too short are dropped after matching, so that they still use up their text.
The ``markov`` kind adds runs of ``TOKEN`` characters of 16 or more whose
log-likelihood per character is higher under a first-order model of random
strings than under one of ordinary identifiers, by at least ``margin``.  Both
models are trained from labelled samples (token, 0 or 1) with add-one smoothing.
Runs that overlap a base span are not reported again.

Everything happens within a row: nothing is shuffled, and a document is scanned
whole in one task.  Runs are found with vectorised byte classes; the assignment
pattern runs only on texts that RE2 finds to hold a keyword with a separator.

Null and empty texts have no spans.  Spans are in code points, end exclusive.
Repeated rows are scanned one by one; only doc_id and text are read, so that other
columns may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_slices, list_column

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINT = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH, TOKEN_LENGTH = 6, 20, 24, 16
KINDS = ("assign", "access", "hex", "markov")
MARGIN = 0.3
ORDER = 1

_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *map(ord, "+/_=-")]] = True
ALPHABET = [c for c in range(128) if _TOKEN[c]]
_NUMBER = np.zeros(256, np.int64)
_NUMBER[ALPHABET] = np.arange(1, len(ALPHABET) + 1)  # 0 stands for the start


class MarkovPair:
    """Log-likelihood ratios of each character after the ``order`` before it."""

    def __init__(self, samples: list[tuple[str, int]], order: int = ORDER):
        size = len(ALPHABET) + 1
        self.size, self.order = size, order
        models = []
        for label in (1, 0):
            counts = np.ones((size**order, size))
            data, ranges = _pack([t for t, y in samples if y == label])
            context, char = self._steps(data, ranges)
            np.add.at(counts, (context, char), 1)
            models.append(np.log(counts[:, 1:] / counts[:, 1:].sum(axis=1, keepdims=True)))
        self.ratio = np.concatenate([np.zeros((size**order, 1)), models[0] - models[1]], axis=1).astype(np.float32)

    def _steps(self, data: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        char = _NUMBER[data]
        since = np.arange(len(char)) - np.repeat(ranges[:-1], np.diff(ranges))
        context = np.zeros(len(char), np.int64)
        for back in range(1, self.order + 1):
            before = np.zeros(len(char), np.int64)
            before[back:] = char[:-back]
            context += np.where(since >= back, before, 0) * self.size ** (back - 1)
        return context, char

    def scores(self, data: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Mean log-likelihood ratio a character of each run."""
        context, char = self._steps(data, ranges)
        total = np.concatenate([[0.0], np.cumsum(self.ratio[context, char], dtype=np.float64)])
        return np.round((total[ranges[1:]] - total[ranges[:-1]]) / np.maximum(np.diff(ranges), 1), 9)


def _pack(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in tokens]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


_WORDS = """account active address after agent array async average backend balance base batch before begin block body
border buffer build bundle button cache callback channel check child class clean client close cluster code color column
command commit config connect constant container content context control convert copy count create current cursor data
date debug default delete depth detail device display document domain double download driver element email enable end
engine error event execute export factory feature field file filter final find flag folder format frame function
generate global group handle hash header height hidden history host image import index info init input insert instance
integer interface internal interval invoke item iterator join key label language last layer layout length level library
limit line link list load local location lock logger lookup loop manager mapping master matrix member memory message
method metric model module monitor mount name native network node notify number object offset open option order origin
output owner package page panel parameter parent parse partition path pattern payload pending percent period phase
player point pointer policy pool port position prefix price primary print process profile project property protocol
provider public publish query queue random range read receive record reference region register release remote remove
render replace report request require reset resolve resource response result return role root route row runtime sample
scale schema scope score screen script search section select sender sequence server service session set setting shape
share signal size socket source split stack start state static status step storage store stream string structure style
submit success summary support switch symbol sync system table target task template temp test text thread time title
total trace track transaction transform trigger type unique unit update upload user util valid value vector version view
virtual visible wait warning width window worker wrapper write""".split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` random strings (1) and ``n`` identifiers, numbers and long words (0) to train from."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sets = [letters.upper() + letters + "0123456789+/", letters + "0123456789", letters.upper() + "0123456789", "0123456789abcdef", letters.upper() + letters + "0123456789-_"]
    rows = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertyuiopasdfghjklzxcvbnm", "1234567890", letters, letters.upper(), "QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM"]
    syllables = sorted({w[i : i + 3] for w in _WORDS for i in range(len(w) - 2)})
    out = []
    for i in range(n):
        out.append(("".join(r.choice(sets[i % len(sets)]) for _ in range(r.randint(16, 48))), 1))
        style = i % 7
        parts = [r.choice(_WORDS) for _ in range(r.randint(2, 5))]
        if style == 0:
            text = "_".join(parts)
        elif style == 1:
            text = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            text = "-".join(parts) + r.choice(["", f"-{r.randint(1, 99)}"])
        elif style == 3:
            text = "_".join(parts).upper()
        elif style == 4:
            text = "/".join(parts)
        elif style == 5:
            text = "".join(r.choice("0123456789") for _ in range(r.randint(16, 20)))  # times, counters, order numbers
        elif i % 70 == 6:
            text = r.choice(rows)[r.randint(0, 3) :] + r.choice(rows)  # rows of keys, the alphabet
        else:
            text = "".join(r.choice(syllables) for _ in range(r.randint(5, 9)))
        out.append((text, 0))
    return out


def _runs(inside: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes of a class within texts, of ``least`` bytes and more."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[off] = True
    begin = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = end - begin >= least
    return begin[long], end[long]


def scan_spans(docs: DataFrame, samples: list[tuple[str, int]] | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, spans) of each row; spans are (kind, start, end, score) by start, then kind."""
    model = MarkovPair(samples if samples is not None else labelled_samples())

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int, int, int, float]] = []  # doc, start, kind, end, score
        hinted = np.flatnonzero(pc.match_substring_regex(pc.fill_null(rows.column("text"), ""), ASSIGN_HINT).to_numpy(zero_copy_only=False))
        for doc in hinted.tolist():
            base = int(off[doc])
            for m in ASSIGN.finditer(data[base : off[doc + 1]].tobytes()):
                if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                    found.append((doc, base + m.start(), 0, base + m.end(), 0.0))
        for m in ACCESS.finditer(data.tobytes()):
            at, end = m.span()
            while end > at:  # a match runs on into the next texts only in the joined bytes
                doc = int(np.searchsorted(off, at, "right")) - 1
                stop = min(end, int(off[doc + 1]))
                again = data[at:stop].tobytes().find(b"AKIA")
                if again >= 0 and stop - at - again >= ACCESS_LENGTH:
                    found.append((doc, at + again, 1, stop, 0.0))
                at = stop
        begin, end = _runs(_HEX[data], off, HEX_LENGTH)
        doc = np.searchsorted(off, begin, "right") - 1
        found += [(d, b, 2, e, 0.0) for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True)]
        begin, end = _runs(_TOKEN[data], off, TOKEN_LENGTH)
        if len(begin):
            ranges = np.concatenate([[0], np.cumsum(end - begin)])
            score = model.scores(data[K.ranges_of(begin, end - begin)], ranges)
            taken = np.zeros(len(data) + 1, np.int64)
            for _, b, _, e, _ in found:
                taken[b] += 1
                taken[e] -= 1
            base_bytes = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
            good = (score >= margin) & (base_bytes[end] == base_bytes[begin])
            doc = np.searchsorted(off, begin[good], "right") - 1
            found += [(d, b, 3, e, s) for d, b, e, s in zip(doc.tolist(), begin[good].tolist(), end[good].tolist(), score[good].tolist(), strict=True)]
        found.sort()
        starts_char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        d = np.array([f[0] for f in found], np.int64)
        place = [np.array([f[i] for f in found], np.int64) for i in (1, 3)]
        place = [(starts_char[p] - starts_char[off[d]]).astype(np.int32) if len(d) else np.zeros(0, np.int32) for p in place]
        spans = pa.StructArray.from_arrays([pa.array([KINDS[f[2]] for f in found], pa.string()), pa.array(place[0]), pa.array(place[1]), pa.array([f[4] for f in found], pa.float64())], ["kind", "start", "end", "score"])
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), list_column(spans, np.searchsorted(d, np.arange(len(rows) + 1)))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", work, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """Per row the counts of the base kinds, the digest of the base spans, and all spans."""
    found = scan_spans(docs)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
        count("markov").alias("n_markov"),
    )


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The base part of the contract on code points, for tests."""
    patterns = (re.compile(ASSIGN.pattern.decode()), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))
    out = []
    for doc, text in docs:
        spans = []
        for kind, p in enumerate(patterns):
            for m in p.finditer(text or ""):
                size = len(m[2]) if kind == 0 else len(m[0])
                if size >= (ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH)[kind]:
                    spans.append((m.start(), kind, m.end()))
        spans.sort()
        names = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        out.append((doc, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(names.encode()).hexdigest()))
    return out
