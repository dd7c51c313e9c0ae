"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about ``shard_bytes``.  Its words are numbered
by the vocabulary of the benchmark; words outside it can be in no occurrence and
become separators, and runs too short for any phrase are left out.  A suffix
array over the rest gives the Burrows-Wheeler transform, kept as a wavelet
matrix with popcount ranks.  All phrases are searched backward at once; the rows
of each non-empty interval are located by walking to a sampled suffix position.
The spans found are merged per document.

Each document is judged on its whole text within one task and nothing is
shuffled, so hot sources, copies and passages cost no more than their bytes.
Phrases are shipped in blocks of at most ``PHRASE_BLOCK``; a larger benchmark
makes more passes over the rows, never a larger broadcast.

Words are compared by 64-bit hashes; a false match needs ten colliding words in
a row.  Null or empty texts have no words and no hits; items without id, words
or text are not searched; repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_slices, list_column, quoted

WINDOW = 10
SHARD_BYTES = 4 << 20
PHRASE_BLOCK = 200_000
SAMPLE_EVERY = 16


def suffix_array(text: np.ndarray, separators: int) -> np.ndarray:
    """Sort the suffixes of ``text``, which ends with a separator.

    Symbols below ``separators`` are separators, each of which occurs once, so
    that no comparison runs past one.  Prefix doubling; after the first round
    only suffixes that still tie are sorted again.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    padded = np.concatenate([text, np.zeros(packed, text.dtype)])
    for k in range(packed):
        symbol = padded[k : k + n].astype(np.int64)
        key = (key << bits) | np.where(ended, 0, symbol)
        ended |= symbol < separators
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    place = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = place
    last = np.concatenate([fresh[1:], [True]])
    slots = np.flatnonzero(~(fresh & last))
    step = packed
    while len(slots):
        active = order[slots]
        second = rank[np.minimum(active + step, n - 1)]
        key = rank[active] * n + second
        by = np.argsort(key, kind="stable")
        order[slots] = active[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        last = np.concatenate([fresh[1:], [True]])
        slots = slots[~(fresh & last)]
        step *= 2
    return order


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix over small integers."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = []
        for shift in reversed(range(max(1, (symbols - 1).bit_length()))):
            one = ((values >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(one), len(values) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])
        self.first = np.zeros(symbols, np.int64)
        self.first = self.down(np.arange(symbols), np.zeros(symbols, np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits[at], bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


class FMIndex:
    """An FM-index of runs of symbols 1..symbols-1; 0 ends each run."""

    def __init__(self, text: np.ndarray, symbols: int, sample_every: int = SAMPLE_EVERY):
        ends = text == 0
        n_ends = int(ends.sum())
        unique = np.where(ends, np.cumsum(ends) - 1, text + (n_ends - 1))
        suffixes = suffix_array(unique, n_ends)
        self.n = len(text)
        self.wavelet = Wavelet(text[suffixes - 1], symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        run_start = np.concatenate([[True], ends[:-1]])
        sampled = (suffixes % sample_every == 0) | run_start[suffixes]
        self.marks, self.samples = Bits(sampled), suffixes[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each phrase; phrases end at the right edge of the matrix."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1]):
            live = live[(lengths[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - k]
            low[live] = self.below[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            known = self.marks[at]
            done = live[known]
            out[done] = self.samples[self.marks.rank(at[known])] + steps[done]
            live, at = live[~known], at[~known]
            steps[live] += 1
            symbol, rank = self.wavelet.access(at)
            at = self.below[symbol] + rank
        return out


class Phrases:
    """Distinct phrases over the benchmark's vocabulary, with the items of each."""

    def __init__(self, items: list, phrases: list[bytes]):
        flat = np.frombuffer(b"".join(phrases), np.uint64)
        self.vocabulary = np.unique(flat)
        self.item_ids = sorted(set(items), key=str)
        number = {x: i for i, x in enumerate(self.item_ids)}
        texts: dict[bytes, int] = {}
        which = np.array([texts.setdefault(p, len(texts)) for p in phrases], np.int64)
        of = np.array([number[x] for x in items], np.int64)
        pairs = np.unique(np.stack([which, of]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
        self.items = pairs[1]
        self.item_range = np.searchsorted(pairs[0], np.arange(len(texts) + 1))
        self.lengths = np.array([len(p) // 8 for p in texts], np.int64)
        self.longest, self.shortest = int(self.lengths.max(initial=1)), int(self.lengths.min(initial=1))
        self.matrix = np.zeros((len(texts), self.longest), np.int64)
        for row, p in enumerate(texts):
            w = np.frombuffer(p, np.uint64)
            self.matrix[row, self.longest - len(w) :] = np.searchsorted(self.vocabulary, w) + 1

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def occurrences(hashes: np.ndarray, ranges: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word position, phrase) of every occurrence in a shard, by its FM-index."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(hashes):
        return none, none
    symbol = phrases.numbered(hashes)
    breaks = np.zeros(len(symbol) + 1, bool)
    breaks[ranges] = True
    inside = symbol > 0
    starts = np.flatnonzero(inside & (breaks[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (breaks[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    keep = ends - starts >= phrases.shortest
    starts, sizes = starts[keep], (ends - starts)[keep]
    if not len(starts):
        return none, none
    at = K.ranges_of(starts, sizes + 1)  # one place more: the separator
    text = symbol[np.minimum(at, len(symbol) - 1)]
    text[np.cumsum(sizes + 1) - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.matrix, phrases.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    places = index.locate(K.ranges_of(low[found], counts))
    return at[places], np.repeat(found, counts)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in any span."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def item_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase): each window of each item as packed word hashes."""

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        starts, ends, ranges = K.words(data, off, K.ALNUM)
        hashes = K.word_hashes(data, starts, ends, lower=True)
        ids, out = [], []
        for item, a, b in zip(rows.column("item_id").to_pylist(), ranges[:-1], ranges[1:], strict=True):
            for at in range(a, max(a + (b > a), b - window + 1)):
                ids.append(item)
                out.append(hashes[at : min(at + window, b)].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, rows.schema.field("item_id").type), pa.array(out, pa.binary())], names=["item_id", "phrase"])

    source = items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    kind = source.schema["item_id"].dataType.simpleString()
    return by_slices(source, "text", work, f"item_id {kind}, phrase binary").distinct()


def phrase_blocks(items: DataFrame, window: int, block: int):
    """The phrases in blocks of bounded size."""
    rows = item_phrases(items, window)
    blocks = max(1, -(-rows.count() // block))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        got = part.toArrow()
        yield Phrases(got["item_id"].to_pylist(), got["phrase"].to_pylist())


def find_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block: int = PHRASE_BLOCK) -> DataFrame:
    """Every row with n_words, ``spans`` of hit words, their byte spans, and the items found.

    ``spans`` holds word numbers, end exclusive, merged; ``byte_spans`` the bytes
    from the first to the last hit word of each; ``items`` the item ids as strings.
    Columns of ``docs`` by these names are replaced.
    """
    span = "array<struct<start:int,end:int>>"
    nothing = F.array().cast(span)
    out = docs.withColumns({"text": F.col("text").cast("string"), "n_words": F.lit(0).cast("bigint"), "spans": nothing, "byte_spans": nothing, "items": F.array().cast("array<string>")})
    schema = out.schema
    for phrases in phrase_blocks(items, window, block):

        def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, phrases: Phrases = phrases) -> pa.RecordBatch:
            starts, ends, ranges = K.words(data, off, K.ALNUM)
            at, phrase = occurrences(K.word_hashes(data, starts, ends, lower=True), ranges, phrases)
            lengths = phrases.lengths[phrase]
            earlier = rows.column("spans")
            if len(earlier.flatten()):
                owner = np.repeat(np.arange(len(rows)), np.diff(earlier.offsets.to_numpy()))
                old = earlier.flatten()
                begin, end = (old.field(i).to_numpy().astype(np.int64) + ranges[owner] for i in (0, 1))
                at, lengths = np.concatenate([at, begin]), np.concatenate([lengths, end - begin])
            hit = covered(len(starts), at, lengths)
            edge = np.zeros(len(hit) + 1, bool)
            edge[ranges] = True
            first = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
            last = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
            spans = np.searchsorted(first, ranges)
            doc = np.repeat(np.arange(len(rows)), np.diff(spans))

            def pairs(a: np.ndarray, b: np.ndarray, base: np.ndarray) -> pa.Array:
                return list_column(pa.StructArray.from_arrays([pa.array((x - base).astype(np.int32)) for x in (a, b)], ["start", "end"]), spans)

            at, phrase = at[: len(phrase)], phrase
            counts = phrases.item_range[phrase + 1] - phrases.item_range[phrase]
            item = phrases.items[K.ranges_of(phrases.item_range[phrase], counts)]
            of = np.repeat(np.searchsorted(ranges, at, "right") - 1, counts)
            both = np.unique(of * (len(phrases.item_ids) + 1) + item)
            found: list[list[str]] = [x for x in rows.column("items").to_pylist()]
            for x in both.tolist():
                found[x // (len(phrases.item_ids) + 1)].append(str(phrases.item_ids[x % (len(phrases.item_ids) + 1)]))
            new = {
                "n_words": pa.array(np.diff(ranges)),
                "spans": pairs(first, last + 1, ranges[doc]),
                "byte_spans": pairs(starts[first], ends[last], off[doc]),
                "items": pa.array([sorted(set(x)) for x in found], pa.list_(pa.string())),
            }
            return pa.RecordBatch.from_arrays([new.get(name, rows.column(i)) for i, name in enumerate(rows.schema.names)], names=rows.schema.names)

        out = by_slices(out, "text", work, schema, shard_bytes)
    return out


def hit_words(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with the hit spans cut out of the texts; untouched texts stay as they are.

    ``n_chars``, if present, follows the text.
    """
    text_type = docs.schema["text"].dataType
    # Columns besides the text travel in one, so that none of them can clash with the result's.
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    found = find_spans(packed, items, **options)

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        texts, spans = rows.column("text"), rows.column("byte_spans")
        out: list[str | None] = []
        for row, cuts in enumerate(spans.to_pylist()):
            text = texts[row].as_py()
            if cuts:
                raw, at, kept = text.encode(), 0, []
                for cut in cuts:
                    kept.append(raw[at : cut["start"]])
                    at = cut["end"]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        cut = pa.array([len(x) > 0 for x in spans], pa.bool_())
        return pa.RecordBatch.from_arrays([rows.column("row"), pa.array(out, pa.string()), cut], names=["row", "text", "cut"])

    done = by_slices(found, "text", work, packed.schema.add("cut", "boolean"))
    new = {"text": F.col("text").cast(text_type)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.char_length("text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""
    found = find_spans(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract word by word, for tests."""
    import re

    def split(text: str | None) -> list[str]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    phrases: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if (p := tuple(w[i : i + size])) in phrases:
                    hit.update(range(i, i + size))
                    found |= phrases[p]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
