"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Documents are taken in chunks.  Each chunk sends its distinct n-grams of all
orders with their counts to the count tables' hash partitions, packed: one row
for a chunk and partition, of sorted hashes as differences in byte planes.  A
partition adds up the counts of all chunks and sends each chunk the totals of
what it asked for.  There they meet the chunk's documents again, whose n-grams
take their counts by rank, and the scores are summed per document.

A word scores c(context word) / c(context) for the longest n-gram counted
``MIN_COUNT`` times or more, times ``ALPHA`` for each order backed off; words
that are rarer in themselves score their count over all words.  Counts are over
all documents; with the least count at 2, an n-gram that only one place holds
says nothing for that place.

A frequent n-gram makes one entry a chunk, not one an occurrence, and chunks
and partitions are bounded; their number grows with the input, and rows of
empty partitions are not sent, so there are never more rows than n-grams.
Words are lower-cased (A-Z) and compared by 64-bit hashes.

Null and empty texts have no words, and a mean of null.  Rows are scored one by
one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Written, by_slices
from .mixing import word_count

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
CHUNK_BYTES, PARTITION_BYTES = 4 << 20, 16 << 20


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def ngrams(data: np.ndarray, off: np.ndarray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the hash of the n-gram that ends at a word, and the words that have one; and each text's word range."""
    starts, ends, ranges = K.words(data, off)
    hashes = K.word_hashes(data, starts, ends, lower=True)
    since = np.arange(len(hashes)) - np.repeat(ranges[:-1], np.diff(ranges))
    out = []
    for k in range(1, order + 1):
        at = np.flatnonzero(since >= k - 1)
        windows = K.window_hashes(hashes, k)
        out.append((windows[at - (k - 1)] if len(at) else np.zeros(0, np.uint64), at))
    return out, ranges


def _chunk_id(data: np.ndarray, off: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(off.tobytes() + data.tobytes(), digest_size=8).digest(), "big", signed=True)


def _partition(values: np.ndarray, partitions: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """Per row doc_id, n_words, log_score (the sum of natural logarithms) and mean_log_score."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = source.agg(F.coalesce(F.sum(word_count()), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    total, partitions = max(1, size["words"]), max(1, -(-size["bytes"] * order // PARTITION_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tell(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        grams, _ = ngrams(data, off, order)
        values, counts = np.unique(np.concatenate([g for g, _ in grams]), return_counts=True)
        edges = np.searchsorted(_partition(values, partitions), np.arange(partitions + 1))
        parts = np.flatnonzero(np.diff(edges))
        packed = [pack(values[edges[p] : edges[p + 1]]) for p in parts]
        own = [pack_counts(counts[edges[p] : edges[p + 1]]) for p in parts]
        chunk = pa.array([_chunk_id(data, off)] * len(parts), pa.int64())
        return pa.RecordBatch.from_arrays([chunk, pa.array(parts), pa.array(packed, pa.binary()), pa.array(own, pa.binary())], names=["chunk", "part", "grams", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        asked = [unpack(x) for x in group["grams"].to_pylist()]
        counts = np.concatenate([unpack_counts(x) for x in group["counts"].to_pylist()])
        _, place = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(place, weights=counts)[place].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum([len(a) for a in asked])])
        back = [pack_counts(totals[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"chunk": group["chunk"], "part": group["part"], "totals": pa.array(back, pa.binary())})

    def place_text(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_chunk_id(data, off)] * len(rows), pa.int64()), *rows.columns], names=["chunk", *rows.schema.names])

    def sum_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
        data, off = K.column_bytes(texts["text"])
        grams, ranges = ngrams(data, off, order)
        values, place = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
        parts = dict(zip(counts["part"].to_pylist(), counts["totals"].to_pylist(), strict=True))
        known = np.concatenate([np.zeros(0, np.int64), *[unpack_counts(parts[p]) for p in sorted(parts)]])
        if len(known) != len(values):
            raise RuntimeError("counts don't belong to this chunk")
        edges = np.concatenate([[0], np.cumsum([len(g) for g, _ in grams])])
        words = int(ranges[-1])
        of = np.zeros((order, words), np.int64)
        for k, (_, at) in enumerate(grams):
            of[k, at] = known[place[edges[k] : edges[k + 1]]]
        logs = np.log(np.maximum(of[0], 1) / total) + (order - 1) * np.log(alpha)
        for k in range(1, order):
            context = np.concatenate([[0], of[k - 1][:-1]])
            logs = np.where(of[k] >= min_count, np.log(np.maximum(of[k], 1) / np.maximum(context, 1)) + (order - 1 - k) * np.log(alpha), logs)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        n = np.diff(ranges)
        log_score = np.round(sums[ranges[1:]] - sums[ranges[:-1]], 6)
        mean = pa.array(np.round(log_score / np.maximum(n, 1), 6), mask=n == 0)
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(n), "log_score": pa.array(log_score), "mean_log_score": mean})

    told = by_slices(source, "text", tell, "chunk bigint, part bigint, grams binary, counts binary", CHUNK_BYTES)
    # Written, so that the n-grams' shuffle files are gone before the texts are shuffled.
    totals = Written(docs.sparkSession).put(told.groupBy("part").applyInArrow(add_up, "chunk bigint, part bigint, totals binary"), "totals")
    texts = by_slices(source, "text", place_text, f"chunk bigint, doc_id {kind}, text string", CHUNK_BYTES)
    return texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(sum_up, f"doc_id {kind}, n_words bigint, log_score double, mean_log_score double")


def brute_force(docs: list[tuple], order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> list[tuple]:
    """Counts in a dictionary, for tests."""
    import math
    import re
    from collections import Counter

    split = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in docs]
    counts = Counter(tuple(w[i : i + k]) for w in split for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(map(len, split))
    out = []
    for (doc, _), w in zip(docs, split, strict=True):
        s = 0.0
        for i in range(len(w)):
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if k == 1 or counts[gram] >= min_count:
                    s += math.log(counts[gram] / (counts[gram[:-1]] if k > 1 else total)) + (order - k) * math.log(alpha)
                    break
        out.append((doc, len(w), s))
    return out
