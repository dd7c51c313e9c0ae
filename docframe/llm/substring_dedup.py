"""Substring deduplication by level-wise doubling of repeated word windows.

Windows of ``length`` consecutive words that other documents hold too are found
level by level: ``length`` is halved until ``FIRST`` words would be undercut, and
each level's windows are at most twice as long as those of the one before.

At the first level, of each text the windows are taken whose hash is the least
among those of some run of ``length`` words: equal runs take the same, so none is
lost, and about two in ``length - FIRST + 2`` remain.  Windows that one document
has alone end there.  Each other one is extended to the next length, once to the
right and once to the left: a run of ``length`` words around it holds one of the
two.  These are counted in turn, and so on; at the last level all windows of
``length`` words around a survivor are formed.  The loop ends when no candidates
survive.

A word goes if a window over it also starts in a document with a smaller
doc_id, judged on the input.  Texts with equal word sequences are found first by
their digest; only the one with the smallest doc_id goes through the levels, and
of the others every window repeats.

Counting is a grouped minimum and maximum, combined before the shuffle, and
written; the way back is an inner join on the window, which Spark can split where
a passage is in very many documents.  Only candidates' texts are shuffled on.
Windows of all levels but the first are compared by two 64-bit hashes.

Null and empty texts have no words.  Rows without doc_id neither lose words nor
take any.  Rows with the same doc_id are judged one by one and don't take words
from each other.  Only doc_id and text are read, so that other columns may have
any name; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Written, by_slices, list_column

LENGTH = 50
FIRST = 7
_SECOND = 0x5851F42D4C957F2D


def levels(length: int) -> list[int]:
    """Window lengths from the first level to ``length``, each at most twice the one before."""
    out = [length]
    while (out[0] + 1) // 2 >= FIRST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sampled(hashes: np.ndarray, ranges: np.ndarray, first: int, second: int) -> np.ndarray:
    """Which windows of ``first`` words are the least in some window of ``second`` words of their text."""
    grams = K.window_hashes(hashes, first)
    width = second - first + 1
    chosen = np.zeros(len(grams), bool)
    least = K.slide(np.minimum, grams, width)
    if not len(least):
        return chosen
    valid = np.zeros(len(least) + second, bool)
    sizes = np.diff(ranges)
    valid[K.ranges_of(ranges[:-1], np.maximum(sizes - second + 1, 0))] = True
    least = np.where(valid[: len(least)], least, 0)
    pad = np.zeros(width - 1, np.uint64)
    most = K.slide(np.maximum, np.concatenate([pad, least, pad]), width)
    return (most == grams) & (grams > 0)


def signatures(docs: DataFrame, first: int, second: int) -> DataFrame:
    """(doc_id, row_key, n_words, digest of the words, sampled windows) of each row."""

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        starts, ends, ranges = K.words(data, off)
        hashes = K.word_hashes(data, starts, ends)
        joined, at = K.join_words(data, starts, ends, ranges)
        digests = [hashlib.sha256(joined[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
        chosen = np.flatnonzero(sampled(hashes, ranges, first, second))
        grams = K.window_hashes(hashes, first)[chosen] if len(chosen) else np.zeros(0, np.uint64)
        doc = np.searchsorted(ranges, chosen, "right") - 1
        order = np.lexsort((grams, doc))
        doc, grams = doc[order], grams[order]
        once = np.ones(len(doc), bool)
        once[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        doc, grams = doc[once], grams[once]
        lists = list_column(grams.view(np.int64), np.searchsorted(doc, np.arange(len(rows) + 1)))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_key"), pa.array(np.diff(ranges)), pa.array(digests, pa.binary()), lists], names=["doc_id", "row_key", "n_words", "digest", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slices(docs, "text", work, f"doc_id {kind}, row_key bigint, n_words bigint, digest binary, grams array<bigint>")


def _extended(rows: pa.RecordBatch, hashes: np.ndarray, ranges: np.ndarray, at: np.ndarray, length: int, longer: int, every: bool) -> pa.RecordBatch:
    """The windows of ``longer`` words that start or end with a window of ``length`` words at one of the places, or ``every`` one that holds it."""
    n, back = len(hashes), longer - length
    mask = np.zeros(n, bool)
    if every:
        edges = np.bincount(np.maximum(at - back, 0), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        mask = np.cumsum(edges[:n]) > 0
    else:
        mask[at] = True
        mask[at[at >= back] - back] = True
    return _windows(rows, hashes, ranges, mask, longer)


def windows_around(docs: DataFrame, first: int, second: int, every: bool) -> DataFrame:
    """Of each row the windows of ``second`` words that extend one of its ``grams`` of ``first`` words."""

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        starts, ends, ranges = K.words(data, off)
        hashes = K.word_hashes(data, starts, ends)
        lists = rows.column("grams")
        wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
        grams = K.window_hashes(hashes, first)
        own = K.owners(ranges)[: len(grams)].astype(np.uint64)
        stamp = np.uint64(0x9E3779B97F4A7C15)
        hit = np.flatnonzero(np.isin(grams ^ K.mix(own * stamp), wanted ^ K.mix(of.astype(np.uint64) * stamp)))
        return _extended(rows, hashes, ranges, hit, first, second, every)

    return by_slices(docs, "text", work, _window_schema(docs))


def windows_doubled(docs: DataFrame, length: int, second: int, every: bool) -> DataFrame:
    """Of each row the windows of ``second`` words that extend one of ``length`` words at its ``places``."""

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        starts, ends, ranges = K.words(data, off)
        hashes = K.word_hashes(data, starts, ends)
        lists = rows.column("places")
        of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
        at = np.unique(lists.flatten().to_numpy(zero_copy_only=False) + ranges[of])
        return _extended(rows, hashes, ranges, at, length, second, every)

    return by_slices(docs, "text", work, _window_schema(docs))


def _window_schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, row_key bigint, text string, places array<int>, windows array<struct<a:bigint,b:bigint>>"


def _windows(rows: pa.RecordBatch, hashes: np.ndarray, ranges: np.ndarray, mask: np.ndarray, length: int) -> pa.RecordBatch:
    whole = np.zeros(len(mask), bool)
    whole[K.ranges_of(ranges[:-1], np.maximum(np.diff(ranges) - length + 1, 0))] = True
    at = np.flatnonzero(mask & whole)
    a, b = (K.window_hashes(hashes, length, salt)[at].view(np.int64) if len(at) else np.zeros(0, np.int64) for salt in (0, _SECOND))
    lists = np.searchsorted(at, ranges)
    places = (at - np.repeat(ranges[:-1], np.diff(lists))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_key"), rows.column("text"), list_column(places, lists), list_column(pairs, lists)], names=["doc_id", "row_key", "text", "places", "windows"])


def repeated_places(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (doc_id, row_key, text, places) of rows whose windows at
    ``places`` also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    tables = Written(spark)
    plan = levels(length)
    first, second = (plan[0], plan[1]) if len(plan) > 1 else (plan[0], plan[0])
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("text"))
    known = tables.put(signatures(source, first, length), "signatures")

    leaders = known.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    grams = known.join(leaders, ["doc_id", "digest"], "left_semi").select("doc_id", "row_key", F.explode(F.array_distinct("grams")).alias("gram"))
    shared = tables.put(grams.groupBy("gram").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("gram"), "shared")
    wanted = grams.join(shared, "gram").groupBy("doc_id", "row_key").agg(F.collect_set("gram").alias("grams"))
    texts = source.where("doc_id IS NOT NULL").join(wanted, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"])
    now = tables.put(windows_around(texts, first, second, second == length), f"windows-{second}")
    for k, size in enumerate(plan[1:] or plan, 1):
        last = size == length
        rows = now.select("doc_id", "row_key", F.posexplode("windows").alias("k", "w"), "places").select("doc_id", "row_key", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.element_at("places", F.col("k") + 1).alias("place"))
        counted = tables.put(rows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "counted")
        again = rows.join(counted, ["a", "b"])
        again = again.where("doc_id > least") if last else again
        places = again.groupBy("doc_id", "row_key").agg(F.collect_list("place").alias("places"))
        found = now.select("doc_id", "row_key", "text").join(places, ["doc_id", "row_key"])
        if last:
            return known, found
        longer = tables.put(windows_doubled(found, size, plan[k + 1], plan[k + 1] == length), f"windows-{plan[k + 1]}")
        tables.drop(now)
        now = longer
    raise AssertionError("the last level is ``length``")


def _covered(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, length: int):
    starts, ends, ranges = K.words(data, off)
    lists = rows.column("places")
    of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
    at = lists.flatten().to_numpy(zero_copy_only=False) + ranges[of]
    n = len(starts)
    gone = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1))[:n] > 0
    return starts, ends, ranges, gone


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the digest of the words kept."""
    known, found = repeated_places(docs, length)

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        starts, ends, ranges, gone = _covered(rows, data, off, length)
        joined, at = K.join_words(data, starts, ends, ranges, ~gone)
        shas = [hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        removed = np.bincount(K.owners(ranges)[gone], minlength=len(rows))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_key"), pa.array(removed), pa.array(shas)], names=["doc_id", "row_key", "removed", "sha"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = by_slices(found, "text", work, f"doc_id {kind}, row_key bigint, removed bigint, sha string")
    leaders = known.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("leader"))
    followers = known.select("doc_id", "row_key", "digest").join(leaders, "digest").where("doc_id > leader").select("doc_id", "row_key").distinct()
    marks = cut.select("doc_id", "row_key", "removed", "sha").unionByName(followers.withColumns({"removed": F.lit(None).cast("bigint"), "sha": F.lit(None).cast("string")}))
    marks = marks.withColumn("marked", F.lit(True))
    whole = F.col("marked") & F.col("removed").isNull() & (F.col("n_words") >= length)
    return known.select("doc_id", "row_key", "n_words", F.lower(F.hex("digest")).alias("own")).join(marks, ["doc_id", "row_key"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The contract word by word, for tests."""
    import re

    words = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in docs]
    least: dict[tuple, int] = {}
    for doc, w in words:
        for i in range(len(w) - length + 1):
            if doc is not None:
                p = tuple(w[i : i + length])
                least[p] = min(least.get(p, doc), doc)
    out = []
    for doc, w in words:
        gone: set[int] = set()
        for i in range(len(w) - length + 1):
            if doc is not None and least[tuple(w[i : i + length])] < doc:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
