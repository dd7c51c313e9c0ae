"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has one coordinate per bin.  In round i of the first half every
shingle is put into the bin that the i-th hash gives, and a bin keeps its least
value; bins already filled by an earlier round are closed.  Each round of the
second half puts all shingles into one bin, so that every coordinate fills.
Documents with similarity s agree in a coordinate with probability s, and the
number of agreements is concentrated as with independent bins.

``plan`` chooses rows and bands so that a pair at the threshold shares no band
with a probability under ``MISS``.  Documents with equal shingle sets form
classes first, known by two 64-bit sums and the size, and one of each class goes
on.  Documents of a band's bucket are linked without listing its pairs:

* two star rounds compare members with one leader of their bucket, and skip what
  earlier links have joined already;
* what is then still apart in a bucket is compared exactly: members outside the
  bucket's largest component against its members, in blocks of bounded size
  whose overlaps are one product of incidence matrices.  Only links that join
  components leave a block.

So every pair that shares a band is compared on full shingle sets or is known to
be connected already, and no link between components is lost.

Sets so small that one shingle more or less ends the link are linked with equal
ones only, and so stay out of the buckets.

Null and empty texts have an empty set and are linked with nothing, as are rows
without doc_id.  A text with fewer words than a shingle has its whole sequence
as its only shingle.  Rows with the same doc_id count as one document, for which
the row with the most shingles stands (of several the one with the greatest
hashes), so that reruns agree.  Only doc_id and text are read, so that other
columns may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Written, by_slices, list_column, mapped
from .components import components

MISS = 1e-9
SMALL_BUCKET = 16
BLOCK_SHINGLES, BLOCK_DOCS = 150_000, 1000
_STAMP = 0x2545F4914F6CDD1D


def plan(percent: int) -> tuple[int, int]:
    """Rows a band and bands for a threshold in percent."""
    s = percent / 100
    rows = 5 if percent >= 85 else 4 if percent >= 75 else 3
    return rows, math.ceil(math.log(MISS) / math.log(1 - s**rows))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, and their ranges."""
    starts, ends, ranges = K.words(data, off)
    hashes = K.word_hashes(data, starts, ends, lower=True)
    counts = np.diff(ranges)
    whole = np.maximum(counts - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), whole)
    windows = K.window_hashes(hashes, size)
    values = windows[K.ranges_of(ranges[:-1], whole)] if len(windows) else np.zeros(0, np.uint64)
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        if len(short):
            values = np.concatenate([values, K.window_hashes(hashes, few)[ranges[short]]])
            doc = np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    once = np.ones(len(doc), bool)
    once[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    values, doc = values[once], doc[once]
    return values, np.searchsorted(doc, np.arange(len(counts) + 1))


def sketches(values: np.ndarray, ranges: np.ndarray, bins: int) -> np.ndarray:
    """A row of ``bins`` coordinates for each set; empty sets give rows of the largest value."""
    n = len(ranges) - 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, top)
    doc = K.owners(ranges)
    live, own = values, doc
    for i in range(2 * bins):
        if not len(live):
            break
        g = K.mix(live ^ np.uint64((_STAMP * (i + 1)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(1)
        at = own * bins + ((g % np.uint64(bins)).astype(np.int64) if i < bins else i - bins)
        open_ = out[at] == top
        if i == 0:
            np.minimum.at(out, at, g)
        else:
            fresh, slot = np.unique(at[open_], return_inverse=True)
            least = np.full(len(fresh), top)
            np.minimum.at(least, slot, g[open_])
            out[fresh] = least
        wanting = (out.reshape(n, bins) == top).any(axis=1)
        keep = wanting[own]
        live, own = live[keep], own[keep]
    return out.reshape(n, bins)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, row_key, n, set sums a and b, band keys) of each row of ``docs(doc_id, text, row_key)``."""
    rows_a_band, bands = plan(percent)

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        values, ranges = shingle_sets(data, off, size)
        n = np.diff(ranges)
        sums = []
        for salt in (1, 2):
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(K.mix(values + np.uint64(salt)), out=total[1:])
            sums.append((total[ranges[1:]] - total[ranges[:-1]]).view(np.int64))
        sketch = sketches(values, ranges, rows_a_band * bands).reshape(len(n), bands, rows_a_band)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STAMP), (len(n), bands))
        for r in range(rows_a_band):
            key = K.mix(key ^ sketch[:, :, r])
        keys = list_column(key.reshape(-1).view(np.int64), np.arange(len(n) + 1) * bands)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_key"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), keys], names=["doc_id", "row_key", "n", "a", "b", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slices(docs, "text", work, f"doc_id {kind}, row_key bigint, n bigint, a bigint, b bigint, bands array<bigint>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        values, ranges = shingle_sets(data, off, size)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), list_column(values.view(np.int64), ranges)], names=["doc", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slices(docs, "text", work, f"doc {kind}, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("doc").alias("x"), F.col("shingles").alias("p")), "x")
    both = left.join(sets.select(F.col("doc").alias("y"), F.col("shingles").alias("q")), "y").select("x", "y", "p", "q")

    def run(batches):
        for batch in batches:
            p, q = batch.column("p"), batch.column("q")
            pv, qv = p.flatten().to_numpy(zero_copy_only=False), q.flatten().to_numpy(zero_copy_only=False)
            po, qo = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (p, q))
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                one, two = pv[po[i] : po[i + 1]], qv[qo[i] : qo[i + 1]]
                if 100 * min(len(one), len(two)) >= percent * max(len(one), len(two)):
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    ok[i] = 100 * shared >= percent * (len(one) + len(two) - shared)
            yield batch.select(["x", "y"]).filter(pa.array(ok))

    kind = pairs.schema["x"].dataType.simpleString()
    return mapped(both, run, f"x {kind}, y {kind}")


def block_links(sides: DataFrame, percent: int) -> DataFrame:
    """Links between components, from blocks: rows (key, ub, mb, probe, doc, comp, shingles)."""

    def links(group: pa.Table) -> pa.Table:
        lists = group["shingles"].combine_chunks()
        probe = group["probe"].to_numpy(zero_copy_only=False).astype(bool)
        doc, comp = group["doc"].to_numpy(), group["comp"].to_numpy()
        values = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        own = np.repeat(np.arange(len(doc)), sizes)
        shingles, column, times = np.unique(values, return_inverse=True, return_counts=True)
        common = times > 1
        number = np.cumsum(common) - 1
        keep = common[column]
        place = np.full(len(doc), -1)
        place[probe], place[~probe] = np.arange(probe.sum()), np.arange((~probe).sum())
        shared = np.zeros((int(probe.sum()), int((~probe).sum())), np.float32)
        for at in range(0, int(common.sum()), 4096):
            part = keep & (number[column] >= at) & (number[column] < at + 4096)
            one = np.zeros((shared.shape[0], 4096), np.float32)
            two = np.zeros((shared.shape[1], 4096), np.float32)
            for side, matrix in ((True, one), (False, two)):
                mine = part & (probe[own] == side)
                matrix[place[own[mine]], number[column[mine]] - at] = 1
            shared += one @ two.T
        size = sizes.astype(np.float64)
        linked = 100 * shared >= percent * (size[probe][:, None] + size[~probe][None, :] - shared)
        linked &= comp[probe][:, None] != comp[~probe][None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        xs, ys = np.nonzero(linked)
        for x, y, p, q in zip(doc[probe][xs], doc[~probe][ys], comp[probe][xs].tolist(), comp[~probe][ys].tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
        return pa.table({"x": pa.array([o[0] for o in out], group.schema.field("doc").type), "y": pa.array([o[1] for o in out], group.schema.field("doc").type)})

    kind = sides.schema["doc"].dataType.simpleString()
    return sides.groupBy("key", "ub", "mb").applyInArrow(links, f"x {kind}, y {kind}")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs(doc_id, text)``."""
    tables = Written(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("text"))
    known = tables.put(signatures(source, size, percent), "signatures")
    identity = ["a", "b", "n"]
    stands = F.max(F.struct("n", "a", "b", "row_key")).alias("one")
    own = tables.put(known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(stands).select("doc_id", "one.*"), "own")
    classes = own.where("n > 0").groupBy(*identity).agg(F.min("doc_id").alias("doc"))
    able = own.join(classes.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").where(100 * F.col("n") >= percent * (F.col("n") + 1))
    leaders = known.join(able.select("doc_id", "row_key"), ["doc_id", "row_key"], "left_semi").dropDuplicates(["doc_id"])  # these are equal texts
    rows = leaders.select(F.explode("bands").alias("key"), F.col("doc_id").alias("doc"), "n")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    buckets = tables.put(rows.join(many.where("members > 1"), "key").select("key", "doc", "n", "members"), "buckets")
    inside = buckets.select(F.col("doc").alias("doc_id")).distinct().join(own.select("doc_id", "row_key"), "doc_id")
    texts = source.join(inside, ["doc_id", "row_key"]).dropDuplicates(["doc_id"])
    sets = tables.put(sets_of(texts, size), "sets")

    comp: DataFrame | None = None
    for turn in range(3):
        known_as = buckets if comp is None else buckets.join(comp.withColumnRenamed("node", "doc"), "doc", "left")
        labelled = known_as.withColumn("comp", F.col("doc") if comp is None else F.coalesce("component", "doc"))
        apart = labelled.groupBy("key").agg(
            F.min("comp").alias("least"),
            F.max("comp").alias("most"),
            F.min(F.struct((F.col("doc") if turn == 0 else F.xxhash64("doc")).alias("rank"), F.col("doc").alias("doc"), F.col("comp").alias("comp"), F.col("n").alias("n"))).alias("leader"),
        ).where("least <> most")
        if turn < 2:
            star = labelled.join(apart, "key").where("comp <> leader.comp").where(100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n"))
            pairs = star.groupBy("doc", F.col("leader.comp").alias("other")).agg(F.min("leader.doc").alias("y")).select(F.col("doc").alias("x"), "y")
            if turn == 0:  # later rounds may meet more than one component
                pairs = pairs.groupBy("x").agg(F.min("y").alias("y"))
            found = tables.put(verified(pairs, sets, percent), "links")
        else:
            sizes = labelled.join(apart.select("key"), "key").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("in_comp"), F.sum("n").alias("shingles"))
            main = sizes.groupBy("key").agg(F.max(F.struct("in_comp", "comp")).getField("comp").alias("main"), F.sum("shingles").alias("total"), F.sum("in_comp").alias("count"))
            rest = tables.put(labelled.join(main, "key").select("key", "doc", "n", "comp", "main", "total", "count"), "apart")
            small = rest.where(F.col("count") <= SMALL_BUCKET)
            probe = small.where("comp <> main").select("key", F.col("doc").alias("x"), F.col("comp").alias("xc"), F.col("n").alias("xn"), "main")
            member = small.select("key", F.col("doc").alias("y"), F.col("comp").alias("yc"), F.col("n").alias("yn"))
            pairs = probe.join(member, "key").where("xc <> yc AND (yc = main OR x < y)").where(100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")).select("x", "y").distinct()
            one = verified(pairs, sets, percent)
            large = rest.where(F.col("count") > SMALL_BUCKET).withColumn("blocks", F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("count") / BLOCK_DOCS)).cast("int"))
            block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            probes = large.where("comp <> main").select("key", block.alias("ub"), every.alias("mb"), F.lit(True).alias("probe"), "doc", "comp")
            members = large.select("key", block.alias("mb"), every.alias("ub"), F.lit(False).alias("probe"), "doc", "comp").select(*probes.columns)
            sides = probes.unionByName(members).join(sets, "doc")
            two = block_links(sides, percent)
            found = tables.put(one.unionByName(two), "links")
        links = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
        if comp is not None:  # the stars that are known stand for the links behind them
            links = links.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))
        comp = tables.put(components(links, tables), "components")
    each = known.select("doc_id", F.col("n").alias("n_row")).join(own.drop("row_key"), "doc_id", "left")
    membership = each.join(classes, identity, "left").join(comp.withColumnRenamed("node", "doc"), "doc", "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc", "doc_id"))
    return membership.select("doc_id", F.col("n_row").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def brute_force(docs: list[tuple], size: int, percent: int) -> list[tuple]:
    """All pairs and a union-find, for tests."""
    import re

    sets = []
    for _, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        meets: dict[int, int] = {}
        for g in s:
            for j in holders.setdefault(g, []):
                meets[j] = meets.get(j, 0) + 1
            holders[g].append(i)
        for j, shared in meets.items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(docs)]
