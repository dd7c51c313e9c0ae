"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

Blank lines always stay.  Any other line goes if an equal line stands earlier: in
a document with a smaller doc_id, or further up in the same one.  A line of
``SHORTEST`` characters and more also goes if one within ``THRESHOLD`` edits, of
``SHORTEST`` characters and more too, stands earlier.  Lines are judged on the
input, so that the first of a chain is what the others are compared with, whether
it stays or not.  A document that loses all its lines, as a copy does, keeps its
row with what is left, which may be an empty text.

Equal lines are counted first, combined before the shuffle, and one of each goes
on.  Each is cut into threshold + 1 segments; two lines within the threshold
share one of the shorter line's segments, at a place that the lengths bound.  So
each line is indexed by (length, segment number, segment) and probes the index
of each length up to ``THRESHOLD`` less with the substrings that the
multi-match-aware bounds allow.  Pairs that meet under a key that at most
``SMALL`` lines are indexed by, and whose counts of a few letters differ by no
more than the threshold's edits can change (short lines only), are verified with
the banded bit-parallel recurrence: one step for each character between the first
and the last difference, over a band of 2 * threshold + 1 bits.

A line needs one earlier line near it, not all of them.  So under a key with more
lines each line is first compared with the earliest one, then with the earliest
that is still open; those found near are done, and only lines earlier than the
last open one stay as partners.  What is left is told apart by the letters: an edit
changes how often two characters occur at most, so of 2 * threshold + 2 groups of
characters at least two keep all their counts, and lines meet again only under the
segment's key joined with two groups' counts.  Nothing is dropped on the way.

Lines are known by a 64-bit hash; a second hash tells collisions, and lines that
collide stay.  Null texts have no lines.  Documents without doc_id are left
whole and take no lines from others.  Rows with the same doc_id and text are one
document, and so are given the same result.  Only doc_id and text are read;
columns of any other name are carried along as they are.  An empty table gives
an empty one.
"""

from __future__ import annotations

from string import ascii_lowercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, fresh_names, quoted

#: Characters that a line has at least for edits to be allowed; a shorter one goes for an equal line only.
SHORTEST = 12
THRESHOLD = 2
#: Letters that pairs are first compared by; any eight ASCII characters give right results, frequent ones tell more pairs apart.
LETTERS = "etaoinsh"
#: Lines of this many characters and more aren't compared by letters: their segments tell them apart.
LONG = 64
#: Lines indexed by one key that all its probes are compared with; larger keys are resolved by stars and by letters.
SMALL, STARS = 16, 2
#: Characters that lines under larger keys are told apart by; any choice gives right results.
COUNTED = ascii_lowercase + digits + " .,-:/"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, line_no, line, id, check) of the lines that aren't blank."""
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    # The key is taken below the generator, once a text, and the text isn't carried into the lines.
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    return keyed.select("doc_id", "row_key", split).where(F.col("line").rlike("[^ \t\r\x0b\x0c]")).withColumns({"id": F.xxhash64("line"), "check": F.hash("line")})


def _places(threshold: int, probe: bool) -> list[tuple[int, int, int]]:
    """(characters less, segment number, shift) of each key of a line; a probe's own segments are among its places."""
    parts = threshold + 1
    out = []
    for less in range(parts if probe else 1):
        for number in range(parts):
            low, high = (max(-number, less - (threshold - number)), min(number, less + (threshold - number))) if probe else (0, 0)
            out += [(less, number, shift) for shift in range(low, high + 1)]
    return out


def _cut(threshold: int, places: list[tuple[int, int, int]]) -> tuple[Column, Column, Column, Column]:
    """(length, segment number, start, size) that the key of the place ``at`` stands for, of a text of ``n`` characters."""
    parts = threshold + 1
    less, number, shift = (F.get(F.array(*[F.lit(p[i]) for p in places]), F.col("at")) for i in range(3))
    length = F.col("n") - less
    short, over = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts))
    start = short * number + F.greatest(over - (F.lit(parts) - number), F.lit(0)) + 1 + shift
    return length, number, start, short + F.when(over >= F.lit(parts) - number, 1).otherwise(0)


def keyed(texts: DataFrame, threshold: int, probe: bool) -> DataFrame:
    """A row for each key of each text (s, n): its hashed length, number and substring, and ``at``, which place that is.

    Places are exploded first and keys taken after, so that the compiled code stays short.
    """
    places = _places(threshold, probe)
    length, number, start, size = _cut(threshold, places)
    wide = texts.withColumn("at", F.explode(F.array(*[F.lit(i).cast("tinyint") for i in range(len(places))])))
    return wide.withColumn("made", F.xxhash64(length, number, F.substring(F.col("s"), start, size)))


def letter_counts(text: str) -> Column:
    """How often each of ``LETTERS`` stands in the text, modulo 16, in four bits each."""
    out = F.lit(0)
    for i, letter in enumerate(LETTERS):
        count = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)), 4 * i))
    return out


def may_be_near(left: str, right: str, threshold: int) -> Column:
    """Whether letter counts allow so few edits: each adds one letter at most, and takes one away at most."""
    if threshold > 7:
        return F.lit(True)
    digit = lambda c, i: F.shiftright(F.col(c), 4 * i).bitwiseAND(F.lit(15))
    less = [(digit(left, i) - digit(right, i) + 8).bitwiseAND(F.lit(15)) - 8 for i in range(len(LETTERS))]
    return (sum(F.greatest(d, F.lit(0)) for d in less) <= threshold) & (sum(F.greatest(-d, F.lit(0)) for d in less) <= threshold)


def common_start(left: Column, right: Column, most: Column) -> Column:
    """How many characters two strings share at the start, up to ``most``; found by halving steps."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(20))])
    same = lambda n, s: (n + s <= most) & (F.substring(left, n + 1, s) == F.substring(right, n + 1, s))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(same(n, s), n + s).otherwise(n))


def trimmed(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (p, q) without what they share at both ends, but for a few characters; the distance stays."""
    room = F.least(F.char_length("p"), F.char_length("q")) - (4 * threshold + 4)
    start = pairs.withColumn("_a", common_start(F.col("p"), F.col("q"), room))
    ends = start.withColumn("_b", common_start(F.reverse("p"), F.reverse("q"), room - F.col("_a")))
    cut = lambda c: F.substring(F.col(c), F.col("_a") + 1, F.char_length(c) - F.col("_a") - F.col("_b")).alias(c)
    return ends.select(*[cut(c) if c in ("p", "q") else F.col(c) for c in pairs.columns])


def edit_distance_within(left: str, right: str, threshold: int) -> Column:
    """Whether two strings are within ``threshold`` edits, by a banded bit-parallel recurrence.

    Bit i of the vectors stands for row j - threshold + i of column j.  The
    distance is followed along the band's lower diagonal, and along the last row
    once that is reached.
    """
    k, width = threshold, 2 * threshold + 1
    mask = (1 << width) - 1
    p, t = (F.regexp_extract_all(F.col(c), F.lit("(?s)."), F.lit(0)) for c in (left, right))
    start = F.struct(F.lit(mask & ~((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))

    def over(text: Column) -> Column:
        rows = F.size(text["p"])

        def step(a: Column, j: Column) -> Column:
            match = F.lit(0)
            here = F.get(text["t"], j - 1)
            for i in range(width):
                match = match + F.when(F.coalesce(F.get(text["p"], j - k + i - 1) == here, F.lit(False)), 1 << i).otherwise(0)
            # Terms that repeat are bound by one-element transforms; these copy small structs of integers only.
            vp, vn = a["vp"], a["vn"]
            one = F.transform(F.array(match), lambda m: m.bitwiseAND(vp).__add__(vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(mask)))
            two = F.transform(one, lambda d0: F.struct(d0.alias("d0"), vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(mask))).alias("hp"), d0.bitwiseAND(vp).alias("hn")))
            enough = a["d"] > 2 * k + F.greatest(F.size(text["t"]) - rows, F.lit(0))  # what follows can't bring it back
            bit = F.greatest(2 * k - (j - (rows - k)), F.lit(0))  # of the last row, past the diagonal

            def close(v: Column) -> Column:
                halved = F.shiftright(v["d0"], 1)
                on = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0
                diagonal = F.when(v["d0"].bitwiseAND(F.lit(1 << (2 * k))) != 0, 0).otherwise(1)
                across = F.when(on(v["hp"]), 1).when(on(v["hn"]), -1).otherwise(0)
                return F.struct(
                    v["hn"].bitwiseOR(F.bitwise_not(halved.bitwiseOR(v["hp"])).bitwiseAND(F.lit(mask))).alias("vp"),
                    halved.bitwiseAND(v["hp"]).alias("vn"),
                    (a["d"] + F.when(j <= rows - k, diagonal).otherwise(across)).alias("d"),
                )

            return F.when(enough, a).otherwise(F.get(F.transform(two, close), F.lit(0)))

        return F.aggregate(F.sequence(F.lit(1), F.size(text["t"])), start, step, lambda a: a["d"] <= threshold)

    return F.get(F.transform(F.array(F.struct(p.alias("p"), t.alias("t"))), over), F.lit(0))


def all_letters_near(left: str, right: str, threshold: int) -> Column:
    """Whether the counts of all of a to z allow so few edits; for pairs, before the recurrence."""
    count = lambda c, x: F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit(x), F.lit("")))
    less = [count(left, x) - count(right, x) for x in ascii_lowercase]
    pair = F.array(*less)
    up = F.aggregate(pair, F.lit(0), lambda n, d: n + F.greatest(d, F.lit(0)))
    down = F.aggregate(pair, F.lit(0), lambda n, d: n + F.greatest(-d, F.lit(0)))
    return (up <= threshold) & (down <= threshold)


def later_of_near(pairs: DataFrame, distinct: DataFrame, threshold: int, tables: Written) -> DataFrame:
    """(id) of the later line of each of the pairs (x, y) that is within the threshold."""
    one = distinct.select(F.col("id").alias("x"), F.col("line").alias("p"), F.col("first").alias("pf"))
    two = distinct.select(F.col("id").alias("y"), F.col("line").alias("q"), F.col("first").alias("qf"))
    met = pairs.join(one, "x").join(two, "y")
    like = met.where(F.abs(F.char_length("p") - F.char_length("q")) <= threshold)
    close = tables.put(trimmed(like.where(all_letters_near("p", "q", threshold)), threshold), "close")
    near = close.where(edit_distance_within("p", "q", threshold))
    return tables.put(near.select(F.when(F.col("pf") < F.col("qf"), F.col("y")).otherwise(F.col("x")).alias("id")).distinct(), "near")


def met_under_keys(index: DataFrame, probe: DataFrame, threshold: int, small: int, tables: Written) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of lines that share a key of at most ``small`` indexed lines, and the probes (key, id, at) of the other keys.

    One join does both: a large key stands in it as one row without a line.
    """
    index = index.select("made", F.col("id").alias("x"), F.col("letters").alias("xl"))
    large = tables.put(index.groupBy("made").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > small).select("made"), "large")
    side = index.join(large, "made", "left_anti").unionByName(large.select("made", F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("int").alias("xl")))
    near = F.coalesce(may_be_near("xl", "letters", threshold), F.lit(True))
    met = tables.put(side.join(probe, "made").where(F.col("x").isNull() | ((F.col("x") != F.col("id")) & near)).select("made", "x", "id", "at"), "met")
    pairs = met.where("x IS NOT NULL").select(F.least("x", "id").alias("x"), F.greatest("x", "id").alias("y")).distinct()
    return pairs, met.where("x IS NULL").select(F.col("made").alias("key"), "id", "at")


def starred(entries: DataFrame, gone: DataFrame, distinct: DataFrame, threshold: int, tables: Written) -> DataFrame:
    """(id) of lines found near the earliest entry of one of their keys, or the earliest that is still open, and of those in ``gone``."""
    for turn in range(STARS):
        still = entries.join(gone, "id", "left_anti")
        head = (entries if turn == 0 else still).groupBy("key").agg(F.min(F.struct("first", "id", "letters")).alias("head"))
        star = still.join(head, "key").where("head.first < first").where(F.coalesce(may_be_near("head.letters", "letters", threshold), F.lit(True)))
        found = later_of_near(star.select(F.col("head.id").alias("x"), F.col("id").alias("y")).distinct(), distinct, threshold, tables)
        gone = tables.put(gone.unionByName(found).distinct(), "gone")
    return gone


def counted(text: str, groups: int) -> tuple[Column, Column]:
    """How often each of ``COUNTED`` stands in a text, and a hash of these counts for each of the groups they are dealt to."""
    count = F.transform(F.array(*[F.lit(c) for c in COUNTED]), lambda c: F.octet_length(text) - F.octet_length(F.replace(F.col(text), c, F.lit(""))))
    of = lambda counts: F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.xxhash64(F.filter(counts, lambda x, i: F.pmod(i, F.lit(groups)) == g)))
    return count, of("counts")


def met_by_letters(entries: DataFrame, distinct: DataFrame, threshold: int, tables: Written) -> DataFrame:
    """Pairs (x, y) of ``entries(key, id, index)`` of one key whose characters' counts allow so few edits; x is an indexed one."""
    groups = 2 * threshold + 2
    count, hashes = counted("line", groups)
    lines_ = distinct.join(entries.select("id").distinct(), "id", "left_semi").withColumn("counts", count).select("id", "counts", hashes.alias("hashes"))
    two = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(groups) for j in range(i)])).alias("two")
    wide = entries.join(tables.put(lines_, "counts"), "id").select("key", "id", "index", "counts", "hashes", two)
    wide = wide.select(F.xxhash64("key", "two", F.get("hashes", F.col("two.i")), F.get("hashes", F.col("two.j"))).alias("made"), "id", "index", "counts")
    less = F.zip_with("xc", "counts", lambda a, b: a - b)
    change = lambda sign: F.aggregate(less, F.lit(0), lambda n, d: n + F.greatest(sign * d, F.lit(0))) <= threshold
    side = wide.where("index").select("made", F.col("id").alias("x"), F.col("counts").alias("xc"))
    return side.join(wide, "made").where("x <> id").where(change(1) & change(-1)).select(F.least("x", "id").alias("x"), F.greatest("x", "id").alias("y")).distinct()


def near_lines(docs: DataFrame, tables: Written, shortest: int = SHORTEST, threshold: int = THRESHOLD, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(id) of lines of which another one within the threshold stands earlier; and the table of distinct lines."""
    found = lines(docs)
    # One struct, so that the lines are shuffled once; written, so that they are combined once for the readers below.
    heads = found.groupBy("id").agg(F.min(F.struct("doc_id", "line_no", "line")).alias("head"), F.count(F.lit(1)).alias("times"), F.min("check").alias("low"), F.max("check").alias("high"))
    heads = heads.select("id", "times", F.expr("low = high").alias("alone"), F.struct("head.doc_id", "head.line_no").alias("first"), F.col("head.line").alias("line"), F.char_length("head.line").alias("n"))
    distinct = tables.put(heads.withColumn("letters", F.when(F.col("n") < LONG, letter_counts("line"))), "lines")
    long = distinct.where(F.col("n") >= shortest).select("id", "n", "letters", F.col("line").alias("s"))
    index, probe = (keyed(long, threshold, side).select("made", "at", "id", "letters") for side in (False, True))
    pairs, hot = met_under_keys(tables.put(index, "index"), probe, threshold, small, tables)
    pairs = tables.put(pairs, "pairs")
    # Few lines meet others: these alone are read from here on.  Each side has an id once, so the ids of a partition are few.
    meeting = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).unionByName(hot.select("id")).distinct()
    wanted = tables.put(distinct.join(meeting.hint("shuffle_hash"), "id", "left_semi"), "wanted")
    near = later_of_near(pairs, wanted, threshold, tables)
    if hot.isEmpty():
        return near, distinct
    own = [i for i, place in enumerate(_places(threshold, True)) if place[0] == place[2] == 0]  # of a probe, the line's own segments
    entries = tables.put(hot.join(wanted.select("id", "first", "letters"), "id").withColumn("index", F.col("at").isin(own)), "entries")
    near = starred(entries, near, wanted, threshold, tables)
    marked = entries.join(near.withColumn("gone", F.lit(True)), "id", "left")
    bound = marked.where("gone IS NULL").groupBy("key").agg(F.max("first").alias("last"))
    left = tables.put(marked.join(bound, "key").where("first <= last").select("key", "id", "index").distinct(), "left")
    rest = later_of_near(tables.put(met_by_letters(left, wanted, threshold, tables), "pairs"), wanted, threshold, tables)
    return near.unionByName(rest).distinct(), distinct


def removed_lines(docs: DataFrame, shortest: int = SHORTEST, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, removed, near): of each document the numbers of the lines that go."""
    tables = Written(docs.sparkSession)
    near, distinct = near_lines(docs, tables, shortest, threshold)
    known = distinct.where("alone").join(near.withColumn("near", F.lit(True)), "id", "left").where("near OR times > 1").select("id", "first", F.coalesce("near", F.lit(False)).alias("near"))
    found = lines(docs).select("doc_id", "row_key", "line_no", "id")
    gone = found.join(known, "id").where("near OR first <> struct(doc_id, line_no)")
    # Sets, as rows with the same doc_id and text name the same lines.
    return gone.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("line_no")).alias("removed"), F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias("n_near"))


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST, threshold: int = THRESHOLD) -> DataFrame:
    """The rows and columns of ``docs`` without the lines that go; ``n_chars``, if present, follows the text."""
    doc, key, own, lost = fresh_names(docs, "doc", "key", "own", "removed")
    gone = removed_lines(docs, shortest, threshold).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("removed").alias(lost))
    marked = docs.withColumn(own, F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(key)), "left")
    cut = marked.withColumn(lost, F.coalesce(lost, F.array().cast("array<int>")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    text = F.when(F.size(lost) > 0, kept).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(F.size(lost) > 0, F.char_length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.select(*[new[c].alias(c) if c in new else quoted(c) for c in docs.columns])


def digest(docs: DataFrame, shortest: int = SHORTEST, threshold: int = THRESHOLD) -> DataFrame:
    """Per row doc_id, its lines, its long lines, and the numbers of the lines removed, joined by commas."""
    count = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    long = F.regexp_count(F.col("text"), F.lit(f"[^\\n]{{{shortest},}}"))  # a match takes the whole line
    sizes = docs.select("doc_id", F.xxhash64("text").alias("row_key"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in ((count, "n_lines"), (long, "n_long"))])
    joined = sizes.join(removed_lines(docs, shortest, threshold), ["doc_id", "row_key"], "left")
    stay = F.col("removed").isNull()
    return joined.select(
        "doc_id",
        "n_lines",
        "n_long",
        F.when(stay, 0).otherwise(F.size("removed")).cast("bigint").alias("n_removed"),
        F.when(stay, 0).otherwise(F.col("n_near")).cast("bigint").alias("n_near"),
        F.when(stay, "").otherwise(F.array_join(F.col("removed").cast("array<string>"), ",")).alias("removed"),
    )


def brute_force(docs: list[tuple], shortest: int = SHORTEST, threshold: int = THRESHOLD) -> list[tuple]:
    """All pairs of lines, for tests."""

    def within(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > threshold:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1] <= threshold

    first: dict[str, tuple] = {}
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if doc is not None and line.strip(" \t\r\x0b\x0c"):
                first[line] = min(first.get(line, (doc, i)), (doc, i))
    near = {b for b in first if len(b) >= shortest and any(first[a] < first[b] and a != b and len(a) >= shortest and within(a, b) for a in first)}
    out = []
    for doc, text in docs:
        own = [] if text is None else text.split("\n")
        long = [i for i, x in enumerate(own) if len(x) >= shortest]
        gone = [i for i, x in enumerate(own) if doc is not None and x.strip(" \t\r\x0b\x0c") and (x in near or first[x] != (doc, i))]
        out.append((doc, len(own), len(long), len(gone), sum(own[i] in near for i in gone), ",".join(map(str, gone))))
    return out
