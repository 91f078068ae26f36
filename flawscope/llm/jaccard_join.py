"""N-gram Jaccard join, light sets by enumerated subsets and heavy ones by inverted lists.

The shingles of all sets have one order, rare ones first.  Sets that are similar enough share ``subset``
or more of their first n - t + ``subset`` shingles in this order (n: a set's size, t: the least overlap that a
partner of it can have).  So

* two small sets share one of the subsets of ``subset`` shingles that each enumerates from there, and
* a pair with a large set shares one of the first n - t + 1 shingles, whose inverted lists are scanned.

The boundary between small and large is the size at which the subsets of all smaller sets and the lists
of all larger ones cost least.  Frequencies are counted over all texts, in a table of hashed counters whose
size grows with the input up to ``MAX_COUNTERS``; counters that two shingles share only change
the order, and any order is right.  Keys hold the size class too, as similar sets are of like size.

Equal sets are one set.  The sets of a key are linked to the smallest of them (its pivot) where they are similar;
those that still are in other components than their pivot's other sets are compared with these
inside tasks of bounded size, which give out links only: no link is lost, no group is spelled out in pairs.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.components import components
from flawscope.llm.text import distinct, hash_words, mix, rolling, space_words
from flawscope.session import materialize

MIN_COUNTERS, MAX_COUNTERS = 1 << 12, 1 << 24  # a byte each is broadcast: 16 MB at most
BYTES_PER_COUNTER = 256  # of text, until there are MAX_COUNTERS
SLICE = 1 << 16  # counters that are summed together
LARGEST_SMALL = 400  # sizes up to this can be small
FAMILY = 1000  # sets of one pivot that a task compares with as many others
FAMILY_SHINGLES = 1_000_000  # and their shingles
CHUNK_WORDS = 200_000  # words that a task has in hand at once


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Distinct hashed shingles of n words; a shorter sequence is one shingle, no words have none."""
    hashes = hash_words(words)
    return distinct(rolling(hashes, min(n, len(words)))) if words else hashes


def least_overlap(n, percent: int):
    """A set of n shares at least this many with any set it is linked to."""
    return -(-n * percent // 100)


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Linked sets are of the same class or of neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(101 / percent)).astype(np.int64)


def _sets_of(batches, n: int, columns):
    """Values of the columns and shingle set of each row."""
    for batch in batches:
        for text, *values in zip(batch.column("text"), *(batch.column(c) for c in columns)):
            yield [v.as_py() for v in values], shingle_set(space_words(text.as_py(), fold=True), n)


def _in_chunks(rows):
    """Lists of (values, set), a bounded number of shingles at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + 10
        if size >= CHUNK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _same(s: np.ndarray) -> bytes | None:
    """128-bit hash of a set (its shingles are sorted)."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


SIZED = "doc_id long, n_shingles long, same binary, slice long, counts binary"


def _size_and_count(n: int, counters: int):
    """Size and hash of each row's set, then the task's counters, slice by slice."""
    def size_and_count(batches):
        counts = np.zeros(counters, np.uint32)
        for held in _in_chunks(_sets_of(batches, n, ["doc_id"])):
            sets = [s for _, s in held]
            at = (np.concatenate(sets) >> np.uint64(8)) & np.uint64(counters - 1)
            counts += np.bincount(at.astype(np.int64), minlength=counters).astype(np.uint32)
            none = [None] * len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v, _ in held], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_same(s) for s in sets], pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.binary())],
                ["doc_id", "n_shingles", "same", "slice", "counts"])
        for i, part in enumerate(np.split(counts, range(SLICE, counters, SLICE))):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()),
                     pa.array([i], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                    ["doc_id", "n_shingles", "same", "slice", "counts"])
    return size_and_count


def _levels(key, pdf):
    """A slice's counters over all tasks, as levels: four for each doubling."""
    total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in pdf["counts"])
    level = np.minimum(np.round(4 * np.log2(total + 1.0)), 127).astype(np.uint8)
    return pd.DataFrame({"slice": [key[0]], "levels": [level.tobytes()], "total": [int(total.sum())]})


def ranked(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's shingles in the common order: each is its level and 56 bits of its hash."""
    at = (s >> np.uint64(8)) & np.uint64(len(levels) - 1)
    level = levels[at.astype(np.int64)].astype(np.uint64)
    return np.sort(((level << np.uint64(56)) | (s >> np.uint64(8))).view(np.int64))


def _prefixes(n: int, percent: int, subset: int, shared, usual: float):
    """The first shingles of each row's set, and what it costs to scan the inverted lists of them: as many
    steps as the counters say, less what other shingles usually add to a counter."""
    def prefixes(batches):
        levels = shared.value
        length = np.maximum(1, np.exp2(np.arange(128) / 4) - 1 - usual)
        for held in _in_chunks(_sets_of(batches, n, ["doc_id"])):
            held = [(v, s) for v, s in held if len(s) and v[0] is not None]
            sizes = np.array([len(s) for _, s in held], np.int64)
            first = [ranked(s, levels)[:k] for (_, s), k in zip(held, sizes - least_overlap(sizes, percent) + subset)]
            scan = [int(length[f[:k] >> 56].sum()) for f, k in zip(first, sizes - least_overlap(sizes, percent) + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v, _ in held], pa.int64()), pa.array([_same(s) for _, s in held], pa.binary()),
                 pa.array(first, pa.list_(pa.int64())), pa.array(scan, pa.int64())], ["rep", "same", "first", "scan"])
    return prefixes


def boundary(sizes: list[tuple[int, int, int]], percent: int, subset: int) -> int:
    """The largest small size, from (size, number of sets, cost of scanning their lists): of all bounds the
    one for which subsets of the smaller and lists of the larger sets cost least."""
    enumerated = {n: sets * math.comb(n - least_overlap(n, percent) + subset, subset) for n, sets, _ in sizes}
    scanned = {n: scan for n, _, scan in sizes}
    cost = lambda x: (sum(c for n, c in enumerated.items() if n <= x)
                      + sum(c for n, c in scanned.items() if n >= least_overlap(x + 1, percent)))
    return min([0, *sorted(enumerated)], key=cost)


def set_keys(first: list[np.ndarray], size: np.ndarray, small: int, percent: int, subset: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of many sets from their first shingles and sizes, and which set each key is of."""
    size = np.asarray(size, np.int64)
    t, cls = least_overlap(size, percent), size_class(size, percent)
    shingles, owner = [], []  # of keys: (kind, shingles, set)
    light = np.flatnonzero((size <= small) & (t >= subset))
    length = np.minimum(size, size - t + subset)
    for k in np.unique(length[light]):
        sets = light[length[light] == k]
        chosen = np.array(list(itertools.combinations(range(k), subset)), np.int64).reshape(-1, subset)
        shingles.append(np.stack([first[i][:k] for i in sets])[:, chosen].reshape(-1, subset))
        owner.append(np.repeat(sets, len(chosen)))
    heavy = np.flatnonzero((size >= least_overlap(small + 1, percent)) | (least_overlap(t, percent) < subset))
    if len(heavy):
        lists = [first[i][:k] for i, k in zip(heavy, (size - t + 1)[heavy])]
        shingles.append(np.concatenate(lists)[:, None])
        owner.append(np.repeat(heavy, [len(x) for x in lists]))
    keys = []
    for group, sets in zip(shingles, owner):
        h = np.full(len(group), group.shape[1], np.uint64)
        for column in group.T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(column, np.int64).view(np.uint64))
        keys += [mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + c.astype(np.uint64)) for c in (cls[sets], cls[sets] + 1)]
    return (np.concatenate(keys) if keys else np.empty(0, np.uint64),
            np.concatenate([np.concatenate([x, x]) for x in owner]) if owner else np.empty(0, np.int64))


def _keys(small: int, percent: int, subset: int):
    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node, size, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "first"))
                key, of = set_keys(list(first), size, small, percent, subset)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[of], pa.int64())], ["key", "doc"])
    return keys


def _padded(first) -> np.ndarray:
    """First shingles as rows of one length, filled up with a value above all."""
    out = np.full((len(first), max(map(len, first))), np.iinfo(np.int64).max)
    for row, f in zip(out, first):
        row[:len(f)] = f
    return out


def could_link(first: np.ndarray, size: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of the others those that set i may be linked to: a shingle of one, before the last known one of the other and
    not among the other's known ones, is not in the other at all."""
    most = np.iinfo(np.int64).max
    last = np.where(first == most, np.iinfo(np.int64).min, first).max(axis=1)
    mine, theirs = first[i][first[i] < most], first[others]
    both = np.isin(theirs, mine).sum(axis=1)
    need = -(-percent * (size[i] + size[others]) // (100 + percent))
    return ((np.searchsorted(mine, last[others], "right") - both <= size[i] - need)
            & ((theirs <= last[i]).sum(axis=1) - both <= size[others] - need))


def _alive(percent: int):
    """Sets of a family that could be linked to another one, pairs that are known already aside (both ``near`` the pivot)."""
    def alive(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["pivot", "p", "q"], sort=False):
            first, size = _padded(g["first"].tolist()), g["n"].to_numpy()
            near, hit = g["near"].to_numpy(bool), np.zeros(len(g), bool)
            for i in np.flatnonzero(~near):
                others = np.flatnonzero(near | (np.arange(len(g)) > i))
                if len(others):
                    others = others[could_link(first, size, i, others, percent)]
                    hit[others] = True
                    hit[i] |= len(others) > 0
            out.append(g["doc"].to_numpy()[hit])
        return pd.DataFrame({"node": np.concatenate(out) if out else []}, dtype="int64")
    return alive


def _link(percent: int):
    """Links between components of a family, on full sets; a link joins its two components at once."""
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["pivot", "p", "q"], sort=False):
            doc, comp = g["doc"].to_numpy(), g["component"].to_numpy().copy()
            first, size, sets = _padded(g["first"].tolist()), g["n"].to_numpy(), g["shingles"].tolist()
            for i in range(len(g) - 1):
                others = np.flatnonzero(comp[i + 1:] != comp[i]) + i + 1
                for j in others[could_link(first, size, i, others, percent)] if len(others) else ():
                    if comp[j] != comp[i]:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= percent * (size[i] + size[j] - both):
                            out.append((doc[i], doc[j]))
                            comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return link


def _with(pairs: DataFrame, rows: DataFrame, side: str, **columns: str) -> DataFrame:
    """Columns of the sets joined to one side of pairs; a set of very many pairs is joined in several parts."""
    parts = pairs.groupBy(side).agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("parts"))
    copies = (rows.select(F.col("node").alias(side), *[F.col(c).alias(new) for new, c in columns.items()])
              .join(parts, side).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    return (pairs.join(parts, side).withColumn("part", F.pmod(F.xxhash64("u", "v"), F.col("parts")).cast("int")).drop("parts")
            .join(copies.drop("parts"), [side, "part"]).drop("part"))


def _shingles(n: int):
    """Full sets, where the text is the one that was meant; repeated rows give one."""
    def shingles(batches):
        seen = set()
        for held in _in_chunks(_sets_of(batches, n, ["node", "same"])):
            held = [(v[0], s) for v, s in held if _same(s) == v[1] and not (v[0] in seen or seen.add(v[0]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in held], pa.int64()), pa.array([np.sort(s.view(np.int64)) for _, s in held], pa.list_(pa.int64()))],
                ["node", "shingles"])
    return shingles


def jaccard_join(docs: DataFrame, shingle: int = 5, percent: int = 80, subset: int = 2, small: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles (size of its set), component_id.

    A text's set has its distinct shingles of ``shingle`` words (between ASCII white space, A-Z in lower case); with
    fewer words the whole sequence is one.  Two texts are linked when 100 * intersection >= ``percent`` * union, on
    64-bit hashes of whole sets; component_id is the smallest doc_id reachable by links.  ``small`` sets the
    boundary between small and large sets, which is else chosen by cost.

    Null and empty texts have no shingles and link with nothing: their component is their doc_id.  Rows without
    doc_id come back without a component and link nothing.  Rows that share a doc_id come back each, judged
    by its own text.  Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    n_bytes = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    counters = 1 << (min(max(n_bytes // BYTES_PER_COUNTER, MIN_COUNTERS), MAX_COUNTERS) - 1).bit_length()

    sized = materialize(rows.mapInArrow(_size_and_count(shingle, counters), SIZED), "table")
    levels, total = np.zeros(counters, np.uint8), 0
    for r in (sized.where("slice is not null").groupBy("slice").applyInPandas(_levels, "slice long, levels binary, total long")
              .collect()):  # MAX_COUNTERS bytes at most
        part = np.frombuffer(r["levels"], np.uint8)
        levels[r["slice"] * SLICE:r["slice"] * SLICE + len(part)] = part
        total += r["total"]

    sets = materialize(sized.where("same is not null and doc_id is not null").groupBy("same")
                       .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
                       .withColumn("node", F.monotonically_increasing_id()), "table")
    prefixes = rows.mapInArrow(_prefixes(shingle, percent, subset, sc.broadcast(levels), total / counters),
                               "rep long, same binary, first array<bigint>, scan long")
    first = materialize(sets.join(prefixes, ["rep", "same"]).dropDuplicates(["node"]).select("node", "n", "first", "scan"), "table")
    if small is None:
        sizes = first.where(F.col("n") <= LARGEST_SMALL).groupBy("n").agg(F.count("*"), F.sum("scan")).collect()
        small = boundary([tuple(r) for r in sizes], percent, subset)

    entries = first.select("node", "n", "first").mapInArrow(_keys(small, percent, subset), "key long, doc long")
    keys = entries.groupBy("key").agg(F.min("doc").alias("u"), F.max("doc").alias("last")).where("u < last").select("key", "u")
    stars = materialize(entries.join(keys, "key").where("doc <> u").select("u", F.col("doc").alias("v")).distinct(), "table")

    known = _with(_with(stars, first, "v", nv="n", fv="first"), first, "u", nu="n", fu="first")
    absent = lambda a, b: F.size(F.filter(F.array_except(a, b), lambda x: x <= F.element_at(b, -1)))
    need = F.expr(f"({percent} * (nu + nv) + {99 + percent}) div {100 + percent}")
    likely = materialize(known.where((absent("fu", "fv") <= F.col("nu") - need) & (absent("fv", "fu") <= F.col("nv") - need))
                         .select("u", "v"), "table")

    # sets that may be linked, by their first shingles: those of a star, and others of a pivot's sets
    near = likely.select(F.col("u").alias("pivot"), F.col("v").alias("doc"), F.lit(True).alias("near"))
    family = (stars.select(F.col("u").alias("pivot"), F.col("v").alias("doc")).join(near, ["pivot", "doc"], "left")
              .unionByName(stars.select(F.col("u").alias("pivot"), F.col("u").alias("doc"), F.lit(True).alias("near")).distinct())
              .select("pivot", "doc", F.coalesce("near", F.lit(False)).alias("near"))
              .join(first.select(F.col("node").alias("doc"), "n"), "doc"))

    def dealt(family: DataFrame, pivots: DataFrame, *columns: str) -> DataFrame:
        """The sets of each pivot (pivot, sets, size) in parts, each part with each other one."""
        parts = F.greatest(F.ceil(F.col("sets") / FAMILY), F.ceil(F.col("size") / FAMILY_SHINGLES)).cast("int")
        pivots = materialize(pivots.select("pivot", "size", parts.alias("parts")), "table")
        work = pivots.agg(F.sum(F.col("size") * F.col("parts")).alias("n")).first()["n"] or 0
        return (family.join(pivots.select("pivot", "parts"), "pivot").withColumn("p", F.pmod(F.hash("doc"), F.col("parts")))
                .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .select("pivot", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "doc", "n", *columns)
                .withColumn("bucket", F.pmod(F.xxhash64("pivot", "p", "q"), F.lit(4 * work // FAMILY_SHINGLES + 1)))
                .join(first.select(F.col("node").alias("doc"), "first"), "doc"))

    counted = family.groupBy("pivot").agg(F.count("*").alias("sets"), F.sum("n").alias("size"), F.min("near").alias("known"))
    alive = (dealt(family, counted.where("sets > 2 and not known"), "near")  # of two sets, the star has compared both
             .groupBy("bucket").applyInPandas(_alive(percent), "node long"))
    nodes = materialize(likely.select(F.explode(F.array("u", "v")).alias("node")).union(alive).distinct(), "table")
    wanted = sets.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id"), "node", "same")
    shingles = materialize(rows.join(wanted, "doc_id").select("node", "text", "same")
                           .mapInArrow(_shingles(shingle), "node long, shingles array<bigint>"), "table")

    both = F.size(F.array_intersect("su", "sv"))
    links = materialize(_with(_with(likely, shingles, "v", sv="shingles"), shingles, "u", su="shingles")
                        .where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v").distinct(), "table")
    found = components(links)

    # pivots whose sets still are in several components: compare across components, on full sets
    split = (family.join(nodes.withColumnRenamed("node", "doc"), "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left")
             .withColumn("component", F.coalesce("component", "doc")))
    mixed = (split.groupBy("pivot").agg(F.count("*").alias("sets"), F.sum("n").alias("size"), F.min("component").alias("a"),
                                        F.max("component").alias("b")).where("a < b and sets > 2"))
    more = materialize(dealt(split, mixed, "component").join(shingles.withColumnRenamed("node", "doc"), "doc")
                       .groupBy("bucket").applyInPandas(_link(percent), "u long, v long"), "table")
    if not more.isEmpty():
        found = components(links.union(more))

    joined = sets.select("same", "rep", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = joined.join(least, "component").select("same", "component_id")
    return (sized.where("slice is null").select("doc_id", "n_shingles", "same").join(of_set, "same", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
