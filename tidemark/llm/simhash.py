"""SimHash near-dedup: fingerprints that differ in few bits link, linked rows form components.

The search is a Gray-order hierarchical index. Two fingerprints within `distance` bits agree on at
least one of distance + 1 blocks of bits, so rows are dealt out by (block, its value). Within such
a group they are sorted by Gray rank, which puts similar ones side by side; runs of neighbours get
a node that keeps the bits they share (mask and pattern), runs of nodes get one above it, and a
child only keeps the bits its parent does not. A query walks down from the root, adds up the
differences of each node's own bits and drops a whole group once they exceed the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, stored

SHINGLE_WORDS, DISTANCE, SEED = 3, 3, 42
FANOUT = 8
#: Distinct fingerprints that share a block value before the group is dealt out again by further bits.
HOT_GROUP = 50_000
#: (query, node) pairs held at a time while searching, and rows gathered before a search.
FRONTIER, GATHER = 1 << 19, 1 << 16
_ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint, unsigned; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        words, shingle_words = [b" ".join(words)], 1
    of, join, votes, n = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64), len(words) - shingle_words + 1
    for a in range(0, n, 8192):  # bounds the memory of long texts
        part = words[a : min(n, a + 8192) + shingle_words - 1]
        runs = zip(*(part[i:] for i in range(shingle_words)), strict=False)
        hashes = np.array([of(join(run), SEED) for run in runs], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        found = np.array([fingerprint(t.as_py(), shingle_words) for t in texts], np.uint64)
        yield pa.record_batch([batch["id"], pa.array(found.view(np.int64))], ["id", "fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over groups of fingerprints, each group sorted by Gray rank and contiguous."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        self.codes, self.group = codes, group
        same, pattern = np.full(len(codes), _ALL), codes
        first, last, of = np.arange(len(codes)), np.arange(len(codes)), group
        levels = [(same, pattern, None, None, last)]
        while True:
            starts_group = np.r_[True, of[1:] != of[:-1]]
            place = np.arange(len(of)) - np.maximum.accumulate(np.where(starts_group, np.arange(len(of)), 0))
            if not place.any():
                break
            starts = np.flatnonzero(place % fanout == 0)
            ones = np.bitwise_and.reduceat(pattern | ~same, starts)  # bits set wherever they are shared below
            zeros = np.bitwise_and.reduceat(~pattern | ~same, starts)
            shared = np.bitwise_and.reduceat(same, starts) & (ones | zeros)
            ends = np.r_[starts[1:], len(of)]
            up = shared, ones & shared
            child_shared = np.repeat(shared, ends - starts)
            levels[-1] = (same & ~child_shared, pattern & ~child_shared, *levels[-1][2:])  # factored out into the parent
            same, pattern, of, last = *up, of[starts], last[ends - 1]
            levels.append((same, pattern, starts, ends, last))
        self.levels, self.root_of = levels, of

    def pairs(self, distance: int = DISTANCE, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair (a, b) of places, a < b, in one group and at most distance bits apart; in blocks.

        With queries, places, every pair of a query a and any b of its group instead, itself included.
        """
        root = np.searchsorted(self.root_of, self.group)
        top = len(self.levels) - 1
        same, pattern = self.levels[top][:2]
        every = np.arange(len(self.codes)) if queries is None else queries
        for a in range(0, len(every), FRONTIER):
            query = every[a : a + FRONTIER]
            node = root[query]
            apart = np.bitwise_count((self.codes[query] ^ pattern[node]) & same[node])
            todo = [(top, query, node, apart)]
            while todo:
                level, query, node, apart = todo.pop()
                own, pat, starts, ends, last = self.levels[level]
                ok = apart <= distance
                if queries is None:
                    ok &= last[node] > query
                query, node, apart = query[ok], node[ok], apart[ok]
                if not len(query):
                    continue
                if level == 0:
                    yield query, node
                    continue
                width = ends[node] - starts[node]
                for cut in range(0, len(query), max(1, FRONTIER // FANOUT)):
                    part = slice(cut, cut + max(1, FRONTIER // FANOUT))
                    w = width[part]
                    child = np.repeat(starts[node[part]] - np.r_[0, np.cumsum(w)[:-1]], w) + np.arange(w.sum())
                    q, below = np.repeat(query[part], w), self.levels[level - 1]
                    todo.append((level - 1, q, child, np.repeat(apart[part], w) + np.bitwise_count((self.codes[q] ^ below[1][child]) & below[0][child])))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label after joining a[i] with b[i]; label[x] is the smallest place of x's class."""
    while True:
        x, y = label[a], label[b]
        if not (differ := x != y).any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
        label = up


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp) sorted by (mask, value) to a spanning forest (u, v) of the links in each group."""

    def found(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        alone = np.bincount(group)[group] == 1
        group, fp = group[~alone], fp[~alone]
        if not len(fp):
            return pa.record_batch([pa.array([], pa.int64())] * 2, ["u", "v"])
        order = np.lexsort((gray_rank(fp), group))
        group, fp = group[order], fp[order]
        group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
        label = np.arange(len(fp))
        for a, b in GrayIndex(fp, group).pairs(distance):
            label = unite(label, a, b)
        child = np.flatnonzero(label != np.arange(len(fp)))
        return pa.record_batch([pa.array(fp[child].view(np.int64)), pa.array(fp[label[child]].view(np.int64))], ["u", "v"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch["mask"].to_numpy(), batch["value"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if len(rest[0]) < GATHER:
            continue
        cut = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1]))
        if len(cut):
            cut = cut[-1] + 1
            yield found(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
    if rest is not None and len(rest[0]):
        yield found(*rest)


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside mask, cut into `parts` runs; each run joined with mask, as signed 64-bit numbers."""
    free = [i for i in range(64) if not mask >> i & 1]
    out = []
    for p in range(parts):
        x = mask | sum(1 << i for i in free[len(free) * p // parts : len(free) * (p + 1) // parts])
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT_GROUP) -> DataFrame:
    """Edges (u, v) that connect just what pairs of distinct fingerprints within `distance` bits connect.

    prints: distinct signed 64-bit fingerprints in column fp. A group beyond `hot` is dealt out
    again by blocks of its remaining bits, as the same argument holds for them; groups then
    share so many bits that they are bounded by the codes that are left.
    """
    masks = _blocks(0, distance + 1)
    rows = prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    done = []
    for _ in range(4):
        crowded = stored(rows.groupBy("mask", "value").count().where(F.col("count") > hot).drop("count"), "crowded")
        if not crowded.limit(1).count():
            break
        done.append(rows.join(crowded, ["mask", "value"], "left_anti").select("mask", "value", "fp"))
        finer = {m: _blocks(m % (1 << 64), distance + 1) for m in masks}
        masks = sorted({m for f in finer.values() for m in f})
        choice = F.create_map(*[x for m, f in finer.items() for x in (F.lit(m), F.array(*map(F.lit, f)))])
        again = stored(rows.join(crowded, ["mask", "value"], "left_semi").select("fp", "mask"), "again")
        rows = again.select("fp", F.explode(choice[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
    for part in done:
        rows = rows.select("mask", "value", "fp").unionByName(part)
    dealt = rows.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(partial(_search, distance=distance), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of edges (u, v): the smallest vertex that it reaches.

    Alternating large-star and small-star steps until the edges stay as they are. Minima are
    aggregated before the shuffle and written, so that a hub's edges can be split in the join.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = print_of(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "low")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        edges = stored(small.distinct(), "edges")
        if (after := print_of(edges)) == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE, hot: int = HOT_GROUP) -> DataFrame:
    """One row (id, fingerprint, component_id, n_linked) for each row of docs.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into shingles of words;
    null counts as empty, and texts without words have fingerprint zero and link like others.
    component_id is the smallest id reachable, n_linked the number of rows in the component.
    Null ids take part, but never name a component (null if it has no other). Repeated
    rows each give a row. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), clean_text(docs, text_col).alias("text"))
    prints = stored(rows.mapInArrow(partial(_fingerprints, shingle_words=shingle_words), "id long, fp long"), "fingerprints")
    one = stored(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct")
    classes = stored(components(links(one.select("fp"), distance, hot)), "classes")
    rooted = one.join(classes, one["fp"] == classes["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "n")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("n_linked"))
    member = stored(rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("__fp"), "component_id", "n_linked"), "members")
    return prints.join(member, prints["fp"] == member["__fp"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked")
