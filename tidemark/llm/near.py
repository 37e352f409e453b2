"""SimHash near-dedup at a Jaccard similarity of 0.8 or more between sets of five-word shingles.

A similarity of 0.8 between sets of one size is a cosine of 8/9, and a SimHash bit of such a pair
differs with probability acos(8/9) / pi = 0.152. One 64-bit fingerprint can't tell such pairs from
others, so a text has WORDS fingerprints, a sketch. Tables of a few bits drawn from the sketch deal texts into
groups; the number of bits follows the number of texts, and the number of tables follows from the bits so that a
pair at 0.8 meets in a table with probability 1 - MISS. Within a group a Gray-order hierarchical
index finds pairs whose fingerprints are near enough, and pairs link only once their exact similarity is known.

Pairs of a dense group are not all made: each text is tried with its nearest ones first. Only where
texts of a group are still apart after that, those outside the group's largest component
meet all others, so no link between components is lost. They are compared where they meet, and only
pairs that join two components leave: rows grow with texts, not with the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, stored
from tidemark.llm.simhash import GrayIndex, components, gray_rank, unite

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Fingerprints in a sketch; texts that a group of unlike texts holds; pairs at the similarity that no table brings together.
WORDS, GROUP, MISS = 16, 64, 1e-3
#: Standard deviations beyond the mean that one and two fingerprints of a pair at the similarity may differ by in a table,
#: and the part of such pairs that pass there; the same for word 0 and the whole sketch where a pair is tested once.
IN_TABLE, PASS, ONCE = (2.5, 2.0), 0.94, (4.0, 3.3)
#: In a group beyond DENSE texts, or with more than CROWD near pairs a text, each text is tried first with the
#: NEAREST of its nearest ones and of those nearest to all.
DENSE, CROWD, NEAREST = 512, 2, 3
#: Rows gathered before a search, and with whole sets; shingles of one open group that a task compares with as many others.
GATHER, GATHER_SETS, BLOCK = 1 << 15, 1 << 12, 1 << 22
#: Pairs that are compared at a time, by sketches and by sets.
BY_SKETCH, BY_SET = 1 << 15, 1 << 12
_RANDOM = np.random.default_rng(SEED)
_XOR, _TIMES = (_RANDOM.integers(0, 1 << 64, WORDS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def differing(similarity: float) -> float:
    """Part of the bits that differ at this Jaccard similarity of two sets of one size; of others fewer do."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def _most(similarity: float, bits: int, deviations: float) -> int:
    p = differing(similarity)
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def shingles(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle_words:
        words, shingle_words = [b" ".join(words)], 1
    of, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([of(join(run), SEED) for run in zip(*(words[i:] for i in range(shingle_words)), strict=False)], np.uint64))


def sketch(of: np.ndarray) -> np.ndarray:
    """The WORDS fingerprints of a set of hashes."""
    votes = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(of), 512):  # bounds the memory of long texts
        mixed = (of[a : a + 512, None] ^ _XOR) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        votes += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(votes * 2 > len(of), bitorder="little").view(np.uint64)


def tables(n: int, similarity: float = SIMILARITY) -> np.ndarray:
    """Places of the bits of each table for n texts, (tables x bits)."""
    bits = max(4, math.ceil(math.log2(max(1, n / GROUP))))
    same = 1 - _most(similarity, 64 * WORDS, 2) / (64 * WORDS)
    count = math.ceil(math.log(MISS) / math.log1p(-PASS * same**bits))
    random = np.random.default_rng(SEED)
    return np.stack([random.choice(64 * WORDS, bits, replace=False) for _ in range(count)])


def _sketched(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            found = [shingles(t.as_py(), shingle_words) for t in part["text"].cast(pa.binary())]
            sketches = [sketch(s).tobytes() if len(s) else b"" for s in found]
            yield pa.record_batch([part["id"], part["key"], pa.array([len(s) for s in found], pa.int64()), pa.array(sketches, pa.binary())], ["id", "key", "n", "sketch"])


def _words(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, WORDS)


def _dealt(batches: Iterator[pa.RecordBatch], places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, sketch) to one row a table: (value, key, two fingerprints, n)."""
    power = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            words = _words(part["sketch"])
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            for t, at in enumerate(places):
                value = pa.array((bits[:, at] @ power) + (np.int64(t) << np.int64(44)))
                two = words[:, [2 * t % WORDS, (2 * t + 1) % WORDS]].view(np.int64)
                yield pa.record_batch([value, part["key"], pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), part["n"].cast(pa.int32())], ["value", "key", "w", "x", "n"])


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], gather: int = GATHER) -> Iterator[list]:
    """Columns of whole groups of a value, gathered to some rows, from rows sorted by value."""
    rest: list | None = None
    for batch in batches:
        now = [_words(batch[c]) if c == "sketch" else batch[c].to_numpy(zero_copy_only=False) for c in names]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = np.flatnonzero(rest[0][1:] != rest[0][:-1]) if len(rest[0]) >= gather else []
        if len(cut):
            yield [x[: cut[-1] + 1] for x in rest]
            rest = [x[cut[-1] + 1 :] for x in rest]
    if rest is not None and len(rest[0]):
        yield rest


def _middle(w: np.ndarray, x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the place of the row of its group, contiguous, that differs least from all the others together."""
    bits = np.unpackbits(np.stack([w, x], axis=1).view(np.uint8), axis=1)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    ones = np.add.reduceat(bits.astype(np.int32), starts, axis=0)
    out = np.zeros(len(group), np.int64)
    for at, size, one in zip(starts, sizes, ones, strict=True):
        apart = bits[at : at + size] @ (size - 2 * one)
        out[at : at + size] = at + np.argmin(apart)
    return out


def _sized(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes may reach the similarity."""
    return np.minimum(n, m) >= similarity * np.maximum(n, m)


def _tried(batches: Iterator[pa.RecordBatch], near: tuple[int, int], similarity: float | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (value, key, w, x) sorted by value to near pairs (a, b, apart, kind).

    kind 0: every near pair of a group; 1: some of an open group; 2: its members, as (value, key, n). With a similarity
    rows also have the size n of their set, and pairs are left out whose sizes rule it out.
    """

    def out(a: np.ndarray, b: np.ndarray, apart: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(apart.astype(np.int32)), pa.array(kind.astype(np.int32))], ["a", "b", "apart", "kind"])

    for value, key, w, x, *sizes in _groups(batches, ("value", "key", "w", "x") + (("n",) if similarity else ())):
        n = sizes[0] if similarity else np.zeros(len(key), np.int32)
        group = np.cumsum(np.r_[False, value[1:] != value[:-1]])
        size = np.bincount(group)
        several = size[group] > 1
        value, key, w, x, n, group = value[several], key[several], w[several].view(np.uint64), x[several].view(np.uint64), n[several], group[several]
        if not len(key):
            continue
        order = np.lexsort((gray_rank(w), group))
        value, key, w, x, n, group = value[order], key[order], w[order], x[order], n[order], group[order]
        dense = size[group] > DENSE
        apart_of = lambda a, b: np.bitwise_count(w[a] ^ w[b]).astype(np.int32) + np.bitwise_count(x[a] ^ x[b])  # noqa: E731,B023
        sized = lambda a, b: _sized(n[a], n[b], similarity or 0)  # noqa: E731,B023
        found = []
        small = np.flatnonzero(~dense)
        if len(small):
            index = GrayIndex(w[small], np.cumsum(np.r_[False, group[small][1:] != group[small][:-1]]))
            for a, b in index.pairs(near[0]):
                a, b = small[a], small[b]
                apart = apart_of(a, b)
                ok = (apart <= near[1]) & sized(a, b)
                found.append((a[ok], b[ok], apart[ok]))
        a = np.flatnonzero(dense[:-1] & (group[1:] == group[:-1])) if len(group) > 1 else np.zeros(0, np.int64)  # neighbours in Gray order
        apart = apart_of(a, a + 1)
        ok = (apart <= near[1]) & sized(a, a + 1)
        found.append((a[ok], a[ok] + 1, apart[ok]))
        a, b, apart = (np.concatenate(c) for c in zip(*found, strict=True))
        crowded = np.bincount(group[a], minlength=len(size)) > CROWD * size
        opened = dense | crowded[group]
        if opened.any():  # of these the nearest of each text, and all with the text nearest to all
            many = crowded[group[a]]
            of, to, d = np.r_[a[many], b[many]], np.r_[b[many], a[many]], np.r_[apart[many], apart[many]]
            order = np.lexsort((d, of))
            of, to, d = of[order], to[order], d[order]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            rows = np.flatnonzero(opened)
            middle = _middle(w[rows], x[rows], group[rows])
            far = rows[middle != np.arange(len(rows))]
            hub = rows[middle[middle != np.arange(len(rows))]]
            fit = sized(far, hub)
            far, hub = far[fit], hub[fit]
            a, b, apart = np.r_[a[~many], of[first], far], np.r_[b[~many], to[first], hub], np.r_[apart[~many], d[first], apart_of(far, hub)]
        yield out(np.minimum(key[a], key[b]), np.maximum(key[a], key[b]), apart, opened[a])
        open_ = np.flatnonzero(opened)
        yield out(value[open_], key[open_], n[open_], np.full(len(open_), 2))


def _common(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes that the sets a[i] and b[i] share, pairs sorted by a; a set's hashes are in order."""
    out = np.zeros(len(a), np.int64)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
    for at, end in zip(starts, [*starts[1:], len(a)], strict=True):
        one, others = sets[a[at]], sets[b[at:end]]
        ends = np.cumsum([len(o) for o in others])
        flat = np.concatenate(others)
        shared = one[np.minimum(one.searchsorted(flat), len(one) - 1)] == flat
        out[at:end] = np.add.reduceat(shared, np.r_[0, ends[:-1]], dtype=np.int64)
    return out


def _met(batches: Iterator[pa.RecordBatch], near: int, most: int, places: np.ndarray, similarity: float | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (value, other, key, root, number, numbers, sketch) sorted by value to pairs of two components.

    other: 0 for rows that are only met, 1 for those that also meet, 2 for those that only meet others.
    number: the table; numbers: all tables where the text is in such a group. A pair comes from the first table that it shares.
    With a similarity rows also have their set, and of pairs that reach it those come that join components.
    """
    power = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
    names = ("value", "other", "key", "root", "number", "numbers", "sketch")
    step = BY_SET if similarity else BY_SKETCH
    for value, *columns in _groups(batches, names + (("set",) if similarity else ()), GATHER_SETS if similarity else GATHER):
        group = np.cumsum(np.r_[False, value[1:] != value[:-1]])
        order = np.lexsort((gray_rank(columns[5][:, 0]), group))
        group, other, key, root, number, numbers, sketches, *sets = (v[order] for v in (group, *columns))
        bits = np.unpackbits(sketches.view(np.uint8), axis=1, bitorder="little")
        values = np.stack([bits[:, at] @ power for at in places], axis=1)
        in_table = np.zeros((len(key), len(places)), bool)
        in_table[np.repeat(np.arange(len(key)), [len(n) for n in numbers]), np.concatenate(numbers)] = True
        before = np.arange(len(places))[None] < number[:, None]
        first, of = np.unique(root, return_index=True, return_inverse=True)[1:]
        label = first[of]  # of each component, as far as it is known here
        if similarity:
            sets = np.fromiter((s.view(np.uint64) for s in sets[0]), object, len(key))
            n = np.array([len(s) for s in sets])
        for a, b in GrayIndex(sketches[:, 0], group).pairs(near, np.flatnonzero(other)):
            ok = (label[a] != label[b]) & (key[a] != key[b]) & (other[b] != 2)
            if similarity:
                ok &= _sized(n[a], n[b], similarity)
            a, b = a[ok], b[ok]
            for c in range(0, len(a), BY_SKETCH):
                i, j = a[c : c + BY_SKETCH], b[c : c + BY_SKETCH]
                ok = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int32) <= most
                i, j = i[ok], j[ok]
                new = ~((values[i] == values[j]) & in_table[i] & before[i]).any(axis=1)
                i, j = i[new], j[new]
                for d in range(0, len(i), step):
                    x, y = i[d : d + step], j[d : d + step]
                    if similarity:
                        x, y = (v[label[x] != label[y]] for v in (x, y))
                        order = np.argsort(x, kind="stable")
                        x, y = x[order], y[order]
                        common = _common(sets, x, y)
                        ok = common >= similarity * (n[x] + n[y] - common)
                        x, y = x[ok], y[ok]
                        once = np.unique(np.stack([label[x], label[y]], axis=1), axis=0, return_index=True)[1] if len(x) else []
                        x, y = x[once], y[once]
                        label = unite(label, x, y)
                    low, high = np.minimum(key[x], key[y]), np.maximum(key[x], key[y])
                    once = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)  # both may be outside the largest component
                    yield pa.record_batch([pa.array(once[:, 0].copy()), pa.array(once[:, 1].copy())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            sets = [shingles(t.as_py(), shingle_words).view(np.int64) for t in part["text"].cast(pa.binary())]
            yield pa.record_batch([part["key"], pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])


def similar_texts(rows: DataFrame, prints: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(u, root) for the keys that link: rows (key, text), prints (key, n, sketch) with one row a key."""
    places = tables(prints.count(), similarity)
    near = _most(similarity, 64, IN_TABLE[0]), _most(similarity, 128, IN_TABLE[1])
    dealt = prints.select("key", "n", "sketch").mapInArrow(partial(_dealt, places=places), "value long, key long, w long, x long, n int")
    searched = dealt.repartition("value").sortWithinPartitions("value").mapInArrow(partial(_tried, near=near, similarity=similarity), "a long, b long, apart int, kind int")
    found = stored(searched, "near-pairs")
    # the more tables propose a pair, the more alike it is
    proposed = found.where("kind < 2").groupBy("a", "b").agg(F.count("*").alias("times"), F.min("apart").alias("apart"))
    sides = proposed.select("a", "b", "times", "apart", F.explode(F.array("a", "b")).alias("of"))
    nearest = Window.partitionBy("of").orderBy(F.desc("times"), "apart", "a", "b")
    first = stored(sides.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= NEAREST).select("a", "b").distinct(), "first-pairs")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    members = found.where("kind < 2").select(F.explode(F.array("a", "b")).alias("key")).unionByName(found.where("kind = 2").select(F.col("b").alias("key"))).distinct()
    sets = stored(rows.join(members, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(partial(_sets, shingle_words=shingle_words), "key long, set array<long>"), "sets")

    def linked(some: DataFrame) -> DataFrame:
        """Pairs (u, v) that reach the similarity; one side's sets travel once a text, the other's once a pair."""
        one = some.join(sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), "a")
        both = one.join(sets.select(F.col("key").alias("b"), F.col("set").alias("set_b")), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        alike_enough = common >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - common)
        return stored(both.where(alike_enough).select(F.col("a").alias("u"), F.col("b").alias("v")), "linked")

    edges = linked(first)
    classes = stored(components(edges), "classes")
    root = lambda df, key, name: df.join(classes.select(F.col("u").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    apart = lambda df: root(root(df, "a", "root_a"), "b", "root_b").where("root_a <> root_b").select("a", "b")
    later = apart(pairs).join(first, ["a", "b"], "left_anti")
    # groups with texts of several components: those outside the largest one meet every text of the group
    open_ = stored(root(found.where("kind = 2").select(F.col("a").alias("value"), F.col("b").alias("key"), F.col("apart").alias("n")), "key", "root"), "open")
    of_root, of_value = Window.partitionBy("value", "root"), Window.partitionBy("value")
    sized_open = open_.repartition("value").withColumn("alike", F.count("*").over(of_root))
    most = F.max_by("root", F.struct("alike", "root")).over(of_value)
    mixed = sized_open.select("value", "key", "root", most.alias("most"), F.sum("n").over(of_value).alias("held"), F.min("root").over(of_value).alias("low"), F.max("root").over(of_value).alias("high")).where("low <> high")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    # a text meets its sketch and its set once, not once a table
    number = F.shiftright("value", 44).cast("int").alias("number")
    tables_of = mixed.groupBy("key").agg(F.collect_list(F.struct("value", "root", (F.col("root") != F.col("most")).alias("outside"), blocks.alias("blocks"), number)).alias("of"))  # as many as there are tables at most
    spread = prints.select("key", "sketch").join(tables_of, "key").join(sets, "key").select("key", "sketch", "set", F.array_distinct("of.number").alias("numbers"), F.inline("of"))
    # a large group is cut into blocks; in cell (i, j) the texts of block i outside its largest component meet block j
    own, every = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda i, j, other: F.struct((i * F.col("blocks") + j).alias("cell"), F.lit(other).alias("other"))
    here = F.transform(every, lambda i: cell(i, own, 0))
    both = F.concat(F.array(cell(own, own, 1)), *(F.transform(F.filter(every, lambda i: i != own), f) for f in (lambda i: cell(i, own, 0), lambda j: cell(own, j, 2))))
    spread = spread.select("value", "key", "root", "number", "numbers", "sketch", "set", F.inline(F.when(F.col("outside"), both).otherwise(here)))
    spread = spread.withColumn("value", F.xxhash64("value", "cell")).drop("cell").repartition("value").sortWithinPartitions("value")
    met = spread.mapInArrow(partial(_met, near=_most(similarity, 64, ONCE[0]), most=_most(similarity, 64 * WORDS, ONCE[1]), places=places, similarity=similarity), "a long, b long")
    more = stored(linked(later).unionByName(met.select(F.col("a").alias("u"), F.col("b").alias("v"))), "more-links")
    if not more.limit(1).count():
        return classes
    return stored(components(edges.unionByName(more)), "classes")


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that name their component (the smallest id); rows of components without ids stay.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into shingles of words; null
    counts as empty, and texts without words link. Null ids take part, but never name a component. Rows that repeat
    the naming id all stay. An empty table gives an empty result; other columns stay as they are.
    """
    text = clean_text(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    prints = stored(rows.mapInArrow(partial(_sketched, shingle_words=shingle_words), "id long, key long, n long, sketch binary"), "sketches")
    one = prints.where("n > 0").select("key", "n", "sketch").dropDuplicates(["key"])
    classes = similar_texts(rows.select("key", "text"), stored(one, "distinct-sketches"), shingle_words, similarity)
    rooted = stored(prints.select("id", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(classes, F.col("key") == F.col("u"), "left").select("id", F.coalesce("root", "key", F.lit(0).cast("long")).alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("id").alias("low"), F.count("*").alias("size")).where("size > 1").select(F.col("root").alias("__root"), "low")
    lost = stored(rooted.join(named, F.col("root") == F.col("__root")).where("id <> low").select(F.col("id").alias("__id")).distinct(), "lost")
    return docs.join(lost, F.col(id_col).cast("long") == F.col("__id"), "left_anti")
