"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

Adding a component sqrt(M^2 - |x|^2), with M the largest norm, makes the largest inner product the
smallest Euclidean distance, which is a metric. Vectors whose norms differ much are kept apart in bands with an M
each, so that one long vector doesn't drown the others. In each band a small tree built on a bounded sample deals
vectors out to shards that are regions of space. A query first searches one shard of the largest band; with the
inner product of its k-th hit it then visits only shards, and in their trees only subtrees, that the
triangle inequality can't rule out. A branch is left out once its lower bound exceeds `factor`
times the distance that belongs to that product: factor one is exact, smaller factors prune more. Candidates are
ranked by the product itself; distances only rule out, with room for their rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

K, FACTOR = 20, 1.0
#: Distinct vectors for each shard, vectors sampled for the dealing trees, vectors in a leaf, queries searched together.
SHARD_ROWS, SAMPLE, LEAF, BLOCK = 8_000, 4_000, 256, 1_024
#: Powers of two that a band's norms span; hits kept beyond k for products that differ by rounding only.
BAND, SPARE = 4, 8
_SLACK = 1e-7  # part of M + |q| that rounding can make of a distance


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - y) ** 2).sum(axis=-1), 0))


class Regions:
    """Dealing tree: halves space at the median distance from a vantage point, down to shards."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple] = []  # (vantage point, median, inside, outside) or the shard's number
        self.shards = 0
        rng = np.random.default_rng(7)

        def grow(x: np.ndarray, depth: int) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            if depth == 0 or len(x) < 4:
                self.nodes[at] = (self.shards,)
                self.shards += 1
                return at
            vp = x[rng.integers(len(x))]
            d = _apart(x, vp)
            mid = float(np.median(d))
            self.nodes[at] = (vp, mid, grow(x[d <= mid], depth - 1), grow(x[d > mid], depth - 1))
            return at

        grow(sample, max(0, math.ceil(math.log2(max(1, shards)))))

    def shard_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                inside = _apart(x[rows], node[0]) <= node[1]
                todo += [(node[2], rows[inside]), (node[3], rows[~inside])]
        return out

    def low(self, x: np.ndarray) -> np.ndarray:
        """(row, shard) lower bounds of the distance to what a shard holds: the largest along its path."""
        out = np.zeros((len(x), self.shards))
        todo = [(0, np.zeros(len(x)))]
        while todo:
            at, bound = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[:, node[0]] = bound
                continue
            d = _apart(x, node[0])
            todo += [(node[2], np.maximum(bound, d - node[1])), (node[3], np.maximum(bound, node[1] - d))]
        return out


class Bands:
    """Bands of norms, each with its largest norm, its regions and the number of its first shard."""

    def __init__(self, lows: list[int], norms: list[float], sizes: list[int], samples: list[np.ndarray], shard_rows: int):
        self.lows, self.norms, self.largest = np.array(lows), norms, int(np.argmax(sizes))  # lows: smallest exponents, rising
        self.regions = [Regions(_lift(x, m), math.ceil(n / shard_rows)) for x, m, n in zip(samples, norms, sizes, strict=True)]
        self.first = np.r_[0, np.cumsum([r.shards for r in self.regions])].astype(np.int32)

    def norm_of(self, shard: int) -> float:
        return self.norms[int(np.searchsorted(self.first, shard, side="right")) - 1]

    def shard_of(self, x: np.ndarray, exponent: np.ndarray) -> np.ndarray:
        out, band = np.zeros(len(x), np.int32), np.searchsorted(self.lows, exponent, side="right") - 1
        for b, r in enumerate(self.regions):
            rows = np.flatnonzero(band == b)
            out[rows] = self.first[b] + r.shard_of(_lift(x[rows], self.norms[b]))
        return out

    def home_of(self, q: np.ndarray) -> np.ndarray:
        return self.first[self.largest] + self.regions[self.largest].shard_of(_flat(q))

    def open(self, q: np.ndarray, least: np.ndarray, factor: float) -> np.ndarray:
        """(query, shard) where a product of at least `least` isn't ruled out."""
        out = []
        for m, r in zip(self.norms, self.regions, strict=True):
            out.append(r.low(_flat(q)) <= factor * _reach(q, least, m)[:, None] + _slack(q, m)[:, None])
        return np.concatenate(out, axis=1)


def _reach(q: np.ndarray, least: np.ndarray, norm: float) -> np.ndarray:
    """The distance, in a band of this norm, of a vector whose product with the query is `least`; negative where none can be so large."""
    square = norm * norm + (q * q).sum(axis=1) - 2 * least
    long = np.sqrt((q * q).sum(axis=1)) * norm
    with np.errstate(invalid="ignore"):
        return np.where(least > long * (1 + 1e-9), -np.inf, np.sqrt(np.maximum(square, 0)))


def _slack(q: np.ndarray, norm: float) -> np.ndarray:
    return _SLACK * (norm + np.sqrt((q * q).sum(axis=1)))


class Tree:
    """Vantage-point tree of one shard; batches of queries walk it together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, original: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids)
        self.x, self.ids, self.original, self.leaf = x[order], ids[order], original[order], leaf
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(11)
        stack = [(np.arange(len(x)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = at
            if len(rows) > leaf:
                vp = self.x[rows[rng.integers(len(rows))]]
                d = _apart(self.x[rows], vp)
                inside = d <= np.median(d)
                if inside.all() or not inside.any():  # as many as can be told apart
                    inside = np.arange(len(rows)) < len(rows) // 2
                self.nodes.append([vp, (d[inside].min(), d[inside].max()), (d[~inside].min(), d[~inside].max()), -1, -1])
                stack += [(rows[inside], at, 3), (rows[~inside], at, 4)]
            else:
                self.nodes.append([rows])

    def search(self, q: np.ndarray, k: int, least: np.ndarray, factor: float, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """(query x k products, places), largest first, ties to the smaller id; -infinity and -1 where there are fewer.

        least: what is known of each query's k-th product; smaller ones needn't be found.
        """
        best, at = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        floor, room, flat = least.copy(), _slack(q, norm), _flat(q)

        def visit(n: int, act: np.ndarray) -> None:
            if not len(act):
                return
            node = self.nodes[n]
            if len(node) == 1:
                rows = node[0]
                score = q[act] @ self.original[rows].T
                some = np.flatnonzero((score >= floor[act][:, None] - 1e-9 * np.abs(floor[act][:, None])).any(axis=1))
                act, score = act[some], score[some]
                both, places = np.concatenate([best[act], score], axis=1), np.concatenate([at[act], np.broadcast_to(rows, score.shape)], axis=1)
                order = np.lexsort((places, -both), axis=1)[:, :k]
                best[act], at[act] = np.take_along_axis(both, order, 1), np.take_along_axis(places, order, 1)
                floor[act] = np.maximum(floor[act], best[act][:, -1])
                return
            vp, near, far, inside, outside = node
            d = _apart(flat[act], vp)
            low = [np.maximum(np.maximum(lo - d, d - hi), 0) for lo, hi in (near, far)]
            first = low[0] <= low[1]
            for go, side, mine in ((inside, 0, first), (outside, 1, ~first), (outside, 1, first), (inside, 0, ~first)):
                visit(go, act[mine & (low[side] <= factor * _reach(q[act], floor[act], norm) + room[act])])

        for a in range(0, len(q), BLOCK):
            visit(0, np.arange(a, min(len(q), a + BLOCK)))
        return best, at


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _flat(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def _norms(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _vectors(batch["v"], dim)
        norm = np.sqrt((x * x).sum(axis=1))
        yield pa.record_batch([*batch.columns, pa.array(norm), pa.array(np.frexp(norm)[1].astype(np.int32))], [*batch.schema.names, "norm", "exponent"])


def _searcher(dim: int, sent, k: int, factor: float) -> Callable:  # noqa: ANN001
    """For rows (shard, kind, id, v, least) sorted by (shard, kind): a shard's vectors (kind 0), then its queries in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            shards, kinds, ids, least = (batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "kind", "id", "least"))
            x = _vectors(batch["v"], dim)
            cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])]) if len(shards) else []
            for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True):
                if shards[a] != shard:
                    shard, held, tree = shards[a], [], None
                if kinds[a] == 0:
                    held.append((x[a:b], ids[a:b]))
                    continue
                if not held:
                    continue
                norm = sent.value.norm_of(shard)
                if tree is None:
                    own = np.concatenate([h[0] for h in held])
                    tree = Tree(_lift(own, norm), np.concatenate([h[1] for h in held]), own)
                q = x[a:b]
                at = tree.search(q, k, least[a:b], factor, norm)[1]
                row, col = np.nonzero(at >= 0)
                hit = at[row, col]
                score = np.add.accumulate(q[row] * tree.original[hit], axis=1)[:, -1] if len(row) else np.zeros(0)
                yield pa.record_batch([pa.array(ids[a:b][row]), pa.array(tree.ids[hit]), pa.array(score)], ["query", "near", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each query the k vectors with the largest inner products, but itself.

    queries: rows of vectors (same columns). Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do those of another length than the most frequent (of equals, the shortest).
    Equal scores go to the smaller id. Equal vectors are searched once; of them the k + 1 smallest ids
    can rank and no others. Null ids take no part, repeated rows count once. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    mode = usable(vectors).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id long, rank int, vec_id long, score double"
    if mode is None:
        return spark.createDataFrame([], result.replace("vec_id", id_col))
    dim = mode["dim"]
    of = Window.partitionBy("v").orderBy("id")
    some = usable(vectors).where(F.size("v") == dim).distinct().withColumn("r", F.row_number().over(of)).where(F.col("r") <= k + 1)
    distinct = stored(some.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]), "distinct-vectors")
    distinct = stored(distinct.mapInArrow(lambda batches: _norms(batches, dim), "v array<double>, ids array<long>, id long, norm double, exponent int"), "normed-vectors")
    found = {r["exponent"]: (r["n"], r["norm"]) for r in distinct.groupBy("exponent").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()}  # some 2,000 exponents at most
    lows: list[int] = []
    for e in sorted(found):
        if not lows or e >= lows[-1] + BAND:
            lows.append(e)
    band_of = lambda e: int(np.searchsorted(lows, e, side="right")) - 1
    sizes, norms = [0] * len(lows), [0.0] * len(lows)
    for e, (n, norm) in found.items():
        sizes[band_of(e)] += n
        norms[band_of(e)] = max(norms[band_of(e)], norm)
    band = F.element_at(F.create_map(*[x for e in found for x in (F.lit(e), F.lit(band_of(e)))]), F.col("exponent"))
    by_hash = Window.partitionBy("band").orderBy("h", "id")
    sample = distinct.select(band.alias("band"), F.xxhash64("id").alias("h"), "id", "v").withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= max(64, SAMPLE // len(lows))).select("band", "v").collect()
    samples = [np.array([r["v"] for r in sample if r["band"] == b]) for b in range(len(lows))]
    bands = Bands(lows, norms, sizes, samples, shard_rows)
    sent = spark.sparkContext.broadcast(bands)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["id"], batch["v"], pa.array(sent.value.shard_of(_vectors(batch["v"], dim), batch["exponent"].to_numpy()))], ["id", "v", "shard"])

    dealt = stored(distinct.select("id", "v", "exponent").mapInArrow(deal, "id long, v array<double>, shard int"), "dealt")
    shards = int(bands.first[-1])

    asked = usable(queries).where(F.size("v") == dim).select("id", "v").distinct()
    links = stored(asked.join(distinct.select("v", F.col("id").alias("query"), F.lit(1).alias("one")), "v").select(F.col("id").alias("query_id"), "query"), "query-ids")
    own = links.select("query").distinct()

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["id"], batch["v"], pa.array(sent.value.home_of(_vectors(batch["v"], dim)))], ["id", "v", "shard"])

    probes = stored(dealt.join(own, dealt["id"] == own["query"], "left_semi").select("id", "v").mapInArrow(at_home, "id long, v array<double>, shard int"), "queries")
    none = F.lit(float("-inf"))
    base = dealt.select("shard", F.lit(0).alias("kind"), "id", "v", none.alias("least"))

    def searched(asks: DataFrame) -> DataFrame:
        parts = base.unionByName(asks).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind", "id")
        return stored(parts.mapInArrow(_searcher(dim, sent, k + 1 + SPARE, factor), "query long, near long, score double"), "hits")

    home = searched(probes.select("shard", F.lit(1).alias("kind"), "id", "v", none.alias("least")))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    reach = home.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k + 1).select("query", F.col("score").alias("least"))
    known = probes.join(reach, probes["id"] == reach["query"], "left").select("id", "v", "shard", F.coalesce("least", none).alias("least"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each other shard that a query has to visit."""
        for batch in (b.slice(a, 2_000) for b in batches for a in range(0, b.num_rows, 2_000)):
            home_shard, least = batch["shard"].to_numpy(), batch["least"].to_numpy()
            go = sent.value.open(_vectors(batch["v"], dim), least, factor)
            go[np.arange(len(home_shard)), home_shard] = False
            row, to = np.nonzero(go)
            of = pa.array(row)
            yield pa.record_batch([pa.array(to.astype(np.int32)), pa.array(np.ones(len(row), np.int32)), batch["id"].take(of), batch["v"].take(of), batch["least"].take(of)], ["shard", "kind", "id", "v", "least"])

    away = searched(known.mapInArrow(spread, "shard int, kind int, id long, v array<double>, least double"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    hits = home.unionByName(away).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("query", "near", "score")
    lists = hits.join(distinct.select(F.col("id").alias("near"), "ids"), "near").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    lists = stored(lists, "found")
    each = links.join(lists, "query").select("query_id", F.inline("found")).select("query_id", "score", F.explode("ids").alias("id")).where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
