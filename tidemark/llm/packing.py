"""Best-fit packing of documents into sequences of fixed capacity, under conflicts.

Bins are kept in order of what is left in them. Each carries a bitmap of its sources and of its
duplicate clusters; an item goes to the tightest bin that holds it and shares neither with it. The
successor search climbs a tree over the bins' residuals whose nodes hold what all bins below have in
common, so bins that conflict are passed over in whole subtrees and the first compatible one is exact.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text

CAPACITY = 2048
#: Pieces that one task packs. Rows are dealt out by a hash of their id, so every shard has its part of a hot source.
SHARD_ROWS = 8_000


def pack(sizes: list[int], source: list, cluster: list, capacity: int) -> list[int]:
    """The bin of each item: best fit in order of falling size, equal sizes in the given order.

    No bin has two items of one source or of one cluster (None conflicts with nothing), or holds more than capacity.
    """
    bit: dict[tuple, int] = {}
    many = Counter([("s", s) for s in source if s is not None] + [("c", c) for c in cluster if c is not None])
    for key, n in sorted(many.items(), key=lambda x: -x[1]):
        if n > 1:  # what occurs once can't conflict
            bit[key] = 1 << len(bit)
    taken: list[int] = []  # each bin's bitmap
    # bins by residual; tree[i] is the AND of the bitmaps of all bins below, and -1 (all bits) where there is none
    width = 1 << max(1, capacity.bit_length())
    tree = [-1] * (2 * width)
    at: list[dict[int, None]] = [{} for _ in range(width)]

    def refresh(residual: int) -> None:
        common = -1
        for b in at[residual]:
            common &= taken[b]
            if not common:
                break
        i = width + residual
        tree[i] = common
        while i > 1:
            i >>= 1
            if tree[i] == (now := tree[2 * i] & tree[2 * i + 1]):
                break
            tree[i] = now

    def tightest(size: int, mask: int) -> tuple[int, int] | None:
        """(residual, bin) of the smallest residual from size on with a bin that shares no bit with mask."""
        i = width + size
        while True:
            if tree[i] != -1 and not tree[i] & mask:  # not all bins below conflict
                if i >= width:
                    for b in at[i - width]:
                        if not taken[b] & mask:
                            return i - width, b
                else:
                    i *= 2
                    continue
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1

    out = [-1] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        mask = bit.get(("s", source[k]), 0) | bit.get(("c", cluster[k]), 0)
        if (found := tightest(sizes[k], mask)) is None:
            residual, b = capacity, len(taken)
            taken.append(0)
        else:
            residual, b = found
            del at[residual][b]
            refresh(residual)
        taken[b] |= mask
        at[residual - sizes[k]][b] = None
        refresh(residual - sizes[k])
        out[k] = b
    return out


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, cluster_col: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row (id, piece, n_tokens, shard, bin, place) for each piece of each row of docs.

    size_col: length in tokens; unset, the words of the text (runs without ASCII white space) and one separator.
    cluster_col: duplicate cluster; unset, documents with one whole text are a cluster.
    Documents longer than capacity are cut into pieces of capacity and a rest. place is the piece's offset in its
    bin. No two pieces of a source, or of a cluster, share a bin; rows with a null source or cluster conflict with
    nothing by it. Lengths that are null or below one count as one. Repeated rows are packed each. An empty table
    gives an empty result.
    """
    text = clean_text(docs, text_col)
    size = F.col(size_col).cast("long") if size_col else F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) + 1
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.substring(F.sha2(text.cast("binary"), 256), 1, 32)
    items = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)).alias("size"))
    pieces = items.withColumn("pieces", F.ceil(F.col("size") / capacity).cast("long")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    pieces = pieces.select("id", "source", "cluster", "piece", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("n_tokens"))
    shards = max(1, math.ceil((items.agg(F.sum(F.ceil(F.col("size") / capacity))).first()[0] or 0) / shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "cluster"), F.lit(shards)).cast("int"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "piece", "cluster", "source", "n_tokens"], na_position="last").reset_index(drop=True)
        value = lambda c: [None if pd.isna(x) else x for x in rows[c]]
        rows["bin"] = pack(rows["n_tokens"].tolist(), value("source"), value("cluster"), capacity)
        rows["place"] = rows.groupby("bin")["n_tokens"].cumsum() - rows["n_tokens"]
        return rows[["id", "piece", "n_tokens", "shard", "bin", "place"]].astype({"id": "Int64"})

    packed = dealt.groupBy("shard").applyInPandas(run, "id long, piece long, n_tokens long, shard int, bin long, place long")
    return packed.select(F.col("id").alias(id_col), "piece", "n_tokens", "shard", "bin", "place")
