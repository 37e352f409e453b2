"""Exact dedup over an extendible-hash index kept as files in the shared folder.

Keys are 64-bit hashes of whole texts. A directory of 2^depth slots, indexed by the leading bits of
the key, points at buckets; a bucket with more keys than its capacity splits by one more bit, and
the directory doubles when a bucket is as deep as it. Owner tasks take ranges of buckets, chain
the entries of a key and compare texts byte by byte, so two texts that share a key stay apart.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, scratch

#: Distinct keys that a bucket holds before it splits, and slots of the largest directory (broadcast, 8 MB). With more
#: keys than these slots' buckets hold, buckets hold more; owner tasks read them sorted, so memory stays as it is.
BUCKET_KEYS, SLOTS = 8_000, 1 << 20
#: Bytes of text that a task holds while it folds repeated texts of its own rows.
FOLD_BYTES = 16 << 20


def grow_directory(histogram: dict[int, int], capacity: int = BUCKET_KEYS, max_depth: int = 14) -> tuple[int, list[int]]:
    """(depth, directory): directory[slot] is the bucket of the keys with those leading bits.

    histogram: distinct keys by their leading max_depth bits, so it has at most 2^max_depth entries.
    A bucket is named by the first slot, at max_depth, that it covers.
    """
    sums = [0]
    for i in range(1 << max_depth):
        sums.append(sums[-1] + histogram.get(i, 0))
    depth, directory, todo = 0, [0], [(0, 0)]
    while todo:
        first, local = todo.pop()
        width = 1 << (max_depth - local)
        if local == max_depth or sums[first + width] - sums[first] <= capacity:
            continue
        if local == depth:  # directory doubling: every slot becomes two
            directory, depth = [b for b in directory for _ in (0, 1)], depth + 1
        half = first + width // 2
        shift = max_depth - depth
        for slot in range(half >> shift, (first + width) >> shift):
            directory[slot] = half
        todo += [(first, local + 1), (half, local + 1)]
    return depth, directory


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _merge(link: list, keep: int | None, n: int, n_keep: int) -> None:
    """Adds copies to link = [keep, n, n_keep]: the largest id, the rows, the rows that carry that id."""
    link[1] += n
    if keep == link[0]:
        link[2] += n_keep
    elif link[0] is None or (keep is not None and keep > link[0]):
        link[0], link[2] = keep, n_keep


def _folder(sent, depth: int) -> Callable:  # noqa: ANN001
    """Rows (key, id, text) to (bucket, key, text, keep, n, n_keep): texts that a task repeats become one entry."""
    names = ("key", "text", "keep", "n", "n_keep", "bucket")
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def lot(held: dict) -> pa.RecordBatch:
        keys = np.fromiter((k for k, _ in held), np.int64, len(held)).view(np.uint64)
        slots = keys >> np.uint64(64 - depth) if depth else np.zeros(len(keys), np.uint64)
        buckets = sent.value[slots.astype(np.int64)].tolist()
        return _batch([(*k, *v, b) for (k, v), b in zip(held.items(), buckets, strict=True)], names, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold(batches, lot)

    return run


def _fold(batches: Iterator[pa.RecordBatch], lot: Callable) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    size = 0
    for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
        for key, i, text in zip(batch["key"].to_pylist(), batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            if (link := held.get((key, text))) is None:
                held[key, text] = [i, 1, 1]
                size += len(text) + 200
                if size > FOLD_BYTES:
                    yield lot(held)
                    held.clear()
                    size = 0
            else:
                _merge(link, i, 1, 1)
    if held:
        yield lot(held)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's entries, sorted by (bucket, key): chains those of a key and compares their bytes."""
    names = ("bucket", "key", "slot", "sha", "keep_id", "group_size", "n_keep")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    last: tuple | None = None
    chain: dict[bytes, tuple[str, list]] = {}
    done: list[tuple] = []

    def close() -> None:
        done.extend((*last, slot, sha, *link) for slot, (sha, link) in enumerate(chain.values()))
        chain.clear()

    for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
        for bucket, key, sha, text, *link in zip(*(batch[c].to_pylist() for c in ("bucket", "key", "sha", "text", "keep", "n", "n_keep")), strict=True):
            if (bucket, key) != last:
                close()
                last = (bucket, key)
                if len(done) >= 5000:
                    yield _batch(done, names, types)
                    done.clear()
            if text in chain:  # equal only if every byte is
                _merge(chain[text][1], *link)
            else:
                chain[text] = (sha, link)
    close()
    if done:
        yield _batch(done, names, types)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS) -> tuple[str, DataFrame]:
    """(path, index): the index is one row per distinct text (bucket, key, slot, sha, keep_id, group_size).

    Files below path: `directory` (slot, bucket) and `buckets`. keep_id is the largest id (null ids lose).
    """
    spark = docs.sparkSession
    path = scratch(spark, "extendible-hash")
    text = clean_text(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    keys = rows.select("key").distinct()
    n = keys.agg(F.approx_count_distinct("key")).first()[0]  # only decides how deep the histogram goes
    capacity = max(capacity, math.ceil(8 * n / SLOTS))
    bits = min(SLOTS.bit_length() - 1, max(1, math.ceil(math.log2(max(2, 8 * n / capacity)))))
    lead = F.shiftrightunsigned("key", 64 - bits).cast("int").alias("lead")
    # SLOTS counts at most come to the driver, whatever the number of rows
    histogram = {r["lead"]: r["n"] for r in keys.select(lead).groupBy("lead").agg(F.count("*").alias("n")).collect()}
    depth, directory = grow_directory(histogram, capacity, bits)
    spark.createDataFrame([(i, b) for i, b in enumerate(directory)], "slot int, bucket long").write.parquet(f"{path}/directory")
    sent = spark.sparkContext.broadcast(np.array(directory, np.int64))
    entries = rows.select("key", "id", "text").mapInArrow(_folder(sent, depth), "key long, text binary, keep long, n long, n_keep long, bucket long")
    owned = entries.select("bucket", "key", F.sha2("text", 256).alias("sha"), "text", "keep", "n", "n_keep")
    owners = owned.repartition("bucket").sortWithinPartitions("bucket", "key")
    owners.mapInArrow(_own, "bucket long, key long, slot int, sha string, keep_id long, group_size long, n_keep long").write.parquet(f"{path}/buckets")
    return path, spark.read.parquet(f"{path}/buckets")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256.

    Null texts count as empty, texts differ by any byte, of equal texts the largest id stays. A row
    with a null id is kept only where no row of its group has an id. Rows that repeat both id and
    text form one group and share the value of kept. Other columns stay as they are; an input
    column with the name of an added one is replaced. An empty table gives an empty result.
    """
    return _marked(docs, build_index(docs, id_col, text_col, capacity)[1], id_col, text_col).drop("__key")


def _marked(docs: DataFrame, index: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    added = {"__key": F.xxhash64(clean_text(docs, text_col)), "text_sha256": F.sha2(clean_text(docs, text_col).cast("binary"), 256)}
    groups = index.select(F.col("key").alias("__k"), F.col("sha").alias("__s"), "keep_id", "group_size")
    out = keyed.withColumns(added).join(groups, (F.col("__key") == F.col("__k")) & (F.col("text_sha256") == F.col("__s"))).drop("__k", "__s")
    return out.withColumn("kept", F.col(id_col).cast("long").eqNullSafe(F.col("keep_id")))


def keep_one_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of docs as they are: that with the largest id.

    Null texts count as empty. Where rows repeat both id and text, any one of them stays. An empty table gives an
    empty result.
    """
    index = build_index(docs, id_col, text_col)[1]
    mark = uuid.uuid4().hex  # no column of docs has such a name
    key, sha, keep, n_keep = (f"{c}_{mark}" for c in ("key", "sha", "keep", "n_keep"))
    text = clean_text(docs, text_col)
    keyed = docs.withColumns({key: F.xxhash64(text), sha: F.sha2(text.cast("binary"), 256)})
    groups = index.select(F.col("key").alias(f"k_{mark}"), F.col("sha").alias(f"s_{mark}"), F.col("keep_id").alias(keep), F.col("n_keep").alias(n_keep))
    kept = keyed.join(groups, (F.col(key) == F.col(f"k_{mark}")) & (F.col(sha) == F.col(f"s_{mark}"))).where(F.col(id_col).cast("long").eqNullSafe(F.col(keep)))
    if index.where("n_keep > 1").limit(1).count():
        kept = kept.dropDuplicates([key, sha])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
