"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, L1 leaves most weights at exactly zero, and the rest is
a sparse vector of at most 2^HASH_BITS entries, which is what gets broadcast for scoring.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, held_out

HASH_BITS = 20
#: Bound of the sample of labelled rows that the classifier is fitted on, and rows for each learner.
SAMPLE_ROWS, SHARD_ROWS = 40_000, 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_CACHE = 100_000


class _WordHash(dict):
    """Word to a 32-bit hash; when it holds many words, others are hashed each time."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) < _CACHE:
            self[word] = value
        return value


def features(texts: list[str], cache: dict, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of the words, word pairs and pairs around one word of whole texts; repeats included."""
    words = [_WORD.findall(t.lower()) for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, size.sum())
    doc = np.repeat(np.arange(len(words)), size)
    mix, shift = np.uint64(0x9E37_79B9_7F4A_7C15), np.uint64(64 - bits)
    out = [((h + np.uint64(1)) * mix) >> shift]
    docs = [doc]
    for gap, salt in ((1, np.uint64(0x1_0000_0001)), (2, np.uint64(0x3_0000_0007))):
        inside = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        pair = (h[:-gap] * salt + (h[gap:] << np.uint64(17)) + np.uint64(gap)) * mix if len(doc) > gap else h[:0]
        out.append((pair >> shift)[inside])
        docs.append(doc[gap:][inside] if len(doc) > gap else doc[:0])
    return np.concatenate(docs), np.concatenate(out).astype(np.int32)


def _by_document(texts: list[str], cache: dict) -> list[np.ndarray]:
    """Distinct coordinates of each text."""
    doc, at = features(texts, cache)
    both = np.unique(doc.astype(np.int64) << 32 | at)
    cuts = np.searchsorted(both >> 32, np.arange(1, len(texts)))
    return np.split((both & 0xFFFF_FFFF).astype(np.int32), cuts)


def _rows_of_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _WordHash()
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            found = _by_document(part["text"].to_pylist(), cache)
            yield pa.record_batch([part["shard"], part["place"], part["toxic"], pa.array(found, pa.list_(pa.int32()))], ["shard", "place", "toxic", "at"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over each learner's rows, which come together and in the order of place."""
    shard, held, marks = None, [], []
    for batch in batches:
        shards, lists = batch["shard"].to_numpy(), batch["at"]
        for a in np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist() if len(shards) else []:
            if shards[a] != shard:
                if held:
                    yield _learned(shard, held, marks)
                shard, held, marks = shards[a], [], []
            part = slice(a, a + int((shards[a:] == shard).sum()))
            held += [lists[i].values.to_numpy().copy() for i in range(part.start, part.stop)]  # whole numbers of 32 bits, free of the batch
            marks += batch["toxic"].slice(a, part.stop - a).to_pylist()
    if held:
        yield _learned(shard, held, marks)


def _learned(shard: int, rows: list[np.ndarray], marks: list[int]) -> pa.RecordBatch:
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for row, y in zip(rows, marks, strict=True):
            at = np.append(row, 0)  # coordinate 0 is the bias
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum())))) - y
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
            n[at] = now
    at = np.flatnonzero(np.abs(z) > L1)
    return pa.record_batch([pa.array(np.full(len(at), shard, np.int32)), pa.array(at), pa.array(weights(at))], ["shard", "at", "w"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero, fitted on at most sample_rows labelled rows.

    Rows with a null text, id or label take no part; a row that repeats counts each time. The sample
    is the rows with the smallest hash of their id. With several learners, each on
    SHARD_ROWS rows at most, their weights are averaged.
    """
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out("__id"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    taken = marks.withColumn("place", F.xxhash64("__id")).orderBy("place", "__id").limit(sample_rows)
    sample = rows.join(F.broadcast(taken), "__id")  # sample_rows at most
    shards = max(1, math.ceil(taken.count() / SHARD_ROWS))
    sample = sample.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).select("text", "shard", "place", "toxic")
    learned = sample.mapInArrow(_rows_of_features, "shard int, place long, toxic int, at array<int>").repartition("shard").sortWithinPartitions("shard", "place", "at").mapInArrow(_train, "shard int, at long, w double")
    mean = learned.groupBy("at").agg((F.sum("w") / shards).alias("w")).orderBy("at").collect()  # 2^HASH_BITS rows at most
    return np.array([r["at"] for r in mean], np.int64), np.array([r["w"] for r in mean], np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a column `to` (0 to 1): the probability that the text is toxic. Null texts count as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.drop(to)
    names = [*cols.columns, to]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in cols.schema)}, `{to}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        dense = np.zeros(1 << HASH_BITS, np.float64)
        dense[at] = w
        bias, dense[0] = dense[0], 0.0
        used, cache = dense != 0, _WordHash()
        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            texts = ["" if t is None else t for t in batch[text_col].to_pylist()]
            logit = np.full(len(texts), bias)
            for a in range(0, len(texts), 256):
                doc, coord = features(texts[a : a + 256], cache)
                hit = used[coord]
                both = np.unique(doc[hit].astype(np.int64) << 32 | coord[hit])  # a feature counts once in a text
                np.add.at(logit, a + (both >> 32), dense[both & 0xFFFF_FFFF])
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names)

    return cols.mapInArrow(run, schema)


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs; trained on rows of train_docs that aren't held out.

    Empty and null texts get the model's base rate. With no usable label every score is one half.
    """
    scored = score(docs.select(F.col(id_col), clean_text(docs, text_col).alias("text")), train(train_docs, labels, id_col, text_col), "text")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with its columns as they are, whose text scores below the threshold; null texts count as empty.

    An empty table gives an empty result.
    """
    to = f"toxic_{uuid.uuid4().hex}"  # no column of docs has such a name
    return score(docs, train(train_docs, labels, id_col, text_col), text_col, to).where(F.col(to) < threshold).drop(to)
