"""Token counts without token ids: distinct pre-tokens are counted once and joined to documents.

A pre-token here is a run of text between places where the byte-level pre-tokeniser always cuts: before
a space that follows no other white space or is followed by none. What the tokenizer makes of a
text is what it makes of these runs, one after another, special tokens included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import clean_text

#: Pre-tokens whose counts are broadcast, because a sample of SAMPLE rows shows them most often: a fixed bound of
#: some 20 MB. The choice only decides how a pre-token travels, not its count.
HEAD, SAMPLE = 200_000, 20_000
_SPACES = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r" (?=\S)")


def pre_tokens(text: str) -> list[str]:
    """The runs of text, each without the one space before it; a first run that has no such space is marked by one.

    Other runs never start with white space, so the mark can't be mistaken.
    """
    if not text:
        return []
    runs = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
    if runs[0]:
        runs[0] = " " + runs[0]
    else:
        del runs[0]
    return runs


def _spelled(run: str) -> str:
    return run[1:] if run.startswith(" ") else " " + run


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _frequent(texts: DataFrame, tokenizer_path: str, head: int) -> dict[str, int]:
    """Pieces of the pre-tokens that occur most in about SAMPLE texts: `head` entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Counter(chain.from_iterable(pre_tokens(t.as_py()) for t in batch["text"]))
            yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["run", "n"])

    some = texts.sample(fraction=min(1.0, SAMPLE / max(texts.count(), 1)), seed=3).mapInArrow(run, "run string, n long")
    often = some.groupBy("run").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "run").limit(head).select("run")
    return {r["run"]: r["pieces"] for r in often.mapInArrow(partial(_pieces, path=tokenizer_path), "run string, pieces long").collect()}


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            runs = batch["run"].slice(a, 2000)
            coded = tokenizer(path).encode_batch_fast([_spelled(x.as_py()) for x in runs], add_special_tokens=False)
            yield pa.record_batch([runs, pa.array([len(e) for e in coded], pa.int64())], ["run", "pieces"])


def _joined(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows (run, row, times) sorted by run to (row, n): each distinct run is counted once, where all its rows meet."""
    last, pieces = None, 0
    for batch in batches:
        for a in range(0, batch.num_rows, 20_000):
            part = batch.slice(a, 20_000)
            coded = part["run"].dictionary_encode()
            names = coded.dictionary.to_pylist()
            fresh = [w for w in names if w != last]
            of = {w: len(e) for w, e in zip(fresh, tokenizer(path).encode_batch_fast(list(map(_spelled, fresh)), add_special_tokens=False), strict=True)}
            if last is not None:
                of.setdefault(last, pieces)
            each = np.array([of[w] for w in names], np.int64)
            last, pieces = names[-1], of[names[-1]]
            sums = each[coded.indices.to_numpy()] * part["times"].to_numpy()
            yield pa.record_batch([part["row"], pa.array(sums)], ["row", "n"])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs: tokens of its whole text.

    Each text becomes its distinct pre-tokens and their frequencies. Those in the broadcast head are summed in
    place; the others meet by pre-token, where each is counted once, and are summed by document.
    Null texts count as empty, with no tokens. Rows that repeat both id and text each give a row. Special
    strings inside a text are what the tokenizer makes of them. An empty table gives an empty result.
    """
    text = clean_text(docs, text_col)
    known = docs.sparkSession.sparkContext.broadcast(_frequent(docs.select(text.alias("text")), tokenizer_path, head))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        for batch in batches:
            sums = [sum(filter(None, map(pieces.get, pre_tokens(t.as_py())))) for t in batch["text"]]
            yield pa.record_batch([batch["row"], pa.array(sums, pa.int64()), pa.array(np.ones(len(sums), np.int32))], ["row", "n", "rows"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                runs, times, of = [], [], []
                for i, t in enumerate(part["text"]):
                    counts = Counter(w for w in pre_tokens(t.as_py()) if w not in pieces)
                    runs += counts
                    times += counts.values()
                    of += [i] * len(counts)
                yield pa.record_batch([pa.array(runs, pa.string()), part["row"].take(pa.array(of, pa.int64())), pa.array(times, pa.int32())], ["run", "row", "times"])

    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = docs.select(row.alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    rare = rows.mapInArrow(others, f"run string, row {kind}, times int").repartition("run").sortWithinPartitions("run")
    parts = rows.mapInArrow(frequent, f"row {kind}, n long, rows int").unionByName(rare.mapInArrow(partial(_joined, path=tokenizer_path), f"row {kind}, n long").withColumn("rows", F.lit(0)))
    summed = parts.groupBy("row").agg(F.sum("n").alias("n"), F.sum("rows").cast("int").alias("rows"))
    out = summed.select(F.col("row.id").alias(id_col), F.col("row.n_bytes").alias("n_bytes"), F.expr("n div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1), "rows")).alias("__r")).drop("__r")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
