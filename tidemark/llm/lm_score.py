"""Stupid-backoff language-model scores, computed with joins.

S(w | context) = c(context w) / c(context) if the n-gram occurs at least min_count times, else
alpha * S(w | shorter context); S(w) = c(w) / N. As counts fall with the order, the log score of a text
is a sum over its words of log(alpha^(order-1) c(w) / N), and over each of its n-grams g = (u, ..., v) that
is frequent enough of a weight of g alone:
    log c(g) - log c(g without v) - log alpha - log c(g without u) + log c(g without u and v).
So tables of n-gram counts, partitioned by a hash of the n-gram, become tables of weights, which
join the exploded n-grams of documents; sums by document follow.

Every word has its count. Words that are frequent have a small number, of which n-grams are packed; other words, and
n-grams with such a word, have a hash of 62 bits, and what they need comes by joins. A text is scored by a model that has
read it, so an n-gram that occurs once was read in that text alone and says nothing: min_count is 2, and
counts themselves start from one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import clean_text, stored

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2
WORD_BITS = 18
#: Words with a small number, n-grams whose counts and weights are broadcast because a sample of SAMPLE rows shows them
#: often: fixed bounds of some MB. They only decide how a word or n-gram travels, not its count or weight.
NUMBERED, HEAD, SAMPLE = (1 << WORD_BITS) - 2, 200_000, 4_000
#: Words counted together before they are passed on, and word hashes a task keeps.
_LOT, _KEPT = 1 << 22, 500_000
_HASHED = np.int64(1) << np.int64(62)
#: N-grams that a task passes on together, those of a bucket on average, and parts of a bucket that are counted one after the other.
_LOT_GRAMS, _BUCKET, _PARTS = 1 << 20, 1 << 23, 16


class WordNumbers(dict):
    """Word to its place among the sorted hashes `top`, or to its hash, at least 2^62, where it isn't there; those met lately are kept."""

    def __init__(self, top: np.ndarray | None = None):
        super().__init__()
        # looked up once for each rare word, where a call of numpy would take longer than all else
        self.place = {} if top is None else dict(zip(top.tolist(), range(len(top)), strict=True))

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) >> 2 | 1 << 62
        value = self[word] = self.place.get(value, value)
        return value


def _words_of(texts: list[str], numbers: WordNumbers) -> tuple[np.ndarray, np.ndarray]:
    """(document, number or hash) of each word."""
    words = [t.lower().split() for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, size.sum())
    return np.repeat(np.arange(len(words)), size), number


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted keys, whether it is there) of each wanted key."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of n-grams given by their words, at least 2^62."""
    h = np.full(len(parts[0]), 0x9E37_79B9_7F4A_7C15, np.uint64)
    for p in parts:
        h = (h ^ p.view(np.uint64)) * np.uint64(0xD6E8_FEB8_6659_FD93)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(2)).view(np.int64) | _HASHED


def gram_key(parts: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams given by their words: packed where each has a number, else hashed."""
    packed, hashed = parts[0].copy(), parts[0] >= _HASHED
    for p in parts[1:]:
        packed = packed << np.int64(WORD_BITS) | p
        hashed = hashed | (p >= _HASHED)
    if len(parts) > 1 and hashed.any():
        packed[hashed] = _mixed([p[hashed] for p in parts])
    return packed


def grams(doc: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document, its words in order) of each run of n words within a document."""
    m = max(0, len(doc) - n + 1)
    inside = doc[:m] == doc[len(doc) - m :]
    return doc[:m][inside], [number[i : i + m][inside] for i in range(n)]


def _counted(doc: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first, key, count) of each distinct n-gram of a document."""
    key, places, counts = gram_key(parts), [], []
    hashed = key >= _HASHED
    bits = WORD_BITS * len(parts)
    for rows, tight in ((np.flatnonzero(~hashed), bits < 54), (np.flatnonzero(hashed), False)):
        if not len(rows):
            continue
        d, k = doc[rows], key[rows]
        if tight:  # document and key in one number
            both = d << np.int64(bits) | k
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(both[order]) != 0])
        else:
            order = np.lexsort((k, d))
            d, k = d[order], k[order]
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
        places.append(rows[order[first]])
        counts.append(np.diff(np.r_[first, len(order)]))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate(places)
    return at, key[at], np.concatenate(counts)


def unpacked(key: np.ndarray, n: int) -> list[np.ndarray]:
    """The n words, all with a number, of packed keys."""
    return [key >> np.int64(WORD_BITS * (n - 1 - i)) & np.int64((1 << WORD_BITS) - 1) for i in range(n)]


def _blob(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, compressed: first all lowest bytes, then the next ones and so on."""
    return zstandard.compress(np.stack(columns).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _of_blob(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(columns, -1)


class _Lot:
    """N-grams of some documents, flushed as rows by bucket (a hash of the n-gram) and number of words.

    Such a row holds its documents once, and for each part of the bucket the n-grams: the document's place, the count there and
    the words, in the order of first words, of which the steps are kept.
    """

    NAMES = ("bucket", "size", "docs", "parts")

    def __init__(self, buckets: int, row_type: pa.DataType):
        self.buckets, self.row_type = buckets, row_type
        self._clear()

    def _clear(self) -> None:
        self.docs, self.before, self.seen, self.size, self.held = [], 0, 0, 0, {}

    def documents(self, rows: pa.Array) -> None:
        """Documents that the next n-grams belong to."""
        self.docs.append(rows)
        self.before, self.seen = self.seen, self.seen + len(rows)

    def add(self, doc: np.ndarray, words: list[np.ndarray], count: np.ndarray) -> None:
        hashed = np.logical_or.reduce([w >= _HASHED for w in words])
        for kind in (False, True):  # apart, as they compress better so
            rows = np.flatnonzero(hashed == kind)
            if len(rows):
                self.held.setdefault((len(words), kind), []).append((doc[rows] + self.before, count[rows], *(w[rows] for w in words)))
        self.size += len(doc)

    def flush(self) -> Iterator[pa.RecordBatch]:
        docs = pa.concat_arrays([d.cast(self.row_type) for d in self.docs])
        for (n, _), held in self.held.items():
            doc, count, *words = (np.concatenate(x) for x in zip(*held, strict=True))
            mixed = _mixed(words)
            place = mixed % np.int64(self.buckets) * _PARTS + mixed // np.int64(self.buckets) % _PARTS
            order = np.lexsort((words[0], place))
            place, columns = place[order], [x[order] for x in (doc, count, *words)]
            starts = np.flatnonzero(np.diff(place // _PARTS, prepend=-1))
            rows = [self._row(n, docs, place[a:b], [x[a:b] for x in columns]) for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True)]
            for i in range(0, len(rows), 200):
                bucket, of, parts = zip(*rows[i : i + 200], strict=True)
                ends = np.cumsum([0] + [len(d) for d in of])
                of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(of))
                yield pa.record_batch([pa.array(bucket, pa.int64()), pa.array(np.full(len(of), n, np.int8)), of, pa.array(parts, pa.list_(pa.binary()))], self.NAMES)
        self._clear()

    @staticmethod
    def _row(n: int, docs: pa.Array, place: np.ndarray, columns: list[np.ndarray]) -> tuple[int, pa.Array, list[bytes | None]]:
        used, at = np.unique(columns[0], return_inverse=True)
        parts, starts = [None] * _PARTS, np.flatnonzero(np.diff(place, prepend=-1))
        for a, b in zip(starts, np.r_[starts[1:], len(place)], strict=True):
            count, first, *others = (x[a:b] for x in columns[1:])
            parts[int(place[a]) % _PARTS] = _blob([at[a:b], count, np.diff(first, prepend=0), *others])
        return int(place[0]) // _PARTS, docs.take(pa.array(used)), parts


def _opened(blobs: list[bytes | None], before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place of the document, count, words) of the n-grams in a part of a bucket's rows, before which so many documents stand."""
    found = [np.zeros((n + 2, 0), np.int64)]
    for blob, shift in zip(blobs, before.tolist(), strict=True):
        if blob is not None:
            columns = _of_blob(blob, n + 2)
            columns[0] += shift
            columns[2] = np.cumsum(columns[2])
            found.append(columns)
    doc, count, *words = np.concatenate(found, axis=1)
    return doc, count, words


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n) for lots of words."""
    numbers, held, size = WordNumbers(), [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.record_batch([pa.array(keys), pa.array(counts.astype(np.int64))], ["key", "n"])

    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            held.append(_words_of(batch["text"].slice(a, 500).to_pylist(), numbers)[1])
            size += len(held[-1])
            if size > _LOT:
                yield flush()
                size = 0
    if size:
        yield flush()


def _log(c: Column | str) -> Column:
    return F.log(F.col(c) if isinstance(c, str) else c)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, numbered: int = NUMBERED, head: int = HEAD) -> DataFrame:
    """(id, n_words, log_score, score) for each row of docs: log_score is the sum over the words of the whole
    text, score its mean by word (null and 0 words: 0 and null).

    Counts come from every whole text of docs. Words are lower-cased runs without white space; n-grams stay within
    a text; order is 1, 2 or 3. Null texts count as empty, null ids are kept. Rows that repeat both id and text give a row
    each and count each. An empty table gives an empty result; other columns are left out.
    """
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    text = clean_text(docs, text_col)
    texts = docs.select(text.alias("text"))
    words = stored(texts.mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    top = words.orderBy(F.desc("n"), "key").limit(min(numbered, NUMBERED)).toArrow()  # NUMBERED rows at most
    order_of = np.argsort(top["key"].to_numpy())
    known_keys, unigram = top["key"].to_numpy()[order_of], top["n"].to_numpy()[order_of].astype(np.float64)
    sent = spark.sparkContext.broadcast((known_keys, unigram))
    head_keys = {n: _often(texts, sent, n, head) for n in range(2, order + 1)}
    heads_sent = spark.sparkContext.broadcast(head_keys)

    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.select(row.alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    row_type = pa.struct([pa.field(f.name, f.type) for f in to_arrow_type(rows.schema["row"].dataType)])

    n_log, a_log = math.log(max(total, 1)), math.log(alpha)
    buckets = total * max(1, order - 1) // _BUCKET + 1

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lots, by bucket, of the n-grams of documents that aren't broadcast, and of words without a number.

        N-grams of the null document carry how often the task has met each broadcast n-gram.
        """
        numbers = WordNumbers(sent.value[0])
        often = {n: np.zeros(len(keys), np.int64) for n, keys in heads_sent.value.items()}
        lot = _Lot(buckets, row_type)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                words_doc, number = _words_of(part["text"].to_pylist(), numbers)
                lot.documents(part["row"])
                for n in range(1, order + 1):
                    doc, parts = grams(words_doc, number, n)
                    at, key, count = _counted(doc, parts)
                    if n == 1:
                        other = key >= _HASHED
                    else:
                        place, there = _found(heads_sent.value[n], key)
                        often[n] += np.bincount(place[there], count[there], len(often[n])).astype(np.int64)
                        other = ~there
                    at = at[other]
                    lot.add(doc[at], [p[at] for p in parts], count[other])
                if lot.size > _LOT_GRAMS:
                    yield from lot.flush()
        lot.documents(pa.nulls(1, row_type))
        for n, counts in often.items():
            met_here = np.flatnonzero(counts)
            lot.add(np.zeros(len(met_here), np.int64), unpacked(heads_sent.value[n][met_here], n), counts[met_here])
        yield from lot.flush()

    def known(lots: pa.Table) -> pa.Table:
        """Rows (row, size, key, n, c, a, b, m, s) of a bucket.

        Size 0: s is the sum, by document, of what words and, at order 2, numbered pairs that occur min_count times say. Else an
        n-gram that occurs min_count times; c is its count in all. Of hashed ones, a and b are the keys of all but the last and all but
        the first word, m that of those between.
        """
        logs, out = np.log(np.maximum(sent.value[1], 1)), []

        def put(row: pa.Array, size: int, key: np.ndarray, n: np.ndarray, c: np.ndarray, inner: list[np.ndarray], s: np.ndarray) -> None:
            columns = [row, pa.array(np.full(len(key), size, np.int8)), *map(pa.array, (key, n, c, *inner, s))]
            out.append(pa.table(columns, ["row", "size", "key", "n", "c", "a", "b", "m", "s"]))

        for n in range(1, order + 1):
            mine = lots.filter(pc.equal(lots["size"], n))
            held = [d.values for d in mine["docs"]]
            docs_of = pa.concat_arrays([d.cast(row_type) for d in held]) if held else pa.nulls(0, row_type)
            before = np.cumsum([0] + [len(d) for d in held])[:-1]
            nobody = docs_of.is_null().to_numpy(zero_copy_only=False)
            sums, met_here = np.zeros(len(docs_of)), np.zeros(len(docs_of), bool)
            for i in range(_PARTS):
                doc, count, words = _opened(pc.list_element(mine["parts"], i).to_pylist() if len(mine) else [], before, n)
                key = gram_key(words)
                _, group = np.unique(key, return_inverse=True)
                c = np.bincount(group, count, 1)[group].astype(np.float64)  # of nothing it makes whole numbers
                keep = c >= (min_count if n > 1 else 1)
                if n == 1:
                    here, w = keep, np.log(c) - n_log + (order - 1) * a_log
                elif order == 2:
                    here = keep & (key < _HASHED) & ~nobody[doc]
                    w = np.log(c) + n_log - a_log
                    w[here] -= logs[words[0][here]] + logs[words[1][here]]
                else:
                    here, w = np.zeros(len(key), bool), c
                sums += np.bincount(doc[here], count[here] * w[here], len(sums))
                met_here[doc[here]] = True
                rest = np.flatnonzero(keep & ~here)
                hashed, inner_keys = np.flatnonzero(key[rest] >= _HASHED), []
                of = [x[rest][hashed] for x in words]
                for inner in (of[:-1], of[1:], of[1:-1]):
                    col = np.zeros(len(rest), np.int64)
                    if inner:
                        col[hashed] = gram_key(inner)
                    inner_keys.append(col)
                put(docs_of.take(pa.array(doc[rest])), n, key[rest], count[rest], c[rest], inner_keys, np.zeros(len(rest)))
            at = np.flatnonzero(met_here)
            none = np.zeros(len(at), np.int64)
            put(docs_of.take(pa.array(at)), 0, none, none, none.astype(np.float64), [none] * 3, sums[at])
        return pa.concat_tables(out)

    lots = rows.mapInArrow(tails, f"bucket long, size tinyint, docs array<{kind}>, parts array<binary>")
    numbers_only = spark.createDataFrame(pa.table({"word": np.arange(len(unigram)), "c": unigram}))
    small = lambda name: F.broadcast(numbers_only.select(F.col("word").alias(name), F.col("c").alias(f"c_{name}")))  # noqa: E731  # NUMBERED rows at most
    other = words.join(F.broadcast(spark.createDataFrame(pa.table({"key": known_keys}))), "key", "left_anti").select(F.col("key").alias("word"), F.col("n").cast("double").alias("c"))
    every = other.unionByName(numbers_only)
    any_ = lambda name: every.select(F.col("word").alias(name), F.col("c").alias(f"c_{name}"))
    last, mask = (1 << WORD_BITS) - 1, lambda c, by: F.shiftrightunsigned(F.col(c), by)
    packed = F.col("key") < int(_HASHED)

    def weigh_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, c, ...) of packed pairs with their weight w."""
        logs = np.log(np.maximum(sent.value[1], 1))
        for batch in batches:
            key = batch["key"].to_numpy()
            w = np.log(batch["c"].to_numpy()) - logs[key >> WORD_BITS] - a_log - logs[key & last] + n_log
            yield pa.record_batch([*batch.columns, pa.array(w)], [*batch.schema.names, "w"])

    def two_words(df: DataFrame) -> DataFrame:
        """Weights of pairs (key, c, a, b, ...)."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        near = df.where(packed).mapInArrow(weigh_packed, f"{schema}, w double")
        far = df.where(~packed).join(any_("a"), "a").join(any_("b"), "b").withColumn("w", _log("c") - _log("c_a") - a_log - _log("c_b") + n_log)
        return near.unionByName(far.drop("c_a", "c_b"))

    def three_words(df: DataFrame, pairs: DataFrame) -> DataFrame:
        """Weights of runs of three (key, c, a, b, m, ...)."""
        inner = {"a": mask("key", WORD_BITS), "b": F.col("key").bitwiseAND(F.lit((1 << 2 * WORD_BITS) - 1)), "m": mask("key", WORD_BITS).bitwiseAND(F.lit(last))}
        named = df.withColumns({c: F.when(packed, x).otherwise(F.col(c)) for c, x in inner.items()})
        side = lambda name: pairs.select(F.col("pair").alias(name), F.col("c_pair").alias(f"c_{name}"))
        both = named.join(side("a"), "a").join(side("b"), "b")
        near, far = both.where(F.col("m") <= last).join(small("m"), "m"), both.where(F.col("m") > last).join(any_("m"), "m")
        return near.unionByName(far).withColumn("w", _log("c") - _log("c_a") - a_log - _log("c_b") + _log("c_m"))

    # One exchange by n-gram: there every n-gram gets its count. It carries lots of n-grams, as a row each would take several times
    # the bytes. N-grams that a sample shows often travel as broadcast counts, so none that is left fills a bucket.
    met = stored(lots.groupBy("bucket").applyInArrow(known, f"row {kind}, size tinyint, key long, n long, c double, a long, b long, m long, s double"), "known-grams")
    parts, weights, pairs = [met.where("size = 0").select("row", "s")], {}, None
    for n in range(2, order + 1):
        mine = met.where((F.col("size") == n) & F.col("row").isNotNull()).drop("s")
        fixed = met.where((F.col("size") == n) & F.col("row").isNull()).select("key", "c", "a", "b", "m").distinct()  # HEAD rows at most
        if n == 2:
            weigh = two_words
            if order > 2:
                pair = lambda df: df.select(F.col("key").alias("pair"), F.col("c").alias("c_pair"))
                pairs = stored(pair(mine).distinct().unionByName(pair(fixed)), "pairs")
        else:
            weigh = lambda df: three_words(df, pairs)
        parts.append(weigh(mine).select("row", (F.col("n") * F.col("w")).alias("s")))
        got = weigh(fixed).select("key", "w").toArrow()  # HEAD rows at most
        keys = got["key"].to_numpy()
        order_of = np.argsort(keys)
        weights[n] = (keys[order_of], got["w"].to_numpy()[order_of])
    weights_sent = spark.sparkContext.broadcast(weights)

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row its words, and the sum of what broadcast tables say."""
        known_words, unigram = sent.value
        numbers = WordNumbers(known_words)
        log1 = np.log(np.maximum(unigram, 1)) - n_log + (order - 1) * a_log
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts_now = part["text"].to_pylist()
                doc, number = _words_of(texts_now, numbers)
                size = np.bincount(doc, minlength=len(texts_now))
                known = number < _HASHED
                s = np.bincount(doc[known], log1[number[known]], len(texts_now)).astype(np.float64)  # of nothing it makes whole numbers
                for n, (keys, w) in weights_sent.value.items():
                    d, of = grams(doc, number, n)
                    at, there = _found(keys, gram_key(of))
                    s += np.bincount(d[there], w[at[there]], len(texts_now))
                yield pa.record_batch([part["row"], pa.array(size.astype(np.int64)), pa.array(s)], ["row", "n_words", "s"])

    base = rows.mapInArrow(bases, f"row {kind}, n_words long, s double")
    together = base.select("row", "n_words", "s", F.lit(1).alias("rows"))
    for part in parts:
        # a task's sums by document are made before the shuffle
        together = together.unionByName(part.select("row", F.lit(None).cast("long").alias("n_words"), "s", F.lit(0).alias("rows")))
    summed = together.groupBy("row").agg(F.max("n_words").alias("n_words"), F.sum("s").alias("s"), F.sum("rows").cast("int").alias("rows"))
    each = summed.select("*", F.explode(F.sequence(F.lit(1), "rows")).alias("__r"))
    log_score = F.col("s") / F.col("rows")
    return each.select(F.col("row.id").alias(id_col), "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("score"))


def _often(texts: DataFrame, sent, n: int, head: int) -> np.ndarray:  # noqa: ANN001
    """Sorted keys of n-grams of numbered words that occur most in about SAMPLE texts."""
    size = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers(sent.value[0])
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                key = gram_key(grams(*_words_of(batch["text"].slice(a, 500).to_pylist(), numbers), n)[1])
                keys, counts = np.unique(key[key < _HASHED], return_counts=True)
                yield pa.record_batch([pa.array(keys), pa.array(counts)], ["key", "n"])

    some = texts.sample(fraction=min(1.0, SAMPLE / max(size, 1)), seed=5).mapInArrow(run, "key long, n long")
    often = some.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 1).orderBy(F.desc("n"), "key").limit(head).select("key").toArrow()
    return np.sort(often["key"].to_numpy())
