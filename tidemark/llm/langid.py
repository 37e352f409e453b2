"""Language identification by n-gram filters that hold a bitmask of languages.

A bit-sliced Bloom filter keeps one word of bits for each position, one bit for each language; the
AND of a few positions gives all languages that contain an n-gram at once. A text's n-grams are
looked up, hits are counted for each language, corrected for the rate at which that language's
slice says yes by chance, and the language with the largest corrected share wins.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, held_out

SIZES = (3, 4)
#: Bound of the sample that is fitted on: about so many labelled rows of each language.
SAMPLE_ROWS = 2_000
#: A language has an n-gram that is in this share of its sampled texts, and in two of them.
SHARE, LEAST = 0.005, 2
#: Bits of a filter's length at least (it grows with the n-grams learned), looks into it, languages in one filter.
FILTER_BITS, HASHES, TOGETHER = 21, 3, 64
#: Part of a text's n-grams, beyond chance, that its language must contain for the filter stage to keep it.
LEAST_COVERED = 0.25
_CHUNK = 1 << 18  # characters looked at together
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["letters"]


def ngrams(texts: list[str], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit key) of each character n-gram of the lower-cased texts; what isn't a letter is one space."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    keep = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])] if len(codes) else np.zeros(0, bool)
    codes, doc = codes[keep].astype(np.uint64), doc[keep]
    docs, keys = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        key = codes[:m].copy()
        for i in range(1, n):
            key = (key << np.uint64(21 if n <= 3 else 16)) ^ codes[i : i + m]
        inside = doc[n - 1 :] == doc[:m]
        for i in range(1, n - 1):
            inside &= codes[i : i + m] != 0  # no n-gram spans two words
        docs.append(doc[:m][inside])
        keys.append((key[inside] + np.uint64(n)) * np.uint64(0x9E37_79B9_7F4A_7C15))
    return (np.concatenate(docs), np.concatenate(keys)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _places(keys: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th position of each key in a filter of 2^bits."""
    odd = (0xBF58_476D_1CE4_E5B9, 0x94D0_49BB_1331_11EB, 0xD6E8_FEB8_6659_FD93)[i]
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(odd)) >> np.uint64(64 - bits)


@dataclass
class LanguageFilter:
    languages: list[str]
    words: list[np.ndarray]  # for each TOGETHER languages their bitmask at each position
    chance: np.ndarray  # rate of false positives for each language

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, langs: np.ndarray) -> LanguageFilter:
        """keys[i] is an n-gram of language number langs[i]."""
        bits = max(FILTER_BITS, math.ceil(math.log2(6 * max(1, np.bincount(langs, minlength=1).max()))))
        filters, chance = [], []
        for first in range(0, len(languages), TOGETHER):
            several = min(TOGETHER, len(languages) - first)
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if several <= np.iinfo(t).bits)
            words, own = np.zeros(1 << bits, kind), (langs >= first) & (langs < first + several)
            for i in range(HASHES):
                np.bitwise_or.at(words, _places(keys[own], i, bits), kind(1) << (langs[own] - first).astype(kind))
            chance += [(words >> kind(i) & kind(1)).mean() ** HASHES for i in range(several)]
            filters.append(words)
        return cls(languages, filters, np.array(chance))

    def lookup(self, keys: np.ndarray) -> list[np.ndarray]:
        """Bitmasks of the languages that contain each n-gram, or seem to."""
        found = []
        for words in self.words:
            bits = len(words).bit_length() - 1
            masks = words[_places(keys, 0, bits)]
            for i in range(1, HASHES):
                masks &= words[_places(keys, i, bits)]
            found.append(masks)
        return found

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text x language share of n-grams contained beyond chance, number of n-grams) of whole texts."""
        hits, total = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for first, part in _pieces(texts):
            doc, keys = ngrams(part)
            found, n = self.lookup(keys), len(part)
            total[first : first + n] += np.bincount(doc, minlength=n)
            for i in range(len(self.languages)):
                masks, bit = found[i // TOGETHER], i % TOGETHER
                hits[i, first : first + n] += np.bincount(doc[(masks >> masks.dtype.type(bit) & masks.dtype.type(1)) != 0], minlength=n)
        rate = hits.T / np.maximum(total, 1)[:, None]
        return np.clip((rate - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1), total


_BORDER = re.compile(r"[\W\d_]")


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in lots of some _CHUNK characters; a very long text comes as several lots, cut where no letter is, so it keeps its n-grams."""
    lot, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if lot and size + len(t) > _CHUNK:
            yield first, lot
            lot, size = [], 0
        if not lot:
            first = i
        if len(t) > _CHUNK:
            a = 0
            while a < len(t):
                border = _next_border(t, a + _CHUNK)
                yield i, [t[a:border]]
                a = border
            continue
        lot.append(t)
        size += len(t)
    if lot:
        yield first, lot


def _next_border(text: str, at: int) -> int:
    """The first place from at on whose character, alone and lower-cased, has no letter; else the end."""
    while at < len(text):
        m = _BORDER.search(text, at)
        if not m:
            break
        at = m.start()
        if not any(c.isalpha() for c in text[at].lower()):
            return at
        at += 1
    return len(text)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """Learns from about SAMPLE_ROWS texts of each language, those with the smallest hash of their id, that aren't held out.

    Rows with a null text or language teach nothing.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageFilter([], [], np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    part = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE_ROWS / r["count"])))])
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("id"), 11) < part[F.col("lang")] * float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), np.array([number[x] for x in batch["lang"].to_pylist()])
            for first, part in _pieces(texts):
                doc, keys = ngrams(part)
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                once = np.r_[True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.zeros(0, bool)
                lang, key = langs[first + doc[once]], keys[once]
                order = np.lexsort((key, lang))
                lang, key = lang[order], key[order]
                new = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, int)
                n = np.diff(np.r_[new, len(key)])
                yield pa.record_batch([pa.array(key[new].view(np.int64)), pa.array(lang[new].astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "lang", "n"])

    seen = sample.select("text", "lang").mapInArrow(run, "key long, lang int, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))
    least = {number[r["lang"]]: max(LEAST, SHARE * min(r["count"], SAMPLE_ROWS)) for r in counts}
    enough = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("lang")]
    # bounded by the sample: an n-gram has SHARE of its language's texts
    got = seen.where(F.col("n") >= enough).select("key", "lang").toArrow()
    return LanguageFilter.build(languages, got["key"].to_numpy().view(np.uint64), got["lang"].to_numpy().astype(np.int64))


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", to: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_covered")) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1: the winner's part of all languages' shares) and lang_covered (its share), named `to`.

    `und` with score 0 where the text is null, has no letter, or no language contains any of its n-grams beyond
    chance and none was learned; ties go to the first language by name. Columns of docs with these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.drop(*to)
    names_out = [*cols.columns, *to]
    kinds = ("string", "double", "double")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema), *(f"`{c}` {k}" for c, k in zip(to, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200)):
            texts = ["" if t is None else t for t in batch[text_col].to_pylist()]
            if m.languages:
                share, total = m.shares(texts)
                best, known = share.argmax(axis=1), total > 0
                top, every = share.max(axis=1), share.sum(axis=1)
                names = np.where(known, np.array(m.languages, object)[best], "und")
                points = np.where(known, np.where(every > 0, top / np.maximum(every, 1e-12), 1 / len(m.languages)), 0.0)
            else:
                names, points, top = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.record_batch([*batch.columns, pa.array(list(names), pa.string()), pa.array(points), pa.array(top.astype(float))], names_out)

    return cols.mapInArrow(run, schema)


def language_id(docs: DataFrame, train_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs; see train and identify for nulls, ties and empty tables."""
    model = train(train_docs, id_col, text_col, lang_col)
    found = identify(docs.select(F.col(id_col), clean_text(docs, text_col).alias("text")), model)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def drop_unknown(docs: DataFrame, train_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_COVERED) -> DataFrame:
    """The rows of docs, with its columns as they are, whose text is in a learned language: not `und`, and its n-grams covered to at least `least`.

    Null texts and those without letters go. An empty table gives an empty result.
    """
    mark = uuid.uuid4().hex  # no column of docs has such a name
    pred, score, covered = (f"{c}_{mark}" for c in ("pred", "score", "covered"))
    found = identify(docs, train(train_docs, id_col, text_col, lang_col), text_col, (pred, score, covered))
    return found.where((F.col(pred) != "und") & (F.col(covered) >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
