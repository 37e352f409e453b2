"""SentencePiece BPE encoding by backtracking, and decoding.

A merge-type encoding is the one sequence of pieces in which every two neighbours, merged anew from
their characters, come out as the same two pieces. So it can be found without merging the text:
take the longest piece at a position (Aho-Corasick matches), check it against the piece before,
else try the next shorter prefix that is a piece, else mark the position as failed in a bitfield
and step back. Texts are cut first between characters that stand side by side in no piece, as no
merge can cross such a place; what repeats between cuts is looked up.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text

SPACE = "▁"
_MARKS = ".,;:!?\"')]}\n"
#: Entries of a worker's tables before they start afresh, and the longest run that is looked up.
_RUNS, _PAIRS, _LONGEST = 300_000, 1_000_000, 48


class Codec:
    """The pieces of a model file, for encoding and decoding without its library."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {text[i]: i for i in range(n) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.bytes_of = [b"" if sp.is_control(i) else bytes([int(text[i][1:-1], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.starts_space = [text[i].startswith(SPACE) and not special[i] for i in range(n)]
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.merge(p) == [p]:  # others never come out of merging
                self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        whole = set(self.automaton)
        self.halves = {p: tuple(self.merge(p, 2)) for p in whole if len(p) > 1}
        order = {s: k for k, s in enumerate(sorted({self.score[p] for p in self.ids}, reverse=True))}
        self.rank = {p: order[self.score[p]] for p in self.ids}  # merges of a smaller rank come first
        self.made = {p: self.rank[p] if p in self.halves else -1 for p in whole}
        #: Pieces that rank before a piece they are made of: their merges can't be undone one by one.
        self.tangled: set[str] = set()
        for p in sorted(self.halves, key=len):
            if any(h in self.tangled or self.made.get(h, -1) >= self.made[p] for h in self.halves[p]):
                self.tangled.add(p)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), p[:1] if len(p) > 1 else None) for p in whole}
        self.packed = {p: i.to_bytes(4, sys.byteorder) for p, i in self.ids.items()}
        self.pairs: defaultdict[str, dict[str, bool]] = defaultdict(dict)  # by the left piece
        self.known_pairs = 0
        self.runs = _Runs(self)
        self.tails: dict[str, bytes] = {}

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Pieces by merging the best-scored neighbours, leftmost first, until none merge or `least` are left."""
        parts, score = list(text), self.score
        while True:
            if len(parts) <= least:
                return parts
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, left: str, right: str) -> bool:
        """Whether merging left + right from its characters gives these two pieces again.

        Undoes the merges of both, the last first: a merge across the border that would have come before
        the one undone would have been made in its place.
        """
        if left[-1] + right[0] not in self.joined:
            return True
        if left in self.tangled or right in self.tangled:
            return self.merge(left + right) == [left, right]
        rank, made, halves = self.rank, self.made, self.halves
        before, a, b = len(rank), made.get(left, -1), made.get(right, -1)
        while True:
            if rank.get(left + right, before) < before:
                return False
            if a > b:
                before, left = a, halves[left][1]
                a = made.get(left, -1)
            elif b >= 0:  # of two equal merges the left one is made first
                before, right = b + 1, halves[right][0]
                b = made.get(right, -1)
            else:
                return True

    def compatible(self, left: str, right: str) -> bool:
        if self.known_pairs >= _PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        known = self.pairs[left][right] = self.stands(left, right)
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of text; characters without a piece stand alone."""
        n, pairs, compatible = len(text), self.pairs, self.compatible
        out: list[str] = []
        last, pos = None, 0
        for end, (k, p) in self.automaton.iter_long(text):  # goes on as long as nothing has to be taken back
            if end + 1 - k != pos or not (last is None or (known if (known := pairs[last].get(p)) is not None else compatible(last, p))):
                break
            out.append(p)
            last, pos = p, end + 1
        if pos == n:
            return out
        longest = list(text)
        for end, (k, p) in self.automaton.iter(text):  # of those that start at a place, the longest comes last
            longest[end + 1 - k] = p
        failed = None  # one bit for each position from which no encoding goes on
        piece, shorter = longest[pos], self.shorter
        while pos < n:
            end = pos + len(piece)
            if (failed is None or not failed[end >> 3] >> (end & 7) & 1) and (last is None or (known if (known := pairs[last].get(piece)) is not None else compatible(last, piece))):
                out.append(piece)
                last, pos = piece, end
                if pos < n:
                    piece = longest[pos]
            elif (less := shorter.get(piece)) is not None:
                piece = less
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError("no encoding: the pieces aren't closed under merging")
                piece = out.pop()
                last = out[-1] if out else None
                pos -= len(piece)
        return out

    def pack(self, piece: str) -> bytes:
        """The id of a piece, or those of the bytes of a character that has none."""
        if (known := self.packed.get(piece)) is not None:
            return known
        return b"".join((self.byte_ids[b] if self.byte_ids else self.unknown).to_bytes(4, sys.byteorder) for b in (piece.encode("utf-8", "replace") if self.byte_ids else b"\0"))

    def encode_packed(self, text: str) -> bytes:
        """The ids of text as 32-bit numbers."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        words = text.split(SPACE)[1:]
        if "" in words[:-1] or len(text) > 1_000_000:  # runs of spaces stay together
            out, a, joined = [], 0, self.joined
            for i in range(1, len(text)):
                if text[i] == SPACE != text[i - 1] or (text[i - 1] + text[i] not in joined):
                    out.append(text[a:i])
                    a = i
            out.append(text[a:])
            return b"".join(map(self.run_of, out))
        return b"".join(map(self.runs.__getitem__, words))

    def tail(self, marks: str) -> bytes:
        """Of marks after a word."""
        if (known := self.tails.get(marks)) is None:
            known = self.run_of(marks)
            if len(self.tails) < 10_000:
                self.tails[marks] = known
        return known

    def run_of(self, run: str) -> bytes:
        return b"".join(map(self.pack, self.backtrack(run)))

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: bytes of byte pieces join into characters, the space put before the text goes again."""
        if not ids:
            return ""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.starts_space[ids[0]] else text


class _Runs(dict):
    """A word, as it follows a space, to its packed ids. When full, what was used since the last time stays one round more."""

    def __init__(self, codec: Codec):
        self.codec, self.before = codec, {}

    def __missing__(self, word: str) -> bytes:
        if (value := self.before.get(word)) is None:
            codec = self.codec
            core = word if word.isalpha() else word.rstrip(_MARKS)
            if len(core) < len(word) and core and core[-1] + word[len(core)] not in codec.joined:
                value = self[core] + codec.tail(word[len(core) :])
            else:
                value = codec.run_of(SPACE + word)
        if len(self) >= _RUNS:
            self.before = dict(self)
            self.clear()
        if len(word) <= _LONGEST:
            self[word] = value
        return value


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker and model file."""
    return Codec(path)


def _columns(df: DataFrame, *drop: str) -> tuple[DataFrame, str, list[str]]:
    cols = df.drop(*drop)
    return cols, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema), cols.columns


def encode(df: DataFrame, model_path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """df with the ids of each whole text in column `to` (array of int); null and empty texts give no ids.

    No begin or end ids. Each row is on its own, so repeated rows, extra columns and empty tables need
    nothing; a column named `to` is replaced. The model file must be at model_path on every executor.
    """
    cols, schema, names = _columns(df, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                packed = [c.encode_packed(t.as_py() or "") for t in part[text_col]]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.record_batch([*part.columns, ids], [*names, to])

    return cols.mapInArrow(run, f"{schema}, `{to}` array<int>")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of each array of ids in column `to`; null and empty arrays give an empty text, null ids are left out."""
    cols, schema, names = _columns(df, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                each = (x.values.drop_null().to_numpy().tolist() if x.is_valid else [] for x in part[ids_col])
                yield pa.record_batch([*part.columns, pa.array(map(c.decode, each), pa.string())], [*names, to])

    return cols.mapInArrow(run, f"{schema}, `{to}` string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row: encoded, then decoded from the ids."""
    coded = decode(encode(docs.select(F.col(id_col), clean_text(docs, text_col).alias("text")), model_path).select(id_col, "ids"), model_path)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
