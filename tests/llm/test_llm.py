"""Operators against brute force, libraries and round trips, on small tables with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import lm_score, near, simhash
from tidemark.llm.chat_format import format_chats, violations
from tidemark.llm.exact_dedup import exact_dedup, grow_directory, keep_one_of_equal
from tidemark.llm.langid import identify, language_id, train
from tidemark.llm.lm_score import lm_scores
from tidemark.llm.near import keep_one_of_near, shingles, similar_texts
from tidemark.llm.packing import best_fit_packing, pack
from tidemark.llm.sp_codec import Codec, round_trip
from tidemark.llm.token_count import count_tokens
from tidemark.llm.toxicity import toxicity
from tidemark.llm.vptree import nearest

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "The cat sat on the mat.", "The cat sat on the mat.", "  two  spaces\n\nand lines \t", "日本語 text <|endoftext|> é", "it's we'll 12,345 words!", "x" * 3000, "▁ mark\u0085 z   end "]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None), (4, TEXTS[4], "en", "s", 0, "clash")], SCHEMA)


def test_exact_dedup(spark, docs):
    got = exact_dedup(docs, capacity=1).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in got}
    assert (by[4]["keep_id"], by[4]["group_size"], by[4]["kept"], by[5]["kept"]) == (5, 3, False, True)
    assert by[0]["keep_id"] == 1 and by[0]["text_sha256"] == hashlib.sha256(b"").hexdigest() and by[None]["kept"]
    assert keep_one_of_equal(docs).count() == len(TEXTS) - 2 + 1
    assert exact_dedup(docs.limit(0)).count() == 0
    depth, directory = grow_directory({i: 10 for i in range(16)}, 20, 4)
    assert depth == 3 and directory == [0, 2, 4, 6, 8, 10, 12, 14]


CLASH = "doc_id long, text string, kept string, keep_id string, group_size int, text_sha256 string, lang string, lang_pred string, lang_score int, lang_covered int, __toxic int"


def test_filters_leave_columns_as_they_are(spark):
    from tidemark.llm.langid import drop_unknown
    from tidemark.llm.toxicity import drop_toxic

    row = ("the cat is here and the dog", "mine", "keep", 7, "sha", "en", "pred", 1, 2, 3)
    rows = spark.createDataFrame([(i, *row) for i in range(12)], CLASH)
    labels = spark.createDataFrame([(i, 0) for i in range(12)], "doc_id long, toxic int")
    for kept, n in ((keep_one_of_equal(rows), 1), (drop_unknown(rows, rows), 12), (drop_toxic(rows, rows, labels), 12)):
        assert kept.columns == rows.columns and [tuple(r[1:]) for r in kept.collect()] == [row] * n


def test_langid_cuts_long_texts_without_losing_ngrams(monkeypatch):
    from tidemark.llm import langid

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\u0130\u00df c,1_\u65e5") for _ in range(n)) for n in (5, 700, 3000)] + ["x" * 900]
    whole = [sorted(langid.ngrams([t])[1].tolist()) for t in texts]
    monkeypatch.setattr(langid, "_CHUNK", 100)
    got = [[] for _ in texts]
    for first, part in langid._pieces(texts):
        doc, keys = langid.ngrams(part)
        for d, k in zip(doc.tolist(), keys.tolist(), strict=True):
            got[first + d].append(k)
    assert [sorted(x) for x in got] == whole


def test_langid_knows_more_languages_than_a_filter_holds(spark):
    from tidemark.llm import langid

    letters = [chr(0x4E00 + 10 * i) for i in range(70)]
    rows = [(100 * i + j, (letters[i] * 4 + " ") * 5, f"l{i:02}") for i in range(70) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 70 and len(model.words) == 2
    assert all(r["lang"] == r["lang_pred"] for r in identify(docs, model).collect())


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(20)})
    label = list(range(len(codes)))
    for i, a in enumerate(codes):
        for j, b in enumerate(codes[:i]):
            if (a ^ b).bit_count() <= 3:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    want = {}
    for c, v in zip(codes, label, strict=True):
        want.setdefault(v, set()).add(c)
    signed = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    for hot in (50_000, 4):  # the second deals crowded groups out again
        found = simhash.components(simhash.links(signed, hot=hot)).collect()
        groups = {}
        for r in found:
            groups.setdefault(r["root"], set()).add(r["u"] % (1 << 64))
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_near_duplicates(docs):
    by = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert by[0]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 0 and by[5]["component_id"] == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_keeps_what_brute_force_keeps(spark):
    rng = random.Random(4)
    texts = {}
    for family in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 30, 120, 400)))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            texts[len(texts)] = " ".join(copy)
    sets = {i: set(shingles(t.encode()).tolist()) for i, t in texts.items()}
    label = dict(zip(texts, texts, strict=True))
    for i in texts:
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    want = {i for i in texts if label[i] == i}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one_of_near(table).collect()} == want
    assert 25 <= len(want) < 200
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "A  b"), (5, ""), (4, None), (6, "c"), (3, "a b")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in keep_one_of_near(odd).collect()) == ["3", "3", "4", "6", "None", "None"]
    assert keep_one_of_near(odd.limit(0)).count() == 0


def test_near_links_a_dense_group_by_way_of_its_components(spark, monkeypatch):
    chain = [" ".join(f"w{i}" for i in range(8 * k, 8 * k + 100)) for k in range(40)]  # neighbours reach 0.8, others don't
    rows = spark.createDataFrame([(k, t, near.sketch(shingles(t.encode())).tobytes(), 96) for k, t in enumerate(chain)], "key long, text string, sketch binary, n long")
    found = similar_texts(rows.select("key", "text"), rows.select("key", "n", "sketch")).collect()
    assert len(found) == 40 and {r["root"] for r in found} == {0}


def test_near_open_group_meets_across_components():
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(300)]
    some = [near.sketch(np.array(base[: 300 - k] + [rng.getrandbits(64) for _ in range(k)], np.uint64)) for k in (0, 5, 10, 15, 290)]
    batch = pa.record_batch({"value": pa.array([1] * 5), "other": pa.array([0, 0, 1, 1, 1]), "key": pa.array(range(5)), "root": pa.array([0, 0, 2, 3, 4]), "number": pa.array([1] * 5, pa.int32()), "numbers": pa.array([[1]] * 5, pa.list_(pa.int32())), "sketch": pa.array([x.tobytes() for x in some])})
    got = {(a, b) for out in near._met(iter([batch]), near._most(0.8, 64, 4), near._most(0.8, 1024, 4), near.tables(100)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
    assert got == {(0, 2), (1, 2), (0, 3), (1, 3), (2, 3)}
    both = batch.set_column(5, "numbers", pa.array([[0, 1]] * 5, pa.list_(pa.int32())))
    again = [r for out in near._met(iter([both]), near._most(0.8, 64, 4), near._most(0.8, 1024, 4), near.tables(100)) for r in out.to_pylist()]
    places, bits = near.tables(100)[0], [np.unpackbits(x.view(np.uint8), bitorder="little") for x in some]
    assert {(r["a"], r["b"]) for r in again} == {(i, j) for i, j in got if (bits[i][places] != bits[j][places]).any()}  # others came from table 0


def _unlike(seed: int, n: int) -> dict[int, str]:
    """Texts that are near, but below the similarity: six of 400 words are other ones; every tenth has a copy with one more."""
    rng, out = random.Random(seed), {}
    for k in range(n):
        words = [f"w{i}" for i in range(400)]
        for i in rng.sample(range(10, 390), 6):
            words[i] = f"x{k}.{i}"
        out[k] = " ".join(words)
        if k % 10 == 0:
            out[n + k] = out[k].replace(" w3 ", f" y{k} ")
    return out


@pytest.mark.parametrize("block", [1 << 22, 6000])
def test_near_dense_group_of_unlike_texts_makes_no_row_a_pair(spark, monkeypatch, block):
    texts, made = _unlike(3, 150), {}
    sets = {k: set(shingles(t.encode()).tolist()) for k, t in texts.items()}
    alike = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(alike) >= 15
    kept = near.stored

    def counted(df, name):
        made.setdefault(name, []).append(rows := kept(df, name))
        return rows

    monkeypatch.setattr(near, "stored", counted)
    monkeypatch.setattr(near, "BLOCK", block)
    if block == 6000:  # all links come from cells
        monkeypatch.setattr(near, "NEAREST", 0)
    rows = spark.createDataFrame([(k, t, near.sketch(shingles(t.encode())).tobytes(), len(sets[k])) for k, t in texts.items()], "key long, text string, sketch binary, n long")
    found = {r["u"]: r["root"] for r in similar_texts(rows.select("key", "text"), rows.select("key", "n", "sketch")).collect()}
    label = {k: k for k in texts}
    for _ in range(3):
        for a, b in alike:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: found.get(k, k) for k in texts} == label
    assert max(r.count() for name, all_ in made.items() if name != "near-pairs" and name != "open" for r in all_) <= 3 * len(texts)


def test_near_met_compares_sets_and_joins_components_once():
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(300)]
    some = [np.unique(np.array(base[: 300 - k] + [rng.getrandbits(64) for _ in range(k)], np.uint64)) for k in (0, 5, 10, 50, 15)]
    batch = pa.record_batch({"value": pa.array([1] * 5), "other": pa.array([0, 0, 1, 1, 2]), "key": pa.array(range(5)), "root": pa.array([0, 0, 2, 3, 4]), "number": pa.array([1] * 5, pa.int32()), "numbers": pa.array([[1]] * 5, pa.list_(pa.int32())), "sketch": pa.array([near.sketch(x).tobytes() for x in some]), "set": pa.array([x.view(np.int64) for x in some], pa.list_(pa.int64()))})
    got = [(a, b) for out in near._met(iter([batch]), 64, 1024, near.tables(100), 0.8) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    label = {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    for a, b in got:
        common = len(np.intersect1d(some[a], some[b]))
        assert common >= 0.8 * (len(some[a]) + len(some[b]) - common)
        label = {k: min(label[a], label[b]) if v in (label[a], label[b]) else v for k, v in label.items()}
    assert len(got) <= 10 and label == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}


def test_near_dense_group_tries_the_nearest_and_stays_open():
    rng = np.random.default_rng(5)
    w = np.full(600, 12345, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    batch = pa.record_batch({"value": pa.array([1] * 600 + [2, 3, 3]), "key": pa.array(range(603)), "w": pa.array(np.r_[w, w[:3]].view(np.int64)), "x": pa.array(np.zeros(603, np.int64))})
    out = pa.Table.from_batches(near._tried(iter([batch]), (21, 36))).to_pandas()
    assert (out.kind == 2).sum() == 600 and {(601, 602)} == {(r.a, r.b) for r in out[out.kind == 0].itertuples()}
    assert 0 < (out.kind == 1).sum() < 5 * 600 and set(out[out.kind == 1][["a", "b"]].to_numpy().ravel()) == set(range(600))


def test_near_pairs_share_a_table():
    assert abs(near.differing(0.8) - 0.1515) < 1e-3
    for n in (100, 250_000, 1 << 35):
        places = near.tables(n)
        assert (1 - (1 - near.differing(0.8)) ** places.shape[1]) ** len(places) < near.MISS
    rng = random.Random(6)
    apart = []
    for _ in range(40):
        common, mine, yours = ([rng.getrandbits(64) for _ in range(k)] for k in (800, 100, 100))  # 0.8 of the union
        x, y = (near.sketch(np.array(common + own, np.uint64)) for own in (mine, yours))
        apart.append(int(np.bitwise_count(x ^ y).sum()) / (64 * near.WORDS))
    assert abs(np.mean(apart) - near.differing(0.8)) < 0.01


def test_sentencepiece_round_trip(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = round_trip(docs, PIECES).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is not None:
            ids = sp.encode(TEXTS[r["doc_id"]] or "")
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


CODEC, LIBRARY = Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst .,\n'▁é日—0▂", max_size=60))
def test_sentencepiece_ids(text):
    assert np.frombuffer(CODEC.encode_packed(text), np.int32).tolist() == LIBRARY.encode(text)


def test_sentencepiece_pairs_as_by_merging():
    c = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    pick, pieces = random.Random(5), sorted(c.made)
    pairs = [(pick.choice(pieces), pick.choice(pieces)) for _ in range(5000)] + [(p, p) for p in sorted(c.tangled)] + list(c.halves.values())[:2000]
    assert all(c.stands(a, b) == (c.merge(a + b) == [a, b]) for a, b in pairs)


def test_token_counts(spark, docs):
    t = Tokenizer.from_file(BYTES)
    odd = [(100 + i, "".join(random.Random(i).choices(" \n\t\u0085 ᠎\u001cab1'!é<|endoftext|>", k=60))) for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    text = dict(odd) | dict(enumerate(TEXTS)) | {None: "null id"}
    for head in (0, 1000):
        got = count_tokens(table, BYTES, head=head).collect()
        assert len(got) == table.count()
        assert all(r["n_tokens"] == len(t.encode(text[r["doc_id"]] or "", add_special_tokens=False)) for r in got)


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(400, x[3]), (401, [0.0] * 8), (402, None), (403, [float("nan")] * 8), (404, x[3]), (405, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(v, v.where("vec_id % 20 = 0"), k=5, shard_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    good = {i: np.array(e, np.float64) for i, e in rows if i not in (401, 402, 403, 405)}
    for q in (i for i in good if i % 20 == 0):
        assert got[q] == sorted((i for i in good if i != q), key=lambda i: (-(good[q] @ good[i]).round(12), i))[:5]
    assert nearest(v.limit(0), v.limit(0)).count() == 0


def neighbours(x: np.ndarray, k: int) -> dict[int, list[int]]:
    score = x @ x.T
    out = {}
    for q in range(0, len(x), 20):
        s = score[q].copy()
        s[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(x)), -s))[:k].tolist()
    return out


def test_nearest_beside_vectors_of_other_norms(spark):
    rng = np.random.default_rng(1)
    for scale in (1e8, 1e-6, 1e30):
        x = rng.normal(size=(600, 8))
        x[7] *= scale
        x[100:140] *= 1e3
        v = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got = {}
        for r in nearest(v, v.where("vec_id % 20 = 0"), k=5, shard_rows=60).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == neighbours(x, 5), scale


def test_nearest_recall_by_factor(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 6)), 20, axis=0) + 0.1 * rng.normal(size=(1200, 6))
    v = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    want, recall = neighbours(x, 10), {}
    for factor in (0.5, 0.8, 1.0):
        rows = nearest(v, v.where("vec_id % 20 = 0"), k=10, factor=factor, shard_rows=100).collect()
        recall[factor] = sum(r["vec_id"] in want[r["query_id"]] for r in rows) / sum(map(len, want.values()))
    assert recall[1.0] == 1.0 and recall[0.8] >= 0.9 and recall[0.5] <= recall[0.8] <= 1


def test_nearest_of_odd_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (0, [0.0, 2.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0]), (20, None), (40, [])]
    v = spark.createDataFrame([(*r, "mine", 1) for r in rows], "vec_id long, embedding array<double>, query string, rank int")
    got = nearest(v, v.where("vec_id % 20 = 0"), k=3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0)]


def test_language_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = language_id(docs, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.where("lang = lang_pred").count()
    assert right / found.count() > 0.95
    odd = identify(spark.createDataFrame([(None,), ("",), ("12 $$",)], "text string"), train(docs)).collect()
    assert {(r["lang_pred"], r["lang_score"]) for r in odd} == {("und", 0.0)}


def test_toxicity(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, docs, labels).join(labels, "doc_id").where("held_out")
    assert rows.where("predicted = toxic").count() / rows.count() > 0.9
    marked = [(r["score"], r["toxic"]) for r in rows.collect()]
    bad, good = ([x for x, y in marked if y == k] for k in (1, 0))
    pairs = [(x > y) + 0.5 * (x == y) for x in bad for y in good]
    assert sum(pairs) / len(pairs) > 0.9  # area under the curve
    assert sum(x >= 0.3 for x in bad) / len(bad) >= 0.5 and sum(x >= 0.3 for x in good) / len(good) <= 0.05
    assert toxicity(docs.limit(2), docs.limit(0), labels.limit(0)).select("score").distinct().collect() == [(0.5,)]


def test_packing_is_best_fit():
    for seed in range(20):
        rng = random.Random(seed)
        n = 60
        sizes, source, cluster = [rng.randint(1, 40) for _ in range(n)], [rng.choice([None, *"abcd"]) for _ in range(n)], [rng.choice([None, 1, 2, 3]) for _ in range(n)]
        bins, want = [], {}
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= sizes[k] and (source[k] is None or source[k] not in b[1]) and (cluster[k] is None or cluster[k] not in b[2])]
            left = min(fits)[0] if fits else 40
            want.setdefault(sizes[k], []).append(left)
            got = pack(sizes, source, cluster, 40)[k]
            if not fits:
                bins.append([40, set(), set()])
            if got >= len(bins):
                raise AssertionError("a bin too many")
            assert not fits or bins[got][0] == left
            bins[got][0] -= sizes[k]
            bins[got][1].add(source[k])
            bins[got][2].add(cluster[k])


def test_packing_table(docs):
    rows = best_fit_packing(docs, capacity=4, shard_rows=5).collect()
    assert {r["doc_id"] for r in rows} == {*range(len(TEXTS)), None} and all(r["place"] + r["n_tokens"] <= 4 for r in rows)
    assert best_fit_packing(docs.limit(0)).count() == 0


def brute_scores(words: list[list[str]], order: int, least: int) -> list[float]:
    count = {}
    for ws in words:
        for n in (1, 2, 3):
            for i in range(len(ws) - n + 1):
                count[tuple(ws[i : i + n])] = count.get(tuple(ws[i : i + n]), 0) + 1
    total, out = sum(map(len, words)), []
    for ws in words:
        want = 0.0
        for i in range(len(ws)):
            n = next((n for n in range(min(order, i + 1), 1, -1) if count[tuple(ws[i - n + 1 : i + 1])] >= least), 1)
            gram = tuple(ws[i - n + 1 : i + 1])
            want += np.log(count[gram] / (count[gram[:-1]] if n > 1 else total)) + (order - n) * np.log(0.4)
        out.append(want)
    return out


def test_lm_scores_equal_brute_force_whatever_is_numbered_or_broadcast(spark):
    rng = random.Random(9)
    alphabet = [f"w{i}" for i in range(40)] + ["é", "日本"]
    texts = ["a b c a b", "a b d", "", None, "a b c a b", "Z", *(" ".join(rng.choice(alphabet[: rng.randrange(2, 42)]) for _ in range(rng.randrange(1, 60))) for _ in range(60))]
    table = spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, score double")
    words = [(t or "").lower().split() for t in texts]
    for order, least, numbered, head in ((1, 2, 5, 0), (2, 2, 10, 30), (3, 2, 7, 10), (3, 1, 1000, 5), (2, 1, 0, 0), (3, 2, 1000, 1000)):
        want = brute_scores(words, order, least)
        rows = lm_scores(table, order=order, min_count=least, numbered=numbered, head=head).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert abs(r["log_score"] - want[r["doc_id"]]) < 1e-9 and r["n_words"] == len(words[r["doc_id"]]), (order, least, numbered, head)
            assert r["score"] == (None if not words[r["doc_id"]] else r["log_score"] / r["n_words"])


def test_lm_lots_give_back_what_they_take():
    rng = np.random.default_rng(4)
    kind = pa.struct([("id", pa.int64()), ("h", pa.int64())])
    numbers, want, got = [*range(6), *(lm_score._HASHED + np.arange(1, 6) * 10**15)], [], []
    lot, batches = lm_score._Lot(5, kind), []
    for start in (0, 4, 8, 12):
        lot.documents(pa.array([{"id": i, "h": -i} for i in range(start, start + 4)], kind))
        for n in (1, 2, 3):
            doc, words, count = rng.integers(0, 4, 50), [rng.choice(numbers, 50) for _ in range(n)], rng.integers(1, 2**40, 50)
            lot.add(doc, words, count)
            want += [(n, int(start + doc[i]), int(count[i]), *(int(w[i]) for w in words)) for i in range(50)]
        if start in (4, 12):
            batches += lot.flush()
    lots = pa.Table.from_batches(batches)
    for n in (1, 2, 3):
        for row in (r for r in lots.to_pylist() if r["size"] == n):
            for blob in row["parts"]:
                doc, count, words = lm_score._opened([blob], np.zeros(1, np.int64), n)
                got += [(n, row["docs"][doc[i]]["id"], int(count[i]), *(int(w[i]) for w in words)) for i in range(len(doc))]
                assert len({(lm_score._mixed(words) % 5)[i] for i in range(len(doc))} | {row["bucket"]}) == 1
    assert sorted(got) == sorted(want)


def test_lm_scores_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "_BUCKET", 40)
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    want = brute_scores([t.split() for t in texts], 2, 2)
    rows = lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), numbered=8, head=5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(30))
    assert all(abs(r["log_score"] - want[r["doc_id"]]) < 1e-9 for r in rows)


def test_lm_scores_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, None), (5, "b " * 30_000)], "doc_id long, text string")
    rows = lm_scores(odd).collect()
    want = dict(zip(["None", "3", "4", "5"], [brute_scores([["a", "b"]] * 4 + [[], ["b"] * 30_000], 2, 2)[i] for i in (0, 2, 4, 5)], strict=True))
    assert sorted(str(r["doc_id"]) for r in rows) == ["3", "3", "4", "5", "None", "None"]
    assert all(abs(r["log_score"] - want[str(r["doc_id"])]) < 1e-6 * max(1, abs(want[str(r["doc_id"])])) for r in rows)
    assert lm_scores(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="order"):
        lm_scores(odd, order=4)


def test_chat_links(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": a} for i, a in calls]})
    turns = [
        (1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}]})),
        (1, 1, "assistant", call(("b", {"x": {"$ref": "a"}}), ("a", {"x": 1}), ("a", {"x": 2}), ("c", {"y": 1}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": 2}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "q", "content": 1})),
        (2, 0, "user", None),
        (2, 1, "assistant", call(("p", {"x": {"$ref": "r"}}), ("r", {"x": {"$ref": "p"}}))),
        (None, None, None, "{broken"),
    ]
    rows = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    at = {(r["conv_id"], r["turn"], r["item"]): r for r in rows}
    assert at[1, 1, 1]["level"] == 2 and at[1, 1, 1]["after_turn"] == 2 and not at[1, 1, 1]["linked"]
    assert at[1, 1, 2]["linked"] and at[1, 1, 2]["errors"] == [] and at[1, 1, 3]["errors"] == ["identifier repeats"]
    assert at[1, 1, 4]["errors"] == ["$.x: missing"] and at[1, 3, 0]["errors"] == ["no such call"]
    assert at[1, 2, 0]["json"] == '{"content":{"b":2,"z":1},"role":"tool","tool_call_id":"a"}'
    assert "needs form a cycle" in at[2, 1, 1]["errors"] and at[None, None, 0]["json"] == '{"content":"{broken","role":null}'
    assert violations([1, "a"], {"items": {"type": "integer"}}) == ["$[1]: not integer"]


def test_pipeline(spark, small):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, small)
    assert 0 < rows.select(F.col("doc_id")).distinct().count() <= 200


def linked_by_hand(turns: list[tuple]) -> dict[tuple, tuple]:
    """(conv, turn, item) of calls to (level, after_turn, linked), by recursion over one conversation at a time."""
    out = {}
    for conv in {t[0] for t in turns}:
        calls, answered = {}, {}
        for _, turn, role, text in sorted((t for t in turns if t[0] == conv), key=lambda t: t[1]):
            value = json.loads(text)
            if role == "tool":
                answered.setdefault(value["tool_call_id"], turn)
            else:
                for i, c in enumerate(value["tool_calls"]):
                    refs = {v["$ref"] for v in c["arguments"].values() if isinstance(v, dict)}
                    calls.setdefault(c["id"], (turn, i + 1, refs))

        def settle(mark: str, path: tuple = ()) -> tuple | None:
            if mark in path:
                return None
            turn, _, refs = calls[mark]
            below = [settle(r, (*path, mark)) for r in refs if r in calls]
            if None in below:
                return None
            return (2 + max(b[0] for b in below) if below else 0, max([turn, *(max(b[1], answered.get(r, -1)) for b, r in zip(below, [r for r in refs if r in calls], strict=True))]))

        for mark, (turn, item, _) in calls.items():
            found = settle(mark)
            out[conv, turn, item] = (*(found or (None, turn)), mark in answered)
    return out


def test_chat_links_equal_those_by_hand(spark):
    rng = random.Random(12)
    turns = []
    for conv in range(120):
        marks = [f"c{i}" for i in range(rng.randrange(2, 14))]
        order, turn = rng.sample(marks, len(marks)), 0
        while order:
            now, order = order[: rng.randrange(1, 4)], order[rng.randrange(1, 4) :] if rng.random() < 0.1 else order[len(order[: 3]) :]
            calls = [{"id": m, "name": "f", "arguments": {"x": 1} | {f"r{k}": {"$ref": rng.choice([*marks, "gone"])} for k in range(rng.choice((0, 0, 0, 1, 2)))}} for m in now]
            turns.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            turn += 1
            for m in now:
                if rng.random() < 0.7:
                    turns.append((conv, turn, "tool", json.dumps({"tool_call_id": m, "content": turn})))
                    turn += 1
    for k in range(1, 60):  # one long chain
        turns.append((999, k, "assistant", json.dumps({"tool_calls": [{"id": f"n{k}", "name": "f", "arguments": {"x": {"$ref": f"n{k - 1}"}}}]})))
    table = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, level string").coalesce(2)
    want = linked_by_hand(turns)
    rows = [r for r in format_chats(table).collect() if r["kind"] == "call"]
    got = {(r["conv_id"], r["turn"], r["item"]): (r["level"], r["after_turn"], r["linked"]) for r in rows if "identifier repeats" not in r["errors"]}
    assert len(want) > 500 and got == want and any(v[0] is None for v in want.values()) and max(v[0] or 0 for v in want.values()) >= 100
    assert format_chats(table.limit(0)).count() == 0


def test_packing_in_shards_wastes_little(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 400), f"s{rng.randrange(300)}") for i in range(3000)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, bin int")
    used = {}
    for shard_rows in (100_000, 500):
        packed = best_fit_packing(table, capacity=512, shard_rows=shard_rows).collect()
        assert len(packed) == 3000
        used[shard_rows] = len({(r["shard"], r["bin"]) for r in packed})
    least = sum(r["n_tokens"] for r in packed) / 512
    assert least <= used[100_000] <= used[500] <= 1.1 * used[100_000]


def test_rare_words_are_found_without_numpy():
    from tidemark.llm.lm_score import WordNumbers

    hashes = np.sort(np.array([WordNumbers()[w] for w in ("a", "b", "é")], np.int64))
    want = {w: int(hashes.searchsorted(WordNumbers()[w])) for w in ("a", "b", "é")}
    numbers = WordNumbers(hashes.copy())
    hashes_of = [v for k, v in vars(numbers).items() if isinstance(v, np.ndarray)]
    assert not hashes_of and {w: numbers[w] for w in want} == want
    assert numbers["z"] == WordNumbers()["z"] >= 1 << 62
