import random
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairlead.llm import pieces, quality
from fairlead.llm.common import table


def test_held_out_accuracy(spark, sf_dir):
    got = quality.op2_quality_classifier(spark, sf_dir)
    rows = got.join(table(spark, sf_dir, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    assert got.count() == table(spark, sf_dir, "documents").count()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_scores_of_edge_cases(spark):
    docs = cases.frame(spark)
    known = [(i, i % 2, 0) for i, _ in cases.texts() if i is not None] * 2 + [(None, 1, 0), (3, None, 0)]
    model = quality.fit(docs, labels(spark, known), epochs=2)
    got = quality.score(docs, model).collect()
    assert len(got) == len(cases.texts()) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.accepted(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(cases.texts())
    assert quality.accepted(docs, model, threshold=1.1).count() == 0


def test_scores_without_labels_or_rows(spark):
    docs = cases.frame(spark)
    model = quality.fit(docs, labels(spark, []))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    model = quality.fit(cases.empty(spark), labels(spark, [(1, 1, 0)]))
    assert quality.score(cases.empty(spark), model).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels(spark, [(i, 1, 0) for i in range(20)]))).collect()} == {1.0}


def test_fold_zero_and_bound_of_the_sample(spark):
    known = labels(spark, [(i, i % 2, 0) for i in range(500)])
    sample = quality.labelled_sample(known, 100).collect()
    assert len(sample) == 100 and all(r["fold"] != 0 for r in sample)
    # Under the cut-off lie the same rows as in a ranking of all.
    known = labels(spark, [(i, i % 2, 0) for i in range(2000)])
    ranked = known.filter(quality.fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id")).limit(100).collect()
    assert {r["id"] for r in quality.labelled_sample(known, 100).collect()} == {r["doc_id"] for r in ranked}


def plain_vectors(rows, window, share):
    """Every word's neighbours looked up one by one: hashes with their own row, and the unit vectors by row."""
    texts = [quality.words_of(pa.array([t], pa.string()), False)[0].tolist() for _, t in rows]
    counts = Counter(h for t in texts for h in t)
    words = sorted(h for h, n in counts.items() if n >= share * counts.total())
    place = {h: k for k, h in enumerate(words)}
    out = np.zeros((len(words) + quality.BUCKETS, quality.DIMS))
    for text in texts:
        for i, h in enumerate(text):
            shared = int(quality.mix(np.array([h], np.uint64))[0]) % quality.BUCKETS
            for other in text[max(0, i - window) : i] + text[i + 1 : i + 1 + window]:
                for j in range(4):
                    part = other >> (16 * j)
                    out[place.get(h, len(words) + shared), part & 63] += -1.0 if part >> 6 & 1 else 1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return words, out / np.where(norms > 0, norms, 1)


@pytest.mark.parametrize("window, share", [(1, 1e-5), (3, 0.002), (2, 0.9)])
def test_word_vectors_against_plain_sums(spark, window, share):
    rows = [(i, t) for i, t in cases.texts() if t is None or len(t) < 20_000]
    words, vectors = plain_vectors(rows, window, share)
    one = quality.word_vectors(cases.frame(spark, rows).coalesce(1), window=window, share=share)
    many = quality.word_vectors(cases.frame(spark, rows).repartition(7), window=window, share=share)
    for got in (one, many):
        assert got.words.tolist() == words and np.allclose(got.rows, vectors, atol=1e-6)
    assert np.array_equal(one.rows, many.rows) and len(words) <= 1 / share


def test_context_sums_handed_over_in_parts(spark, monkeypatch):
    # Changed constants do not reach the workers, so steps and parts are tried without Spark.
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in cases.texts() if not t or len(t) < 20_000])], ["text"])
    words = type("Sent", (), {"value": np.sort(np.unique(quality.words_of(batch.column(0), False)[0])[:50])})
    whole = list(quality._add_up(quality._context_sums(words, 2)(iter([batch]))))
    monkeypatch.setattr(quality, "_FLUSH", 1)
    monkeypatch.setattr(quality, "_STEP", 7)
    monkeypatch.setattr(quality, "small_batches", lambda batches: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    parts = list(quality._add_up(quality._context_sums(words, 2)(iter([batch]))))
    key = lambda batches: {r["bucket"]: r["vector"] for b in batches for r in b.to_pylist()}
    full = {k: v for k, v in key(parts).items() if any(v)}
    assert full == {k: v for k, v in key(whole).items() if any(v)} and len(full) > 50


def test_words_of_their_own_do_not_drift_with_size(spark):
    rows = [(i, t) for i, t in cases.texts() if i != 13]
    once = quality.frequent_words(cases.frame(spark, rows).select("text"), 0.001)
    more = quality.frequent_words(cases.frame(spark, rows * 5).select("text"), 0.001)
    assert len(once) and np.array_equal(once, more)
    assert len(quality.frequent_words(cases.empty(spark).select("text"))) == 0


def test_document_vectors_match_a_plain_sum(monkeypatch):
    texts = ["Aa bb bb !!", "", "x", "one two three " * 50]
    hashes, _, begins = quality.words_of(pa.array(texts), False)
    own = np.unique(hashes[:3])
    rows = np.random.default_rng(1).normal(size=(len(own) + quality.BUCKETS, quality.DIMS)).astype(np.float32)
    vectors = quality.Vectors(own, rows)
    whole = quality.document_vectors(pa.array(texts), vectors)
    monkeypatch.setattr(quality, "_STEP", 3)
    assert np.allclose(whole, quality.document_vectors(pa.array(texts), vectors), atol=1e-4)
    places = [own.tolist().index(h) if h in own else len(own) + int(quality.mix(np.array([h]))[0] % np.uint64(quality.BUCKETS)) for h in hashes[: begins[1]]]
    assert np.allclose(whole[0, : quality.DIMS], rows[places].mean(0), atol=1e-5) and not whole[1].any()


def test_temperature_recovers_calibration():
    rng = np.random.default_rng(2)
    true = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-true))).astype(float)
    assert abs(quality._temperature(true * 3, y) - 3) < 0.3


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load().prepare()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def hard_texts():
    rng = random.Random(3)
    letters = "abcdeinorst.,'é \n▁ 0123日"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    out += ["", " ", "  ", "a ", " a", "   x   y  ", "\n\n\t tab", "日本語 🎉🎉 é́", "x" * 3000, "== " * 50, " " * 160 + "if x:"]
    return out + ["a\u0000b", "der der" * 200, "don't  stop -- ...... !!!!!! ????", "1234567890" * 20]


def test_ids_are_those_of_the_library(vocabulary, library):
    texts = hard_texts() + [t for _, t in cases.texts() if t]
    for text, ids in zip(texts, vocabulary.encode(texts)):
        assert ids.tolist() == (library.encode(text) if text else []), text[:80]


def test_round_trip(vocabulary):
    for text, ids in zip(hard_texts(), vocabulary.encode(hard_texts())):
        # The space mark itself cannot be told from a blank.
        assert vocabulary.decode(ids) == text.replace(pieces.MARK, " ")


def test_forgetting_words_changes_nothing(vocabulary, monkeypatch):
    texts = hard_texts()
    whole = [i.tolist() for i in vocabulary.encode(texts)]
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    assert [i.tolist() for i in vocabulary.encode(texts)] == whole


def test_unigram_walk_finds_the_best_sum():
    rng = random.Random(4)
    names = sorted({pieces.MARK, *"abc"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)} | {pieces.MARK + "ab", pieces.MARK + "a"})
    scores = [-rng.random() * 5 - 1 for _ in names]
    model = pieces.Vocabulary(["<unk>", *names], [0.0, *scores], "u" + "n" * len(names), merges=False).prepare()

    def best(word):
        table = [(0.0, [])] + [(-1e9, [])] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                part = word[i:j]
                if part in model.ids and table[i][0] + model.scores[model.ids[part]] > table[j][0]:
                    table[j] = (table[i][0] + model.scores[model.ids[part]], [*table[i][1], model.ids[part]])
        return table[-1][0]

    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 15))) for _ in range(200)]
    for word, ids in zip(words, model.encode(words)):
        assert abs(sum(model.scores[i] for i in ids) - best(pieces.MARK + word)) < 1e-9
    assert model.decode(model.encode(["ab?a"])[0]).count("⁇") == 1


def test_encoding_of_edge_cases(spark, library):
    docs = cases.frame(spark)
    encoded = pieces.encode(docs, pieces.load(), check=True)
    for r, (_, text) in zip(sorted(encoded.collect(), key=str), sorted(cases.texts(), key=str)):
        assert (r["tokens"] is None) == (r["round_trip"] is None)
    assert encoded.filter("round_trip").count() == sum(t is not None for _, t in cases.texts())
    back = pieces.decode(encoded, pieces.load()).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, cases.texts()))
    assert pieces.encode(cases.empty(spark), pieces.load()).count() == 0
