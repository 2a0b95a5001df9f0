import hashlib
import re
import struct

import cases
import pytest
import xxhash
from pyspark.sql import functions as F

from fairlead import llm
from fairlead.llm import fingerprint, quotes



def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def expected(text, fraction=fingerprint.FRACTION):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower(text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def joined(part):
        seed = 42
        for h in part:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        return signed(seed)

    k = fingerprint.SHINGLE
    found = [joined(hashes[i : i + k]) for i in range(len(hashes) - k + 1)] if len(hashes) >= k else [joined(hashes)] * bool(hashes)
    limit = -(1 << 63) + (1 << 64) // fraction
    return sorted({h for h in found if h < limit}) or ([min(found)] if found else [])


def likeness(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_query_against_brute_force(spark, tmp_path):
    rows = sorted({(i, t) for i, t in cases.texts() if i is not None and i not in (2, 15)}, reverse=True)
    docs = cases.frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.op8_document_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for place, (i, text) in enumerate(rows):
        text, after = text or "", rows[(place + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, new = expected(text), expected(edited)
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in own)
        assert r["edited_fingerprint"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in new)
        assert r["near_edited"] == pytest.approx(likeness(own, new)) and r["near_next"] == pytest.approx(likeness(own, expected(after)))


def exact(a, b):
    """Jaccard similarity of the sets of shingles as texts, without hashes."""

    def shingles(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]
        k = fingerprint.SHINGLE
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())

    return likeness(shingles(a), shingles(b))


@pytest.mark.parametrize("words", [3, 12, 49, 149, 600])
def test_likeness_is_exact_in_every_length_class(spark, tmp_path, words):
    texts = []
    for i in range(12):
        # Every second text is a near copy of the one before.
        text = cases.prose(1000 * words + i // 2, words)
        texts.append(text if i % 2 else text.rsplit(" ", 1)[0] + f" word{i}")
    rows = list(enumerate(texts))[::-1]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.op8_document_fingerprints(spark, str(tmp_path)).collect()}
    for place, (i, text) in enumerate(rows):
        after = rows[(place + 1) % len(rows)][1]
        third = len(text) // 3
        assert got[i]["near_edited"] == pytest.approx(exact(text, text[: len(text) - third] + after[:third]))
        assert got[i]["near_next"] == pytest.approx(exact(text, after))


@pytest.mark.parametrize("fraction", [1, 4, 8])
def test_fraction_of_the_hashes(spark, fraction):
    """Fingerprints, merging, and the error of likeness and containment by length class."""
    error = {}
    for words in (50, 150, 600, 3000):
        pairs = []
        for i in range(10):
            tokens = cases.prose(100 * words + i, words).split()
            pairs.append((" ".join(tokens), " ".join(tokens[: -(words // 4)] + cases.prose(-words - i, words // 4).split())))
        rows = spark.createDataFrame(pairs, "a string, b string")
        for c in "ab":
            rows = fingerprint.with_fingerprint(rows, c, f"f{c}", fraction)
        got = rows.select("*", fingerprint.likeness("fa", "fb").alias("like"), fingerprint.merged("fa", "fb", fraction).alias("both")).collect()
        off = []
        for r in got:
            assert r["fa"] == expected(r["a"], fraction) and r["fb"] == expected(r["b"], fraction)
            # Of texts without a hash under the limit only the smaller smallest hash stays.
            union = set(r["fa"]) | set(r["fb"])
            under = {h for h in union if h < -(1 << 63) + (1 << 64) // fraction}
            assert r["both"] == sorted(under or {min(union)})
            off.append(abs(r["like"] - exact(r["a"], r["b"])))
        error[words] = sum(off) / len(off)
    assert error[50] <= 2.5 * (fraction - 1) ** 0.5 * 0.5 / 50**0.5 + 1e-9
    assert error[3000] <= 2.5 * (fraction - 1) ** 0.5 * 0.5 / 3000**0.5 + 1e-9


@pytest.mark.parametrize("fraction", [1, 4, 8])
def test_containment_of_very_unequal_texts(spark, fraction):
    long = cases.prose(77, 20_000)
    tokens = long.split()
    inside, half = " ".join(tokens[4000:4050]), " ".join(tokens[4000:4027] + cases.prose(78, 27).split())
    rows = spark.createDataFrame([(long, inside, half, cases.prose(79, 50))], "l string, i string, h string, o string")
    for c in "liho":
        rows = fingerprint.with_fingerprint(rows, c, f"f{c}", fraction)
    r = rows.select(
        "*",
        *[fingerprint.containment(f"f{c}", "fl").alias(f"c{c}") for c in "iho"],
        fingerprint.merged("fl", "fi", fraction).alias("both"),
    ).first()
    assert r["ci"] == 1.0 and r["co"] == 0.0 and r["both"] == r["fl"] == expected(long, fraction)
    assert r["ch"] == pytest.approx(0.46, abs=0.01 if fraction == 1 else 0.5)


@pytest.mark.parametrize("step", [1, 10_007, 10**12])
def test_following_of_dense_and_sparse_keys(spark, step):
    keys = [k * step for k in range(-40, 200)]
    got = fingerprint.following(spark.createDataFrame([(k,) for k in keys], "key bigint")).collect()
    assert {r["key"]: r["following"] for r in got} == {k: keys[i - 1] for i, k in enumerate(keys)} and len(got) == len(keys)


def test_following_of_one_and_of_no_key(spark):
    one = fingerprint.following(spark.createDataFrame([(5,)], "key bigint")).collect()
    assert [tuple(r) for r in one] == [(5, 5)]
    assert fingerprint.following(spark.createDataFrame([], "key bigint")).count() == 0


def test_rows_without_id_and_repeats(spark, tmp_path):
    cases.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op8_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(cases.texts())
    assert all((r["near_next"] is None) == (r["doc_id"] is None) for r in got)
    cases.empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprint.op8_document_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_merging_and_containment(spark):
    a, b = cases.prose(1, 300), cases.prose(2, 40)
    both = spark.createDataFrame([(a, b, a + "\n" + b, "w", "")], "a string, b string, c string, d string, e string")
    for c in "abcde":
        both = fingerprint.with_fingerprint(both, c, f"f{c}")
    row = both.select(
        fingerprint.merged("fa", "fb").alias("union"), "fa", "fb", "fc",
        fingerprint.containment("fb", "fc").alias("inside"), fingerprint.merged("fd", "fa").alias("small"),
        fingerprint.containment("fe", "fa").alias("none"),
    ).first()
    assert row["union"] == sorted(set(row["fa"]) | set(row["fb"])) and row["inside"] == 1.0 and row["none"] is None
    assert row["small"] == row["fa"] or len(row["small"]) == len(row["fa"]) + 1


@pytest.mark.parametrize("keys", [[5], [0, 1, 255, 256, 70_000, 70_001, 10**12, -1, -300], list(range(0, 200_000, 777))])
def test_following(spark, keys):
    got = dict(map(tuple, fingerprint.following(spark.createDataFrame([(k,) for k in keys], "key bigint")).collect()))
    order = sorted(keys, reverse=True)
    assert got == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}


FIRST = "Hello there, how are you today?\nSecond line of the message."
MESSAGES = [
    (1, 0, "user", FIRST),
    (1, 1, "bot", "> Hello there, how are you   TODAY?\n> Second line of the message.\n\nI am fine, thank you very much."),
    (1, 2, "user", "> > Hello there, how are you today?\n> I am fine, thank you very much.\n\nGreat to hear that from you."),
    (1, 3, "user", ">> I am fine, thank you very much.\r\n> Great to hear that from you.\nbye"),
    (1, 4, "bot", "> Second line of the message."),
    (1, 5, "bot", "no quote at all"),
    (1, 5, "bot", "no quote at all"),
    (1, 6, None, None),
    (1, 7, "x", ""),
    (1, 8, "x", "> ok\n> unheard of words here\nso"),
    (2, 0, "a", "> Hello there, how are you today?"),
    (2, None, "a", FIRST),
    (None, 1, "a", "> Hello there, how are you today?"),
]


def messages(spark, rows=MESSAGES):
    full = [(*r, "clash", 1, "clash") for r in rows]
    return spark.createDataFrame(full, "conv_id bigint, turn bigint, role string, text string, version string, slice int, row string")


def test_quotes_are_linked_and_removed(spark):
    out = quotes.link_quotes(messages(spark))
    assert out.columns[:7] == messages(spark).columns
    got = {(r["conv_id"], r["turn"]): (r["text"], r["_reply_to"], r["_thread"], r["_depth"]) for r in out.collect()}
    assert out.count() == len(MESSAGES)
    assert got == {
        (1, 0): (FIRST, None, 0, 0),
        (1, 1): ("I am fine, thank you very much.", 0, 0, 1),
        (1, 2): ("Great to hear that from you.", 1, 0, 2),
        (1, 3): ("bye", 2, 0, 3),
        (1, 4): ("", 0, 0, 1),
        (1, 5): ("no quote at all", None, 5, 0),
        (1, 6): (None, None, 6, 0),
        (1, 7): ("", None, 7, 0),
        (1, 8): ("so", None, 8, 0),
        (2, 0): ("", None, 0, 0),
        (2, None): (FIRST, None, None, 0),
        (None, 1): ("", None, 1, 0),
    }


SHORT = [
    (4, 0, "a", "No thanks"),
    (4, 1, "b", "Yes, agreed"),
    (4, 2, "a", "好的"),
    (4, 3, "b", "> Yes,  AGREED\nfine"),
    (4, 4, "b", "> 好的\n谢谢"),
    (4, 5, "a", "> fine"),
    (4, 6, "a", "> No thanks\n> never said"),
    (4, 7, "a", "This one is longer than the others.\nok"),
    (4, 8, "b", "ok"),
    # Most quoted characters decide, though a later message said the short line.
    (4, 9, "b", "> This one is longer than the others.\n> ok"),
    (4, 10, "b", "> ok"),
]
LEVELS = [
    (5, 0, "a", "first\nwords of two lines"),
    (5, 1, "b", "> first\n> words of two lines\nsecond"),
    (5, 2, "a", ">> first\n>> words of two lines\n> second\n\nthird"),
    (5, 3, "b", "> > second\n> third\nfourth\n>>> first"),
    (5, 4, "a", "  > fourth\n\t>> third"),
    (5, 5, "b", ">\n> \n>>"),
]


@pytest.mark.parametrize("rows", [None, SHORT, LEVELS])
def test_sql_gives_the_same_links(spark, tmp_path, rows):
    import duckdb

    (messages(spark) if rows is None else messages(spark, rows)).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.execute(llm.ORACLES["op10_quotation_linking"]).fetchall()
    got = quotes.op10_quotation_linking(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert sum(r["reply_to"] is not None for r in got) >= 4


def test_short_passages_are_linked(spark):
    rows = SHORT
    got = {r["turn"]: (r["_reply_to"], r["_thread"], r["_depth"]) for r in quotes.link_quotes(messages(spark, rows)).collect()}
    replies = {3: (1, 1, 1), 4: (2, 2, 1), 5: (3, 1, 2), 6: (0, 0, 1), 9: (7, 7, 1), 10: (8, 8, 1)}
    assert got == {t: replies.get(t, (None, t, 0)) for t in range(11)}


def test_latest_earlier_original_over_slices(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SLICE", 4)
    said = "the same words again and again"
    rows = [(7, t, "u", said if t % 5 == 0 else f"> {said}\nanswer {t}") for t in range(40)]
    got = {r["turn"]: r["_reply_to"] for r in quotes.link_quotes(messages(spark, rows)).collect()}
    assert got == {t: None if t % 5 == 0 else t - t % 5 for t in range(40)}


def test_long_chain_of_replies(spark):
    rows = [(3, 0, "u", "message number zero is here")]
    rows += [(3, t, "u", (f"> message number {t - 1} is here" if t > 1 else "> message number zero is here") + f"\nmessage number {t} is here") for t in range(1, 70)]
    got = {r["turn"]: (r["_reply_to"], r["_thread"], r["_depth"]) for r in quotes.link_quotes(messages(spark, rows)).collect()}
    assert got == {t: (t - 1 if t else None, 0, t) for t in range(70)}


def test_no_messages(spark):
    assert quotes.link_quotes(messages(spark, [])).count() == 0
    assert quotes.link_quotes(messages(spark)).agg(F.count("*")).first()[0] == len(MESSAGES)
