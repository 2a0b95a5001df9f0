import hashlib
import random
import re

import cases
import numpy as np
import pytest

from fairlead.llm import decontaminate, pii, suffix


def expected_repeats(rows):
    """(id, bytes, removed, spans, digest) by a set of all windows so far."""
    seen, out, done = set(), [], {}
    import xxhash

    versions = {}
    for i, text in rows:
        h = xxhash.xxh64_intdigest((text or "").encode(), 42)
        versions[i, text] = h - (1 << 64) if h >= 1 << 63 else h
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, versions[r])):
        data = (text or "").encode()
        if (i, text or "") in done and i is not None:
            out.append(done[i, text or ""])
            continue
        gone = np.zeros(len(data), bool)
        if i is not None:
            for s in range(len(data) - 99):
                if data[s : s + 100] in seen:
                    gone[s : s + 100] = True
                seen.add(data[s : s + 100])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        done[i, text or ""] = (i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        out.append(done[i, text or ""])
    return sorted(out, key=str)


def removed(spark, rows, **settings):
    got = suffix.remove_repeats(cases.frame(spark, rows), **settings)
    return sorted(map(tuple, got.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"shard": 3000, "most_pieces": 2}, {"shard": 700}])
def test_repeats_of_edge_cases(spark, settings):
    rows = [(i, t) for i, t in cases.texts() if i != 13]
    assert removed(spark, rows, **settings) == expected_repeats(rows)


def test_repeats_in_many_documents(spark):
    rng = random.Random(2)
    passage = cases.prose(9, 60)
    rows = [(i, cases.prose(100 + i, rng.randint(1, 60)) + passage[rng.randrange(80) :] + str(i)) for i in range(60)]
    rows += [(100 + i, "0123456789" * rng.randint(5, 40) + "é" * rng.randint(0, 90)) for i in range(10)]
    assert removed(spark, rows, shard=2000, most_pieces=5) == expected_repeats(rows)


def test_repeats_spans_and_empty_table(spark):
    text = cases.prose(4, 100)
    row = suffix.remove_repeats(cases.frame(spark, [(1, text), (2, "ü" + text)])).filter("id = 2").first()
    n = len(text.encode())
    assert row["spans"] == [2, 2 + n] and bytes(row["kept"]).decode() == "ü"
    assert suffix.remove_repeats(cases.empty(spark)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 99, 900, np.uint8), np.zeros(500, np.uint8), np.frombuffer(b"abcab" * 90, np.uint8)):
        sa, same = suffix.suffix_array(data, 100)
        text = data.tobytes()
        order = [text[i : i + 100] for i in sa]
        assert order == sorted(order) and sorted(sa) == list(range(len(data)))
        # Ends of the text are shorter than a window and equal nothing here.
        for k in range(1, len(sa)):
            if max(sa[k], sa[k - 1]) + 100 <= len(data):
                assert same[k] == (order[k] == order[k - 1])


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while nobody is looking at the garden fence."),
    (2, "Another passage of the benchmark,\nwith two lines and É accents that go on for a while longer."),
    (2, "Second text of item two that is long enough to be found in documents with a few edits inside."),
    (3, None),
    (4, ""),
    (5, "short"),
    (6, "a" * 120),
    (None, "An item without an id is still an item and is found in whatever document carries its text."),
]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_id bigint, text string, doc_id string")


def nearest(item, text):
    """Fewest edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def compared(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.sub("[ \t\n\x0b\x0c\r]+", " ", low)


def edited(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = "#"
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, "q")
    return "".join(out)


def leaking_rows():
    rng = random.Random(6)
    rows = list(cases.texts())
    rows = [r for r in rows if r[0] not in (12, 13)]
    texts = [t for _, t in ITEMS if t]
    for i in range(120):
        text = rng.choice(texts)
        rows.append((1000 + i, cases.prose(i, rng.randint(0, 40)) + " " + edited(rng, text, rng.randint(0, 9)) + " " + cases.prose(i + 1, rng.randint(0, 20))))
    rows += [(2000, ITEMS[0][1].upper().replace(" ", "\n ")), (2001, ITEMS[0][1][:50]), (2002, "b" + "a" * 400 + "b")]
    # Two halves in neighbouring rows are no match.
    return rows + [(2003, ITEMS[1][1][:45]), (2004, ITEMS[1][1][45:])]


def test_leaks_against_full_alignment(spark, monkeypatch):
    rows = leaking_rows()
    found = decontaminate.contaminations(cases.frame(spark, rows), benchmark(spark)).collect()
    got = {(r["doc"], r["item"], r["edits"]) for r in found}
    expected = set()
    for i, text in rows:
        for item, passage in ITEMS:
            if text and passage:
                edits = nearest(compared(passage.strip()), compared(text))
                if edits <= int(len(compared(passage.strip())) * decontaminate.RATE):
                    expected.add((i, item, edits))
    assert got == expected and len(expected) > 60
    texts = dict(rows)
    for r in found:
        if r["edits"] == 0 and r["doc"] is not None and r["doc"] not in (2, 15):
            assert compared(texts[r["doc"]][r["start"] : r["stop"]]) in {compared(t.strip()) for _, t in ITEMS if t}


def test_leaks_do_not_depend_on_parts_or_blocks(spark, monkeypatch):
    rows = leaking_rows()[-60:]
    items = next(decontaminate.item_blocks(benchmark(spark)))
    with np.errstate(over="ignore"):
        whole = sorted(decontaminate.matches([t for _, t in rows], items))
        monkeypatch.setattr(decontaminate, "PART", 50)
        assert sorted(decontaminate.matches([t for _, t in rows], items)) == whole
        long = "x " * 700 + rows[-4][1]
        assert [m[4] for m in decontaminate.matches([long], items)] == [m[4] for m in decontaminate.matches([rows[-4][1]], items)]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 120)
    docs = cases.frame(spark, rows)
    split = decontaminate.contaminations(docs, benchmark(spark)).select("doc", "item", "edits").collect()
    monkeypatch.undo()
    assert sorted(map(str, split)) == sorted(map(str, decontaminate.contaminations(docs, benchmark(spark)).select("doc", "item", "edits").collect()))


def test_clean_documents_stay(spark):
    rows = leaking_rows()
    docs = cases.frame(spark, rows)
    leaks = {r["doc"] for r in decontaminate.contaminations(docs, benchmark(spark)).collect()}
    kept = decontaminate.clean_documents(docs, benchmark(spark))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - leaks
    assert decontaminate.clean_documents(cases.empty(spark), benchmark(spark)).count() == 0
    assert decontaminate.clean_documents(docs, benchmark(spark, [])).count() == len(rows)
    assert decontaminate.contaminations(docs, benchmark(spark, [(1, None)])).count() == 0


PERSONS = (
    "Mr. John Smith (john.smith@corp.co.uk, +1 (017) 555-7713) met Frau Müller-Lüdenscheid. Smith paid with "
    "4111 1111 1111 1111 from 10.0.0.7, SMITH again; г-жа Анна Иванова, 123-45-6789, GB82 WEST 1234 5698 7654 32, "
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", 9807915762804490.'
)


def test_surrogates_keep_type_and_format():
    new, n = pii.replace(PERSONS, b"key")
    old_found, new_found = pii.find(PERSONS), pii.find(new)
    assert n == len(old_found) == len(new_found) == 16
    assert [k for *_, k, _ in old_found] == [k for *_, k, _ in new_found]
    shape = lambda s: re.sub(r"\d", "9", s)
    for (a, b, kind, canon), (c, d, _, other) in zip(old_found, new_found):
        assert canon != other
        if kind in ("phone", "card", "ssn"):
            assert shape(PERSONS[a:b]) == shape(new[c:d])
        if kind == "card":
            assert (pii.luhn(canon) == 0) == (pii.luhn(other) == 0)
    assert re.search(r"from 10\.\d", new) and ".example" in new
    smith = [new[c:d] for (_, _, _, canon), (c, d, _, _) in zip(old_found, new_found) if canon == "smith"]
    assert len(smith) == 3 and smith[0] == smith[1] and smith[2] == smith[0].upper()
    anna = next(new[c:d] for (_, _, _, canon), (c, d, _, _) in zip(old_found, new_found) if canon == "анна")
    assert re.fullmatch("[А-Я][а-я]+а", anna)
    iban = next(other for *_, k, other in new_found if k == "iban")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.replace(PERSONS, b"key")[0] == new != pii.replace(PERSONS, b"other")[0]


FOUND = {
    "phone": [
        "+1 (017) 555-7713", "(743) 555-3824", "743-555-3824", "743.555.3824", "743 555 3824", "1-743-555-3824",
        "(743)555-3824", "0171 2345678", "0171/2345678", "(0171) 2345678", "020 7946 0958", "02-1234-5678",
        "01 23 45 67 89", "044 668 18 00", "(11) 91234-5678",
    ],
    "hex": ["0a" * 64, "0a" * 65, "9f" * 400, "deadbeef" * 4],
    "ip6": ["2001:db8::1", "2001:0DB8:0000:0000:0000:FF00:0042:8329", "fe80::1", "2a00:1450:4001:81b::200e", "2001:db8:0:0:0:0:0:9"],
    "ssn": ["012-34-5678"],
    "card": ["4111 1111 1111 1111"],
    "ip": ["10.0.0.7"],
}
PLAIN = [
    "01/02/2023", "01-02-2023", "2023-11-30 10:00", "12:34:56:78", "1,000,000 0.125", "std::vector a::b x[1::2]",
    "3.14159 1.2.3", "1 234 567", "(2019) 12345", "id 01712345678", "phone 2023-11-30", "1:2:3:4:5:6:7:8:9:a:b:c",
]


@pytest.mark.parametrize("kind", FOUND)
def test_national_phones_long_secrets_and_ip6_are_found(kind):
    for entity in FOUND[kind]:
        for text in (entity, f"ask {entity}.", f"at ({entity}), or", f"is\n{entity}\n"):
            begin = text.index(entity)
            found = pii.find(text)
            assert [x[:3] for x in found] == [(begin, begin + len(entity), kind)], text
            new, n = pii.replace(text, b"key")
            assert n == 1 and entity not in new and [x[2] for x in pii.find(new)] == [kind]
            if kind != "ip6":
                assert re.sub("[0-9a-f]+", "9", new) == re.sub("[0-9a-f]+", "9", text) or kind == "ip"


def test_phones_after_their_word_and_plain_numbers():
    for text in ("tel 01712345678", "Phone no.: 5553824", "Fax: 7435553824."):
        assert [x[2] for x in pii.find(text)] == ["phone"] and pii.replace(text, b"key")[0][:4] == text[:4]
    for text in PLAIN:
        assert pii.find(text) == [], text


def test_surrogates_of_edge_cases(spark):
    rows = [*cases.texts(), (500, PERSONS), (500, PERSONS), (501, "ask john.smith@corp.co.uk"), (None, "10.0.0.7"), (None, None)]
    docs = cases.frame(spark, rows)
    out = pii.pseudonymize(docs)
    assert out.columns == [*docs.columns, "_n_entities"] and out.count() == len(rows)
    got = {(r["doc_id"], r["_n_entities"]): r for r in out.collect()}
    assert got[500, 16]["text"] == pii.replace(PERSONS, pii.DEFAULT_KEY)[0] and got[500, 16]["version"] == "clash"
    mail = pii.surrogate(pii.DEFAULT_KEY, "email", "john.smith@corp.co.uk")
    assert mail in got[500, 16]["text"] and got[501, 1]["text"] == f"ask {mail}"
    assert got[None, 1]["text"] == pii.surrogate(pii.DEFAULT_KEY, "ip", "10.0.0.7")
    assert pii.pseudonymize(cases.empty(spark)).count() == 0


def test_clashes_are_resolved(spark):
    # Five possible values, one of which is a real entity.
    def few(key, kind, canon, attempt):
        return f"v{(int(canon[1:]) * 3 + attempt) % 6}"

    rows = [("k", f"e{i}") for i in range(5)] + [("k", "v2")] + [("other", "e0"), ("other", "e1")]
    entities = spark.createDataFrame([r for r in rows if r[1] != "v2"], "kind string, canon string")
    given = pii.assign(entities, b"", few).collect()
    for kind in ("k", "other"):
        values = [r["value"] for r in given if r["kind"] == kind]
        assert len(set(values)) == len(values)
    real = spark.createDataFrame([("k", "e1"), ("k", "v3")], "kind string, canon string")
    values = {r["canon"]: r["value"] for r in pii.assign(real, b"", few).collect()}
    assert "v3" not in values.values() and len(set(values.values())) == 2


def test_permutations_of_every_size_and_form():
    for size in (2, 3, 26, 1000):
        for attempt in range(3):
            moved = [pii._moved(b"k", "form", v, size, attempt) for v in range(size)]
            assert sorted(moved) == list(range(size)) and all(v != m for v, m in enumerate(moved))
        even = [pii._moved(b"k", "form", v, size, 0, lambda v: v % 2 == 0) for v in range(0, size, 2)]
        assert sorted(even) == list(range(0, size, 2))
    domains = {pii.surrogate(b"k", "email", f"a@{c}.com").split("@")[1] for c in "abcdefghijklmnopqrstuvwxyz"}
    assert len(domains) == 26 and pii.surrogate(b"k", "email", "b@e.com").split("@")[1] in domains
    assert pii.surrogate(b"k", "email", "a@e.org").split("@")[1] not in domains
    for valid in ("GB82WEST12345698765432", "GB83WEST12345698765432"):
        new = pii.surrogate(b"k", "iban", valid)
        assert (pii._iban_check("GB", new[4:]) == new[2:4]) == valid.startswith("GB82")
    cards = {pii.surrogate(b"k", "card", f"411111111111{n:04d}") for n in range(10_000)}
    assert len(cards) == 10_000 and sum(pii.luhn(c) == 0 for c in cards) == 1000


def test_crowded_ranges_end_with_distinct_surrogates(spark):
    rows = [("ip", f"192.168.{i // 256}.{i % 256}") for i in range(40_000)]
    rows += [("phone", f"5{i:02d}") for i in range(100)] + [("email", f"{c}@e.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("ssn", "012345678"), ("given_m", "john"), ("given_x", "john")]
    given = pii.assign(spark.createDataFrame(rows, "kind string, canon string"), b"k").collect()
    assert sorted((r["kind"], r["canon"]) for r in given) == sorted(rows)
    assert len({(r["kind"], r["value"]) for r in given}) == len(rows)
    assert all(r["value"] == pii.surrogate(b"k", r["kind"], r["canon"], r["attempt"]) != r["canon"] for r in given)
    # Where all values are real the first attempt stands; where half are free, the fewer are real.
    assert {r["attempt"] for r in given if r["kind"] == "phone"} == {0}
    ips = {c for k, c in rows if k == "ip"}
    assert sum(r["value"] in ips for r in given if r["kind"] == "ip") < 20_000


def test_forms_of_address_without_gender():
    for text in ("Dr. John Smith", "Prof. Anna Weber", "Señorita Ana López", "Signora Maria Rossi", "Frau Dr. Anna Weber"):
        assert [k.split("_")[0] for *_, k, _ in pii.find(text)] == ["given", "family"], text
    assert pii.find("Frau Dr. Anna Weber")[0][2] == "given_f" and pii.find("Dr. John Smith")[0][2] == "given_x"


def test_the_query_against_plain_replacement(spark, tmp_path):
    rng = random.Random(5)
    entities = ["Mr. John Smith", "Dr. Ana Smith", "j.smith@corp.com", "a@e.com", "a@j.com", "10.0.0.7", "8.8.8.8", "+44 20 7946 0958",
                "743-555-3824", "123-45-6789", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "fe80::1", "0a" * 20]
    rows = [(i, " | ".join([cases.prose(i, rng.randint(0, 30)), *rng.sample(entities, rng.randint(0, 9)), "end."])) for i in range(200)]
    # Real values that are first surrogates of others.
    rows += [(900 + i, f"see | {pii.surrogate(pii.DEFAULT_KEY, k, c)}") for i, (k, c) in enumerate([("ip", "10.0.0.7"), ("email", "a@e.com")])]
    rows += [(950, None), (951, "")]
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op1_pii_surrogates(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    real = {(k, c) for _, t in rows if t for *_, k, c in pii.find(t)}
    seen: dict[tuple[str, str], str] = {}
    for i, text in rows:
        found = {text[a:b]: (k, c) for a, b, k, c in pii.find(text)} if text else {}
        new = got[i]["text"]
        assert got[i]["n_entities"] == len(pii.find(text or "")) and (found or new == text)
        # What stands for an entity is the same everywhere; what lies between stays.
        old_parts, new_parts = (
            [w for part in (t or "").split(" | ") for w in (part.split(" ") if part[:2] in ("Mr", "Dr") else [part])]
            for t in (text, new)
        )
        assert len(old_parts) == len(new_parts)
        for old, put in zip(old_parts, new_parts):
            kind, canon = found.get(old, (None, None))
            value = pii.canonical(kind, put) if kind else None
            assert seen.setdefault((kind, canon), value) == value if kind else old == put
    assert set(seen) == real and all(canon != value for (_, canon), value in seen.items())
    assert len({(k, v) for (k, _), v in seen.items()}) == len(seen)
    assert not {(k, v) for (k, _), v in seen.items()} & real
