import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.llm import merkle, mixing, periodic

FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, digest string, leaves int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


# Merkle manifest


def leaf(row):
    fields = row[:5]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def way(levels, index, arity):
    out = []
    for level in levels[:-1]:
        first = index // arity * arity
        run = level[first : first + arity]
        out.append(("".join(run[: index - first]), "".join(run[index - first + 1 :])))
        index //= arity
    return out


def expected_manifest(rows, arity=16):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = levels_of([leaf(r) for r in groups[source]], arity)
    top = levels_of([trees[s][-1][0] for s in order], arity)
    root = top[-1][0] if order else None
    out = []
    for place, source in enumerate(order):
        for index, row in enumerate(groups[source]):
            steps = way(trees[source], index, arity) + way(top, place, arity)
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lowered = re.sub("[A-Z]", lambda m: m.group().lower(), row[4])
                node = leaf((*row[:4], lowered))
            for left, right in steps:
                node = sha(left, node, right)
            proof = sha(*(x + y for x, y in steps))
            out.append((row[0], leaf(row), trees[source][-1][0], root, proof, node, node == root))
    return out


def manifest_rows(hot=300, groups=40):
    rng = random.Random(3)
    rows = []
    for i, text in cases.texts():
        rows.append((i, rng.choice(["b", None, "", "é", "a"]), None if i == 3 else "de", len(text) if text else None, text))
    rows += [(1000 + i, "hot", "en", i, f"Text {i}" if i % 3 else f"text {i}") for i in range(hot)]
    rows += [(5000 + i, f"s{i}", None, i, "ONE") for i in range(groups)]
    rows += [(7, "twice", "en", 1, "Same row")] * 3
    return [(*row, "clash", "clash", 1) for row in rows]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_manifest_query_against_brute_force(spark, tmp_path):
    rows = manifest_rows()
    got = merkle.op11_merkle_manifest(spark, write(spark, tmp_path, rows, FIELDS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = expected_manifest(rows)
    assert order(got.collect()) == order(expected)
    assert {r[-1] for r in expected} == {True, False}


@pytest.mark.parametrize(("arity", "levels"), [(3, 1), (2, 2)])
def test_manifest_over_many_rounds(spark, arity, levels):
    rows = manifest_rows(30, 2)
    docs = spark.createDataFrame(rows, FIELDS).repartition(7)
    # A piece has 3 or 4 leaves here, so nodes, top tree and paths need several rounds.
    manifest = merkle.build(docs, merkle.leaf_hash(merkle.FIELDS), arity=arity, levels=levels)
    assert len(manifest.log) > 2 and len(manifest.top_log) > 1
    got = merkle.prove(manifest).select("id", "leaf", "subroot", "root", "proof_sha256", "verified").collect()
    assert order(got) == order((*r[:5], True) for r in expected_manifest(rows, arity))
    log = defaultdict(list)
    for r in manifest.full_log().collect():
        log[r["tree"]].append(r)
    for tree in log.values():
        # Positions are the places 0, 1, ... and every node follows its children.
        assert [r["position"] for r in tree] == list(range(len(tree)))
        place = {(r["level"], r["index"]): r["position"] for r in tree}
        for (level, index), at in place.items():
            if (level + 1, index // arity) in place:
                assert at < place[level + 1, index // arity]


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_positions_are_those_of_a_postorder_walk(arity):
    for n in [1, 2, 3, 4, 9, 15, 16, 17, 31, 81, 82, 256, 257, 300]:
        top, walk = merkle.height(n, arity), []

        def visit(level, index):
            if level:
                for child in range(index * arity, min((index + 1) * arity, merkle.width(n, level - 1, arity))):
                    visit(level - 1, child)
            walk.append((level, index))

        visit(top, 0)
        assert [merkle.position(n, level, index, arity) for level, index in walk] == list(range(len(walk)))


def test_manifest_of_nothing_and_of_one_row(spark, tmp_path):
    none = spark.createDataFrame([], FIELDS)
    manifest = merkle.build(none, merkle.leaf_hash(merkle.FIELDS))
    assert manifest.root() is None and merkle.prove(manifest).count() == 0
    row = (None, None, None, None, None, "x", "y", 1)
    got = merkle.op11_merkle_manifest(spark, write(spark, tmp_path, [row], FIELDS)).first()
    assert got["leaf"] == got["subroot"] == got["root"] == sha("-----")
    assert got["proof_sha256"] == sha("") and got["verified"]


# Mixing


def mixed(spark, tmp_path, rows, name="mix"):
    sf_dir = write(spark, tmp_path / name, rows, "doc_id bigint, source string, text string, target string, _plan int")
    return [tuple(r) for r in mixing.op12_source_mixing(spark, sf_dir).collect()]


def shares(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, rest, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in above:
            target[s] = Fraction(3 * sizes[s])
            rest -= target[s]
            open_.discard(s)
    return target


def check_mix(rows, got, near):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    target = shares(sizes)
    assert sorted(r[0] for r in got) == sorted(size)
    taken = Counter()
    for i, words, of_source, aim, took in got:
        assert (words, of_source) == (size[i], sizes[source[i]])
        assert aim == pytest.approx(float(target[source[i]]), rel=1e-12)
        assert 0 <= took <= 3 * words and (not words or took % words == 0)
        taken[source[i]] += took
    for s in target:
        largest = max(size[i] for i in size if source[i] == s)
        assert abs(taken[s] - target[s]) <= (2 + target[s] / 500 if near else largest), (s, taken[s], float(target[s]))


@pytest.mark.parametrize("most", [1024, 8])
def test_mix_meets_targets(spark, tmp_path, monkeypatch, most):
    # With 8 rows in a last bucket several steps of the histogram are needed.
    monkeypatch.setattr(mixing, "LIST", most)
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        source = rng.choice(["hot"] * 8 + ["a", "é", "", None, "z"])
        rows.append((i, source, " ".join(["w"] * int(rng.paretovariate(0.8)))[:60_000]))
    rows += [(2000, "empty", None), (2001, "empty", " \n"), (2002, "tiny", "one two")]
    first = mixed(spark, tmp_path, [(*r, "clash", 1) for r in rows], "one")
    check_mix(rows, first, most > 8)
    rng.shuffle(rows)
    assert sorted(mixed(spark, tmp_path, [(*r, "clash", 1) for r in rows], "two")) == sorted(first)


def test_mix_of_repeated_rows_and_of_nothing(spark, tmp_path):
    rows = [(1, "a", "x y z")] * 300 + [(None, "a", None), (2, "b", "x " * 500), (2, "b", "y")]
    got = mixed(spark, tmp_path, [(*r, None, None) for r in rows], "repeats")
    assert len(got) == 303 and all(r[4] <= 3 * r[1] for r in got)
    assert len({r for r in got if r[0] == 1}) == 1
    assert mixed(spark, tmp_path, [], "none") == []


def test_mix_returns_texts_as_often_as_taken(spark):
    rows = [(i, "a" if i % 4 else "b", f"words {i} " * 5, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, _hash2 int")
    out = mixing.mix(docs, weights={"a": 1, "b": 2})
    assert out.columns == docs.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " ")) - 1).alias("n")).collect()}
    # The shares are 667 and 1333 of 2000 words, in documents of 10 words.
    assert words == {"a": 670, "b": 1330}
    half = mixing.mix(docs, weights={"a": 1, "b": 1}, budget=400).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in half} == {"a": 20, "b": 20}


# Periodic runs


def brute_runs(words, least=24):
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            run = words[i - p : j]
            shorter = any(all(run[k] == run[k - q] for k in range(q, len(run))) for q in range(1, p))
            if len(run) >= max(least, 3 * p) and not shorter:
                out.append((i - p, len(run), p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(rng):
    words = []
    for _ in range(rng.randrange(0, 6)):
        block = [rng.randrange(rng.choice([1, 2, 5, 50])) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.3:
            block = block * rng.randrange(2, 5) + block[: rng.randrange(len(block) + 1)]
        part = block * rng.randrange(1, 9) + block[: rng.randrange(len(block) + 1)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = 99
        words += part
    return words[:400]


def test_runs_of_random_sequences():
    rng, found = random.Random(8), 0
    for _ in range(600):
        words = stretches(rng)
        expected = brute_runs(words)
        number = np.unique(np.array(words, np.int64), return_inverse=True)[1].astype(np.int64)
        assert [tuple(r) for r in periodic.runs_of(number).tolist()] == expected
        found += len(expected)
    assert found > 300


def test_runs_of_long_sequences_take_no_square_time():
    assert periodic.runs_of(np.zeros(500_000, np.int64)).tolist() == [[0, 500_000, 1]]
    assert periodic.runs_of(np.arange(600_000) % 200_000).tolist() == [[0, 600_000, 200_000]]


def expected_runs(i, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, sha(listed), hashlib.sha256(kept).hexdigest())


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t) for i, t in cases.texts() if not t or len(t) < 20_000]
    rows += [(500 + k, " \n".join(f"w{x}" for x in stretches(rng))) for k in range(150)]
    rows += [(700 + k, cases.prose(k, 120)) for k in range(60)]
    rows += [(900, "\x1c\x85 a　b " * 40), (901, "x"), (None, "a b " * 30), (None, None)]
    schema = "doc_id bigint, text string, words int, runs string, best string, n string"
    sf_dir = write(spark, tmp_path, [(*r, 1, "clash", "clash", None) for r in rows], schema)
    got = periodic.op13_periodic_runs(spark, sf_dir)
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert got.columns == names
    expected = [expected_runs(*r) for r in rows]
    assert order(got.collect()) == order(expected)
    planted = [e for e in expected if e[0] is not None and zlib.crc32(str(e[0]).encode()) % 10 == 0 and e[1]]
    assert len(planted) > 5


def test_runs_as_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 50)
    rows = [(1, "a b " * 20_000), (1, "a b " * 20_000), (2, "c " * 10), (3, "x y " * 12 + "z " * 30)]
    docs = cases.frame(spark, rows)
    got = sorted(tuple(r) for r in periodic.find_runs(docs).collect())
    assert got == [(1, 0, 40_000, 2)] * 2 + [(3, 0, 24, 2), (3, 24, 30, 1)]
    kept = {r["doc_id"]: r["text"] for r in periodic.collapse(docs).collect()}
    assert kept == {1: "a b", 2: " ".join("c" * 10), 3: "x y z"}
    assert periodic.collapse(cases.empty(spark)).count() == 0
