import itertools
import random
import re
from collections import defaultdict

import cases
import numpy as np
import pyarrow as pa

from fairlead.llm import jaccard, tokens
from fairlead.llm.common import components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def expected(rows, k, percent):
    sets = defaultdict(set)
    for i, text in rows:
        if i is not None and shingles(text, k):
            sets[i].add(frozenset(shingles(text, k)))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    # A row without words is linked with nothing, even if its id has other rows.
    return sorted(
        ((i, len(shingles(t, k)), root(i) if shingles(t, k) and i in parent else i) for i, t in rows), key=lambda r: tuple((x is not None, x) for x in r)
    )


def run(spark, rows, k, percent):
    got = jaccard.near_duplicates(cases.frame(spark, rows), k, percent).collect()
    return sorted(map(tuple, got), key=lambda r: tuple((x is not None, x) for x in r))


def test_edge_cases(spark):
    rows = cases.texts()
    assert run(spark, rows, 3, 90) == expected(rows, 3, 90)
    assert run(spark, rows, 5, 80) == expected(rows, 5, 80)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_borderline_copies(spark):
    # Groups whose members are just similar enough, or just not, to each other and to their source.
    rng = random.Random(5)
    rows, number = [], 0
    for size in (9, 10, 11, 12, 20, 31, 60, 150, 400):
        source = [f"v{size}x{j}" for j in range(size)]
        for changes in (0, 0, 1, 1, 1, 2, 3, size // 60, size // 40, size // 30):
            rows.append((number, edited(rng, source, changes)))
            number += 1
        for cut in (1, 2, size // 12):
            rows.append((number, " ".join(source[cut:])))
            number += 1
    assert run(spark, rows, 3, 90) == expected(rows, 3, 90)
    assert run(spark, rows, 5, 80) == expected(rows, 5, 80)


def test_large_group_in_cells(spark, monkeypatch):
    # One source with many copies that are not linked to each other but share blocks.
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "FEW", 3)
    rng = random.Random(8)
    source = [f"s{j}" for j in range(120)]
    rows = [(i, edited(rng, source, 4)) for i in range(80)]
    rows += [(200 + i, edited(rng, source, 1)) for i in range(20)]
    rows += [(400 + i, edited(rng, rows[i][1].split(), 1)) for i in range(30)]
    assert run(spark, rows, 3, 90) == expected(rows, 3, 90)


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in cases.texts() if r[0] != 15]
    kept = jaccard.distinct_documents(cases.frame(spark, rows))
    assert kept.columns == cases.frame(spark, rows).columns
    stay = {i for i, _, c in expected(rows, 5, 80) if i is None or i == c}
    assert {r["doc_id"] for r in kept.collect()} == stay


def test_empty_tables(spark):
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0
    assert jaccard.distinct_documents(cases.empty(spark)).count() == 0
    assert run(spark, [(1, None), (2, None)], 3, 90) == [(1, 0, 1), (2, 0, 2)]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = np.concatenate([a[rng.integers(0, 40) :], rng.integers(0, 1 << 63, 25, dtype=np.uint64)])
        x, y = (jaccard.parity_sketch(np.unique(s), 22)[0].view(np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        sums = jaccard.parity_sketch(np.unique(a), 22)[1]
        whole = jaccard.block_keys(x.view(np.int64), sums, 3, 0)
        assert len(jaccard.block_keys(x.view(np.int64), sums, 3, 22)) == np.count_nonzero(np.bitwise_count(x) > 1) <= len(whole) == 22


def test_every_linked_pair_meets_in_a_band():
    for percent in (80, 90):
        for n in range(1, 400):
            for m in range(n, n * 100 // percent + 1):
                shared = {b for b, *_ in jaccard.bands_for(n, percent)} & {b for b, *_ in jaccard.bands_for(m, percent)}
                # Only equal sets are linked where no band is shared.
                assert shared or (n == m and jaccard.allowed_difference(2 * n, percent) < 1)
                for band, blocks, spare in jaccard.bands_for(n, percent):
                    if band in shared:
                        assert blocks - spare > jaccard.allowed_difference(n + m, percent)


def test_words_do_not_depend_on_pieces(monkeypatch):
    texts = [t or "" for _, t in cases.texts()]
    whole, begins = tokens.word_hashes(pa.array(texts))
    monkeypatch.setattr(tokens, "PIECE", 64)
    data, offsets = tokens.buffers(pa.array(texts))
    ends = [e for _, e in tokens.pieces(data, offsets, 64)]
    assert ends[-1] == len(data) and all(b > a for a, b in zip(ends, ends[1:]))
    again = [tokens.word_hashes(pa.array([t]))[0] for t in texts]
    assert np.array_equal(np.concatenate(again), whole)
    assert list(np.diff(begins)) == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (61, 60), (500, 400)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert all(got[i] == 0 for i in range(62)) and all(got[100 + i] == 100 for i in range(50)) and got[500] == 400
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_flag_words_are_packed_bits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500, 20_000):
        places = rng.integers(0, 1 << 16, n).astype(np.uint64)
        flags = np.zeros(1 << 16, bool)
        flags[places.astype(int)] = True
        words, bits = tokens.flag_words(places)
        full = np.zeros(1 << 10, np.int64)
        full[words] = bits
        assert np.array_equal(np.packbits(flags).view(np.int64), full)
