"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, other columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, doc string, version string, words int, row string, h1 string, n int"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(("ba", "ko", "lu", "mi", "né", "ro", "ti")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out = []
    for i in range(words):
        out.append(rng.choice(vocabulary) + rng.choice(("", "", "", ",", ".\n")))
    return " ".join(out)


LINE = "A line of more than forty characters that several documents hold"


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 400)
    rows: list[tuple[int | None, str | None]] = [
        (1, base),
        (2, base),
        (2, base),
        (3, base.replace(" ", "  ", 3)),
        (4, " ".join(base.split()[:-2] + ["other", "end"])),
        (5, None),
        (6, ""),
        (7, " \t\n \r\n"),
        (8, "one"),
        (9, "One two"),
        (10, "one TWO"),
        (11, "x" * 5000),
        (12, "ab " * 3000),
        (13, prose(2, 40_000)),
        (14, "tail " + base[200:900] + " and more"),
        (15, base[:150]),
        (15, base[-300:]),
        (None, base),
        (None, None),
        (-3, "a negative id"),
        (20_000_000_000, base[500:800] + "é" * 150),
    ]
    rows += [(100 + i, f"{prose(50 + i, 30)}\n  {LINE if i % 2 else LINE.upper()}\t\nend {i}") for i in range(6)]
    rows += [(90, f"{LINE}\nmiddle\n{LINE}"), (300 + 5000, f"{LINE}\n{LINE}")]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "xx", "clash", "clash", 7, "clash", "clash", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
