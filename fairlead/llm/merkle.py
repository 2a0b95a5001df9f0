"""Merkle manifest of a dataset: one tree per group of rows, and a tree over the groups.

Every row is a leaf, groups are ordered lists of leaves, and ``arity`` consecutive
nodes (the last run: fewer, even one) become their hash until one node remains.
The roots of the groups, in order of the group, are the leaves of the top tree.

All trees are kept as one append log in postorder: a node is written when its
last leaf is complete. Where a node stands in the log follows from its level, its
number and the count of leaves alone (``position``), from the sizes of the
complete subtrees before it. Builders work on aligned pieces of arity ** levels
consecutive leaves, whose part of the log is contiguous, so no builder waits for
another one and a group of any size is spread over many of them. The nodes on
top of the pieces are the leaves of a next round, and so on; the rounds grow with
the logarithm of the largest group. Proofs go the same way back: each piece
addresses the siblings of its leaves by position in its part of the log and adds
the path from its own top to the root, one row per piece.

Defined results: a null field is hashed as ``-``; a null group is a group and comes
first; rows without an id come first in their group. Leaves of equal id (repeated
rows too) are ordered by their digest and each keeps a place of its own. An empty
table gives an empty manifest. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairlead.llm.common import ascii_lower, query, scope, stored, table
from fairlead.operators.numbering import numbered, same

ARITY = 16
#: A builder takes ARITY ** LEVELS leaves.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The top tree's number; the trees of the groups are 0, 1, ...
TOP = -1


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(leaves: int, arity: int = ARITY) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // arity), levels + 1
    return levels


def width(leaves: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a level."""
    return -(-leaves // arity**level)


def position(leaves: int, level: int, index: int, arity: int = ARITY) -> int:
    """Place of a node in the postorder log of a tree, counted from 0.

    Before it come all leaves up to its last one, the nodes of lower levels over
    them, its own predecessors, and those nodes of higher levels that end before
    its first leaf.
    """
    first = index * arity**level
    if level:
        end = min(first + arity**level, leaves)
        place = end + sum(-(-end // arity**k) for k in range(1, level)) + index
    else:
        place = index
    k = level + 1
    while arity**k <= first:
        place, k = place + first // arity**k, k + 1
    return place


def field_text(name: str) -> Column:
    value = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row; ``changed`` gives other values for some fields."""
    parts = []
    for name in fields:
        if changed and name in changed:
            value = changed[name]
            value = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
            parts.append(F.coalesce(value, F.lit("-")))
        else:
            parts.append(field_text(name))
    return F.sha2(F.concat(*parts), 256)


#: ``piece``: the piece of its round that wrote the node; ``top``: whether it is the root of its tree.
_NODE = "tree bigint, leaves bigint, piece bigint, level int, index bigint, position bigint, digest string, top boolean"


def _piece(arity: int, levels: int) -> Column:
    return F.expr(f"index div {arity**levels}").alias("piece")


def _builder(base: int, arity: int, levels: int):
    """Writes the nodes above one piece's entries, nodes of level ``base``, as they are complete."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        tree, leaves, first = (int(rows[c].iat[0]) for c in ("tree", "leaves", "index"))
        up = min(levels, height(leaves, arity) - base)
        last_level = height(leaves, arity)
        log: list[tuple] = []
        waiting: list[list[str]] = [[] for _ in range(up + 1)]
        number = [first // arity**k for k in range(up + 1)]

        def add(level: int, node: str) -> None:
            if level or not base:
                place = position(leaves, base + level, number[level], arity)
                log.append((base + level, number[level], place, node, base + level == last_level))
            number[level] += 1
            waiting[level].append(node)
            if level < up and len(waiting[level]) == arity:
                close(level)

        def close(level: int) -> None:
            run, waiting[level] = waiting[level], []
            add(level + 1, digest(run))

        for node in rows["digest"]:
            add(0, node)
        for level in range(up):
            if waiting[level]:
                close(level)
        out = pd.DataFrame(log, columns=["level", "index", "position", "digest", "top"])
        return out.assign(tree=tree, leaves=leaves, piece=first // arity**levels)

    return build


def _rounds(largest: int | None, arity: int, levels: int) -> int:
    """Rounds of pieces that the largest tree needs."""
    rounds, nodes = 1, largest or 0
    while nodes > arity**levels:
        nodes, rounds = -(-nodes // arity**levels), rounds + 1
    return rounds


def build_log(leaves: DataFrame, rounds: int, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The log by rounds, from leaves (tree, leaves, index, digest); round r has the nodes above level r * levels."""
    log, entries = [], leaves.select("tree", "leaves", "index", "digest")
    for number in range(rounds):
        grouped = entries.groupBy("tree", _piece(arity, levels))
        nodes = stored(grouped.applyInPandas(_builder(number * levels, arity, levels), _NODE), outer=True)
        log.append(nodes)
        entries = nodes.filter((F.col("level") == (number + 1) * levels) & ~F.col("top"))
    return log


def roots(log: list[DataFrame]) -> DataFrame:
    """tree, digest of the root of every tree."""
    return reduce(DataFrame.unionByName, [nodes.filter("top").select("tree", "digest") for nodes in log])


def _sides(nodes: dict[int, str], leaves: int, base: int, up_to: int, arity: int):
    """A function from an entry's number to its siblings (left, right) on the levels of a piece."""
    runs: dict[tuple[int, int], list[str]] = {}

    def sides(index: int) -> Iterator[tuple[str, str]]:
        for level in range(base, up_to):
            first = index // arity * arity
            run = runs.get((level, first))
            if run is None:
                end = min(first + arity, width(leaves, level, arity))
                run = [nodes[position(leaves, level, i, arity)] for i in range(first, end)]
                runs[level, first] = run
            yield "".join(run[: index - first]), "".join(run[index - first + 1 :])
            index //= arity

    return sides


def _split(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
    """Nodes of a piece, and the row with the way on from its top."""
    is_way = rows["position"].isna()
    return rows[~is_way], rows[is_way].iloc[0]


_WAY = "tree bigint, piece bigint, `left` array<string>, `right` array<string>"


def _finder(base: int, arity: int, levels: int):
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, way = _split(rows)
        tree, leaves = int(nodes["tree"].iat[0]), int(nodes["leaves"].iat[0])
        places = nodes["position"].astype("int64").tolist()
        sides = _sides(
            dict(zip(places, nodes["digest"])), leaves, base, min(base + levels, height(leaves, arity)), arity
        )
        out = []
        for index in nodes.loc[nodes["level"] == base, "index"].astype("int64").tolist():
            near = list(sides(index))
            left, right = [x for x, _ in near], [x for _, x in near]
            out.append((tree, index, left + list(way["left"]), right + list(way["right"])))
        return pd.DataFrame(out, columns=["tree", "piece", "left", "right"])

    return find


def _inside(log: list[DataFrame], number: int, arity: int, levels: int) -> DataFrame:
    """The nodes that a piece of a round needs: those it wrote, and its entries from the round before."""
    if number == 0:
        return log[0]
    entries = log[number - 1].filter((F.col("level") == number * levels) & ~F.col("top"))
    return log[number].unionByName(entries.withColumn("piece", _piece(arity, levels)))


def _ways_of_entries(log: list[DataFrame], number: int, ways: DataFrame, arity: int, levels: int) -> DataFrame:
    both = _inside(log, number, arity, levels).unionByName(ways, allowMissingColumns=True)
    return both.groupBy("tree", "piece").applyInPandas(_finder(number * levels, arity, levels), _WAY)


def ways(log: list[DataFrame], above: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Siblings on the way from the top of each piece of leaves to the root: tree, piece, left, right.

    ``above`` has tree, leaves, left and right: the way on from the root of each tree.
    """
    known = None
    for number in reversed(range(len(log))):
        # The last round of a tree is the one in which its entries fit one piece.
        piece = arity**levels
        ends = (F.col("leaves") <= piece ** (number + 1)) & (F.lit(number == 0) | (F.col("leaves") > piece**number))
        ending = above.filter(ends).select("tree", F.lit(0).cast("bigint").alias("piece"), "left", "right")
        known = ending if known is None else known.unionByName(ending)
        if number:
            known = stored(_ways_of_entries(log, number, known, arity, levels))
    return known


@dataclass(frozen=True)
class Manifest:
    """rows: tree, leaves, index, digest, id and the caller's columns; trees: tree, group, leaves, subroot."""

    rows: DataFrame
    trees: DataFrame
    n_trees: int
    log: list[DataFrame]
    top_log: list[DataFrame]
    arity: int
    levels: int

    def root(self) -> str | None:
        """The hash that stands for the whole dataset."""
        row = roots(self.top_log).first()
        return row["digest"] if row else None

    def full_log(self) -> DataFrame:
        """All nodes: tree (-1: the top tree), level, index, position, digest; ordered by (tree, position)."""
        nodes = reduce(DataFrame.unionByName, [*self.top_log, *self.log])
        return nodes.select("tree", "level", "index", "position", "digest").sort("tree", "position")


def build(
    docs: DataFrame,
    leaf: Column,
    group_col: str = "source",
    id_col: str = "doc_id",
    extra: dict[str, Column] | None = None,
    arity: int = ARITY,
    levels: int = LEVELS,
) -> Manifest:
    """Hash the rows, number them in their groups and build the trees of all groups and of their roots."""
    extra = extra or {}
    spark = docs.sparkSession
    with scope(spark):
        hashed = docs.select(
            F.col(f"`{id_col}`").cast("bigint").alias("id"),
            F.col(f"`{group_col}`").alias("group"),
            leaf.alias("digest"),
            *[column.alias(name) for name, column in extra.items()],
        )
        # A tie-breaker, so that no range of the numbering is one repeated row.
        hashed = stored(hashed.withColumn("row", F.monotonically_increasing_id()))
        placed = stored(numbered(hashed, ["id", "digest", "row"], ["group"], "index", "leaves", store=stored))
        groups = stored(placed.groupBy("group").agg(F.max("leaves").alias("leaves")))
        trees = stored(numbered(groups, ["group"], (), "tree", "n_trees", store=stored))
        rows = placed.join(trees, same(["group"], placed, trees)).select(
            trees["tree"], placed["leaves"], placed["index"], placed["digest"], placed["id"], *[placed[n] for n in extra]
        )
        rows = stored(rows, outer=True)
        largest, n_trees = trees.agg(F.max("leaves"), F.max("n_trees")).first()
        log = build_log(rows, _rounds(largest, arity, levels), arity, levels)
        trees = stored(trees.join(roots(log).withColumnRenamed("digest", "subroot"), "tree"), outer=True)
        top = trees.select(
            F.lit(TOP).cast("bigint").alias("tree"),
            F.col("n_trees").alias("leaves"),
            F.col("tree").alias("index"),
            F.col("subroot").alias("digest"),
        )
        top_log = build_log(top, _rounds(n_trees, arity, levels), arity, levels)
    return Manifest(rows, trees, n_trees or 0, log, top_log, arity, levels)


_PROOF = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prover(root: str | None, given: str | None, arity: int, levels: int):
    def prove(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes, way = _split(nodes)
        leaves = int(rows["leaves"].iat[0])
        places = nodes["position"].astype("int64").tolist()
        sides = _sides(dict(zip(places, nodes["digest"])), leaves, 0, min(levels, height(leaves, arity)), arity)
        further = list(zip(way["left"], way["right"]))
        rest = "".join(x + y for x, y in further)
        proofs, folded = [], []
        for index, own, other in zip(rows["index"].tolist(), rows["digest"], rows[given or "digest"]):
            near = list(sides(index))
            proofs.append(digest([*(x + y for x, y in near), rest]))
            node = own if other is None else other
            for x, y in [*near, *further]:
                node = digest([x, node, y])
            folded.append(node)
        return pd.DataFrame(
            {
                "id": rows["id"].astype("Int64"), "leaf": rows["digest"], "subroot": way["subroot"], "root": root,
                "proof_sha256": proofs, "folded_root": folded, "verified": [node == root for node in folded],
            }
        )

    return prove


def prove(manifest: Manifest, given: str | None = None) -> DataFrame:
    """Proof of every row against the root, and the root folded from its leaf and its siblings.

    ``given`` names a column of the manifest's rows with the leaf as someone else
    hands it in; null takes the manifest's own.
    """
    arity, levels, spark = manifest.arity, manifest.levels, manifest.rows.sparkSession
    if not manifest.n_trees:
        return spark.createDataFrame([], _PROOF)
    with scope(spark):
        start = [(TOP, manifest.n_trees, [], [])]
        over = spark.createDataFrame(start, "tree bigint, leaves bigint, `left` array<string>, `right` array<string>")
        top_ways = ways(manifest.top_log, over, arity, levels)
        # The top tree's leaves are the trees of the groups.
        to_root = _ways_of_entries(manifest.top_log, 0, top_ways, arity, levels).select(
            F.col("piece").alias("tree"), "left", "right"
        )
        above = stored(manifest.trees.select("tree", "leaves", "subroot").join(to_root, "tree"))
        down = ways(manifest.log, above, arity, levels).join(above.select("tree", "subroot"), "tree")
        nodes = manifest.log[0].select("tree", "piece", "position", "digest")
        nodes = nodes.unionByName(stored(down, outer=True), allowMissingColumns=True)
    rows = manifest.rows.withColumn("piece", _piece(arity, levels))
    both = rows.groupBy("tree", "piece").cogroup(nodes.groupBy("tree", "piece"))
    return both.applyInPandas(_prover(manifest.root(), given, arity, levels), _PROOF)


def is_tampered(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0


@query(
    "op11_merkle_manifest",
    """
WITH RECURSIVE numbered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
           list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]
               FOR c IN string_split(doc_id::VARCHAR, '')])),
               lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS crc
    FROM documents
), fields AS (
    SELECT doc_id, source, idx, xor(crc, 4294967295) % 5 = 0 AS tampered,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
    FROM numbered
), leaves AS (
    SELECT doc_id, source, idx, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(CASE WHEN tampered THEN lowered ELSE text END) || ':'
                  || CASE WHEN tampered THEN lowered ELSE text END, '-')) AS given
    FROM fields
), tree AS (
    SELECT source, 0 AS lvl, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
    UNION ALL
    SELECT source, lvl, idx, digest, count(*) OVER (PARTITION BY source) AS n FROM (
        SELECT source, lvl + 1 AS lvl, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
        FROM tree WHERE n > 1 GROUP BY source, lvl + 1, idx // 16)
), subroots AS (
    SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM tree WHERE n = 1
), top AS (
    SELECT 0 AS lvl, idx, subroot AS digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT lvl, idx, digest, count(*) OVER () AS n FROM (
        SELECT lvl + 1 AS lvl, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
        FROM top WHERE n > 1 GROUP BY lvl + 1, idx // 16)
), own AS (
    SELECT l.*, s.subroot, s.idx AS place FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
), steps AS (
    SELECT o.doc_id, t.lvl AS step, t.idx, t.digest, sign(t.idx - o.idx // (16 ** t.lvl)::BIGINT) AS side
    FROM own o JOIN tree t ON o.source IS NOT DISTINCT FROM t.source AND t.n > 1
         AND t.idx // 16 = o.idx // (16 ** (t.lvl + 1))::BIGINT
    UNION ALL
    SELECT o.doc_id, 100 + t.lvl, t.idx, t.digest, sign(t.idx - o.place // (16 ** t.lvl)::BIGINT)
    FROM own o JOIN top t ON t.n > 1 AND t.idx // 16 = o.place // (16 ** (t.lvl + 1))::BIGINT
), sides AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k,
           coalesce(string_agg(digest, '' ORDER BY idx) FILTER (side < 0), '') AS lefts,
           coalesce(string_agg(digest, '' ORDER BY idx) FILTER (side > 0), '') AS rights
    FROM steps GROUP BY doc_id, step
), proofs AS (
    SELECT doc_id, string_agg(lefts || rights, '' ORDER BY k) AS proof, max(k) AS n FROM sides GROUP BY doc_id
), folds AS (
    SELECT doc_id, 0 AS k, given AS node FROM leaves
    UNION ALL
    SELECT f.doc_id, f.k + 1, sha256(s.lefts || f.node || s.rights)
    FROM folds f JOIN sides s ON s.doc_id = f.doc_id AND s.k = f.k + 1
)
SELECT o.doc_id, o.leaf, o.subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.digest AS verified
FROM own o LEFT JOIN proofs p ON p.doc_id = o.doc_id
     JOIN folds f ON f.doc_id = o.doc_id AND f.k = coalesce(p.n, 0)
     JOIN top r ON r.n = 1
""",
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    altered = F.when(is_tampered(), leaf_hash(FIELDS, {"text": ascii_lower(F.col("text"))}))
    manifest = build(docs, leaf_hash(FIELDS), extra={"altered": altered})
    return prove(manifest, "altered").withColumnRenamed("id", "doc_id")
