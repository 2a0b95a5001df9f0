r"""Document fingerprints: the shingle hashes in a fixed fraction of the hash range.

Words are runs without white space, with A-Z in lower case; a text of fewer than
``SHINGLE`` words is one shingle. A fingerprint holds the distinct shingle hashes
in the lowest ``1 / fraction`` of the range, sorted. The limit does not depend on
the text, so a long text keeps more hashes than a short one, the fingerprint of a
union is the merged fingerprint, and containment may be asked of texts of very
unequal length. Fingerprints that are compared or merged must have one fraction.
With a fraction of 1 all hashes stay, and likeness and containment are those of
the shingle sets themselves (but for clashes of 64-bit hashes); the query uses
that, since short texts have too few shingles for anything less. With a larger
fraction both are estimates with an error of about ``sqrt(fraction / shingles)``,
and a text with no shingle under the limit keeps its smallest hash, which merging
drops as soon as the other side has one under the limit. All of it is Spark SQL.

Neighbours in descending order of ids come from slices of ``SLICE`` ids: inside
a slice a window looks one row ahead, and the first row of each slice goes to
the slice before it. Texts are shuffled once, by slice. Slices are put in order by
ranges of about equally many of them, so sparse ids are no different from dense.

Defined results: null is the empty text; a text without words has an empty
fingerprint. Two empty fingerprints are alike (1), an empty and another are not
(0). Rows with one id follow each other by a hash of the text. Rows without an
id have no next document: nothing fills the replaced part and ``near_next`` is
null. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fairlead.llm.common import ascii_lower, query, stored, table

SHINGLE = 5
FRACTION = 1
SLICE = 256
_WORDS = "filter(split({}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"


def _limit(fraction: int) -> int:
    """The largest hash that is kept."""
    return -(1 << 63) + (1 << 64) // fraction - 1


def with_fingerprint(rows: DataFrame, text: str, name: str, fraction: int = FRACTION) -> DataFrame:
    """``rows`` with the fingerprint (sorted array of longs) of column ``text`` as column ``name``."""
    parts = ", ".join(f"_hashes[i + {j}]" for j in range(SHINGLE))
    # One step per select: each result is used several times in the next.
    rows = rows.select("*", ascii_lower(F.col(text)).alias("_low"))
    rows = rows.select("*", F.expr(f"transform({_WORDS.format('_low')}, w -> xxhash64(w))").alias("_hashes"))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("_low", "_hashes")],
        F.expr(
            f"CASE WHEN size(_hashes) >= {SHINGLE} "
            f"THEN transform(sequence(0, size(_hashes) - {SHINGLE}), i -> xxhash64({parts})) "
            "WHEN size(_hashes) > 0 THEN array(xxhash64(_hashes)) ELSE array() END"
        ).alias("_shingles"),
    )
    rows = rows.select("*", F.expr(f"filter(_shingles, h -> h <= {_limit(fraction)}L)").alias("_low"))
    found = F.expr(
        "CASE WHEN size(_low) > 0 THEN sort_array(array_distinct(_low)) "
        "WHEN size(_shingles) > 0 THEN array(array_min(_shingles)) ELSE _low END"
    )
    return rows.select(*[c for c in rows.columns if c not in ("_low", "_shingles")], found.alias(name))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprint columns."""
    common = f"size(array_intersect({a}, {b}))"
    return F.expr(
        f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D "
        f"ELSE {common} / CAST(size({a}) + size({b}) - {common} AS DOUBLE) END"
    )


def containment(a: str, b: str) -> Column:
    """Share of the first text's shingles that the second has; null for an empty one."""
    return F.expr(f"CASE WHEN size({a}) > 0 THEN size(array_intersect({a}, {b})) / CAST(size({a}) AS DOUBLE) END")


def merged(a: str, b: str, fraction: int = FRACTION) -> Column:
    """The fingerprint of both texts' shingles together."""
    limit = _limit(fraction)
    both = f"sort_array(array_union({a}, {b}))"
    return F.expr(
        f"CASE WHEN exists({both}, h -> h <= {limit}L) THEN filter({both}, h -> h <= {limit}L) "
        f"ELSE slice({both}, 1, 1) END"
    )


def as_text(fingerprint: str) -> Column:
    """Hexadecimal digits, 16 per hash."""
    return F.expr(f"array_join(transform({fingerprint}, h -> lpad(lower(hex(h)), 16, '0')), '')")


def following(keys: DataFrame) -> DataFrame:
    """Rows key, following: the next smaller of distinct keys; the largest follows the smallest.

    Keys are dealt to ranges of about equal size and stored with the number of
    their range; windows run inside ranges, and over one row per range.
    """
    ranged = stored(keys.repartitionByRange(F.desc("key")).select("key", F.spark_partition_id().alias("block")))
    inside = Window.partitionBy("block").orderBy(F.desc("key"))
    first = ranged.groupBy("block").agg(F.max("key").alias("head"))
    order = Window.orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("block", F.coalesce(F.lead("head").over(order), F.max("head").over(whole)).alias("next_head"))
    return (
        ranged.select("key", "block", F.lead("key").over(inside).alias("next_key"))
        .join(first, "block")
        .select("key", F.coalesce("next_key", "next_head").alias("following"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Rows doc, text, n, fp, next_text, next_fp in descending order of ids, closed to a ring."""
    known = docs.filter("doc IS NOT NULL").withColumn("slice", F.expr(f"doc div {SLICE}"))
    dealt = known.repartition("slice")
    printed = with_fingerprint(dealt.withColumn("version", F.xxhash64("text")), "text", "fp")
    order = Window.partitionBy("slice").orderBy(F.desc("doc"), "version")
    heads = (
        dealt.withColumn("version", F.xxhash64("text"))
        .withColumn("place", F.row_number().over(order))
        .filter("place = 1")
        .select(F.col("slice").alias("following"), F.col("text").alias("head_text"))
    )
    heads = with_fingerprint(heads, "head_text", "head_fp")
    chain = following(docs.filter("doc IS NOT NULL").select(F.expr(f"doc div {SLICE}").alias("key")).distinct())
    borders = heads.join(chain, "following").select(F.col("key").alias("slice"), "head_text", "head_fp")
    rows = printed.select(
        "slice", "doc", "text", "fp", F.lead("text").over(order).alias("lead_text"), F.lead("fp").over(order).alias("lead_fp")
    )
    rows = rows.join(borders, "slice").select(
        "doc", "text", "fp",
        F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_fp", "head_fp").alias("next_fp"),
    )
    alone = with_fingerprint(docs.filter("doc IS NULL"), "text", "fp").select(
        "doc", "text", "fp", F.lit("").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_fp")
    )
    return rows.unionByName(alone)


@query("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = with_next(docs).withColumn("n", F.char_length("text"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc", "n", "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        F.col("doc").alias("doc_id"),
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        F.when(F.col("next_fp").isNotNull(), likeness("fp", "next_fp")).alias("near_next"),
    )
