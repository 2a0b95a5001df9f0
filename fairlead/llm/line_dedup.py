r"""Removal of lines that very many documents repeat.

Lines are compared by a key: the line without white space at its ends and with
A-Z in lower case. Keys of enough characters that enough documents hold keep
their lines only in the document with the largest id.

Hashes of 128 bits stand for the keys. They are partitioned by hash range and
slice of document ids, and sorted inside by hash, document (largest first) and
position; one streaming pass over each run marks the first lines of documents
and the newest document. A slice covers ``SLICE`` ids, so a line that a third of
all documents hold is spread over as many tasks as there are slices; the slices
of a key are put together from one summary row each. What returns to the
documents is a bitmap of lines per document, without its words of no dropped
line, and never text.

Defined results: a null or empty text is one empty line. Rows without a document
id keep all lines and support no key. Equal rows get equal results; rows with
one id but different texts are told apart by a hash of the text and count as one
document. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fairlead.llm.common import SPACE, ascii_lower, query, table

MIN_CHARS = 40
MIN_DOCUMENTS = 5
SLICE = 4096
#: Hash ranges by leading bits; many more than tasks, so that tasks are even.
_RANGE_BITS = 12


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), text.alias("text")).withColumn(
        "version", F.xxhash64("text")
    )


def line_hashes(base: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: doc, version, pos, h1, h2."""
    lines = base.filter("doc IS NOT NULL").select(
        "doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    # Trimming only shortens, so short lines go before it.
    lines = lines.filter(F.char_length("line") >= min_chars)
    lines = lines.select("doc", "version", "pos", F.trim("line", F.lit(SPACE)).alias("line"))
    lines = lines.filter(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return lines.select("doc", "version", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def dropped_lines(base: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """Lines to drop: doc, version, pos."""
    slots = line_hashes(base, min_chars).select(
        "*",
        F.shiftrightunsigned("h1", 64 - _RANGE_BITS).alias("range"),
        F.expr(f"doc div {SLICE}").alias("slice"),
    )
    run = Window.partitionBy("range", "h1", "h2", "slice").orderBy(F.desc("doc"), "pos")
    streamed = slots.repartition("range", "slice").select(
        "*", F.first("doc").over(run).alias("newest"), F.lag("doc").over(run).alias("before")
    )
    of_slice = streamed.groupBy("range", "h1", "h2", "slice").agg(
        F.max("newest").alias("newest"),
        F.count_if(F.col("before").isNull() | (F.col("before") != F.col("doc"))).alias("documents"),
    )
    # A key has one row per slice here, so these windows stay small for any key.
    key = Window.partitionBy("h1", "h2")
    common = (
        of_slice.select(
            "range", "h1", "h2", "slice",
            F.sum("documents").over(key).alias("documents"), F.max("newest").over(key).alias("newest"),
        )
        .filter(F.col("documents") >= min_documents)
        .drop("documents")
    )
    found = slots.join(common, ["range", "h1", "h2", "slice"])
    return found.filter("doc < newest").select("doc", "version", "pos")


def drop_bitmaps(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Compressed bitmaps: doc, version, words (map of word number to 64 bits; a set bit drops the line).

    Words without a dropped line and documents without one are left out; their lines all stay.
    """
    base = _documents(docs, id_col, text_col)
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return (
        dropped_lines(base, min_chars, min_documents)
        .groupBy("doc", "version", F.expr("cast(pos div 64 as int)").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc", "version")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("words"))
    )


_KEPT = """
filter(split(text, '\\n', -1), (line, i) ->
    (shiftright(coalesce(try_element_at(words, cast(i div 64 as int)), 0L), cast(i % 64 as int)) & 1L) = 0L)
"""
_N_DROPPED = "coalesce(aggregate(map_values(words), 0L, (n, bits) -> n + bit_count(bits)), 0L)"


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Input rows with the text reduced to its kept lines, and ``_n_lines``, ``_n_dropped``."""
    words = drop_bitmaps(docs, min_chars, min_documents, id_col, text_col)
    names = docs.columns
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    left = left.select("row", text.alias("text"), F.col(f"row.`{id_col}`").cast("bigint").alias("doc"))
    left = left.withColumn("version", F.xxhash64("text"))
    joined = left.join(words, ["doc", "version"], "left")
    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.expr(_KEPT), "\n"))
    # A null text has no line to lose and stays null.
    new_text = F.when(F.col(f"row.`{text_col}`").isNotNull(), kept)
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return joined.select(
        *[(new_text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names],
        (breaks + 1).cast("bigint").alias("_n_lines"),
        F.expr(_N_DROPPED).cast("bigint").alias("_n_dropped"),
    )


@query(
    "op3_line_dedup",
    r"""
WITH lines AS (
    SELECT doc_id, u.pos AS pos, u.line AS line,
           translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
         LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u
), common AS (
    SELECT line_key, max(doc_id) AS newest FROM lines WHERE length(line_key) >= 40
    GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT l.*, c.newest IS NOT NULL AND l.doc_id < c.newest AS gone
    FROM lines l LEFT JOIN common c ON l.line_key = c.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
