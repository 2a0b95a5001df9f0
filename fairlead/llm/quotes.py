r"""Reply order of chat messages from what they quote.

A line's quote level is the number of ``>`` marks it begins with, white space
between them ignored. Passages are runs of lines of one level that are not
blank; they are normalised (lower case, white space to single blanks) and
hashed, as is each line of theirs, so that a quotation of part of a passage is
found as well. What a message writes itself (level 0) are originals; what it
quotes is linked to the latest earlier message of the conversation with the same
original, however short it is. Among the messages found, the one with most
quoted characters at the lowest level is the message replied to. Following these links gives each message
its thread (the turn it goes back to) and its depth; sorted by conversation,
thread and turn, every reply stands after its original. Texts keep their own
lines only.

The latest earlier original is found per (conversation, hash) and slice of
``SLICE`` turns, with what earlier slices hold in one row per slice, so a long
conversation that repeats one passage is spread over tasks; no passage is joined
with all its copies. All of it is Spark SQL.

Defined results: a null text stays null; a message that only quotes has an empty
text. Messages without conversation or turn have no link and are no original.
Rows with the same conversation and turn are told apart by a hash of their text
for what they quote and count as one message for what they are. Equal rows get
equal results. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fairlead.llm.common import query, stored, table

SLICE = 1024
_QUOTED = r"^[ \\t]*>"
_OWN = rf"filter(split(text, '\\r?\\n', -1), line -> NOT line RLIKE '{_QUOTED}')"


def passages(messages: DataFrame) -> DataFrame:
    """Rows conv, turn, version, level, h1, h2, chars: passages and their lines, once each."""
    lines = messages.select(
        "conv", "turn", "version", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line")
    )
    marks = F.regexp_extract("line", r"^((?:[ \t]*>)*)", 1)
    lines = lines.select(
        "conv", "turn", "version", "pos",
        (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
        F.trim(F.regexp_replace(F.lower(F.regexp_replace("line", r"^((?:[ \t]*>)*)", "")), r"\s+", " ")).alias("words"),
    ).filter("words <> ''")
    # Lines of one passage follow each other, so position less rank in the level is the same.
    message = Window.partitionBy("conv", "turn", "version", "level").orderBy("pos")
    runs = lines.withColumn("run", F.col("pos") - F.row_number().over(message))
    whole = runs.groupBy("conv", "turn", "version", "level", "run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"]), " ").alias("words")
    )
    units = whole.drop("run").unionByName(lines.drop("pos"))
    units = units.withColumn("chars", F.length("words"))
    return units.select(
        "conv", "turn", "version", "level", "chars",
        F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"),
    ).distinct()


def quote_links(messages: DataFrame) -> DataFrame:
    """Rows conv, turn, version, reply_to: the message each quoting message answers."""
    known = messages.filter("conv IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    units = stored(passages(known)).withColumn("slice", F.expr(f"turn div {SLICE}"))
    own = F.when(F.col("level") == 0, F.col("turn"))
    quoted = F.max(F.col("level") > 0).over(Window.partitionBy("conv", "h1", "h2", "slice"))
    key = ["conv", "h1", "h2"]
    before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = units.groupBy(*key, "slice").agg(F.max(own).alias("newest"))
    carried = slices.select(*key, "slice", F.max("newest").over(before).alias("carried"))
    inside = Window.partitionBy(*key, "slice").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = (
        units.withColumn("quoted", quoted)
        .filter("quoted")
        .withColumn("near", F.max(own).over(inside))
        .filter("level > 0")
        .join(carried, [*key, "slice"])
        .withColumn("source", F.coalesce("near", "carried"))
        .filter("source IS NOT NULL")
    )
    weighed = found.groupBy("conv", "turn", "version", "source").agg(
        F.min("level").alias("level"), F.sum("chars").alias("chars")
    )
    best = F.max(F.struct((-F.col("level")).alias("near"), "chars", "source"))
    return weighed.groupBy("conv", "turn", "version").agg(best.alias("best")).select(
        "conv", "turn", "version", F.col("best.source").alias("reply_to")
    )


def threads(links: DataFrame) -> DataFrame:
    """Rows conv, turn, thread, depth of replying messages: the turn a chain of replies goes back to.

    Pointers are doubled each round, so the rounds grow with the logarithm of the
    longest chain.
    """
    up = links.groupBy("conv", "turn").agg(F.max("reply_to").alias("top")).withColumn("depth", F.lit(1).cast("bigint"))
    up = stored(up)
    while True:
        higher = up.select("conv", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step = up.join(higher, ["conv", "top"], "left")
        if step.filter("next IS NOT NULL").isEmpty():
            break
        up = stored(
            step.select(
                "conv", "turn", F.coalesce("next", "top").alias("top"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )
    return up.select("conv", "turn", F.col("top").alias("thread"), "depth")


def link_quotes(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    text_col: str = "text",
) -> DataFrame:
    """Input rows with text free of quotes, and _reply_to, _thread, _depth; sort by conversation, _thread, turn."""
    rows = messages.select(
        F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"),
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"),
        F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.col(f"`{text_col}`").alias("text"),
    ).withColumn("version", F.xxhash64("text"))
    links = stored(quote_links(rows.select("conv", "turn", "version", "text")))
    rows = rows.join(links, ["conv", "turn", "version"], "left").join(threads(links), ["conv", "turn"], "left")
    own = F.expr(f"array_join({_OWN}, '\\n')")
    # Blank lines at both ends were next to a quote.
    own = F.when(F.col("text").rlike(rf"(?m){_QUOTED}".replace("\\\\", "\\")), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(F.col("text"))
    return rows.select(
        *[(own if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in messages.columns],
        F.col("reply_to").alias("_reply_to"),
        F.coalesce("thread", "turn").alias("_thread"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("_depth"),
    )


@query(
    "op10_quotation_linking",
    r"""
WITH RECURSIVE c AS (
    SELECT row_number() OVER () AS rid, * FROM conversations
), l AS (
    SELECT rid, conv_id, turn, u.pos AS pos, u.line AS line,
           regexp_extract(u.line, '^((?:[ \t]*>)*)', 1) AS marks
    FROM (SELECT *, string_split_regex(text, '\r?\n') AS parts FROM c WHERE text IS NOT NULL),
         LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u
), w AS (
    SELECT rid, conv_id, turn, pos, length(marks) - length(replace(marks, '>', '')) AS level,
           trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)*)', '')), '\s+', ' ', 'g')) AS words
    FROM l WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), r AS (
    SELECT *, pos - row_number() OVER (PARTITION BY rid, level ORDER BY pos) AS run FROM w WHERE words <> ''
), grouped AS (
    SELECT rid, conv_id, turn, level, string_agg(words, ' ' ORDER BY pos) AS words
    FROM r GROUP BY rid, conv_id, turn, level, run
    UNION SELECT rid, conv_id, turn, level, words FROM r
), u AS (SELECT DISTINCT * FROM grouped),
found AS (
    SELECT q.rid, q.conv_id, q.turn, q.level, q.words, max(o.turn) AS source
    FROM u q JOIN u o ON q.conv_id = o.conv_id AND q.words = o.words AND o.level = 0 AND o.turn < q.turn
    WHERE q.level > 0 GROUP BY ALL
), weighed AS (
    SELECT rid, conv_id, turn, source, min(level) AS level, sum(length(words)) AS chars FROM found GROUP BY ALL
), links AS (
    SELECT rid, conv_id, turn, source FROM weighed
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level, chars DESC, source DESC) = 1
), up AS (SELECT conv_id, turn, max(source) AS parent FROM links GROUP BY ALL),
chain AS (
    SELECT conv_id, turn, parent AS top, 1 AS depth FROM up
    UNION ALL
    SELECT k.conv_id, k.turn, p.parent, k.depth + 1 FROM chain k JOIN up p ON k.conv_id = p.conv_id AND k.top = p.turn
), threads AS (SELECT conv_id, turn, min(top) AS thread, max(depth) AS depth FROM chain GROUP BY ALL),
own AS (
    SELECT rid, bool_or(regexp_matches(line, '^[ \t]*>')) AS quotes,
           regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT regexp_matches(line, '^[ \t]*>')), ''),
                          '^\s+|\s+$', '', 'g') AS kept
    FROM l GROUP BY rid
)
SELECT c.conv_id, c.turn, c.role, CASE WHEN own.quotes THEN own.kept ELSE c.text END AS text,
       k.source AS reply_to, coalesce(t.thread, c.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth
FROM c LEFT JOIN own USING (rid) LEFT JOIN links k USING (rid)
     LEFT JOIN threads t ON c.conv_id = t.conv_id AND c.turn = t.turn
""",
)
def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select(
        "conv_id", "turn", "role", "text",
        F.col("_reply_to").alias("reply_to"), F.col("_thread").alias("thread"), F.col("_depth").alias("depth"),
    )
