"""Op 11: lines that many documents share, dropped but for their first document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespark.llm.common import row_tie, stored

#: Characters that keys lose at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case.

    ``lower`` is quick but changes letters beyond A-Z; it takes the lines that have none.
    """
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def shared_lines(lines: DataFrame, least_docs: int = 2) -> DataFrame:
    """Keys (h1, h2) that at least ``least_docs`` documents hold, with the smallest id.

    Distinct documents are counted by hash and id first, then by hash: both steps combine
    on the map side, so that a line of a third of all documents is a row for each task.
    """
    by_document = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return by_document.groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.min(F.struct(F.col("id").isNotNull(), "id")).alias("first"),
    ).where(F.col("n_docs") >= least_docs).select("h1", "h2", "n_docs", F.col("first.id").alias("first"))


def without_shared_lines(
    docs: DataFrame, *, least_chars: int = 10, least_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", hot: int = 4096,
) -> DataFrame:
    """Texts without the lines that another document holds first.

    A text is split at newlines; a line's key is the line without blanks at its ends and
    with A-Z in lower case. Keys of at least ``least_chars`` code points that at least
    ``least_docs`` documents hold lose all their lines, except in the document of the
    smallest id that holds them, which keeps every one. Keys are told apart by 128 bits of
    hash; lines travel as hashes and positions, texts only once, to be put together again.

    Keys with more than 1/``hot`` of all lines, at most ``hot`` by count, are broadcast; the
    rest are joined by hash, where a key then has that share of the rows at most.

    Rows of one id are one document, which has all their lines; null ids are one document
    too, the first of all. Null and empty texts are one empty line; a text that loses all lines
    is empty. Equal rows each get a row; lines of any length and number are split
    in the JVM, and a document's dropped lines (4 bytes each) are its largest group. An
    empty table gives no rows. Other columns stay, whatever their names; of columns called
    n_lines, n_dropped and kept the operator's own stay.

    Returns ``docs`` plus n_lines, n_dropped long, kept string.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    exploded = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.xxhash64(f"`{text_col}`"), F.lit(0)).alias("tie"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).select("id", "tie", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    lines = stored(exploded.select("id", "tie", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line-hashes")
    shared = stored(shared_lines(lines, least_docs), "shared-lines")
    most = lines.count() // hot
    others = ~F.col("id").eqNullSafe(F.col("first"))
    held = lines.join(F.broadcast(shared.where(F.col("n_docs") > most)), ["h1", "h2"]).where(others)
    light = lines.join(shared.where(F.col("n_docs") <= most), ["h1", "h2"]).where(others)
    drops = held.unionByName(light).groupBy("id", "tie").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))

    rest = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped", "kept")]
    packed = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row_tie(f"`{text_col}`").alias("tie"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    found = drops.withColumnsRenamed({"id": "drop_id", "tie": "drop_tie"})
    joined = packed.join(found, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("tie") == F.col("drop_tie")), "left")
    whole = F.coalesce("text", F.lit(""))
    pieces = joined.withColumn("lines", F.split(whole, "\n")).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    # Runs of lines between dropped ones: each is sliced once, however many there are.
    kept = F.expr("array_join(flatten(transform(concat(array(-1), dropped), (p, k) ->"
                  " slice(lines, p + 2, coalesce(get(dropped, k), size(lines)) - p - 1))), '\n')")
    names = {id_col: "id", text_col: "text"}
    return pieces.select(
        *[F.col(names[c] if c in names else f"rest.`{c}`").alias(c) for c in docs.columns if c in names or c in rest],
        F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        F.when(F.size("dropped") == 0, whole).otherwise(kept).alias("kept"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return without_shared_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
