"""Op 6: token counts of the documents in flat token files."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracespark.llm.common import chunks, shared_dir

#: Tokens are 16 bits, big end first. The end of a document is an id beyond the vocabulary.
TOKEN = ">u2"
END_ID = 0xC480
#: Ends a file: Spark's text writer sets it (as UTF-8) as the separator of lines.
FILLER = "ā"
FILLER_ID = 0xC481
#: A document may begin with its number in base 8192: so many digits, as ids from here.
DIGITS, FIRST_DIGIT = 5, FILLER_ID + 1
NO_NUMBER = FIRST_DIGIT + 8192
#: Fixed value: the public pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The worker's encoding, built once for each rank file."""
    key = hash(ranks)
    if key not in _ENCODINGS:
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, special_tokens={},
            mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
    return _ENCODINGS[key]


def header(number: int | None) -> np.ndarray:
    if number is None:
        return np.full(DIGITS, NO_NUMBER)
    return np.array([FIRST_DIGIT + ((number >> (13 * k)) & 8191) for k in range(DIGITS)])


def write_token_files(
    docs: DataFrame, path: str, ranks_file: str, *, numbered: bool = True, id_col: str = "doc_id",
    file_tokens: int = 4 << 20,
) -> None:
    """Write the texts as flat token files: ids and an end-of-document id, nothing else.

    Each task writes one stream of ids and cuts it into files of ``file_tokens`` ids (the
    last is shorter), wherever documents end: long documents reach over files, and no
    file grows with them. A file ends with ``FILLER``, which belongs to no document. With
    ``numbered``, a document begins with its id (five reserved ids, never cut), since no
    index tells which document is where. Null texts have no tokens.
    """
    with open(ranks_file, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        held, n = [], 0
        for batch in batches:
            for part in chunks(batch):
                for number, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    head = header(number) if numbered else np.empty(0, np.int64)
                    if n + head.size > file_tokens:
                        yield _file(held)
                        held, n = [], 0
                    ids = np.concatenate([head, encode(text.as_py() or ""), [END_ID]]).astype(np.uint16)
                    while n + ids.size > file_tokens:
                        held.append(ids[: file_tokens - n])
                        ids = ids[file_tokens - n :]
                        yield _file(held)
                        held, n = [], 0
                    held.append(ids)
                    n += ids.size
        if n:
            yield _file(held)

    def _file(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype(TOKEN).tobytes()], pa.binary())], names=["value"])

    docs.select(F.col(id_col).cast("long"), "text").mapInArrow(run, "value binary").select(
        F.col("value").cast("string")).write.option("lineSep", FILLER).option("maxRecordsPerFile", 1).text(path)


def document_counts(
    spark: SparkSession, path: str, *, end_id: int = END_ID, filler_id: int | None = FILLER_ID, token: str = TOKEN,
    numbered: bool = True, block_tokens: int = 1 << 20,
) -> DataFrame:
    """Tokens of each document in flat token files that have no index.

    Files named part-<stream>...-c<number> (and an ending) are one stream, in order of number. Each
    file, of bounded size, is a task's; it is searched block by block with one vectorised
    comparison, and a block gives its size and the places of its end ids. Boundaries are
    stitched by a scan over the blocks of a stream, which lie in several tasks: running
    sums of the sizes give every block its place, the end id before a block tells
    whether a document starts there, and the first end id behind a block ends the
    document that is open at its end. What stands behind a stream's last end is a
    document that is not complete. Empty files have no documents.

    Returns stream, start (token of the stream where the document begins), n_tokens
    (without a number's digits), complete, and with ``numbered`` also number.
    """
    digits = DIGITS if numbered else 0
    width = np.dtype(token).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column(2)[k].as_buffer()
                tokens = np.frombuffer(content, token, len(content) // width if content else 0)
                if tokens.size and tokens[-1] == filler_id:
                    tokens = tokens[:-1]
                for block, at in enumerate(range(0, tokens.size, block_tokens)):
                    some = tokens[at : at + block_tokens]
                    ends = np.flatnonzero(some == end_id)
                    # Where documents start if one starts with the block; the last may be the next block's.
                    starts = np.r_[0, ends + 1]
                    starts = starts[starts < some.size]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([block], pa.int32()),
                         pa.array([some.size]), pa.array([bool(some[-1] == end_id)]), pa.array([ends.tolist()], pa.list_(pa.int64())),
                         pa.array([starts.tolist()], pa.list_(pa.int64())),
                         pa.array([_numbers(tokens, at + starts)], pa.list_(pa.int64()))],
                        names=["stream", "file", "block", "size", "closed", "ends", "starts", "numbers"])

    def _numbers(tokens: np.ndarray, starts: np.ndarray) -> list[int | None]:
        if not numbered:
            return [None] * starts.size
        heads = tokens[np.minimum(starts[:, None] + np.arange(digits), tokens.size - 1)].astype(np.int64)
        values = np.zeros(starts.size, np.uint64)
        for k in range(digits):
            values |= ((heads[:, k] - FIRST_DIGIT) & 8191).astype(np.uint64) << np.uint64(13 * k)
        return [None if h == NO_NUMBER else int(v) for h, v in zip(heads[:, 0], values.view(np.int64), strict=True)]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.regexp_extract("path", r"(part-[0-9]+)[^/]*$", 1).alias("stream"),
        F.coalesce(F.regexp_extract("path", r"-c([0-9]+)(\.[^/]*)?$", 1).try_cast("long"), F.lit(0)).alias("file"), "content")
    blocks = files.mapInArrow(
        run, "stream string, file long, block int, size long, closed boolean, ends array<long>, starts array<long>, numbers array<long>")
    before = Window.partitionBy("stream").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("stream").orderBy(F.desc("file"), F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.withColumns({
        "offset": F.coalesce(F.sum("size").over(before), F.lit(0)),
        "fresh": F.coalesce(F.last("closed").over(before), F.lit(True)),
    }).withColumn("first_end", F.col("offset") + F.try_element_at("ends", F.lit(1))).withColumns({
        "next_end": F.last("first_end", ignorenulls=True).over(after),
        "behind": F.max(F.col("offset") + F.col("size")).over(Window.partitionBy("stream")),
    })
    rows = stitched.select("stream", "offset", "next_end", "behind", "fresh", F.posexplode(F.arrays_zip(
        "starts", "numbers", F.col("ends").alias("stops"))).alias("k", "doc")).where("doc.starts is not null and (k > 0 or fresh)")
    stop = F.coalesce(F.col("offset") + F.col("doc.stops"), "next_end")
    counted = rows.select(
        "stream", (F.col("offset") + F.col("doc.starts")).alias("start"),
        (F.coalesce(stop, "behind") - F.col("offset") - F.col("doc.starts") - digits).alias("n_tokens"),
        stop.isNotNull().alias("complete"), F.col("doc.numbers").alias("number"))
    return counted if numbered else counted.drop("number")


def corpus_counts(docs: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id and n_tokens of every document, read back from flat token files.

    The files are written to the shared folder first. Null and empty texts have no
    tokens; texts of any length are whole; repeated rows each get a row; a null doc_id
    comes back as null. Other columns are ignored, whatever their names; an empty table
    gives no rows. A doc_id that is no integer doesn't fit into the files' numbers: TypeError.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be an integer")
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, ranks_file)
    return document_counts(spark, path).select(F.col("number").alias("doc_id"), "n_tokens", "complete")
