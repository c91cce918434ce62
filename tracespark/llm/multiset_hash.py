"""Op 10: document fingerprints that are sums over paragraphs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracespark.llm.common import id_key

#: Lanes of 64 bits, summed modulo 2^64: equal sums mean equal multisets of paragraphs.
WIDE = 8
#: Lanes of 32 bits, summed modulo 2^32: signed counts of the paragraphs' word runs. A
#: string of 2 GB has at most 2^30 words, so that no text's lane changes its sign.
NARROW = 128
#: Words of a run.
RUN = 3

_WORDS: dict[str, int] = {}


def _word_hash(word: str) -> int:
    known = _WORDS.get(word)
    if known is None:
        if len(_WORDS) > 500_000:
            _WORDS.clear()
        known = _WORDS[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return known


def vector(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the paragraphs' wide vectors: uint64 lanes and uint32 lanes.

    A paragraph's wide lanes are its SHA-512; its narrow lanes get one +1 or -1 for
    each run of three words (a shorter paragraph: for all its words), by hash. Adding a
    paragraph's vector inserts it, subtracting deletes it, in any order.
    """
    digests = b"".join([hashlib.sha512(p.encode("utf-8", "surrogatepass")).digest() for p in paragraphs])
    wide = np.frombuffer(digests, "<u8").reshape(-1, WIDE).sum(0, dtype=np.uint64)
    words = [p.split() for p in paragraphs]
    sizes = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter((_word_hash(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    if not hashes.size:
        return wide, np.zeros(NARROW, np.uint32)
    owner = np.repeat(np.arange(sizes.size), sizes)
    padded = np.r_[hashes, np.zeros(RUN - 1, np.uint64)]
    ends = np.r_[owner, np.full(RUN - 1, -1)]
    runs = hashes.copy()
    full = np.ones(hashes.size, bool)
    for k in range(1, RUN):
        same = ends[k : k + hashes.size] == owner
        full &= same
        runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.where(same, padded[k : k + hashes.size], 0)
    first = np.r_[True, owner[1:] != owner[:-1]]
    full |= first & (sizes[owner] < RUN)
    runs = runs[full]
    runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    lane = (runs >> np.uint64(40)).astype(np.int64) % NARROW
    sign = 1 - 2 * ((runs >> np.uint64(20)) & np.uint64(1)).astype(np.int64)
    return wide, np.bincount(lane, sign, NARROW).astype(np.int64).astype(np.uint32)


def text_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    return vector(text.split("\n"))


def combined(a: tuple, b: tuple, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The vector of both multisets together (sign -1: of a without b)."""
    return tuple(x + y if sign > 0 else x - y for x, y in zip(a, b, strict=True))


def as_hex(v: tuple[np.ndarray, np.ndarray]) -> str:
    return v[0].astype("<u8").tobytes().hex() + v[1].astype("<u4").tobytes().hex()


def from_hex(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: 8 * WIDE], "<u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], "<u4").astype(np.uint32)


def likeness(a: tuple, b: tuple) -> float:
    """0 to 1, from the two vectors alone: the cosine of the signed counts; equal: 1."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].view(np.int32).astype(float), b[1].view(np.int32).astype(float)
    size = math.sqrt((x @ x) * (y @ y))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame, range_bytes: int, most: int) -> tuple[DataFrame, int]:
    """``docs`` (key, text) dealt to runs of keys, each with the row that follows it.

    Adds range (by key, ascending) and visitor (0: own row; 1: a copy of the row that
    follows the range in descending order of key). Only one row per range is known to
    the driver, at most ``most``.
    """
    total, = docs.agg(F.sum(F.octet_length("text"))).first()
    n = max(1, min(most, -(-(total or 0) // range_bytes)))
    cuts = docs.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    splits = [-math.inf, *sorted({float(c) for c in cuts or []}), math.inf]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(
            docs.withColumn("_key", F.col("key").cast("double"))).withColumn("range", F.col("_range").cast("int")).drop("_key", "_range")
    else:
        ranged = docs.withColumn("range", F.lit(0))
    heads = sorted((r.range, r.head) for r in ranged.groupBy("range").agg(F.max("key").alias("head")).collect())
    # The range above reads on in this range's head; after the lowest comes the highest.
    targets = [(head, heads[(k + 1) % len(heads)][0]) for k, (_, head) in enumerate(heads)]
    spark = docs.sparkSession
    visits = spark.createDataFrame(targets, "key long, target int")
    own = F.struct("range", F.lit(0).alias("visitor"))
    out = ranged.join(F.broadcast(visits), "key", "left").withColumn(
        "to", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(
            F.array(own, F.struct(F.col("target").alias("range"), F.lit(1).alias("visitor"))))))
    return out.select("to.range", "to.visitor", "key", "doc_id", "text"), max(1, len(heads))


def paired_fingerprints(docs: DataFrame, *, range_bytes: int = 4 << 20, most_ranges: int = 20_000) -> DataFrame:
    """Fingerprints of every document and of its edited text, and what they tell.

    The next document is that of the next lower doc_id (null counts as the lowest);
    after the last comes the first. Rows of one doc_id follow each other by text. Null
    texts are empty. Texts are shuffled once, to ranges of doc_id that are read in
    order; each range also gets a copy of the one row that follows it. A task holds two
    texts, however long its range is: beyond ``most_ranges`` of ``range_bytes`` ranges
    grow, and their sort spills. An empty table gives no rows; other columns are ignored,
    whatever their names. A doc_id that is no integer has no next one: TypeError.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be an integer")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, n = _ranges(docs.select(
        id_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), range_bytes, most_ranges)
    dealt = rows.repartition(n, "range").sortWithinPartitions(
        F.col("range"), F.col("visitor"), F.col("key").desc(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is still to come
        for batch in batches:
            ranges, visitors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k in range(batch.num_rows):
                if held and held[0] != ranges[k]:
                    held = None
                if visitors[k] and not held:
                    continue
                text = batch.column(4)[k].as_py()
                v = text_vector(text)
                if held:
                    out.append(_row(*held[1:], text, v))
                held = None if visitors[k] else (ranges[k], batch.column(3)[k].as_py(), text, v)
                if len(out) == 256:
                    yield _record(out, batch.schema.field(3).type)
                    out = []
            if out:
                yield _record(out, batch.schema.field(3).type)

    return dealt.mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double")


def _row(doc_id, text: str, v: tuple, following: str, following_v: tuple) -> tuple:
    new = edited(text, following)
    w = text_vector(new)
    return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_hex(v), as_hex(w), likeness(v, w), likeness(v, following_v))


def _record(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
