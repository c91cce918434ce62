"""Op 9: benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracespark.llm.common import WORD_TABLE, any_key, as_bytes, chunks, row_tie, stored

HITS = "n_words long, starts array<int>, stops array<int>, items array<string>"


class WuManber:
    """Finds runs of ``width`` consecutive item words (short items: the whole item).

    Patterns of one length share a shift table over blocks of two words. A block that
    no pattern has lets the search move on by all of its length; a block that ends
    patterns selects a bucket, by the pattern's first block, of strings that are then
    compared word by word.
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = text.translate(WORD_TABLE).split()
            size = min(width, len(words))
            if size:
                table = by_length.setdefault(size, {})
                for at in range(len(words) - size + 1):
                    table.setdefault(tuple(words[at : at + size]), set()).add(item)
        self.groups = [(size, *self._tables(size, table)) for size, table in sorted(by_length.items())]

    @staticmethod
    def _tables(size: int, patterns: dict) -> tuple[int, dict, dict]:
        block = min(2, size)
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns.items():
            for end in range(block, size + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets.setdefault(pattern[-block:], {}).setdefault(pattern[:block], []).append((pattern, items))
        return block, shift, buckets

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words, half open, and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, block, shift, buckets in self.groups:
            end, n, skip, back = size, len(words), size - block + 1, block
            get = shift.get
            while end <= n:
                key = tuple(words[end - back : end])
                step = get(key, skip)
                if step:
                    end += step
                    continue
                start = end - size
                for pattern, owners in buckets[key].get(tuple(words[start : start + back]), ()):
                    if tuple(words[start:end]) == pattern:
                        found.append((start, end))
                        items |= owners
                end += 1
        spans: list[tuple[int, int]] = []
        for start, end in sorted(found):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((start, end))
        return spans, items


_SEARCHERS: dict[str, WuManber] = {}


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, *, width: int = 10, id_col: str = "doc_id",
    item_col: str = "item_id", block_bytes: int = 4_000_000,
) -> DataFrame:
    """Each document row with the words that benchmark passages cover.

    The benchmark is searched in blocks of about ``block_bytes`` of item text (one
    block for a usual benchmark), each sent to the tasks as one bounded broadcast; its
    hits are united per row. A longer benchmark means more scans, one after the other, not
    larger tasks. A doc_id may be of any type.

    Null texts have no words; texts of any length are searched whole; an empty benchmark or
    table gives no hits or no rows;
    items without words never occur, and a null item_id counts as the empty string.
    Items that share an id are one item. Repeated document rows each get a row.

    Returns ``docs`` plus n_words long, starts and stops array<int> (merged spans of
    hit words, half open), items array<string> (sorted).
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("words"),
    )
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1

    def scan(block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == block)
        return _scan(docs, [(r.item, bytes(r.words)) for r in own.collect()], width)

    if n_blocks == 1:
        return scan(0)
    # Each block's hits are stored before the next block is read: the driver and the tasks hold one.
    key = [any_key(docs, id_col).alias("_key"), row_tie().alias("_tie")]
    hits = [stored(scan(block).where("size(items) > 0").select(*key, "starts", "stops", "items"), "benchmark-hits")
            for block in range(1, n_blocks)]
    whole = scan(0)
    hit = whole.where("size(items) > 0").select(*key, "starts", "stops", "items")
    for one in hits:
        hit = hit.unionByName(one)
    united = hit.groupBy("_key", "_tie").agg(
        F.flatten(F.collect_set(F.arrays_zip("starts", "stops"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).withColumn("spans", F.expr(
        # sorted spans are merged: a span that starts within the last one extends it
        "aggregate(array_sort(spans), cast(array() as array<struct<starts:int,stops:int>>), (m, s) ->"
        " case when size(m) > 0 and s.starts <= element_at(m, -1).stops then concat(slice(m, 1, size(m) - 1),"
        " array(named_struct('starts', element_at(m, -1).starts, 'stops', greatest(s.stops, element_at(m, -1).stops))))"
        " else concat(m, array(s)) end)"))
    none = F.array().cast("array<int>")
    return (
        whole.drop("starts", "stops", "items").withColumns({"_key": key[0], "_tie": key[1]})
        .join(united, ["_key", "_tie"], "left")
        .withColumns({"starts": F.coalesce("spans.starts", none), "stops": F.coalesce("spans.stops", none),
                      "items": F.coalesce("items", F.array().cast("array<string>"))})
        .drop("_key", "_tie", "spans")
    )


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = shared.value
        if name not in _SEARCHERS:  # built once in each Python worker
            _SEARCHERS.clear()
            _SEARCHERS[name] = WuManber(own, width)
        searcher = _SEARCHERS[name]
        for batch in batches:
            for part in chunks(batch):
                n_words, starts, stops, found = [], [], [], []
                for text in as_bytes(part):
                    words = text.translate(WORD_TABLE).split()
                    spans, hit = searcher.search(words)
                    n_words.append(len(words))
                    starts.append([s for s, _ in spans])
                    stops.append([e for _, e in spans])
                    found.append(sorted(hit))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(stops, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                    names=[*part.schema.names, "n_words", "starts", "stops", "items"],
                )

    docs = docs.drop("n_words", "starts", "stops", "items")
    return docs.mapInArrow(run, StructType(docs.schema.fields + StructType.fromDDL(HITS).fields))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs.select("doc_id", "text"), benchmark, width=width)
    n_hit = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0), lambda a, x: a + x)
    return hits.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )
