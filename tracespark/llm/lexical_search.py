"""Op 13: ranked lexical search over posting lists in blocks of similar documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from tracespark.llm.common import WORD_TABLE, as_bytes, byte_chunks, dropped, stored

#: Stands between texts; no term can be this one.
BETWEEN = b"-"
VECTORS = "doc_id long, n long, terms binary, tfs binary"


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """Each document's number of terms, and its counts of the vocabulary's terms (int32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary.value, pa.binary())
        for batch in batches:
            for part in byte_chunks(batch, "text", 8 << 20):
                blob = (b" %b " % BETWEEN).join([t.translate(WORD_TABLE) for t in as_bytes(part)])
                coded = pa.array([BETWEEN, *blob.split()], pa.binary()).dictionary_encode()
                ids = coded.indices.to_numpy()[1:]
                doc = np.cumsum(ids == 0)
                n = np.bincount(doc, minlength=part.num_rows) - 1
                n[0] += 1  # no mark stands before the first text
                term = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy()[ids]
                pairs, tf = np.unique((doc.astype(np.int64) << 32 | term)[term >= 0], return_counts=True)
                ends = np.searchsorted(pairs >> 32, np.arange(part.num_rows), "right")
                terms, tf = (pairs & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)
                cut = lambda x: [x[a:z].tobytes() for a, z in zip([0, *ends[:-1]], ends)]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(cut(terms), pa.binary()), pa.array(cut(tf), pa.binary())],
                    names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS)


def _document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: tasks add up arrays of its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return df


class PostingList:
    """The documents of one term in blocks of similar ones, each with a summary.

    Some of the list's documents are pivots, and every document goes to the pivot with
    which it has the largest inner product (over the 64 heaviest coordinates, which decide
    nothing but the blocks). Blocks of over twice ``size`` documents are cut. A block's
    summary holds the largest value of each coordinate in ``asked`` among its documents.
    """

    def __init__(self, shard: "Shard", docs: np.ndarray, asked: np.ndarray, size: int):
        entries, lengths = shard.entries(docs)
        terms, values = shard.terms[entries], shard.values[entries]
        chosen = asked[terms]
        row = np.repeat(np.arange(len(docs)), lengths)[chosen]
        terms, values = terms[chosen], values[chosen]
        block = np.zeros(len(docs), np.int64)
        if len(docs) > size:
            most = np.zeros(len(asked), np.int64)
            np.maximum.at(most, terms, values)
            heavy = np.argsort(-most, kind="stable")[:64]
            column = np.full(len(asked), -1)
            column[heavy] = np.arange(len(heavy))
            dense = np.zeros((len(docs), len(heavy)), np.float32)
            inside = column[terms] >= 0
            dense[row[inside], column[terms[inside]]] = values[inside]
            pivots = dense[:: size]
            block = (dense @ (pivots / np.maximum(1e-9, np.linalg.norm(pivots, axis=1, keepdims=True))).T).argmax(1)
        order = np.argsort(block, kind="stable")
        begins = np.append(True, np.diff(block[order]) > 0)
        within = np.arange(len(docs)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        begins |= within % (2 * size) == 0
        self.docs, self.starts = docs[order], np.append(np.flatnonzero(begins), len(docs))
        number = np.empty(len(docs), np.int64)
        number[order] = np.cumsum(begins) - 1
        by = np.lexsort((terms, number[row]))
        key, sorted_terms, sorted_values = number[row][by], terms[by], values[by]
        first = np.flatnonzero(np.append(True, (np.diff(key) > 0) | (np.diff(sorted_terms) > 0))) if len(key) else np.empty(0, np.int64)
        self.summary_terms = sorted_terms[first]
        self.summary_values = np.maximum.reduceat(sorted_values, first) if len(first) else sorted_values
        self.summary_starts = np.searchsorted(key[first], np.arange(len(self.starts) - 1))

    def bounds(self, mine: np.ndarray) -> np.ndarray:
        """What no document of each block can score above; ``mine`` marks the query's terms."""
        return np.add.reduceat(np.append(self.summary_values * mine[self.summary_terms], 0), self.summary_starts)


class Shard:
    """An index of some documents: vectors of w * (term's share), lists built when asked."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, weights: np.ndarray, total: int, length: int):
        self.ids, self.ends, self.terms = ids, ends, terms
        self.starts = np.append(0, ends[:-1])
        m = np.repeat(10 + (90 * n * total) // length, ends - self.starts)
        tf = tfs.astype(np.int64)
        self.values = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        by = np.argsort(terms, kind="stable")
        self.posted = np.repeat(np.arange(len(ends)), ends - self.starts)[by]
        self.list_ends = np.cumsum(np.bincount(terms, minlength=len(weights)))
        self.most = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(np.diff(self.list_ends, prepend=0))
        self.most[some] = np.maximum.reduceat(self.values[by], np.append(0, self.list_ends)[some]) if len(some) else 0
        self.lists: dict[int, PostingList] = {}
        self.held = 0

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' coordinates, one document after the other, and their numbers."""
        lengths = self.ends[docs] - self.starts[docs]
        return np.arange(lengths.sum()) + np.repeat(self.starts[docs] - np.cumsum(lengths) + lengths, lengths), lengths

    def scores(self, docs: np.ndarray, mine: np.ndarray) -> np.ndarray:
        entries, lengths = self.entries(docs)
        own = np.append(self.values[entries] * mine[self.terms[entries]], 0)
        return np.add.reduceat(own, np.cumsum(lengths) - lengths) * (lengths > 0)

    def list_of(self, term: int, asked, size: int) -> PostingList:
        if term not in self.lists:
            if self.held > 1 << 22:  # summaries are kept up to a bound, then made anew
                self.lists.clear()
                self.held = 0
            begin, end = (self.list_ends[term - 1] if term else 0), self.list_ends[term]
            self.lists[term] = PostingList(self, self.posted[begin:end], asked(term), size)
            self.held += len(self.lists[term].summary_terms) + end - begin
        return self.lists[term]


class Search:
    """The best documents of every query so far, and what they let a shard skip."""

    def __init__(self, queries: list[np.ndarray], n_terms: int, top: int, size: int = 32):
        self.queries, self.n_terms, self.top, self.size = queries, n_terms, top, size
        self.best = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in queries]  # score, null id, id
        self.askers: dict[int, list[int]] = {}
        for q, terms in enumerate(queries):
            for t in terms.tolist():
                self.askers.setdefault(t, []).append(q)
        self.evaluated = self.skipped = 0

    def asked(self, term: int) -> np.ndarray:
        """Which coordinates summaries of a term's list need: those of the queries that have it."""
        found = np.zeros(self.n_terms, bool)
        for q in self.askers.get(term, ()):
            found[self.queries[q]] = True
        return found

    def add(self, shard: Shard) -> None:
        for q in range(len(self.queries)):
            self._ask(q, shard)

    def _least(self, q: int) -> int:
        """Documents below this score cannot be among the best; equal ones can, by their id."""
        scores = self.best[q][0]
        return max(1, int(scores[-1])) if len(scores) == self.top else 1

    def _ask(self, q: int, shard: Shard) -> None:
        terms = self.queries[q]
        mine = np.zeros(self.n_terms, np.int64)
        mine[terms] = 1
        seen = np.zeros(len(shard.ends), bool)
        # Lists by falling maximum: a document in none of the lists so far scores at most
        # the sum of the others' maxima, and the rest is skipped once this is too low.
        terms = terms[np.argsort(-shard.most[terms], kind="stable")]
        left = np.cumsum(shard.most[terms][::-1])[::-1]
        for term, bound in zip(terms.tolist(), left.tolist()):
            if bound < self._least(q) or not shard.most[term]:
                break
            posting = shard.list_of(term, self.asked, self.size)
            bounds = posting.bounds(mine)
            order = np.argsort(-bounds, kind="stable")
            at, step = 0, 4
            while at < len(order) and bounds[order[at]] >= self._least(q):
                chosen = order[at : at + step]
                chosen = chosen[bounds[chosen] >= self._least(q)]
                docs = np.concatenate([posting.docs[posting.starts[b] : posting.starts[b + 1]] for b in chosen])
                docs = docs[~seen[docs]]
                seen[docs] = True
                self.evaluated += len(docs)
                if len(docs):
                    self._take(q, shard.scores(docs, mine), shard.ids.take(pa.array(docs)))
                at, step = at + step, 2 * step
            self.skipped += len(order) - min(at, len(order))

    def _take(self, q: int, scores: np.ndarray, ids: pa.Array) -> None:
        good = scores >= self._least(q)
        if not good.any():
            return
        none = ids.is_null().to_numpy(zero_copy_only=False)[good]
        held = [np.append(a, b) for a, b in zip(self.best[q], (scores[good], none, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[good]))]
        order = np.lexsort((held[2], held[1], -held[0]))[: self.top]
        self.best[q] = tuple(x[order] for x in held)


def _shards(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[tuple]:
    """Arrays of documents with about ``postings`` coordinates (at least one document)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + postings, "right")))
            part = batch.slice(at, end - at)
            join = lambda c: np.frombuffer(b"".join(part.column(c).to_pylist()), np.int32)  # noqa: E731, B023
            yield part.column("doc_id"), part.column("n").to_numpy(), join("terms"), join("tfs"), np.cumsum(sizes[at:end])
            at = end


def ranked(
    docs: DataFrame, queries: DataFrame, *, top: int = 10, item_col: str = "item_id", size: int = 32, postings: int = 1 << 19, block_bytes: int = 4_000_000,
) -> DataFrame:
    """The ``top`` documents of every query by the sum of their terms' weights.

    Queries are taken in blocks of about ``block_bytes`` of text; a block's terms and items are
    the only things broadcast. One scan turns all documents into vectors over the block's
    terms; their number, lengths and document frequencies are counted over all of them.
    Each task then indexes its vectors shard by shard (``postings`` coordinates): posting lists
    are clustered into blocks of about ``size`` similar documents, whose summaries hold the
    largest value of every coordinate that a query with the list's term asks. A block is
    read only if the sum of its summary over the query's terms reaches the last of the
    query's best documents so far, which a task carries from shard to shard. Bounds are
    exact, so that the result is that of scoring every document.

    Terms are maximal runs of letters, digits and bytes beyond ASCII, A-Z in lower case. Null
    and empty texts have no terms; a null id is ranked behind equal scores; every row is a
    document, repeated ones too; rows of one item are one query; items without terms and an
    empty table give no rows; texts of any length are whole; ids are whole numbers; other
    columns are ignored.

    Returns item, rank int, doc_id long, score long.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    items = queries.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    kind = to_arrow_type(items.schema["item"].dataType)
    schema = StructType([items.schema["item"], StructField("doc_id", LongType()), StructField("score", LongType())])
    found = []
    for block in range(n_blocks):
        by_item: dict = {}
        for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect():
            by_item.setdefault(r.item, set()).update(bytes(r.text).translate(WORD_TABLE).split())
        words = sorted(set().union(*by_item.values()))
        if not words:
            continue
        number = {w: k for k, w in enumerate(words)}
        asked = [(item, np.array(sorted(number[w] for w in own), np.int64)) for item, own in by_item.items() if own]
        vocabulary = context.broadcast(words)
        vectors = stored(_vectors(docs, vocabulary), "search-vectors")
        vocabulary.destroy()
        n, length = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n:
            dropped(vectors)
            continue
        df = _document_frequencies(vectors, len(words))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        shared = context.broadcast((asked, weights))
        found.append(stored(_best(vectors, shared, n, length, kind, schema, top, size, postings), "search-best"))
        shared.destroy()
        dropped(vectors)
    best = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def _best(vectors: DataFrame, shared, n: int, length: int, kind: pa.DataType, schema: StructType, top: int, size: int, postings: int) -> DataFrame:
    """The best documents of each task: item, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        search = Search([terms for _, terms in asked], len(weights), top, size)
        for part in _shards(batches, postings):
            search.add(Shard(*part, weights, n, length))
        for (item, _), (scores, none, ids) in zip(asked, search.best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(ids), kind), pa.array(ids, mask=none), pa.array(scores)], names=["item", "doc_id", "score"])

    return vectors.where("length(terms) > 0").mapInArrow(run, schema)
