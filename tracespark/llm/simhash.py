"""Op 8: SimHash fingerprints and their groups of near copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracespark.llm.common import LOWER_TABLE, any_key, chunks, dropped, id_key, row_tie, stored
from tracespark.llm.components import components

#: The embedding: 32 segments of 2 bits, one byte of counts for every 4 segments.
GROUPS = 8
#: 64 bits as the bit count of every 2-bit segment (half adders, without carries).
COUNTS = (
    "shiftleft((fp & shiftrightunsigned(fp, 1)) & 6148914691236517205L, 1)"
    " | ((fp ^ shiftrightunsigned(fp, 1)) & 6148914691236517205L)"
)
#: Manhattan distance of two bytes of counts (four segments each), by both bytes.
FOUR = np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3
MANHATTAN = np.abs(FOUR[:, None] - FOUR[None]).sum(2).astype(np.uint8).ravel()
EVEN = np.uint64(0x5555555555555555)
#: Cells up to this size give all their links, larger ones a spanning forest.
SMALL_CELL = 8


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, unsigned; no words: zero."""
    words = (text or b"").translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + 1) - 1
        starts = (stops - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        octets = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp (64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                marks = [fingerprint(x.as_py(), shingle, seed) for x in part.column(1)]
                bits = np.array(marks, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bits)], names=["doc_id", "tie", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary"), row_tie()).mapInArrow(run, f"doc_id {kind}, tie long, fp long")


def counts_of(marks: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the 32 segments, packed into 8 bytes a row (as ``COUNTS``)."""
    x = np.ascontiguousarray(marks).view(np.uint64)
    y = x >> np.uint64(1)
    return (((x & y & EVEN) << np.uint64(1)) | ((x ^ y) & EVEN)).view(np.uint8).reshape(-1, 8)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed count vectors, row by row: never more than the differing bits."""
    return MANHATTAN[(a.astype(np.uint16) << 8) | b].sum(1, dtype=np.uint8)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count the magnitude's bits


def near_pairs(marks: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether the fingerprints at places ``a`` and ``b`` are near: by the bound, then by their bits."""
    near = manhattan(counts[a], counts[b]) <= distance
    near[near] = differing_bits(marks[a[near]], marks[b[near]]) <= distance
    return near


def forest(marks: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints which the full set of links would join."""
    counts, rest, links = counts_of(marks), np.arange(marks.size), []
    while rest.size > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and rest.size:
            k = stack.pop()
            near = near_pairs(marks, counts, rest, np.broadcast_to(k, rest.size), distance)
            if near.any():
                new = rest[near]
                rest = rest[~near]
                links += [(marks[k], x) for x in marks[new]]
                stack += new.tolist()
    return links


def cell_links(table: np.ndarray, cell: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links inside the cells of rows sorted by (table, cell)."""
    new = np.r_[True, (table[1:] != table[:-1]) | (cell[1:] != cell[:-1])]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, fp.size])
    number = np.cumsum(new) - 1
    small = sizes[number] <= SMALL_CELL
    links: list[tuple[int, int]] = []
    counts = counts_of(fp)
    for step in range(1, SMALL_CELL):
        at = np.flatnonzero((number[:-step] == number[step:]) & small[:-step]) if fp.size > step else []
        if not len(at):
            break
        at = at[near_pairs(fp, counts, at, at + step, distance)]
        links += zip(fp[at].tolist(), fp[at + step].tolist(), strict=True)
    for k in np.flatnonzero(sizes > SMALL_CELL):
        links += forest(fp[starts[k] : starts[k] + sizes[k]], distance)
    return links


def near_links(classes: DataFrame, *, distance: int = 4, block: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` of at most ``distance`` bits.

    The links join exactly the fingerprints that all links would join; in a cell of
    many near copies only a spanning forest is given, so that their number stays
    linear.

    Every fingerprint becomes the vector of its bit counts in 32 segments. The
    Manhattan distance of two vectors is at most the number of differing bits, so that
    linked vectors agree in all coordinates of ``8 - distance`` of the 8 groups of
    coordinates: the range join looks only at vectors which share the grid cell of such
    a choice of groups, takes those within Manhattan distance ``distance`` over all 32
    counts, and verifies the bits of these.

    Cells are read in sorted order. One of over ``block`` members is not compared in
    its task: it is dealt out as pairs of blocks of ``block`` members each.
    """
    masks = [sum(255 << (8 * g) for g in keep) for keep in combinations(range(GROUPS), GROUPS - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    grid = classes.select("fp", F.expr(COUNTS).alias("counts")).select(
        "fp", "counts", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("grid", "mask"),
    ).select("grid", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"), "fp")

    names = ["a", "b", "grid", "block"]

    def rows(a, b, grid=None, part=None):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)),
             pa.array([-1] * n if grid is None else grid, pa.int32()),
             pa.array([0] * n if part is None else part, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        spilt, n_spilt = None, 0  # the cell that is being dealt out, and its rows so far
        for batch in batches:
            held = [np.r_[h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)] for i, h in enumerate(held)]
            if not held[2].size:
                continue
            last = int(np.flatnonzero(np.r_[True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])])[-1])
            grid, cell, fp = held
            begin = 0
            if spilt:  # rows that still belong to it
                begin = int(np.searchsorted(~((grid == spilt[0]) & (cell == spilt[1])), True))
                if begin:
                    yield rows(cell[:begin], fp[:begin], grid[:begin], (n_spilt + np.arange(begin)) // block)
                    n_spilt += begin
                if begin == fp.size:
                    held = [h[begin:] for h in held]
                    continue
                spilt = None
            if begin < last:
                links = cell_links(grid[begin:last], cell[begin:last], fp[begin:last], distance)
                if links:
                    yield rows(*zip(*links, strict=True))
            held = [h[max(begin, last) :] for h in held]
            if held[2].size > block:
                grid, cell, fp = held
                yield rows(cell, fp, grid, np.arange(fp.size) // block)
                spilt, n_spilt = (grid[0], cell[0]), fp.size
                held = [h[:0] for h in held]
        if held[2].size > 1:
            links = cell_links(*held, distance)
            if links:
                yield rows(*zip(*links, strict=True))

    found = stored(
        grid.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
        .mapInArrow(run, "a long, b long, grid int, block int"), "simhash-links")
    links = found.where("grid < 0").select("a", "b")
    dealt = found.where("grid >= 0").select("grid", F.col("a").alias("cell"), F.col("b").alias("fp"), "block")
    if dealt.isEmpty():
        return links.distinct()
    blocks = dealt.groupBy("grid", "cell").agg(F.max("block").alias("last"))
    pairs = dealt.join(blocks, ["grid", "cell"]).withColumn("other", F.explode(F.expr("sequence(0, last)"))).select(
        "grid", "cell", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(group):
        import pandas as pd

        return pd.DataFrame(forest(np.sort(group["fp"].to_numpy()), distance), columns=["a", "b"], dtype=np.int64)

    wide = pairs.groupBy("grid", "cell", "i", "j").applyInPandas(compare, "a long, b long")
    return links.union(wide).distinct()


def near_groups(docs: DataFrame, *, distance: int = 4, shingle: int = 4, seed: int = 42, block: int = 4096) -> DataFrame:
    """Fingerprint and component of every document row.

    Rows of equal fingerprints are one class; classes are linked by ``near_links`` and
    united by ``components``. A row's component is the smallest doc_id that is
    reachable from it. Null and empty texts have the fingerprint zero and are linked
    like any other; a null doc_id keeps its row and never names a component unless all
    of its members' ids are null (then null). Repeated rows each keep theirs. Other
    columns are ignored; an empty table gives no rows.

    Returns doc_id, tie, fp long, root (a fingerprint that names the group), component_id.
    """
    marks = stored(fingerprints(docs, shingle=shingle, seed=seed), "simhash")
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    links = near_links(classes.select("fp"), distance=distance, block=block)
    roots = components(links)
    dropped(links)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Stored before it meets its members, so that Spark may split a large component.
    least = stored(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-components")
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marks.join(named, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def _shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles (fewer words: of the whole sequence)."""
    words = (text or b"").translate(LOWER_TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh3_64_intdigest
    ends = stops[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip((stops - lengths)[:n].tolist(), ends, strict=True)], np.uint64))


def similar_forest(roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (places in the lists) that join all texts which the full set of links would join.

    Texts of one root are joined already. Each text is compared with all that the search
    has not reached, by postings of the shingles.
    """
    sizes = np.array([s.size for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    rest, links = np.ones(len(sets), bool), []
    while rest.any():
        stack = np.flatnonzero(rest & (roots == roots[np.argmax(rest)])).tolist()
        rest[stack] = False
        while stack and rest.any():
            k = stack.pop()
            low, high = np.searchsorted(flat, sets[k]), np.searchsorted(flat, sets[k], "right")
            n = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=rest.size)
            near = rest & (shared >= similarity * (sizes[k] + sizes - shared))
            if near.any():
                links += [(k, x) for x in np.flatnonzero(near).tolist()]
                new = rest & np.isin(roots, roots[near])
                rest &= ~new
                stack += np.flatnonzero(new).tolist()
    return links


def similar_links(
    docs: DataFrame, known: DataFrame | None = None, *, shingle: int = 5, similarity: float = 0.8, bands: int = 20,
    rows: int = 5, block: int = 1 << 18,
) -> DataFrame:
    """Links (a, b) between texts, by hash (``tie``), that join what ``known`` links (a, b)
    and all proposed pairs of so similar shingle sets would join.

    Null texts and texts without words have no shingles and no links; repeated rows are
    one text; an empty table has no links; other columns are ignored.

    SimHashes of texts that share 0.8 of their five-word shingles differ in up to 14 of
    64 bits, further than a grid of bit counts can look. Pairs are therefore proposed by
    bands of min-wise samples (a pair at 0.8 is missed by all 20 bands once in 2,900
    times) and verified on the whole sets; equal texts are one. Texts without words are
    left out.

    In a bucket every text is first compared with the smallest and the largest one, which
    is all pairs of up to three texts and a linear number. Where the others of a bucket
    are then still in several components, all of them are compared by ``similar_forest``:
    buckets of the same texts once, and buckets of over ``block`` shingles as pairs of
    blocks of about so many.
    """
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    texts = docs.select(row_tie().alias("tie"), F.col("text").cast("binary").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                ties, keys, sizes = [], [], []
                for tie, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    hashes = _shingle_hashes(text.as_py(), shingle)
                    if not hashes.size:
                        continue
                    least = np.full(bands * rows, np.uint64(2**64 - 1))
                    for at in range(0, hashes.size, 2048):
                        x = hashes[at : at + 2048, None] * factors + offsets
                        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
                    band = least.reshape(bands, rows)
                    key = np.zeros(bands, np.uint64)
                    for k in range(rows):
                        key = (key ^ band[:, k]) * np.uint64(0x9FB21C651E98DF25)
                        key ^= key >> np.uint64(29)
                    ties.append(tie)
                    keys.append(key.view(np.int64))
                    sizes.append(hashes.size)
                n = len(ties)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ties, np.int64), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)),
                     pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)),
                     pa.array(np.repeat(np.array(sizes, np.int64), bands))], names=["tie", "band", "key", "size"])

    placed = stored(
        texts.mapInArrow(sketch, "tie long, band int, key long, size long").distinct(), "similar-bands")
    buckets = placed.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("tie").alias("low"), F.max("tie").alias("high")).where("n > 1")
    pairs = stored(
        placed.join(buckets, ["band", "key"]).select("tie", F.explode(F.array("low", "high")).alias("b"))
        .where("tie <> b").select(F.least("tie", "b").alias("a"), F.greatest("tie", "b").alias("b")).distinct(), "similar-pairs")
    ends = pairs.select(F.col("a").alias("tie")).union(pairs.select("b")).distinct()

    def as_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = [_shingle_hashes(t.as_py(), shingle).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("tie"), pa.array(sets, pa.list_(pa.int64()))], names=["tie", "shingles"])

    sets = stored(
        texts.join(ends, "tie").mapInArrow(as_set, "tie long, shingles array<long>").dropDuplicates(["tie"]), "similar-sets")
    both = pairs.join(sets.select(F.col("tie").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("tie").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    star = stored(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "similar-links")
    dropped(pairs)
    roots = components(star if known is None else star.union(known))

    # The smallest and the largest text of a bucket have met all others.
    bucket = ["band", "key"]
    others = stored(
        placed.join(buckets.where("n > 3"), bucket).where("tie <> low and tie <> high")
        .join(roots.withColumnRenamed("node", "tie"), "tie", "left")
        .select(*bucket, "tie", "size", F.coalesce("root", "tie").alias("root")), "similar-others")
    dropped(placed)
    same = ["n", "sum", "other_sum"]
    apart = others.groupBy(*bucket).agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("tie").cast("decimal(20,0)")).alias("sum"),
        F.sum(F.hash("tie").cast("long")).alias("other_sum"), F.sum("size").alias("total"),
        F.min("root").alias("least"), F.max("root").alias("most"),
    ).where("least <> most").groupBy(*same).agg(F.min(F.struct(*bucket, "total")).alias("one")).select(
        "one.band", "one.key", F.ceil(F.col("one.total") / block).cast("long").alias("blocks"))
    dealt = others.join(apart, bucket).withColumns({
        "block": F.expr("pmod(xxhash64(tie, 1), blocks)"), "other": F.explode(F.expr("sequence(0L, blocks - 1)"))}).select(
        *bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "tie", "root")

    def compare(group: pa.Table) -> pa.Table:
        ties, joined = group["tie"].to_numpy(), group["root"].to_numpy()
        found = similar_forest(joined, [x.values.to_numpy() for x in group["shingles"]], similarity)
        pairs = ties[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    late = dealt.join(sets, "tie").groupBy(*bucket, "i", "j").applyInArrow(compare, "a long, b long")
    links = stored(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late).distinct(), "similar-links")
    for table in (star, sets, others):
        dropped(table)
    return links


def first_of_groups(docs: DataFrame, *, similarity: float | None = 0.8, **options) -> DataFrame:
    """The documents without near copies: of each group the row of the smallest doc_id.

    Groups are those of ``near_groups``, joined further by ``similar_links`` (five-word
    shingles; ``similarity`` None: not). Rows that repeat an id are told apart by their
    text's hash, and rows without an id stay only where a group has no other; of equal
    rows one stays. Null and empty texts are one group; a doc_id may be of any type that
    has an order; an empty table gives no rows; all columns stay, whatever their names. The
    groups are found without their texts, which are shuffled once
    more to meet the rows that stay.
    """
    groups = stored(near_groups(docs, **options), "simhash-groups")
    numeric = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    if similarity is not None:
        named = stored(groups.groupBy("root").agg(F.min("tie").alias("b")), "simhash-names")
        known = groups.select("root", F.col("tie").alias("a")).join(named, "root").select("a", "b").where("a <> b")
        roots = components(similar_links(docs, known, similarity=similarity)).select(F.col("node").alias("tie"), F.col("root").alias("_joined"))
        groups = groups.join(roots, "tie", "left").withColumn("root", F.coalesce("_joined", "tie"))
    kept = groups.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), id_key().alias("_order") if numeric else F.col("doc_id").alias("_order"),
        any_key(groups).alias("_key"), F.col("tie").alias("_tie"))).alias("one"))
    # The documents' columns go in one struct, so that none clashes with the keys.
    named = docs.select(any_key(docs).alias("_key"), row_tie().alias("_tie"), F.struct(*docs.columns).alias("row"))
    keys = ["_key", "_tie"]
    return named.join(kept.select("one._key", "one._tie"), keys, "left_semi").dropDuplicates(keys).select("row.*")
