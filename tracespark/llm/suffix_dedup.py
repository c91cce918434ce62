"""Op 3: byte windows that repeat anywhere, by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracespark.llm.common import any_key, as_bytes, byte_chunks, chunks, dropped, row_tie, stored

#: First digit of a suffix: so many bytes at its anchor.
GRAM = 32
#: Bytes of a further digit.
DIGIT = 8
#: Bytes of the longest hash that is made by doubling.
HALF = 128
#: Bytes hashed at once; longer texts go in pieces that overlap by a window.
PIECE = 1 << 19
#: Suffixes that a task sorts at once.
SORTED = 1 << 19
LOW = np.uint64(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for every byte value (splitmix64 of 1 to 256).
BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _joined(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a * np.uint64(0xD6E8FEB86659FD93 + 2 * level)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 128 bytes from every position that has so many."""
    x, size, grams = BYTES[data], 1, None
    while size < HALF:
        x, size = _joined(x[:-size], x[size:], size), 2 * size
        if size == GRAM:
            grams = x
    return grams, x


def window_hashes(h128: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` bytes (129 to 256) from every position."""
    gap = window - HALF
    return _joined(h128[:-gap], h128[gap:], window)


def anchors(h64: np.ndarray, window: int) -> np.ndarray:
    """Of every window of bytes the place of its least gram, the leftmost on ties."""
    low = (h64 & ~LOW) | np.arange(h64.size, dtype=np.uint64)
    grams, size = window - GRAM + 1, 1
    while 2 * size <= grams:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    rest = grams - size
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & LOW).astype(np.int64)


def _blocks(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Bytes to hash at once, and their pieces: (text, offset in text, offset here, size)."""
    held: list[bytes] = []
    pieces: list[tuple[int, int, int, int]] = []
    n = 0
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) - window + 1), PIECE):
            piece = text[at : at + PIECE + window - 1]
            held.append(piece)
            pieces.append((k, at, n, len(piece)))
            n += len(piece)
            if n >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), pieces
                held, pieces, n = [], [], 0
    if n:
        yield np.frombuffer(b"".join(held), np.uint8), pieces


def anchor_spans(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of neighbouring windows that share an anchor.

    Yields arrays: text, place (``_packed``), hash of the anchor's gram, hash of all
    bytes of the run's windows.
    """
    for data, pieces in _blocks(texts, window):
        grams, h128 = gram_hashes(data)
        least = anchors(grams, window)
        starts = np.concatenate([np.arange(here, here + size - window + 1) for _, _, here, size in pieces])
        which = np.repeat(np.arange(len(pieces)), [size - window + 1 for _, _, _, size in pieces])
        at = least[starts]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], at.size] - 1
        p0, p1, anchor, piece = starts[first], starts[last], at[first], which[first]
        tail = p1 + window - HALF
        middle = np.minimum(p0 + HALF, tail)
        span = _joined(_joined(h128[p0], h128[middle], 1), h128[tail], 2)
        span = _joined(span, ((p1 - p0) * 1024 + (anchor - p0)).astype(np.uint64), 3)
        text = np.array([k for k, *_ in pieces])[piece]
        shift = np.array([offset - here for _, offset, here, _ in pieces])[piece]
        yield text, _packed(p0 + shift, anchor - p0, p1 - p0), grams[anchor].view(np.int64), span.view(np.int64)


def _packed(start: np.ndarray, skip: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One long: the first window's start, 8 bits for the anchor's offset in it, 8 bits
    for the number of further windows."""
    return start.astype(np.int64) << 16 | skip.astype(np.int64) << 8 | more.astype(np.int64)


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth-limited radix sort of the suffixes of ``data`` that begin at ``starts``.

    ``group`` holds each suffix's first digit. Each pass orders the suffixes of a group
    by their next eight bytes, the most significant first, splits the group and drops
    groups of one, until ``depth`` bytes are read (each suffix has so many). Groups that
    agree in a digit keep their order and are not sorted anew.

    Returns the suffixes (places in ``starts``) that are left, in order, and their
    groups' numbers: exactly the suffixes whose first ``depth`` bytes and first digit
    occur more than once.
    """
    words = np.ndarray((max(0, data.size - DIGIT + 1),), ">u8", data, strides=(1,))
    order = np.argsort(group, kind="stable")
    left, number = _split(order, group[order])
    for at in [*range(0, depth - DIGIT, DIGIT), depth - DIGIT]:
        if not left.size:
            break
        digit = words[starts[left] + at].astype(np.uint64)
        uneven = np.zeros(int(number[-1]) + 1, bool)
        uneven[number[1:][(number[1:] == number[:-1]) & (digit[1:] != digit[:-1])]] = True
        mixed = np.flatnonzero(uneven[number])
        if not mixed.size:
            continue
        sort = mixed[np.lexsort((digit[mixed], number[mixed]))]
        left[mixed], digit[mixed] = left[sort], digit[sort]
        left, number = _split(left, number, digit)
    return left, number


def _split(left: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of sorted rows by their keys, without groups of one."""
    if not left.size:
        return left, left
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
    number = np.cumsum(new) - 1
    stay = np.bincount(number)[number] > 1
    return left[stay], number[stay]


def repeated_windows(docs: DataFrame, *, window: int = 200, block: int = 1024) -> DataFrame:
    """Where the windows of ``window`` bytes (160 to 200) that occur more than once start.

    Sorting all suffixes to the depth of a window and reading off the equal groups
    gives exactly the repeated windows. Suffixes are sorted by most significant digits
    first, and a group of one leaves after each pass:

    1. The first digit is the 32 bytes at the window's anchor (its least gram by hash)
       and the anchor's offset. Equal windows have equal anchors at equal offsets, so
       that any such choice of the leading digit sorts them together; and neighbouring
       suffixes share an anchor, so that one row (about one in 80 bytes) stands for all
       of them. Spark counts the digit and drops what occurs once.
    2. Rows of equal spans (all bytes of their windows, by a second hash) fall into
       equal groups in every later pass. They are counted; one of each goes on, and
       where a span occurs twice its windows are known to repeat.
    3. What is left is dealt by its first digit with its bytes, and each task sorts the
       suffixes by the digits that follow, eight bytes at a time (``radix_groups``): groups
       that are left after the last digit are equal byte by byte.

    No group is gathered: a first digit of over ``block`` different spans is dealt out as
    several blocks, each sorted by itself. What such a block has (its lone suffixes, and one
    of each of its groups) goes on by a last digit, the hash of all bytes: each block sends
    one packed row to each of as many ranges of the hash, and a range reads off what several
    blocks have. Counts are stored before they meet the rows again, so that Spark may split
    hot keys.

    Returns id (``any_key``), tie (``row_tie``), starts array<long>: start << 8 | further starts.
    """
    if not 160 <= window <= 200:  # so that offsets fit into 8 bits, and three hashes cover a span
        raise ValueError("window must be 160 to 200 bytes")
    texts = docs.select(any_key(docs).alias("id"), row_tie().alias("tie"), F.col("text"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "text"):
                ids = part.column("id").to_numpy(zero_copy_only=False)
                ties = part.column("tie").to_numpy(zero_copy_only=False)
                for text, *columns in anchor_spans(as_bytes(part), window):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[text]), pa.array(ties[text]), *map(pa.array, columns)],
                        names=["id", "tie", "place", "gram", "span"])

    placed = stored(texts.mapInArrow(spans, "id long, tie long, place long, gram long, span long"), "anchors")
    grams = stored(placed.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    again = stored(placed.join(grams, "gram"), "anchors-again")
    dropped(placed)
    dropped(grams)
    classes = stored(again.groupBy("gram", "span").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "tie", "place")).alias("one")), "span-classes")
    several = stored(classes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(
        "gram", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "mixed-grams")
    asked = classes.join(several, "gram").select(
        "one.id", "one.tie", F.struct(
            "one.place", "gram", F.pmod("span", "blocks").cast("int").alias("block"), "blocks",
            (F.col("n") == 1).alias("alone")).alias("ask"),
    ).groupBy("id", "tie").agg(F.collect_list("ask").alias("asks"))

    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 64):
                for row in part.to_pylist():
                    yield from _span_rows(row, window)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["gram", "block"], 2 * SORTED // window):
            yield from _sorted_rows(group, window)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["gram", "part"], 64):
            yield from _united_rows(group)

    found_ddl = "id long, tie long, start long"
    dealt = texts.join(asked, ["id", "tie"]).mapInArrow(
        with_bytes, "id long, tie long, place long, gram long, block int, blocks int, alone boolean, bytes binary")
    ordered = stored(
        dealt.repartition("gram", "block").sortWithinPartitions("gram", "block")
        .mapInArrow(sort, f"{found_ddl}, gram long, part int, packed binary"), "sorted-windows")
    dropped(several)
    across = ordered.where("packed is not null").select("gram", "part", "packed").repartition("gram", "part").sortWithinPartitions(
        "gram", "part").mapInArrow(unite, found_ddl)
    whole = again.join(classes.where("n > 1").select("gram", "span"), ["gram", "span"]).select(
        "id", "tie", F.expr("shiftleft(shiftright(place, 16), 8) | (place & 255)").alias("start"))
    starts = stored(
        whole.union(ordered.where("packed is null").select("id", "tie", "start")).union(across)
        .groupBy("id", "tie").agg(F.collect_set("start").alias("starts")), "repeated-windows")
    for table in (again, classes, ordered):
        dropped(table)
    return starts


def _span_rows(row: dict, window: int) -> Iterator[pa.RecordBatch]:
    """The asked spans of one text with their bytes."""
    text = (row["text"] or "").encode()
    for at in range(0, len(row["asks"]), 2048):
        asks = row["asks"][at : at + 2048]
        begins = [a["place"] >> 16 for a in asks]
        n = len(asks)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["id"]] * n, pa.int64()), pa.array([row["tie"]] * n, pa.int64()),
             pa.array([a["place"] for a in asks], pa.int64()), pa.array([a["gram"] for a in asks], pa.int64()),
             pa.array([a["block"] for a in asks], pa.int32()), pa.array([a["blocks"] for a in asks], pa.int32()),
             pa.array([a["alone"] for a in asks], pa.bool_()),
             pa.array([text[b : b + (a["place"] & 255) + window] for a, b in zip(asks, begins, strict=True)], pa.binary())],
            names=["id", "tie", "place", "gram", "block", "blocks", "alone", "bytes"])


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by keys in tables of whole groups, of about so many rows at least."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for part in chunks(batch, 1024):
            held.append(part)
            n += part.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            new = np.flatnonzero(np.logical_or.reduce([(x[1:] != x[:-1]) for x in (table[k].to_numpy() for k in keys)])) + 1
            if new.size:
                yield table.slice(0, int(new[-1]))
                held = table.slice(int(new[-1])).combine_chunks().to_batches()
                n = table.num_rows - int(new[-1])
    if held:
        yield pa.Table.from_batches(held)


def _runs(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Neighbouring windows of a text as one row: start << 8 | further starts (up to 255)."""
    order = np.lexsort((starts, ties, ids))
    ids, ties, starts = ids[order], ties[order], starts[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]) | (starts[1:] != starts[:-1] + 1)][: ids.size]
    first = np.flatnonzero(new)
    step = np.arange(ids.size) - np.repeat(first, np.diff(np.r_[first, ids.size]))
    first = np.flatnonzero(step % 256 == 0)
    size = np.diff(np.r_[first, ids.size]) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[first]), pa.array(ties[first]), pa.array(starts[first] << 8 | size)], names=["id", "tie", "start"])


#: A suffix that goes on to the ranges of the last digit.
OPEN = np.dtype([("deep", "<u8"), ("id", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("alone", "?")])


def _sorted_rows(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Runs of the repeated windows, and of dealt groups what other blocks may repeat."""
    place, gram, block, blocks = (table[c].to_numpy() for c in ("place", "gram", "block", "blocks"))
    ids, ties, alone = table["id"].to_numpy(), table["tie"].to_numpy(), table["alone"].to_numpy().astype(bool)
    data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
    begin, skip, more = place >> 16, place >> 8 & 255, place & 255
    first = np.r_[0, np.cumsum(more + window)[:-1]]
    row = np.repeat(np.arange(place.size), more + 1)
    step = np.arange(row.size) - np.repeat(np.r_[0, np.cumsum(more + 1)[:-1]], more + 1)
    group = np.cumsum(np.r_[False, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])
    left, number = radix_groups(data, first[row] + step, group[row] * 256 + skip[row] - step, window)

    found = left[alone[row[left]]]
    runs = _runs(ids[row[found]], ties[row[found]], begin[row[found]] + step[found])
    none = [pa.nulls(runs.num_rows, t) for t in (pa.int64(), pa.int32(), pa.binary())]
    names = ["id", "tie", "start", "gram", "part", "packed"]
    yield pa.RecordBatch.from_arrays([*runs.columns, *none], names=names)
    if (blocks == 1).all():
        return
    lone = (blocks > 1)[row]
    lone[left] = False
    one = left[np.r_[True, number[1:] != number[:-1]]] if left.size else left
    one = one[blocks[row[one]] > 1]
    some = np.r_[np.flatnonzero(lone), one]
    out = np.empty(some.size, OPEN)
    r = row[some]
    out["deep"] = window_hashes(gram_hashes(data)[1], window)[first[r] + step[some]]
    out["id"], out["tie"], out["start"], out["alone"] = ids[r], ties[r], begin[r] + step[some], alone[r]
    out["alone"][some.size - one.size :] = False  # its group is known to repeat
    part = (out["deep"] % blocks[r].astype(np.uint64)).astype(np.int32)
    order = np.lexsort((part, gram[r]))
    out, part, key = out[order], part[order], gram[r][order]
    cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
    packed = [out[a:z].tobytes() for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), out.size], strict=True)]
    n = len(packed)
    yield pa.RecordBatch.from_arrays(
        [*(pa.nulls(n, pa.int64()) for _ in range(3)), pa.array(key[cuts]), pa.array(part[cuts]), pa.array(packed, pa.binary())], names=names)


def _united_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs of the windows that several blocks of a first digit have."""
    gram = np.repeat(table["gram"].to_numpy(), [len(x) // OPEN.itemsize for x in table["packed"].to_pylist()])
    rows = np.frombuffer(b"".join(table["packed"].to_pylist()), OPEN)
    order = np.lexsort((rows["deep"], gram))
    left, _ = _split(order, gram[order], rows["deep"][order])
    rows = rows[left][rows["alone"][left]]
    yield _runs(rows["id"], rows["tie"], rows["start"])


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover, half open."""
    starts = np.sort(starts)
    begin, end = starts >> 8, (starts >> 8) + (starts & 0xFF) + window
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return list(zip(begin[new].tolist(), np.r_[reach[new[1:] - 1], reach[-1]].tolist(), strict=True))


def without_repeats(docs: DataFrame, *, window: int = 200, as_text: bool = False, block: int = 1024) -> DataFrame:
    """Every document row with the bytes that no repeated window covers.

    Texts are judged as UTF-8 bytes, on the input; matches never cross documents, and a
    window that repeats inside one document counts too. Null texts are empty; texts
    shorter than a window keep all; repeated rows repeat each other's windows and lose
    them all. A doc_id may be of any type; a null one is an id of its own. A clashing column of ``docs`` is
    replaced; an empty table gives no rows.

    Returns ``docs`` plus n_bytes, n_removed, n_spans long, kept binary; with ``as_text``
    kept is a string, without the bytes of characters that a cut has gone through.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "_id", "_tie", "_starts")
    found = repeated_windows(docs, window=window, block=block).select(
        F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.col("starts").alias("_starts"))
    joined = docs.withColumns({"_id": any_key(docs), "_tie": row_tie()}).join(found, ["_id", "_tie"], "left").select(*docs.columns, "_starts")
    width = len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                for text, starts in zip(as_bytes(part), part.column("_starts"), strict=True):
                    runs = merged(np.array(starts.as_py(), np.int64), window) if starts.is_valid else []
                    left, at = [], 0
                    for a, b in runs:
                        left.append(text[at:a])
                        at = b
                    left.append(text[at:])
                    n_bytes.append(len(text))
                    n_removed.append(sum(b - a for a, b in runs))
                    n_spans.append(len(runs))
                    rest = b"".join(left)
                    kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(width)), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)),
                     pa.array(kept, pa.string() if as_text else pa.binary())],
                    names=[*part.schema.names[:width], "n_bytes", "n_removed", "n_spans", "kept"])

    schema = StructType(docs.schema.fields + StructType.fromDDL(
        f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}").fields)
    return joined.mapInArrow(cut, schema)
