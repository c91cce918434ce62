"""Op 12: collocations by level-wise counts of candidate phrases in double-array tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracespark.llm.common import as_bytes, byte_chunks, cleaned, dropped, stored

#: Byte table: A-Z in lower case, the ends of pieces [.,;:!?\x0A-\x0D] a full stop, tabs a space.
PIECES = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: What stands for the end of a piece; no word can be this one. Its id in a chunk is 0.
BREAK = b"."
#: Language of rows without one.
NO_LANG = "und"
#: Bits of a phrase's hash that number its bucket; bitmaps of frequent phrases have 8 MB, whatever the corpus.
BITS = 26
#: Most bits of the buckets that are counted: 64 MB, for over 10^9 words. Fewer would be heavy by chance.
MOST_BITS = 29
#: Bytes of text in a row of the encoded corpus; a task holds some ten times as much.
CHUNK = 4 << 20
#: Numbers of words that a task holds before it takes them through the tries, about.
WALKED = 1 << 23
#: Candidates that a task holds before it sends them, and those of a part that one task tells apart, about.
HELD, PART = 1 << 19, 1 << 14
IDS = "lang string, words array<binary>, hashes binary, ids binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of about ``CHUNK`` bytes and one language as numbers of their own vocabulary."""
    for batch in batches:
        for part in byte_chunks(batch, "text", CHUNK):
            texts = as_bytes(part)
            rows: dict[str, list[int]] = {}
            for row, lang in enumerate(part.column("lang").to_pylist()):
                rows.setdefault(lang, []).append(row)
            for lang, own in rows.items():
                blob = b".".join([BREAK, *[texts[r] for r in own], b""]).translate(PIECES)
                spaced = pa.array([blob.replace(BREAK, b" . ").strip()], pa.large_binary()).cast(pa.large_string())
                coded = pc.ascii_split_whitespace(spaced).values.cast(pa.binary()).dictionary_encode()
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
                words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), words, pa.array([hashes.tobytes()], pa.binary()), pa.array([coded.indices.to_numpy().astype(np.int32).tobytes()], pa.binary())],
                    names=["lang", "words", "hashes", "ids"])
                pa.default_memory_pool().release_unused()


class Chunk:
    """One row of the encoded corpus."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.lang: str = batch.column("lang")[row].as_py()
        self.words: pa.Array = batch.column("words")[row].values
        self.hashes = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint64)
        self.ids = np.frombuffer(batch.column("ids")[row].as_buffer(), np.int32)

    def first(self) -> np.ndarray:
        """The hash of each word of the vocabulary as a phrase of one word. A phrase's hash
        follows from its language and words alone."""
        return _mixed(self.hashes ^ np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), seed=1)))

    def admissible(self, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a phrase of one word more than ``frequent`` has bitmaps may be
        frequent, and the phrases' buckets."""
        at, run = self.runs(frequent)
        return at, _bucket(run)

    def runs(self, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The positions of ``admissible`` and the phrases' hashes: for every length, all parts
        are in the bitmap of that length. Hashes grow by a word at a time, at the positions left."""
        if not frequent:
            at = np.flatnonzero(self.ids != 0)
            return at, self.first()[self.ids[at]]
        alive = (_has(frequent[0], _bucket(self.first())) & (np.arange(len(self.words)) > 0))[self.ids]
        at = np.flatnonzero(alive[:-1] & alive[1:])
        run = self.first()[self.ids[at]]
        for k in range(2, len(frequent) + 2):
            run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.ids[at + k - 1]])
            if k > len(frequent):
                break
            often = np.flatnonzero(_has(frequent[k - 1], _bucket(run)))
            own = np.flatnonzero(np.diff(at[often]) == 1)
            at, run = at[often[own]], run[often[own]]
        return at, run

    def heavy(self, frequent: list[np.ndarray], heavy: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The phrases of ``runs`` whose bucket in ``heavy`` is set: the words that occur in them,
        a row of these words' numbers for each position, and the hashes."""
        at, run = self.runs(frequent)
        own = _has(heavy, _bucket(run, _bits(heavy)))
        ids = self.ids[at[own][:, None] + np.arange(len(frequent) + 1)]
        used = np.zeros(len(self.words), bool)
        used[ids] = True
        return self.words.take(pa.array(np.flatnonzero(used))), (np.cumsum(used, dtype=np.int32) - 1)[ids], run[own]


def _bucket(run: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (run >> np.uint64(64 - bits)).astype(np.uint32)


def _bits(bitmap: np.ndarray) -> int:
    return len(bitmap).bit_length() + 2


def _bits_for(n_words: int) -> int:
    """Bits of counted buckets for a corpus of so many words: about two positions a bucket, within bounds."""
    return min(max(BITS, int(n_words // 2).bit_length() - 1), MOST_BITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _phrase_buckets(lang: str, phrases: pa.Array) -> np.ndarray:
    """The buckets of phrases of two words or more and one length, as ``Chunk.admissible`` has them."""
    words = pc.split_pattern(phrases.cast(pa.binary()), b" ")
    coded = words.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    ids = coded.indices.to_numpy().reshape(len(phrases), -1)
    run = _mixed(hashes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed=1)))[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + hashes[ids[:, k]])
    return _bucket(run)


def _one_vocabulary(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Rows of words' numbers of several vocabularies as rows of one sorted one."""
    coded = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    numbers = np.split(rank[coded.indices.to_numpy()], np.cumsum([len(words) for words, _ in held])[:-1])
    return coded.dictionary.take(pa.array(order)), np.concatenate([of[ids] for of, (_, ids) in zip(numbers, held)])


def _first_rows(ids: np.ndarray, n_words: int) -> np.ndarray:
    """Places of the different rows, in their order."""
    bits = n_words.bit_length()
    code, filled = ids[:, 0].astype(np.int64), bits
    for column in ids.T[1:]:
        if filled + bits > 63:  # numbers that only equal beginnings share
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            filled = len(code).bit_length()
        code, filled = code << bits | column, filled + bits
    return np.unique(code, return_index=True)[1]


def _packed(data: bytes) -> bytes:
    """Bytes as they travel: what repeats or is small takes little."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(packed: pa.Scalar) -> bytes:
    data = packed.as_buffer()
    return pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd", asbytes=True)


def _has(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Chunk(batch, row)
        pa.default_memory_pool().release_unused()


def _word_counts(encoded: DataFrame, heavy) -> DataFrame:
    """Counts of words in ``heavy`` buckets, and of all words of a language under a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            counts = np.bincount(chunk.ids, minlength=len(chunk.words))
            buckets = _bucket(chunk.first())
            own = np.flatnonzero(_has(heavy.value, buckets) & (np.arange(len(counts)) > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk.lang] * (len(own) + 1)), pa.concat_arrays([chunk.words.take(pa.array(own)).cast(pa.string()), pa.nulls(1, pa.string())]),
                 pa.array(np.append(buckets[own], 0).astype(np.int32)), pa.array(np.append(counts[own], counts[1:].sum()).astype(np.int64))],
                names=["lang", "phrase", "bucket", "f"])

    return encoded.mapInArrow(run, "lang string, phrase string, bucket int, f long")


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The values of ``bucket`` as one bitmap of 2**BITS bits: 8 MB at most reach the driver."""
    whole = np.zeros(1 << BITS - 3, np.uint8)
    with cleaned(rows.sparkSession):
        parts = rows.groupBy(F.shiftright("bucket", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bucket").cast("long") % 32768).alias("bits"))
        for r in parts.collect():
            whole[r.part << 12 : r.part + 1 << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    return whole


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted different keys and their counts as they travel: the steps between keys, and the counts."""
    return _narrow(np.diff(keys.astype(np.uint32), prepend=np.uint32(0))), _narrow(n)


def _narrow(x: np.ndarray) -> bytes:
    size = 2 if x.max() < 1 << 16 else 4
    return _packed(x.astype(f"<u{size}").tobytes() + bytes([size]))


def _numbers(packed: pa.Scalar) -> np.ndarray:
    data = _unpacked(packed)
    return np.frombuffer(data, f"<u{data[-1]}", len(data) // data[-1])


def _added(batches: Iterator[pa.RecordBatch], key: str, size) -> Iterator[tuple[int, np.ndarray]]:
    """Counts that ``_sums`` has packed, added up by ``key``, by which rows are sorted, over
    keys below ``size`` of it."""
    now, sums = None, np.empty(0, np.int64)
    for batch in batches:
        for own, steps, n in zip(batch.column(key).to_pylist(), batch.column("steps"), batch.column("n")):
            if own != now:
                if now is not None:
                    yield now, sums
                now, sums = own, np.zeros(size(own), np.int64)
            sums[np.cumsum(_numbers(steps), dtype=np.int64)] += _numbers(n)
    if now is not None:
        yield now, sums


def _heavy_buckets(encoded: DataFrame, frequent: list, least: int, bits: int = BITS) -> np.ndarray:
    """The bitmap of the 2**bits buckets into which admissible phrases fall ``least`` times or more.

    Tasks send the counts of their buckets by 1,024 ranges, as packed arrays of the steps
    between buckets and of their counts; each range is added up and comes back as bits.
    """
    span = bits - 10

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            buckets, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            parts, begins = np.unique(buckets >> span, return_index=True)
            sent = [_sums(buckets[a:z] & ((1 << span) - 1), n[a:z]) for a, z in zip(begins, [*begins[1:], len(buckets)])]
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), *[pa.array(x, pa.binary()) for x in zip(*sent)]], names=["part", "steps", "n"])

        for chunk in _chunks(batches):
            held.append(_bucket(chunk.runs([f.value for f in frequent])[1], bits))
            if sum(map(len, held)) > 1 << 21:
                yield told()
        if sum(map(len, held)):
            yield told()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sums in _added(batches, "part", lambda part: 1 << span):
            bits_ = np.packbits(sums >= least, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits_.tobytes()], pa.binary())], names=["part", "bits"])

    whole = np.zeros(1 << bits - 3, np.uint8)
    with cleaned(encoded.sparkSession):
        counts = encoded.mapInArrow(counted, "part int, steps binary, n binary")
        for r in counts.repartition("part").sortWithinPartitions("part").mapInArrow(added, "part int, bits binary").collect():
            whole[r.part << span - 3 : r.part + 1 << span - 3] = np.frombuffer(bytes(r.bits), np.uint8)
    return whole


def _candidates(encoded: DataFrame, k: int, frequent: list, heavy) -> DataFrame:
    """Distinct phrases of k words whose parts are frequent and whose bucket is heavy: a
    superset of the frequent ones, since neither test can fail one of them.

    A task sends its phrases by language and range of buckets, sorted and packed; ranges are so narrow
    that the phrases of each, some ``PART``, are told apart at once, whatever the corpus.
    """
    n_parts = max(64, int(np.bitwise_count(heavy.value).sum(dtype=np.int64)) // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray, np.ndarray]]] = {}

        def once() -> int:
            for lang, own in held.items():
                words, ids = _one_vocabulary([x[:2] for x in own])
                first = _first_rows(ids, len(words))
                held[lang] = [(words, ids[first], np.concatenate([x[2] for x in own])[first])]
            return sum(len(own[0][1]) for own in held.values())

        def told() -> Iterator[pa.RecordBatch]:
            for lang, [(words, ids, hashes)] in held.items():
                parts = (_bucket(hashes).astype(np.int64) * n_parts >> BITS).astype(np.int32)
                order = np.argsort(parts, kind="stable")
                there, begins = np.unique(parts[order], return_index=True)
                words = words.cast(pa.string())
                phrases = pc.binary_join_element_wise(*[words.take(pa.array(column)) for column in ids[order].T], " ")
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), phrases)
                joined = pc.binary_join(lists, "\n").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(there), pa.string()), pa.array(there), pa.array([_packed(x) for x in joined], pa.binary())], names=["lang", "part", "phrases"])
            held.clear()

        n = 0
        for chunk in _chunks(batches):
            found = chunk.heavy([f.value for f in frequent], heavy.value)
            if not len(found[1]):
                continue
            held.setdefault(chunk.lang, []).append(found)
            n += len(found[1])
            if n > 4 * HELD:  # copies of one phrase, for the most part
                n = once()
                if n > HELD:
                    yield from told()
                    n = 0
        once()
        yield from told()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told() -> pa.RecordBatch:
            own = pa.concat_arrays(held).unique()
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(own), pa.string()), own, pa.array(_phrase_buckets(key[0], own).astype(np.int32))], names=["lang", "phrase", "bucket"])

        for batch in batches:
            for lang, part, phrases in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist(), batch.column("phrases")):
                if (lang, part) != key:
                    if key is not None:
                        yield told()
                    key, held = (lang, part), []
                held.append(pc.split_pattern(pa.array([_unpacked(phrases)], pa.binary()).cast(pa.string()), "\n").flatten())
                if sum(map(len, held)) > 8 * PART + 2 * len(held[0]):  # the first holds what was told apart before
                    held = [pa.concat_arrays(held).unique()]
        if key is not None:
            yield told()

    sent = encoded.mapInArrow(run, "lang string, part int, phrases binary")
    return sent.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(distinct, "lang string, phrase string, bucket int")


def double_array(paths: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie of distinct paths of one length, sorted, as two arrays.

    Symbols are 1 to ``n_symbols``. State s has the child base[s] + symbol if check of
    that place is s; the root is 1, and 0 is no state's parent. Nodes of several children
    look for a base at the first free places and take new ones if 64 fail; nodes of
    one child fill what is left free. Returns base, check and the last states of the paths.
    """
    size = 2 * (paths.size + n_symbols) + 1024
    base, check, free = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.ones(size, bool)
    free[:2] = False
    end, low = 2, 2

    def grown(most: int) -> None:
        nonlocal base, check, free
        if most > len(free):
            more = 2 * most - len(free)
            base, check, free = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(free, np.ones(more, bool))

    node, states = np.zeros(len(paths), np.int64), np.ones(1, np.int64)
    for symbols in paths.T:
        begins = np.append(True, (node[1:] != node[:-1]) | (symbols[1:] != symbols[:-1]))
        rows = np.flatnonzero(begins)
        parent, symbol = node[rows], symbols[rows].astype(np.int64)
        counts = np.bincount(parent, minlength=len(states))
        starts = np.cumsum(counts) - counts
        place = np.zeros(len(rows), np.int64)
        for p in np.argsort(-counts, kind="stable"):
            if counts[p] < 2:
                break
            own = symbol[starts[p] : starts[p] + counts[p]]
            while not free[low] and low < end:
                low += 1
            tries = np.flatnonzero(free[max(low, own[0]) : max(low, own[0]) + 256])[:64] + max(low, own[0]) - own[0]
            grown(max(int(tries[-1]) if len(tries) else 0, end) + n_symbols + 2)
            fits = np.flatnonzero(free[tries[:, None] + own].all(1)) if len(tries) else []
            if len(fits):
                at = int(tries[fits[0]])
            else:
                at, low = max(end - int(own[0]), 0), low + 1
            base[states[p]] = at
            place[starts[p] : starts[p] + counts[p]] = at + own
            free[at + own] = False
            end = max(end, at + int(own[-1]) + 1)
        lone = np.flatnonzero(counts[parent] == 1)
        open_ = np.flatnonzero(free[n_symbols:end]) + n_symbols if end > n_symbols else np.empty(0, np.int64)
        open_ = np.append(open_, np.arange(max(end, n_symbols), max(end, n_symbols) + max(0, len(lone) - len(open_))))[: len(lone)]
        if len(lone):
            grown(int(open_[-1]) + n_symbols + 2)
            base[states[parent[lone]]] = open_ - symbol[lone]
            place[lone] = open_
            free[open_] = False
            end = max(end, int(open_[-1]) + 1)
        check[place] = states[parent]
        node, states = np.cumsum(begins) - 1, place
    grown(end + n_symbols + 2)
    return base[: end + n_symbols + 1], check[: end + n_symbols + 1], states[node]


TRIE = "block int, vocabulary array<binary>, langs array<string>, radix int, base binary, check binary, last binary"


def _trie(table: pa.Table) -> pa.Table:
    """A block of candidates (block, slot, lang, phrase) as one row: a double-array trie and the last
    states of the candidates by slot. A path is the language and two digits for each
    word: with some hundreds of digits, nodes are narrow and lie close together, where one
    symbol for each of 100,000 words would scatter them."""
    table = table.sort_by("slot")
    langs = sorted(set(table.column("lang").to_pylist()))
    words = pc.split_pattern(table.column("phrase").combine_chunks().cast(pa.binary()), b" ")
    k = len(words[0])
    coded = words.flatten().dictionary_encode()
    paths = np.empty((table.num_rows, 2 * k + 1), np.int32)
    paths[:, 0] = 1 + np.searchsorted(langs, table.column("lang").to_pylist())
    radix = int(len(coded.dictionary) ** 0.5) + 1
    symbols = coded.indices.to_numpy().reshape(-1, k)
    paths[:, 1::2], paths[:, 2::2] = symbols // radix + 1, symbols % radix + 1
    order = np.lexsort(paths.T[::-1])
    base, check, last = double_array(paths[order], max(len(langs), radix))
    by_slot = np.empty(len(last), np.int32)
    by_slot[order] = last
    return pa.Table.from_arrays(
        [table.column("block").slice(0, 1).cast(pa.int32()), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.binary())), pa.array([langs], pa.list_(pa.string())), pa.array([radix], pa.int32()),
         *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (base, check, by_slot)]],
        names=["block", "vocabulary", "langs", "radix", "base", "check", "last"])


def _loaded(shared):
    """A broadcast's value, which a worker lets go of after use where it can read it again."""
    value = shared.value
    if getattr(shared, "_path", None):
        vars(shared).pop("_value", None)
    return value


def _block(run: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of candidates that a phrase of this hash is in."""
    return (_bucket(run).astype(np.int64) * n_blocks >> BITS).astype(np.int32)


def _trie_counts(encoded: DataFrame, k: int, frequent: list, heavy, tries: list, sizes: list[int], least: int) -> DataFrame:
    """The candidates that occur at least ``least`` times, by block and slot, and how often.

    One scan of the texts serves the tries of all blocks. A position's hash names the only block that its
    phrase can be in, so that a position moves through one trie. A task holds positions of about ``WALKED``
    words and takes them through one trie after the other, of which it holds one at a time: all
    positions of a block are in a state at once; each level takes them on by one digit and lets go
    those without a child. One bincount counts the states in which they end, and only the slots that
    occur are sent and added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, pa.Array, np.ndarray, np.ndarray]] = []  # lang, words, numbers of a phrase's words, hashes

        def told() -> Iterator[pa.RecordBatch]:
            names = sorted({lang for lang, *_ in held})
            words, ids = _one_vocabulary([x[1:3] for x in held])
            langs = np.repeat(np.array([names.index(lang) for lang, *_ in held], np.int16), [len(own) for _, _, own, _ in held])
            blocks = _block(np.concatenate([hashes for *_, hashes in held]), len(tries))
            held.clear()
            order = np.argsort(blocks, kind="stable")
            there, begins = np.unique(blocks[order], return_index=True)
            for block, rows in zip(there, np.split(order, begins[1:])):
                if tries[block] is None:
                    continue
                vocabulary, known_langs, radix, base, check, last = _loaded(tries[block])
                known = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int32)
                roots = np.array([base[1] + 1 + known_langs.index(x) if x in known_langs else -1 for x in names], np.int32)
                state = roots[langs[rows]]
                alive = state >= 0
                rows, state = rows[alive], state[alive]
                for j in range(k):
                    symbols = known[ids[rows, j]]  # -1: no word of the block
                    alive = symbols >= 0
                    rows, state, symbols = rows[alive], state[alive], symbols[alive]
                    for digit in (np.floor_divide, np.remainder):
                        child = base[state] + digit(symbols, radix) + 1
                        alive = check[child] == state
                        rows, state, symbols = rows[alive], child[alive], symbols[alive]
                found = np.bincount(state, minlength=len(check))[last]
                some = np.flatnonzero(found)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), *[pa.array([x], pa.binary()) for x in _sums(some, found[some])]], names=["block", "steps", "n"])

        n = 0
        for chunk in _chunks(batches):
            found = chunk.heavy([f.value for f in frequent], heavy.value)
            if not len(found[1]):
                continue
            held.append((chunk.lang, *found))
            n += found[1].size
            if n > WALKED:
                yield from told()
                n = 0
        if held:
            yield from told()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, counts in _added(batches, "block", lambda block: sizes[block]):
            some = np.flatnonzero(counts >= least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), block, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["block", "slot", "f"])

    sent = encoded.mapInArrow(run, "block int, steps binary, n binary")
    return sent.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block int, slot int, f long")


def _frequent(encoded: DataFrame, k: int, frequent: list, least: int, block: int, bits: int = BITS) -> DataFrame | None:
    """Phrases of k words that occur at least ``least`` times: lang, phrase, bucket, f; None without
    candidates. ``frequent`` has the broadcast bitmaps of frequent phrases of 1 to k - 1 words."""
    context = encoded.sparkSession.sparkContext
    heavy = context.broadcast(_heavy_buckets(encoded, frequent, least, bits))
    found = stored(_candidates(encoded, k, frequent, heavy), "phrase-candidates")
    with cleaned(encoded.sparkSession):
        n_blocks = -(-found.count() // block)
    counted = None
    if n_blocks:
        slot = F.row_number().over(Window.partitionBy("block").orderBy("lang", "phrase")) - 1
        own = F.shiftright(F.col("bucket").cast("long") * n_blocks, BITS).cast("int")
        dealt = stored(found.withColumn("block", own).withColumn("slot", slot), "phrase-blocks")
        built = stored(dealt.select("block", "slot", "lang", "phrase").groupBy("block").applyInArrow(_trie, TRIE), "phrase-tries")
        tries, sizes = [None] * n_blocks, [0] * n_blocks
        for b in range(n_blocks):
            trie = built.where(F.col("block") == b).first()
            if trie is not None:
                arrays = [np.frombuffer(bytes(x), np.int32) for x in (trie.base, trie.check, trie.last)]
                tries[b] = context.broadcast((pa.array([bytes(w) for w in trie.vocabulary], pa.binary()), list(trie.langs), trie.radix, *arrays))
                sizes[b] = len(arrays[-1])
        counts = _trie_counts(encoded, k, frequent, heavy, tries, sizes, least)
        counted = stored(dealt.join(counts, ["block", "slot"]).select("lang", "phrase", "bucket", "f"), "phrases")
        for shared in filter(None, tries):
            shared.destroy()
        for table in (dealt, built):
            dropped(table)
    dropped(found)
    heavy.destroy()
    return counted


def phrase_counts(docs: DataFrame, *, longest: int = 4, least: int = 30, block: int = 1 << 19) -> DataFrame:
    """Phrases of one to ``longest`` words and at least ``least`` occurrences within pieces:
    lang, phrase, k, f; and under a null phrase of k = 0 all words of a language.

    Level by level: bitmaps of fixed size over hashed phrases, one for each length, admit phrases
    whose parts are frequent; a further one, whose hashed bucket is frequent. All let every frequent
    phrase through. The distinct phrases that pass are cut into blocks of about ``block`` candidates,
    and the blocks' double-array tries, each broadcast by itself, count them in one scan of the texts.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    encoded = stored(plain.mapInArrow(_encoded, IDS), "phrase-ids")
    heavy = spark.sparkContext.broadcast(_heavy_buckets(encoded, [], least))
    words = _word_counts(encoded, heavy).groupBy("lang", "phrase", "bucket").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())
    words = stored(words, "phrases")
    heavy.destroy()
    levels = [words.withColumn("k", F.col("phrase").isNotNull().cast("int"))]
    shorter, frequent = words.where("phrase is not null"), []
    with cleaned(spark):
        bits = _bits_for(words.where("phrase is null").agg(F.sum("f")).first()[0] or 0)
    for k in range(2, longest + 1):
        frequent.append(spark.sparkContext.broadcast(_bitmap(shorter)))
        shorter = _frequent(encoded, k, frequent, least, block, bits)
        if shorter is None:
            break
        levels.append(shorter.withColumn("k", F.lit(k)))
    for bitmap in frequent:
        bitmap.destroy()
    dropped(encoded)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole.select("lang", "phrase", "k", "f")


def collocations(
    docs: DataFrame, *, longest: int = 4, least: int = 30, top: int = 2000, share: int = 80, block: int = 1 << 19,
) -> DataFrame:
    """The ``top`` phrases of each language whose parts come together most.

    A candidate of a = f(phrase) >= ``least`` is cut behind each word into parts that occur l
    and r times; its score is the least floor(2000000 a / (l + r)), of equal ones the first
    cut's. Candidates inside a longer candidate that has ``share`` percent of their
    occurrences or more are dropped. Products are exact decimals.

    Null texts are empty and rows without a language are ``und``; repeated rows count each;
    equal scores are ranked by a, then by the phrase's bytes; texts of any length are whole (a
    long one is a chunk by itself); an empty table gives no rows; other columns are ignored.

    Returns lang, rank, phrase, a, l, r, n, score.
    """
    counts = phrase_counts(docs, longest=longest, least=least, block=block)
    own = counts.where("k > 0").select("lang", "phrase", "f")
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "k", "words", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("left_part"),
        F.expr("array_join(slice(words, cut + 1, k - cut), ' ')").alias("right_part"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(20,0))").cast("long")
    scored = (
        cuts.join(own.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l")), ["lang", "left_part"])
        .join(own.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r")), ["lang", "right_part"])
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    inner = candidates.where("k > 2").select("lang", "a", "k", "words", F.explode(F.expr("sequence(2, k - 1)")).alias("size")).select(
        "lang", "a", "words", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at")).select(
        "lang", F.expr("array_join(slice(words, at, size), ' ')").alias("phrase"), F.col("a").alias("longer"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(
        f"longer is null or cast(100 as decimal(3,0)) * cast(longer as decimal(19,0)) < cast({share} as decimal(3,0)) * cast(a as decimal(19,0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
