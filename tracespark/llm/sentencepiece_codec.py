"""Op 5: SentencePiece encoding and decoding with a streaming Viterbi lattice."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tracespark.llm.common import byte_chunks, chunks

SPACE = "▁"
#: A character that no piece covers costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: A window holds so many longest pieces.
WIDTH = 4
#: Windows that move side by side.
LANES = 16384
#: Hashing of prefixes.
BASE, SPREAD, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class Codec:
    """Ids of a SentencePiece model, found with bounded memory.

    ``Lattice`` moves a window over the characters of a segment and keeps one state per
    boundary in it: the best last piece and its backpointer. Only the boundaries within
    the longest piece can still be extended; where their backpointer paths run through
    one boundary, the ids before it are final and leave the window, which moves on from
    there.

    ``kind`` "unigram" takes the path of the highest sum of scores. For "bpe" models
    the sum of scores isn't what the model means: a path is admissible if each pair of
    neighbouring pieces is what merging by priority gives for their text, and exactly
    one admissible path reaches each boundary. Characters outside the vocabulary become
    byte pieces (or the unknown piece).

    A piece has spaces only in front, so that a space after another character is a
    boundary that all paths share, and so are both ends of a character that no piece
    has. All segments between such boundaries that are new in a batch move through their
    windows side by side, in arrays; the ids of those that fit into one window are
    remembered (``memory`` segments at most).
    """

    def __init__(self, model: bytes, kind: str = "bpe", memory: int = 400_000):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.processor.get_piece_size()
        plain = [i for i in range(n) if not (
            self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i) or self.processor.is_unused(i))]
        self.ids = {self.processor.id_to_piece(i): i for i in plain}
        self.scores = {p: self.processor.get_score(i) for p, i in self.ids.items()}
        self.worst = min(self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.byte_ids = None
        if any(self.processor.is_byte(i) for i in range(n)):
            self.byte_ids = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.octets = [self._octets(i) for i in range(n)]
        alphabet = {c for p in self.ids for c in p} - {SPACE}
        cut = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        inside = f"[{''.join(map(re.escape, sorted(alphabet)))}]+"
        self.segments = re.compile(f"{SPACE}*{inside}|{SPACE}+|." if cut else f"[{SPACE}{inside[1:]}|.", re.DOTALL).findall
        self.kind, self.memory = kind, memory
        #: Place of a segment among the remembered ones, whose ids lie in ``flat``.
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pieces = [self.processor.id_to_piece(i) for i in range(n)]
        self.split: dict[int, tuple[int, int]] = {}
        self.whole = {p: True for p in self.ids if len(p) == 1}
        if kind == "bpe":
            for piece in sorted(self.ids, key=len):
                if len(piece) > 1:
                    parts = self._merged(piece, stop=2)
                    self.whole[piece] = len(parts) == 2 and all(p in self.ids and self.whole[p] for p in parts)
                    if self.whole[piece]:
                        self.split[self.ids[piece]] = (self.ids[parts[0]], self.ids[parts[1]])
        self.lattice = Lattice(self)

    def _octets(self, i: int) -> bytes:
        if self.processor.is_byte(i):
            return bytes([int(self.processor.id_to_piece(i)[3:5], 16)])
        if self.processor.is_control(i):
            return b""
        if self.processor.is_unknown(i):
            return " ⁇ ".encode()
        return self.processor.id_to_piece(i).replace(SPACE, " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        flat, ends = self.encode_flat(texts)
        return np.split(flat, ends[:-1]) if texts else []

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text's end."""
        split = [self.segments(self.processor.normalize(t)) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        new = set(every) - self.known.keys()
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            self.flat, self.starts, self.sizes = self.flat[:0], self.starts[:0], self.sizes[:0]
            new = set(every)
        if new:
            some = list(new)
            ids, sizes = self.lattice.encode_flat(some)
            n, end = len(self.known), self.flat.size
            self.known.update(zip(some, range(n, n + len(some)), strict=True))
            self.starts = np.r_[self.starts, end + np.cumsum(sizes) - sizes]
            self.sizes, self.flat = np.r_[self.sizes, sizes], np.r_[self.flat, ids]
        place = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        sizes = self.sizes[place]
        stops = np.cumsum(sizes)
        at = np.repeat(self.starts[place] - (stops - sizes), sizes) + np.arange(stops[-1] if stops.size else 0)
        n = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return self.flat[at], np.r_[0, stops][n]

    def decode(self, ids) -> str:
        octets = self.octets
        text = b"".join([octets[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def _merged(self, text: str, stop: int = 1) -> list[str]:
        """The pieces that merging neighbours by priority gives (``stop``: so many at least)."""
        parts = list(text)
        scores = self.scores
        while len(parts) > stop:
            joined = [(-scores[p], k) for k, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in scores]
            if not joined:
                break
            k = min(joined)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _merges_to(self, piece: str) -> bool:
        return len(piece) == 1 or self.whole.get(piece, False)

    def of_character(self, character: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.processor.unk_id()]


class Lattice:
    """The windows of many segments, moved side by side.

    Pieces are found by a walk from every character over the vocabulary's prefixes, kept
    in a table by hash; states are arrays over all characters of all windows.
    """

    def __init__(self, own: Codec):
        self.own = own
        nodes: dict[int, tuple[int, str]] = {}
        for piece in own.ids:
            value = 0
            for k, character in enumerate(piece):
                value = (value * BASE + ord(character) + 1) & MASK
                prefix = piece[: k + 1]
                if nodes.setdefault(value, (-1, prefix))[1] != prefix:
                    raise ValueError("two prefixes of the vocabulary share a hash")
                if k + 1 == len(piece) and own._merges_to(piece) | (own.kind == "unigram"):
                    nodes[value] = (own.ids[piece], prefix)
        self.bits = max(16, (4 * len(nodes)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -2, np.int32)
        for value, (number, _) in nodes.items():
            at = (value * SPREAD & MASK) >> (64 - self.bits)
            while self.values[at] != -2:
                at = (at + 1) % self.keys.size
            self.keys[at], self.values[at] = value, number
        #: Stands for a character that no piece covers.
        self.none = len(own.pieces)
        self.pieces = [*own.pieces, "\0"]
        self.scores = np.array([*(own.scores.get(p, 0.0) for p in own.pieces), own.worst])
        self.window = WIDTH * own.longest
        self.asked = np.full(1 << 21, -1, np.int64)
        self.allowed = np.zeros(1 << 21, bool)

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each hash's piece, -1 for a mere prefix, -2 for neither."""
        at = ((hashes * np.uint64(SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(hashes.size, -2, np.int32)
        left = np.arange(hashes.size)
        while left.size:
            value = self.values[at[left]]
            same = self.keys[at[left]] == hashes[left]
            out[left[same]] = value[same]
            left = left[~same & (value != -2)]
            at[left] = (at[left] + 1) % self.keys.size
        return out

    def encode(self, segments: list[str]) -> list[tuple[int, ...]]:
        ids, sizes = self.encode_flat(segments)
        return [tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])] if segments else []

    def encode_flat(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments behind each other, and the number of each segment's.

        Each round moves every segment's window once. A window that reaches the end of
        its segment commits all ids. Another one commits those before the boundary on
        which its surviving paths converge and moves there; only where they do not yet
        converge, it grows.
        """
        begin, left, reach = ([x] * len(segments) for x in (0, -1, self.window))
        found: list[tuple[np.ndarray, np.ndarray]] = []  # segment and id of each piece, round by round
        active = list(range(len(segments)))
        while active:
            going = []
            for at in range(0, len(active), LANES):
                some = active[at : at + LANES]
                windows = [segments[k][begin[k] : begin[k] + reach[k]] for k in some]
                ends = [begin[k] + reach[k] >= len(segments[k]) for k in some]
                ids, counts, sizes = self.advance(windows, [left[k] for k in some], ends)
                lane = np.repeat(np.arange(len(some)), counts)
                if (ids == self.none).any():
                    lane, ids = self._spelled(lane, ids, windows)
                found.append((np.array(some)[lane], ids))
                last = np.cumsum(counts) - 1
                for i in np.flatnonzero(~np.array(ends)).tolist():
                    k = some[i]
                    if counts[i]:
                        left[k] = int(ids[last[i]])
                        begin[k] += int(sizes[i])
                    reach[k] = self.window if counts[i] else 2 * reach[k]
                    going.append(k)
            active = going
        owner, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 1:  # rounds of one segment follow each other
            order = np.argsort(owner, kind="stable")
            owner, ids = owner[order], ids[order]
        return ids, np.bincount(owner, minlength=len(segments))

    def _spelled(self, lane: np.ndarray, ids: np.ndarray, windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids that stand for characters which no piece covers."""
        out, begun, at = [], -1, 0
        for k, i in zip(lane.tolist(), ids.tolist(), strict=True):
            at = at if k == begun else 0
            begun = k
            out.append(self.own.of_character(windows[k][at]) if i == self.none else [i])
            at += len(self.pieces[i])
        return np.repeat(lane, [len(x) for x in out]), np.array(list(chain.from_iterable(out)), np.int32)

    def advance(self, windows: list[str], left: list[int], ends: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the windows commit: all ids, and each window's number of ids and of
        characters. ``left`` has the last id before the window (-1: none); ``ends``: it
        reaches the segment's end."""
        own = self.own
        points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        stop = np.repeat(first + sizes, sizes)
        begin = np.repeat(first, sizes)
        before = np.repeat(np.array(left, np.int32), sizes)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # last character, order, id
        at = np.arange(points.size)
        value = np.zeros(points.size, np.uint64)
        for k in range(1, own.longest + 1):
            value = value * np.uint64(BASE) + points[at + k - 1] + np.uint64(1)
            number = self._found(value)
            hit = number >= 0
            spots, pieces = at[hit] + k - 1, number[hit]
            if k == 1 and not hit.all():  # characters that are no pieces
                spots, pieces = at, np.where(hit, number, self.none)
            # by the end's place in its window, longer pieces first
            found.append((spots, (spots - begin[spots]) * (own.longest + 1) + own.longest - k, pieces))
            on = (number != -2) & (at + k < stop[at])
            at, value = at[on], value[on]
            if not at.size:
                break
        spots, order, numbers = (np.concatenate(x) for x in zip(*found, strict=True))
        sort = np.argsort(order, kind="stable")
        spots, order, numbers = spots[sort], order[sort], numbers[sort]
        last = np.full(points.size, -1, np.int32)
        back = np.zeros(points.size, np.int64)
        best = np.full(points.size, -np.inf)
        cuts = np.r_[0, np.flatnonzero(order[1:] != order[:-1]) + 1, order.size].tolist()
        for a, z in zip(cuts, cuts[1:]):
            spot, piece = spots[a:z], numbers[a:z]
            k = own.longest - int(order[a]) % (own.longest + 1)
            inner = int(order[a]) // (own.longest + 1) >= k  # there is a boundary in the window before this piece
            if own.kind == "unigram":
                total = self.scores[piece] + (best[spot - k] if inner else 0.0)
                better = total > best[spot]
                spot, piece = spot[better], piece[better]
                best[spot], last[spot], back[spot] = total[better], piece, k
                continue
            free = last[spot] < 0
            spot, piece = spot[free], piece[free]
            if spot.size:
                neighbour = last[spot - k] if inner else before[spot]
                # inside the window -1 is a boundary that no path reaches, before it the segment's start
                good = neighbour >= 0 if inner else np.ones(spot.size, bool)
                asked = np.flatnonzero(neighbour >= 0)
                good[asked] = self._admissible(neighbour[asked], piece[asked])
                spot, piece = spot[good], piece[good]
            last[spot], back[spot] = piece, k
        to = sizes.copy()
        for k in np.flatnonzero(~np.array(ends)).tolist():
            piece = slice(int(first[k]), int(first[k] + sizes[k]))
            to[k] = self._converged(back[piece].tolist(), last[piece].tolist(), int(sizes[k]))
        # All paths are walked back at once, a piece of each a step.
        walked: list[tuple[np.ndarray, np.ndarray]] = []
        lane = np.flatnonzero(to > 0)
        place = first[lane] + to[lane] - 1
        while lane.size:
            walked.append((lane, last[place]))
            place = place - back[place]
            on = place >= first[lane]
            lane, place = lane[on], place[on]
        counts = np.zeros(len(windows), np.int64)
        for lane, _ in walked:
            counts[lane] += 1
        stop = np.cumsum(counts)
        ids = np.empty(int(stop[-1]), np.int32)
        for step, (lane, piece) in enumerate(walked):
            ids[stop[lane] - 1 - step] = piece
        return ids, counts, to

    def _converged(self, steps: list[int], ids: list[int], size: int) -> int:
        """The boundary through which the paths of all boundaries run that can still be extended."""
        alive = {k for k in range(size - self.own.longest + 1, size + 1) if ids[k - 1] >= 0}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - steps[last - 1])
        return alive.pop()

    def _admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging gives these two pieces for their text; answers are kept in a
        table that newer ones overwrite."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(43)).astype(np.int64)
        missing = np.flatnonzero(self.asked[slot] != key)
        out = self.allowed[slot]
        if missing.size:
            unique, inverse = np.unique(key[missing], return_inverse=True)
            answers = np.array([self._pair(k >> 32, k & 0xFFFFFFFF) for k in unique.tolist()], bool)
            out[missing] = answers[inverse]
            self.asked[slot[missing]], self.allowed[slot[missing]] = key[missing], out[missing]
        return out

    def _pair(self, left: int, right: int) -> bool:
        """No merge across the border goes before the merges that made both pieces.

        The latest merge on either side is undone, one after the other; while it is
        undone, the pieces at the border must not make one of an earlier priority.
        """
        own, pieces = self.own, self.pieces
        ids, scores, split = own.ids, own.scores, own.split
        floor = -np.inf  # score of the merge that is undone: an earlier merge has a higher one
        inclusive = False
        while True:
            joined = pieces[left] + pieces[right]
            if joined in ids and (scores[joined] > floor or inclusive and scores[joined] == floor):
                return False
            a = scores[pieces[left]] if left in split else np.inf
            z = scores[pieces[right]] if right in split else np.inf
            if a == z == np.inf:
                return True
            if a < z:  # the left piece was made later
                floor, inclusive = a, False
                left = split[left][1]
            else:
                floor, inclusive = z, True
                right = split[right][0]


_CODECS: dict[tuple, Codec] = {}


def codec(model: bytes, kind: str) -> Codec:
    """The worker's codec, built once for each model."""
    key = (hash(model), kind)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, kind)
    return _CODECS[key]


def encoded(docs: DataFrame, model_file: str, *, kind: str = "bpe", check: bool = True) -> DataFrame:
    """``docs`` plus ids array<int>, n_tokens long and, with ``check``, round_trip boolean.

    Whole texts are encoded; null and empty ones have no ids. ``round_trip`` tells
    whether decoding the ids gives the text (null: the empty text) again: it fails only
    where the model itself loses text, such as for U+2581, which it writes for a space.
    Repeated rows each get their ids; clashing columns are replaced; an empty table
    gives no rows. The model file (0.5 MB) is read by the driver and sent along.
    """
    with open(model_file, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.drop("ids", "n_tokens", "round_trip")
    added = StructType.fromDDL("ids array<int>, n_tokens long" + ", round_trip boolean" * check)
    names = [*docs.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, kind)
        for batch in batches:
            for part in byte_chunks(batch, "text"):
                texts = [x.as_py() or "" for x in part.column("text")]
                ids, ends = own.encode_flat(texts)
                sizes = np.diff(np.r_[0, ends])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids))
                columns = [*part.columns, lists, pa.array(sizes)]
                if check:
                    columns.append(pa.array([own.decode(i.tolist()) == x for i, x in zip(np.split(ids, ends[:-1]), texts, strict=False)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, StructType(docs.schema.fields + added.fields))


def decoded(tokens: DataFrame, model_file: str, *, kind: str = "bpe") -> DataFrame:
    """``tokens`` with the text of its column ids (null: null) as text."""
    with open(model_file, "rb") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(file.read())
    rest = [c for c in tokens.columns if c not in ("text", "ids")]
    tokens = tokens.select(*rest, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, kind)
        for batch in batches:
            for part in chunks(batch, 128):
                texts = [own.decode(x.as_py()) if x.is_valid else None for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(rest))), pa.array(texts, pa.string())], names=[*rest, "text"])

    return tokens.mapInArrow(run, StructType(tokens.schema.fields[:-1] + StructType.fromDDL("text string").fields))
