"""Op 7: toxicity by a weighted grammar of composed finite-state transducers over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespark.llm.common import WORD_TABLE, as_bytes, chunks, dropped, row_tie, stored

#: The closed word classes of the grammar (en, de, fr, es).
THREATS = frozenset("""kill hurt beat stab shoot strangle destroy burn smash crush punch hunt bury choke drown slap murder
töte töten schlage schlagen erschlage erwürge würgen verbrenne vernichte verprügle prügeln erschießen
tuer tuerai frapper brûler étrangler écraser cogner poignarder massacrer
matar mataré golpear golpearé quemar quemaré apuñalar aplastar estrangular disparar destruir""".encode().split())
INTENTS = frozenset("""will shall gonna going ll want must should werde wirst wird werden will soll muss vais vas va allons veux dois
voy vas va vamos quiero debo""".encode().split())
COPULAS = frozenset("""are is re am were was be bist ist sind seid warst war es est êtes sommes sont étais était
eres son está estás fue sois""".encode().split())
TARGETS = frozenset("you your yours yourself he she they them him her du dich dir dein ihr euch tu te toi vous ton tes usted ustedes ti te tú".encode().split())
NEGATIONS = frozenset("not never no nobody neither nor nicht kein keine nie jamais aucun nunca ningún jamás".encode().split())
REPORTS = frozenset("said says say called calls wrote writes quoted claimed told sagte sagt nannte schrieb dit disait écrit dijo dice llamó escribió".encode().split())

CLAUSE = re.compile(rb"[.,;:!?\n]+").split
#: Stems are the first letters of a word, of these lengths.
STEMS = (4, 5, 6, 7)
#: A negation works on the next so many words.
REACH = 3

#: Symbols that the lexicon gives for words: insult, threat, target, negation, report, other, intent, copula.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, INTENT, COPULA = "itanrowc"
#: Symbols of rewritten insults and threats: denied, quoted.
DENIED = {INSULT: "d", THREAT: "D"}
QUOTED = {INSULT: "q", THREAT: "Q"}
#: Ends a clause. The insult transducer writes SAID for a clause that says an insult of someone, the
#: threat transducer MEANT, or BOTH after SAID, for one that announces a threat.
STOP, SAID, MEANT, BOTH = ".", ":", ";", "!"
#: What comes out at the end: whether the clause is aimed at someone, and the same with SAID, MEANT and BOTH.
AIMED, UNAIMED = "A", "U"
ENDS = {STOP: (AIMED, UNAIMED), SAID: ("A:", "U:"), MEANT: ("A;", "U;"), BOTH: ("A!", "U!")}
AIMED_ENDS = frozenset(aimed for aimed, _ in ENDS.values())
SAID_ENDS, MEANT_ENDS = (frozenset((*ENDS[x], *ENDS[BOTH])) for x in (SAID, MEANT))
MARKS = (INSULT, THREAT, *DENIED.values(), *QUOTED.values())

FIXED = {**{w: INTENT for w in INTENTS}, **{w: COPULA for w in COPULAS}, **{w: TARGET for w in TARGETS}, **{w: THREAT for w in THREATS},
         **{w: REPORT for w in REPORTS}, **{w: NEGATION for w in NEGATIONS}}


class Transducer:
    """A deterministic finite-state transducer: (state, symbol) to (next state, output).

    Symbols without an arc are copied and go to the state that ``idle`` gives.
    """

    def __init__(self, start, arcs: dict, idle=lambda state: state):
        self.start, self.arcs, self.idle = start, arcs, idle

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or (self.idle(state), symbol)

    def then(self, other: "Transducer", symbols: str) -> "Transducer":
        """The composition: ``other`` reads what this one writes. Only reachable states."""
        start, arcs = (self.start, other.start), {}
        states = [start]
        for state in states:
            for symbol in symbols:
                own, written = self.step(state[0], symbol)
                next_, out = other.step(state[1], written)
                arcs[state, symbol] = (own, next_), out
                if (own, next_) not in states:
                    states.append((own, next_))
        return Transducer(start, arcs)


def insult() -> Transducer:
    """Marks the end of a clause in which an insult follows a target and a copula within
    ``REACH`` words ("you are such a ..."); a negation in between undoes it.

    States: (words left, whether said), with -1 for right behind a target.
    """
    arcs = {}
    for said in (0, 1):
        for left in range(-1, REACH + 1):
            arcs[(left, said), TARGET] = (-1, said), TARGET
            arcs[(left, said), COPULA] = (REACH if left == -1 else max(0, left - 1), said), OTHER
            arcs[(left, said), NEGATION] = (0, said), NEGATION
            arcs[(left, said), INSULT] = (max(0, left - 1), 1 if left > 0 else said), INSULT
            arcs[(left, said), STOP] = (0, 0), SAID if said else STOP
    return Transducer((0, 0), arcs, idle=lambda state: (max(0, state[0] - 1), state[1]))


def threat() -> Transducer:
    """Marks the end of a clause in which a threat follows an intent within ``REACH`` words
    ("will ... hurt"); a negation in between undoes it. States: (words left, whether meant)."""
    arcs = {}
    for meant in (0, 1):
        for left in range(REACH + 1):
            arcs[(left, meant), INTENT] = (REACH, meant), OTHER
            arcs[(left, meant), NEGATION] = (0, meant), NEGATION
            arcs[(left, meant), THREAT] = (max(0, left - 1), 1 if left else meant), THREAT
            arcs[(left, meant), STOP] = (0, 0), MEANT if meant else STOP
            arcs[(left, meant), SAID] = (0, 0), BOTH if meant else SAID
    return Transducer((0, 0), arcs, idle=lambda state: (max(0, state[0] - 1), state[1]))


def negation() -> Transducer:
    """Insults and threats within ``REACH`` words of a negation come out as denied."""
    arcs = {}
    for left in range(REACH + 1):
        arcs[left, NEGATION] = REACH, OTHER
        if left:
            arcs |= {(left, x): (left - 1, y) for x, y in DENIED.items()}
    return Transducer(0, arcs, idle=lambda left: max(0, left - 1))


def reported_speech() -> Transducer:
    """Insults and threats behind a verb of saying come out as quoted."""
    arcs = {(k, REPORT): (1, OTHER) for k in (0, 1)} | {(1, x): (1, y) for x, y in QUOTED.items()}
    return Transducer(0, arcs)


def target() -> Transducer:
    """The clause's end comes out as aimed or unaimed: whether someone is meant."""
    arcs = {(k, TARGET): (1, OTHER) for k in (0, 1)} | {(k, end): (0, out[1 - k]) for k in (0, 1) for end, out in ENDS.items()}
    return Transducer(0, arcs)


WORDS = INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER + INTENT + COPULA + STOP
PARTS = (insult, threat, negation, reported_speech, target)
#: The composed grammar as a table: for each state, symbol to (state, output).
GRAMMAR = reduce(lambda a, z: a.then(z(), WORDS), PARTS[1:], insult())
TABLE: dict = {}
for (_state, _symbol), _arc in GRAMMAR.arcs.items():
    TABLE.setdefault(_state, {})[_symbol] = _arc
FEATURES = 11


@dataclass
class Grammar:
    """A weighted grammar of toxic clauses.

    The arcs of insults, words and stems, carry weights learned from labels; those of threats
    weigh 1, or more where labels teach it. The transducers of insults, threats, negation,
    reported speech and targets are composed to one (``GRAMMAR``). A clause runs through
    the composition; its path collects the weights of what comes out, by mark, by the
    clause's aim, and by whether its end says an insult of someone or announces a threat. A clause that no mark comes out of doesn't match. A document's score is
    the logistic of weights times what its matched clauses collect.
    """

    arcs: dict[str, float]
    mean: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    #: As long as no labels teach others, texts are not toxic.
    weights: list[float] = field(default_factory=lambda: [-3.0] + [0.0] * FEATURES)

    def __post_init__(self):
        self._known: dict[bytes, tuple[str, float]] = {}

    def read(self, word: bytes) -> tuple[str, float]:
        """The word's symbol and arc weight."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            weight = max((self.arcs.get(t, 0.0) for t in terms(word)), default=0.0)
            symbol = FIXED.get(word) or (INSULT if weight else OTHER)
            known = self._known[word] = symbol, weight if symbol == INSULT else max(1.0, weight) if symbol == THREAT else 1.0
        return known

    def clause(self, words: list[bytes]) -> tuple[bool, dict[str, float]]:
        """Whether a clause is aimed at someone, and the weights that its path collects by mark."""
        end, found = self.path(words)
        return end in AIMED_ENDS, found

    def path(self, words: list[bytes]) -> tuple[str, dict[str, float]]:
        """What comes out at a clause's end, and the weights that its path collects by mark."""
        state, found = GRAMMAR.start, {}
        read = self.read
        for word in words:
            symbol, weight = read(word)
            state, out = TABLE[state][symbol]
            if out in MARKS:
                found[out] = found.get(out, 0.0) + weight
        return TABLE[state][STOP][1], found

    def features(self, text: bytes) -> list[float]:
        """What the matched clauses of a text collect."""
        read = self.read
        marked = {w for w in set(text.translate(WORD_TABLE).split()) if read(w)[0] in (INSULT, THREAT)}
        if not marked:
            return [0.0] * FEATURES
        plain = aimed_ = denied = quoted = threat = idle = most = said = meant = 0.0
        n = matched = 0
        for part in CLAUSE(text):
            words = part.translate(WORD_TABLE).split()
            n += bool(words)
            if marked.isdisjoint(words):
                continue
            end, found = self.path(words)
            aimed = end in AIMED_ENDS
            matched += 1
            said += found.get(INSULT, 0.0) if end in SAID_ENDS else 0.0
            meant += found.get(THREAT, 0.0) if end in MEANT_ENDS else 0.0
            insult = found.get(INSULT, 0.0)
            if aimed:
                aimed_ += insult
                threat += found.get(THREAT, 0.0)
            else:
                plain += insult
                idle += found.get(THREAT, 0.0)
            denied += found.get("d", 0.0) + found.get("D", 0.0)
            quoted += found.get("q", 0.0) + found.get("Q", 0.0)
            most = max(most, insult + (found.get(THREAT, 0.0) if aimed else 0.0))
        return [math.log1p(x) for x in (plain, aimed_, denied, quoted, threat, idle, most, matched, 100 * matched / n, said, meant)]

    def score(self, text: bytes) -> float:
        x = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def terms(word: bytes) -> list[str]:
    """The word (ends with $) and its stems."""
    text = word.decode("utf-8", "replace")
    return [text + "$", *(text[:k] for k in STEMS if len(text) > k)]


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents, by the crc32 of the id: no label of theirs is read."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _chosen(counts: dict[str, tuple[int, int]], toxic: int, clean: int, support: int, surprise: float) -> dict[str, float]:
    arcs = {}
    for term, (n1, n0) in counts.items():
        odds = math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))
        if n1 >= support and odds >= 2 and odds / math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)) >= surprise:
            arcs[term] = min(odds, 6.0)
    return arcs


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000, support: int = 5, surprise: float = 3.5) -> Grammar:
    """The grammar that the labels of training documents give.

    At most ``train_rows`` different texts of labelled documents outside the held-out fifth are
    read, those of the smallest hashes of id and text: the sample's bound, whatever the corpus and
    however often an id or a row occurs. Repeated rows count once. Words and stems
    are counted by Spark; those whose odds of a toxic document are clearly raised get
    an insult arc. The weights of the registers are fitted (logistic, by Newton steps)
    on one half of the sample with arcs from the other, so that arcs that fit their
    own documents too well don't mislead them; the arcs are then taken from both.
    Without labelled documents of both kinds, every score is that of no match, below 0.5.
    """
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("_toxic"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    key = docs.select("doc_id", row_tie().alias("_tie"), F.col("text").cast("binary").alias("text"))
    # The texts to read are chosen by keys alone: one id may have any number of rows.
    chosen = stored(key.select("doc_id", "_tie").join(F.broadcast(sample), "doc_id").distinct().orderBy(
        F.xxhash64("doc_id", "_tie"), "doc_id", "_tie").limit(train_rows), "toxic-keys")
    read = stored(
        key.join(F.broadcast(chosen), ["doc_id", "_tie"]).groupBy("doc_id", "_tie", "_toxic").agg(F.first("text").alias("text"))
        .select((F.col("_toxic") * 2 + F.pmod(F.hash("doc_id"), F.lit(2))).alias("part"), "text"), "toxic-sample")
    dropped(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter[str]] = [Counter() for _ in range(4)]
        for batch in batches:
            for chunk in chunks(batch):
                for part, text in zip(chunk.column(0).to_pylist(), chunk.column(1), strict=True):
                    words = set((text.as_py() or b"").translate(WORD_TABLE).split())
                    found[part].update({t for w in words for t in terms(w)})
                    found[part][""] += 1  # the documents themselves
        every = list({t for c in found for t in c})
        for at in range(0, len(every), 50_000):
            some = every[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *(pa.array([c[t] for t in some], pa.int64()) for c in found)], names=["term", "c0", "c1", "t0", "t1"])

    sums = read.mapInArrow(count, "term string, c0 long, c1 long, t0 long, t1 long").groupBy("term").agg(
        *[F.sum(c).alias(c) for c in ("c0", "c1", "t0", "t1")])
    # Rarer terms can't become arcs in either half or in both.
    rows = {r.term: r for r in sums.where(F.col("t0") + F.col("t1") >= support).where(
        "term = '' or (t0 + t1) * 3 > (c0 + c1)").collect()}
    total = rows.pop("", None)
    if total is None or min(total.t0 + total.t1, total.c0 + total.c1) == 0:
        dropped(read)
        return Grammar({})
    half = max(2, support // 2)
    first = Grammar(_chosen({t: (r.t0, r.c0) for t, r in rows.items()}, total.t0, total.c0, half, surprise))
    both = Grammar(_chosen({t: (r.t0 + r.t1, r.c0 + r.c1) for t, r in rows.items()},
                           total.t0 + total.t1, total.c0 + total.c1, support, surprise))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                x = [first.features(t.as_py() or b"") for t in chunk.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), pa.array(x, pa.list_(pa.float64()))], names=["part", "x"])

    fitted = read.where("part in (1, 3)").mapInArrow(measure, "part int, x array<double>").collect()
    dropped(read)
    y = np.array([float(r.part == 3) for r in fitted])
    x = np.array([r.x for r in fitted]).reshape(len(fitted), FEATURES)
    if 0 < y.sum() < y.size:
        both.mean, scale = x.mean(0).tolist(), x.std(0)
        both.scale = np.where(scale > 0, scale, 1).tolist()
        both.weights = _logistic((x - both.mean) / both.scale, y).tolist()
    return both


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` plus score double (0 to 1).

    Null and empty texts have the score of no match; repeated rows each get theirs; a
    clashing column score is replaced; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop("score")
    arcs, mean, scale, weights = grammar.arcs, grammar.mean, grammar.scale, grammar.weights
    shared = docs.sparkSession.sparkContext.broadcast((arcs, mean, scale, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value)
        for batch in batches:
            for part in chunks(batch):
                scores = [own.score(x) for x in as_bytes(part)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1: a score of 0.5 or more) of every row.

    Null and empty texts match nothing and have the score of no match; whole texts of any
    length are read clause by clause; repeated rows each get a row; a null doc_id is
    held out or not as the empty string is. Of repeated labels the highest counts; labels
    without a document or a value don't. Other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    grammar = fit(docs, labels, **options)
    return scored(docs.select("doc_id", "text"), grammar).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
