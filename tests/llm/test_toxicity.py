"""The toxicity grammar against its transducers run one after the other, and its bounded sample."""

import math
import random
import re

import numpy as np
import pytest
from fixtures import words_of

from tracespark.llm.toxicity import (
    AIMED_ENDS, COPULAS, INTENTS, NEGATIONS, PARTS, REPORTS, TARGETS, THREATS, Grammar, fit, scored, terms,
)


def slow_features(grammar, text):
    """Every clause through the five transducers, each reading what the one before has written."""
    sums = dict.fromkeys(("plain", "aimed", "denied", "quoted", "threat", "idle", "most", "said", "meant"), 0.0)
    n = matched = 0
    for part in re.split(r"[.,;:!?\n]+", text):
        words = words_of(part)
        if not words:
            continue
        n += 1
        symbols, weights = [], []
        for word in words:
            weight = max((grammar.arcs.get(t, 0.0) for t in terms(word.encode())), default=0.0)
            kinds = ((THREATS, "t"), (NEGATIONS, "n"), (REPORTS, "r"), (TARGETS, "a"), (COPULAS, "c"), (INTENTS, "w"))
            symbol = next((x for known, x in sorted(kinds, key=lambda k: "nrtacw".index(k[1])) if word.encode() in known), "i" if weight else "o")
            symbols.append(symbol)
            weights.append(weight if symbol == "i" else max(1.0, weight) if symbol == "t" else 1.0)
        if not {"i", "t"} & set(symbols):
            continue
        matched += 1
        written = [*symbols, "."]
        for part_ in PARTS:
            machine, out = part_(), []
            state = machine.start
            for symbol in written:
                state, w = machine.step(state, symbol)
                out.append(w)
            written = out
        own = lambda marks: sum(w for s, w in zip(written, weights) if s in marks)  # noqa: B023, E731
        end = written[-1]
        aimed = end in AIMED_ENDS
        sums["aimed" if aimed else "plain"] += own("i")
        sums["threat" if aimed else "idle"] += own("t")
        sums["denied"] += own("dD")
        sums["quoted"] += own("qQ")
        sums["said"] += own("i") if end[1:] in (":", "!") and end[1:] else 0
        sums["meant"] += own("t") if end[1:] in (";", "!") and end[1:] else 0
        sums["most"] = max(sums["most"], own("i") + (own("t") if aimed else 0))
    values = [sums[k] for k in ("plain", "aimed", "denied", "quoted", "threat", "idle", "most")] + [
        matched, 100 * matched / n if n else 0, sums["said"], sums["meant"]]
    return [math.log1p(x) for x in values] if matched else [0.0] * 11


def texts(n=400):
    rng = random.Random(12)
    pool = "you are such a fool not never said i will hurt kill them he is idiotic table chair , . ! and of ich werde töte dich bist FOOL foolish wrote".split()
    return [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " . ! ", "You are a fool", "\n"]


def test_scores_equal_the_transducers_one_by_one(spark):
    grammar = Grammar({"fool$": 4.0, "fool": 1.5, "idiot": 2.5, "hurt$": 3.0}, weights=[-1.0, *[0.3 * (k % 4) for k in range(11)]])
    own = texts()
    for text in own:
        assert grammar.features(text.encode()) == pytest.approx(slow_features(grammar, text))
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(4)
    for r in scored(docs, grammar).collect():
        x = (np.array(slow_features(grammar, own[r.doc_id])) - grammar.mean[0]) if own[r.doc_id] is not None else np.zeros(11)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(grammar.weights[0] + float(x @ np.array(grammar.weights[1:]))))))


def test_insults_said_of_someone_and_threats_that_are_meant():
    grammar = Grammar({"fool$": 4.0})
    end = lambda t: grammar.path(t.encode().split())[0]
    assert end("you are such a fool") == "A:" and end("you fool") == "A" and end("you are not a fool") == "A"
    assert end("i will really hurt you") == "A;" and end("i will never hurt you") == "A" and end("will kill") == "U;"
    assert end("you are a fool and i will kill you") == "A!" and end("a fool") == "U" and end("") == "U"


def test_the_sample_is_bounded_for_a_hot_id(spark):
    """A third of the rows under one labelled id, equal and different ones."""
    rows = [(1, f"clean words number {k}") for k in range(900)] + [(1, "the same row")] * 900
    rows += [(k, "you are a wretch" if k % 2 else "a quiet table") for k in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(1, 0), *((k, k % 2) for k in range(2, 400))], "doc_id long, toxic int")
    read = []
    from tracespark.llm import toxicity as module

    keep = module.stored
    module.stored = lambda df, name: read.append((name, keep(df, name))) or read[-1][1]
    counts = {}
    drop = module.dropped
    module.dropped = lambda df: counts.update({name: df.count() for name, d in read if d is df}) or drop(df)
    try:
        grammar = fit(docs, labels, train_rows=100)
    finally:
        module.stored, module.dropped = keep, drop
    assert counts == {"toxic-keys": 100, "toxic-sample": 100} and grammar.score(b"you are a wretch") >= 0
    whole = fit(docs, labels)
    assert whole.score(b"you are a wretch") > 0.5 > whole.score(b"a quiet table")
