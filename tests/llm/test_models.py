import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from fixtures import SCHEMA, documents, frame

import corpus_pipeline
from tracespark.llm import queries
from tracespark.llm.multiset_hash import combined, likeness, paired_fingerprints, text_vector, vector
from tracespark.llm.sentencepiece_codec import Codec, decoded, encoded
from tracespark.llm.toxicity import GRAMMAR, TABLE, Grammar, fit, negation, reported_speech, target, toxicity

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codec():
    return Codec(open(MODEL, "rb").read())


def odd_texts():
    rng = random.Random(5)
    letters = "abcdeéñ 日\n▁xyz.,\U0001f600 \t0"
    return [d[1] or "" for d in documents()] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(150)] + [
        "  two  spaces ", "x" * 500 + " " + "ab" * 300, "▁", "\u0000", "def f(x):\r\n\treturn x"]


def test_ids_equal_the_librarys(codec):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    assert [x.tolist() for x in codec.encode_batch(texts)] == own.encode(texts)
    assert [codec.decode(x) for x in own.encode(texts)] == own.decode(own.encode(texts))


def test_windows_of_any_size_give_the_same(codec):
    """Small windows commit where their paths converge, or grow."""
    texts = [*odd_texts()[:80], "internationalization" * 30, "aaaa" * 100 + "bcbc" * 50]
    segments = sorted({s for t in texts if t for s in codec.segments(codec.processor.normalize(t))})
    whole, window = codec.lattice.encode(segments), codec.lattice.window
    try:
        for codec.lattice.window in (codec.longest, codec.longest + 5, 10_000):
            assert codec.lattice.encode(segments) == whole
    finally:
        codec.lattice.window = window


def test_unigram_paths_have_the_best_score():
    own = Codec(open(MODEL, "rb").read(), kind="unigram")
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("theanding") for _ in range(rng.randrange(1, 60)))
        best = [0.0] + [-np.inf] * len(text)
        for z in range(1, len(text) + 1):
            best[z] = max(best[a] + own.scores.get(text[a:z], own.worst) for a in range(z) if text[a:z] in own.ids or z - a == 1)
        for own.lattice.window in (own.longest, 64):
            pieces = [own.pieces[i] for i in own.lattice.encode([text])[0]]
            assert "".join(pieces) == text and abs(sum(own.scores[p] for p in pieces) - best[-1]) < 1e-6


def test_window_stays_bounded(codec):
    """Ids leave the window long before a segment without spaces ends."""
    segment, lengths = "abcdefgh" * 5000, []
    advance = codec.lattice.advance
    codec.lattice.advance = lambda windows, *rest: (lengths.extend(map(len, windows)), advance(windows, *rest))[1]
    try:
        ids = codec.lattice.encode([segment])[0]
    finally:
        del codec.lattice.advance
    assert max(lengths) <= codec.lattice.window and len(lengths) > 500 and codec.decode(ids) == segment


def test_round_trip(spark):
    out = encoded(frame(spark), MODEL)
    rows = out.collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((r.doc_id, len(r.ids)) for r in rows)
    assert all(r.round_trip for r in rows if r.doc_id != 22) and not any(r.round_trip for r in rows if r.doc_id == 22)
    texts = Counter((r.doc_id, r.text) for r in decoded(out.where("doc_id <> 22"), MODEL).collect())
    assert texts == Counter((d[0], d[1] or "") for d in documents() if d[0] not in (22, None))
    assert encoded(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_vectors_add_up():
    a, b = "one two three four\nfive six seven", "eight nine ten eleven"
    both = text_vector(a + "\n" + b)
    assert all((x == y).all() for x, y in zip(combined(text_vector(a), text_vector(b)), both))
    assert all((x == y).all() for x, y in zip(combined(both, text_vector(b), -1), text_vector(a)))
    assert all((x == y).all() for x, y in zip(vector(["p", "q r"]), vector(["q r", "p"])))
    assert likeness(text_vector(a), text_vector(a)) == 1.0 and 0 <= likeness(text_vector(a), text_vector(b)) <= 1
    assert (text_vector("x")[0] != text_vector("x\n")[0]).any()


@pytest.mark.parametrize("range_bytes", [1 << 30, 2000])
def test_edited_texts(spark, range_bytes):
    docs = documents()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    ids = [d[0] for d in order]
    got = paired_fingerprints(frame(spark), range_bytes=range_bytes).collect()
    by = {}
    for k, d in enumerate(order):  # ties of an id follow each other by text
        by.setdefault(d[0], []).append(d[1] or "")
    flat = [(i, t) for i in dict.fromkeys(ids) for t in sorted(by[i])]
    expected = []
    for (i, t), (_, following) in zip(flat, flat[1:] + flat[:1]):
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        expected.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 1
    assert paired_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(got[r.doc_id], r.toxic) for r in labels if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.97
    hit = [r.predicted for r, y in held if y]
    assert sum(hit) / len(hit) > 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity(frame(spark), labels).collect()
    assert len(rows) == len(documents())
    assert toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0
    none = fit(frame(spark), labels.limit(0))
    assert none.arcs == {} and none.score(b"you fool") < 0.5
    long = "they said nothing. " * 200_000 + "you fool"  # matched at the end of 4 MB
    assert Grammar({"fool$": 4.0}).features(long.encode())[1] > 0


def test_composed_transducers():
    """The composition writes what the transducers write one after the other."""
    rng = random.Random(8)
    parts = [negation(), reported_speech(), target()]
    for _ in range(300):
        words = "".join(rng.choice("itanro") for _ in range(rng.randrange(12))) + "."
        expected = words
        for part in parts:
            state, out = part.start, ""
            for symbol in expected:
                state, written = part.step(state, symbol)
                out += written
            expected = out
        state, got = GRAMMAR.start, ""
        for symbol in words:
            state, written = TABLE[state][symbol]
            got += written
        assert got == expected


def test_clauses():
    g = Grammar({"fool$": 4.0})
    clause = lambda t: g.clause(t.encode().split())
    assert clause("you fool") == (True, {"i": 4.0}) and clause("fool me") == (False, {"i": 4.0})
    assert clause("he is not a fool") == (True, {"d": 4.0}) and clause("not one of the many a fool") == (False, {"i": 4.0})
    assert clause("she said fool") == (True, {"q": 4.0}) and clause("i will kill you") == (True, {"t": 1.0})
    assert clause("never kill") == (False, {"D": 1.0}) and clause("he wrote kill") == (True, {"Q": 1.0}) and clause("") == (False, {})
    whole = g.features(b"Nothing here. You fool! Fool; she said: no.")
    assert whole[:4] == pytest.approx([np.log1p(4), np.log1p(4), 0, 0]) and whole[7] == pytest.approx(np.log1p(2))
    assert not any(g.features(b"")) and not any(g.features(b"you said no"))


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, FOLDER).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = [i not in left for i, y in labels.items() if y]
    stay = [i in left for i, y in labels.items() if not y]
    assert sum(gone) / len(gone) > 0.7 and sum(stay) / len(stay) > 0.97


NAMES = ("score _text n_bytes n_removed n_spans kept _id _tie _bytes _starts n_words starts stops items _key row rest part tie"
         " fp root group text_ a").split()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Each stage on the edge cases: clashing columns, nulls, repeated rows, an empty table."""
    rows = [(d[0], d[1], 7, *range(len(NAMES))) for d in documents()]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` int" for n in NAMES)
    docs = spark.createDataFrame(rows, schema).repartition(2)
    folder = str(tmp_path)
    spark.createDataFrame([*((k, 0) for k in range(20)), (21, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        got = out.collect()
        assert got and all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in got)
        ids = Counter(r.doc_id for r in got)
        if name in ("toxicity", "benchmark decontamination"):
            assert ids == Counter(d[0] for d in documents())
        if name.startswith("suffix"):
            assert all(r.n_chars == (7 if r.text is None or (r.doc_id, r.text) in {d[:2] for d in documents()} else len(r.text)) for r in got)
            assert ids[0] == ids[1] == 1 and ids[17] == 0  # nothing is left of one letter's text
        assert stage(spark, docs.limit(0), folder).count() == 0
    last = corpus_pipeline.as_token_ids(spark, docs, folder)
    assert last.columns == [*[c for c in docs.columns if c != "text"], "ids", "n_tokens", "round_trip"]
    assert last.count() == len(rows) and corpus_pipeline.as_token_ids(spark, docs.limit(0), folder).count() == 0


def test_ids_of_other_types(spark):
    from test_operators import windows_hit
    from fixtures import words_of

    from tracespark.llm.decontamination import benchmark_hits
    from tracespark.llm.simhash import first_of_groups

    rows = [(None if d[0] is None else f"a{d[0]}", d[1]) for d in documents()]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = [r.doc_id for r in first_of_groups(docs).collect()]
    assert len(kept) == first_of_groups(frame(spark)).count() and len({"a7", "a8", "a9", "a10"} & set(kept)) == 1
    bench = spark.createDataFrame([(1, documents()[12][1]), (2, "three little words")], "item_id long, text string")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    for size in (100, 1 << 20):
        got = benchmark_hits(docs, bench, block_bytes=size).collect()
        assert Counter((r.doc_id, tuple(r["items"])) for r in got) == Counter(
            (i, tuple(sorted(windows_hit(words_of(t), items)[1]))) for i, t in rows)
    with pytest.raises(TypeError):
        paired_fingerprints(docs)


def test_pipeline_against_its_operators(spark):
    """Each stage is held against the rows that brute force leaves."""
    from test_operators import joined, removed, simhash, windows_hit
    from fixtures import words_of

    from tracespark.llm.common import stored
    from tracespark.llm.toxicity import scored

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], folder), name.replace(" ", "-")))
        if name != "sentencepiece":
            assert out[-1].columns == columns
    rows = [{r.doc_id: r.asDict() for r in df.collect()} for df in out]
    grammar = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(rows[1]) == {r.doc_id for r in scored(docs, grammar).where("score < 0.5").collect()} <= set(rows[0])
    ids = sorted(rows[1])
    texts = [rows[1][i]["text"] for i in ids]
    roots = joined([simhash(t) for t in texts], texts)
    assert set(rows[2]) == {ids[r] for r in roots}
    left = {i: x for i, x in zip(rows[2], removed([r["text"] for r in rows[2].values()]))}
    texts = {i: x[3].decode("utf-8", "ignore") for i, x in left.items() if not x[1] or x[3].decode("utf-8", "ignore").strip(" ")}
    assert {i: r["text"] for i, r in rows[3].items()} == texts and all(r["n_chars"] == len(r["text"]) for r in rows[3].values())
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(rows[4]) == {i for i, t in texts.items() if not windows_hit(words_of(t), items)[0]} < set(rows[3])
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {i: r["ids"] for i, r in rows[5].items()} == {i: own.encode(r["text"]) for i, r in rows[4].items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(rows[5])
