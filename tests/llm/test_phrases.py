import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import ascii_lower, bag, documents

from tracespark.llm.collocations import BITS, collocations, double_array, phrase_counts


def slow(rows, longest=4, least=30, top=2000, share=80):
    """Rows of (lang, text): the operator's rows by plain loops."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in chosen.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        kept = []
        for p, a in chosen.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * covered[p] < share * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


def edges():
    rng = random.Random(3)
    words = "new york city a of the in Zug Äpfel x | 漢字 y".split()
    rows = []
    for k in range(150):
        text = "".join(rng.choice(words) + rng.choice("  \t \n.,") for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    rows += [("en", "New York City"), ("en", "a a a a a a"), ("en", None), (None, ""), ("de", ". , ;"), ("en", "New\x0bYork\x0cCity\rNew\tYork")]
    rows += [("xx", "one phrase of four words here now ") for _ in range(31)] + [("yy", "b b " * 2000)]
    return rows + [("f", d[1]) for d in documents()]


@pytest.mark.parametrize("block", [1 << 19, 7])
def test_phrases_equal_plain_loops(spark, block):
    rows = edges()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    least, top = (3, 2000) if block == 1 << 19 else (30, 5)
    got = collocations(docs, least=least, top=top, block=block).collect()
    assert bag(got) == bag(slow(rows, least=least, top=top))
    assert [c for c in collocations(docs.limit(0)).collect()] == []


def test_exact_above_64_bits(spark):
    """Products of counts beyond 2**63 stay exact: the score's expression alone."""
    got = spark.sql("SELECT (cast(2000000 as decimal(7,0)) * cast(9007199254740993 as decimal(19,0))) div cast(18014398509481987 as decimal(20,0)) AS s").first().s
    assert got == 2000000 * 9007199254740993 // 18014398509481987


def test_hot_language_and_phrase(spark):
    """Two thirds of the rows hold one phrase, and most are of one language."""
    rows = [("en", "the same phrase everywhere")] * 600 + [("en", f"word{k % 9} word{k % 7} other") for k in range(250)] + [("fr", "the same phrase everywhere")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    assert bag(collocations(docs).collect()) == bag(slow(rows))
    found = {(r.lang, r.phrase): r.f for r in phrase_counts(docs).collect()}
    assert found["en", "same phrase"] == 600 and found["fr", None] == 160


def test_double_array():
    rng = np.random.default_rng(1)
    for symbols, n, depth in ((5, 200, 4), (1000, 3000, 3), (3, 1, 2), (50_000, 20_000, 2)):
        paths = np.unique(rng.integers(1, symbols + 1, (n, depth)) ** 2 // symbols + 1, axis=0).clip(1, symbols).astype(np.int32)
        paths = np.unique(paths, axis=0)
        base, check, last = double_array(paths, symbols)
        assert len(set(last.tolist())) == len(paths)
        known = set(map(tuple, paths.tolist()))
        asked = np.concatenate([paths, rng.integers(1, symbols + 1, (n, depth))])
        for path in asked.tolist()[:4000]:
            state = 1
            for symbol in path:
                child = int(base[state]) + symbol
                if check[child] != state:
                    state = None
                    break
                state = child
            assert (state is not None) == (tuple(path) in known)


def test_columns_of_any_name(spark):
    rows = [("en", "two words " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as f", "3 as ids", "4 as slot", "5 as n", "6 as block")
    assert bag(collocations(docs).collect()) == bag(slow(rows))
    numbers = spark.createDataFrame([(7, "two words " * 40)], "lang int, text string")
    assert {r.lang for r in collocations(numbers).collect()} == {"7"}
    assert BITS == 26


def test_phrases_are_hashed_only_where_all_their_parts_are_frequent():
    """A position is left out as soon as a part of any length is not in its bitmap."""
    import numpy as np
    import pyarrow as pa

    from tracespark.llm.collocations import Chunk, _bucket, _encoded

    texts = pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "text": ["a b c d x a b c d", "b c\td. a b, c d a b c d"]})
    chunk = Chunk(next(_encoded(iter([texts]))), 0)
    words = [w.decode() for w in chunk.words.to_pylist()]
    line = [words[i] for i in chunk.ids]

    def bitmap(k, phrases):
        every = [np.full(1 << BITS - 3, 255, np.uint8)] * (k - 1)
        at, buckets = chunk.admissible(every) if k > 1 else (np.arange(len(line)), _bucket(chunk.first()[chunk.ids]))
        chosen = [b for i, b in zip(at, buckets) if " ".join(line[i : i + k]) in phrases]
        bits = np.zeros(1 << BITS, bool)
        bits[chosen] = True
        return np.packbits(bits, bitorder="little")

    frequent = [bitmap(1, {"a", "b", "c", "d"}), bitmap(2, {"a b", "b c", "c d"}), bitmap(3, {"a b c", "b c d"})]
    found = lambda n: [" ".join(line[i : i + n + 1]) for i in chunk.admissible(frequent[:n])[0]]
    assert sorted(found(1)) == ["a b"] * 4 + ["b c"] * 4 + ["c d"] * 5 + ["d a"] and "d x" not in found(1)
    assert sorted(found(2)) == ["a b c"] * 3 + ["b c d"] * 4
    assert found(3) == ["a b c d"] * 3
    frequent[1] = bitmap(2, {"a b", "b c"})  # the triple b c d is let through, its pair c d is not
    assert found(3) == []


def test_counts_leave_no_shuffle_files_and_candidates_travel_packed(spark, monkeypatch):
    """Bitmaps, tries and counts that reach the driver leave no shuffle files; phrases come once each."""
    import time
    from pathlib import Path

    import pyarrow as pa

    from tracespark.llm import collocations as op

    there = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before = there()
    rows = [(lang, " ".join(f"w{(k * j) % 7}" for j in range(12))) for k in range(300) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    phrase_counts(docs)
    for _ in range(100):
        if not there() - before:
            break
        time.sleep(0.1)
    assert not there() - before
    monkeypatch.setattr(op, "HELD", 50)  # tasks send what they have before they end
    encoded = docs.repartition(6).mapInArrow(op._encoded, op.IDS).persist()
    every = spark.sparkContext.broadcast(np.full(1 << BITS - 3, 255, np.uint8))
    got = [tuple(r) for r in op._candidates(encoded, 3, [every, every], every).collect()]
    plain = {(lang, " ".join(words[i : i + 3])) for lang, text in rows for words in [text.split()] for i in range(len(words) - 2)}
    assert len(got) == len(plain) and {r[:2] for r in got} == plain
    chunk = op.Chunk(next(op._encoded(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": [rows[10][1]]})]))), 0)
    at, buckets = chunk.admissible([every.value] * 2)
    own = [" ".join(chunk.words[chunk.ids[i + j]].as_py().decode() for j in range(3)) for i in at]
    assert op._phrase_buckets("en", pa.array(own)).tolist() == buckets.tolist()
    assert {(p, b) for lang, p, b in got if lang == "en"} >= set(zip(own, buckets.tolist()))
    encoded.unpersist()


def test_one_scan_of_the_texts_counts_the_candidates_of_all_blocks(spark, monkeypatch):
    """Scans don't grow with the blocks of candidates; a task sends only the counts that it has, before it ends too."""
    from tracespark.llm import collocations as op

    rng = random.Random(11)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice("abcdefgh") for _ in range(60))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    scans, plain = [], op._trie_counts
    monkeypatch.setattr(op, "_trie_counts", lambda *a: scans.append(len(a[4])) or plain(*a))
    monkeypatch.setattr(op, "WALKED", 100)
    got = collocations(docs, longest=3, least=3, block=9).collect()
    assert bag(got) == bag(slow(rows, longest=3, least=3))
    assert len(scans) == 2 and min(scans) > 5


def test_counted_buckets_follow_the_corpus(spark):
    """With more bits, rare phrases meet in fewer buckets; heavy ones are the same phrases."""
    from tracespark.llm import collocations as op

    assert [op._bits_for(n) for n in (0, 10**6, 1 << 28, 1 << 40)] == [26, 26, 27, 29]
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdef") for _ in range(40)) for _ in range(50)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    encoded = docs.mapInArrow(op._encoded, op.IDS).persist()
    every = spark.sparkContext.broadcast(np.full(1 << BITS - 3, 255, np.uint8))
    counts = Counter((a, z) for t in texts for w in [t.split()] for a, z in zip(w, w[1:]))
    for bits in (26, 28):
        heavy = spark.sparkContext.broadcast(op._heavy_buckets(encoded, [every], 57, bits))
        assert op._bits(heavy.value) == bits
        found = {r.phrase for r in op._candidates(encoded, 2, [every], heavy).collect()}
        assert found == {" ".join(p) for p, n in counts.items() if n >= 57} and 0 < len(found) < len(counts)
    encoded.unpersist()
