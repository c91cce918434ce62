"""Inputs on which a shortened operator gives other results than the whole one."""

import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from fixtures import SCHEMA
from test_operators import removed

from tracespark.llm.licenses import license_scan
from tracespark.llm.multiset_hash import as_hex, edited, from_hex, likeness, text_vector
from tracespark.llm.simhash import first_of_groups, similar_forest, similar_links
from tracespark.llm.suffix_dedup import without_repeats


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, 1, "h", 9) for i, t in texts], SCHEMA).repartition(3)


def star(copies, seed=5):
    """A text and copies with three words replaced: like it (0.86), less like each other (0.74)."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(words)]
    for k in range(copies):
        copy = list(words)
        for at in rng.sample(range(5, 195, 6), 3):
            copy[at] = f"new{k}x{at}"
        texts.append(" ".join(copy))
    return texts


def test_star_group_of_edited_copies(spark):
    docs = rows_of(spark, enumerate(star(1000)))
    assert [r.doc_id for r in first_of_groups(docs).collect()] == [0]
    # Blocks smaller than the bucket: all pairs of blocks meet.
    nodes = {r.a for r in similar_links(docs, block=20_000).select("a").union(similar_links(docs).select("b")).collect()}
    assert len(nodes) == 1001


def test_two_groups_in_a_bucket_stay_apart():
    sets = [np.arange(100), np.arange(10, 110), np.arange(30, 130), np.arange(22, 122)]
    assert sorted(map(sorted, similar_forest(np.array([1, 2, 3, 4]), sets, 0.8))) == [[0, 1], [2, 3]]
    assert similar_forest(np.array([1, 1, 3, 3]), sets, 0.8) == []


def test_texts_under_one_null_id_keep_their_own_windows(spark):
    """Among many texts two have hashes that agree in 24 bits; only one has a repeated passage."""
    rng = random.Random(9)
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(60)) for _ in range(9000)]
    by = defaultdict(list)
    for t in texts:
        by[xxhash.xxh64_intdigest(t, 42) & 0xFFFFFF].append(t)
    twins = next(ts for ts in by.values() if len(ts) > 1)
    docs = [(None, t) for t in [*texts[:50], *twins]] + [(1, "before it " + twins[0] + " and after it")]
    got = without_repeats(rows_of(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(
        (d[0], *x) for d, x in zip(docs, removed([t for _, t in docs])))


def test_likeness_of_long_repetitive_texts():
    """Counts of over 32,767 in a lane keep their sign."""
    text = "word " * 200_000
    assert likeness(text_vector(text), text_vector(edited(text, "other words " * 100_000))) > 0.5
    assert likeness(text_vector(text), text_vector(text[: len(text) // 2])) > 0.99
    assert all((x == y).all() for x, y in zip(from_hex(as_hex(text_vector(text))), text_vector(text)))


def test_gnu_file_headers(spark):
    """The published headers, in comments and wrapped, name the licence and its version."""
    header = ("# {0} is free software{1} you can redistribute it and/or modify it under the terms of the\n#  GNU {2} as published by\n"
              "# the Free Software Foundation{1} {3}.\n#\n# {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.\n")
    later = "either version {} of the License, or\n# (at your option) any later version"
    cases = [
        ("General Public License", later.format("3"), "gpl,gpl-3.0"), ("General Public License", later.format("2"), "gpl,gpl-2.0"),
        ("Lesser General Public License", later.format("2.1"), "lgpl-2.1"), ("Lesser General Public License", later.format("3"), "lgpl-3.0"),
        ("Library General Public License", later.format("2"), "lgpl-2.0"), ("Affero General Public License", later.format("3"), "agpl-3.0"),
        ("General Public License", "version 2 of the License", "gpl,gpl-2.0"), ("General Public License", "either version 3, or (at your option)\n# any later version", "gpl,gpl-3.0"),
    ]
    texts = [header.format("This program", mark, family, version) for family, version, _ in cases for mark in ";:"]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(rows_of(spark, enumerate(texts))).collect()}
    assert [got[k] for k in range(len(texts))] == [(labels, 1.0) for *_, labels in cases for _ in ";:"]


def slow_vector(text):
    """op10's sums written down one paragraph and one run of words at a time."""
    import hashlib

    mask = (1 << 64) - 1
    wide, narrow = [0] * 8, [0] * 128
    for paragraph in text.split("\n"):
        digest = hashlib.sha512(paragraph.encode()).digest()
        for k in range(8):
            wide[k] = (wide[k] + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) & mask
        words = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in paragraph.split()]
        for at in range(max(1, len(words) - 2) if words else 0):
            run = words[at]
            for k in (1, 2):
                own = words[at + k] if at + k < len(words) else 0
                run = ((run ^ run >> 29) * 0xBF58476D1CE4E5B9 + own) & mask
            run = ((run ^ run >> 31) * 0x94D049BB133111EB) & mask
            narrow[(run >> 40) % 128] += 1 - 2 * (run >> 20 & 1)
    return wide, narrow


def test_fingerprints_against_plain_sums(spark):
    """Every column of op10 by brute force, on the edge cases and on long texts."""
    import hashlib

    from fixtures import documents

    from tracespark.llm.multiset_hash import paired_fingerprints

    docs = [(d[0], d[1]) for d in documents() if d[0] is not None and d[0] not in (3, 5)] + [
        (90, "long line " * 30_000), (91, "a paragraph of words\n" * 5_000), (92, "a paragraph of words\n" * 4_999)]
    order = sorted(docs, key=lambda d: -d[0])
    vectors = {i: slow_vector(t or "") for i, t in docs}

    def as_text(v):
        return b"".join(x.to_bytes(8, "little") for x in v[0]).hex() + b"".join((x % 2**32).to_bytes(4, "little") for x in v[1]).hex()

    def like(a, b):
        if a == b:
            return 1.0
        dot, size = sum(x * y for x, y in zip(a[1], b[1])), (sum(x * x for x in a[1]) * sum(x * x for x in b[1])) ** 0.5
        return min(1.0, max(0.0, dot / size)) if size else 0.0

    expected = {}
    for (i, t), (j, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        w = slow_vector(new)
        expected[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), as_text(vectors[i]), as_text(w),
                       round(like(vectors[i], w), 9), round(like(vectors[i], vectors[j]), 9))
    for size in (1 << 30, 3000):
        got = paired_fingerprints(rows_of(spark, docs), range_bytes=size).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                for r in got} == expected and len(got) == len(docs)


def test_long_texts(spark):
    """Matches at the end of texts of some megabytes."""
    from tracespark.llm.decontamination import contamination
    from tracespark.llm.sentencepiece_codec import encoded
    from tracespark.llm.sharding import byte_shards
    from tracespark.llm.token_counts import corpus_counts
    from tracespark.llm.url_filters import judged
    from tracespark.llm import queries

    text = "plain words go on " * 150_000
    passage = "one two three four five six seven eight nine ten"
    docs = rows_of(spark, [(1, text + "Licensed under the MIT License"), (2, text + passage), (3, None)])
    labels = {r.doc_id: (r.base_labels, r.first_word, r.n_words) for r in license_scan(docs).collect()}
    assert labels == {1: ("mit", 600_003, 600_005), 2: ("", None, 600_010), 3: ("", None, 0)}
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in contamination(docs, bench).collect()} == {1: 0, 2: 10, 3: 0}
    assert all(r.round_trip for r in encoded(docs, f"{queries.TOKENIZERS}/piece_bpe_32k.model").select("round_trip").collect())
    counts = {r.doc_id: r.n_tokens for r in corpus_counts(docs, f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken").collect()}
    assert counts[1] > 500_000 and counts[3] == 0
    assert sorted((r.doc_id, r["size"]) for r in byte_shards(docs, 4).select("doc_id", "size").collect()) == [
        (1, 8 + len(text) + 30), (2, 8 + len(text) + len(passage)), (3, 8)]
    pages = [(None, "http://x.net/es/" + "a" * 100_000, "<p>" * 500_000), (2, "http://y.org/p", "z" * 10**6 + '<link rel="canonical" href="http://x.net/fr/q">'),
             (3, "http://x.net/fr/q", None)]
    got = {r.page_id: r.verdict for r in judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {None: "block", 2: "block", 3: "block"}


def test_a_hot_id(spark):
    """A third of the rows under one id, and equal rows: shards and cuts stay whole."""
    from tracespark.llm.sharding import byte_shards

    rng = random.Random(2)
    docs = [(None if k % 3 else k, " ".join(f"x{rng.randrange(900)}" for _ in range(40))) for k in range(600)] + [(7, "same row " * 40)] * 60
    shards = byte_shards(rows_of(spark, docs), 5).collect()
    sizes = Counter()
    for r in shards:
        sizes[r.shard] += r.size
    assert len(shards) == len(docs) and max(sizes.values()) - min(sizes.values()) < 2 * max(r.size for r in shards)
    got = without_repeats(rows_of(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(
        (d[0], *x) for d, x in zip(docs, removed([t for _, t in docs])))


def test_recall_of_near_links(spark):
    """Pairs of texts at 0.8 to 0.9 of their five-word shingles among texts that share a
    passage: nearly all are linked, whatever else is in their buckets."""
    rng = random.Random(11)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(150)]
    docs, pairs = [], 0
    for k in range(0, 400, 2):
        own = [f"q{rng.randrange(10**6)}" for _ in range(52)]
        other = list(own)
        other[20 + k % 20] = "edited"
        docs += [(k, " ".join(passage + own)), (k + 1, " ".join(passage + other))]
        pairs += 1
    links = similar_links(rows_of(spark, docs)).collect()
    by_tie = {r.tie: r.doc_id for r in rows_of(spark, docs).selectExpr("doc_id", "xxhash64(text) AS tie").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in links:
        root[find(by_tie[r.a])] = find(by_tie[r.b])
    assert sum(find(k) == find(k + 1) for k in range(0, 400, 2)) >= 0.99 * pairs
