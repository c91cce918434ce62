import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from fixtures import bag, documents, words_of

from tracespark.llm.lexical_search import PostingList, Search, Shard, ranked


def slow(docs, items, top=10):
    """Rows of (doc_id, text) and (item, text): item, rank, doc_id, score by scoring all documents."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(words_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    topics = [[f"t{k}w{j}" for j in range(40)] for k in range(12)]
    common = "the of and to In is ÉTÉ 漢字 7".split()
    text = lambda: " ".join(rng.choice(common if rng.random() < 0.4 else topic) for topic in [rng.choice(topics)] for _ in range(rng.randrange(1, 120)))
    docs = [(k, text()) for k in range(n)] + [(d[0], d[1]) for d in documents()]
    docs += [(10_000 + k, docs[5][1]) for k in range(60)] + [(None, docs[5][1]), (10_000, docs[5][1])]
    items = [(k, text()) for k in range(25)] + [(3, "more words t1w1 under a used id"), (90, None), (91, ""), (92, "unknownterm"), (93, "THE the"), (None, "t2w2 alpha"), (94, docs[5][1])]
    return docs, items


def tables(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"))


def test_ranks_equal_scoring_all(spark):
    docs, items = corpus()
    d, q = tables(spark, docs, items)
    expected = bag(slow(docs, items))
    assert bag(ranked(d, q).collect()) == expected
    assert bag(ranked(d, q, size=3, postings=300).collect()) == expected  # many shards and blocks
    assert bag(ranked(d, q, block_bytes=2000).collect()) == expected  # several blocks of queries
    assert bag(ranked(d, q, top=3).collect()) == bag(slow(docs, items, 3))


def test_a_hot_term_and_copies(spark):
    """A third of the rows are one text, and every row holds one term."""
    rng = random.Random(8)
    docs = [(k, f"everywhere r{rng.randrange(50)} r{rng.randrange(50)}") for k in range(600)] + [(5000 + k, "everywhere copy of a copy") for k in range(300)]
    items = [(1, "everywhere copy"), (2, "everywhere r3 r9"), (3, "everywhere")]
    assert bag(ranked(*tables(spark, docs, items), size=8, postings=400).collect()) == bag(slow(docs, items))


def test_empty_tables_names_and_types(spark):
    docs, items = [(1, "one two"), (2, None)], [("b", "two three"), ("a", "")]
    d = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 as item", "2 as n", "3 as terms", "4 as score")
    q = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "5 as doc_id", "6 as item")
    assert [tuple(r)[:3] for r in ranked(d, q).collect()] == [("b", 1, 1)]
    assert ranked(d.limit(0), q).collect() == [] and ranked(d, q.limit(0)).collect() == []
    assert ranked(d.where("text is null"), q).collect() == []


def shard_of(rng, n, n_terms):
    terms, tfs, ends = [], [], []
    for _ in range(n):
        own = np.unique(rng.zipf(1.3, 30).clip(1, n_terms) - 1)
        terms.append(own)
        tfs.append(rng.integers(1, 5, len(own)))
        ends.append(len(own))
    weights = rng.integers(1, 6000, n_terms)
    return Shard(pa.array(np.arange(n)), np.full(n, 40), np.concatenate(terms).astype(np.int32), np.concatenate(tfs).astype(np.int32), np.cumsum(ends), weights, n, 40 * n)


def test_summaries_bound_their_blocks_and_skip():
    rng = np.random.default_rng(2)
    shard = shard_of(rng, 2000, 300)
    queries = [np.unique(rng.integers(0, 300, 12)) for _ in range(20)]
    search = Search(queries, 300, 10)
    for q, terms in enumerate(queries):
        mine = np.zeros(300, np.int64)
        mine[terms] = 1
        for t in terms.tolist():
            if not shard.most[t]:
                continue
            posting = shard.list_of(t, search.asked, 16)
            assert sorted(posting.docs.tolist()) == sorted(set(posting.docs.tolist())) and np.diff(posting.starts).max() <= 32
            bounds = posting.bounds(mine)
            for b, (a, z) in enumerate(zip(posting.starts[:-1], posting.starts[1:])):
                docs = posting.docs[a:z]
                # the summary is the largest value of each coordinate: a bound that some value reaches
                assert bounds[b] >= shard.scores(docs, mine).max()
                dense = np.zeros((len(docs), 300), np.int64)
                entries, lengths = shard.entries(docs)
                dense[np.repeat(np.arange(len(docs)), lengths), shard.terms[entries]] = shard.values[entries]
                assert bounds[b] == (dense.max(0) * mine).sum()
    search.add(shard)
    scores = np.zeros((20, 2000), np.int64)
    for q, terms in enumerate(queries):
        mine = np.zeros(300, np.int64)
        mine[terms] = 1
        scores[q] = shard.scores(np.arange(2000), mine)
        assert search.best[q][0].tolist() == np.sort(scores[q])[::-1][:10].tolist()
    assert search.evaluated < (scores > 0).sum() and search.skipped > 0
    assert isinstance(posting, PostingList)
