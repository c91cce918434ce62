import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from compare import connected
from fixtures import SCHEMA, ascii_lower, bag, documents, frame, words_of
from pyspark.sql import functions as F

from tracespark.llm import queries
from tracespark.llm.components import components
from tracespark.llm.decontamination import WuManber, benchmark_hits, contamination
from tracespark.llm.licenses import NOTICES, LicenseIndex, license_scan
from tracespark.llm.sharding import byte_shards
from tracespark.llm.simhash import counts_of, fingerprints, first_of_groups, manhattan, near_groups
from tracespark.llm.suffix_dedup import PIECE, radix_groups, without_repeats
from tracespark.llm.token_counts import corpus_counts, document_counts
from tracespark.llm.url_filters import judged

FOLDER = "/root/testdata/sf0.001"


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_contiguous_and_balanced(spark):
    docs = documents()
    got = sorted(byte_shards(frame(spark), 5, ranges=3).collect(), key=lambda r: r.global_row)
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag(
        (d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert [r.global_row for r in got] == list(range(len(docs)))
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    total, before, slots = sum(r.size for r in got), 0, Counter()
    for r in got:
        assert r.first_byte == before and r.shard == min(4, (2 * before + r.size) * 5 // (2 * total))
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        before += r.size
    assert byte_shards(empty(spark), 5).count() == 0


def license_base(text):
    words = words_of(text)
    places = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


def test_licenses(spark):
    got = license_scan(frame(spark)).collect()
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == bag(
        (d[0], *license_base(d[1])) for d in documents())
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[14] == ("apache,apache-2.0", 1.0) and labels[16][0] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0"
    assert labels[15][0] == "mit" and labels[0] == ("", 0.0)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan(empty(spark)).count() == 0


def test_licence_places_against_all_alignments():
    """The index finds what trying every template at every place finds."""
    import random

    rng = random.Random(12)
    vocabulary = sorted({w for _, notice, _ in NOTICES for w in notice.split()})
    for idf in (None, {w: rng.random() for w in vocabulary[::2]}):
        index = LicenseIndex(NOTICES, idf)
        for _ in range(150):
            words = [rng.choice(vocabulary) for _ in range(20)]
            for _, notice, _ in rng.sample(NOTICES, 3):
                part = notice.split()
                for _ in range(rng.randrange(3)):
                    part[rng.randrange(len(part))] = rng.choice(vocabulary)
                words += part + [rng.choice(vocabulary) for _ in range(rng.randrange(5))]
            words = [w.encode() for w in words]
            expected = {}
            for label, notice, phrases in NOTICES:
                own = notice.encode().split()
                keys = [next((i, q) for i in range(len(own)) if own[i : i + len(q)] == q) for q in (p.encode().split() for p in phrases)]
                for start in range(-len(own), len(words)):
                    if all(start + i >= 0 and words[start + i : start + i + len(q)] == q for i, q in keys):
                        share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(own)) / len(own)
                        if share >= 0.8:
                            expected[label] = max(expected.get(label, 0), share)
            assert index.notices(words, set(words)) == expected


def removed(texts, window=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                hit[i : i + window] = b"\1" * window
        kept = bytes(c for c, h in zip(b, hit) if not h)
        runs = sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1]))
        out.append((len(b), sum(hit), runs, kept))
    return out


@pytest.mark.parametrize("window, block", [(200, 1024), (160, 1024), (200, 2), (163, 1)])
def test_repeated_windows(spark, window, block):
    """Small blocks: first digits are dealt out and united again."""
    docs = documents()
    got = without_repeats(frame(spark), window=window, block=block).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == bag(
        (d[0], *x) for d, x in zip(docs, removed([d[1] for d in docs], window)))
    assert got[0].score == 0.5  # other columns stay
    assert without_repeats(empty(spark)).count() == 0
    as_text = without_repeats(frame(spark), as_text=True).where("doc_id = 21").first()
    assert "�" not in as_text.kept


def test_radix_groups_are_the_repeated_strings():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1300] = data[200:500]
    starts = np.arange(0, 3900)
    for depth in (8, 20, 64):
        group = starts % 2
        left, number = radix_groups(data, starts, group, depth)
        strings = [(g, data[s : s + depth].tobytes()) for g, s in zip(group.tolist(), starts.tolist())]
        count = Counter(strings)
        assert sorted(left.tolist()) == [k for k, s in enumerate(strings) if count[s] > 1]
        ordered = [strings[k] for k in left]
        assert ordered == sorted(ordered)
        assert [a == b for a, b in zip(ordered, ordered[1:])] == [a == b for a, b in zip(number, number[1:])]


def test_repeats_over_the_borders_of_pieces(spark):
    """A text of over a piece (512 KiB), with repeats in and around the border."""
    import random

    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(PIECE + 3000))
    near = long[PIECE - 1500 : PIECE + 900]
    docs = [(1, long), (2, near[:700] + "#" + near[700:]), (3, long[40:300])]
    got = without_repeats(spark.createDataFrame([(*d, 0.5, 1, "h", 9) for d in docs], SCHEMA)).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == bag(
        (d[0], *x) for d, x in zip(docs, removed([d[1] for d in docs])))


def test_ids_of_another_type(spark):
    rows = [(None if d[0] is None else f"a{d[0]}", d[1]) for d in documents()]
    got = without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == bag(
        (d[0], *x) for d, x in zip(rows, removed([d[1] for d in rows])))


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://example.com/en/1", None), (2, "https://WWW.example.com/en/1", ""), (3, "http://a.net/es/5", link.format("http://b.org/x")),
        (4, "http://b.org/x/", None), (5, "http://m.b.org/x.html?utm_source=feed#top", None), (6, "http://c.org/y", link.format("http://b.org/x")),
        (7, None, None), (8, "no scheme", None), (9, "", None), (10, "http://d.org/z", '<meta http-equiv="refresh" content="0; url=/w">'),
        (11, "http://d.org/w", link.format("//e.net/fr/q")), (12, "http://e.net/fr/q", None), (13, "http://f.com/ok", link.format("http://c.org/y2")),
        (14, "http://c.org/y2", link.format("http://g.net/es/")), (15, "http://g.net/es/", None), (4, "http://b.org/x/", None), (16, "http://notexample.com/en/", None),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(df).collect()}
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == got[5][2:] == got[6][2:] == (None, "block")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == got[11][2:] == (None, "block")
    assert got[14][2:] == (None, "allow") and got[15][3] == "block"  # an allowed alias goes first
    assert got[16][2:] == ("com/", "allow")
    assert judged(df).count() == len(pages) and judged(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (300, 300), (None, 3)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in [*range(41), 100]}, 200: 200, 201: 200, **{k: 500 for k in range(500, 560)}}


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(marks, distance=4):
    """Smallest index reachable from each."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= distance:
            a, z = sorted((find(i), find(j)))
            root[z] = a
    return [find(i) for i in range(len(marks))]


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined(marks, texts, similarity=0.8):
    """Smallest index reachable by close fingerprints or similar five-word shingles."""
    root, sets = list(range(len(marks))), [shingles(t) for t in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(marks)), 2):
        both = len(sets[i] & sets[j])
        if (marks[i] ^ marks[j]).bit_count() <= 4 or both and both >= similarity * len(sets[i] | sets[j]):
            a, z = sorted((find(i), find(j)))
            root[z] = a
    return [find(i) for i in range(len(marks))]


def test_simhash_groups(spark):
    docs = documents()
    marks = [simhash(d[1]) for d in docs]
    roots = linked(marks)
    least = defaultdict(list)
    for r, d in zip(roots, docs):
        if d[0] is not None:
            least[r].append(d[0])
    got = near_groups(frame(spark)).collect()
    assert bag((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == bag(
        (d[0], m, min(least[r])) for d, m, r in zip(docs, marks, roots))
    kept = first_of_groups(frame(spark), similarity=None).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(least[r]) for r in set(roots))
    wider = joined(marks, [d[1] for d in docs])
    least = defaultdict(list)
    for r, d in zip(wider, docs):
        if d[0] is not None:
            least[r].append(d[0])
    kept = first_of_groups(frame(spark)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(least[r]) for r in set(wider))
    assert near_groups(empty(spark)).count() == first_of_groups(empty(spark)).count() == 0


def test_simhash_links_of_dense_cells(spark):
    """Cells over the block size are dealt out as pairs of blocks."""
    from tracespark.llm.simhash import near_links

    import random

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    marks = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)} | {rng.getrandbits(64) for _ in range(200)}
                   | {centre ^ 0x3FF000 ^ (1 << k) for k in range(64)})
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "fp long")
    for block in (16, 4096):
        links = near_links(df, block=block).collect()
        index = {m: i for i, m in enumerate(signed)}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
        root = list(range(len(marks)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            x, y = sorted((find(index[a]), find(index[b])))
            root[y] = x
        assert [find(i) for i in range(len(marks))] == linked(marks)


def test_manhattan_distance_bounds_the_bits():
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 2**64, 500, dtype=np.uint64)
    marks[250:] = marks[:250] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    marks = marks.view(np.int64)
    segments = np.array([[bin(int(m) >> (2 * k) & 3).count("1") for k in range(32)] for m in marks])
    bits = np.bitwise_count((marks[:250] ^ marks[250:]).view(np.uint64))
    packed = counts_of(marks)
    assert ((packed[:, :, None] >> np.arange(0, 8, 2) & 3).reshape(-1, 32) == segments).all()
    expected = np.abs(segments[:250] - segments[250:]).sum(1)
    assert (manhattan(packed[:250], packed[250:]) == expected).all() and (expected <= bits).all()


def test_fingerprints_of_long_texts(spark):
    text = "w%d " * 70000 % tuple(range(70000))
    row = fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.fp & (2**64 - 1) == simhash(text)


def windows_hit(words, items, width=10):
    hit, found = set(), set()
    for item, text in items:
        w = words_of(text)
        n = min(width, len(w))
        for at in range(len(w) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[at : at + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(hit), found


def test_benchmark_passages(spark):
    docs = documents()
    items = [(1, docs[12][1]), (20, "Three LITTLE words"), (3, "little"), (4, None), (5, "..."), (20, docs[19][1][:900]), (6, "zeta never here 10 11 12 13 14 15 16 17")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d in docs:
        words = words_of(d[1])
        n, found = windows_hit(words, [(str(i), t) for i, t in items])
        expected.append((d[0], len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0))
    assert bag(contamination(frame(spark), bench).collect()) == bag(expected)
    small = benchmark_hits(frame(spark), bench, block_bytes=300)  # several blocks of the benchmark
    n_hit = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0), lambda a, x: a + x)
    assert bag(small.select("doc_id", n_hit, F.size("items")).collect()) == bag((e[0], e[2], e[3]) for e in expected)
    assert contamination(frame(spark), bench.limit(0)).where("contaminated").count() == 0
    assert contamination(empty(spark), bench).count() == 0


def test_shift_tables_skip():
    finder = WuManber([("a", b"b c d e f"), ("z", b"q")], 4)
    assert finder.search([b"x", b"b", b"c", b"d", b"e", b"f", b"q"]) == ([(1, 7)], {"a", "z"})


def test_token_counts(spark, tmp_path):
    from tracespark.llm.token_counts import encoding, write_token_files

    ranks = f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    encode = encoding(open(ranks, "rb").read()).encode_ordinary
    got = corpus_counts(frame(spark), ranks).collect()
    assert bag((r.doc_id, r.n_tokens, r.complete) for r in got) == bag((d[0], len(encode(d[1] or "")), True) for d in documents())
    for n, size in enumerate((7, 300, 1 << 20)):  # documents reach over files and blocks
        path = str(tmp_path / f"tokens{n}")
        write_token_files(frame(spark), path, ranks, numbered=False, file_tokens=size)
        for block in (3, 50, 1 << 20):
            plain = document_counts(spark, path, numbered=False, block_tokens=block).collect()
            assert Counter(r.n_tokens for r in plain) == Counter(len(encode(d[1] or "")) for d in documents())
            assert all(r.complete for r in plain)
    path = str(tmp_path / "numbered")
    write_token_files(frame(spark), path, ranks, file_tokens=11)
    for block in (4, 1 << 20):
        got = document_counts(spark, path, block_tokens=11 if block == 4 else block).collect()
        assert bag((r.number, r.n_tokens) for r in got) == bag((d[0], len(encode(d[1] or ""))) for d in documents())
    assert corpus_counts(empty(spark), ranks).count() == 0
    with pytest.raises(TypeError):
        corpus_counts(frame(spark).withColumn("doc_id", F.lit("a1")), ranks)


def test_files_without_a_filler_or_last_end(spark, tmp_path):
    """Plain files of another writer: each is a stream, its tail may be open."""
    from tracespark.llm.token_counts import document_counts

    tokens = [5, 6, 9, 9, 7, 9, 1, 2, 3]
    (tmp_path / "part-00000").write_bytes(np.array(tokens, "<u4").tobytes())
    (tmp_path / "part-00001").write_bytes(b"")
    for block in (1, 2, 100):
        got = document_counts(spark, str(tmp_path), end_id=9, filler_id=None, token="<u4", numbered=False, block_tokens=block).collect()
        assert sorted((r.start, r.n_tokens, r.complete) for r in got) == [(0, 2, True), (3, 0, True), (4, 1, True), (6, 3, False)]


def test_all_links_of_a_page_count(spark):
    """Several canonical links and refreshes, with attributes in either order."""
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.org/y"><LINK href="http://c.net/es/z" rel=canonical>'),
        (2, "http://c.net/es/z", None), (3, "http://b.org/y", ""),
        (4, "http://d.org/p", '<meta content="0; url=http://e.org/q" http-equiv="refresh"><meta http-equiv=refresh content="1;URL=http://f.net/fr/r">'),
        (5, "http://f.net/fr/r", None), (6, "http://e.org/q", None), (7, None, '<link rel="canonical" href="http://c.net/es/z">'), (8, "no host", None),
        (9, "http://g.org/", '<link rel="stylesheet" href="http://c.net/es/z"><link rel="canonical">'),
    ]
    got = {r.page_id: r.verdict for r in judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
    con = connected(FOLDER)
    frame_ = pd.DataFrame(pages, columns=["page_id", "url", "html"])  # noqa: F841
    con.execute("create or replace view pages as select * from frame_")
    assert {r[0]: r[1] for r in con.execute(f"select page_id, verdict from ({queries.SQL['op4_url_filters']})").fetchall()} == got


def test_rows_without_host_are_no_key(spark):
    pages = [(k, None if k % 2 else "nothing", None) for k in range(500)] + [(1000, "http://x.net/es/", None)]
    got = judged(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert Counter(r.verdict for r in got.collect()) == {"allow": 500, "block": 1}
    assert got.count() == 501


def test_files_whose_names_hold_another_number(spark, tmp_path):
    """The writer's own id may have a part like -c4; only the last one is the file's number."""
    stem = "part-00000-1f2e3d4c-c4b1-4a5b-8c9d-c00112233445"
    for k, tokens in enumerate(([5, 6, 9, 7], [8, 9, 1], [2, 9])):
        (tmp_path / f"{stem}-c{(0, 2, 10)[k]:03d}.txt").write_bytes(np.array(tokens, "<u4").tobytes())
    got = document_counts(spark, str(tmp_path), end_id=9, filler_id=None, token="<u4", numbered=False).collect()
    assert sorted((r.start, r.n_tokens, r.complete) for r in got) == [(0, 2, True), (3, 2, True), (6, 2, True)]
