"""Small tables with every edge that the operators must stand."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, score double, size long, hash string, n_words long"


def documents():
    rng = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu Ärger élan 漢字 x1".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    base = prose(300)
    texts = [
        None, "", " \n\t ", "one", "two words", "three little words", prose(4), base, base, base + " end",
        "Start " + base, prose(40) + "\n" + passage + "\n" + prose(30), passage, prose(25) + passage.upper(),
        "Licensed under the Apache License, Version 2.0. " + prose(10), "Released under the MIT License.\nMIT license mit LICENSE",
        "GNU General Public License, version 3; CC BY-NC 4.0", "a" * 700, "ab" * 300 + "c", prose(3000), "word " * 400,
        "é" * 250, prose(20) + "\U0001f600 ▁ end", "Line\n" * 120,
    ]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(3, "one"), (5, "another text under a used id"), (None, base), (None, None), (-4, prose(50)), (2**40, prose(50))]
    return [(i, t, 0.5, 1, "h", 9) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def bag(rows):
    return Counter(map(tuple, rows))
