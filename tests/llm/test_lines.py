import random
from collections import defaultdict

from fixtures import SCHEMA, ascii_lower, bag, documents, frame

from tracespark.llm.line_dedup import line_dedup, without_shared_lines


def slow(rows, least_chars=10, least_docs=2):
    """Rows of (id, text): (id, text, n_lines, n_dropped, kept) by plain loops."""
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least_docs or i == min(holders[key(x)], key=rank)]
        out.append((i, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def edges():
    rng = random.Random(5)
    pool = ["A line that many share", "  a LINE that many share\t\r", "short", "ten chars!", "nine char", "", " ", "ÄRGER im Haus ist", "ärger im Haus ist",
            " not a blank at its ends ", "x" * 5000, "漢字漢字漢字漢字漢字", "\x0bvertical tab line\x0c"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    rows += [(7, rows[7][1]), (7, "A line that many share\nunder a used id, twice"), (None, "A line that many share"), (None, "null again\nten chars!"),
             (-3, "ten chars!\nten chars!\nonly here it stays"), (100, None), (101, ""), (102, "\n\n"), (103, "once only once only\n" * 3000)]
    return rows + [(d[0], d[1]) for d in documents()]


def test_lines_equal_plain_loops(spark):
    rows = edges()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (4096, 4):  # all keys light, the common ones broadcast
        got = without_shared_lines(docs, hot=hot)
        assert bag(got.select("doc_id", "text", "n_lines", "n_dropped", "kept").collect()) == bag(slow(rows))
    got = without_shared_lines(docs, least_chars=1, least_docs=5)
    assert bag(got.select("doc_id", "text", "n_lines", "n_dropped", "kept").collect()) == bag(slow(rows, 1, 5))


def test_hot_line_and_id(spark):
    """A third of all rows hold one line, and a third are equal rows of one id."""
    rows = [(k, f"Terms of use apply here\nown line number {k}") for k in range(700)] + [(5000, "equal rows of one id\nTerms of use apply here")] * 700
    rows += [(k, f"own line number {k}") for k in range(10_000, 10_700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = without_shared_lines(docs, hot=16)
    assert bag(got.select("doc_id", "text", "n_lines", "n_dropped", "kept").collect()) == bag(slow(rows))


def test_columns_of_any_name_and_empty_tables(spark):
    docs = frame(spark).selectExpr(
        "doc_id", "text", "1 as id", "2 as tie", "3 as `a.b`", "4 as kept", "5 as dropped", "6 as lines", "7 as h1", "8 as rest", "9 as n_lines", "10 as first")
    got = without_shared_lines(docs)
    assert got.columns == ["doc_id", "text", "id", "tie", "a.b", "dropped", "lines", "h1", "rest", "first", "n_lines", "n_dropped", "kept"]
    assert {tuple(r) for r in got.selectExpr("id", "tie", "`a.b`", "dropped", "lines", "h1", "rest", "first").collect()} == {(1, 2, 3, 5, 6, 7, 8, 10)}
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    strings = spark.createDataFrame([("b", "a shared line it is"), ("a", "a shared line it is")], "doc_id string, text string")
    assert bag(without_shared_lines(strings).select("doc_id", "kept").collect()) == {("a", "a shared line it is"): 1, ("b", ""): 1}


def test_no_python_in_the_plan(spark):
    plan = line_dedup(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
