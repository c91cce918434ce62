"""Filling looks back twice: a frame that shrinks is taken anew for every row."""

from tracespark.operators.traces import filled


def test_no_window_ends_at_the_last_row(spark):
    rows = [(1, k, v) for k, v in enumerate([None, 2.0, None, None, 8.0, None])] + [(2, 0, None), (3, 0, 5.0), (3, 1, None)]
    done = filled(spark.createDataFrame(rows, "roi long, frame long, value double"), ["roi"])
    assert "unboundedfollowing" not in done._jdf.queryExecution().analyzed().toString().lower()
    got = {(r.roi, r.frame): r.value for r in done.collect()}
    assert [got[1, k] for k in range(6)] == [2, 2, 4, 6, 8, 8] and got[2, 0] == 0 and got[3, 0] == got[3, 1] == 5
