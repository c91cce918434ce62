"""Large tables are dealt out in more parts than the session's."""

from tracespark.plans import bindings as b


def test_parts_grow_with_the_table(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    few = b.traces(spark, folder)
    monkeypatch.setattr(b, "PART_ROWS", 500)
    many = b.traces(spark, folder)
    assert "RepartitionByExpression" not in few._jdf.queryExecution().analyzed().toString()
    assert many.rdd.getNumPartitions() >= 10 > 4
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
