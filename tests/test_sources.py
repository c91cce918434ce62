import numpy as np
import pytest

from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from tracespark import sources
from tracespark.operators import behaviour, logs, timejoin
from tracespark.sources import binary


def test_logs_keep_line_numbers(spark, tmp_path):
    (tmp_path / "A1.txt").write_text("$PP,1,x\n\n$TR,5\nbad\n$NT,9\n$LE,10,1\n")
    read = sources.read_logs(spark, str(tmp_path))
    assert [(r.rec, r.line_no) for r in read.orderBy("line_no").collect()] == [("A1", 0), ("A1", 2), ("A1", 3), ("A1", 4), ("A1", 5)]
    assert [r.raw for r in read.where(logs.malformed(read)).collect()] == ["bad"]
    trials = logs.with_trials(logs.parsed(read)).select("tag", "trial").orderBy("line_no").collect()
    assert [tuple(r) for r in trials] == [("$PP", 0), ("$TR", 0), ("bad", 0), ("$NT", 0), ("$LE", 1)]


def test_movie_and_regions(spark, tmp_path):
    movie = np.arange(20 * 64, dtype="<i2").reshape(20, 64)
    (tmp_path / "m.bin").write_bytes(movie.tobytes())
    frames = sources.read_movie(spark, str(tmp_path / "m.bin"), 8, 8)
    assert [r["mean"] for r in frames.orderBy("frame").collect()] == movie.mean(1).tolist()
    means = sources.roi_means(frames, {1: np.arange(12), 2: np.arange(3)})
    got = {(r.frame, r.roi): r.value for r in means.collect()}
    assert got[3, 1] == movie[3, :12].mean() and got[3, 2] is None
    blocks = sources.roi_means(frames, {1: np.arange(12), 2: np.arange(3), 3: np.arange(20, 40)}, most_broadcast=5)  # a block at a time
    assert {(r.frame, r.roi): r.value for r in blocks.where("roi < 3").collect()} == got
    for most in (5, 1000):  # a pixel outside the frame fails, however many masks there are
        with pytest.raises(Exception, match="out of bounds"):
            sources.roi_means(frames, {1: [3, 64]}, 1, most_broadcast=most).collect()


def test_one_movie_file_is_many_partitions(spark, tmp_path):
    movie = np.arange(100 * 64, dtype="<i2").reshape(100, 64)
    (tmp_path / "a.bin").write_bytes(movie[:70].tobytes())
    (tmp_path / "b.bin").write_bytes(movie[70:].tobytes())
    frames = sources.read_movie(spark, str(tmp_path), 8, 8, split=1000)
    assert frames.rdd.getNumPartitions() == 10 + 5
    assert {r.frame: bytes(r.pixels) for r in frames.collect()} == {k: movie[k].tobytes() for k in range(100)}
    some = sources.read_movie(spark, str(tmp_path), 8, 8, frames=(65, 72), split=1000)
    assert some.rdd.getNumPartitions() == 2 and sorted(r.frame for r in some.collect()) == list(range(65, 72))
    (tmp_path / "b.bin").write_bytes(movie[70:].tobytes()[:-1])
    with pytest.raises(Exception, match="whole number of frames"):
        sources.read_movie(spark, str(tmp_path), 8, 8).collect()


def test_filters_on_frames_narrow_the_byte_ranges(spark, tmp_path):
    movie = np.arange(100 * 64, dtype="<i2").reshape(100, 64)
    (tmp_path / "a.bin").write_bytes(movie.tobytes())
    options = {"path": str(tmp_path), "height": "8", "width": "8", "split": "1280"}
    reader = binary.PushedMovieReader(options)
    other = EqualTo(("mean",), 3.0)
    assert reader.pushFilters([GreaterThan(("frame",), 41), LessThanOrEqual(("frame",), 55), other]) == [other]
    assert [(p.start, p.first, p.count) for p in reader.partitions()] == [(42 * 128, 42, 10), (52 * 128, 52, 4)]
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        frames = sources.read_movie(spark, str(tmp_path), 8, 8, split=1280).where("frame >= 95 and mean > 0")
        assert frames.rdd.getNumPartitions() == 1 and sorted(r.frame for r in frames.collect()) == [95, 96, 97, 98, 99]
    finally:
        spark.conf.unset(key)


def test_movies_and_matrices_written_by_tasks(spark, tmp_path):
    movie = np.arange(60 * 12, dtype="<i2").reshape(60, 12)
    rows = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(movie)], "frame long, pixels binary").repartition(7)
    sources.write_movie(rows, str(tmp_path / "movie"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "movie").glob("*.bin"))) == movie.tobytes()
    assert not list((tmp_path / "movie").glob("_*"))
    x = {"a": np.random.default_rng(1).random((30, 50)), "b": np.arange(8.0).reshape(2, 4)}
    traces = spark.createDataFrame([(r, k, v.tolist()) for r, m in x.items() for k, v in enumerate(m)], "rec string, roi long, values array<double>")
    sources.write_traces(traces.repartition(5), str(tmp_path / "npy"))
    assert all(np.array_equal(np.load(tmp_path / "npy" / f"{r}.npy"), m) for r, m in x.items())
    read = sources.read_traces(spark, str(tmp_path / "npy"), split=4000)
    assert read.rdd.getNumPartitions() == 4
    assert {(r.rec, r.roi): r["values"] for r in read.collect()} == {(r, k): v.tolist() for r, m in x.items() for k, v in enumerate(m)}
    assert {(r.rec, r.roi) for r in sources.read_traces(spark, str(tmp_path / "npy"), rois=(1, 3)).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    (tmp_path / "npy" / "c.npy").write_bytes((tmp_path / "npy" / "b.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="do not fit"):
        sources.read_traces(spark, str(tmp_path / "npy")).collect()


def test_a_log_in_fifty_splits(spark, tmp_path):
    """Line numbers, trials and counters run on over the splits of one file."""
    raw, t = [], 0
    for k in range(4000):
        t += 700
        raw.append("" if k % 97 == 0 else f"${('NT' if k % 50 == 49 else 'TR' if k % 50 == 0 else 'LE')},{t % 100_000},1")
    (tmp_path / "A1.txt").write_text("\r\n".join(raw) + "\n")
    (tmp_path / "A2.txt").write_text("$TR,5\nlast without end")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, str((tmp_path / "A1.txt").stat().st_size // 50 + 1))
    try:
        read = sources.read_logs(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 0 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 50
        got = {(r.rec, r.line_no): r.raw for r in read.collect()}
        assert got == {("A1", k): x for k, x in enumerate(raw) if x} | {("A2", 0): "$TR,5", ("A2", 1): "last without end"}
        for slot_lines in (1 << 20, 64):
            log = logs.unwrapped(logs.with_trials(logs.parsed(read), slot_lines=slot_lines), 100_000, slot_lines=slot_lines)
            rows = {r.line_no: (r.trial, r.t_ms) for r in log.where("rec = 'A1'").collect()}
            trial, expected = 0, {}
            for k, x in enumerate(raw):
                if x and k >= 50:  # the first $TR is on an empty line
                    expected[k] = (trial, 700.0 * (k + 1))
                trial += x.startswith("$NT")
            assert rows == expected
    finally:
        spark.conf.set(key, before)


def test_groups_settle_or_fail(spark):
    from tracespark.operators.pooling import connected_groups

    chain = spark.createDataFrame([(1, k, k + 1) for k in range(200)], "anm int, a long, z long")
    nodes = spark.createDataFrame([(1, k) for k in range(205)], "anm int, node long")
    got = {r.node: r.group for r in connected_groups(chain, nodes, "anm").collect()}
    assert got == {**dict.fromkeys(range(201), 1), 201: 2, 202: 3, 203: 4, 204: 5}
    with pytest.raises(RuntimeError, match="settled"):
        connected_groups(chain, nodes, "anm", rounds=2)


def test_trace_arrays(spark, tmp_path):
    x = np.arange(6.0).reshape(2, 3)
    np.save(tmp_path / "F.npy", x)
    rows = sources.read_traces(spark, str(tmp_path)).orderBy("roi").collect()
    assert [r["values"] for r in rows] == x.tolist() and rows[0].rec == "F"


def test_ties_in_nearest_go_left(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 0.0), (2, 1.0)], "rec int, t double")
    b = spark.createDataFrame([(1, 4.0, 0), (1, 6.0, 1)], "rec int, t double, frame int")
    got = {(r.rec, r.t): r.frame for r in timejoin.to_frame(a, b, ["rec"]).collect()}
    assert got == {(1, 5.0): 0, (1, 0.0): -1, (2, 1.0): -1}


def test_conflicting_labels_fail(spark):
    days = spark.createDataFrame([(["s1", "s1"], ["ctrl", "drug"])], "session array<string>, label array<string>")
    with pytest.raises(Exception, match="conflict"):
        logs.treatments(days).collect()


def test_streak_decides_the_stage(spark):
    days = spark.createDataFrame([(1, k, m) for k, m in enumerate([True, False, True, True, True])], "anm int, k int, met boolean")
    from pyspark.sql import functions as F

    got = behaviour.learning_stage(days, F.col("met")).orderBy("k").collect()
    assert [r.stage for r in got] == ["learning"] * 3 + ["learned"] * 2


def test_session_tables_in_few_folders_replace_only_their_recordings(spark, tmp_path):
    """Recordings share folders; those that are not written stay; names like numbers stay names."""
    rows = {f"{k:04}": [k + 0.5, None, k * 2.0] for k in range(600)}
    table = lambda x: spark.createDataFrame(list(x.items()), "rec string, values array<double>")
    path = str(tmp_path / "stats")
    sources.write_stats(table(rows), path)
    assert len(list((tmp_path / "stats").glob("*/*.parquet"))) <= sources.PARTS
    more = {"0007": [1.0], "0599": [], "new": [2.0]}
    sources.write_stats(table(more), path)
    read = sources.read_stats(spark, path)
    assert read.columns == ["rec", "values"] and read.count() == 601
    assert {r.rec: r["values"] for r in read.collect()} == rows | more


def test_logs_are_one_file_each_in_one_folder(spark, tmp_path):
    rows = [(f"A{k % 90}", k // 90, f"$LE,{k}" if k % 7 else "") for k in range(2000)]
    lines = spark.createDataFrame(rows, "rec string, line_no long, raw string").repartition(5)
    sources.write_logs(lines, str(tmp_path / "logs"))
    assert sorted(p.name for p in (tmp_path / "logs").iterdir()) == sorted(f"A{k}.txt" for k in range(90))
    read = sources.read_logs(spark, str(tmp_path / "logs"))
    assert sorted(map(tuple, read.collect())) == sorted(r for r in rows if r[2])
    key, before = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, least in (("4m", 4 << 20), ("512", 512), ("2KB", 2048), ("7b", 7), ("1g", 128 << 20)):
            spark.conf.set(key, size)
            assert sources._least_split(spark) == least
    finally:
        spark.conf.set(key, before)
    with pytest.raises(Exception, match="cannot name a file"):
        sources.write_logs(lines.limit(1).selectExpr("'a/b' AS rec", "line_no", "raw"), str(tmp_path / "other"))


def test_file_names_of_long_paths():
    import re
    import time

    for path, name in (("file:///tmp/a/b.c.txt", "b.c"), ("A1", "A1"), ("/x/.a.b", ".a"), ("x/y.z/k", "k")):
        assert re.search(sources.FILE_NAME, path).group(1) == name
    began = time.perf_counter()
    assert re.search(sources.FILE_NAME, "/" + "x" * 20_000 + "/a.txt").group(1) == "a"
    assert time.perf_counter() - began < 0.5  # the square of the length took seconds
