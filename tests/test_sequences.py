import pytest
from pyspark.sql import functions as F

from grainset.operators import sequences as SQ

GOLDEN_IDS = [0, 3, 8, 10, 11, 20, 23]


def _pairs(df):
    return sorted((r["t0"]["id"], r["t1"]["id"]) for r in df.collect())


def _golden(spark):
    return spark.createDataFrame([(i, i // 10) for i in GOLDEN_IDS], "id long, grp long")


def test_golden_ngram_row_group_scope(spark):
    spec = SQ.NGram({0: ["id"], 1: ["id"]}, 4, "id")
    got = _pairs(SQ.ngram(_golden(spark), spec, ["grp"], ["id"]))
    assert got == [(0, 3), (10, 11), (20, 23)]


def test_golden_ngram_single_scope(spark):
    df = _golden(spark).withColumn("one", F.lit(1))
    spec = SQ.NGram({0: ["id"], 1: ["id"]}, 4, "id")
    assert _pairs(SQ.ngram(df, spec, ["one"], ["id"])) == [(0, 3), (8, 10), (10, 11), (20, 23)]


def test_gap_is_inclusive_and_small_buckets(spark):
    df = spark.createDataFrame([(i * 2, 0) for i in range(50)], "id long, g int")
    spec = SQ.NGram({-1: ["id"], 0: ["id"], 1: ["id"]}, 2, "id")
    # Tiny buckets force windows across bucket edges to be rebuilt from the copied head rows.
    out = SQ.ngram(df, spec, ["g"], ["id"], bucket_rows=7).collect()
    assert len(out) == 48
    assert sorted(r["t_m1"]["id"] for r in out) == [i * 2 for i in range(48)]
    spec_tight = SQ.NGram({0: ["id"], 1: ["id"]}, 1.999, "id")
    assert SQ.ngram(df, spec_tight, ["g"], ["id"], bucket_rows=7).count() == 0


def test_sparse_keys_consume_rows(spark):
    df = spark.createDataFrame([(i, "x%d" % i) for i in range(6)], "id long, s string").withColumn("g", F.lit(0))
    spec = SQ.NGram({0: ["id"], 2: ["s"]}, 10, "id")
    out = SQ.ngram(df, spec, ["g"], ["id"])
    assert "t1" not in out.columns
    rows = sorted((r["t0"]["id"], r["t2"]["s"]) for r in out.collect())
    assert rows == [(0, "x2"), (1, "x3"), (2, "x4"), (3, "x5")]


def test_unsorted_raises(spark):
    df = spark.createDataFrame([(0, 5), (1, 3), (2, 9)], "pos long, ts long").withColumn("g", F.lit(0))
    spec = SQ.NGram({0: ["ts"], 1: ["ts"]}, 100, "ts")
    with pytest.raises(Exception, match="goes back"):
        SQ.ngram(df, spec, ["g"], ["pos"]).collect()


def test_no_overlap_greedy(spark):
    # Consecutive timestamps 0..5, length 3: windows (0,1,2) and (3,4,5).
    df = spark.createDataFrame([(i, 0) for i in range(6)], "id long, g int")
    spec = SQ.NGram({0: ["id"], 1: ["id"], 2: ["id"]}, 1, "id", timestamp_overlap=False)
    out = SQ.ngram_no_overlap(df, spec, ["g"], ["id"]).collect()
    assert sorted(r["t0"]["id"] for r in out) == [0, 3]
    # Equal start and previous end is rejected.
    df2 = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0)], "pos long, ts long, g int")
    spec2 = SQ.NGram({0: ["pos"], 1: ["pos"]}, 5, "ts", timestamp_overlap=False)
    out2 = SQ.ngram_no_overlap(df2, spec2, ["g"], ["pos"]).collect()
    assert sorted(r["t0"]["pos"] for r in out2) == [0]


def _brute_force(rows, length, thr):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for u, rs in by.items():
        rs.sort(key=lambda r: (r[1], r[2]))
        for i in range(len(rs) - length + 1):
            w = rs[i:i + length]
            if all((w[j + 1][1] - w[j][1]).total_seconds() <= thr for j in range(length - 1)):
                out.append(tuple(x[2] for x in w))
    return sorted(out)


def test_ngram_matches_brute_force_on_events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = [(r["user_id"], r["ts"], r["event_id"]) for r in e.collect()]
    spec = SQ.NGram({0: ["event_id"], 1: ["event_id"], 2: ["event_id"]}, 36000, "ts")
    got = SQ.ngram(e, spec, ["user_id"], ["ts", "event_id"], bucket_rows=64)
    got = sorted((r["t0"]["event_id"], r["t1"]["event_id"], r["t2"]["event_id"]) for r in got.collect())
    assert got == _brute_force(rows, 3, 36000)


def test_flatten_roundtrip(spark):
    df = spark.createDataFrame([(i, i * 1.5) for i in range(5)], "id long, v double").withColumn("g", F.lit(0))
    spec = SQ.NGram({-1: ["id", "v"], 0: ["id"]}, 10, "id")
    seq = SQ.ngram(df, spec, ["g"], ["id"])
    flat = SQ.flatten_ngram(seq, spec)
    assert {"id_0", "v_0", "id_1"} <= set(flat.columns)
    back = SQ.unflatten_ngram(flat, spec)
    assert sorted(r["t_m1"]["id"] for r in back.collect()) == sorted(r["t_m1"]["id"] for r in seq.collect())


def test_spec_validation_and_length():
    with pytest.raises(ValueError):
        SQ.NGram([1, 2], 1, "id")
    with pytest.raises(ValueError):
        SQ.NGram({0: "id"}, 1, "id")
    s = SQ.NGram({-1: ["a"], 1: ["a"]}, 1, "a")
    assert s.length == 3
    assert s.same_spec(SQ.NGram({1: ["a"], -1: ["a"]}, 5, "b"))


def test_regex_fields(spark):
    df = spark.createDataFrame([(i, i, i) for i in range(4)], "id long, id2 long, other long").withColumn("g", F.lit(0))
    spec = SQ.NGram({0: ["id.*"], 1: ["other"]}, 5, "^id$")
    out = SQ.ngram(df, spec, ["g"], ["id"])
    assert set(out.schema["t0"].dataType.fieldNames()) == {"id", "id2"}


@pytest.mark.parametrize("length,thr", [(2, 600.0), (3, 1800.0), (1, 0.0)])
def test_no_overlap_matches_sequential_scan(spark, length, thr):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("user_id", "event_id", "ts")
    # Coarse timestamps create ties, which the successor rule must skip.
    e = e.withColumn("ts", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))
    spec = SQ.NGram({k: ["event_id"] for k in range(length)}, thr, "ts", timestamp_overlap=False)
    got = SQ.ngram_no_overlap(e, spec, ["user_id"], ["ts", "event_id"], bucket_rows=512).collect()
    rows = [(r["user_id"], r["ts"], r["event_id"]) for r in e.collect()]
    want = taken_windows(rows, length, lambda a, b: (b - a).total_seconds() <= thr)
    assert sorted((r["user_id"], r["t0"]["event_id"]) for r in got) == want and want


def taken_windows(rows, length, near):
    """(scope, first key) of the greedy windows over (scope, time, key) rows."""
    out, rows = [], sorted(rows)
    for scope in sorted({r[0] for r in rows}):
        part, end = [r for r in rows if r[0] == scope], None
        for i in range(len(part) - length + 1):
            times = [r[1] for r in part[i : i + length]]
            if (end is None or times[0] > end) and all(near(a, b) for a, b in zip(times, times[1:])):
                out.append((scope, part[i][2]))
                end = times[-1]
    return sorted(out)


@pytest.mark.parametrize("kind", ["bigint", "date"])
def test_no_overlap_keeps_the_time_type(spark, kind):
    import datetime as dt

    base = 1_700_000_000_000_000_001 if kind == "bigint" else dt.date(2024, 1, 1)
    step = 10 if kind == "bigint" else dt.timedelta(days=1)
    df = spark.createDataFrame([("a", base + i * step, i) for i in range(6)], f"g string, t {kind}, rid long")
    spec = SQ.NGram({0: ["rid"], 1: ["rid"]}, 10 if kind == "bigint" else 1, "t", timestamp_overlap=False)
    assert SQ.ngram_no_overlap(df, spec, ["g"], ["t", "rid"]).count() == 3
