"""Property tests (hypothesis): shards partition pieces, sub-split parts partition each
piece, epochs multiply counts, batches concatenate back, split subsets are disjoint and
cover, and distributed numbering equals a sequential numbering."""

import hashlib
import math
import sys

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainset.functions.numbering import with_row_index
from grainset.operators import batches as B
from grainset.operators import predicates as P
from grainset.operators import rowgroups as RG

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(n=st.integers(1, 120), pieces=st.integers(1, 12), shards=st.integers(1, 5))
def test_shards_cover_exactly(spark, n, pieces, shards):
    df = spark.range(n).select(F.col("id"), F.pmod(F.col("id"), F.lit(pieces)).alias("piece_id"))
    got = []
    for k in range(shards):
        got += [r["id"] for r in RG.shard(df, k, shards).collect()]
    assert sorted(got) == list(range(n))


@SETTINGS
@given(sizes=st.lists(st.integers(1, 40), min_size=1, max_size=5), parts=st.integers(1, 9))
def test_subsplit_formula(spark, sizes, parts):
    rows = [(p, i) for p, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "piece_id long, i long")
    out = RG.subsplit_parts(df, parts, ["i"]).collect()
    for r in out:
        n = sizes[r["piece_id"]]
        assert r["row_in_piece"] == r["i"]
        assert r["part"] == math.floor(r["i"] / (float(n) / min(n, parts)))
    assert len(out) == len(rows)


@SETTINGS
@given(n=st.integers(0, 200), size=st.integers(1, 50))
def test_batches_concat(spark, n, size):
    df = spark.range(n)
    b = B.batch_rows(df, size, [F.col("id")], ["id"]).orderBy("batch_id").collect()
    assert [x for r in b for x in r["id"]] == list(range(n))
    assert all(r["batch_rows"] == size for r in b[:-1])


@SETTINGS
@given(fr=st.lists(st.floats(0.0, 1.0), min_size=1, max_size=5).filter(lambda f: sum(f) > 0))
def test_split_subsets_disjoint_and_cover(spark, fr):
    total = sum(fr)
    fractions = [f / total for f in fr]
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    seen = []
    for i in range(len(fractions)):
        seen += [r["k"] for r in P.in_pseudorandom_split(fractions, i, "k").apply(df).collect()]
    assert len(seen) == len(set(seen))
    # Keys beyond the float sum of the borders may fall outside every subset (as in Python).
    borders_top = sum(fractions) * (sys.maxsize - 1)
    expect = {str(i) for i in range(300)
              if int(hashlib.md5(str(i).encode()).hexdigest(), 16) % sys.maxsize < borders_top}
    assert set(seen) == expect


@SETTINGS
@given(n=st.integers(1, 300), parts=st.integers(1, 9), dup=st.integers(1, 4))
def test_row_index_equals_sequential(spark, n, parts, dup):
    df = spark.range(n).select((F.col("id") % dup).alias("g"), F.col("id")).repartition(3)
    out = with_row_index(df, [F.col("g"), F.col("id")], "i", num_partitions=parts).collect()
    expect = {key: i for i, key in enumerate(sorted((r["g"], r["id"]) for r in out))}
    assert all(r["i"] == expect[(r["g"], r["id"])] for r in out)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ts=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40)), min_size=1, max_size=60),
       length=st.integers(1, 3), thr=st.integers(0, 6))
def test_no_overlap_distributed_equals_sequential(spark, ts, length, thr):
    from grainset.operators import sequences as SQ

    rows = [(scope, t, i) for i, (scope, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "scope int, t long, rid long")
    spec = SQ.NGram({k: ["rid"] for k in range(length)}, thr, "t", timestamp_overlap=False)
    from test_sequences import taken_windows

    got = SQ.ngram_no_overlap(df, spec, ["scope"], ["t", "rid"], bucket_rows=8).collect()
    want = taken_windows(rows, length, lambda a, b: b - a <= thr)
    assert sorted((r["scope"], r["t0"]["rid"]) for r in got) == want
