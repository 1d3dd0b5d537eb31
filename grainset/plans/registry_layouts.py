"""More registered queries: shuffled sub-splits, collated batches, large value sets, indexes with
a state, ordered files, resumed epochs. Same rules as ``registry``: whole driver tables, DuckDB
SQL beside."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import predicates as P
from ..operators import projection as PJ
from ..operators import rowgroups as RG
from ..operators import sampling as X
from ..operators import sequences as SQ
from ..session import shared_table_path, table
from ..sources import catalog as CAT
from ..sources import metrics as M
from ..sources import writer as W
from ..sources.schema import infer_fields
from ..streaming.epochs import epochs_to_table, infinite_epochs
from .reader import DatasetSpec, read_dataset
from .registry import _PIECE_SQL, SEED, _md5_sql, events_index, events_pieces, register, stored_events_index

# ---------------------------------------------------------------- shuffled sub-splits

_SHUFFLED = f"""
    WITH e AS (SELECT event_id, {_PIECE_SQL} AS piece_id, CAST(range AS INTEGER) AS epoch FROM events, range(2)),
    r AS (SELECT *, row_number() OVER (PARTITION BY epoch, piece_id ORDER BY {_md5_sql('epoch', 'event_id')}, event_id) - 1 AS i,
                 count(*) OVER (PARTITION BY epoch, piece_id) AS n FROM e)"""


@register(
    "shuffle_before_subsplit",
    _SHUFFLED
    + f""",
    p AS (SELECT *, CAST(floor(i / (n / least(n, 3.0))) AS INTEGER) AS part FROM r)
    SELECT event_id, piece_id, i AS row_in_piece, part, epoch,
           row_number() OVER (ORDER BY epoch, {_md5_sql('epoch', 'piece_id', 'part')}, piece_id, part, i) - 1 AS position
    FROM p""",
)
def q_shuffle_before_subsplit(spark, sf):
    e = events_pieces(spark, sf).select("event_id", "piece_id")
    parts = X.shuffled_parts(e, 3, ["event_id"], num_epochs=2, seed=SEED)
    return X.piece_positions(parts, ["event_id"], 2, part_col="part", shuffle_pieces=True, seed=SEED, rank_col="row_in_piece")


@register(
    "shuffle_before_subsplit_overlap",
    _SHUFFLED
    + f""",
    p AS (SELECT *, CAST(unnest(generate_series(CAST(floor(greatest(i - 2, 0) / (n / least(n, 3.0))) AS INTEGER),
                                                CAST(floor(i / (n / least(n, 3.0))) AS INTEGER))) AS INTEGER) AS part FROM r)
    SELECT event_id, piece_id, i AS row_in_piece, part, epoch,
           row_number() OVER (ORDER BY epoch, piece_id, part, i) - 1 AS position
    FROM p""",
)
def q_shuffle_before_subsplit_overlap(spark, sf):
    e = events_pieces(spark, sf).select("event_id", "piece_id")
    parts = X.shuffled_parts(e, 3, ["event_id"], num_epochs=2, seed=SEED, overlap=2)
    return X.piece_positions(parts, ["event_id"], 2, part_col="part", seed=SEED, rank_col="row_in_piece")


# ---------------------------------------------------------------- collated batches


@register(
    "collate_sequences",
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS g FROM events),
    w AS (SELECT s0.g, s0.event_id AS e0, s0.value AS v0, s1.event_id AS e1, s1.event_type AS k1, s2.event_id AS e2
          FROM e s0 JOIN e s1 ON s1.g = s0.g + 1 AND s1.user_id = s0.user_id
                    JOIN e s2 ON s2.g = s0.g + 2 AND s2.user_id = s0.user_id
          WHERE date_diff('microsecond', s0.ts, s1.ts) <= 21600000000
            AND date_diff('microsecond', s1.ts, s2.ts) <= 21600000000),
    b AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS p FROM w)
    SELECT p // 16 AS batch_id, CAST(count(*) AS INTEGER) AS batch_rows, list(e0 ORDER BY p) AS e0, list(v0 ORDER BY p) AS v0,
           list(e1 ORDER BY p) AS e1, list(k1 ORDER BY p) AS k1, list(e2 ORDER BY p) AS e2
    FROM b GROUP BY 1""",
)
def q_collate_sequences(spark, sf):
    spec = SQ.NGram({-1: ["event_id", "value"], 0: ["event_id", "event_type"], 1: ["event_id"]}, 21600, "ts")
    seq = SQ.ngram(table(spark, sf, "events"), spec, ["user_id"], ["ts", "event_id"])
    steps = ["t_m1", "t0", "t1"]
    out = B.collate(B.batch_rows(seq, 16, ["start_pos"], steps), steps)
    return out.select(
        "batch_id", "batch_rows", F.col("t_m1.event_id").alias("e0"), F.col("t_m1.value").alias("v0"),
        F.col("t0.event_id").alias("e1"), F.col("t0.event_type").alias("k1"), F.col("t1.event_id").alias("e2"))


@register(
    "collate_decimals",
    """WITH l AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS price, l_returnflag AS flag,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_extendedprice AS DECIMAL(14,2)), l_returnflag) - 1 AS step,
                     count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    o AS (SELECT l_orderkey, n, (row_number() OVER (ORDER BY l_orderkey) - 1) // 4 AS batch_id FROM l WHERE step = 0),
    k AS (SELECT batch_id, min(n) AS steps FROM o GROUP BY 1)
    SELECT o.batch_id, CAST(l.step AS INTEGER) AS step, list(l.price ORDER BY l.l_orderkey) AS price,
           list(l.flag ORDER BY l.l_orderkey) AS flag
    FROM l JOIN o ON l.l_orderkey = o.l_orderkey JOIN k ON k.batch_id = o.batch_id WHERE l.step < k.steps GROUP BY 1, 2""",
)
def q_collate_decimals(spark, sf):
    line = F.struct("l_linenumber", F.col("l_extendedprice").cast("decimal(14,2)").alias("price"), F.col("l_returnflag").alias("flag"))
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    out = B.collate(B.batch_rows(orders, 4, ["l_orderkey"], ["lines"]))
    steps = out.select("batch_id", F.posexplode("lines").alias("step", "line"))
    return steps.select("batch_id", "step", F.col("line.price").alias("price"), F.col("line.flag").alias("flag"))


# ---------------------------------------------------------------- values, indexes, files


@register(
    "overlap_large_set",
    """WITH b AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark)
    SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents
    WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)
                     WHERE w IN (SELECT w FROM b))""",
)
def q_overlap_large_set(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    wanted = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return P.overlap_with(docs, "words", wanted).select("doc_id", F.size("words").cast("bigint").alias("n_words"))



@register(
    "range_index_rows",
    f"""WITH e AS (SELECT *, {_PIECE_SQL} AS piece_id FROM events),
    mid AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM events),
    p AS (SELECT piece_id FROM e, mid GROUP BY piece_id, t HAVING max(ts) >= t AND min(ts) <= t + INTERVAL 1 DAY)
    SELECT e.event_id, e.piece_id FROM e JOIN p USING (piece_id)""",
)
def q_range_index_rows(spark, sf):
    # The index is built in two parts, as for rows that came later, and merged.
    e = events_pieces(spark, sf).select("event_id", "piece_id", "ts")
    indexer = RG.RangeIndexer("ts", "ts")
    halves = [RG.build_state_index(e.where(F.col("event_id") % 2 == k), indexer) for k in (0, 1)]
    path = shared_table_path(spark, "index-")
    RG.write_state_index(RG.merge_state_indexes(indexer, *halves), indexer, path)
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    start = low + (high - low) / 2
    selector = RG.StateIndexSelector(indexer, (start, start + dt.timedelta(days=1)), RG.read_state_index(spark, indexer, path))
    return RG.select_pieces(e, selector.state, selector).select("event_id", "piece_id")


@register(
    "ordered_files",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders""",
)
def q_ordered_files(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    path = shared_table_path(spark, "ordered-")
    W.write_in_order(o, path, [F.desc("o_totalprice"), F.asc("o_orderkey")], 7)
    return W.read_in_order(spark, path)


@register(
    "epochs_resumed",
    """SELECT event_id, user_id, CAST(range AS INTEGER) AS epoch FROM events, range(3)""",
)
def q_epochs_resumed(spark, sf):
    # Two epochs, a stop, and a second query that goes on from the first one's checkpoint.
    path, checkpoint = shared_table_path(spark, "epochs-"), shared_table_path(spark, "epochs-state-")
    e = table(spark, sf, "events").select("event_id", "user_id")
    for epochs in (2, 3):
        epochs_to_table(infinite_epochs(spark, e), path, epochs, checkpoint)
    return spark.read.parquet(path).select("event_id", "user_id", "epoch")


# ---------------------------------------------------------------- growing datasets and stores


@register(
    "appended_dataset",
    """SELECT event_id, user_id, event_type, event_id % 3 = 0 AS came_later FROM events""",
)
def q_appended_dataset(spark, sf):
    # Stamped, appended to, brought up to date: only the new files' footers are read.
    path = shared_table_path(spark, "grown-")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    first = W.materialize_dataset(e.where("event_id % 3 <> 0"), path).agg(F.max("piece_id")).first()[0]
    e.where("event_id % 3 = 0").write.mode("append").parquet(path)
    W.update_catalog(spark, path)
    url = path if "://" in path or path.startswith("file:") else f"file://{path}"
    rows = read_dataset(spark, DatasetSpec(url, global_positions=False))
    return rows.select("event_id", "user_id", "event_type", (F.col("piece_id") > first).alias("came_later"))


@register(
    "appended_catalog",
    """SELECT event_id % 3 = 0 AS came_later, count(*) AS catalogued, count(*) AS held, 0 AS gone FROM events GROUP BY 1""",
)
def q_appended_catalog(spark, sf):
    # Row totals of the catalogued pieces against the rows found in them.
    path = shared_table_path(spark, "grown-")
    e = table(spark, sf, "events").select("event_id")
    first = W.materialize_dataset(e.where("event_id % 3 <> 0"), path).agg(F.max("piece_id")).first()[0]
    e.where("event_id % 3 = 0").write.mode("append").parquet(path)
    gone = W.update_catalog(spark, path).gone_files
    catalog = W.load_catalog(spark, path)
    held = CAT.attach_pieces(spark.read.parquet(path), catalog).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"))
    both = catalog.join(held, "piece_id", "full").groupBy((F.col("piece_id") > first).alias("came_later"))
    return both.agg(F.sum("num_rows").alias("catalogued"), F.sum("n").alias("held"), F.lit(gone).alias("gone"))


@register(
    "record_store",
    """SELECT CAST(o_orderkey AS VARCHAR) AS commit_hash, o_orderpriority AS author, CAST(o_orderkey % 50 AS BIGINT) AS comment_lines,
              CAST(o_custkey AS BIGINT) AS total_changed_files_comments,
              CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS run FROM orders""",
)
def q_record_store(spark, sf):
    # Two runs over a work list: the second measures only what the first has not stored.
    path = shared_table_path(spark, "store-")
    orders = table(spark, sf, "orders")
    keys = F.col("o_orderkey").cast("string")
    orders.select(F.concat(F.lit("  "), keys).alias("value")).write.text(f"{path}/work")
    record = orders.select(
        keys.alias("commit_hash"), F.col("o_orderpriority").alias("author"), F.lit("2020-01-02T03:04:05+00:00").alias("date"),
        F.struct((F.col("o_orderkey") % 50).cast("string").alias("comment_lines")).alias("overall_comment_metrics"),
        F.col("o_custkey").cast("string").alias("total_changed_files_comments"))
    M.write_record_store(record.where(F.col("commit_hash").cast("bigint") % 3 != 0), path, run="first")
    pending = M.pending_keys(M.read_work_list(spark, f"{path}/work"), M.store_keys(spark, path))
    M.write_record_store(record.join(pending, F.col("commit_hash") == F.col("key"), "left_semi"), path, run="second")
    records = M.read_record_store(spark, path).drop("key")
    # The cleaning step keeps its own columns: the run is joined to them by key.
    clean = M.clean_metric_records(M.parse_metric_records(records.drop("run")))
    runs = M.store_keys(spark, path).withColumnRenamed("key", "commit_hash")
    return clean.join(runs, "commit_hash").select("commit_hash", "author", "comment_lines", "total_changed_files_comments", "run")


# ---------------------------------------------------------------- materialised paths, inference


@register(
    "converter_path_batches",
    """WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT i // 32 AS batch_id, CAST(count(*) AS INTEGER) AS batch_rows, list(o_orderkey ORDER BY i) AS o_orderkey,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM p GROUP BY 1""",
)
def q_converter_path_batches(spark, sf):
    # A converter over files that are there already; the batch hook adds each batch's total.
    path = shared_table_path(spark, "ready-")
    W.write_in_order(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, ["o_orderkey"], 5)
    made = W.make_converter(path, spark=spark)

    def hook(batches):
        cents = F.transform("o_totalprice", lambda x: F.round(x * 100).cast("bigint"))
        return batches.withColumn("cents", F.aggregate(cents, F.lit(0).cast("bigint"), lambda a, x: a + x))

    return made.batches(spark, 32, hook=hook).drop("o_totalprice")


@register(
    "converter_deleted",
    """SELECT o_orderpriority, count(*) AS n, true AS held, false AS held_after, true AS made_again FROM orders GROUP BY 1""",
)
def q_converter_deleted(spark, sf):
    # A materialisation that is deleted is made again, in another place.
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    before = spark.conf.get(W.CACHE_DIR_CONF, None)
    parent = shared_table_path(spark, "converter-")
    spark.conf.set(W.CACHE_DIR_CONF, parent if "://" in parent or parent.startswith("file:") else f"file://{parent}")
    try:
        first = W.make_converter(o)
        held = W.path_exists(spark, first.cache_dir_url)
        first.delete(spark)
        after = W.path_exists(spark, first.cache_dir_url)
        again = W.make_converter(o)
    finally:
        spark.conf.unset(W.CACHE_DIR_CONF) if before is None else spark.conf.set(W.CACHE_DIR_CONF, before)
    counts = again.read(spark).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "o_orderpriority", "n", F.lit(held).alias("held"), F.lit(after).alias("held_after"),
        F.lit(again.cache_dir_url != first.cache_dir_url and len(again) > 0).alias("made_again"))


@register(
    "inferred_columns",
    """SELECT 'l_orderkey' AS name, 'int64' AS dtype, count(l_orderkey) AS n FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'str', count(l_returnflag) FROM lineitem
    UNION ALL SELECT 'l_quantity', 'float64', count(l_quantity) FROM lineitem
    UNION ALL SELECT 'flags', 'str[]', count(*) FROM lineitem""",
)
def q_inferred_columns(spark, sf):
    # Fields inferred from the files' schema, with the rows that hold a value; a struct is left out.
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_quantity", F.array("l_returnflag", "l_linestatus").alias("flags"),
        F.struct("l_orderkey").alias("nested"))
    path = shared_table_path(spark, "plain-")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    fields = infer_fields(rows.schema, strict_compat=True)
    counts = rows.agg(*[F.count(f.name).alias(f.name) for f in fields])
    entry = lambda f: F.struct(F.lit(f.name).alias("name"), F.lit(f.dtype + "[]" * len(f.shape)).alias("dtype"), F.col(f.name).alias("n"))
    return counts.select(F.inline(F.array(*map(entry, fields))))


# ---------------------------------------------------------------- errors as rows


def _refused(make) -> str:
    """'refused: <start of the message>' of an error that ``make`` raises, else 'taken'."""
    try:
        make()
    except (ValueError, NotImplementedError) as exc:
        return f"refused: {str(exc)[:24]}"
    return "taken"


@register(
    "refused_requests",
    """SELECT event_type, count(*) AS n, 'refused: No fields matched the cr' AS no_field,
              'refused: timestep keys must be in' AS bad_window, 'refused: windows without overlap ' AS bad_mix, 'taken' AS good_window
       FROM events GROUP BY 1""",
)
def q_refused_requests(spark, sf):
    e = table(spark, sf, "events")
    url = f"{sf}/events.parquet"
    url = url if "://" in url else f"file://{url}"
    window = lambda **kw: SQ.NGram({0: ["event_id"], 1: ["event_id"]}, 10, "ts", **kw)
    verdicts = {
        "no_field": _refused(lambda: PJ.select_fields(e, ["nothing_.*"])),
        "bad_window": _refused(lambda: SQ.NGram({"0": ["event_id"]}, 10, "ts")),
        "bad_mix": _refused(lambda: read_dataset(
            spark, DatasetSpec(url, ngram=window(timestamp_overlap=False), shuffle_row_drop_partitions=2, block_rows=100))),
        "good_window": _refused(lambda: window()),
    }
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.lit(v).alias(k) for k, v in verdicts.items()])


@register(
    "unsorted_users",
    """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts < before) > 0 AS refused FROM o""",
)
def q_unsorted_users(spark, sf):
    # Sequences in the order of ids: an error if any user's time goes back.
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    spec = SQ.NGram({0: ["event_id"], 1: ["event_id"]}, 1e15, "ts")
    try:
        SQ.ngram(e, spec, ["user_id"], ["event_id"]).agg(F.count("start_pos")).collect()
        refused = False
    except PySparkException as exc:
        if "goes back in time" not in str(exc):
            raise
        refused = True
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(refused).alias("refused"))


@register(
    "stored_index_listing",
    """SELECT event_type, count(*) AS n_rows, true AS all_listed, true AS no_other FROM events GROUP BY 1""",
)
def q_stored_index_listing(spark, sf):
    # The piece ids that the metadata report lists for each value, against the rows in the pieces.
    path = shared_table_path(spark, "indexed-")
    W.materialize_dataset(table(spark, sf, "events").select("event_id", "event_type").repartition(6, "event_id"), path)
    W.build_dataset_indexes(spark, path, [RG.SingleFieldIndexer("by_type", "event_type"), RG.SingleFieldIndexer("by_id", "event_id")])
    listing = W.metadata_report(spark, path, skip_indexes=["by_id"], list_pieces=True)[1]
    listed = listing.select(F.col("value").alias("event_type"), F.explode("piece_ids").alias("piece_id"), F.lit(True).alias("listed"))
    rows = CAT.attach_pieces(spark.read.parquet(path), W.load_catalog(spark, path))
    held = rows.groupBy("event_type", "piece_id").agg(F.count(F.lit(1)).alias("n"))
    return held.join(listed, ["event_type", "piece_id"], "full").groupBy("event_type").agg(
        F.sum("n").alias("n_rows"), F.every(F.col("listed").isNotNull()).alias("all_listed"), F.every(F.col("n").isNotNull()).alias("no_other"))


# ---------------------------------------------------------------- postings, pruned files

_POSTINGS = f"""
    WITH e AS (SELECT event_type, user_id, value, {_PIECE_SQL} AS piece_id FROM events)"""


@register(
    "index_postings",
    _POSTINGS
    + """,
    v AS (SELECT 'by_user' AS index_name, CAST(user_id AS VARCHAR) AS value, piece_id FROM e WHERE user_id IS NOT NULL
          UNION ALL SELECT 'by_type', event_type, piece_id FROM e WHERE event_type IS NOT NULL
          UNION ALL SELECT 'big_error', '*', piece_id FROM e WHERE event_type = 'error' AND value > 45),
    w AS (SELECT index_name, value, piece_id // 64 AS word, sum(DISTINCT CAST(1 AS HUGEINT) << CAST(piece_id % 64 AS INTEGER)) AS s
          FROM v GROUP BY 1, 2, 3)
    SELECT index_name, value, word,
           CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS bits FROM w""",
)
def q_index_postings(spark, sf):
    # Built in two parts, as for rows that came later, and merged: one long for 64 pieces.
    return RG.merge_indexes(*[events_index(spark, sf, f"event_id % 2 = {k}") for k in (0, 1)])


@register(
    "select_tree",
    _POSTINGS
    + """,
    u AS (SELECT piece_id FROM e WHERE user_id IN (3, 5) UNION SELECT piece_id FROM e WHERE event_type = 'error' AND value > 45),
    r AS (SELECT piece_id FROM e GROUP BY 1 HAVING max(value) >= 20 AND min(value) <= 200)
    SELECT piece_id, count(*) AS n_rows FROM e
    WHERE piece_id IN (SELECT piece_id FROM u INTERSECT SELECT piece_id FROM r
                       INTERSECT (SELECT piece_id FROM e WHERE user_id IN (7, 11) UNION SELECT piece_id FROM e WHERE user_id = 3))
    GROUP BY 1""",
)
def q_select_tree(spark, sf):
    # Values and a state index in one tree of selectors: one aggregate over both, no joins between.
    e = events_pieces(spark, sf)
    index = stored_events_index(spark, sf)
    ranges = RG.RangeIndexer("value", "value")
    user = lambda *v: RG.SingleIndexSelector("by_user", v)
    tree = RG.IntersectIndexSelector([
        RG.UnionIndexSelector([user(3, 5), RG.SingleIndexSelector("big_error", ["*"])]),
        RG.StateIndexSelector(ranges, (20, 200), RG.build_state_index(e, ranges)),
        RG.UnionIndexSelector([user(7, 11), user(3)]),
    ])
    return RG.select_pieces(e, index, tree).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "select_pruned_files",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 40 AS bucket FROM orders)
    SELECT o_orderkey, o_custkey, o_totalprice, bucket FROM o
    WHERE bucket IN (SELECT bucket FROM o WHERE o_custkey IN (1, 2, 4))""",
)
def q_select_pruned_files(spark, sf):
    # A dataset of 40 files: the reader opens those that hold a selected row group.
    path = shared_table_path(spark, "files-")
    bucketed = table(spark, sf, "orders").withColumn("bucket", F.col("o_orderkey") % 40)
    bucketed.repartition("bucket").write.partitionBy("bucket").parquet(path)
    W.stamp_metadata(spark, path)
    W.build_dataset_indexes(spark, path, [RG.SingleFieldIndexer("by_customer", "o_custkey")])
    spec = DatasetSpec(path if ":/" in path else f"file://{path}", selector=RG.SingleIndexSelector("by_customer", [1, 2, 4]),
                       index_path=f"{path}/{W.SIDE_DIR}/index", global_positions=False)
    return read_dataset(spark, spec).select("o_orderkey", "o_custkey", "o_totalprice", F.col("bucket").cast("bigint").alias("bucket"))
