"""Epochs, reproducible shuffles, weighted mixing, capped samples and shuffle quality.

Every random choice is an md5 of (seed, epoch, stable key), so a re-run, a
re-partitioned plan or a recomputed task after an executor loss produce the same
order. Global positions come from distributed prefix numbering, never from a
single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, order_key
from ..functions.numbering import with_dense_group_rank, with_group_row_index, with_row_index, with_running_sum
from ..session import broadcast_if_small
from .rowgroups import subsplit_parts


def with_epochs(df: DataFrame, num_epochs: int, name: str = "epoch") -> DataFrame:
    """Repeat every row ``num_epochs`` times with an ``epoch`` column (0-based).

    The epoch table has ``num_epochs`` rows (a user parameter, not data), so it is broadcast.
    """
    if not isinstance(num_epochs, int) or isinstance(num_epochs, bool) or num_epochs < 1:
        raise ValueError("num_epochs must be a positive integer (None means infinite: use streaming.epochs)")
    epochs = df.sparkSession.range(num_epochs).select(F.col("id").cast("int").alias(name))
    return df.crossJoin(F.broadcast(epochs))


def read_order(
    df: DataFrame,
    row_key: list[str],
    piece_col: str = "piece_id",
    epoch_col: str | None = "epoch",
    shuffle_pieces: bool = False,
    shuffle_rows: bool = False,
    seed: int = 0,
    part_col: str | None = None,
) -> list[Column]:
    """Sort key of the read order.

    Unshuffled: (epoch, piece, row key). Shuffled pieces: the piece order (or the
    (piece, part) order with sub-splits) is re-drawn per epoch from md5(seed, epoch, piece).
    Shuffled rows: inside each piece, rows are ordered by md5(seed, epoch, row key).
    """
    ep = [F.col(epoch_col)] if epoch_col else []
    unit = [F.col(piece_col)] + ([F.col(part_col)] if part_col else [])
    key = list(ep)
    if shuffle_pieces:
        key.append(order_key(seed, *ep, *unit))
    key.extend(unit)
    if shuffle_rows:
        key.append(order_key(seed, *ep, *[F.col(c) for c in row_key]))
    key.extend(F.col(c) for c in row_key)
    return key


def ordered_positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Global 0-based position of every row under ``order`` (distributed)."""
    return with_row_index(df, order, name)


def piece_positions(
    df: DataFrame,
    row_key: list[str],
    num_epochs: int = 1,
    piece_col: str = "piece_id",
    part_col: str | None = None,
    shuffle_pieces: bool = False,
    shuffle_rows: bool = False,
    seed: int = 0,
    name: str = "position",
    rank_col: str | None = None,
) -> DataFrame:
    """Every row once per epoch with ``epoch`` and its 0-based position in ``read_order``.

    No global sort of rows: only the list of pieces (one row per piece, part and epoch) is
    put in order, giving each piece its first position; a row adds its index inside the
    piece, from a window over that piece alone (pieces are bounded by the row-group or block
    size). Unshuffled rows are indexed once, whatever the number of epochs. With ``rank_col``
    the rows are there once per epoch already (``shuffled_parts``) and have that order inside
    their piece; rows may be missing.
    """
    if not isinstance(num_epochs, int) or isinstance(num_epochs, bool) or num_epochs < 1:
        raise ValueError("num_epochs must be a positive integer (None means infinite: use streaming.epochs)")
    unit = [piece_col] + ([part_col] if part_col else [])
    key = [F.col(c) for c in row_key]
    if rank_col:
        starts = df.groupBy(*unit, "epoch").agg(F.count(F.lit(1)).alias("__n"))
    else:
        starts = with_epochs(df.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n")), num_epochs)
    draw = [order_key(seed, F.col("epoch"), *[F.col(c) for c in unit])] if shuffle_pieces else []
    starts = with_running_sum(starts, [F.col("epoch"), *draw, *map(F.col, unit)], "__n", "__start").drop("__n")
    if rank_col:
        inside = Window.partitionBy(*unit, "epoch").orderBy(rank_col)
        rows = df.withColumn("__i", F.row_number().over(inside) - 1)
    elif shuffle_rows:
        rows = with_epochs(df, num_epochs)
        inside = Window.partitionBy(*unit, "epoch").orderBy(order_key(seed, F.col("epoch"), *key), *key)
        rows = rows.withColumn("__i", F.row_number().over(inside) - 1)
    else:
        inside = Window.partitionBy(*unit).orderBy(*key)
        rows = with_epochs(df.withColumn("__i", F.row_number().over(inside) - 1), num_epochs)
    out = rows.join(broadcast_if_small(starts, measure=True), [*unit, "epoch"])
    kept = [c for c in df.columns if not (rank_col and c == "epoch")]
    return out.select(*kept, "epoch", (F.col("__start") + F.col("__i")).alias(name))


def shuffled_parts(
    df: DataFrame,
    parts: int,
    row_key: list[str],
    num_epochs: int = 1,
    seed: int = 0,
    overlap: int = 0,
    piece_col: str = "piece_id",
    index_name: str = "row_in_piece",
    part_name: str = "part",
) -> DataFrame:
    """Every row once per epoch and part that it is in. The rows of a piece are shuffled first
    (``index_name`` is their place in the epoch's order) and the shuffled piece is cut into
    parts, so what is in a part changes with the seed and the epoch; all parts of an epoch are
    the table. ``overlap`` repeats rows of the next parts as in ``subsplit_parts``, in the
    shuffled order too."""
    rows = with_epochs(df, num_epochs)
    key = [F.col(c) for c in row_key]
    order = [order_key(seed, F.col("epoch"), *key), *key]
    return subsplit_parts(rows, parts, order, [piece_col, "epoch"], overlap, index_name, part_name)


TOP_ROWS = 100_000  # above, the first rows come from a range sort instead of one top-k task


def capped_sample(df: DataFrame, order: list[str], rows_capacity: int, num_epochs: int, seed: int,
                  shuffle: bool = True) -> DataFrame:
    """First ``rows_capacity`` rows (by ``order``), repeated for ``num_epochs``, each epoch
    permuted by md5(seed + epoch, key). Output adds ``epoch`` and ``position`` (in epoch)."""
    if rows_capacity <= TOP_ROWS:
        head = df.orderBy(*order).limit(rows_capacity)
    else:
        head = with_row_index(df, order, "__place").where(F.col("__place") < rows_capacity).drop("__place")
    rep = with_epochs(head, num_epochs)
    if shuffle:
        key = [F.col("epoch"), order_key(F.lit(seed) + F.col("epoch"), *[F.col(c) for c in order])]
    else:
        key = [F.col("epoch")]
    key += [F.col(c) for c in order]
    return with_group_row_index(rep, ["epoch"], key[1:], "position")


def shuffle_quality(df: DataFrame, id_col: str, runs: int = 5, seed: int = 0) -> DataFrame:
    """Mean and population std of |corr(original position, shuffled position)| over runs.

    The original position is the rank of ``id_col``; run r shuffles by md5(seed + r, id).
    """
    base = with_row_index(df.select(id_col), [F.col(id_col)], "orig_pos")
    rep = base.crossJoin(F.broadcast(df.sparkSession.range(runs).select(F.col("id").cast("int").alias("run"))))
    rep = rep.withColumn("__k", order_key(F.lit(seed) + F.col("run"), F.col(id_col)))
    shuffled = with_group_row_index(rep, ["run"], [F.col("__k"), F.col(id_col)], "shuf_pos")
    shuffled = shuffled.select("run", "orig_pos", "shuf_pos")
    per_run = shuffled.groupBy("run").agg(F.corr(F.col("orig_pos").cast("double"),
                                                  F.col("shuf_pos").cast("double")).alias("c"))
    return per_run.agg(
        F.round(F.avg(F.abs("c")), 6).alias("mean_abs_corr"),
        F.round(F.stddev_pop(F.abs("c")), 6).alias("std_abs_corr"),
    )


def weighted_mix(sources: list[DataFrame], probabilities: list[float], order_cols: list[list[str]],
                 seed: int = 0, specs: list | None = None) -> DataFrame:
    """Interleave same-schema sources: draw d picks source i when u(d) < cum_i
    (normalised cumulative probabilities, u = md5-uniform of (seed, d)) and takes that
    source's next row; output stops at the first draw whose source is exhausted.

    Output: ``draw``, ``source``, ``k`` (1-based row number within the source) and the
    source columns. All steps are distributed: draw numbering per source uses prefix
    numbering, not one window per source. ``specs``: the NGram spec of each source when they
    hold sequences; differing specs are an error.
    """
    if len(sources) < 2:
        raise ValueError("at least two sources are needed")
    if len(sources) != len(probabilities):
        raise ValueError("one probability per source")
    if specs is not None and not (len(specs) == len(sources) and all(specs[0].same_spec(s) for s in specs[1:])):
        raise ValueError("sources of sequences must share one sequence spec")
    cols = sources[0].columns
    for s in sources[1:]:
        if set(s.columns) != set(cols):
            raise ValueError("all sources must have the same columns")
    total_p = float(sum(probabilities))
    cum, acc = [], 0.0
    for p in probabilities:
        acc += p / total_p
        cum.append(acc)
    spark = sources[0].sparkSession
    if all(list(oc) == list(order_cols[0]) for oc in order_cols):
        # One numbering pass over all sources (grouped by source).
        tagged = sources[0].select(F.lit(0).alias("source"), *cols)
        for i, s in enumerate(sources[1:], start=1):
            tagged = tagged.unionByName(s.select(F.lit(i).alias("source"), *cols))
        rows = with_group_row_index(tagged, ["source"], [F.col(c) for c in order_cols[0]], "__r")
        rows = rows.select("source", (F.col("__r") + 1).alias("k"), *cols)
    else:
        numbered = []
        for i, (s, oc) in enumerate(zip(sources, order_cols)):
            n = with_row_index(s.select(*cols), [F.col(c) for c in oc], "__r")
            numbered.append(n.select(F.lit(i).alias("source"), (F.col("__r") + 1).alias("k"), *cols))
        rows = numbered[0]
        for n in numbered[1:]:
            rows = rows.unionByName(n)
    # One row per source: collecting the counts is metadata-sized.
    counts = {r["source"]: r["__n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).collect()}
    sizes = spark.createDataFrame([(i, counts.get(i, 0)) for i in range(len(sources))], "source int, __n bigint")
    # Enough draws: after sum(n) successful draws some source is exhausted.
    draws = spark.range(sum(counts.values()) + 1).select(F.col("id").alias("draw"))
    u = hash_uniform(seed, F.col("draw"))
    pick = None
    for i, c in enumerate(cum):
        cond = u < F.lit(c) if i < len(cum) - 1 else F.lit(True)
        pick = F.when(cond, F.lit(i)) if pick is None else pick.when(cond, F.lit(i))
    draws = draws.withColumn("source", pick)
    # Draws are a pure function of the dense draw id: rank per source without a checkpoint.
    kd = with_dense_group_rank(draws, "draw", "source", "__k").withColumn("k", F.col("__k") + 1)
    kd = kd.join(F.broadcast(sizes), "source")  # one row per source
    stop = kd.filter(F.col("k") > F.col("__n")).agg(F.min("draw").alias("__stop"))
    kept = kd.crossJoin(F.broadcast(stop)).filter(F.col("__stop").isNull() | (F.col("draw") < F.col("__stop")))
    out = kept.select("draw", "source", "k").join(rows, ["source", "k"])
    return out.select("draw", "source", "k", *cols)


def shuffled_batches(df: DataFrame, batch_size: int, row_key: list[str], seed: int = 0,
                     columns: list[str] | None = None, full_only: bool = False) -> DataFrame:
    """Batches of the whole table in the seeded order md5(seed, row key), the key breaking ties."""
    from .batches import batch_rows

    keys = [F.col(c) for c in row_key]
    return batch_rows(df, batch_size, [order_key(seed, *keys), *keys], columns or df.columns, full_only=full_only)
