"""Sliding and non-overlapping event sequences (n-grams).

An n-gram spec maps integer timestep keys to field lists; its length is
``max(key) - min(key) + 1`` consecutive rows of one *scope* (a row group, or any
key such as a user id), in the scope's row order. A window is kept when every
adjacent timestamp gap is ``<= delta_threshold`` (inclusive). Keys without fields
still consume a row.

Scalable plan (no task ever holds a whole scope): rows get a global position
under (scope, order) by distributed prefix numbering; positions are cut into
fixed-size buckets and the first ``L-1`` rows of each bucket are copied into the
previous bucket, so every window lies inside one bucket. ``lead`` over the bucket
builds the window; windows that cross a scope boundary are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import with_row_index
from ..session import broadcast_if_small, reliable_checkpoint
from ..operators.batches import in_order
from ..operators.projection import resolve_fields

BUCKET_ROWS = 1 << 16  # rows per window bucket; L-1 head rows are copied per bucket


def _key_name(k: int) -> str:
    return f"t{k}" if k >= 0 else f"t_m{-k}"


@dataclass
class NGram:
    fields: dict
    delta_threshold: float
    timestamp_field: str
    timestamp_overlap: bool = True

    def __post_init__(self):
        if not isinstance(self.fields, dict):
            raise ValueError("fields must be a dict of timestep -> list of fields")
        for k, v in self.fields.items():
            if not isinstance(k, int):
                raise ValueError("timestep keys must be integers")
            if not isinstance(v, list):
                raise ValueError("each timestep must map to a list of fields")
        if not isinstance(self.delta_threshold, (int, float)):
            raise ValueError("delta_threshold must be a number")
        if not isinstance(self.timestamp_overlap, bool):
            raise ValueError("timestamp_overlap must be a boolean")
        if not self.fields:
            raise ValueError("fields must not be empty")

    @property
    def length(self) -> int:
        return max(self.fields) - min(self.fields) + 1

    @property
    def base_key(self) -> int:
        return min(self.fields)

    def resolve(self, columns: list[str]) -> "NGram":
        """Resolve regexes in field lists and the timestamp field against ``columns``."""
        fields = {k: resolve_fields(columns, v) if v else [] for k, v in self.fields.items()}
        ts = resolve_fields(columns, [self.timestamp_field])
        if len(ts) != 1:
            raise ValueError(f"{self.timestamp_field!r} names {len(ts)} columns: one time column is needed")
        return NGram(fields, self.delta_threshold, ts[0], self.timestamp_overlap)

    def fields_at(self, key: int) -> list[str]:
        return list(self.fields.get(key, []))

    def all_fields(self) -> list[str]:
        out = []
        for k in sorted(self.fields):
            for f in self.fields[k]:
                if f not in out:
                    out.append(f)
        return out

    def same_spec(self, other: "NGram") -> bool:
        return set(self.fields) == set(other.fields) and all(
            set(self.fields[k]) == set(other.fields[k]) for k in self.fields
        )


def _gap(ts_type, later: Column, earlier: Column) -> Column:
    if isinstance(ts_type, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_diff("MICROSECOND", earlier, later).cast("double") / F.lit(1e6)
    if isinstance(ts_type, T.DateType):
        return F.datediff(later, earlier).cast("double")
    return (later - earlier).cast("double")


def _windows(df: DataFrame, length: int, scope: list[str], order: list, carry: list[str],
             bucket_rows: int, position_col: str | None = None) -> DataFrame:
    """One row per window start: ``__s{j}`` structs of ``carry`` for j = 0..L-1 and a
    flag telling whether all L rows exist in the same scope."""
    if position_col is not None:
        # A dense global position, contiguous per scope (e.g. the reader's ``position``).
        needed = list(dict.fromkeys([*scope, *carry]))
        pos = df.select(*needed, F.col(position_col).alias("__g"))
    else:
        order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
        needed = list(dict.fromkeys([*scope, *carry, *[o for o in order if isinstance(o, str)]]))
        pos = with_row_index(df.select(*needed), [*[F.col(c) for c in scope], *order_cols], "__g")
    row = F.struct(*[F.col(c) for c in carry], *[F.col(c).alias(f"__scope_{i}") for i, c in enumerate(scope)])
    b = F.floor(F.col("__g") / F.lit(bucket_rows)).cast("bigint")
    base = pos.select(F.col("__g"), b.alias("__b"), row.alias("__row"))
    if length > 1:
        # The first L-1 rows of each bucket also go to the previous bucket.
        head = base.filter((F.pmod(F.col("__g"), F.lit(bucket_rows)) < F.lit(length - 1)) & (F.col("__b") > 0))
        base = base.unionByName(head.withColumn("__b", F.col("__b") - 1))
    w = Window.partitionBy("__b").orderBy("__g")
    sel = [F.col("__g"), F.col("__b"), F.col("__row").alias("__s0")]
    for j in range(1, length):
        sel.append(F.lead("__row", j).over(w).alias(f"__s{j}"))
        sel.append(F.lead("__g", j).over(w).alias(f"__g{j}"))
    win = base.select(*sel).filter(F.floor(F.col("__g") / F.lit(bucket_rows)) == F.col("__b"))
    complete = F.lit(True)
    for j in range(1, length):
        complete = complete & F.col(f"__s{j}").isNotNull() & (F.col(f"__g{j}") == F.col("__g") + F.lit(j))
        for i in range(len(scope)):
            complete = complete & F.col(f"__s{j}")[f"__scope_{i}"].eqNullSafe(F.col("__s0")[f"__scope_{i}"])
    return win.withColumn("__complete", complete)


def ngram(df: DataFrame, spec: NGram, scope: list[str], order: list | None = None,
          bucket_rows: int = BUCKET_ROWS, check_sorted: bool = True,
          position_col: str | None = None) -> DataFrame:
    """All sliding windows of ``spec`` inside each scope.

    Output: one row per window with the scope columns, ``start_pos`` (global position)
    and one struct column per timestep key that has fields (named ``t0``, ``t1``,
    ``t_m1`` for -1, ...). ``order`` defaults to (timestamp, then the key fields).
    ``position_col``: an existing dense 0-based position, contiguous per scope and
    following ``order`` (as the reader's ``position``); it replaces the numbering pass.
    """
    if not spec.timestamp_overlap:
        raise ValueError("use ngram_no_overlap for timestamp_overlap=False")
    spec = spec.resolve(df.columns)
    ts = spec.timestamp_field
    order = order or [ts]
    L = spec.length
    carry = list(dict.fromkeys([ts, *spec.all_fields()]))
    win = _windows(df, L, scope, order, carry, bucket_rows, position_col).filter("__complete")
    ts_type = df.schema[ts].dataType
    ok = F.lit(True)
    unsorted = F.lit(False)
    for j in range(1, L):
        g = _gap(ts_type, F.col(f"__s{j}")[ts], F.col(f"__s{j-1}")[ts])
        ok = ok & (g <= F.lit(float(spec.delta_threshold)))
        unsorted = unsorted | (g < F.lit(0.0))
    if check_sorted:
        msg = f"{ts} goes back in time within a sequence: sort the rows by it"
        ok = F.when(unsorted, F.raise_error(F.lit(msg))).otherwise(ok)
    win = win.filter(ok)
    out = [F.col("__s0")[f"__scope_{i}"].alias(c) for i, c in enumerate(scope)]
    out.append(F.col("__g").alias("start_pos"))
    for j in range(L):
        key = spec.base_key + j
        fs = spec.fields_at(key)
        if fs:
            out.append(F.struct(*[F.col(f"__s{j}")[f].alias(f) for f in fs]).alias(_key_name(key)))
    return win.select(*out)


def flatten_ngram(seq: DataFrame, spec: NGram, by_key: bool = False) -> DataFrame:
    """One wide row per window: ``<field>_<position>`` with position 0..L-1 in key
    order (``by_key=True`` names by the key itself, as the ancestor sequence does)."""
    keep = [c for c in seq.columns if c not in {_key_name(k) for k in spec.fields}]
    sel = [F.col(c) for c in keep]
    for pos, key in enumerate(sorted(spec.fields)):
        name = _key_name(key)
        if name not in seq.columns:
            continue
        suffix = key if by_key else (key - spec.base_key)
        for f in spec.fields_at(key):
            sel.append(F.col(name)[f].alias(f"{f}_{suffix}"))
    return seq.select(*sel)


def unflatten_ngram(flat: DataFrame, spec: NGram, by_key: bool = False) -> DataFrame:
    """Inverse of ``flatten_ngram``."""
    used = set()
    structs = []
    for key in sorted(spec.fields):
        fs = spec.fields_at(key)
        if not fs:
            continue
        suffix = key if by_key else (key - spec.base_key)
        names = [f"{f}_{suffix}" for f in fs]
        used.update(names)
        structs.append(F.struct(*[F.col(n).alias(f) for n, f in zip(names, fs)]).alias(_key_name(key)))
    keep = [F.col(c) for c in flat.columns if c not in used]
    return flat.select(*keep, *structs)


def ancestor_sequence(df: DataFrame, length: int, delta_threshold: float, timestamp_field: str,
                      scope: list[str], order: list | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fixed-length sequence with every field at every step, keys 0..L-1, no sort check."""
    fields = [c for c in df.columns if c not in scope]
    spec = NGram({k: list(fields) for k in range(length)}, delta_threshold, timestamp_field)
    return ngram(df, spec, scope, order, bucket_rows, check_sorted=False)


# Buckets that one task of the skeleton walk goes through.
WALK_BUCKETS = 4096


class _Bucket:
    """The greedy path inside one bucket. ``starts`` are the valid windows' first positions,
    ``breaks`` the last positions of tie runs (of one scope and time), those of the first L-1
    rows after the bucket included; ``beyond`` is the first break behind all these."""

    def __init__(self, number, size, length, starts, breaks, beyond):
        self.base, self.end = number * size, (number + 1) * size
        self.starts = np.asarray(starts, dtype=np.int64)
        breaks = np.asarray(breaks, dtype=np.int64)
        places = np.append(breaks, self.end if beyond is None else beyond)
        # Where the search goes on after each window: behind the tie run of its last row.
        self.after = places[np.searchsorted(breaks, self.starts + length - 1)] + 1
        self.following = np.searchsorted(self.starts, self.after).tolist()
        # A window from before the bucket ends before it or in its first L-1 rows, its tie run behind.
        runs = places[np.searchsorted(breaks, np.arange(self.base, self.base + max(length - 1, 1)))] + 1
        self.entries = sorted({self.base, *runs[runs < self.end].tolist()})
        self.broken = bool(((breaks >= self.base + length - 1) & (breaks < self.end)).any())

    def path(self, entry: int) -> tuple[list[int], int]:
        """The windows taken from ``entry`` on (as indexes), and where the next bucket goes on."""
        at, taken = int(np.searchsorted(self.starts, entry)), []
        while at < len(self.starts):
            taken.append(at)
            at = self.following[at]
        return taken, max(int(self.after[taken[-1]]) if taken else entry, self.end)


def _walk(buckets, entry: int, size: int):
    """Goes through (number, entries, exits) in order; yields (number, entry) and at last (None, exit)."""
    for number, entries, exits in buckets:
        if entry < (number + 1) * size:
            entry = max(entry, number * size)
            yield number, entry
            entry = exits[entries.index(entry)]
    yield None, entry


def _greedy_starts(slim: DataFrame, L: int, thr: float, unit: float, bucket_rows: int) -> DataFrame:
    """Start positions of the greedy non-overlapping windows. ``__ts`` keeps its
    exact type; gaps are its differences divided by ``unit``.

    1. Rows are dealt into buckets of consecutive positions (the next bucket's first L rows are
       copied); each bucket becomes one written row: its valid windows' starts (L rows of one
       scope, gaps <= thr) and the ends of its tie runs.
    2. A taken window's successor is the first valid start behind the tie run of its last row;
       behind the last window of a scope that is the next scope's first, so all scopes are one
       path. A bucket can be entered at its begin or behind one of at most L-1 tie runs: it is
       reduced to the exits of these entries (the skeleton).
    3. The skeleton is walked in two levels, stretches of ``WALK_BUCKETS`` buckets side by side,
       then one row for each stretch; then each bucket marks its path from the entry found."""
    B, ahead = max(bucket_rows, 2 * L), max(L - 1, 1)
    o, b = F.col("__o"), F.floor(F.col("__o") / F.lit(B)).cast("bigint")
    base = slim.select(o, b.alias("__b"), "__scope_key", "__ts")
    head = base.filter((F.pmod(o, F.lit(B)) < F.lit(L)) & (F.col("__b") > 0))
    base = base.unionByName(head.withColumn("__b", F.col("__b") - 1))
    w = Window.partitionBy("__b").orderBy("__o")
    sel = [o, F.col("__b"), F.col("__scope_key"), F.col("__ts").alias("__t0")]
    for j in range(1, ahead + 1):
        sel += [F.lead("__ts", j).over(w).alias(f"__t{j}"), F.lead("__scope_key", j).over(w).alias(f"__k{j}"),
                F.lead("__o", j).over(w).alias(f"__o{j}")]
    win = base.select(*sel)
    own = b == F.col("__b")
    complete, ok, unsorted = own, F.lit(True), F.lit(False)
    for j in range(1, L):
        complete = complete & (F.col(f"__o{j}") == o + F.lit(j)) & (F.col(f"__k{j}") == F.col("__scope_key"))
        gap = (F.col(f"__t{j}") - F.col(f"__t{j-1}")).cast("double") / F.lit(unit)
        ok = ok & (gap <= F.lit(thr))
        unsorted = unsorted | (gap < F.lit(0.0))
    msg = "the time column goes back within a sequence: sort the rows by it"
    valid = F.when(complete & unsorted, F.raise_error(F.lit(msg))).otherwise(complete & ok)
    same = F.col("__k1").eqNullSafe(F.col("__scope_key")) & F.col("__t1").eqNullSafe(F.col("__t0")) & F.col("__o1").isNotNull()
    known = own | (F.pmod(o, F.lit(B)) < F.lit(L - 1))
    buckets = win.groupBy("__b").agg(
        F.array_sort(F.collect_list(F.when(valid, o))).alias("starts"),
        F.array_sort(F.collect_list(F.when(known & ~same, o))).alias("breaks"),
    )
    buckets = reliable_checkpoint(buckets)
    # One row per bucket: the first break behind the copied rows.
    first = F.col("__b") * F.lit(B)
    inside = F.filter("breaks", lambda x: x < first + F.lit(B))
    firsts = buckets.select(
        "__b", F.array_min(inside).alias("any"),
        F.array_min(F.filter(inside, lambda x: x >= first + F.lit(L - 1))).alias("late"))
    down = Window.orderBy(F.col("__b").desc())
    beyond = F.least(F.lag("late", 1).over(down), F.min("any").over(down.rowsBetween(Window.unboundedPreceding, -2)))
    firsts = firsts.select("__b", beyond.alias("beyond"))
    whole = buckets.join(broadcast_if_small(firsts, measure=True), "__b").select("__b", "starts", "breaks", "beyond")

    def bucket(row):
        return _Bucket(row["__b"], B, L, row["starts"], row["breaks"], row["beyond"])

    def reduce(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                one = bucket(row)
                out.append({"__b": row["__b"], "entries": one.entries, "exits": [one.path(e)[1] for e in one.entries], "broken": one.broken})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    numbers = pa.list_(pa.int64())
    kind = pa.schema([("__b", pa.int64()), ("entries", numbers), ("exits", numbers), ("broken", pa.bool_())])
    skeleton = whole.mapInArrow(reduce, "__b long, entries array<long>, exits array<long>, broken boolean")
    per = WALK_BUCKETS
    stretch = F.expr(f"__b div {per}")
    skeleton = reliable_checkpoint(skeleton.withColumn("stretch", stretch))

    def ordered(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["__b"])
        return rows, [(r["__b"], r["entries"], r["exits"]) for r in rows]

    def stretch_exits(table: pa.Table) -> pa.Table:
        rows, steps = ordered(table)
        entries = []
        for r in rows:  # a tie run of a window from before ends in the first of these that has a late break
            entries += r["entries"]
            if r["broken"]:
                entries.append((r["__b"] + 1) * B)
                break
        exits = [list(_walk(steps, e, B))[-1][1] for e in entries]
        number = rows[0]["stretch"]
        return pa.table({"stretch": [number], "entries": pa.array([entries], numbers), "exits": pa.array([exits], numbers)})

    def stretch_entries(batches):
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["stretch"])
        entry, out = 0, []
        size = B * per
        for r in rows:
            if entry < (r["stretch"] + 1) * size:
                entry = max(entry, r["stretch"] * size)
                out.append((r["stretch"], entry))
                entry = r["exits"][r["entries"].index(entry)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["at", "entry"])

    def bucket_entries(table: pa.Table, entry: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and entry.num_rows:
            out = [x for x in _walk(ordered(table)[1], entry.column("entry")[0].as_py(), B) if x[0] is not None]
        return pa.table({"__b": pa.array([x[0] for x in out], pa.int64()), "entry": pa.array([x[1] for x in out], pa.int64())})

    # One row for each WALK_BUCKETS buckets goes through one task.
    stretches = skeleton.groupBy("stretch").applyInArrow(stretch_exits, "stretch long, entries array<long>, exits array<long>")
    entered = stretches.repartition(1).mapInArrow(stretch_entries, "at long, entry long")
    entries = skeleton.groupBy("stretch").cogroup(entered.groupBy("at")).applyInArrow(bucket_entries, "__b long, entry long")

    def expand(batches):
        for batch in batches:
            starts = []
            for row in batch.to_pylist():
                one = bucket(row)
                starts += one.starts[one.path(row["entry"])[0]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64())], names=["__start"])

    return whole.join(entries, "__b").mapInArrow(expand, "__start long")


def ngram_no_overlap(df: DataFrame, spec: NGram, scope: list[str], order: list | None = None,
                     bucket_rows: int = BUCKET_ROWS, position_col: str | None = None) -> DataFrame:
    """Greedy non-overlapping windows: scanning left to right inside a scope, a window
    is taken when its gaps pass and its first timestamp is *greater* than the last
    taken window's end. Scopes of any size use the same distributed plan."""
    spec = spec.resolve(df.columns)
    ts = spec.timestamp_field
    order = order or [ts]
    L = spec.length
    ts_type = df.schema[ts].dataType
    carry = list(dict.fromkeys([ts, *spec.all_fields()]))
    needed = list(dict.fromkeys([*scope, *carry, *[o for o in order if isinstance(o, str)]]))
    if position_col is not None:
        pos = df.select(*needed, F.col(position_col).alias("__o"))
    else:
        slim_df = df.select(*needed) if all(isinstance(o, str) for o in order) else df
        pos = with_row_index(slim_df, [*[F.col(c) for c in scope],
                                       *[F.col(o) if isinstance(o, str) else o for o in order]], "__o")
    scope_key = F.to_json(F.struct(*[F.col(c) for c in scope]))
    tcol, unit = F.col(ts), 1.0
    if isinstance(ts_type, T.DateType):
        tcol = F.unix_date(tcol)  # days, as the gaps of the sliding form
    elif isinstance(ts_type, (T.TimestampType, T.TimestampNTZType)):
        epoch = F.lit("1970-01-01 00:00:00").cast(ts_type.simpleString())
        tcol, unit = F.timestamp_diff("MICROSECOND", epoch, tcol), 1e6
    slim = pos.select(scope_key.alias("__scope_key"), F.col("__o"), tcol.alias("__ts"))
    starts = _greedy_starts(slim, L, float(spec.delta_threshold), unit, bucket_rows)
    # Assemble the rows of the chosen windows with an equi-join on position.
    members = starts.select(
        F.col("__start"), F.explode(F.sequence(F.lit(0), F.lit(L - 1))).alias("__j")
    ).withColumn("__o", F.col("__start") + F.col("__j"))
    row = pos.select("__o", *scope, F.struct(*[F.col(c) for c in carry]).alias("__row"))
    joined = members.join(row, "__o")
    grouped = joined.groupBy("__start", *scope).agg(
        F.collect_list(F.struct(F.col("__j"), F.col("__row"))).alias("__all")
    )
    grouped = grouped.select("__start", *scope, in_order(F.col("__all"), ["__j"]).alias("__rows"))
    out = [*[F.col(c) for c in scope], F.col("__start").alias("start_pos")]
    for j in range(L):
        key = spec.base_key + j
        fs = spec.fields_at(key)
        if fs:
            out.append(F.struct(*[F.col("__rows")[j]["__row"][f].alias(f) for f in fs]).alias(_key_name(key)))
    return grouped.select(*out)

