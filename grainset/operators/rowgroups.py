"""Row-group (piece) operators: inverted indexes, selectors, shards, sub-splits.

A *piece* is the unit of scan, shard and selection: a Parquet row group from the
catalog, or a logical block of rows. Rows carry ``piece_id``; index and selection
tables are metadata-sized (values x pieces), so they are joined back with a
size-checked broadcast.

Indexes and selections are *postings*: bitmaps of 64 pieces, one long for a ``word`` of piece
ids (``piece_id // 64``). A value in few pieces costs a row a piece, as a list would; one in
every piece costs a row for 64, spread over tasks. Union and intersection are ``|`` and ``&`` of
such longs, word by word. (``bitmap_construct_agg`` would take 4 KB for each value and range of
32,768 pieces, however few of them hold it.)
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_mod_bucket
from ..session import broadcast_if_small

class Indexer:
    """An index by name; ``values`` gives a row's entries as an array of text."""

    index_name: str

    def values(self, df: DataFrame) -> Column:
        raise NotImplementedError


def _texts(df: DataFrame, c: Column) -> Column:
    kind = df.select(c.alias("v")).schema["v"].dataType
    return F.transform(c, lambda x: x.cast("string")) if kind.typeName() == "array" else F.array(c.cast("string"))


@dataclass
class SingleFieldIndexer(Indexer):
    """value -> pieces holding it; arrays contribute each element; nulls skipped."""

    index_name: str
    field: str

    def values(self, df: DataFrame) -> Column:
        return _texts(df, F.col(self.field))


@dataclass
class FieldNotNullIndexer(Indexer):
    """Pieces holding at least one non-null value of the field (single entry '*')."""

    index_name: str
    field: str

    def values(self, df: DataFrame) -> Column:
        return F.array(F.when(F.col(self.field).isNotNull(), F.lit("*")))


@dataclass
class ExpressionIndexer(Indexer):
    """Custom index: any Column (scalar or array) extracted per row is the index value."""

    index_name: str
    value: Column

    def values(self, df: DataFrame) -> Column:
        return _texts(df, self.value)


WORD_SHIFT = 6  # 64 pieces to a long


def _packed(piece_col: str) -> tuple[Column, Column]:
    """The word of a piece and the long that has only the piece's bit set."""
    piece = F.col(piece_col).cast("bigint")
    bit = piece.bitwiseAND(F.lit((1 << WORD_SHIFT) - 1)).cast("int")
    return F.shiftright(piece, WORD_SHIFT), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _unpacked(word: Column, bits: Column) -> Column:
    """The piece ids of a word, ascending."""
    places = F.filter(F.sequence(F.lit(0), F.lit((1 << WORD_SHIFT) - 1)), lambda k: F.getbit(bits, k) == 1)
    return F.transform(places, lambda k: F.shiftleft(word, WORD_SHIFT) + k)


def build_indexes(df: DataFrame, indexers: list, piece_col: str = "piece_id") -> DataFrame:
    """All indexes in one scan and one exchange, as postings (index_name, value, word, bits):
    a task sends a row for each value and word, however many rows hold it."""
    names = [ix.index_name for ix in indexers]
    if len(set(names)) != len(names):
        raise ValueError("index names must be unique")
    if not indexers:
        raise ValueError("no indexers given")

    def entries(ix):
        named = lambda v: F.struct(F.lit(ix.index_name).alias("index_name"), v.alias("value"))
        return F.transform(F.coalesce(ix.values(df), F.array().cast("array<string>")), named)

    word, bit = _packed(piece_col)
    rows = df.select(word.alias("word"), bit.alias("bit"), F.explode(F.concat(*map(entries, indexers))).alias("e"))
    rows = rows.where("e.value IS NOT NULL").select("e.index_name", "e.value", "word", "bit")
    return rows.groupBy("index_name", "value", "word").agg(F.bit_or("bit").alias("bits"))


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """One index of several built apart, of the same pieces or of others."""
    return reduce(DataFrame.unionByName, indexes).groupBy("index_name", "value", "word").agg(F.bit_or("bits").alias("bits"))


def index_pieces(index: DataFrame) -> DataFrame:
    """The index as rows (index_name, value, piece_id), each once."""
    return index.select("index_name", "value", F.explode(_unpacked(F.col("word"), F.col("bits"))).alias("piece_id"))


def index_arrays(index: DataFrame, index_name: str | None = None, values: list | None = None) -> DataFrame:
    """The sorted piece ids of each value as an array, for listings; name an index or some
    values (as in ``SingleIndexSelector``) where the pieces are many."""
    if values is not None:
        index = index.filter(SingleIndexSelector(index_name, values).hits())
    elif index_name is not None:
        index = index.filter(F.col("index_name") == index_name)
    words = index.groupBy("index_name", "value").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    pieces = F.flatten(F.transform("w", lambda w: _unpacked(w["word"], w["bits"])))
    return words.select("index_name", "value", pieces.alias("piece_ids"))


def write_indexes(index: DataFrame, path: str, mode: str = "overwrite"):
    index.write.mode(mode).partitionBy("index_name").parquet(path)


def read_indexes(spark, path: str) -> DataFrame:
    """Postings written by ``write_indexes``; indexes stored as rows of pieces are packed."""
    stored = spark.read.parquet(path)
    if "piece_id" in stored.columns:
        word, bit = _packed("piece_id")
        stored = merge_indexes(stored.select("index_name", "value", word.alias("word"), bit.alias("bits")))
    return stored.select("index_name", "value", "word", "bits")


def index_report(index: DataFrame) -> DataFrame:
    """Per index and value: how many pieces hold it."""
    return index.groupBy("index_name", "value").agg(F.sum(F.bit_count("bits")).cast("int").alias("n_pieces"))


# ------------------------------------------------------------------ indexes with a state


class StateIndexer:
    """An index that keeps a state for each piece instead of its values: ``update`` gives the
    state's fields as aggregates over a piece's rows, ``merge`` as aggregates over states (of
    the same piece, from parts built apart), ``hits`` whether a state may hold what is asked."""

    index_name: str

    def update(self) -> dict[str, Column]:
        raise NotImplementedError

    def merge(self) -> dict[str, Column]:
        raise NotImplementedError

    def hits(self, asked) -> Column:
        raise NotImplementedError


@dataclass
class RangeIndexer(StateIndexer):
    """Least and largest value of a field; asked for an interval (low, high), both included;
    None leaves a side open. Pieces without a value hold nothing."""

    index_name: str
    field: str

    def update(self):
        return {"low": F.min(self.field), "high": F.max(self.field)}

    def merge(self):
        return {"low": F.min("low"), "high": F.max("high")}

    def hits(self, asked):
        low, high = asked
        out = F.col("low").isNotNull()
        if low is not None:
            out = out & (F.col("high") >= F.lit(low))
        return out if high is None else out & (F.col("low") <= F.lit(high))


@dataclass
class DistinctIndexer(StateIndexer):
    """A sketch of a field's distinct values (HyperLogLog); asked for a least number of them."""

    index_name: str
    field: str

    def update(self):
        return {"sketch": F.hll_sketch_agg(self.field)}

    def merge(self):
        return {"sketch": F.hll_union_agg("sketch")}

    def hits(self, asked):
        return F.hll_sketch_estimate("sketch") >= F.lit(asked)


def _aggregated(df: DataFrame, piece_col: str, aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(piece_col).agg(*[c.alias(k) for k, c in aggregates.items()])


def build_state_index(df: DataFrame, indexer: StateIndexer, piece_col: str = "piece_id") -> DataFrame:
    """(piece_id, state fields): a partial aggregate per task, then one row for each piece."""
    return _aggregated(df.withColumnRenamed(piece_col, "piece_id"), "piece_id", indexer.update())


def merge_state_indexes(indexer: StateIndexer, *indexes: DataFrame) -> DataFrame:
    """One index of several: rows added later, to old or new pieces, need no second scan of
    those already indexed."""
    out = indexes[0]
    for other in indexes[1:]:
        out = out.unionByName(other)
    return _aggregated(out, "piece_id", indexer.merge())


def write_state_index(index: DataFrame, indexer: StateIndexer, path: str, mode: str = "overwrite"):
    index.write.mode(mode).parquet(f"{path.rstrip('/')}/state/{indexer.index_name}")


def read_state_index(spark, indexer: StateIndexer, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/state/{indexer.index_name}")


# ------------------------------------------------------------------ selectors


class Selector:
    """A selection of pieces. A tree of selectors is one aggregate over the index: ``leaves``
    are its parts that look something up, ``combine`` joins their bits, taken from an iterator
    in the order of the leaves."""

    def leaves(self) -> list:
        return [self]

    def combine(self, bits) -> Column:
        return next(bits)

    def words(self, index: DataFrame | None = None) -> DataFrame:
        """The selected pieces as postings (word, bits), one row a word."""
        leaves = self.leaves()
        names = [f"b{i}" for i in range(len(leaves))]
        named = [i for i, leaf in enumerate(leaves) if isinstance(leaf, SingleIndexSelector)]
        parts = []
        if named:
            found = index.filter(reduce(lambda a, b: a | b, [leaves[i].hits() for i in named]))
            hit = {i: F.when(leaves[i].hits(), F.col("bits")) for i in named}
            parts.append(found.select("word", *[hit.get(i, F.lit(None)).cast("bigint").alias(n) for i, n in enumerate(names)]))
        for k, leaf in enumerate(leaves):
            if k not in named:
                word, bit = _packed("piece_id")
                own = [(bit if i == k else F.lit(None)).cast("bigint").alias(n) for i, n in enumerate(names)]
                parts.append(leaf.pieces(index).select(word.alias("word"), *own))
        if not parts:
            return index.sparkSession.createDataFrame([], "word bigint, bits bigint")
        found = reduce(DataFrame.union, parts).groupBy("word").agg(*[F.bit_or(n).alias(n) for n in names])
        bits = self.combine(iter([F.coalesce(n, F.lit(0).cast("bigint")) for n in names]))
        return found.select("word", bits.alias("bits")).where("bits != 0")

    def pieces(self, index: DataFrame | None = None) -> DataFrame:
        """The selected pieces as rows (piece_id), each once."""
        return self.words(index).select(F.explode(_unpacked(F.col("word"), F.col("bits"))).alias("piece_id"))


class SingleIndexSelector(Selector):
    """Pieces holding any of ``values`` in index ``index_name``; unknown values select nothing.
    Numbers match equal numbers however they are written (2 finds 2.0), booleans match
    ``true`` and ``false``; everything else is compared as text."""

    def __init__(self, index_name: str, values):
        self.index_name = index_name
        self.values = list(values)

    def _wanted(self) -> Column:
        value = F.col("value")
        plain = lambda v: isinstance(v, (int, float, Decimal, np.number)) and not isinstance(v, (bool, np.bool_))
        texts = [str(v).lower() if isinstance(v, (bool, np.bool_)) else str(v) for v in self.values]
        out = value.isin(texts)
        whole = [int(v) for v in self.values if plain(v) and not isinstance(v, (float, np.floating)) and v == int(v)]
        other = [float(v) for v in self.values if plain(v)]
        # Exact for whole numbers; the double comparison is for what has a fraction or exponent.
        if whole:
            out = out | F.coalesce(value.try_cast("decimal(38,10)").isin([Decimal(v) for v in whole]), F.lit(False))
        if other:
            broken = value.rlike("[.eE]")
            out = out | (broken & F.coalesce(value.try_cast("double").isin(other), F.lit(False)))
        return out

    def hits(self) -> Column:
        return (F.col("index_name") == self.index_name) & self._wanted()


class StateIndexSelector(Selector):
    """Pieces whose state in ``indexer``'s index may hold ``asked``; takes that index, or a
    folder written by ``write_state_index``, so it may stand beside selectors on values."""

    def __init__(self, indexer: StateIndexer, asked, state: DataFrame | str):
        self.indexer, self.asked, self.state = indexer, asked, state

    def pieces(self, index: DataFrame | None = None) -> DataFrame:
        state = self.state
        if isinstance(state, str):
            state = read_state_index(index.sparkSession, self.indexer, state)
        return state.filter(self.indexer.hits(self.asked)).select("piece_id")


class IntersectIndexSelector(Selector):
    def __init__(self, selectors: list):
        if not selectors:
            raise ValueError("IntersectIndexSelector needs at least one selector")
        self.selectors = selectors

    def leaves(self):
        return [leaf for s in self.selectors for leaf in s.leaves()]

    def combine(self, bits):
        return reduce(Column.bitwiseAND, [s.combine(bits) for s in self.selectors])


class UnionIndexSelector(Selector):
    """Pieces that any of the selectors finds; of no selectors, none."""

    def __init__(self, selectors: list):
        self.selectors = selectors

    def leaves(self):
        return [leaf for s in self.selectors for leaf in s.leaves()]

    def combine(self, bits):
        return reduce(Column.bitwiseOR, [s.combine(bits) for s in self.selectors], F.lit(0).cast("bigint"))


def check_index_names(index: DataFrame, selector: Selector, known: set[str] | None = None):
    """Unknown index names are an error (``known`` avoids a metadata query)."""
    names = set()

    def walk(s):
        if isinstance(s, SingleIndexSelector):
            names.add(s.index_name)
        elif not isinstance(s, StateIndexSelector):
            for c in s.selectors:
                walk(c)

    walk(selector)
    if known is None:
        known = {r[0] for r in index.select("index_name").distinct().collect()}  # metadata-sized
    missing = names - known
    if missing:
        raise ValueError(f"Index {sorted(missing)} is not available in this dataset")


def in_words(df: DataFrame, words: DataFrame, piece_col: str = "piece_id") -> DataFrame:
    """Rows whose piece is in the postings ``words`` (word, bits), one row a word: a semi join
    on the word, with the piece's bit tested beside it."""
    words = broadcast_if_small(words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")), measure=True)
    piece = F.col(piece_col).cast("bigint")
    bit = F.getbit(F.col("__bits"), piece.bitwiseAND(F.lit((1 << WORD_SHIFT) - 1)).cast("int"))
    return df.join(words, (F.shiftright(piece, WORD_SHIFT) == F.col("__word")) & (bit == 1), "left_semi")


def select_pieces(df: DataFrame, index: DataFrame, selector: Selector, piece_col: str = "piece_id") -> DataFrame:
    """Rows of the *whole* selected pieces (a superset of the matching rows)."""
    return in_words(df, selector.words(index), piece_col)


# ------------------------------------------------------------------ shards


def shard(df: DataFrame, cur_shard: int, shard_count: int, total_pieces: int | None = None,
          piece_col: str = "piece_id") -> DataFrame:
    """Keep pieces with ``piece_id % shard_count == cur_shard`` (membership ignores seeds)."""
    if not isinstance(cur_shard, int) or not isinstance(shard_count, int):
        raise ValueError("cur_shard and shard_count must be integers")
    if shard_count <= 0 or not 0 <= cur_shard < shard_count:
        raise ValueError("need shard_count > 0 and 0 <= cur_shard < shard_count")
    if total_pieces is not None and total_pieces < shard_count:
        raise ValueError(f"Cannot shard {total_pieces} row groups into {shard_count} shards")
    return df.filter(F.pmod(F.col(piece_col), F.lit(shard_count)) == F.lit(cur_shard))


def shard_numbers(df: DataFrame, shard_count: int, piece_col: str = "piece_id", name: str = "shard") -> DataFrame:
    """All shards in one scan: every row with the shard its piece belongs to."""
    if not isinstance(shard_count, int) or shard_count <= 0:
        raise ValueError("need shard_count > 0")
    return df.withColumn(name, F.pmod(F.col(piece_col), F.lit(shard_count)).cast("int"))


def path_hash_shard(path: Column, shard_count: int) -> Column:
    """Shard of a path: its md5 bucket modulo the number of shards."""
    return F.pmod(md5_mod_bucket(path), F.lit(shard_count)).cast("int")


def shard_by_path_hash(df: DataFrame, cur_shard: int, shard_count: int, path_col: Column | None = None,
                       root: str | None = None) -> DataFrame:
    """File-level sharding by a hash of the file's path below the dataset folder ``root`` (a
    qualified URI; a moved dataset keeps its shards), or of ``path_col``."""
    p = path_col
    if p is None:
        p = F.col("_metadata.file_path")
        if root is not None:
            p = F.when(p.startswith(root), F.substring(p, len(root) + 1, 1 << 20)).otherwise(p)
    return df.filter(path_hash_shard(p, shard_count) == F.lit(cur_shard))


# ------------------------------------------------------------------ sub-splits


def subsplit_parts(
    df: DataFrame, parts: int, order: list, piece_col: str | list = "piece_id", overlap: int = 0,
    index_name: str = "row_in_piece", part_name: str = "part",
) -> DataFrame:
    """Split each piece into ``parts`` contiguous parts: part = floor(i / (n / least(n, P)))
    in double arithmetic, i the row's position in the piece and n the piece size.

    With ``overlap = L - 1`` (sequences of length L) a row also belongs to the earlier
    parts whose end lies within ``overlap`` rows before it, so no sequence is lost."""
    if parts < 1:
        raise ValueError("parts must be >= 1")
    # Pieces are bounded (row-group or block size), so a window per piece is one task's work.
    piece = Window.partitionBy(*([piece_col] if isinstance(piece_col, str) else piece_col))
    sized = df.withColumn(index_name, (F.row_number().over(piece.orderBy(*order)) - 1).cast("bigint")).withColumn(
        "__n", F.count(F.lit(1)).over(piece))
    n = F.col("__n").cast("double")

    def part_of(i: Column) -> Column:
        return F.floor(i.cast("double") / (n / F.least(n, F.lit(float(parts))))).cast("int")

    i = F.col(index_name)
    if overlap <= 0:
        out = sized.withColumn(part_name, part_of(i))
    else:
        lo = part_of(F.greatest(i - F.lit(overlap), F.lit(0)))
        out = sized.withColumn(part_name, F.explode(F.sequence(lo, part_of(i))))
    return out.drop("__n")
