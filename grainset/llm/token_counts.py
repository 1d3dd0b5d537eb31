"""Token counts from an exact histogram of encoded lengths.

Each text is encoded whole with a public byte-level BPE (rank file and split pattern are
parameters; the file is read on the driver and broadcast, about a megabyte). Documents are
aggregated by encoded length, and prefix and suffix sums over the histogram answer totals,
quantiles and truncated totals for every context limit. The sums run in two levels (blocks of
lengths, then within a block), so no task holds more than a block of distinct lengths.

Defined cases: null and empty texts have 0 tokens and count as documents; repeated rows count
each time; other columns are not read; an empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainset.session import reliable_checkpoint

from .common import text_buffers

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
# White space from which a run is cut out: the split pattern goes back through it at a depth of
# its length, which ends the process at about a million.
LONG_RUN = 1000
# What the pattern takes as white space.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(f"{_SPACE}{{{LONG_RUN},}}")


class _Counter:
    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.text = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.run = tiktoken.Encoding("run", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})

    def count(self, text: str) -> int:
        """Tokens of a text. A long run of white space is one piece of the split pattern, without
        its last character unless it ends the text: that goes with what follows."""
        total = lo = 0
        for found in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
            hi = found.end() - (found.end() < len(text))
            total += len(self.text.encode_ordinary(text[lo : found.start()]))
            total += len(self.run.encode_ordinary(text[found.start() : hi]))
            lo = hi
        return total + len(self.text.encode_ordinary(text[lo:] if lo else text))


def token_counts(
    docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens) for every row."""
    with open(ranks, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or _Counter(data.value, pattern)
            counts = []
            for _, _, buf, bounds in text_buffers(batch.column(1)):
                raw, b = buf.tobytes(), bounds.tolist()
                counts += [counter.count(raw[i:j].decode()) for i, j in zip(b, b[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each length that occurs, read as a context limit:

    n_tokens, n_docs (of exactly that length), docs_within (not longer), docs_over (longer),
    tokens_within, tokens_over (of those documents), truncated_tokens (every document cut to
    the limit), quantile (docs_within over all documents).
    """
    # Written once (a row for each length), as sums of blocks and rows both read it: the texts
    # are encoded once.
    hist = reliable_checkpoint(counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    hist = hist.withColumn("block", F.expr(f"n_tokens div {block}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(below), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(below), F.lit(0)).alias("t0"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("d0") + F.sum("n_docs").over(upto)).alias("docs_within"),
        (F.col("t0") + F.sum(tokens).over(upto)).alias("tokens_within"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_within",
        (F.col("all_docs") - F.col("docs_within")).alias("docs_over"),
        "tokens_within",
        (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_over"),
        (F.col("tokens_within") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_within"))).alias("truncated_tokens"),
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def limit_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_within, docs_over, truncated_tokens) for any limits, from the
    histogram alone, whose rows are repeated once for each limit and aggregated."""
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    n, d = F.col("n_tokens"), F.col("n_docs")
    inside = n <= F.col("context_limit")
    return (
        hist.select("n_tokens", "n_docs", wanted)
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(inside, d).otherwise(0)).alias("docs_within"),
            F.sum(F.when(inside, 0).otherwise(d)).alias("docs_over"),
            F.sum(F.least(n, "context_limit") * d).alias("truncated_tokens"),
        )
    )


def length_quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of the documents do not exceed."""
    return hist.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
