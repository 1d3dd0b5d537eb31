"""Toxicity by weak supervision.

1. Voters. From a bounded sample of labelled rows, terms (words and word beginnings of 4, 5
   and 6 bytes, ASCII lower case) far more frequent in toxic documents become lexicon voters;
   pattern voters look at how many lexicon terms a document holds, shouting and exclamation.
2. Label model. A generative model says how often each voter fires on toxic and on clean
   documents (its accuracies); expectation maximisation fits it on the sample's votes, most
   of which have no label. Voters that fire together beyond what the label explains are
   correlated; each vote counts by one over the correlated voters' number.
3. Classifier. A logistic regression on term presence and patterns is trained on the label
   model's posteriors (labels themselves where known) and scores every document.

Bounds (parameters): ``sample`` labelled and as many unlabelled documents, ``voters`` lexicon
voters, ``terms`` classifier terms. Documents whose crc32(doc_id as text) leaves remainder 1
modulo 3 are held out: neither their labels nor their texts are used in fitting. Only the
text is an input of a score.

Defined cases: null and empty texts score by the intercept; a null doc_id is not held out
and takes no part in fitting; null labels are left out; several labels of one document count
each; without labels every score is 0 (below 1e-12); if the labelled sample has one class only, or
no term tells its classes apart, every score is the sample's share of toxic documents (1 if all
are); repeated rows repeat in the result; other columns are
carried by ``mark`` and not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTES, documents_frame, in_sorted, mix, small_batches, text_buffers, token_spans
from .simhash_dedup import _lower

SAMPLE = 20_000
VOTERS = 256
TERMS = 4096
THRESHOLD = 0.7
LEAST_DOCS = 5
LEAST_GAIN = 20.0  # likelihood ratio statistic a lexicon term needs
PURITY = 0.7
BEGINNINGS = (4, 5, 6)
PATTERNS = ("one_term", "two_terms", "three_terms", "dense_terms", "shouting", "exclaiming")

_letters = np.zeros(256, dtype=bool)
_letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_upper = np.zeros(256, dtype=bool)
_upper[65:91] = True
_U = np.uint64


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms_of(buf: np.ndarray, bounds: np.ndarray):
    """(text, term) with repeats, in no given order, and the words of each text."""
    low = _lower[buf]
    starts, ends, doc = token_spans(low, bounds, _letters)
    pre = BYTES.prefix(low)
    docs, out = [doc], [BYTES.spans(pre, starts, ends)]
    for k in BEGINNINGS:
        on = ends - starts >= k
        docs.append(doc[on])
        out.append(mix(BYTES.spans(pre, starts[on], starts[on] + k) + _U(k)))
    return np.concatenate(docs), np.concatenate(out), np.bincount(doc, minlength=len(bounds) - 1)


def _distinct(doc, term):
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


def _shape(buf, bounds):
    """Shares of upper-case letters and of exclamation marks."""
    per = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[bounds])
    letters = np.maximum(per(_letters[buf]), 1)
    return per(_upper[buf]) / letters, per(buf == 33) / letters


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, docs, toxic) over the labelled sample (text, toxic)."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, bounds in text_buffers(batch.column(0)):
                doc, term, _ = terms_of(buf, bounds)
                doc, term = _distinct(doc, term)
                uniq, at = np.unique(term, return_inverse=True)
                pos = np.bincount(at, weights=toxic[lo:hi][doc], minlength=len(uniq)).astype(np.int64)
                cols = [uniq.view(np.int64), np.bincount(at, minlength=len(uniq)), pos]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["term", "docs", "toxic"])

    counts = labelled.select("text", "toxic").mapInArrow(run, "term long, docs long, toxic long")
    return counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def _gain(docs, toxic, n, share):
    """Likelihood ratio statistic of the toxic share within a term's documents."""
    d, x = F.col("docs"), F.col("toxic")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    return 2 * (part(x, d * share) + part(d - x, d * (1 - share)))


@dataclass
class Model:
    terms: np.ndarray  # sorted term hashes
    weight: np.ndarray  # of terms, then of PATTERNS
    bias: float
    lexicon: np.ndarray  # sorted hashes of the lexicon voters

    def features(self, buf, bounds):
        """(text, term number) pairs and the dense pattern columns."""
        n = len(bounds) - 1
        doc, term, words = terms_of(buf, bounds)
        on = in_sorted(term, self.terms)
        doc, term = doc[on], term[on]
        is_lex = in_sorted(term, self.lexicon)
        hits = np.bincount(doc[is_lex], minlength=n)
        doc, term = _distinct(doc, term)
        is_lex = in_sorted(term, self.lexicon)
        kinds = np.bincount(doc[is_lex], minlength=n)
        upper, exclaim = _shape(buf, bounds)
        dense = hits / np.maximum(words, 1)
        patterns = np.stack(
            [kinds >= 1, kinds >= 2, kinds >= 3, dense >= 0.01, upper >= 0.3, exclaim >= 0.01], axis=1
        )
        return doc, np.searchsorted(self.terms, term), patterns.astype(float)

    def score(self, column) -> np.ndarray:
        out = [np.zeros(0)]
        for _, _, buf, bounds in text_buffers(column):
            doc, term, patterns = self.features(buf, bounds)
            z = np.bincount(doc, weights=self.weight[term], minlength=len(bounds) - 1)
            z = z + patterns @ self.weight[len(self.terms) :] + self.bias
            out.append(1 / (1 + np.exp(-z)))
        return np.concatenate(out)


class LabelModel:
    """Bernoulli votes given a hidden label, weighted down by their correlations. ``votes``
    is a float32 matrix of documents x voters; ``known`` is 0, 1 or -1."""

    def __init__(self, votes: np.ndarray, known: np.ndarray, rounds: int = 3, steps: int = 10):
        self.prior = float(np.clip((known == 1).sum() / max((known >= 0).sum(), 1), 1e-3, 0.5))
        p = np.where(known >= 0, known, np.where(votes.sum(axis=1) > 0, 0.5, self.prior))
        self.weight = np.ones(votes.shape[1])
        together = (votes.T @ votes).astype(float)
        for _ in range(rounds):
            for _ in range(steps):
                self._accuracies(votes, p)
                p = np.where(known >= 0, known, self.posterior(votes))
            self._correlations(votes, p, together)
        self._accuracies(votes, p)

    def _accuracies(self, v, p):
        fired = p.astype(np.float32) @ v
        still = v.sum(axis=0) - fired
        self.toxic = np.clip((fired + 0.5) / (p.sum() + 1), 1e-4, 1 - 1e-4)
        self.clean = np.clip((still + 0.05) / ((1 - p).sum() + 1), 1e-5, 1 - 1e-4)

    def _correlations(self, v, p, together):
        """Correlations of what the label leaves unexplained (products of v - E[v | p])."""
        q, t, c = 1 - p, self.toxic, self.clean
        fired = (p.astype(np.float32) @ v).astype(float)
        still = v.sum(axis=0) - fired
        cross = np.outer(fired, t) + np.outer(still, c)
        mean = (p @ p) * np.outer(t, t) + (p @ q) * (np.outer(t, c) + np.outer(c, t)) + (q @ q) * np.outer(c, c)
        rest = (together - cross - cross.T + mean) / len(v)
        scale = np.sqrt(np.maximum(np.diag(rest), 1e-9))
        self.correlation = rest / scale[:, None] / scale[None, :]
        strong = np.where(self.correlation > 0.1, self.correlation, 0)
        np.fill_diagonal(strong, 1)
        self.weight = 1 / strong.sum(axis=1)

    def posterior(self, v):
        fire = np.log(self.toxic / self.clean)
        still = np.log((1 - self.toxic) / (1 - self.clean))
        z = v @ (self.weight * (fire - still)).astype(np.float32)
        z = z + (self.weight * still).sum() + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(float)))


def _logistic(doc, term, patterns, target, size, steps: int = 400, rate: float = 0.3, decay: float = 1e-5):
    """Weights of a logistic regression on sparse presence and dense columns (Adam)."""
    n = len(target)
    w = np.zeros(size + patterns.shape[1] + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for k in range(1, steps + 1):
        z = np.bincount(doc, weights=w[term], minlength=n) + patterns @ w[size:-1] + w[-1]
        err = 1 / (1 + np.exp(-z)) - target
        g = np.concatenate([np.bincount(term, weights=err[doc], minlength=size), patterns.T @ err, [err.sum()]]) / n
        g[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * g
        s = 0.999 * s + 0.001 * g * g
        w -= rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    voters: int = VOTERS,
    terms: int = TERMS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    def constant(share: float) -> Model:
        bias = np.log(max(share, 1e-13) / max(1 - share, 1e-13))
        return Model(np.zeros(0, _U), np.zeros(len(PATTERNS)), float(bias), np.zeros(0, _U))

    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("label_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("label_id"))
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(sample)
    frame = documents_frame(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & ~held_out())
    labelled = frame.join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    n, positive = labelled.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    share = (positive or 0) / n if n else 0.0
    if share in (0.0, 1.0):
        return constant(share)
    counts = term_counts(labelled).where(f"docs >= {LEAST_DOCS}")
    gain = _gain("docs", "toxic", n, share).alias("gain")
    chosen = counts.select("term", "docs", "toxic", gain).where(f"gain >= {LEAST_GAIN}")
    chosen = chosen.orderBy(F.desc("gain"), "term").limit(terms).toPandas()
    hash_of = chosen["term"].to_numpy(np.int64).view(_U)
    pure = (chosen["toxic"] >= PURITY * chosen["docs"]).to_numpy()
    lexicon = np.sort(hash_of[pure][:voters])
    if not len(lexicon):
        return constant(share)
    model = Model(np.sort(hash_of), np.zeros(len(hash_of) + len(PATTERNS)), 0.0, lexicon)

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).fill_null(-1).to_numpy().astype(np.int64)
            for lo, hi, buf, bounds in text_buffers(batch.column(0)):
                doc, term, patterns = model.features(buf, bounds)
                cut = np.searchsorted(doc, np.arange(1, hi - lo))
                found = [x.astype(np.int32).tobytes() for x in np.split(term, cut)]
                shape = [x.astype(np.int8).tobytes() for x in patterns]
                cols = [pa.array(toxic[lo:hi]), pa.array(found, pa.binary()), pa.array(shape, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["toxic", "terms", "patterns"])

    # As many unlabelled documents, by a share of the hash range.
    total = docs.count()
    part = min(1.0, sample / max(total, 1))
    free = frame.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    free = free.join(F.broadcast(rows.select("label_id").distinct()), F.col("doc_id") == F.col("label_id"), "left_anti")
    both = labelled.unionAll(free.select("text", F.lit(None).cast("int").alias("toxic")))
    got = both.mapInArrow(run, "toxic long, terms binary, patterns binary").collect()
    got = sorted((r["toxic"], bytes(r["terms"]), bytes(r["patterns"])) for r in got)  # the same model in whatever order rows came
    known = np.array([r[0] for r in got])
    doc = np.repeat(np.arange(len(got)), [len(r[1]) // 4 for r in got])
    term = np.frombuffer(b"".join(r[1] for r in got), np.int32).astype(np.int64)
    patterns = np.frombuffer(b"".join(r[2] for r in got), np.int8).reshape(len(got), len(PATTERNS)).astype(float)
    slot = np.full(len(model.terms), -1)
    slot[np.searchsorted(model.terms, lexicon)] = np.arange(len(lexicon))
    votes = np.zeros((len(got), len(lexicon) + len(PATTERNS)), dtype=np.float32)
    on = slot[term] >= 0
    votes[doc[on], slot[term[on]]] = 1
    votes[:, len(lexicon) :] = patterns
    target = np.where(known >= 0, known, LabelModel(votes, known).posterior(votes))
    del got, votes
    model.weight, model.bias = _logistic(doc, term, patterns, target, len(model.terms))
    return model


def mark(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows as ``rest`` (a struct of all columns by position) with ``score``."""

    def run(batches):
        for batch in batches:
            text = pc.struct_field(batch.column(0), [at])
            yield pa.RecordBatch.from_arrays([pa.array(model.score(text)), batch.column(0)], names=["score", "rest"])

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    frame = small_batches(docs).select(rest)
    at = docs.columns.index(text_col)
    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("rest", frame.schema["rest"].dataType)])
    return frame.mapInArrow(run, out)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], names=["doc_id", "score"])

    out = documents_frame(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
