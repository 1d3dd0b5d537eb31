"""Mixing to target weights by soft membership, in DataFrame expressions only.

1. Domains and classifier. Labelled rows (those in the labels table) name a domain; a
   naive Bayes classifier over ``MARKERS`` (how often each short string occurs per hundred
   bytes, capped to a few levels) is counted on all labelled rows and gives every
   document posteriors over the domains.
2. Rates. Nonnegative document rates minimise the squared relative gap between expected
   domain token totals (sum of rate x tokens x posterior) and their targets, plus a small
   pull towards rate 1. Accelerated projected gradient steps: one distributed aggregate each,
   whose result (a number for each domain) steers the next step.

The gradient for a document is its posteriors times one vector of domain prices, so a step is
an expression on the posterior columns; while fitting, only tokens, posteriors and rates are
written to the checkpoint folder every few steps to cut the plan. The fitted prices then give
every row its rate by one expression.

Defined cases: null and empty texts have 0 tokens and the prior as posteriors; a null label
or domain is left out of the counts; a domain without tokens gets no rate; target weights are
scaled to sum to 1, domains without a target have target 0; repeated rows each get a rate;
other columns are not read (``carry`` keeps them); an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainset.session import reliable_checkpoint

# Short strings that tell languages, prose and machine text apart; any list will do.
MARKERS = ("th", "ei", "qu", "ci", "sch", "é", "ñ", "ó", "#", "$", "|", "\n")
LEVELS = 6
STEPS = 24
PULL = 1e-3
WRITE_EVERY = 8


def tokens(text: Column) -> Column:
    """Words at white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def marker_levels(text: Column) -> Column:
    """Level of each marker: how often per 100 bytes, doubling from 1/8, as 0..5."""
    whole = F.octet_length(text)
    counts = [(whole - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / len(m.encode()) for m in MARKERS]

    def level(share):
        return F.when(share <= 0, 0).otherwise(F.least(F.lit(LEVELS - 1), F.greatest(F.lit(1), F.floor(F.log2(share * 8))))).cast("int")

    return let(F.array(*counts), lambda c: F.transform(c, lambda x: level(x * 100 / F.greatest(whole, F.lit(1)))))


def features(text: Column) -> Column:
    """struct(n_tokens, levels)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(tokens(text).alias("n_tokens"), marker_levels(text).alias("levels"))


def fit_domains(labelled: DataFrame) -> dict:
    """Counts over all labelled rows (domain, f): one row for each domain, marker and level
    reaches the driver."""
    rows = (
        labelled.where(F.col("domain").isNotNull())
        .select(F.col("domain").cast("string").alias("domain"), F.posexplode("f.levels").alias("marker", "level"))
        .groupBy("domain", "marker", "level")
        .count()
        .collect()
    )
    names = sorted({r["domain"] for r in rows})
    count = {(r["domain"], r["marker"], r["level"]): r["count"] for r in rows}
    size = {d: sum(count.get((d, 0, k), 0) for k in range(LEVELS)) for d in names}
    return {"domains": names, "count": count, "size": size}


def posteriors(levels: Column, model: dict) -> Column:
    """Array of the posteriors in the order of the model's domains (naive Bayes)."""
    names = model["domains"]
    if not names:
        return F.array().cast("array<double>")
    total = sum(model["size"].values())
    tables = []
    for d in names:
        prior = math.log((model["size"][d] + 1) / (total + len(names)))
        rows = [
            F.array(*[F.lit(math.log((model["count"].get((d, i, k), 0) + 0.5) / (model["size"][d] + 0.5 * LEVELS))) for k in range(LEVELS)])
            for i in range(len(MARKERS))
        ]
        tables.append(F.struct(F.lit(prior).alias("prior"), F.array(*rows).alias("rows")))

    def score(t):
        return F.aggregate(F.zip_with(t["rows"], levels, lambda row, k: row[k]), t["prior"], lambda a, x: a + x)

    def share(e):
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda whole: F.transform(e, lambda x: x / whole))

    def exps(s):
        return let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))

    return let(F.transform(F.array(*tables), score), lambda s: let(exps(s), share))


def _dot(values: list[float]) -> Column:
    out = F.lit(0.0)
    for k, v in enumerate(values):
        out = out + F.col("p")[k] * F.lit(float(v))
    return out


def fit_prices(frame: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS, pull: float = PULL) -> dict:
    """Prices of the domains in every step, from rows with n_tokens and p. Targets are weights
    of the domains; their token totals sum to the tokens at hand."""
    k = range(len(domains))
    if not domains:
        return {"step": 0.0, "pull": pull, "steps": []}
    frame = reliable_checkpoint(frame.select("n_tokens", "p"))
    t = F.col("n_tokens").cast("double")
    first = frame.agg(
        F.coalesce(F.sum(t), F.lit(0.0)).alias("all"),
        *[F.coalesce(F.sum(t * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)).alias(f"h{i}_{j}") for i in k for j in k if j >= i],
    ).first()
    scale = sum(max(targets.get(d, 0.0), 0.0) for d in domains) or 1.0
    want = [first["all"] * max(targets.get(d, 0.0), 0.0) / scale for d in domains]
    # Relative gaps, in the metric where a document weighs as its tokens: the gradient for a
    # rate is then posteriors times prices, and the largest curvature is that of a k x k matrix.
    weight = [1.0 / max(first[f"h{i}_{i}"], 1.0) for i in k]
    rows = [sum(abs(first[f"h{min(i, j)}_{max(i, j)}"]) * (weight[i] * weight[j]) ** 0.5 for j in k) for i in k]
    plan = {"step": 1.0 / (max(rows) + pull), "pull": pull, "steps": []}
    state = frame.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0))
    momentum = 1.0
    for n in range(steps):
        got = state.agg(*[F.coalesce(F.sum(F.col("ahead") * t * F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in k]).first()
        price = [weight[i] * (got[f"s{i}"] - want[i]) for i in k]
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        beta, momentum = (momentum - 1) / after, after
        plan["steps"].append((price, beta))
        state = state.withColumn("__new", _stepped(F.col("ahead"), _dot(price), plan))
        state = state.withColumn("ahead", F.col("__new") + beta * (F.col("__new") - F.col("rate")))
        state = state.withColumn("rate", F.col("__new")).drop("__new")
        if (n + 1) % WRITE_EVERY == 0 and n + 1 < steps:
            state = reliable_checkpoint(state)
    return plan


def _stepped(ahead: Column, price: Column, plan: dict) -> Column:
    return F.greatest(F.lit(0.0), ahead - plan["step"] * (price + plan["pull"] * (ahead - 1.0)))


def rates(p: Column, plan: dict) -> Column:
    """The rate of a row with posteriors ``p``: the fitted steps played through."""
    if not plan["steps"]:
        return F.lit(1.0)
    steps = F.array(
        *[F.struct(F.array(*[F.lit(float(x)) for x in price]).alias("price"), F.lit(float(beta)).alias("beta")) for price, beta in plan["steps"]]
    )

    def one(state, s):
        dot = F.aggregate(F.zip_with(s["price"], p, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        new = _stepped(state["ahead"], dot, plan)
        return F.struct(new.alias("rate"), (new + s["beta"] * (new - state["rate"])).alias("ahead"))

    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    return F.aggregate(steps, start, one, lambda state: state["rate"])


def domain_column() -> Column:
    """Language and quality of a labelled document."""
    return F.concat_ws("/", F.col("lang").cast("string"), F.when(F.col("quality") == 1, "good").otherwise("poor"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, carry: bool = False) -> tuple[DataFrame, list[str]]:
    """doc_id, o = struct(n_tokens, p, rate) for every row, and the domains in the order of
    p; with ``carry`` also ``rest``. Markers are read off the texts once and written with the
    ids; only ``carry`` reads the texts again, so as not to write them."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    read = docs.select(doc_id, F.col("lang").cast("string").alias("lang"), features(F.col("text")).alias("f"))
    read = reliable_checkpoint(read)
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality").where("label_id is not null and quality is not null")
    labelled = read.join(rows, F.col("doc_id") == F.col("label_id")).select(domain_column().alias("domain"), "f")
    model = fit_domains(labelled)
    if targets is None:
        targets = derived_targets(model["size"])
    elif model["domains"] and not any(targets.get(d, 0.0) > 0 for d in model["domains"]):
        raise ValueError(f"no target for any of the labelled domains {model['domains']}")
    fitted = read.select(F.col("f.n_tokens").alias("n_tokens"), posteriors(F.col("f.levels"), model).alias("p"))
    plan = fit_prices(fitted, model["domains"], targets)

    def result(f):
        rate = lambda p: F.struct(f["n_tokens"].alias("n_tokens"), p.alias("p"), rates(p, plan).alias("rate"))
        return let(posteriors(f["levels"], model), rate)

    if not carry:
        return read.select("doc_id", result(F.col("f")).alias("o")), model["domains"]
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    return docs.select(doc_id, rest, let(features(F.col("text")), result).alias("o")), model["domains"]


# Of the tokens, what text of poor quality gets; and the power of the languages' shares (below
# 1 raises rare languages).
POOR = 0.04
EVEN = 0.5


def derived_targets(size: dict[str, int], poor: float = POOR, even: float = EVEN) -> dict[str, float]:
    """A weight for every labelled domain: ``poor`` for those of poor quality and the rest for
    good ones, among each by the domains' labelled documents to the power ``even``."""
    weight = {d: n**even for d, n in size.items()}
    bad = {d for d in weight if d.endswith("poor")}
    out = {}
    for part, share in ((bad, poor), (set(weight) - bad, 1 - poor)):
        whole = sum(weight[d] for d in part)
        out |= {d: share * weight[d] / whole for d in part if whole}
    return out


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior of it, rate, expected_tokens; targets
    are weights of the domains (``derived_targets`` unless given); with ``carry`` also ``rest``, a struct of the input row."""
    frame, domains = mix(docs, labels, targets, carry)
    best = F.array_max("o.p")
    name = F.lit(None).cast("string")
    if domains:
        name = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("o.p", best).cast("int"))
    return frame.select(
        "doc_id",
        *(["rest"] if carry else []),
        F.col("o.n_tokens").alias("n_tokens"),
        name.alias("domain"),
        best.alias("posterior"),
        F.round("o.rate", 9).alias("rate"),
        F.round(F.col("o.rate") * F.col("o.n_tokens"), 6).alias("expected_tokens"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
