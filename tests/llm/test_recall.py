"""Recall of the decontamination search: changed passages of more items than the rank."""

import random

from grainset.llm import decontamination as D

KINDS = ("replaced", "dropped", "moved", "inserted")


def changed(kind, body, rng, vocabulary):
    n = len(body)
    picked = set(rng.sample(range(n), round(n * 0.25)))
    if kind == "replaced":
        return [rng.choice(vocabulary) if i in picked else w for i, w in enumerate(body)]
    if kind == "dropped":
        return [w for i, w in enumerate(body) if i not in picked]
    if kind == "inserted":
        return [x for i, w in enumerate(body) for x in ([rng.choice(vocabulary), w] if i in picked else [w])]
    out = [w for i, w in enumerate(body) if i not in picked]
    for i in sorted(picked):
        out.insert(rng.randrange(len(out) + 1), body[i])
    return out


def share(passage, body):
    """Part of the passage in the longest common subsequence, by the plain table."""
    row = [0] * (len(body) + 1)
    for w in passage:
        before = 0
        for j, x in enumerate(body, 1):
            before, row[j] = row[j], before + 1 if w == x else max(row[j], row[j - 1])
    return row[-1] / len(passage)


def test_changed_passages_are_found(spark, frame, words):
    rng = random.Random(41)
    vocabulary = [w + v for w in words for v in ("", "qu", "xo", "zi")]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randint(16, 40)) for _ in range(2 * D.RANK)]
    rows, wanted = [(i, " ".join(prose(rng.randint(20, 300)))) for i in range(200)], set()
    for k, item in enumerate(items):
        body = changed(KINDS[k % 4], item, rng, vocabulary)
        text = prose(300)
        at = rng.randrange(300)
        rows.append((1000 + k, " ".join(text[:at] + body + text[at:])))
        if share(item, body) >= D.LCS:
            wanted.add((1000 + k, k))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    docs = frame(rows)
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, D.build_index(docs, bench)).collect()}
    assert len(wanted) > 100
    missed = sorted(k % 4 for _, k in wanted - got)
    print(f"recall {len(wanted & got)} of {len(wanted)}, missed by kind {[missed.count(i) for i in range(4)]}")
    assert len(wanted & got) >= 0.9 * len(wanted)
    assert got <= {(1000 + k, k) for k in range(len(items))}
