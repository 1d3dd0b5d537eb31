"""Long texts read in parts: the same results as in one pass, and bounded memory."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from grainset.llm import common, quality_rules, simhash_dedup

SPACE = " \t\n\v\f\r"


def texts():
    rng = random.Random(5)
    words = ["Ab", "c#d", "é1", "日本", "x" * 30, "y" * 200, "Z.", "w", "7"]
    yield from ["", " ", "\n\n", "one", "  lead two", "a b", "a b c", "q" * 300, "q" * 300 + "  r\n" + "q" * 300]
    for _ in range(60):
        n = rng.randrange(1, 120)
        yield "".join(rng.choice(words) + "".join(rng.choices(SPACE, [6, 1, 3, 1, 1, 1], k=rng.randrange(1, 4))) for _ in range(n))
    yield "\n".join(["the same line of words here", " ", "another"] * 20)


@pytest.mark.parametrize("limit", [1, 7, 64, 1000])
def test_parts_give_what_one_pass_gives(limit):
    for text in texts():
        raw = text.encode()
        parts = list(common.long_parts(raw, limit))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()
        assert all(len(p) <= limit or len(p.split()) == 1 for p in parts)
        if raw:
            for shingle in (1, 3):
                want = simhash_dedup.fingerprint_batch(pa.array([text]), shingle)[0]
                assert simhash_dedup.long_fingerprint(raw, shingle, limit) == want, (text, shingle)
            counts, features = quality_rules.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            c, f = quality_rules.long_statistics(raw, limit)
            assert c.tolist() == counts.tolist() and np.allclose(f, features), text


MEASURE = """
import resource, sys
import pyarrow as pa
from grainset.llm import quality_rules, simhash_dedup
kind, size = sys.argv[1], 24 << 20
text = {"words": "some words of a text, no. %d\\n", "unspaced": "abcdefgh%d"}[kind]
column = pa.array([(text * (size // len(text)))[:size]])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
simhash_dedup.fingerprint_batch(column, 3)
batch = pa.RecordBatch.from_arrays([pa.array([1]), column], names=["doc_id", "text"])
list(quality_rules._apply(quality_rules.FEATURES, None)([batch]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("kind", ["words", "unspaced"])
def test_memory_of_a_long_text(kind):
    # One pass took 58 to 105 bytes for each byte: 1,400 to 2,500 MB for these 24 MB.
    out = subprocess.run([sys.executable, "-c", MEASURE, kind], capture_output=True, text=True, check=True, timeout=600)
    assert int(out.stdout) < 600
