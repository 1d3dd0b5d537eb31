import random
import re

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture()
def frame(spark):
    def make(rows, extra=True):
        """Documents with clashing extra columns."""
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        schema = "doc_id long, text string, lang string, source string, n_chars long, chunk string, tk long, rate string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1, "r") for i, t in rows], schema)

    return make


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
