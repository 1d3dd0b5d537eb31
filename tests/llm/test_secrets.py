"""Secrets of the personal-data operator, and its digests against plain code."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from grainset.llm import pii

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
BLOCK = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\nabc=\n-----END RSA PRIVATE KEY-----"


def secrets(text):
    return [text[a:b] for k, a, b in pii.find_spans(text, pii.automaton()) if k == "secret"]


@pytest.mark.parametrize(
    "text,want",
    [
        (f'x token = "{HEX}" y', [HEX]),
        (f'{{"api_key": "{HEX}", "n": 1}}', [HEX]),
        ("PASSWORD: 'correct horse' and more", ["correct horse"]),
        ("access_token=abc123def456, next", ["abc123def456"]),
        (f"a {BLOCK} b", [BLOCK]),
        ("key AKIA" + "A1" * 8 + ".", ["AKIA" + "A1" * 8]),
        (f"token = {HEX}", [HEX]),
        # Not secrets: prose, short or unclosed values, other labels, prefixes inside words.
        ("The token: wonderful things. A secret = nothing", []),
        ('token = "short"', []),
        ('password = "never closed\nhere"', []),
        ("token of 12345678a", []),
        ("-----BEGIN PRIVATE KEY-----\nabc", []),
        ("-----BEGIN PRIVATE KEY-----\nabc\n-----END CERTIFICATE-----", []),
        ("xAKIA" + "A1" * 8, []),
        ("", []),
        ("token", []),
        ("token =", []),
    ],
)
def test_secret_values(text, want):
    assert secrets(text) == want


def test_base_spans_stay_inside_secrets():
    text = 'password = "mail a@b.cd now"'
    spans = pii.find_spans(text, pii.automaton())
    assert [text[a:b] for k, a, b in spans if k == "email"] == ["a@b.cd"] and len(secrets(text)) == 1


def test_many_open_blocks_are_read_once():
    assert secrets("-----BEGIN PRIVATE KEY-----\n" * 20_000) == []
    assert secrets("-----BEGIN PRIVATE KEY-----\n" * 20_000 + "-----END CERTIFICATE-----") == []
    assert secrets("token=" * 100_000) == []
    assert secrets("token=password='abc def'") == ["abc def"]


def test_every_token_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in pii.digest_columns(pii.find_pii(docs)).collect()}
    n = 0
    for r in docs.select("doc_id", "text").collect():
        text, got = r.text or "", rows[r.doc_id]
        spans = [s.split(":") for s in got.spans.split(",") if s]
        found = {text[int(a) : int(b)] for k, a, b in spans if k == "secret"}
        for value in re.findall(r'token = "([0-9a-f]{40})"', text):
            assert value in found
            n += 1
        base = ",".join(":".join(s) for s in spans if s[0] in pii.BASE)
        assert got.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert n > 0


def test_repeated_rows_and_long_texts(spark):
    text = f'token = "{HEX}" ' + "plain words " * 400_000 + "token: 1"
    docs = spark.range(1).select(F.lit(7).alias("doc_id"), F.lit(text).alias("text"))
    rows = pii.digest_columns(pii.find_pii(docs.unionAll(docs))).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_secret == 1
