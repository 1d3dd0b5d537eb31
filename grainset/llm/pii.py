"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits,
``://`` and ``www.``, and words that announce an identifier. From each anchor a small
deterministic parser expands to the boundary of the address, number or account and validates
it. Offsets count code points, ends are exclusive.

Base kinds (leftmost, non-overlapping within a kind; a match that fails its check is dropped
and not tried again): email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8
to 15 digits after a plus). Further kinds: url, iban (after its cue, modulo 97), ssn and
account (digits after a cue), secret: the value behind a cue such as token, password or api_key
and one ``=`` or ``:`` (quoted: 6 characters or more up to the same quote on the line;
otherwise 8 or more without blanks that hold both a letter and a digit), keys of a known prefix,
and private-key blocks from their BEGIN line to the end of the next END line.

Defined cases: null text is empty; repeated rows repeat in the result; a null doc_id stays;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account", "secret")

DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
HOST = frozenset(string.ascii_letters + string.digits + "-")
SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
UPPER_OR_DIGIT = frozenset(string.ascii_uppercase + string.digits)
PHONE_FILL = frozenset(" ().0123456789-")
URL_END = frozenset(" \t\n\r\v\f<>\"'`|{}[]")
CUE_FILL = frozenset(" \t:#.=-")
BLANKS = frozenset(" \t")
VALUE_END = frozenset(" \t\n\r\v\f\"'`,;<>(){}[]")
WORD = frozenset(string.ascii_letters + string.digits + "_")
BLOCK_BEGIN, BLOCK_END, BLOCK_TAIL = "-----BEGIN ", "-----END ", "-----"
# Prefix of an issued key -> fewest characters of letters, digits, _ and - behind it.
KEY_PREFIXES = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "gho_": 36, "ghs_": 36, "github_pat_": 22, "glpat-": 20, "xoxb-": 20, "xoxp-": 20}
SECRET_CUES = (
    "token", "secret", "password", "passwd", "passphrase", "api_key", "apikey", "api-key", "api key",
    "access_key", "access-key", "access key", "secret_key", "secret key", "private_key", "private key",
)
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "passport": "account"}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in string.digits:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for w in ("www.", "WWW.", "Www."):
        a.add_word(w, ("www", 4))
    a.add_word(BLOCK_BEGIN, ("block", len(BLOCK_BEGIN)))
    for prefix in KEY_PREFIXES:
        a.add_word(prefix, ("prefix", len(prefix)))
    for cue, kind in (CUES | dict.fromkeys(SECRET_CUES, "secret")).items():
        for w in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(w, (kind, len(cue)))
    a.make_automaton()
    return a


def run_end(text: str, i: int, members: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in members:
        i += 1
    return i


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def host_end(text: str, i: int) -> int:
    """End of two or more dotted labels from i, else -1."""
    end, labels = run_end(text, i, HOST), 0
    if end == i:
        return -1
    while end < len(text) and text[end] == ".":
        nxt = run_end(text, end + 1, HOST)
        if nxt == end + 1:
            break
        end, labels = nxt, labels + 1
    return end if labels else -1


def parse_email(text: str, at: int, floor: int):
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = host_end(text, at + 1)
    return (start, end) if end > 0 else None


def parse_ips(text: str, i: int):
    """Matches in the run of dotted numbers from i, and the run's end."""
    parts, end = [], run_end(text, i, DIGITS)
    parts.append((i, end))
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        nxt = run_end(text, end + 1, DIGITS)
        parts.append((end + 1, nxt))
        end = nxt
    found = []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, end


def parse_card(text: str, i: int):
    """The run of digits with single spaces or hyphens from i: (valid, end)."""
    digits, end, n = [text[i]], i + 1, len(text)
    while end < n:
        c = text[end]
        if c in DIGITS:
            digits.append(c)
            end += 1
        elif c in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return 16 <= len(digits) <= 19 and luhn("".join(digits)), end


def parse_phone(text: str, plus: int):
    """(start, end, valid) from a plus sign, or None if no number of that form starts there."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    last = run_end(text, plus + 2, PHONE_FILL) - 1
    while last >= plus + 3 and text[last] not in DIGITS:
        last -= 1
    if last < plus + 3:
        return None
    n = sum(c in DIGITS for c in text[plus + 1 : last + 1])
    return plus, last + 1, 8 <= n <= 15


def parse_iban(text: str, i: int):
    i = run_end(text, i, CUE_FILL)
    if not (text[i : i + 2].isascii() and text[i : i + 2].isupper() and text[i + 2 : i + 4].isascii() and text[i + 2 : i + 4].isdigit()):
        return None
    chars, end, n = [], i, len(text)
    while end < n and len(chars) < 34:
        if text[end] in UPPER_OR_DIGIT:
            chars.append(text[end])
            end += 1
        elif text[end] == " " and end + 1 < n and text[end + 1] in UPPER_OR_DIGIT and len(chars) % 4 == 0:
            end += 1
        else:
            break
    if len(chars) < 15:
        return None
    number = int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4]))
    return (i, end) if number % 97 == 1 else None


def parse_ssn(text: str, i: int):
    i = run_end(text, i, CUE_FILL)
    s = text[i : i + 11]
    ok = len(s) == 11 and s[3] == s[6] == "-" and all(c in DIGITS for c in s[:3] + s[4:6] + s[7:])
    if not ok or (i + 11 < len(text) and text[i + 11] in DIGITS):
        return None
    return (i, i + 11) if s[:3] not in ("000", "666") and s[4:6] != "00" and s[7:] != "0000" else None


def parse_account(text: str, i: int):
    i = run_end(text, i, CUE_FILL)
    for word in ("number", "no", "nr", "id"):
        if text[i : i + len(word)].lower() == word:
            i = run_end(text, i + len(word), CUE_FILL)
            break
    end = run_end(text, i, DIGITS)
    return (i, end) if 6 <= end - i <= 17 else None


def parse_secret(text: str, i: int, failed: int):
    """The value behind a cue that ends at i (an optional quote closes the cue's own name), and
    the end of the last unquoted run that held none: what begins inside it holds none either."""
    n = len(text)
    if i < n and text[i] in "\"'":
        i += 1
    i = run_end(text, i, BLANKS)
    if i == n or text[i] not in ":=":
        return None, failed
    i = run_end(text, i + 1, BLANKS)
    if i < n and text[i] in "\"'`":
        quote, end = text[i], i + 1
        while end < n and text[end] != quote and text[end] not in "\r\n":
            end += 1
        return (i + 1, end) if end < n and text[end] == quote and end - i > 6 else None, failed
    if i < failed:
        return None, failed
    end = i
    while end < n and text[end] not in VALUE_END:
        end += 1
    run = end
    while end > i and text[end - 1] in ".:!?":
        end -= 1
    value = text[i:end]
    if len(value) >= 8 and any(c.isalpha() for c in value) and any(c.isdigit() for c in value):
        return (i, end), failed
    return None, run


def parse_key(text: str, start: int, i: int, least: int):
    """An issued key whose prefix is text[start:i]; it must not go on from another word."""
    if start and text[start - 1] in WORD:
        return None
    end = i
    while end < len(text) and (text[end] in WORD or text[end] == "-"):
        end += 1
    return (start, end) if end - i >= least else None


def parse_block(text: str, start: int, i: int, close: int):
    """A private-key block whose label starts at i, if the next END line, at close, has the same
    label (of up to 60 characters)."""
    tail = text.find(BLOCK_TAIL, i, i + 60 + len(BLOCK_TAIL))
    if tail < 0 or not text[i:tail].endswith("PRIVATE KEY"):
        return None
    closing = f"{BLOCK_END}{text[i:tail]}{BLOCK_TAIL}"
    return (start, close + len(closing)) if text.startswith(closing, close) else None


CUE_PARSERS = {"iban": parse_iban, "ssn": parse_ssn, "account": parse_account}


def find_spans(text: str, auto) -> list[tuple[str, int, int]]:
    """All spans, by kind in the order of KINDS, then by start."""
    out: dict[str, list] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    failed, close = 0, -1  # ends of secrets: the last failing run, the next END line
    for last, (what, size) in auto.iter(text):
        i = last - size + 1
        if what == "digit":
            if i >= done["ip"]:
                found, done["ip"] = parse_ips(text, i)
                out["ip"] += found
            if i >= done["card"]:
                valid, done["card"] = parse_card(text, i)
                if valid:
                    out["card"].append((i, done["card"]))
        elif what == "at":
            span = parse_email(text, i, done["email"])
            if span:
                out["email"].append(span)
                done["email"] = span[1]
        elif what == "plus":
            if i >= done["phone"] and (span := parse_phone(text, i)):
                done["phone"] = span[1]
                if span[2]:
                    out["phone"].append(span[:2])
        elif what in ("scheme", "www"):
            if i < done["url"]:
                continue
            start, end = i, last + 1
            if what == "scheme":
                while start > done["url"] and text[start - 1] in SCHEME:
                    start -= 1
                if start == i:
                    continue
            while end < len(text) and text[end] not in URL_END:
                end += 1
            while end > last + 1 and text[end - 1] in ".,;:!?)":
                end -= 1
            if end > last + 1:
                out["url"].append((start, end))
                done["url"] = end
        elif what in ("prefix", "block", "secret"):
            if i < done["secret"]:
                continue
            span = None
            if what == "secret":
                span, failed = parse_secret(text, last + 1, failed)
            elif what == "prefix":
                span = parse_key(text, i, last + 1, KEY_PREFIXES[text[i : last + 1]])
            else:
                if close <= last and close < len(text):
                    close = text.find(BLOCK_END, last)
                    close = len(text) if close < 0 else close
                span = parse_block(text, i, last + 1, close)
            if span:
                out["secret"].append(span)
                done["secret"] = span[1]
        elif i >= done[what] and (span := CUE_PARSERS[what](text, last + 1)):
            out[what].append(span)
            done[what] = span[1]
    return [(k, *span) for k in KINDS for span in out[k]]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end)."""

    def run(batches):
        auto = automaton()
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, auto)] if (t := v.as_py()) else []
                for v in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest_columns(found: DataFrame) -> DataFrame:
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest_columns(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))
