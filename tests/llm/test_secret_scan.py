"""Secret scans: the fixed patterns against a scanner without patterns, planted strings for the rest."""

import base64
import hashlib
import random

import pytest
from made_texts import prose

from tablemine.llm import secret_scan
from tablemine.llm.queries import op13_secret_scan

VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
UPPER, LOWHEX = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def run(text, i, chars):
    while i < len(text) and text[i] in chars:
        i += 1
    return i


def assign_at(text, i):
    """(end, value's length) of an assignment that begins at ``i``."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i : i + 8])
    name = next((n for n in NAMES if low.startswith(n)), None)
    if name is None:
        return None
    for quote_first in (1, 0):
        j = i + len(name)
        if quote_first and text[j : j + 1] in ("'", '"'):
            j += 1
        j = run(text, j, " ")
        if text[j : j + 1] not in (":", "=") or j >= len(text):
            continue
        j = run(text, j + 1, " ")
        if text[j : j + 1] in ("'", '"') and text[j : j + 1]:
            j += 1
        end = run(text, j, VALUE)
        if end > j:
            return end, end - j
    return None


def brute(text):
    out, i = [], 0
    while i < len(text):
        found = assign_at(text, i)
        if found and found[1] >= 6:
            out.append((i, 0, found[0]))
        i = found[0] if found else i + 1
    i = 0
    while i < len(text):
        end = run(text, i + 4, UPPER) if text.startswith("AKIA", i) else i
        if end > i + 4:
            if end - i >= 20:
                out.append((i, 1, end))
            i = end
        else:
            i += 1
    i = 0
    while i < len(text):
        end = run(text, i, LOWHEX)
        if end - i >= 24:
            out.append((i, 2, end))
        i = max(end, i + 1)
    return sorted(out)


def random_texts(n):
    rng = random.Random(5)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apiKey", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGHIJ", "0123456789abcdef", "ſecret", "toKen", "\n", "é", "日", "-", "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_base_spans_equal_a_plain_scanner():
    texts = random_texts(20_000)
    assert [secret_scan.base_spans(t) for t in texts] == [brute(t) for t in texts]
    assert sum(len(brute(t)) for t in texts) > 2000


@pytest.fixture(scope="module")
def corpus(spark, plain):
    rng = random.Random(9)
    key = base64.b64encode(rng.randbytes(30)).decode()
    planted = {
        1000: f"def login():\n    session.headers['Authorization'] = 'Bearer {key}'\n",
        1001: f"the client secret is\n{key}\nand nothing else " + prose(rng, 50),
        1002: "call getAccessTokenFromSession(token) with your_password_here or your_api_key_here or xxxxxxxxxxxxxxxxxxxxxxxx after the token",
        1003: f"a picture {key} far from everything " + prose(rng, 50),
        1004: f"token = {key} and AKIA{'Z7' * 10} then 0123456789abcdef01234567",
        1005: "token " * 3000 + " secret zzzzzzzzzzzzzzzzzzzzzzzz1",
    }
    extra = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    return key, plain.select("doc_id", "text").unionByName(extra)


def test_strings_that_nothing_explains_are_reported(corpus):
    key, df = corpus
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    of = lambda d: [(s.kind, s.secret) for s in got[d].spans]
    assert of(1000) == of(1001) == [("novel", key)]
    assert of(1002) == of(1003) == of(1005) == []
    assert [k for k, _ in of(1004)] == ["assign", "access", "hex"]
    assert all(s.novelty >= secret_scan.NOVELTY for r in got.values() for s in r.spans if s.kind == "novel")
    assert all(r.text[s.start : s.end] == s.secret for r in df.collect() for s in got[r.doc_id].spans)


def test_awkward_rows(awkward, empty):
    got = secret_scan.scan(awkward).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in awkward.collect())
    assert secret_scan.scan(empty).count() == 0


def test_query_against_the_plain_scanner(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op13_secret_scan(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        want, r = brute(t), got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("novel")] == (joined.split(",") if joined or not r.spans else [])
