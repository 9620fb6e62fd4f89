"""Periodic runs beside brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tarifa.llm import runs
from tarifa.llm.queries import QUERIES

from ..compare import needs_data

SCHEMA = "doc_id long, text string, words string, start long, period string, h int, g int, runs string, best string, collapsed string"


def brute_runs(words, min_length=24, exponent=3):
    """All (start, length, period), by trying every period."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(min_length, exponent * p):
                found.setdefault((s, i + p - s), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    """The words of a document, as the query changes them."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def random_words(rng):
    k, n, words = rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 220), []
    while len(words) < n:
        if words and rng.random() < 0.3:
            s = rng.randrange(len(words))
            words += words[s : s + rng.randint(1, 60)] * rng.randint(1, 6)
        else:
            words += [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 12))]
    return words[:n]


@pytest.mark.parametrize("limits", [(24, 3), (4, 2), (10, 2), (2, 2)])
def test_runs_are_those_of_brute_force(limits, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_PAIRS", 97)
    rng = random.Random(limits[0])
    texts = [random_words(rng) for _ in range(250)] + [[], [b"a"], [b"a"] * 300, [b"a", b"b"] * 100 + [b"a"]]
    assert runs.judged(texts, *limits) == [brute_runs(t, *limits) for t in texts]


def test_runs_inside_copied_blocks():
    """Runs inside a stretch that comes again, also within itself, are found at every place."""
    inner = [b"x"] * 30 + [b"y", b"z"] * 20
    part = [b"%d" % i for i in range(50)] + inner + [b"%d" % i for i in range(50, 90)]
    words = part * 4 + [b"end"] + part
    (found,) = runs.judged([words], 24, 3)
    assert found == brute_runs(words) and len(found) == 2 * 5 + 1


def test_the_greatest_is_compared_exactly():
    assert runs.greatest([]) is None
    assert runs.greatest([(9, 30, 10), (0, 27, 9), (4, 31, 10), (5, 62, 20)]) == (4, 31, 10)
    assert runs.greatest([(0, 3 * 10**9 + 1, 10**9), (5, 3 * 10**9 + 2, 10**9)])[0] == 5


def test_query_equals_brute_force(spark):
    folder = needs_data("sf0.01")
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words, r = planted(doc_id, text), got[doc_id]
        found = brute_runs(words) if len(words) < 700 else runs.judged([words], 24, 3)[0]
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, found)).hexdigest()
        some += len(found) > 0
    assert some > 40


def test_rows_of_all_kinds(spark, monkeypatch):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, an empty table; batches of any size."""
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    hit = [i for i in range(20, 200) if zlib.crc32(str(i).encode()) % 10 == 0]
    long = " ".join(f"w{i}" for i in range(3000)) + " ha" * 40
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, "la " * 30), (5, "la " * 30), (5, "la " * 30), (7, long), (8, long), (9, "\x0bÜber ﬁ 𝛼 " * 20), (10, "a b " * 24)]
    rows = [(i, t, "x", 1, "p", 2, 3, "r", "b", "c") for i, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = runs.find_runs(docs).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.collapsed, len(r.runs)) for r in found) == sorted(
        (i or -1, len(w := (t or "").encode().split()), brute_collapsed(w, f := brute_runs(w) if len(w) < 700 else [(3000, 40, 1)]).decode(), len(f)) for i, t in texts
    )
    again = {(r.doc_id, r.text and tuple(r.text.encode().split())) for r in runs.with_planted_runs(docs).collect()}
    assert again == {(i, t and tuple(planted(i, t))) for i, t in texts}
    assert runs.find_runs(runs.with_planted_runs(docs.limit(0))).collect() == []
    with pytest.raises(ValueError, match="missing columns"):
        runs.find_runs(docs.drop("text"))
