"""The divergence audit beside SQL and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tarifa.llm import divergence
from tarifa.llm.queries import QUERIES, SQL

from ..compare import differences, needs_data

SCHEMA = "text string, lang string, source string, gid long, a long, b long, n long, docs long, term string, p long, base long, item string, value string, low int"
LOWER = {k: k + 32 for k in range(65, 91)}


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "t", 6, 7, "i", "v", 8) for r in rows], SCHEMA)


def brute(rows, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, having, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
        having[lang].update(set(terms))
    out = set()
    for lang, source in counts:
        kept = [t for t, n in having[lang].items() if n >= 30]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = share(counts[lang, source]), share(langs[lang])
        pairs = [(sum(abs(p[t] - o[t]) for t in kept), s) for m, s in counts if m == lang and s != source for o in [share(counts[m, s])]]
        terms = [(p[t] - q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)}
    return out


def test_query_matches_sql(spark):
    folder = needs_data("sf0.01")
    assert differences(QUERIES["op13_source_divergence"](spark, folder), folder, SQL["op13_source_divergence"]) == []


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    """Nulls, clashing columns, a group without terms, ties by bytes; also with every table joined by a shuffle and small pieces."""
    if small:
        for name, value in (("BROADCAST_ROWS", 0), ("FEW", 2), ("TASK_TERMS", 20), ("TASK_PAIRS", 7)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    terms = [a + b + c for a in ("x", "Y", "é", "ﬁ", "𝛼", "") for b in ("a", "B", "ß") for c in ("", "q", "Q", "qq", "ü")]
    rows = [(" 1-".join(rng.choices(terms, k=rng.randint(0, 40))), rng.choice(["en", "", None]), rng.choice(["s1", "s2", "S", None, "é"])) for _ in range(400)]
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("few words", "xx", "two"), ("12 34", None, "digits"), ("alone " * 3, "yy", "z")] + [("tie me", "zz", "t")] * 40 + [("Tie ME", "zz", None)]
    docs = docs_of(spark, rows).repartition(5)
    found = divergence.audit(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))


def test_first_rows_divide_values_and_bytes(spark, monkeypatch):
    """Thousands of ties of one value, that differ late in their bytes; groups of fewer rows than asked for."""
    monkeypatch.setattr(divergence, "FEW", 10)
    rng = random.Random(4)
    rows = [(1, "prefix" * 3 + f"{rng.randrange(10**6):06d}", 77) for _ in range(5000)] + [(1, f"b{i}", 10**9 - i) for i in range(20)]
    rows += [(2, f"c{i}", i % 3) for i in range(200)] + [(3, f"d{i}", 5) for i in range(50)] + [(4, "e", 0), (5, "\x00", 1023), (5, "", 1023), (5, "é", 1024)]
    rows += [(6, f"v{i}", rng.randrange(1 << 30)) for i in range(3000)] + [(7, "x" * i, 9) for i in range(1, 100)]
    rows = sorted(set(rows))
    got = divergence.first_rows(spark.createDataFrame(rows, "gid long, item string, value long").repartition(4)).collect()
    want = set()
    for gid in range(1, 8):
        own = sorted((r for r in rows if r[0] == gid), key=lambda r: (-r[2], r[1].encode()))[:50]
        want |= {(*r, k) for k, r in enumerate(own, 1)}
    assert sorted(map(tuple, got)) == sorted(want)


def test_an_empty_table_gives_no_rows(spark):
    docs = docs_of(spark, [("a", "b", "c")]).limit(0)
    assert divergence.audit(docs).collect() == []
    with pytest.raises(ValueError, match="missing columns"):
        divergence.audit(docs.drop("lang"))
