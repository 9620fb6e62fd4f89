"""The corpus operators beside SQL, brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarifa.llm import bpe, chat, exact_dedup, html, importance, line_dedup, mixing, quality, simhash, token_counts
from tarifa.llm.queries import MIX_SCHEDULES, QUERIES, SQL, word_bpe

from ..compare import differences, needs_data

#: Columns of documents, and some whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, size long, fp long, digest string, h int, label string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3000


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, 0, "d", 1, 2, "x", 3, "l") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", " \t\n", LONG, LONG, LONG + "end", "a b c", "a  b c", "#$% ***", "Ünïcode 𝛼 Σ ﬁ", "<|endoftext|> x <|startoftext|>"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    folder = needs_data("sf0.001")
    assert differences(QUERIES[name](spark, folder), folder, SQL[name]) == []


@pytest.mark.parametrize("texts", [EDGES, []])
def test_kept_rows_have_the_columns_of_documents(spark, texts):
    docs = docs_of(spark, texts)
    for out in (
        quality.kept_documents(docs), exact_dedup.distinct_documents(docs), simhash.first_of_each(docs),
        mixing.mixed_documents(docs, MIX_SCHEDULES), line_dedup.without_repeats(docs),
    ):
        assert out.columns == docs.columns
        assert out.count() <= 2 * len(texts)


def test_first_of_each_takes_any_column_names(spark):
    """Columns named like the operator's own, and one whose name holds a dot."""
    names = ("gone_id", "repeated_id", "best_id", "best_fp", "stays", "no_id", "root", "component_id", "first_id", "fp", "doc", "a.b")
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names)
    rows = [(3, "A"), (5, "A"), (5, "B"), (None, "A"), (None, "A"), (6, "q r s"), (6, "q r s")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
    out = simhash.first_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, "A"), (5, "B"), (6, "q r s")]


def brute_exact(rows):
    drop, groups = str.maketrans("", "", " \t\n\x0b\x0c\r"), defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(drop)].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    """With one byte of digest, different texts share digests and must be told apart by their bytes."""
    rng = random.Random(1)
    texts = EDGES + [" ".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(400)]
    found = exact_dedup.assign(docs_of(spark, texts).repartition(7), digest_bytes=digest_bytes)
    assert {r.doc.doc_id: (r.keep_id, r.group_size) for r in found.collect()} == brute_exact(enumerate(texts))


REPEATED = [(3, "A b c d e"), (5, "A b c d e"), (5, "f g h i j"), (7, "x y"), (7, "x y"), (None, "n u l l"), (None, "n u l l"), (None, ""), (9, None), (5, "A bcd e "), (2, "q r s"), (2, "q rs")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup_keeps_one_row_of_each_text(spark, digest_bytes):
    """Whatever ids repeat or are null."""
    docs = docs_of(spark, [t for _, t in REPEATED], [i for i, _ in REPEATED])
    rows = [(r.doc.doc_id, r.doc.text, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(docs, digest_bytes=digest_bytes).collect()]
    assert len(rows) == len(REPEATED)
    kept = sorted(((i, t) for i, t, _, _, k in rows if k), key=str)
    assert kept == sorted([(3, "A b c d e"), (5, "f g h i j"), (7, "x y"), (None, "n u l l"), (9, None), (2, "q r s")], key=str)
    assert sorted(map(str, exact_dedup.distinct_documents(docs, digest_bytes=digest_bytes).select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in kept)
    assert {(i, n) for _, _, i, n, _ in rows} == {(3, 3), (5, 1), (7, 2), (None, 2), (9, 2), (2, 2)}


def test_exact_dedup_by_shuffled_joins(spark, monkeypatch):
    """Beyond the size of a broadcast, and with an index of many parts."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "PART", 10)
    rng = random.Random(1)
    texts = EDGES + [" ".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(300)]
    found = exact_dedup.assign(docs_of(spark, texts).repartition(7))
    assert {r.doc.doc_id: (r.keep_id, r.group_size) for r in found.collect()} == brute_exact(enumerate(texts))


def test_near_dedup_keeps_one_row_of_each_component(spark):
    """Whatever ids repeat or are null."""
    docs = docs_of(spark, [t for _, t in REPEATED], [i for i, _ in REPEATED])
    left = sorted(((r.doc_id, r.text) for r in simhash.first_of_each(docs).collect()), key=str)
    assert left == sorted([(3, "A b c d e"), (5, "f g h i j"), (7, "x y"), (None, "n u l l"), (9, None), (2, "q r s"), (2, "q rs"), (5, "A bcd e ")], key=str)


def test_merge_index_folds_runs():
    index, rng, want = exact_dedup.MergeIndex(), np.random.default_rng(3), Counter()
    for _ in range(30):
        keys = np.array([hashlib.sha256(bytes([x])).digest() for x in rng.integers(0, 200, 20)], "S32")
        want.update(keys.tolist())
        index.put(keys, np.ones(20, int), np.zeros(20, int), np.arange(20), np.ones(20, int))
    keys, n, _, ids, ties, hit = index.compacted()
    assert all(1 <= t <= m for t, m in zip(ties.tolist(), n.tolist()))
    assert dict(zip(keys.tolist(), n.tolist())) == want
    assert hit.tolist() == [want[k] > 1 for k in keys.tolist()]


def test_bpe_merges_few_new_words_at_once():
    """Texts all of new words: what encoding holds beyond the ids stays far below an executor's share of memory."""
    rng = random.Random(3)
    texts = pa.array([" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(1000)) for _ in range(300)])
    encode = bpe.Tokenizer.load(Path(word_bpe()).read_text("utf-8")).encoder()
    tracemalloc.start()
    ids = [encode(part.column(0).to_pylist()) for part in bpe.slices(pa.RecordBatch.from_arrays([texts], ["text"]), texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, ids)) == 300
    assert peak < 150e6


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.no_truncation()
    t.no_padding()
    texts = EDGES + [r.text for r in spark.read.parquet(f"{needs_data('sf0.001')}/documents.parquet").select("text").collect()]
    texts += ["aaaaaaaaab", "İstanbul ΣΑΣ", "it's 12345 don't", "́e é", "日本語 \U0001f600\U0001f600", "\x00\x7f"]
    for r in bpe.encode_and_decode(docs_of(spark, texts), word_bpe()).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.text == t.decode(ids, skip_special_tokens=False)
    apart = bpe.decode(bpe.encode(docs_of(spark, texts[:20]), word_bpe()), word_bpe())
    assert {r.doc_id: r.text for r in apart.collect()} == {r.doc_id: r.text for r in bpe.encode_and_decode(docs_of(spark, texts[:20]), word_bpe()).collect()}


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    texts = EDGES + [r.text for r in spark.read.parquet(f"{needs_data('sf0.001')}/documents.parquet").orderBy("doc_id").select("text").collect()]
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints)
    for r in simhash.near_duplicates(docs_of(spark, texts)).collect():
        assert r.fp % 2**64 == prints[r.doc_id] and r.component_id == roots[r.doc_id]


def test_probing_loses_no_link(spark, monkeypatch):
    """Chains of links in one dense bucket, which is divided again."""
    monkeypatch.setattr(simhash, "BUCKET", 40)
    rng = random.Random(5)
    prints = {0}
    for _ in range(500):
        base = rng.choice(sorted(prints))
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.8 else rng.getrandbits(64))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    plan = simhash.make_plan(*simhash.bit_counts(df), 2)
    assert sum(t + 1 for t in plan.thresholds) == 3
    found = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df, plan.masks, 2)).collect()}
    roots = brute_components(prints)
    groups = defaultdict(set)
    for x in prints:
        groups[found.get(x, simhash.signed(x))].add(x)
    want = defaultdict(set)
    for x, r in zip(prints, roots):
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_links_are_written_before_components(spark, monkeypatch):
    """Before, links were verified and made forests in one stage, by two Python workers for every task."""
    plans, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or components(edges))
    docs = spark.createDataFrame([(k, f"a b c d {k % 5}") for k in range(20)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(found[k] == found[k % 5] for k in range(20))
    assert plans and "MapInArrow" not in plans[0]


@pytest.mark.parametrize("most", [3, 40, simhash.EDGES])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_of_any_number_of_parts(spark, most, kind):
    """Chains, hubs, loops, repeated edges and negative or binary nodes, in parts of a few edges and in one."""
    rng = random.Random(most)
    nodes = list({rng.randrange(-(2**63), 2**63) for _ in range(300)})
    chain = list(zip(nodes[:60], nodes[1:61]))
    hub = [(nodes[61], x) for x in nodes[62:120]]
    pairs = [tuple(rng.sample(nodes[120:], 2)) for _ in range(120)]
    edges = chain + hub + pairs + pairs[:10] + [(x, x) for x in nodes[:3]]
    rng.shuffle(edges)
    name = (lambda x: x) if kind == "long" else lambda x: (x % 2**64).to_bytes(8, "big")
    root = {name(x): name(x) for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(name(a)), find(name(b))
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(5)
    as_key = (lambda x: x) if kind == "long" else bytes
    found = sorted((as_key(r.node), as_key(r.root)) for r in simhash.components(df, most).collect())
    assert found == sorted((x, find(x)) for x in root if find(x) != x)
    assert simhash.components(df.limit(0), most).count() == 0


def brute_lines(rows):
    """Of (id, text) rows in order: (place, words, links, earliest place alike, removed) of their lines; nulls last."""
    key = lambda i, n, k: (i is None, i or 0, n, k)
    lines = sorted((key(i, n, k), i, k, frozenset(x.encode().split())) for n, (i, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if x.encode().split())
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    classes = {w for *_, w in lines}
    links = {c: sum(like(c, d) for d in classes) - 1 for c in classes}
    first = {}
    for _, i, k, w in lines:
        first.setdefault(w, (i, k))
    return [(i, k, *first[w], links[w], any(like(w, v) for *_, v in lines[:n])) for n, (_, i, k, w) in enumerate(lines)]


def line_rows(df):
    return [(r.doc_id, r.line_no, r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in df.collect()]


def texts_of_lines(rng, n):
    line = lambda: " ".join(rng.sample("abcdefghijklmn", rng.randint(1, 9)))
    return [None, "", "\n\n", "a b\nb a\n a  b "] + ["\n".join(line() for _ in range(5)) for _ in range(n)]


@pytest.mark.parametrize("block", [2000, 8])
def test_line_dedup(spark, monkeypatch, block):
    """With a small block every frequent word goes the way of names that may be too frequent."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    texts = texts_of_lines(random.Random(2), 60)
    found = line_rows(line_dedup.line_matches(docs_of(spark, texts)))
    assert sorted(found) == sorted(brute_lines(list(enumerate(texts))))


def test_line_dedup_of_long_lines(spark, monkeypatch):
    """Lines with bitmaps of several widths, near and far; tasks hand on what they gather in small parts."""
    monkeypatch.setattr(line_dedup, "GATHERED", 50)
    monkeypatch.setattr(line_dedup, "COUNTED", 300)
    monkeypatch.setattr(line_dedup, "PART", 20)
    monkeypatch.setattr(line_dedup, "SLICE", 3000)
    rng, lines = random.Random(3), []
    for n in (30, 99, 101, 190, 210, 390, 420, 900, 1700):
        base = rng.sample(range(3000), n)
        lines.append(base)
        for _ in range(6):
            gone = rng.randint(0, n // 8)
            lines.append(base[gone:] + rng.sample(range(3000, 6000), rng.randint(0, n // 8)))
    rng.shuffle(lines)
    texts = ["\n".join(" ".join(f"w{x}" for x in y) for y in lines[k : k + 3]) for k in range(0, len(lines), 3)]
    found = line_rows(line_dedup.line_matches(docs_of(spark, texts).repartition(3)))
    assert sorted(found) == sorted(brute_lines(list(enumerate(texts))))


def test_lines_of_repeated_and_null_ids_are_judged_apart(spark):
    texts = ["alpha beta gamma delta", "unique line number one here", "alpha beta gamma delta", "one\ntwo", "one\ntwo", "two\n\nthree"]
    ids = [1, 5, 5, None, None, None]
    docs = docs_of(spark, texts, ids).coalesce(1)
    assert sorted(map(str, line_rows(line_dedup.line_matches(docs)))) == sorted(map(str, brute_lines(list(zip(ids, texts)))))
    left = sorted(str((r.doc_id, r.text)) for r in line_dedup.without_repeats(docs).collect())
    assert left == sorted(map(str, [(1, texts[0]), (5, texts[1]), (5, ""), (None, texts[3]), (None, ""), (None, "\nthree")]))


def test_lines_of_a_very_long_document(spark, monkeypatch):
    """A document with more lines than are worked on at once."""
    monkeypatch.setattr(line_dedup, "SLICE_LINES", 1000)
    n = 20_000
    text = "\n".join(f"a{k} b{k} c{k} d{k}" for k in range(n))
    rows = line_rows(line_dedup.line_matches(docs_of(spark, [text, "x y\n" + text])))
    assert len(rows) == 2 * n + 1 and sum(r[5] for r in rows) == n
    assert all(r[2:4] == (0, r[1] - 1) for r in rows if r[0] == 1 and r[1])


def test_importance_prefers_the_target(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choices(["river", "stone", "cloud", "tree"], k=30))
    bad = lambda: " ".join(rng.choices(["buy", "click", "cheap", "win"], k=30))
    texts = [good() if i % 2 else bad() for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    rows = importance.resample(docs_of(spark, texts), labels, share=0.5).collect()
    held_out = [(r.log_weight > 0) == bool(r.doc_id % 2) for r in rows if 100 <= r.doc_id < 400]
    assert np.mean(held_out) > 0.95
    keys = sorted((r.sample_key for r in rows), reverse=True)
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in rows if r.sample_key >= keys[201 - 1]}
    assert all(r.log_weight == 0 for r in rows if r.doc_id >= 400)
    assert importance.resample(docs_of(spark, []), labels).count() == 0


def brute_grams(text, buckets):
    words = [xxhash.xxh64_intdigest(w) for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    out, mask = Counter(w % buckets for w in words), 2**64 - 1
    for a, b in zip(words, words[1:]):
        pair = (a * 0x9E3779B97F4A7C15 & mask ^ b) * 0xC2B2AE3D27D4EB4F & mask
        out[(pair ^ pair >> 29) % buckets] += 1
    return out


def test_importance_weights_equal_brute_force(spark):
    """Both models, the weights, the noise and the sample; labels that repeat, lack documents or are null; repeated rows."""
    rng, buckets = random.Random(11), 50
    texts = EDGES + [" ".join(rng.choices(["Alpha", "beta", "GAMMA", "délta", "eps"], k=rng.randint(1, 12))) for _ in range(60)]
    ids = [*range(len(texts) - 4), 20, 20, None, None]
    labels = [(20, 1), (20, 1), (21, 1), (22, 0), (999, 1), (None, 1)] + [(i, 1) for i in range(30, 40)]
    rows = importance.resample(docs_of(spark, texts, ids), spark.createDataFrame(labels, "doc_id long, quality int"), share=0.5, buckets=buckets).collect()
    raw, target = Counter(), Counter()
    good = {i for i, q in labels if q == 1 and i is not None}
    for i, t in zip(ids, texts):
        raw += brute_grams(t, buckets)
        target += brute_grams(t, buckets) if i in good else Counter()
    share = [(raw[b] + 1) / (raw.total() + buckets) for b in range(buckets)]
    ratio = [np.log((target[b] + buckets * share[b]) / (target.total() + buckets) / share[b]) for b in range(buckets)]
    want = sorted((str(i), c.total(), round(sum(n * ratio[b] for b, n in c.items()), 9)) for i, c in ((i, brute_grams(t, buckets)) for i, t in zip(ids, texts)))
    found = sorted((str(r.doc_id), r.n_grams, round(r.log_weight, 9)) for r in rows)
    assert [f[:2] for f in found] == [w[:2] for w in want] and np.allclose([f[2] for f in found], [w[2] for w in want], atol=1e-7)
    keys = sorted((r.sample_key for r in rows), reverse=True)
    assert all(r.kept == (r.sample_key >= keys[len(rows) // 2 - 1]) for r in rows)
    g = np.array([r.g for r in spark.range(40_000).withColumnRenamed("id", "doc_id").select(importance.gumbel(3).alias("g")).collect()])
    assert abs(g.mean() - 0.5772) < 0.03 and abs(g.var() - np.pi**2 / 6) < 0.06


def test_importance_ranks_held_out_labels(spark):
    """Fitted on the labels of even ids, measured on those of odd ones."""
    folder = needs_data("sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = importance.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = importance.log_weights(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality").distinct(), "doc_id").collect()
    good, bad = ([r.log_weight / max(r.n_grams, 1) for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 20 and len(bad) > 20
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9


def test_token_counts_on_the_real_vocabulary(spark):
    """Greedy longest match by hand, with the vocabulary the query uses."""
    import public_tokenizers

    pieces = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known, longest = set(pieces), max(map(len, pieces))
    texts = EDGES[:3] + EDGES[6:] + [r.text for r in spark.read.parquet(f"{needs_data('sf0.001')}/documents.parquet").orderBy("doc_id").limit(60).collect()]

    def greedy(word):
        n = 0
        while word:
            size = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in known), 0)
            n += 1 if size else len(word[0].encode())
            word = word[size or 1 :]
        return n

    for r in token_counts.token_counts(docs_of(spark, texts), pieces).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy("▁" + w.decode()) for w in words))
    assert token_counts.token_counts(docs_of(spark, []), pieces).count() == 0


@pytest.mark.parametrize("kind, ids", [("string", ["a", None]), ("double", [1.5, 2.0]), ("date", None)])
def test_chat_edges(spark, kind, ids):
    """Null roles and turns, repeated rows, ties, columns that clash, ids of any type."""
    import datetime

    ids = ids or [datetime.date(2024, 1, 1), None]
    rows = [(ids[0], 1, None, "x", "f"), (ids[0], 1, None, "x", "f"), (ids[0], 2, "assistant", "b", None), (ids[0], 2, "assistant", "a", "g"), (ids[0], None, "user", None, "h"), (ids[1], 1, "assistant", "", "")]
    found = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string, formatted string")).collect()}
    assert set(found) == set(ids)
    assert chat.parse_formatted(found[ids[0]].formatted) == [("user", ""), ("", "x"), ("", "x"), ("assistant", "a"), ("assistant", "b")]
    assert chat.parse_formatted(found[ids[1]].formatted) == [("assistant", "")] and found[ids[1]].spans == []


def test_token_counts_equal_greedy_match(spark):
    pieces = ["▁a", "▁ab", "abc", "b", "bc", "c", "cab", "▁", "aaaa", "a"]
    match = token_counts.LongestMatch(pieces)

    def greedy(word):
        n = 0
        while word:
            size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
            n += 1 if size else len(word[0].encode())
            word = word[size or 1 :]
        return n

    rng = random.Random(6)
    for _ in range(3000):
        word = "▁" + "".join(rng.choices("aabbcé", k=rng.randint(0, 12)))
        assert match.count(word) == greedy(word)
    texts = EDGES
    for r in token_counts.token_counts(docs_of(spark, texts), pieces).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy("▁" + w.decode()) for w in words))


def test_chat_template_and_round_trip(spark):
    run = chat.compile_template("{% for m in ms %}{{ loop.index }}{% if m.a == 'x' %}[{% generation %}{{ m.b|upper }}{% endgeneration %}]{% else %}-{% endif %}{% endfor %}{{ 1 + 2 }}{# no #}")
    assert chat.render(run(ms=[{"a": "x", "b": "hi"}, {"a": "y", "b": ""}])) == ("1[HI]2-3", [(2, 4)])
    for bad in ("{% if x %}", "{{ x.y() }}", "{{ x[0] }}", "{% for %}{% endfor %}", "{{ x|nope }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    says = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "\n<|", "", None, "a\\<|b", LONG]
    turns = [(c, k, "assistant" if k % 2 else "us<|er\n", s) for c in (1, 2) for k, s in enumerate(says)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        assert chat.parse_formatted(r.formatted) == [(role, s or "") for c, _, role, s in turns if c == r.conv_id]
        loss = "".join(chat.unescape(r.formatted[s.begin : s.end]) for s in r.spans)
        assert loss == "".join(s or "" for c, k, _, s in turns if c == r.conv_id and k % 2)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_html_extraction(spark):
    frame = "<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><nav><a href=/>Home</a></nav><main><article><h1>{0}</h1>{1}</article></main><aside>Ad</aside><div class='comments'><p>me too</p></div><footer>Foot</footer></body></html>"
    bodies = [("One", "<p>A &amp; b\n c<br>d</p><p>More&nbsp;x</p>"), ("Two", "<p>Only</p><ul><li>i<li>j</ul>"), ("Three", "<form><p>Sign</p></form><p>End</p>")]
    pages = [(k, "http://h.example/x", frame.format(*b)) for k, b in enumerate(bodies)]
    pages += [(3, None, None), (4, "http://h.example/y", ""), (5, "http://other.example/", "<p>Unclosed <b>text")]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {0: "One\nA & b c d\nMore x", 1: "Two\nOnly\ni\nj", 2: "Three\nEnd", 3: "", 4: "", 5: "Unclosed text"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    row = html.wrappers(spark.createDataFrame(pages[:3], "page_id long, url string, html string")).first()
    assert row.pages == 3 and "#" in row.wrapper and "?" in row.wrapper


PAGES = "page_id long, url string, html string"


def test_html_keeps_slots_and_drops_constants(spark):
    """Pages of one outline: a notice of any class is constant over them, a section of a listed word isn't."""
    frame = "<body><article><div class='box-7'>We use your data.</div><h1>Title {0}</h1><div class='social-history'><p>Then {0}</p></div><p>By <b>Ann {0}</b></p></article></body>"
    pages = spark.createDataFrame([(k, "http://h.example/", frame.format(k)) for k in range(4)], PAGES)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {k: f"Title {k}\nThen {k}\nBy Ann {k}" for k in range(4)}
    row = html.wrappers(pages).first()
    assert "We use your data." in row.wrapper and "Title" not in row.wrapper
    copies = spark.createDataFrame([(k, "http://h.example/", frame.format(0)) for k in range(2)], PAGES)  # nothing to tell by
    assert {r.text for r in html.extract(copies).collect()} == {"We use your data.\nTitle 0\nThen 0\nBy Ann 0"}  # nor by parts of names inside an article


def texts_of_pages(spark, pages):
    """The texts of (url, html) pages, with columns beside that no operator knows."""
    rows = [(k, u, h, "x", 1) for k, (u, h) in enumerate(pages)]
    found = html.extract(spark.createDataFrame(rows, f"{PAGES}, host string, main int")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_html_pages_that_lists_misread(spark):
    """Boilerplate that only the wrapper knows; names that begin or end with a listed word; numbers in names."""
    shop = "<body><div class='zz1'>Buy now, site boilerplate</div><div class='zz2'><p>{0}</p><p>More {0}</p></div></body>"
    story = "<body><div class='promo-story'><h1>{0}</h1><p>" + "A long tale of {0}. " * 9 + "</p></div><p>foot</p></body>"
    alert = "<body><article><p>One</p><div class='widget-alert'><p>Two</p></div></article></body>"
    pages = [("http://a/", shop.format("x")), ("http://a/", shop.format("y")), ("http://b/", story.format("q")), ("http://c/", alert), ("http://d/", story.format("r")), ("http://d/", story.format("s"))]
    tale = lambda x: " ".join([f"A long tale of {x}."] * 9)
    assert texts_of_pages(spark, pages) == ["x\nMore x", "y\nMore y", f"q\n{tale('q')}\nfoot", "One\nTwo", f"r\n{tale('r')}", f"s\n{tale('s')}"]


def test_html_deep_and_long_pages(spark):
    deep = "<body>" + "<div>" * 5000 + "<nav><ul><li>Menu item</ul></nav><article><p>Text {0}</p></article>" + "</div>" * 5000
    long = "<body><article>" + "".join(f"<h2>Part {k}</h2><p>Words {k} of {{0}}</p>" for k in range(3000)) + "</article></body>"
    odd = "<body><article>" + "".join(f"<{'ph'[k % 7 % 2]}{'2' * (k % 7 % 2)}>{k} of {{0}}</{'ph'[k % 7 % 2]}{'2' * (k % 7 % 2)}>" for k in range(2000)) + "</article></body>"
    pages = [(f"http://{n}/", page.format(k)) for n, page in enumerate((deep, long, odd)) for k in "ab"]
    found = texts_of_pages(spark, pages)
    assert found[:2] == ["Text a", "Text b"]
    assert found[2] == "\n".join(x for k in range(3000) for x in (f"Part {k}", f"Words {k} of a")) and found[5] == "\n".join(f"{k} of b" for k in range(2000))


def test_wrappers_have_repeated_groups_of_several_elements(spark):
    pages = [(k, "http://h/", "<body><div>Site</div>" + "".join(f"<h2>t{k}{i}</h2><p>b{k}{i}</p>" for i in range(k)) + "</body>") for k in (1, 2, 3)]
    assert html.wrappers(spark.createDataFrame(pages, PAGES)).first().wrapper == '<body><div>"Site"</>(<h2>#</><p>#</>)+</>'
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abc", k=rng.randint(0, 9)) for _ in "xy")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html.common(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)


def test_html_blocks_are_found(spark):
    """Precision and recall of blocks over hosts whose templates differ and whose classes say nothing."""
    rng, pages, want = random.Random(9), [], []
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    for h in range(12):
        notice, side, foot = words(6), words(8), words(5)
        for _ in range(8):
            body = [words(rng.randint(8, 40)) for _ in range(rng.randint(2, 7))]
            paragraphs = "".join(f"<p>{b}</p>" for b in body)
            advert = f"<div class=ad>{words(9)}</div>" if rng.random() < 0.5 else ""
            holder = ("<article>{}</article>", "<main><div>{}</div></main>", "<div class=c1>{}</div>")[h % 3].format(advert + paragraphs)
            pages.append((f"http://h{h}/", f"<body><div class=c2>{notice}</div><nav><a href=/>{words(2)}</a></nav>{holder}<div class=c3><p>{side}</p></div><footer>{foot} {words(1)}</footer></body>"))
            want.append(body)
    found = [set(t.split("\n")) for t in texts_of_pages(spark, pages)]
    hit = sum(len(f & set(w)) for f, w in zip(found, want))
    assert hit / sum(map(len, found)) > 0.99 and hit / sum(map(len, want)) > 0.99


def test_html_keeps_what_stands_beside_the_body(spark):
    """Without an article element, and on pages of a template that few of a host's pages have."""
    frame = "<body><div class='x'>Site</div><h1>Title {0}</h1><div id='b'><p>" + "word {0} " * 40 + "</p></div><p>End {0}</p></body>"
    pages = spark.createDataFrame([(k, "http://h.example/", frame.format(k)) for k in range(4)], PAGES)
    body = {k: " ".join([f"word {k}"] * 40) for k in range(4)}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {k: f"Title {k}\n{body[k]}\nEnd {k}" for k in range(4)}
    most = [(k, "http://o.example/", f"<body><article><p>{body[0]} {k}</p></article></body>") for k in range(20)]
    few = (20, "http://o.example/", f"<body><article><p>In short</p></article><div><article class='story'><p>{body[1]}</p></article></div></body>")
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame([*most, few], PAGES)).collect()}
    assert found[20] == body[1] and found[3] == f"{body[0]} 3"


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    texts = EDGES + ["w " * rng.randint(0, 40) for _ in range(300)]
    rows = mixing.mix(docs_of(spark, texts), MIX_SCHEDULES).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r.doc.source] += r.taken
        size[r.doc.source] += r.size
        target[r.doc.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for s in target:
        assert abs(taken[s] - target[s]) < 1 and target[s] <= 2 * size[s] + 1e-6
    assert abs(sum(target.values()) - min(1.5 * sum(size.values()), 2 * sum(size.values()))) < 1e-3
    again = mixing.mix(docs_of(spark, texts).repartition(5), MIX_SCHEDULES).collect()
    assert sorted((r.doc.doc_id, r.taken, r.position or -1) for r in rows) == sorted((r.doc.doc_id, r.taken, r.position or -1) for r in again)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_mixing_of_repeated_and_null_ids(spark, monkeypatch, broadcast):
    """Rows that share an id, or have none, are documents of their own; more sources than schedules, and than are broadcast."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3, None, None, k]), "w " * rng.randint(0, 30), rng.choice([None, "a", "b", "c", "d", "é", "Z"])) for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, MIX_SCHEDULES).collect()
    assert len(found) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in found:
        taken[r.doc.source] += r.taken
        size[r.doc.source] += r.size
        target[r.doc.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size >= r.size
    assert size == Counter({s: sum(t.count("w") for _, t, x in rows if x == s) for s in {x for *_, x in rows}})
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    weigh = dict(zip(sorted(s for s in size if s is not None), (3, 1, 2) * 3)) | {None: (3, 1, 2)[len([s for s in size if s is not None]) % 3]}
    open_ = [s for s in size if target[s] < 2 * size[s] - 1e-6]
    assert len({round(target[s] / weigh[s], 6) for s in open_}) == 1
    key = lambda rs: sorted((str(r.doc.doc_id), str(r.doc.source), r.size, r.taken) for r in rs)
    assert key(found) == key(mixing.mix(docs.repartition(4), MIX_SCHEDULES).collect())


def test_curriculum_inverts_its_integral(spark):
    ramp = ((0.0, 0.0), (0.5, 1.0), (1.0, 3.0))
    shares = [k / 50 for k in range(50)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    for r in df.select("s", mixing.due_time(F.col("s"), ramp).alias("t")).collect():
        area = r.t**2 if r.t <= 0.5 else 0.25 + (r.t - 0.5) * (1 + 1 + 4 * (r.t - 0.5)) / 2
        assert abs(area / mixing.integral(ramp) - r.s) < 1e-9


def test_pipeline_mixes_along_a_curriculum(spark):
    """The first source's pace falls, the second's is even, the third's rises."""
    import corpus_pipeline

    assert [mixing.integral(s) for s in MIX_SCHEDULES] == [3, 1, 2]
    docs = spark.createDataFrame([(k, "w " * 10, "abc"[k % 3]) for k in range(900)], "doc_id long, text string, source string")
    area = (lambda t: 5 * t - 2 * t * t, lambda t: t, lambda t: t + t * t)
    rows = mixing.placed(docs, MIX_SCHEDULES).collect()
    for r in rows:
        assert abs(area[r.schedule_id](r.position) / mixing.integral(MIX_SCHEDULES[r.schedule_id]) - r.begin / r.target) < 1e-9
    order = [r.source for r in corpus_pipeline.mixed(spark, docs, "").collect()]
    assert len(order) == sum(r.passes for r in rows)
    early = Counter(order[: len(order) // 2])
    whole = Counter(order)
    assert early["a"] > 0.6 * whole["a"] and early["c"] < 0.4 * whole["c"]


def test_quality_edges(spark):
    rows = {r.doc_id: r for r in quality.judge(docs_of(spark, EDGES)).collect()}
    assert len(rows) == len(EDGES)
    assert all(rows[k].n_words == 0 and rows[k].base_failed and not rows[k].kept for k in range(3))
    assert rows[3].n_words == 36000 and rows[3].n_repeat_words == 36000 and rows[3].base_failed
    assert rows[8].n_symbols == 6


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Repeated rows, repeated and null ids, nulls in any column, empty texts, further columns, an empty table."""
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    texts, ids = [a, a, a + " ", b, c, c, d, d + " more", None, "", LONG], [7, 7, 5, 5, None, None, 9, 8, 3, None, 2]
    docs_of(spark, texts, ids).coalesce(1).write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == SCHEMA.replace(",", "").split()[::2], name
    near = brute_print(d) ^ brute_print(d + " more")
    want = [(5, a + " "), (5, b), (None, c), *([(8, d + " more")] if near.bit_count() <= 2 else [(8, d + " more"), (9, d)])]
    assert sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in rows} <= {i for i, _ in want} and all(r.n_tokens > 0 for r in rows)
    docs_of(spark, [a, a], [1, 1]).coalesce(1).write.parquet(f"{tmp_path}/twice/documents.parquet")
    assert len(corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()) <= 2  # one document, as often as the mix begins it
    docs_of(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Its rows, from SQL for the rules and the mix and from brute force for the rest; with near copies added."""
    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{needs_data('sf0.001')}/documents.parquet")
    near = docs.where("size(split(text, ' ')) > 300").withColumns({"doc_id": docs.doc_id + 10_000, "text": F.concat("text", F.lit(" again"))})
    folder = str(tmp_path)
    docs.unionByName(near).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE TABLE documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        db.execute(f"CREATE TABLE k AS {SQL['op9_quality_rules']}")
        db.execute("CREATE TABLE d1 AS SELECT documents.* FROM documents JOIN k USING (doc_id) WHERE kept")
        left = dict(db.execute("SELECT doc_id, text FROM d1").fetchall())
        left = {i: left[i] for i, (keep, _) in brute_exact(left.items()).items() if keep == i}
        ids = sorted(left)
        roots = brute_components([brute_print(left[i]) for i in ids])
        near = [i for k, i in enumerate(ids) if roots[k] == k]
        db.execute(f"CREATE TABLE d3 AS SELECT * FROM d1 WHERE doc_id IN ({','.join(map(str, near))})")
        db.execute("DROP TABLE documents; ALTER TABLE d3 RENAME TO documents")
        mixed = db.execute(f"SELECT doc_id, (taken > 0)::INT + (taken > size)::INT FROM ({SQL['op10_mixing']})").fetchall()
    t = Tokenizer.from_file(word_bpe())
    t.no_truncation()
    t.no_padding()
    want = []
    for i, passes in mixed:
        tokens = t.encode(left[i], add_special_tokens=False).ids
        row = (i, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(tokens, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * passes
    assert len(near) < len(ids) < docs.count() * 2
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(want)
