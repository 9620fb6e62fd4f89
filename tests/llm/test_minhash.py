"""MinHash near-duplicates beside SQL and brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarifa.llm import common, minhash
from tarifa.llm.queries import QUERIES, SQL

from ..compare import differences, needs_data

SCHEMA = "doc_id long, text string, n long, set_id string, keys string, bits long, h int, key long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "k", 2, 3, 4) for i, t in rows], SCHEMA)


def shingles(text, width=4):
    words = (text or "").encode().translate(minhash._LOWER).split()
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        name = min((x for x in names[find(i)] if x is not None), default=None)
        out.append((doc_id, len(sets[i]), name, doc_id == name))
    return out


def near_copies(rng, groups=12, most=30, plain=40):
    """Groups of edited copies, by few words and by many, texts of a common passage, and short texts."""
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(plain)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([5, 12, 40, 150, 400]))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper())
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(40)]
    rng.shuffle(texts)
    return texts


EDGES = [None, None, "", " \t\n", "one", "ONE", "one two three", "One  two\tthree", "one two three four", "ü Ü é ﬁ 𝛼", "w " * 20000, "w " * 9000 + "v"]


def test_query_matches_sql(spark):
    folder = needs_data("sf0.01")
    assert differences(QUERIES["op12_minhash_near_dedup"](spark, folder), folder, SQL["op12_minhash_near_dedup"]) == []


@pytest.mark.parametrize("block", [1000, 6])
def test_components_equal_brute_force(spark, monkeypatch, block):
    """Also with buckets so small that they are divided, dealt into blocks, and gone through again; null and repeated ids."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "DIVIDED", 3 * block)
    monkeypatch.setattr(minhash, "PAIRS", 1 << 18 if block > 6 else 5)
    rng = random.Random(block)
    rows = [(k * 7 % 1009, t) for k, t in enumerate(near_copies(rng))] + [(2000 + k, t) for k, t in enumerate(EDGES)]
    rows += [(None, "w " * 9000), (None, "nobody else says this"), (5, "five says this"), (5, "and five says that"), (5, "five says this")]
    found = minhash.near_duplicates(docs_of(spark, rows).repartition(5))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows), key=key)


def test_a_failed_sure_pair_is_made_up_for(spark, monkeypatch):
    """With a margin that calls every pair sure, some fail, and their buckets are gone through again."""
    monkeypatch.setattr(minhash, "MARGIN", -1e9)
    rows = list(enumerate(near_copies(random.Random(9), 8, 40)))
    assert sorted(map(tuple, minhash.near_duplicates(docs_of(spark, rows)).collect())) == sorted(brute(rows))


def test_only_the_buckets_of_failed_pairs_are_gone_through_again(spark, monkeypatch):
    """Texts just below the similarity, called sure, fail; copies of other texts hold, and their buckets rest."""
    monkeypatch.setattr(minhash, "MARGIN", -1e9)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(883)]
    texts = [" ".join(passage + [word() for _ in range(117)]) for _ in range(12)]
    for _ in range(30):
        base = [word() for _ in range(200)]
        texts += [" ".join(base), " ".join([*base, word()])]
    rows = list(enumerate(texts))
    seen, all_rows, later, first = [], [], minhash.later_links, minhash.first_links
    monkeypatch.setattr(minhash, "later_links", lambda rows, *a: seen.append(rows.count()) or later(rows, *a))
    monkeypatch.setattr(minhash, "first_links", lambda rows, *a: all_rows.append(rows.count()) or first(rows, *a))
    assert sorted(map(tuple, minhash.near_duplicates(docs_of(spark, rows)).collect())) == sorted(brute(rows))
    assert seen and seen[0] < all_rows[0]


def test_a_pair_that_fails_hides_no_other(spark):
    """A pair known as wrong is doubtful: it no longer joins two trees, so that the doubtful pairs between them are handed on."""
    base = np.random.default_rng(5).integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(base[k : 300 + k]) for k in (0, 1, 2)]
    ids = [bytes([k]) * 16 for k in range(3)]
    keys = np.zeros(minhash.HALVES, np.int64)
    row = {"key": [0] * 3, "part": [0] * 3, "nth": [0] * 3, "mth": [-1] * 3, "set_id": ids, "n": [len(x) for x in sets], "keys": [keys.tolist()] * 3,
           "others": [keys.astype(np.uint32).tobytes()] * 3, "bits": [minhash.bits_of(x) for x in sets], "root": ids, "side": [0] * 3}
    batch = pa.RecordBatch.from_pydict(row)
    pairs = lambda wrong: {(r["a"], r["b"]): r["sure"] for out in minhash.bucket_links(iter([batch]), wrong) for r in out.to_pylist()}
    plain = pairs(None)
    assert len(plain) == 2 and all(plain.values())
    failed = spark.createDataFrame([(a, b) for a, b in plain], "a binary, b binary")
    now = pairs(minhash.bitmap_of(minhash.pair_hashes(failed)))
    assert set(plain) <= set(now) and not any(now[p] for p in plain) and len(now) == 3


def test_only_sketches_of_sets_that_meet_are_moved(spark):
    rows = [(k, " ".join(str(10 * k + c) for c in range(8))) for k in range(2000)] + [(3000, "w " * 40), (3001, "w " * 39 + "v")]
    sketch = minhash.sketches(docs_of(spark, rows), "doc_id", "text", 4).where("keys IS NOT NULL").select(*minhash._SKETCH)
    classes = minhash.materialize(sketch)
    buckets = minhash.bucket_rows(classes)
    met = {bytes(r.set_id) for r in buckets.select("set_id").distinct().collect()}
    moved = [bytes(r.set_id) for r in minhash.sketches_of(buckets, classes).collect()]
    assert met <= set(moved) and len(moved) < 300 < classes.count()


def test_large_buckets_are_divided_before_they_are_copied(spark, monkeypatch):
    """Rows of a large bucket that isn't linked go on at most once for each second half key, not once for each pair of blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "DIVIDED", 1 << 30)
    rng = np.random.default_rng(3)
    n = 90
    others = rng.integers(0, 1 << 32, (n, minhash.HALVES), np.uint32)
    others[1::30, 5] = 7  # these three meet, and no others
    ids, keys = [bytes([k]) * 16 for k in range(n)], [list(range(minhash.HALVES))] * n
    sets = [np.unique(rng.integers(0, 1 << 63, 50, np.uint64)) for _ in ids]
    rows = [(i, len(x), k, bytearray(o.tobytes()), bytearray(minhash.bits_of(x))) for i, x, k, o in zip(ids, sets, keys, others)]
    classes = spark.createDataFrame(rows, "set_id binary, n long, keys array<long>, others binary, bits binary")
    buckets = spark.createDataFrame([(1, 0, -1, i, n) for i in ids], "key long, nth int, mth int, set_id binary, size long")
    roots = spark.createDataFrame([], "set_id binary, root binary")
    seen, linked = [], minhash.linked
    monkeypatch.setattr(minhash, "linked", lambda members, *a: seen.append({bytes(r.set_id) for r in members.collect()} if members.count() < n else members.count()) or linked(members, *a))
    assert minhash.later_links(buckets, classes, roots).count() == 0
    assert seen == [set(ids[1::30])]


def test_components_equal_brute_force_with_large_buckets(spark, monkeypatch):
    """With large buckets divided in later rounds, beside parts of several blocks and of one."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "DIVIDED", 1 << 30)
    divided, by_second_keys = [], minhash.by_second_keys
    monkeypatch.setattr(minhash, "by_second_keys", lambda *a: divided.append(1) or by_second_keys(*a))
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(60)]
    texts = near_copies(rng, 6, 20, 10) + [" ".join(passage + [word() for _ in range(rng.randint(12, 40))]) for _ in range(60)]
    rows = list(enumerate(texts))
    assert sorted(map(tuple, minhash.near_duplicates(docs_of(spark, rows)).collect())) == sorted(brute(rows))
    assert divided


def test_pairs_of_whole_parts_and_of_sides():
    """Parts of both kinds and of one size lie in one task: of the one all pairs count, of the other those across."""
    zero = np.zeros(8, np.int64)
    m = minhash.Members(np.repeat([0, 1], 4), zero, zero, [b""] * 8, zero, zero, zero, [b""] * 8, zero, np.array([1, 1, 2, 2, 0, 0, 0, 0]))
    pairs = {p for i, j in minhash.pairs_of(m) for p in zip(i.tolist(), j.tolist())}
    assert pairs == {(0, 2), (0, 3), (1, 2), (1, 3)} | {(i, j) for i in range(4, 8) for j in range(i + 1, 8)}


def test_a_bitmap_is_one_job_whatever_the_partitions(spark):
    """Before, each partition was a job of its own."""
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h")).localCheckpoint()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("bitmap", "")
        bitmap = minhash.bitmap_of(hashes)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    h = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    assert minhash.in_bitmap(bitmap, h).all()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) <= 4


def test_few_links_lie_in_one_part(spark, monkeypatch):
    """Before, links and what was verified of them kept as many parts as a shuffle has, and so had every step after them."""
    seen, components = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges: seen.append(edges.rdd.getNumPartitions()) or components(edges))
    rng = random.Random(5)
    rows = list(enumerate(near_copies(rng, 4, 5, 40)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = sorted(map(tuple, minhash.near_duplicates(docs_of(spark, rows)).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == sorted(brute(rows))
    assert seen and max(seen) < 12


def test_gathered_keeps_all_rows_and_the_parts_of_many(spark, monkeypatch):
    rows = spark.range(100).repartition(7)
    for few, parts in ((100, 1), (99, 7)):
        monkeypatch.setattr(common, "FEW", few)
        out = common.gathered(rows)
        assert (sorted(r.id for r in out.collect()), out.rdd.getNumPartitions()) == (list(range(100)), parts)
        bitmap = common.bitmap_of(rows.select(F.xxhash64("id").alias("h")))
        h = np.array([r.h for r in rows.select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
        assert common.in_bitmap(bitmap, h).all() and np.unpackbits(bitmap).sum() <= 100


def test_bitmaps_leave_no_similar_pair_out():
    rng = np.random.default_rng(1)
    for n in (3, 50, 255, 257, 1000, 9000):
        base = rng.integers(0, 1 << 63, n * 2, np.uint64)
        for extra in (0, 1, n // 9, n // 8, n // 4):
            x, y = np.unique(base[:n]), np.unique(np.concatenate((base[extra:n], base[n : n + extra // 9])))
            zero, ones = np.zeros(2, int), np.ones((2, minhash.HALVES), np.uint32)
            m = minhash.Members(zero, zero, zero - 1, [b"x", b"y"], np.array([len(x), len(y)]), ones, ones, [minhash.bits_of(x), minhash.bits_of(y)], np.arange(2), np.zeros(2, int))
            common = len(np.intersect1d(x, y))
            if 5 * common >= 4 * (len(x) + len(y) - common):
                assert len(minhash.candidates(m)[0]) == 1


def test_a_forest_takes_the_best_pairs():
    rng = np.random.default_rng(2)
    i, j = np.triu_indices(30, 1)
    keep = rng.random(len(i)) < 0.2
    i, j = i[keep], j[keep]
    ratio = rng.integers(0, 5, len(i)).astype(float)
    picks, tree = minhash.forest(30, i, j, ratio)
    root, want = list(range(30)), 0.0
    find = lambda x: x if root[x] == x else find(root[x])
    for k in np.argsort(ratio, kind="stable"):
        a, b = find(i[k]), find(j[k])
        if a != b:
            root[a], want = b, want + ratio[k]
    assert ratio[picks].sum() == want
    assert all((tree[a] == tree[b]) == (find(a) == find(b)) for a in range(30) for b in range(30))


def test_an_empty_table_gives_no_rows(spark):
    docs = docs_of(spark, [(1, "a")]).limit(0)
    assert minhash.near_duplicates(docs).collect() == []
    assert sorted(map(tuple, minhash.near_duplicates(docs_of(spark, [(1, None), (2, "")])).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError, match="missing columns"):
        minhash.near_duplicates(docs.drop("text"))
