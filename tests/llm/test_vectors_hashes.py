import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, saved, table
from tessera.llm import ordermin, simhash, topk


def brute_top(rows, k, is_query):
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in usable]
    out = []
    for a, (i, v) in enumerate(q):
        if i is not None and is_query(i):
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(q) if b != a)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_topk_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2 + (i % 7) / 3, 8)]) for i in range(400)]
    rows += [(400, None), (401, [1.0] * 7 + [None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [0.5])]
    rows += [(500 + i, rows[50][1]) for i in range(20)]  # ties with a query
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score int, uid int")
    got = topk.top_k(df.repartition(5), F.col("vec_id") % 50 == 0, 5, pivots=8, block_rows=64)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, lambda i: i % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 5).collect()
    assert len(few) == 2


def test_topk_stops_early():
    rng = np.random.default_rng(1)
    far = rng.integers(-10, 10, (2000, 6)) + np.array([300, 0, 0, 0, 0, 0]) * np.sign(rng.normal(size=(2000, 1)))
    far = far.astype(np.int64)
    ids = np.arange(len(far))
    no = np.zeros(len(far), dtype=bool)
    angles = topk.pivot_angles(far, topk.spread_pivots(far, 16))
    hits, evaluated = topk.search_block((ids[:3], ids[:3], no[:3], far[:3], angles[:, :3]), (ids, ids, no, far, angles), 5, chunk=16)
    assert evaluated < 3 * len(far) / 2
    for i in range(3):
        s = far @ far[i]
        best = sorted((-int(s[j]), j) for j in range(len(far)) if j != i)[:5]
        assert [(j, sc) for a, j, sc in hits if a == i] == [(j, -x) for x, j in best]


def test_topk_without_broadcasts_and_with_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6)]) for i in range(300)] + [(600 + i, [0.0] * 6) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(topk, "CELL_BLOCKS", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = topk.top_k(df.repartition(3), F.col("vec_id") % 10 == 0, 4, pivots=16, block_rows=7).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, got)) == brute_top(rows, 4, lambda i: i % 10 == 0)


def test_topk_with_large_components():
    rng = np.random.default_rng(2)
    big = rng.integers(-2**31 + 1, 2**31, (300, 3)).astype("<i4")
    ids, no = np.arange(300), np.zeros(300, dtype=bool)
    angles = topk.pivot_angles(big, topk.spread_pivots(big.astype(np.int64), 8))
    hits, _ = topk.search_block((ids[:4], ids[:4], no[:4], big[:4], angles[:, :4]), (ids, ids, no, big, angles), 3, chunk=8)
    for i in range(4):
        scores = [sum(int(a) * int(b) for a, b in zip(big[i], w, strict=True)) for w in big]
        want = sorted((-s, j) for j, s in enumerate(scores) if j != i)[:3]
        assert [(-s, j) for a, j, s in hits if a == i] == want


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows, radius=4):
    fps = [(i, brute_simhash(t)) for i, t, *_ in rows]
    comp = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {c: min((fps[i][0] for i in range(len(fps)) if comp[i] == c and fps[i][0] is not None), default=None) for c in set(comp)}
    return sorted(((i, f"{f:016x}", least[c]) for (i, f), c in zip(fps, comp, strict=True)), key=str)


def test_simhash_against_brute_force(spark, sample_docs, tmp_path):
    rows = [*sample_docs[:150], *[(10_000 + i if r[0] is not None else None, *r[1:]) for i, r in enumerate(AWKWARD)]]
    rows += [(20_000 + i, sample_docs[3][1] + f" tail{i}", "en", "s") for i in range(40)]
    path = saved(spark, tmp_path, rows)
    got = sorted(map(tuple, simhash.op10_simhash_near_dedup(spark, path).collect()), key=str)
    assert got == brute_components(rows)


def test_simhash_of_no_rows(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_masks_cover_every_pair():
    rng = np.random.default_rng(0)
    masks = simhash.covering_masks()
    assert len(masks) == 31
    for _ in range(3000):
        x = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert any(m & x == 0 for m in masks)


def test_inner_masks_cover_every_pair_and_leave_few_bits():
    rng = np.random.default_rng(1)
    for mask in simhash.covering_masks():
        inner = simhash.inner_masks(mask)
        free = [p for p in range(64) if not mask >> p & 1]
        assert len(inner) == 31 and all(m & mask == mask for m in inner)
        assert max(64 - (m % 2**64).bit_count() for m in inner) <= 16
        for _ in range(100):
            x = sum(1 << int(i) for i in rng.choice(free, 4, replace=False))
            assert any(m & x == 0 for m in inner)


def test_crowded_buckets_lose_no_link(spark):
    # All agree in the bits one mask keeps, so they crowd in one bucket; few of them link.
    mask = simhash.covering_masks()[4]
    free = [p for p in range(64) if not mask >> p & 1]
    rng = np.random.default_rng(6)
    fps = {0}
    for _ in range(250):
        x = sum(1 << int(p) for p in rng.choice(free, 12, replace=False))
        near = x
        for p in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            near ^= 1 << int(p)
        fps |= {x, near}
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")

    def sets(links):
        comp = {x: x for x in fps}
        for a, b in links:
            old, new = comp[a], comp[b]
            comp = {x: new if c == old else c for x, c in comp.items()}
        groups = {}
        for x, c in comp.items():
            groups.setdefault(c, set()).add(x)
        return sorted(map(sorted, groups.values()))

    want = sets([(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 4])
    assert 250 < len(want) < len(fps)
    for bucket in (8192, 100, 1):
        got = [(r["a"], r["b"]) for r in simhash.covering_links(df, bucket=bucket).collect()]
        assert all(a < b and ((a ^ b) % 2**64).bit_count() <= 4 for a, b in got)
        assert sets(got) == want


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (150, 300)]
    got = simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 150, 200, 300)}}


def test_forest_connects_what_pairs_connect():
    fps = np.array([0, 1, 3, 7, 15, 31, 63, 127, 2**40, 2**41 + 2**42 + 2**43 + 2**44 + 2**45], dtype=np.int64)
    links = simhash.forest_links(fps, 2)
    assert len(links) == len(fps) - 2
    assert all((a ^ b).bit_count() <= 2 for a, b in links)


def brute_signature(text):
    """Order MinHash by sorting all k-mers for every hash function."""
    values = ordermin.numbered(ordermin.kmer_hashes(ordermin.code_points(text)))
    out = []
    for m, o in zip(ordermin.MULTIPLIERS.tolist(), ordermin.OFFSETS.tolist(), strict=True):
        ranked = sorted(range(len(values)), key=lambda j: ((int(values[j]) * m % 2**32) ^ o, j))[:ordermin.TUPLE]
        h = np.zeros(1, dtype=np.uint64)
        for j in sorted(ranked):
            h = ordermin.mixed(h * ordermin.BASE + np.uint64(int(values[j]) + 1))
        out.append(int(h[0] >> np.uint64(32)))
    return out


def test_signature_against_sorting():
    for text in ["", "a", "abcdefgh", "abcabcabcabcabcabc" * 5, "the quick brown fox jumps over the lazy dog"]:
        assert ordermin.signature(text).tolist() == brute_signature(text)


def test_blocks_do_not_change_a_signature(monkeypatch):
    text = "some words that go on and on, " * 40
    whole = ordermin.signature(text)
    monkeypatch.setattr(ordermin, "BLOCK", 100)
    assert ordermin.signature(text).tolist() == whole.tolist()


def test_occurrences_are_numbered():
    v = ordermin.numbered(ordermin.kmer_hashes(ordermin.code_points("abcdefgh" * 3)))
    assert len(set(v.tolist())) == len(v)


def test_likeness_follows_edits_and_order():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(600)]
    text, sig = " ".join(words), ordermin.signature(" ".join(words))
    few = " ".join(["changed" if i % 150 == 0 else w for i, w in enumerate(words)])
    halves = " ".join(words[300:] + words[:300])
    other = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(600))
    near, swapped, far = (ordermin.likeness(sig, ordermin.signature(t)) for t in (few, halves, other))
    assert ordermin.likeness(sig, ordermin.signature(text)) == 1.0
    assert near > 0.75 > swapped > 0.25 > far == 0.0


def test_fingerprints_of_all_rows(spark, tmp_path, monkeypatch):
    rows = [r for r in AWKWARD if r[0] is not None] + [(100 + i, f"text number {i} with some words", "en", "s") for i in range(60)]
    path = saved(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = ordermin.with_next(docs, ordermin.fingerprint_pairs, ordermin.FINGERPRINT_SCHEMA, range_rows=7).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    import hashlib

    want = []
    for i, r in enumerate(order):
        a, b = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        want.append((r[0], len(a), hashlib.sha256(e.encode()).hexdigest(),
                     ordermin.likeness(ordermin.signature(a), ordermin.signature(e)),
                     ordermin.likeness(ordermin.signature(a), ordermin.signature(b))))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)
    assert ordermin.with_next(docs.limit(0), ordermin.fingerprint_pairs, ordermin.FINGERPRINT_SCHEMA).count() == 0


def test_fingerprint_of_one_row_and_null_ids(spark):
    one = table(spark, [(1, "only", "en", "s")])
    assert [r["near_next"] for r in ordermin.with_next(one, ordermin.fingerprint_pairs, ordermin.FINGERPRINT_SCHEMA).collect()] == [1.0]
    got = ordermin.with_next(table(spark, [(None, "no id", "en", "s"), (3, "three", "en", "s")]),
                             ordermin.fingerprint_pairs, ordermin.FINGERPRINT_SCHEMA).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "None"]


def test_large_ids_beside_a_null_id(spark):
    big = 2**60 + 1
    docs = table(spark, [(big, "one text of several words", "en", "a"), (None, "another text of words", "en", "a"), (big + 2, "a third", "en", "a")])
    got = ordermin.with_next(docs.coalesce(1), ordermin.fingerprint_pairs, ordermin.FINGERPRINT_SCHEMA).collect()
    assert {r["doc_id"] for r in got} == {big, None, big + 2}
    vectors = spark.createDataFrame([(big, [1.0, 2.0]), (None, [2.0, 1.0]), (big + 2, [3.0, 3.0])], "vec_id bigint, embedding array<float>")
    found = topk.top_k(vectors.coalesce(1), F.col("vec_id") == big, 5).collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(big, big + 2), (big, None)]
