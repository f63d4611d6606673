"""Spelling variants, quality classifier and Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import AWKWARD, saved, table
from tessera.llm import manifest, quality, variants

# ---- op11: spelling variants ----


def brute_words(rows):
    counts, lower = Counter(), {i: i + 32 for i in range(65, 91)}
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if distance_is_one(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def misspelt(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("etaoinshrdluñé") for _ in range(rng.randint(7, 12))) for _ in range(25)]
    base += ["abcdefgh", "abcdefgx", "Señoritas", "x" * 300, "x" * 301, "aaaaaaaa", "aaaaaaab", "bbbbbbba"]
    rows = []
    for i in range(400):
        words = [rng.choice(base) for _ in range(30)]
        for k in range(3):
            w = words[k]
            at = rng.randrange(len(w))
            words[k] = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("etzÿ") + w[at:], w[:at] + rng.choice("etzÿ") + w[at + 1:]])
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words), "en", "s"))
    # A chain of forms: 400, 30 and 2 times.
    rows += [(2000 + i, "quagmire " * 20 + "quagmirk " * (i < 15) * 2 + "quagmikk " * (i < 2), "en", "s") for i in range(20)]
    return rows


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_equal_brute_force(spark):
    rows = misspelt() + AWKWARD
    got = {tuple(r) for r in variants.spelling_variants(table(spark, rows).repartition(4)).select(*COLUMNS).collect()}
    expected = brute_variants(rows)
    assert got == expected
    assert any(f for _, f, *_ in expected) and any(f and f != r for _, f, r, *_ in expected)


def test_variants_with_parts_cut_to_the_last_level(spark, monkeypatch):
    rows = misspelt(9)
    monkeypatch.setattr(variants, "PART_WORDS", 3)  # anagrams share a vector: cut by hash
    rows += [(1000 + i, "abcdefgh abcdefhg abcdegfh badcfehg abcdefgg", "en", "s") for i in range(3)]
    got = {tuple(r) for r in variants.spelling_variants(table(spark, rows)).select(*COLUMNS).collect()}
    assert got == brute_variants(rows)


def test_variants_of_no_words(spark):
    assert variants.spelling_variants(table(spark, [])).count() == 0
    assert variants.spelling_variants(table(spark, [(1, None, "en", "a"), (2, "short", "en", "a"), (3, "onlyonce", "en", "a")])).count() == 0


def test_search_reaches_every_edit():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("etxñ") for _ in range(rng.randint(7, 10))) for _ in range(1500)})
    trie = variants.Trie(words, [1] * len(words), [variants.vector_of(w) for w in words])
    for w in rng.sample(words, 60):
        near = [v for v in words if distance_is_one(w, v)]
        got = list(trie.near([w], variants.vector_of(w)))
        assert got == ([(w, len(near), 1, near[0])] if near else [])
    assert list(variants.Trie([], [], []).near(["etetete"], variants.vector_of("etetete"))) == []


# ---- op12: quality classifier ----

LABELS = "doc_id bigint, quality int, toxic int, LABEL int, score double"


def prose(rng, bad):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 300))]
    return " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in words) if bad else " ".join(words).capitalize() + "."


def quality_rows(n=900, seed=2):
    rng = random.Random(seed)
    bad = [rng.random() < 0.25 for _ in range(n)]
    return [(i, prose(rng, b), "en", "s") for i, b in enumerate(bad)], [(i, int(not b), 0, 1, 0.5) for i, b in enumerate(bad)]


def test_quality_of_rows_held_out(spark):
    rows, labels = quality_rows()
    rows += [(90_000 + (r[0] or 0), *r[1:]) for r in AWKWARD] + [(None, "nobody", "en", "s")]
    labels += [(0, 1, 0, 1, 0.0), (0, 0, 0, 1, 0.0), (None, 1, 0, 1, 0.0), (90_001, None, 0, 1, 0.0), (90_002, 7, 0, 1, 0.0)]
    docs, told = table(spark, rows), spark.createDataFrame(labels, LABELS)
    model = quality.fit(docs.repartition(3), told, fit_pieces=300, fit_rows=200)
    got = quality.classify(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {i: q for i, q, *_ in labels[:900]}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    again = quality.fit(docs.repartition(5), told, fit_pieces=300, fit_rows=200)
    assert sorted((str(r[0]), r["score"]) for r in quality.classify(docs.select("doc_id", "text"), again).collect()) == \
        sorted((str(r[0]), r["score"]) for r in got)


def test_quality_on_the_test_tables(spark):
    path = "/root/testdata/sf0.01"
    got = quality.op12_quality_classifier(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1, 0, 0, 0.0), (4, 1, 0, 0, 0.0)], 1.0)])
def test_quality_without_both_labels(spark, labels, score):
    docs = table(spark, [(1, "one text", "en", "a"), (4, "another", "en", "a"), (2, None, "en", "a")])
    got = quality.classify(docs.select("doc_id", "text"), quality.fit(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert {r["score"] for r in got} == {score} and len(got) == 3


def test_quality_of_no_rows(spark):
    rows, labels = quality_rows(60)
    docs, told = table(spark, rows), spark.createDataFrame(labels, LABELS)
    assert quality.classify(docs.limit(0).select("doc_id", "text"), quality.fit(docs, told)).count() == 0
    assert quality.classify(docs.limit(0).select("doc_id", "text"), quality.fit(docs.limit(0), told)).count() == 0


# ---- op13: Merkle manifest ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_path(levels, at):
    out = []
    for row in levels[:-1]:
        out.append(("", "") if at ^ 1 >= len(row) else (("L" if at % 2 else "R"), row[at ^ 1]))
        at //= 2
    return out


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    groups = {}
    for i, text, lang, source, n in rows:
        leaf = h(field(i), field(source), field(lang), field(n), field(text))
        hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        changed = h(field(i), field(source), field(lang), field(n + 1), field(text)) if hit else leaf
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, changed, i))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])]) for g in langs}
    top = brute_tree([trees[g][-1][0] for g in langs])
    root, out = top[-1][0] if langs else None, []
    for k, g in enumerate(langs):
        for at, (_, _, leaf, changed, i) in enumerate(sorted(groups[g])):
            path = brute_path(trees[g], at) + brute_path(top, k)
            folded = changed
            for side, sibling in path:
                folded = h(sibling, folded) if side == "L" else h(folded, sibling)
            out.append((i, leaf, trees[g][-1][0], root, h(*[s for _, s in path]), folded, folded == root))
    return out


def manifest_table(spark, rows):
    full = [(i, t, la, s, n, "x", 3, 4) for i, t, la, s, n in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, KEY string, idx int, size int"
    return spark.createDataFrame(full, schema)


def key_of(row):
    return tuple(map(str, row))


def manifest_rows():
    rng = random.Random(4)
    rows = [(i, f"text é {i}", "en", "s", i) for i in rng.sample(range(-5000, 5000), 700)]  # two rounds, one hot group
    rows += [(i * 2**40 + 3, "far", "de", None, None) for i in range(-40, 40)]
    rows += [(2**60 + 1, "", None, "s", 0), (None, "no id", "en", "s", 1), (None, "no id either", "en", "s", 1), (5, None, "", "s", 2**63 - 1),
             (7, "lone", "ß", "s", 4), (2**60 + 1, None, "fr", "s", 0), (9, "x" * 5000, "fr", "s", 5000)]
    rows += [(11, "same", "fr", "s", 4)] * 5 + [(11, "other", "fr", "s", 5), (12, "after", "fr", "s", 5)]
    return rows


def test_manifest_equals_brute_force(spark):
    rows = manifest_rows()
    got = [tuple(r) for r in manifest.manifest(manifest_table(spark, rows).repartition(4)).collect()]
    expected = brute_manifest(rows)
    assert sorted(got, key=key_of) == sorted(expected, key=key_of)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 255, 256, 257, 513])
def test_manifest_of_any_size(spark, n):
    rows = [(i * 3, f"t{i}", "en", "s", i) for i in range(n)]
    got = [tuple(r) for r in manifest.manifest(manifest_table(spark, rows)).collect()]
    assert sorted(got, key=key_of) == sorted(brute_manifest(rows), key=key_of)


def test_manifest_of_many_groups_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(manifest, "RANGE_ROWS", 50)
    rows = [(i, "t", f"g{i % 300}", "s", i) for i in range(600)] + [(77, f"copy {i % 3}", "g1", "s", 1) for i in range(300)]
    got = [tuple(r) for r in manifest.manifest(manifest_table(spark, rows)).collect()]
    assert sorted(got, key=key_of) == sorted(brute_manifest(rows), key=key_of)


def test_queries_registered(spark, tmp_path):
    from tessera.llm.queries import ORACLE, QUERIES

    for n in (11, 12, 13):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
    assert "op13_merkle_manifest" in ORACLE
    out = QUERIES["op11_spelling_variants"](spark, saved(spark, tmp_path, AWKWARD))
    assert out.columns == COLUMNS
