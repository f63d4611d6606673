import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, saved, table
from tessera.llm import langid, lm

ID_ROWS = [(i, " ".join(w[(i + k) % len(w)] for k in range(12)), la, "s")
           for la, w in {"en": ["the", "house", "was", "white", "with", "things"], "de": ["das", "Haus", "und", "schön", "nicht", "ich"],
                         "fr": ["le", "château", "où", "était", "très", "beau"]}.items()
           for i in range({"en": 0, "de": 1000, "fr": 2000}[la], {"en": 0, "de": 1000, "fr": 2000}[la] + 40)]


def test_language_of_known_and_unknown_words(spark):
    model = langid.fit(langid.train_rows(table(spark, ID_ROWS)))
    assert model.langs == ["de", "en", "fr"]
    assert model.predict("The house", langid.Memo())[0] == "en"
    assert model.predict("HAUS schönheit", langid.Memo())[0] == "de"  # one unseen word, by its n-grams
    assert model.predict("châteaux", langid.Memo())[0] == "fr"
    assert model.predict("", langid.Memo()) == model.predict(None, langid.Memo()) == model.predict("12 !!", langid.Memo()) == ("und", 0.0)
    for t in ("the", "das le", "zzzz", "ж"):
        assert 0.0 <= model.predict(t, langid.Memo())[1] <= 1.0


def test_back_off_takes_the_longest_known_grams():
    model = langid.Model(["a", "b"], {0: {}, 4: {"<abc": 0}, 3: {"<ab": 0}, 2: {}, 1: {"x": 0}},
                         {0: np.zeros((0, 2)), 4: np.array([[-1.0, -5.0]]), 3: np.array([[-5.0, -1.0]]), 2: np.zeros((0, 2)),
                          1: np.array([[-2.0, -1.0]])})
    assert model.predict("abcd", langid.Memo())[0] == "a" and model.predict("ab", langid.Memo())[0] == "b" and model.predict("xq", langid.Memo())[0] == "b"
    assert model.predict("q", langid.Memo()) == ("a", 0.5)  # nothing known: a tie


def test_fit_takes_the_driver_little_memory(spark):
    import tracemalloc

    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, " ".join(str(1000 * i + k) for k in range(1000)).translate(letters), "en" if i % 2 else "de", "s") for i in range(100, 140)]
    labelled = table(spark, rows)
    tracemalloc.start()
    model = langid.fit(labelled)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    entries = sum(len(s) for s in model.scores.values())
    assert len(model.known) == 40_000 and model.langs == ["de", "en"]
    assert peak < 400 * entries, peak / entries


def test_memo_may_fill_up(monkeypatch):
    monkeypatch.setattr(langid, "MEMO", 3)
    model = langid.Model(["a", "b"], {0: {}, 4: {}, 3: {}, 2: {}, 1: {"x": 0, "y": 1}},
                         {o: np.array([[-1.0, -2.0], [-4.0, -1.0]]) if o == 1 else np.zeros((0, 2)) for o in (0, 4, 3, 2, 1)})
    words = ["x", "y", "xx", "yy", "xy", "x", "y"]
    assert np.allclose(langid.Memo().total(model, words), sum(model.back_off(w) for w in words))


def test_language_id_rows(spark, tmp_path):
    rows = [*ID_ROWS, *[(r[0] + 5000 if r[0] is not None else None, *r[1:]) for r in AWKWARD]]
    got = langid.op9_language_id(spark, saved(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (5001, 5002, 5005)] == ["und"] * 3
    assert by[None]["held_out"] is False and by[5007]["lang_pred"] == "en"
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)


def test_language_id_without_training(spark):
    empty = table(spark, [])
    model = langid.fit(langid.train_rows(empty))
    assert model.predict("words", langid.Memo()) == ("und", 0.0)
    assert langid.identify(empty, model).count() == 0


def test_held_out_accuracy(spark):
    got = langid.op9_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


@pytest.fixture(scope="module")
def lm_case(spark, tmp_path_factory):
    base = [r for r in AWKWARD if r[0] is None or r[0] < 7]
    rows = base + [(100 + i, f"The cat sat on mat {i} and saw rare{i * 7919}\tthing", "en", "s") for i in range(50)]
    rows += [(300 + i, f"der Hund lag auf dem Bett {i}", "de", "s") for i in range(50)]
    path = saved(spark, tmp_path_factory.mktemp("lm"), rows)
    return rows, lm.op5_lm_scoring(spark, path).collect()


def test_base_score_against_brute_force(lm_case):
    rows, got = lm_case

    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    train = Counter()
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted(((str(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)),
                    round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, *_ in rows))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}


def test_tail_tokens_are_exact(spark, tmp_path, monkeypatch, lm_case):
    rows, whole = lm_case
    monkeypatch.setattr(lm, "HEAD", 12)  # nearly all tokens go through the join
    monkeypatch.setattr(lm, "FLUSH", 20)
    got = lm.op5_lm_scoring(spark, saved(spark, tmp_path, rows)).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
    assert sorted(map(key, got)) == sorted(map(key, whole))


def test_class_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    seq = []
    for _ in range(3000):  # two "languages" with words 1..5 and 6..10
        seq += [0, *rng.integers(1, 6, 6).tolist()] if rng.random() < 0.5 else [0, *rng.integers(6, 11, 6).tolist()]
    codes, counts = np.unique(lm.triple_codes(np.array(seq)), return_counts=True)
    log_p = lm.train(codes, counts)
    assert np.allclose((10.0 ** log_p).sum(axis=1), 1.0)
    same, other = log_p[3 * lm.CLASSES + 2, 4], log_p[3 * lm.CLASSES + 2, 8]
    assert same > other + 1.0
    unigram = np.bincount(codes % lm.CLASSES, weights=counts, minlength=lm.CLASSES) / counts.sum()
    c = codes % lm.CLASSES
    assert (counts * log_p[codes // lm.CLASSES, c]).sum() > (counts * np.log10(unigram[c])).sum()


def test_every_counted_triple_is_trained_on():
    size = lm.CLASSES
    codes = np.array([(1 * size + 2) * size + 3, (5 * size + 6) * size + 7, (8 * size + 9) * size + 10])
    log_p = lm.train(codes, np.array([10**9, 20, 20]))  # a draw of a few million would miss the rare ones
    assert min(log_p[5 * size + 6, 7], log_p[8 * size + 9, 10]) > math.log10(20 / 10**9) + 2
    assert log_p[5 * size + 6, 7] > log_p[5 * size + 6, 10] + 0.3 and log_p[8 * size + 9, 10] > log_p[8 * size + 9, 7] + 0.3


def test_triples_in_parts_of_a_stored_table(spark, monkeypatch):
    size, rng = 12, np.random.default_rng(1)
    codes = np.unique(rng.integers(0, size**3, 600))
    counts = rng.integers(1, 40, len(codes))
    rows = spark.createDataFrame(list(zip(codes.tolist(), counts.tolist(), strict=True)), "code bigint, n bigint")
    fit = lambda scores: (counts * (scores.first[codes // size**2, codes % size] + scores.second[codes // size % size, codes % size]
                                    - scores.norm[codes // size**2, codes // size % size])).sum() / counts.sum()
    whole = fit(lm.train_stored(rows, size))
    log_p = lm.train(codes, counts, size)  # one part: the same as the plain loop
    assert abs(whole - (counts * log_p[codes // size, codes % size]).sum() / counts.sum()) < 1e-5
    monkeypatch.setattr(lm, "PART_TRIPLES", 60)
    monkeypatch.setattr(lm, "SLICE", 50)
    unigram = np.bincount(codes % size, weights=counts) / counts.sum()
    parts = fit(lm.train_stored(rows, size))
    assert parts > (counts * np.log10(unigram[codes % size])).sum() / counts.sum() and abs(parts - whole) < 0.2
    assert parts == fit(lm.train_stored(rows.repartition(7), size))  # sums do not depend on the tasks


def test_classes_grow_with_the_training_tokens():
    assert lm.class_numbers(0, 0) == lm.class_numbers(100_000, 5_000) == (lm.FREQUENT, lm.SPELLED)
    sizes = [1 + sum(lm.class_numbers(n, 10**7)) for n in (10**7, 10**8, 10**9, 10**10)]
    assert sizes == sorted(sizes) and all(b > 2 * a for a, b in zip(sizes, sizes[1:], strict=False))
    assert lm.class_numbers(10**10, 200) == (200, 100)


def test_model_beats_the_base_on_held_out_text(spark):
    got = lm.op5_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[0] > got[1] and got[2] > 100


def test_scoring_without_rows(spark, tmp_path):
    assert lm.op5_lm_scoring(spark, saved(spark, tmp_path, [])).count() == 0


def test_numerals_are_no_letters():
    assert langid.words_of("½ ② ⅷ ³ 12 _") == []
    assert langid.words_of("Été ½naïve②word 日本") == ["été", "naïve", "word", "日本"]


def test_rare_language_is_learned_and_equal_rows_once(spark):
    rows = [(i, "the cat and the dog of the house", "en", "a") for i in range(300)]
    rows += [(7, "the cat and the dog of the house", "en", "a")] * 200  # a hot id
    rows += [(1000 + i, f"der Hund und das Haus {i}", "de", "a") for i in range(3)]
    sample = langid.fit_sample(table(spark, rows), 20).collect()
    assert sum(r["lang"] == "de" for r in sample) == 3 and sum(r["lang"] == "en" for r in sample) == 20
    model = langid.fit(table(spark, rows), fit_rows=20)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table(spark, [(1, "und der Hund", None, "a"), (2, "the house", None, "a"), (3, "½ ②", None, "a")]), model).collect()}
    assert got == {1: "de", 2: "en", 3: "und"}
