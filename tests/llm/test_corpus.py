import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import AWKWARD, saved, table
from tests.llm.test_vectors_hashes import brute_components, brute_simhash
from tessera.llm import mixing, packing, suffix


def brute_repeats(texts, length):
    seen = defaultdict(int)
    datas = [(t or "").encode() for t in texts]
    for d in datas:
        for i in range(len(d) - length + 1):
            seen[d[i:i + length]] += 1
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def digest_rows(out):
    return [(r["doc_id"], len(r["text"].encode()), sum(e - s for s, e in r["spans"]), len(r["spans"]),
             hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect()]


def passages(seed, n):
    """Documents that share passages of all lengths around the limit, at odd places."""
    rng = np.random.default_rng(seed)
    pool = ["".join(chr(97 + c) for c in rng.integers(0, 8, 150)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.integers(0, 6)):
            p = pool[rng.integers(0, len(pool))]
            a, b = sorted(rng.integers(0, 150, 2).tolist())
            text += p[a:b] + "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(0, 30)))
        rows.append((i, text, "en", "s"))
    return rows


@pytest.mark.parametrize(("seed", "group"), [(1, 50_000), (2, 50_000), (3, 2), (4, 8)])
def test_repeats_against_brute_force(spark, seed, group):
    rows = [*passages(seed, 60), (100, "ab" * 200, "en", "s"), (101, "é" * 90, "fr", "s"), (102, None, "en", "s"), (102, "", "en", "s"),
            (103, "same text in two rows that are equal " * 3, "en", "s"), (103, "same text in two rows that are equal " * 3, "en", "s"),
            (None, "an id that is null " * 5, "en", "s"), (None, "another id that is null " * 5, "en", "s")]
    docs = table(spark, rows).select("doc_id", "text").repartition(4)
    got = digest_rows(suffix.remove_repeats(docs, length=48, window=20, group=group))
    want = [(r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 48), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_passages(texts, words, gone):
    """Marks in ``gone`` (bytes per text) the windows of ``words`` + 1 words that are in two texts or more."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    holders = defaultdict(set)
    windows = [[tuple(t[a:b] for a, b in at[i:i + words + 1]) for i in range(len(at) - words)] for t, at in zip(texts, places, strict=True)]
    for j, own in enumerate(windows):
        for w in own:
            holders[w].add(j)
    for j, own in enumerate(windows):
        for i, w in enumerate(own):
            if len(holders[w]) > 1:
                s, e = places[j][i][0], places[j][i + words][1]
                gone[j][s:e] = b"\1" * (e - s)


@pytest.mark.parametrize(("seed", "group", "words"), [(1, 50_000, 5), (2, 4, 5), (3, 50_000, 1), (4, 50_000, 12), (5, 2, 12)])
def test_passages_by_words_against_brute_force(spark, seed, group, words):
    rng = np.random.default_rng(seed)
    pool = [[f"w{x}" if x % 5 else "é" * (x % 4 + 1) for x in rng.integers(0, 9, 40)] for _ in range(4)]
    rows = []
    for i in range(70):
        text = []
        for _ in range(rng.integers(0, 5)):
            p = pool[rng.integers(0, len(pool))]
            a, b = sorted(rng.integers(0, 40, 2).tolist())
            text += p[a:b] + [f"own{x}" for x in rng.integers(0, 999, rng.integers(0, 4))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in text), "en", "s"))
    rows += [(100, "only in here again " * 30, "en", "s"), (101, None, "en", "s"), (102, "", "en", "s"), (None, rows[3][1], "en", "s"),
             (None, "an id that is null and its words " + rows[5][1], "en", "s"), (103, "two rows of the same words and id " * 2, "en", "s"),
             (103, "two rows of the same words and id " * 2, "en", "s")]
    docs = table(spark, rows).select("doc_id", "text").repartition(4)
    out = suffix.remove_repeats(docs, length=90, window=40, group=group, words=words).collect()
    datas = [(r[1] or "").encode() for r in rows]
    gone = [bytearray(len(d)) for d in datas]
    brute_passages(datas, words, gone)
    assert any(any(g) for g in gone) and not all(all(g) for g in gone)
    by_bytes = Counter(d[i:i + 90] for d in datas for i in range(len(d) - 89))
    for d, g in zip(datas, gone, strict=True):
        for i in range(len(d) - 89):
            if by_bytes[d[i:i + 90]] > 1:
                g[i:i + 90] = b"\1" * 90
    want = [(r[0], bytes(b for b, x in zip(d, g, strict=True) if not x)) for r, d, g in zip(rows, datas, gone, strict=True)]
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in out), key=str) == sorted(want, key=str)


def test_word_anchors_in_blocks_cover_every_window():
    text = suffix.Words(" ".join(f"w{i * i % 97}" for i in range(900)).encode())
    at, lo, hi = suffix.word_anchors(text, 50)
    assert lo[0] == 0 and hi[-1] == len(text) - 51 and all(b + 1 == a for a, b in zip(lo[1:], hi, strict=False))
    assert all(0 <= a - f and a + suffix.context_words(50) <= first + 51 for a, f, first in zip(at, hi, lo, strict=True))


def test_stage_cuts_passages_of_over_50_words_of_few_bytes(spark):
    fifty, more = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(51))
    within = " ".join(f"c{i}" for i in range(51))
    assert len(more) < 400
    own = [" ".join(f"own{d}x{i}" for i in range(30)) for d in range(4)]
    rows = [(0, f"{own[0]} {more} end", "en", "s"), (1, f"start {more}\n{own[1]}", "en", "s"), (2, f"{own[2]} {fifty} x", "en", "s"),
            (3, f"{own[3]} {fifty} y {within} z {within}", "en", "s"), (4, more, "en", "s")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_array_dedup(spark, table(spark, rows), "").collect()}
    assert got == {0: f"{own[0]}  end", 1: f"start \n{own[1]}", 2: rows[2][1], 3: rows[3][1]}


def test_repeats_of_the_test_tables(spark, sample_docs, monkeypatch):
    monkeypatch.setattr(suffix, "RANGE_ROWS", 300)  # several ranges
    monkeypatch.setattr(suffix, "RUN_BYTES", 20_000)  # several runs a task
    docs = table(spark, sample_docs).select("doc_id", "text")
    got = digest_rows(suffix.remove_repeats(docs.repartition(3)))
    want = [(r[0], *b) for r, b in zip(sample_docs, brute_repeats([r[1] for r in sample_docs], 400), strict=True)]
    assert sorted(got) == sorted(want)


def test_repeats_of_awkward_rows(spark, tmp_path):
    got = suffix.op8_suffix_dedup(spark, saved(spark, tmp_path, AWKWARD)).collect()
    want = [(r[0], *b) for r, b in zip(AWKWARD, brute_repeats([r[1] for r in AWKWARD], 400), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert suffix.remove_repeats(table(spark, []).select("doc_id", "text")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=25), max_size=7))
def test_loser_tree_merges_and_knows_prefixes(runs):
    blobs = [suffix.front_coded([(s, b"l" * (i % 3), i or None, -i, i) for i, s in enumerate(sorted(r))]) for r in runs]
    got = list(suffix.merged([suffix.read_run(b) for b in blobs]))
    assert [e[1] for _, e in got] == sorted(s for r in runs for s in r)
    for (_, a), (n, b) in zip(got, got[1:], strict=False):
        assert n == suffix.common_prefix(a[1], b[1])


def test_merge_never_compares_a_known_prefix(monkeypatch):
    base = b"p" * 300
    runs = [[base + bytes([i, j]) for j in range(20)] for i in range(8)]
    compared = []
    plain = suffix.common_prefix

    def counting(a, b, known=0):
        n = plain(a, b, known)
        compared.append(n - known)
        return n

    blobs = [suffix.front_coded([(s, b"", 0, 0, 0) for s in r]) for r in runs]
    monkeypatch.setattr(suffix, "common_prefix", counting)
    out = list(suffix.merged([suffix.read_run(b) for b in blobs]))
    assert len(out) == 160
    assert sum(compared) < 8 * 300 + 160  # the long prefix is compared once for each run at most


def test_anchors_cover_all_string_starts():
    data = ("some text " * 20 + "other text, " * 30).encode()
    at, lo, hi = suffix.anchors_of(data, 48, 20)
    assert [i for a, b in zip(lo, hi, strict=True) for i in range(a, b + 1)] == list(range(len(data) - 47))
    assert all(a <= x < a + 20 and b <= x for x, a, b in zip(at, lo, hi, strict=True))


def test_cut_characters_go_whole(spark):
    df = spark.createDataFrame([(b"ab\xc3",), (b"\xa9cd",), (None,)], "b binary")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(suffix.whole_characters(F.col("b"))).collect()] == [b"ab", b"cd", None]


# ---- packing ----


def check_packed(rows, lengths, capacity):
    """rows (key, sequence, offset, length): every piece once, gapless, within capacity."""
    assert sorted((r[0], r[3]) for r in rows) == sorted(lengths)
    by = defaultdict(list)
    for _, s, o, n in rows:
        by[s].append((o, n))
    for placed in by.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize(("block", "over"), [(100_000, 1.02), (150, 1.04)])
def test_packing_uses_few_sequences(spark, block, over):
    rng = np.random.default_rng(4)
    lengths = [(i, int(n)) for i, n in enumerate(rng.integers(1, 65, 1500))]
    pieces = spark.createDataFrame(lengths, "doc_id bigint, length bigint").repartition(3)
    got = packing.pack(packing.stored(pieces, "t"), capacity=64, block=block)
    used = check_packed([(r["doc_id"], r["sequence_id"], r["offset"], r["length"]) for r in got.collect()], lengths, 64)
    assert used <= -(-sum(n for _, n in lengths) // 64) * over + 1


def test_operators_of_the_algorithm_keep_every_piece():
    rng = np.random.Generator(np.random.PCG64(9))
    lengths = rng.integers(1, 60, 300).tolist()
    a, b = (packing.first_grouping(lengths, 64, rng, n) for n in (0.0, 0.3))
    child = packing.mutate(packing.crossover(a, b, lengths, 64, rng), lengths, 64, rng)
    assert sorted(p for places in child[0] for p in places) == list(range(300))
    assert [64 - sum(lengths[p] for p in places) for places in child[0]] == child[1] and min(child[1]) >= 0
    assert packing.restored(packing.dumped(child, 300), lengths, 64)[1] == child[1]
    grown = packing.evolve([a, b], lengths, 64, rng, 30)
    assert packing.fitness(grown[0][1], 64) >= packing.fitness(a[1], 64)


def test_ranked_tokens_equal_library_tokens(sample_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    whole.encode_special_tokens = True
    coder = packing.TextTokenizer(packing.tokenizer_path(), packing.word_pattern())
    texts = [t for _, t, *_ in sample_docs if t][:80]
    texts += ["", " ", "  a  b ", "a \n b", " lead", "trail ", "x  y", "a <|endoftext|> b", "don't 12 34's", "\ta b", "é  \r\n é", "a  b"]
    texts += ["one.\nTwo, three\n\nfour", "a\n's", "\nß\nª²½ µx", "x\n y \nz", "ŉ\n日本 Straße,\nÉté"]
    for t in texts:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_lines_without_spaces_are_cut_in_one_loop():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    coder = packing.TextTokenizer(packing.tokenizer_path(), packing.word_pattern())
    for t in ("\n".join(f"word{i % 5000}" for i in range(100_000)), "日本\n" * 3000, "a\n\nb\nc\r\nd\n" * 2000, "\n" * 3000 + "x\ny"):
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_white_space_is_cut_as_the_pattern_does():
    import random

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    whole.encode_special_tokens = True
    coder = packing.TextTokenizer(packing.tokenizer_path(), packing.word_pattern())
    assert "(?!" not in coder.ranks._pat_str  # words are found without looking ahead
    assert "(?!" in packing.TextTokenizer(packing.tokenizer_path(), r"\s*\n" + packing.AHEAD).ranks._pat_str  # other patterns as they are
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x1d ", "\x1f\x1f", "\x85", "\xa0", "\u2003", "\u200b", "\u3000 ", "a", "b7", "'s", "é", "!", "日"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(5000)] + ["a  b\n\n" * 150_000]  # more than LIST_CHARS
    for t in texts:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:20]


def test_every_token_and_long_runs_equal_library_tokens():
    import random

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    whole.encode_special_tokens = True
    coder = packing.TextTokenizer(packing.tokenizer_path(), packing.word_pattern())
    rng = random.Random(3)
    tokens = [whole.decode([i]) for i in range(whole.get_vocab_size(with_added_tokens=False))]
    texts = tokens + ["".join(rng.choices(tokens, k=3)) for _ in range(20_000)]
    texts += ["a " + "x" * 5000 + " b c\nd", "ab " * 400 + "=" * 600 + ", e  f", "q" + " " * 700 + "r s", "\t" * 2000 + "y z",
              "one two " + "日" * 1500 + " " + "7" * 900 + " three", ("w " * 300 + "v" * 512 + "\n") * 5]
    for t in texts:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_packed_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_path())
    rows = AWKWARD
    got = packing.op4_best_fit_packing(spark, saved(spark, tmp_path, rows)).collect()
    want = []
    for i, t, *_ in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
                 for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(tuple, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)), key=str) == sorted(want, key=str)
    check_packed([(0, r["sequence_id"], r["offset"], r["length"]) for r in got], [(0, w[3]) for w in want], 1024)


def test_packing_nothing(spark, tmp_path):
    assert packing.op4_best_fit_packing(spark, saved(spark, tmp_path, [])).count() == 0


# ---- mixing ----


def mixed(spark, rows, **kw):
    counted = mixing.stored(mixing.count_tokens(table(spark, rows)), "t")
    weights = mixing.stored(mixing.source_weights(counted, **kw), "w")
    return {r["source"]: r for r in weights.collect()}, counted, weights


MIX_ROWS = [(i, "w " * (1 + i % 9), "en", "big" if i % 10 else "small" if i % 20 else "tiny") for i in range(1200)]


def test_weights_meet_the_entropy_or_the_repeats(spark):
    entropy = lambda w: -sum(r["weight"] * np.log(r["weight"]) for r in w.values())
    w, *_ = mixed(spark, MIX_ROWS, entropy_share=0.8, max_epochs=100.0)
    assert abs(sum(r["weight"] for r in w.values()) - 1) < 1e-12 and abs(entropy(w) - 0.8 * np.log(3)) < 1e-9
    w, *_ = mixed(spark, MIX_ROWS, entropy_share=0.8, max_epochs=2.0)
    assert abs(max(r["budget_tokens"] / r["tokens"] for r in w.values()) - 2.0) < 0.01
    w, *_ = mixed(spark, MIX_ROWS, entropy_share=0.1)
    assert all(abs(r["weight"] - r["share"]) < 1e-12 for r in w.values())


@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_blocks_realise_the_weights(spark, bucket_rows):
    w, counted, weights = mixed(spark, MIX_ROWS, entropy_share=0.9, max_epochs=3.0)
    got = defaultdict(list)
    for r in mixing.mix(counted, weights, bucket_rows).collect():
        got[r["source"]].append(r)
    for s, r in w.items():
        own = [(i, 1 + i % 9) for i, _, _, src in MIX_ROWS if src == s]
        whole, rest = divmod(r["budget_tokens"], r["tokens"])
        want = [(i, e) for i, _ in own for e in range(whole)]
        keys = sorted((hashlib.md5(f"{mixing.SEED}|{s}|{whole}|{i}".encode()).hexdigest(), i, n) for i, n in own)
        for _, i, n in keys:
            if rest <= 0:
                break
            want.append((i, whole))
            rest -= n
        assert sorted((x["doc_id"], x["epoch"]) for x in got[s]) == sorted(want)


def test_mixing_edges(spark):
    assert mixed(spark, [])[0] == {}
    w, counted, weights = mixed(spark, AWKWARD)
    assert set(w) == {"a", "b", "c"}  # the null source has no words
    one, counted, weights = mixed(spark, [(1, "a b", "en", None), (1, "a b", "en", None)])
    assert one[""]["weight"] == 1.0 and mixing.mix(counted, weights).count() == 2
    w, counted, weights = mixed(spark, MIX_ROWS, budget=None, max_epochs=2.0)
    assert mixing.mix(counted, weights).select("doc_id").distinct().count() == len(MIX_ROWS)
    assert max(r["budget_tokens"] / r["tokens"] for r in w.values()) < 2.01


# ---- pipeline ----


def test_stages_keep_the_columns_and_clean_documents(spark, sample_docs, tmp_path):
    rows = [*sample_docs[:60], *[(90_000 + (r[0] or 0), *r[1:]) for r in AWKWARD]]
    docs = spark.read.parquet(f"{saved(spark, tmp_path / 'in', rows)}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    lettered = [r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(kept["language_id"]) == sorted(lettered)
    assert len(kept["simhash_near_dedup"]) == len(set(kept["simhash_near_dedup"])) < len(lettered)
    assert kept["simhash_near_dedup"].count(90_004) == 1 and 90_006 not in kept["simhash_near_dedup"]
    assert set(kept["source_mixing"]) == set(kept["suffix_array_dedup"])
    assert set(kept["best_fit_packing"]) == set(kept["source_mixing"])
    check = [(0, r["sequence_id"], r["offset"], r["length"]) for r in docs.collect()]
    check_packed(check, [(0, c[3]) for c in check], 1024)


def test_language_stage_without_labels_and_with_null_labels(spark):
    rows = [(1, "the cat and the dog", None, "a"), (2, None, None, "a"), (3, "12 !!", None, "b"), (4, "日本", None, "b")]
    got = corpus_pipeline.language_id(spark, table(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(1, None), (4, None)]
    rows = [(i, "the cat and the dog", "en", "a") for i in range(20)] + [(i, "der Hund und das Haus", "de", "a") for i in range(20, 40)]
    rows += [(50, "the cat", None, "a"), (51, "das Haus", None, "a"), (52, "das Haus", "en", "a"), (53, "12 !!", "en", "a")]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, table(spark, rows), "").collect()}
    assert got == {**{r[0]: r[2] for r in rows[:40]}, 50: "en", 51: "de", 52: "en"}


def test_near_dedup_keeps_its_rows_when_the_splits_change(spark, tmp_path, monkeypatch):
    rows = [(i, f"unique words number {i * 7919} of text {i * 31} " * 3, "en", "s") for i in range(40)]
    rows += [(1000 + i, r[1], "en", "s") for i, r in enumerate(rows[:10])]
    path = str(tmp_path / "docs")
    table(spark, rows).repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    whole = corpus_pipeline.simhash.components_of
    expected = whole(docs.select("doc_id", "text")).groupBy("component_id").count().collect()

    def components_then_other_splits(*args):
        found = whole(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return found

    monkeypatch.setattr(corpus_pipeline.simhash, "components_of", components_then_other_splits)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "5")
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")
        kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted(r["doc_id"] for r in kept.collect())
    finally:
        for key in ("maxPartitionBytes", "minPartitionNum", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert got == sorted(r["component_id"] for r in expected)


def plain_mix(rows):
    """The (id, text) of each row as often as the mixing stage takes it; rows: (id, text, source)."""
    own = defaultdict(list)
    for i, text, source in rows:
        own[source or ""].append((i, text, len(text.encode().split())))
    tokens = {s: sum(n for *_, n in own[s]) for s in sorted(own)}
    total = sum(tokens.values())
    p = np.array(list(tokens.values())) / total

    def entropy(t):
        w = p**t / (p**t).sum()
        return -(w * np.log(w)).sum()

    def bisect(lo, ok):
        hi = 1.0
        for _ in range(mixing.BISECTIONS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    goal = mixing.ENTROPY_SHARE * np.log(len(p))
    t = 1.0 if entropy(1.0) >= goal else bisect(0.0, lambda t: entropy(t) >= goal)
    over = lambda t: (p**(t - 1)).max() / (p**(t - 1)).min() > mixing.MAX_EPOCHS
    t = bisect(t, over) if over(t) else t
    out = []
    for (s, n), share in zip(tokens.items(), p, strict=True):
        whole, rest = divmod(int(np.floor(share**t / (p**(t - 1)).min() * total + 0.5)), n)
        out += [(i, text) for i, text, _ in own[s]] * whole
        name = lambda i: "" if i is None else i
        for _, i, text, n in sorted((hashlib.md5(f"{mixing.SEED}|{s}|{whole}|{name(i)}".encode()).hexdigest(), i, x, n) for i, x, n in own[s]):
            if rest <= 0:
                break
            out.append((i, text))
            rest -= n
    return out


def plain_pipeline(rows):
    """doc_id, piece, start, length, ids_crc32 of run()'s rows, stage by stage in plain Python."""
    from tokenizers import Tokenizer

    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    first = {}
    component = {}
    for r, (_, fp, least) in zip(rows, plain_components(rows), strict=True):
        component[id(r)] = (least, fp if least is None else "")
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(component[id(r)], r)
    rows = list(first.values())
    rows = [(r[0], text, r[3]) for r, text in zip(rows, plain_without_repeats([r[1] for r in rows], 400), strict=True) if text.strip(" ")]
    coder = Tokenizer.from_file(packing.tokenizer_path())
    coder.encode_special_tokens = True
    out = []
    for i, text in plain_mix(rows):
        ids = [*coder.encode(text, add_special_tokens=False).ids, packing.END_ID]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def plain_components(rows):
    """brute_components with the order of ``rows``."""
    got = {(i, f): c for i, f, c in brute_components(rows)}
    return [(r[0], f, got[r[0], f]) for r in rows for f in [f"{brute_simhash(r[1]):016x}"]]


def plain_without_repeats(texts, length):
    """The texts without what occurs elsewhere; what is left of a cut character goes."""
    seen = defaultdict(int)
    datas = [t.encode() for t in texts]
    for d in datas:
        for i in range(len(d) - length + 1):
            seen[hashlib.md5(d[i:i + length]).digest()] += 1
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i:i + length]).digest()] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_pipeline_against_a_plain_version(spark, sample_docs, tmp_path):
    shared = " ".join(f"shared{i * i}" for i in range(60))
    long = " ".join(f"word{i * 7 % 3001}" for i in range(1500))
    rows = [*sample_docs[:50], *[(r[0] and 90_000 + r[0], *r[1:]) for r in AWKWARD]]  # a component is named by its smallest id
    rows += [(5000 + i, f"{sample_docs[i][1] or ''} and a tail {i}", None, f"src{i % 3}") for i in range(12)]
    rows += [(6000 + i, " ".join(f"own{i * 1000 + j}" for j in range(40)) + f" {shared} end {i}", "en", "src1") for i in range(6)]
    rows += [(7000, long, "en", "src2"), (7001, long + " tail", "en", "src2"), (7002, long, "en", "src2")]
    got = corpus_pipeline.run(spark, saved(spark, tmp_path, rows)).collect()
    want = plain_pipeline(rows)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    check_packed([(0, r["sequence_id"], r["offset"], r["length"]) for r in got], [(0, w[3]) for w in want], 1024)


def test_pipeline_of_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, saved(spark, tmp_path, [])).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
