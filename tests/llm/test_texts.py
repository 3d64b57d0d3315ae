"""Operators on texts against brute force, on the smallest tables and on odd rows."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from datagauge.llm import language, quality, words
from datagauge.llm.components import connected_components
from datagauge.llm.decontaminate import Index, _near, _similarity, build_index, decontaminated, find_leaks
from datagauge.llm.jaccard import jaccard_join, one_of_each
from datagauge.llm.queries import QUERIES
from datagauge.llm.substrings import _spread, remove_repeats
from datagauge.llm.tokens import Encoder, pack, read_tokens, token_files, unpack

from .conftest import fold, prose, words_of

TOKENIZER = str(path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_words_of_batches():
    texts = ["a b  c", None, "", " x\ty\x0bz\r\n", "é b", "q" * 50]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["skip", *texts]).slice(1)):
        for limit in (1, 7, 1 << 20):
            got = [(int(r), int(n)) for p in words.pieces(column, limit) for r, n in zip(p.rows, p.n_words)]
            assert got == [(i, len(words_of(t))) for i, t in enumerate(texts)]


def thue_morse(n, letters):
    """Words on which polynomial hashes modulo 2^64 collide."""
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_hashes_of_words_alike():
    found = [thue_morse(n, x) for n in (8, 9, 64, 128, 256, 257, 1024, 4096) for x in ("ab", "ba")]
    found += ["a" * n for n in range(1, 40)] + ["b" + "a" * n for n in range(40)]
    buf = np.frombuffer("".join(found).encode(), dtype=np.uint8)
    end = np.cumsum([len(w) for w in found])
    for seed in (0, 1):
        h = words.hash_words(buf, end - [len(w) for w in found], end, seed)
        assert len(set(h.tolist())) == len(set(found))
    assert words.hash_words(buf, end[:1], end[:1], 0) != words.hash_words(buf, end[:1], end[:1], 1)


def test_windows_alike_are_dealt_out():
    a, b = np.array([5, 7, 5, 5, 9, 7, 5], dtype=np.uint64), np.array([1, 1, 1, 2, 1, 1, 1], dtype=np.uint64)
    salt = _spread(a, b)
    assert salt[[3, 4]].tolist() == [0, 0] and sorted(salt[[0, 2, 6]]) in ([-1, 1, 2], [-1, 1, 3], [-1, 2, 3]) and (salt == -1).sum() == 2
    assert len(set(salt[salt > 0].tolist())) == 3 and _spread(a[:0], b[:0]).tolist() == []


def test_a_passage_in_most_texts(spark):
    """One passage in 400 texts, twice in some, in several partitions: gone everywhere, and no task gets all of it."""
    passage = prose(11, 40)
    rows = [(i, " ".join(prose(100 + i, 20) + passage + prose(1000 + i, 15) + (passage if i % 50 == 0 else []))) for i in range(400)] + [(900, " ".join(passage[:34])), (901, " ".join(prose(7, 90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    starts = {i: [tuple(t.split()[k : k + 35]) for k in range(len(t.split()) - 34)] for i, t in rows}
    times = collections.Counter(w for found in starts.values() for w in found)
    gone = {i: {k + j for k, w in enumerate(found) if times[w] > 1 for j in range(35)} for i, found in starts.items()}
    assert got == {i: (len(t.split()), len(gone[i])) for i, t in rows} and got[50][1] >= 80 and got[900] == (34, 0)


def test_words_alike_link_nothing(spark):
    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    docs = spark.createDataFrame([(1, f"one two three four {a}"), (2, f"one two three four {b}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join(docs).collect()} == {1: 1, 2: 2}
    assert one_of_each(docs).count() == 2
    same = " ".join(prose(4, 34))
    docs = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}")], "doc_id long, text string")
    assert [r["n_removed"] for r in remove_repeats(docs).collect()] == [0, 0]


def test_hashes_do_not_depend_on_place():
    piece = next(words.pieces(pa.array(["a bb ccc", "x ccc bb a", "A BB"])))
    h = piece.hashes(fold=True)
    assert h[0] == h[6] == h[7] and h[1] == h[5] == h[8] and len(set(h.tolist())) == 4
    assert piece.hashes(fold=False)[0] != piece.hashes(fold=False)[7]
    assert piece.runs_at(h, np.array([0]), 2) == piece.runs_at(h, np.array([7]), 2)


@pytest.mark.parametrize("task_edges", [500_000, 3])
def test_components(spark, task_edges):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 50), (60, 50), (7, 7), (None, 3), (70, None), (50, 40)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), task_edges=task_edges).collect()
    assert {r["id"]: r["component"] for r in got} == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40, 60: 40}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, k=5):
    w = words_of(fold(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components_of(sets, similar):
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j]):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def test_jaccard_join_equals_brute_force(spark, documents):
    got = jaccard_join(documents).collect()
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in documents.collect()}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(sets, similar)


@pytest.mark.parametrize("counters", [1 << 20, 4096])
def test_jaccard_join_of_families(spark, counters):
    """Chains of small edits, a common passage in all, pairs at the threshold: each link holds, none is added."""
    passage, rows, n = prose(1, 30), [], 0
    for family in range(6):
        base = prose(100 + family, 45 + family) + passage
        for edit in range(12):
            text = list(base)
            for e in range(edit % 5):
                text[(7 * edit + 11 * e) % len(text)] = f"new{edit}"
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n + i, " ".join(passage + prose(900 + i, 3))) for i in range(8)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), counters=counters).collect()
    sets = {i: shingle_set(t) for i, t in rows}
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(sets, similar)


def test_jaccard_join_of_odd_rows(odd_docs, no_docs):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(odd_docs).collect())
    small = {k: n for k, n in got.items() if k[0] not in (8, 10)}
    assert small == {(1, 3, 1): 1, (2, 3, 1): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 0, 5): 1, (6, 1, 6): 1, (7, 1, 6): 2, (None, 3, None): 1, (None, 0, None): 1, (9, 5, 9): 1, (11, 1, 11): 1}
    assert jaccard_join(no_docs).count() == 0 and one_of_each(no_docs).count() == 0
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11]


def without_repeats(texts, window):
    seen = collections.Counter(tuple(w[i : i + window]) for w in map(words_of, texts) for i in range(len(w) - window + 1))
    out = []
    for w in map(words_of, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, documents, sf_dir):
    got = QUERIES["op10_doubled_windows"](spark, sf_dir).collect()
    rows = documents.select("doc_id", "text").collect()
    expected = without_repeats([r["text"] for r in rows], 35)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {r["doc_id"]: e for r, e in zip(rows, expected)}


@pytest.mark.parametrize("window", [4, 7, 35])
def test_planted_repeats(spark, window):
    passage, rows = prose(3, 60), []
    for i in range(20):
        own = prose(50 + i, 100)
        at = 5 * i % 60
        rows.append((i, " ".join(own[:at] + passage[i % 13 : 60 - i % 7] + own[at:])))
    rows += [(20, " ".join(["x"] * 200)), (21, " ".join(prose(7, 36))), (22, " ".join(prose(7, 36))), (23, " ".join(prose(8, window - 1))), (24, " ".join(prose(8, window - 1)))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    expected = without_repeats([t for _, t in rows], window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got} == dict(enumerate(expected))


def test_repeats_of_odd_rows(odd_docs, no_docs):
    done = remove_repeats(odd_docs, window=4)
    assert done.columns == odd_docs.columns + ["n_words_", "n_removed", "kept_text"]
    rows = done.collect()
    expected = without_repeats([r["text"] for r in rows], 4)
    assert [(r["n_words_"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows] == expected
    assert len(rows) == odd_docs.count() and remove_repeats(no_docs).count() == 0


def test_blocks_round_trip():
    random = np.random.default_rng(5)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 300, 50257, 1 << 32):
            ids = random.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[::97] = (1 << 32) - 1
            sizes = np.array([n // 3, 0, n - n // 3])
            doc_ids, given, back_sizes, back = unpack(pack(np.array([5, 0, -7]), np.array([1, 0, 1]), sizes, ids))
            assert (back == ids).all() and list(back_sizes) == list(sizes) and list(doc_ids) == [5, 0, -7] and list(given) == [True, False, True]
    whole = pack(np.array([1]), np.array([1]), np.array([3]), np.array([1, 2, 3]))
    with pytest.raises(ValueError):
        unpack(whole[:-9] + b"\x01" + whole[-8:])


def test_encoder_equals_tokenizer():
    plain = Tokenizer.from_file(TOKENIZER)
    texts = [
        "", " ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n  b", "a  b", "a  b", "it's they'll 'd", "日本 語", "x \t y", "end <|endoftext|> x",
        "a\x1c b", "tab\t\tb  \n\n c ", "  b", " " * 9 + "b", "1 234 !? ..", "naïve café", "q" * 3000,
    ]
    encode = Encoder(TOKENIZER)
    expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for limit in (1 << 20, 40, 1 << 20):
        assert [x.tolist() for piece in words.pieces(pa.array(texts), limit) for x in encode(piece)] == expected
    assert [x.tolist() for piece in words.pieces(pa.array([None, ""])) for x in encode(piece)] == [[], []]


def tokens_expected(rows):
    plain = Tokenizer.from_file(TOKENIZER)
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_tokenizer(spark, sf_dir, documents):
    got = [tuple(r) for r in QUERIES["op3_token_blocks"](spark, sf_dir).orderBy("doc_id").collect()]
    assert got == tokens_expected([(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()])


def test_token_files_of_odd_rows(spark, odd_docs, no_docs):
    folder, manifest = token_files(odd_docs, TOKENIZER, ids_per_file=50)
    got = read_tokens(spark, folder, manifest).orderBy("start").collect()
    rows = odd_docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == tokens_expected([(r["doc_id"], r["text"]) for r in rows])
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in got)
    folder, manifest = token_files(no_docs, TOKENIZER)
    assert read_tokens(spark, folder, manifest).count() == 0


def test_languages_of_held_out_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_language_spans"](spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in rows if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_spans_of_mixed_texts(spark):
    train = [("en", "the cat sat on the mat and then the dog came " * 20), ("de", "der hund und die katze sind nicht im haus " * 20), ("ru", "кот сидит на окне и смотрит на улицу " * 20)]
    model = language.train(spark.createDataFrame(train, "lang string, text string"))
    texts = ["the cat and the dog came then der hund und die katze sind im haus", "the cat кот сидит на окне и смотрит", "12 -- the 34", "--- 12", None, "", "日本語"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["x"] for r in rows.select("i", language.label_languages(model, F.col("text"), penalty=4.0).alias("x")).orderBy("i").collect()]
    assert [(s["start"], s["end"], s["lang"]) for s in got[0]["spans"]] == [(0, 7, "en"), (7, 15, "de")]
    assert got[1]["lang"] == "ru" and got[1]["spans"][-1]["lang"] == "ru"
    assert got[2]["lang"] == "en" and got[2]["score"] == 1.0
    assert [(x["lang"], x["score"], x["spans"]) for x in got[3:6]] == [("und", 0.0, [])] * 3
    assert got[6]["lang"] in model.languages and got[6]["score"] == 0.0


def test_paths_equal_a_plain_viterbi():
    random = np.random.default_rng(3)
    first = np.array([0, 5, 5, 30, 31])
    scores = (random.normal(size=(31, 3)) * 2).astype(np.float32)
    path = language._paths(scores, first, 1.5)
    for a, b in zip(first, first[1:]):
        best = {}
        if a == b:
            continue
        value = scores[a].astype(float)
        for t in range(a + 1, b):
            value = np.maximum(value, value.max() - 1.5) + scores[t]
        best = value.max()
        own = sum(float(scores[t, path[t]]) for t in range(a, b)) - 1.5 * sum(path[t] != path[t + 1] for t in range(a, b - 1))
        assert abs(own - best) < 1e-4


def test_languages_of_odd_rows(odd_docs, no_docs):
    model = language.train(odd_docs)
    got = odd_docs.select("text", language.label_languages(model, F.col("text")).alias("x")).collect()
    for r in got:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["x"]["lang"] != "und") == lettered and 0 <= r["x"]["score"] <= 1
    empty = language.train(no_docs)
    assert empty.languages == [] and odd_docs.select(language.label_languages(empty, F.col("text")).alias("x")).where("x.lang <> 'und'").count() == 0


def test_quality_of_held_out_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op8_quality_gam"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    usual = max(sum(q for _, q in held), sum(1 - q for _, q in held))
    assert sum(a == b for a, b in held) >= usual


def test_additive_model_learns_shapes_and_pairs():
    random = np.random.default_rng(1)
    x = random.uniform(size=(4000, len(quality.FEATURES)))
    y = ((np.abs(x[:, 0] - 0.5) < 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.85
    assert any({a, b} <= {0, 1, 2} for a, b, *_ in model.pairs)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (10, 1), (11, 0), (99, 1)], "doc_id long, quality int")
    scored = quality.score_quality(odd_docs, labels)
    assert scored.columns == odd_docs.columns + ["score_"] and scored.where("score_ BETWEEN 0 AND 1").count() == odd_docs.count()
    assert {r["score_"] for r in quality.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(no_docs, labels).count() == 0


def bag_similarity(a, b, items, k=5):
    def bag(text):
        w = words_of(fold(text))
        k_ = min(k, len(w))
        return collections.Counter(tuple(w[i : i + k_]) for i in range(len(w) - k_ + 1))

    bags = [bag(t) for t in items if words_of(t)]
    x, y = bag(a), bag(b)
    weight = {s: np.log1p(len(items) / max(1, sum(s in g for g in bags))) for s in x | y}
    return sum(w * min(x[s], y[s]) for s, w in weight.items()) / sum(w * max(x[s], y[s]) for s, w in weight.items())


def test_leaks_equal_brute_force(spark, documents, sf_dir):
    """Every window of every document against every item of as many words, by plain sets."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    item_words = {i: words_of(fold(t)) for i, t in items.items()}
    index = build_index(list(items.items()), 5, 19, len(items))
    bags = {i: set(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for i, w in item_words.items()}
    expected = set()
    for r in documents.collect():
        w = words_of(fold(r["text"]))
        own = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for i, bag in bags.items():
            hits = [j for j, s in enumerate(own) if s in bag]
            n = len(item_words[i])
            starts = {s for j in hits for s in range(max(0, j - n + 5), min(j, max(0, len(w) - n)) + 1)}
            if any(bag_similarity(" ".join(w[s : s + n]), items[i], list(items.values())) >= 0.8 for s in starts if sum(s <= j <= s + n - 5 for j in hits) >= 0.5 * (n - 4)):
                expected.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontaminate"](spark, sf_dir).collect()}
    assert expected and got <= expected and len(got) >= 0.95 * len(expected)
    assert isinstance(index, Index)


def test_planted_leaks(spark):
    items = [(i, " ".join(prose(500 + i, 20 + i))) for i in range(30)] + [(30, None), (31, ""), (32, "Two Words"), (33, " ".join(prose(501, 21)))]
    rows = [(i, " ".join(prose(i, 300))) for i in range(40)]
    for i in range(20):  # whole, in upper case, and with one word changed
        item = items[i][1].split()
        if i % 3 == 1:
            item = [w.upper() for w in item]
        if i % 3 == 2:
            item[0] = "changed"
        own = rows[i][1].split()
        rows[i] = (i, " ".join(own[: 10 * i] + item + own[10 * i :]))
    rows += [(40, "these two words are here"), (41, " ".join(items[25][1].split()[: 10])), (42, items[26][1])]
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    assert set(found) == {(i, i) for i in range(20)} | {(1, 33), (40, 32), (42, 26)}
    assert all(found[i, i]["start"] == 10 * i and found[i, i]["n_words"] == 20 + i for i in range(20) if i % 3 != 2)
    assert all(found[i, i]["similarity"] > 0.999 for i in range(20) if i % 3 != 2)
    assert found[40, 32]["start"] == 1 and found[40, 32]["n_words"] == 2


def test_blocks_find_every_fingerprint_within_the_radius():
    random = np.random.default_rng(2)
    items = [(i, " ".join(prose(i, 30))) for i in range(50)]
    index = build_index(items, 5, 19, 50)
    index.prepare()
    mine, prints, _ = index.tables[30]
    for flips in (0, 1, 10, 19):
        probes = prints.copy()
        for i in range(len(probes)):
            for bit in random.choice(64, flips, replace=False):
                probes[i] ^= np.uint64(1 << int(bit))
        which, item = index.candidates(30, probes)
        assert {(i, mine[i]) for i in range(len(probes))} <= set(zip(which.tolist(), item.tolist()))
    assert len(_near(4)) == 2517 and abs(_similarity(index, index.bags[0][0], 0) - 1) < 1e-12


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two three four five six"), (None, None), (2, "word")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in find_leaks(odd_docs, items).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (6, 2), (7, 2), (7, 2)]
    clean = decontaminated(odd_docs, items)
    assert clean.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 3, 4, 5, 8, 9, 10, 11]
    assert find_leaks(no_docs, items).count() == 0 and find_leaks(odd_docs, items.limit(0)).count() == 0
