"""Leaks by row, over many items, and of templated items."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from datagauge.llm import decontaminate, words
from datagauge.llm.decontaminate import RADIUS, _leaks, _prints, _shingle_at, build_index, decontaminated, find_leaks

from .conftest import prose, words_of


def test_clean_rows_of_leaking_ids_stay(spark):
    item = " ".join(prose(1, 30))
    rows = [(None, "a " + item), (None, " ".join(prose(2, 40))), (None, None), (5, item + " b"), (5, " ".join(prose(3, 40))), (5, item + " b"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text IS NULL OR NOT contains(text, '%s')" % item).collect()))
    assert kept.count() == 4


def similarity(a, b, frequency, n_items, k=5):
    x, y = (collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (words_of(a), words_of(b)))
    weight = {s: np.log1p(n_items / max(1, frequency[s])) for s in x | y}
    return sum(w * min(x[s], y[s]) for s, w in weight.items()) / sum(w * max(x[s], y[s]) for s, w in weight.items())


@pytest.mark.parametrize("per_slice", [1000, 40])
def test_slices_do_not_change_results(spark, monkeypatch, per_slice):
    """Templated items, one text repeated: similarities are by frequencies over all items, however they are sliced."""
    template = prose(77, 24)
    items = [(i, " ".join(template + prose(1000 + i, 10))) for i in range(200)] + [(200 + i, " ".join(template + prose(1000, 10))) for i in range(60)] + [(300, None)]
    rows = [(i, " ".join(prose(5000 + i, 20)) + " " + items[i][1]) for i in range(10)]
    rows += [(20 + i, items[i][1].rsplit(" ", 1)[0] + " changed") for i in range(10)]
    monkeypatch.setattr(decontaminate, "ITEMS_PER_SLICE", per_slice)
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    frequency = collections.Counter(s for _, t in items if t for w in [words_of(t)] for s in {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    texts, of_items = dict(rows), dict(items)
    assert {(i, i) for i in range(10)} | {(0, 200 + i) for i in range(60)} <= {(r["doc_id"], r["item_id"]) for r in got}
    for r in got:
        window = " ".join(words_of(texts[r["doc_id"]])[r["start"] : r["start"] + r["n_words"]])
        assert abs(r["similarity"] - similarity(window, of_items[r["item_id"]], frequency, len(items))) < 1e-9
    expected = {(20 + i, i) for i in range(10) if similarity(rows[10 + i][1], items[i][1], frequency, len(items)) >= 0.8}
    assert expected and expected <= {(r["doc_id"], r["item_id"]) for r in got}


def lost_of_templated(n_items, shared_by, similar, changed, draws, n_shared=60):
    """(pairs above the threshold, those not found): items share most of their shingles with others, windows differ in unseen ones."""
    rng = np.random.default_rng(11)
    pools = [[f"p{p}x{j}" for j in range(n_shared + 4)] for p in range(n_items // shared_by)]
    items = [(i, " ".join(pools[i // shared_by] + [f"i{i}x{j}" for j in range(4)])) for i in range(n_items)]
    index = build_index(items, 5, RADIUS, n_items)
    index.prepare()
    frequency = collections.Counter(s for _, t in items for w in [words_of(t)] for s in {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    pairs = lost = 0
    for draw in range(draws):
        i = int(rng.integers(n_items))
        window = words_of(items[i][1])
        for c in range(changed):
            window[-1 - c if c % 2 else c] = f"new{draw}x{c}"
        text = " ".join(window)
        if similarity(text, items[i][1], frequency, n_items) < similar:
            continue
        piece = next(words.pieces(pa.array([text])))
        found = _leaks(index, {5: _shingle_at(piece, piece.hashes(fold=True), 0, 5)}, len(window), 5, 0.8)
        pairs += 1
        lost += i not in {f[0] for f in found}
    return pairs, lost


@pytest.mark.parametrize("n_items, shared_by", [(200, 20), (200, 50), (1000, 100)])
def test_templated_items_are_found(n_items, shared_by):
    for changed in (1, 2, 3, 4):
        pairs, lost = lost_of_templated(n_items, shared_by, 0.8, changed, 300)
        assert lost <= 0.01 * pairs


def simulated_loss(n_items, shared_by, similar, power, draws=20000, n_shared=60):
    """Share of window-item pairs at a similarity whose fingerprints, sums of signs times weight ** power, exceed the radius."""
    rng = np.random.default_rng(5)
    light, heavy = np.log1p(n_items / shared_by), np.log1p(n_items)
    n_new = int(n_shared * light * (1 / similar - 1) / heavy)  # unseen shingles of the window
    signs = lambda n: rng.choice(np.array([-1.0, 1.0], dtype=np.float32), (draws // 20, n, 64))
    lost = 0
    for _ in range(20):
        item = signs(n_shared).sum(axis=1) * light**power
        lost += (((item > 0) != (item + signs(n_new).sum(axis=1) * heavy**power > 0)).sum(axis=1) > RADIUS).sum()
    return lost / draws


@pytest.mark.parametrize("n_items, shared_by, similar", [(200, 20, 0.82), (200, 50, 0.82), (1000, 300, 0.86), (1000, 500, 0.83)])
def test_loss_does_not_depend_on_weights(n_items, shared_by, similar):
    print(n_items, shared_by, similar, simulated_loss(n_items, shared_by, similar, 1.0), simulated_loss(n_items, shared_by, similar, 0.5))
    assert simulated_loss(n_items, shared_by, similar, 0.5) <= 0.005


def test_fingerprints_of_windows_with_repeats():
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    values, heavy = kinds[rng.integers(0, 12, 200)], rng.uniform(1, 5, 12)
    weight = heavy[np.searchsorted(np.sort(kinds), values)]
    starts = np.arange(200 - 9 + 1)
    for start, got in zip(starts, _prints(values, weight, starts, 9)):
        window, at, n = np.unique(values[start : start + 9], return_index=True, return_counts=True)
        sums = (decontaminate._signs(window) * np.sqrt(weight[at + start] * n)[:, None]).sum(axis=0, keepdims=True)
        bits = np.unpackbits(np.array([got ^ decontaminate._packed(sums)[0]]).view(np.uint8), bitorder="little")
        assert (np.abs(sums[0][bits > 0]) < 1e-4).all()
