import random
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import chosen_path


def shingles(text, gram):
    w = (text or "").split()
    k = min(gram, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(table, threshold=0.8, gram=5):
    """Class and links of each document from all pairs."""
    sets, root, links = [shingles(t, gram) for t in table], list(range(len(table))), [0] * len(table)
    for a, b in combinations(range(len(table)), 2):
        both = len(sets[a] & sets[b])
        union = len(sets[a] | sets[b])
        if not union or both >= threshold * union - 1e-9:
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return {i: (root[i], links[i]) for i in range(len(table))}


@pytest.fixture
def table(words):
    rng = random.Random(6)
    out = [None, "", "one", "one two three four", "one two three four"]
    for seed in range(12):
        base = words(120, seed).split()
        for k in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            out.append(" ".join(copy))
    out += [words(60, 100 + i) for i in range(30)]
    # a hot group: one text with a word changed here and there
    base = words(80, 77).split()
    out += [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 80, 2)]
    return out


@pytest.mark.parametrize("options", [{}, {"limit": 3, "block": 8}, {"limit": 2, "block": 2048}])
def test_all_links_and_no_others(docs, table, options):
    rows = chosen_path.jaccard_join(docs(table, 5), **options).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == brute(table)
    assert all(r["first"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_one_of_each_class(docs, table):
    kept = chosen_path.one_of_each(docs(table, 5))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in brute(table).values()})


def test_signatures_in_a_batch_are_those_alone(words):
    shingler = chosen_path.Shingler(5)
    sets = [shingler.shingles(words(n, n)) for n in (0, 1, 7, 90, 400)]
    whole = chosen_path.sketches_and_choices(sets, 3, 0.8)
    for i, s in enumerate(sets):
        own = chosen_path.sketches_and_choices([s], 3, 0.8)
        assert (whole.sketch[i] == own.sketch[0]).all()
        for (keys, n), (own_keys, own_n) in zip(whole.chosen, own.chosen, strict=True):
            ends = np.concatenate([[0], np.cumsum(n)])
            assert keys[ends[3 * i] : ends[3 * i + 3]].tolist() == own_keys.tolist()
            assert n[3 * i : 3 * i + 3].tolist() == own_n.tolist()


def test_rows_with_one_id_and_different_texts_have_their_own_fate(docs):
    table = [(1, "a b c d e f g h"), (2, "x y z u v w p q"), (2, "a b c d e f g h"), (3, "k l m n o p q r"), (3, "k l m n o p q r"), (None, None)]
    kept = chosen_path.one_of_each(docs(table, 3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (1, "a b c d e f g h"), (2, "x y z u v w p q"), (3, "k l m n o p q r")]


def test_average_similarity_of_a_bucket(spark, words):
    """The estimate from signs against the mean over all pairs."""
    base = words(60, 1).split()
    near = [" ".join([f"n{i}" if k == i else w for k, w in enumerate(base)]) for i in range(60)]
    far = [words(60, 10 + i) for i in range(60)]
    shingler, rows = chosen_path.Shingler(5), []
    for bucket, texts in ((0, near), (1, far)):
        sketch = chosen_path.sketches_and_choices([shingler.shingles(t) for t in texts], 1, 0.8).sketch
        rows += [(bucket, int(s)) for s in chosen_path.signs_of(sketch)]
    found = chosen_path.alike(spark.createDataFrame(rows, "bucket long, signs long")).collect()
    assert {r["bucket"]: r["alike"] for r in found} == {0: True, 1: False}
