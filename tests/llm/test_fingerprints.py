import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import weighted_sampling as ws


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize("cut", [10, 40, 70, 95])
def test_collision_rate_is_generalised_jaccard(words, cut):
    sampler = ws.Sampler(2048)
    base = (words(60, 1) + " " + words(40, 2)).split() + ["often"] * 20
    a, b = " ".join(base), " ".join(base[:cut] + words(100 - cut, 3).split() + ["often"] * (cut // 5))
    found, want = ws.likeness(sampler.fingerprint(a), sampler.fingerprint(b)), jaccard(a, b)
    assert abs(found - want) < 4 * np.sqrt(want * (1 - want) / 2048) + 0.003


def brute(table):
    ids = sorted(range(len(table)), reverse=True)
    sampler = ws.Sampler(ws.SAMPLES)
    out = {}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, nxt = table[i] or "", table[after] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        mine, theirs, other = sampler.fingerprint(text), sampler.fingerprint(new), sampler.fingerprint(nxt)
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), mine.tobytes().hex(), theirs.tobytes().hex(), ws.likeness(mine, theirs), ws.likeness(mine, other))
    return out


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_next_document_across_ranges(docs, words, ranges):
    table = [None, "", "one", *[words(n, n) for n in range(1, 60)], "same", "same", "日本語 é \U0001f600 x" * 3]
    rows = ws.neighbours(docs(table, 5), ranges=ranges).collect()
    assert len(rows) == len(table)
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute(table)


def test_small_table_of_rows_gives_the_same(words, monkeypatch):
    text = words(3000, 5)
    whole = ws.Sampler(16).fingerprint(text)
    monkeypatch.setattr(ws, "TABLE_ROWS", 2100)
    small = ws.Sampler(16)
    small.fingerprint(words(2500, 6))
    assert (small.fingerprint(text) == whole).all()


def test_draws_are_those_of_the_formula():
    """Each draw again, one at a time, from the formula in whole and double-precision numbers."""
    import math

    import xxhash

    mask = (1 << 64) - 1

    def scramble(x):
        for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
            x ^= x >> shift
            x = x * factor & mask
        return x ^ x >> 33

    samples = 16
    salts = [scramble(i) for i in range(1, 2 * samples + 1)]
    entries = ws.entries_of("one two two three three three " + "four " * 50)
    score, _ = ws.Sampler(samples).draws(entries)
    for i, (term, n) in enumerate([(b"one", 1), (b"two", 2), (b"three", 3), (b"four", 50)]):
        for k in range(samples):
            x, y = (scramble(xxhash.xxh3_64_intdigest(term) ^ salts[k + j * samples]) for j in (0, 1))
            u = [(v + 0.5) / (1 << 24) for v in (x >> 40, x >> 16 & 0xFFFFFF, y >> 40, y >> 16 & 0xFFFFFF)]
            r, c, b = -math.log(u[0] * u[1]), -math.log(u[2] * u[3]), ((x & 0xFFFF) << 16 | y & 0xFFFF) / (1 << 32)
            t = math.floor(math.log(n) / r + b)
            assert abs(score[i, k] - (math.log(c) - r * (t - b + 1))) < 1e-3


def test_gamma_draws_have_mean_and_variance_two():
    """For weight 1 the score is ln c - r (1 - b): its mean over many terms is that of independent gamma and uniform draws."""
    rng = np.random.default_rng(1)
    found = ws.Sampler(64).draws([b"w%d" % i for i in range(3000)])[0].ravel()
    r, c, b = rng.gamma(2, 1, found.size), rng.gamma(2, 1, found.size), rng.uniform(size=found.size)
    want = np.log(c) - r * (np.floor(b) - b + 1)
    assert abs(found.mean() - want.mean()) < 0.02 and abs(found.std() - want.std()) < 0.02
    assert np.allclose(np.quantile(found, [0.01, 0.1, 0.5, 0.9, 0.99]), np.quantile(want, [0.01, 0.1, 0.5, 0.9, 0.99]), atol=0.08)
