import hashlib
import random

import pytest

from tidemark.llm import phrase_dedup


def brute(table, width):
    """The removal by definition: every string of `width` bytes against all smaller documents."""
    seen, out = {}, {}
    raw = [(t or "").encode() for t in table]
    for i, b in enumerate(raw):
        for k in range(len(b) - width + 1):
            seen.setdefault(b[k : k + width], i)
    for i, b in enumerate(raw):
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("alphabet,width,gram", [("ab", 12, 5), ("a", 8, 3), ("abcdefgh ", 12, 5), ("é日a ", 12, 5)])
def test_against_brute_force(docs, alphabet, width, gram):
    rng = random.Random(9)
    table = [None, "", "a" * 5]
    for _ in range(40):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 90)))
        if table and rng.random() < 0.6:
            other = rng.choice(table) or ""
            at = rng.randint(0, len(other))
            text += other[at : at + rng.randint(0, 60)] + "".join(rng.choices(alphabet, k=rng.randint(0, 20)))
        table.append(text)
    rows = phrase_dedup.remove_repeats(docs(table), width=width, gram=gram, batch_bytes=400, bucket_bytes=200).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == brute(table, width)


def test_repetitive_corpus_with_production_widths(docs, words):
    shared, own = words(70, 1), [words(40, 10 + i) for i in range(30)]
    table = [f"{o[:60]} {shared} {o[60:]}" for o in own] + own[:5]
    rows = phrase_dedup.remove_repeats(docs(table), batch_bytes=3000, bucket_bytes=1000).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute(table, 50)


def test_kept_bytes(docs, words):
    text = words(30, 3)
    rows = {r["doc_id"]: r["kept"] for r in phrase_dedup.remove_repeats(docs([text, text + " end"]), with_text=True).collect()}
    assert bytes(rows[0]).decode() == text and bytes(rows[1]).decode() == " end"


def test_phrases_alike_in_32_bits_stay(docs):
    """Strings round one trigger whose content hashes agree in their upper 32 bits only."""
    table = ["qekgvzexcgmtiprsfphhyjltpmbyojlzuzuspuejkevyvlxyko", "lfnjsnozrvrurhvsfphhyjltpmbyojlzuzuruxlglrmbuuuvri", "zoskwsshlkwxrfusfphhyjltpmbyojlzuzuaufoalbevyljagc", "mgqjptnamhrreeesfphhyjltpmbyojlzuzuuarukdsaaqmivwa"]
    rows = phrase_dedup.remove_repeats(docs(table)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute(table, 50)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_suffixes_are_compared_by_bytes_whatever_the_hashes(at_once):
    """Phrases that all claim one of two triggers, as if hashes collided: only equal bytes of larger documents are marked."""
    import numpy as np

    rng, width = random.Random(4), 11
    phrases = [("".join(rng.choices("ab", k=width - 1 + rng.randint(1, 9))).encode(), i % 2, rng.randrange(12)) for i in range(60)]
    raw, trigger, doc = zip(*phrases, strict=True)
    count = np.array([len(x) - width + 1 for x in raw])
    found = phrase_dedup.suffix_verdicts(np.array(trigger), np.array(doc), count, np.frombuffer(b"".join(raw), np.uint8), width, at_once)
    strings = [(t, x[k : k + width], d) for x, t, d in phrases for k in range(len(x) - width + 1)]
    least: dict = {}
    for t, x, d in strings:
        # triggers are handled together if they fit, and equal strings under two triggers do not occur then
        least[(t if at_once < 1 << 20 else 0, x)] = min(d, least.get((t if at_once < 1 << 20 else 0, x), d))
    assert found.tolist() == [phrase_dedup.REMOVED if d > least[(t if at_once < 1 << 20 else 0, x)] else phrase_dedup.CLEAN for t, x, d in strings]


def test_suffix_array_is_in_the_order_of_bytes():
    import numpy as np

    rng = random.Random(5)
    raw = bytes(rng.choices(b"\x00ab\xff", k=400))
    at = np.arange(400 - 50 + 1)
    order, new = phrase_dedup.suffix_array(np.frombuffer(raw, np.uint8), at, 50)
    cut = [raw[i : i + 50] for i in at[order]]
    assert cut == sorted(cut) and new.tolist() == [i == 0 or cut[i] != cut[i - 1] for i in range(len(cut))]
