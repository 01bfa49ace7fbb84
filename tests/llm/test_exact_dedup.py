import hashlib
import random
import re

import pytest

from tidemark.llm import exact_dedup


@pytest.mark.parametrize("digest_chars,salts", [(64, 16), (1, 2), (64, 1)])
def test_against_brute_force(docs, digest_chars, salts):
    rng = random.Random(4)
    texts = [rng.choice(["a", "a ", "a  b", "a\tb", "a b", "", None, "c" * 50, "hot", "hot", "hot", "hot"]) for _ in range(200)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(texts, 7), digest_chars=digest_chars, salts=salts).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (same[0], len(same), i == same[0], hashlib.sha256(t.encode()).hexdigest())


def test_kept_rows(docs):
    d = docs([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, None)])
    kept = exact_dedup.first_of_each(d)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, ""), (1, "a"), (3, "b")]
    assert kept.columns == d.columns
