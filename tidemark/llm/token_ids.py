"""Token ids of documents by a public byte-level BPE vocabulary, for operators 2 and 4.

All ids come from `tokenizers`. No token of this kind of tokenizer crosses from a non-space character into a following space,
so a text may be cut before every space that follows a non-space character, and the ids of the pieces, kept in a bounded table
of pieces, are put together. The pieces that a batch lacks are encoded as one text, whose ids are parted before each token that
begins with a space, as a piece has its only space in front. Texts with runs of white space, white space at an end or the
strings of special tokens go through the tokenizer whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Pieces whose ids one worker keeps, and the longest piece that is kept.
CACHE_PIECES, CACHE_CHARS = 800_000, 40
#: Pieces that one call encodes (an encoding takes far more memory than its ids).
CALL_PIECES = 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable letter; bytes without one take the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White space that is no space, before a space.
OTHER_BEFORE_SPACE = re.compile(r"[^\S ] ")


class Ids:
    """`many(texts)` gives an array of unsigned 16 or 32-bit ids for each text, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        largest = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ()))])
        self.kind, self.code = (np.uint16, "H") if largest < 1 << 16 else (np.uint32, "I")
        self.begins = np.zeros(largest + 1, bool)
        space = next(letter for letter, byte in byte_of_letter().items() if byte == 32)
        self.begins[[i for token, i in spec["model"]["vocab"].items() if token.startswith(space)]] = True
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}

    def encoded(self, strings: list[str]) -> Iterator[bytes]:
        """Ids of each string by itself."""
        for i in range(0, len(strings), CALL_PIECES):
            for e in self.tokenizer.encode_batch_fast(strings[i : i + CALL_PIECES], add_special_tokens=False):
                yield array(self.code, e.ids).tobytes()

    def encoded_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word with a space before it; the words have no space and end in no white space."""
        size = np.dtype(self.kind).itemsize
        for i in range(0, len(words), CALL_PIECES):
            some = words[i : i + CALL_PIECES]
            (together,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(together.ids, self.kind)
            ends = [*(np.flatnonzero(self.begins[ids]) * size).tolist(), len(ids) * size]
            if len(ends) != len(some) + 1:
                raise ValueError("a token of this vocabulary crosses into a space")
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in itertools.pairwise(ends))

    def whole(self, text: str) -> bool:
        """Whether the text must not be cut at its spaces; a printable text has no other white space than the space."""
        if "  " in text or text[:1] == " " or text[-1:].isspace() or not text.isprintable() and OTHER_BEFORE_SPACE.search(text):
            return True
        return any(s in text for s in self.special)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in order."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        known = self.pieces
        split = [[t] if self.whole(t) else t.split(" ") for t in texts]
        lacking = dict.fromkeys(w for words in split for w in words[1:] if w not in known)
        known.update(zip(lacking, self.encoded_words(list(lacking)), strict=True))
        heads = self.encoded([words[0] for words in split])
        found = [np.frombuffer(head + b"".join(map(known.__getitem__, words[1:])), self.kind) for head, words in zip(heads, split, strict=True)]
        for w in lacking:
            if len(w) > CACHE_CHARS:
                del known[w]
        return found

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Ids:
    """One table of ids for each Python worker."""
    return Ids(path)
