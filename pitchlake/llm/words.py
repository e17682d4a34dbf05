"""Words of ASCII letters and digits and of all other characters; only A-Z are lower-cased."""

from __future__ import annotations

import numpy as np

_BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a whole text, in UTF-8; none of a null text."""
    return text.encode("utf-8", "surrogatepass").translate(_BLANKED).split() if text else []


def word_counts(texts: list[str | None]) -> np.ndarray:
    """How many words each text has."""
    out = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t:
            inside = np.frombuffer(t.encode("utf-8", "surrogatepass").translate(_BLANKED), np.uint8) != 32
            out[k] = np.count_nonzero(inside[1:] > inside[:-1]) + inside[0]
    return out


class Ids(dict):
    """Numbers for words, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))
