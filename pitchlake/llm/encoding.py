"""Token ids of whole texts as the tokenizers library gives them, with every distinct run of letters merged once a worker.

Both readers cut a text only where the library's own splitting cannot look across, look known pieces up, and let the
library's model merge the rest. ``tests/llm`` hold them against ``Tokenizer.encode`` on adversarial strings.
"""

from __future__ import annotations

import array
import json
import re
import sys

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed by the byte-level BPE vocabulary: how it splits text before merging.
BYTE_LEVEL = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Fixed by the word BPE vocabulary.
WORD_LEVEL = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Between two non-blanks, before a single blank: no byte-level piece reaches across.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Below it, all characters are composed, have stable classes, and lower-case one by one (but for U+0130).
SIMPLE_BELOW = "ɐ"
UNSIMPLE = re.compile(f"[^\0-{chr(ord(SIMPLE_BELOW) - 1)}]")
MEMO_ENTRIES = 300_000
MEMO_LENGTH = 64


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()


def mapped(piece: str) -> str:
    return piece.encode("utf-8").decode("latin-1").translate(_ALPHABET)


def merger(tokenizer: Tokenizer):
    """piece (UTF-8 bytes) -> its ids: the vocabulary's merges, run by rank; its ``whole`` takes texts, where ranks are ids.

    Ranks can stand for the merges where each merge made the next id, which is checked; the end-of-word mark is
    written as the byte 0xFF, which UTF-8 never holds, and joined to its byte before any other merge.
    """
    model = json.loads(tokenizer.to_str())["model"]
    vocab, mark = model["vocab"], model["end_of_word_suffix"] or ""
    first = 512 if mark else 256
    if [vocab[a + b] for a, b in map(_pair, model["merges"])] != list(range(first, first + len(model["merges"]))):
        raise ValueError("this vocabulary's ids don't follow its merges")
    back = {c: b for b, c in byte_alphabet().items()}

    def raw(token: str) -> bytes:
        ends = bool(mark) and token.endswith(mark) and token != mark
        return bytes(back[c] for c in (token[: -len(mark)] if ends else token)) + b"\xff" * ends

    order = sorted(((raw(t), i) for t, i in vocab.items()), key=lambda x: (bool(mark) and x[1] < first and len(x[0]) == 1, x[1]))
    ranks, ids = {t: r for r, (t, _) in enumerate(order)}, [i for _, i in order]
    if mark:
        ranks[b"\xff"] = len(ranks)
    core = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
    end, one = b"\xff" if mark else b"", core.encode_single_piece

    def merge(piece: bytes) -> list[int]:
        return [ids[r] for r in one(piece + end)]

    if ids == list(range(len(ids))):
        merge.whole = core.encode_ordinary
    return merge


def _pair(merge) -> tuple[str, str]:
    return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    a = array.array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class _Memo(dict):
    """Computes what it lacks; emptied when full, so its memory is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


class ByteLevelPieces:
    """Folds a value over the byte-level pieces of a text: ``of_piece`` gives a piece's, ``fold`` joins a list's."""

    def __init__(self, tokenizer: Tokenizer, of_piece, of_special, fold):
        self.splitter = tokenizer.pre_tokenizer
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.unmapped = {ord(c): b for b, c in byte_alphabet().items()}
        self.of_special, self.fold = of_special, fold
        self.pieces = _Memo(of_piece)
        self.words = _Memo(self._word)

    def chunk(self, chunk: str):
        if max(chunk) < SIMPLE_BELOW:
            return self.fold([self.pieces[p] for p in BYTE_LEVEL.findall(chunk)])
        split = self.splitter.pre_tokenize_str(chunk)
        return self.fold([self.pieces[p.translate(self.unmapped).encode("latin-1").decode("utf-8")] for p, _ in split])

    def _word(self, word: str):
        """Of ' ' + word, or None where that isn't a safe cut."""
        return None if not word or word[0].isspace() or word[-1].isspace() else self.chunk(f" {word}")

    def _plain(self, text: str) -> list:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            values = list(map(self.words.__getitem__, rest))
            if None not in values:
                return [self.chunk(first), *values]
        return [self.chunk(c) for c in SAFE_CUT.split(text) if c]

    def __call__(self, text: str | None):
        if not text:
            return self.fold([])
        if "<" not in text or not (found := self.special.findall(text)):
            return self.fold(self._plain(text))
        values: list = []
        for k, part in enumerate(self.special.split(text)):
            if k:
                values.append(self.of_special(self.specials[found[k - 1]]))
            if part:
                values += self._plain(part)
        return self.fold(values)


class ByteEncoder:
    """text -> its ids as an array, for the byte-level vocabulary.

    Texts of simple characters go through the rank merges whole; the others, and those with special strings, through
    the library's own splitting.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        merge = merger(tokenizer)
        self.whole = merge.whole
        self.careful = ByteLevelPieces(tokenizer, lambda p: packed(merge(p.encode())), lambda i: packed([i]), b"".join)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if "<" in text or UNSIMPLE.search(text):
            return np.frombuffer(self.careful(text), "<u4")
        return np.frombuffer(array.array("I", self.whole(text)), np.uint32)  # a third of the time of np.array


class WordEncoder:
    """text -> its ids, packed, for the word BPE vocabulary: blanks only separate, so each blank-free chunk stands alone."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        merge = merger(self.tokenizer)
        self.pieces = _Memo(lambda p: packed(merge(p.encode())))
        self.chunks = _Memo(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) < SIMPLE_BELOW and "<|" not in chunk and "İ" not in chunk:
            return b"".join([self.pieces[p] for p in WORD_LEVEL.findall(chunk.lower())])
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text.isascii() and "<|" not in text:  # then "The" and "the" are one key
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
