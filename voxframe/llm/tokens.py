"""Whole-text token ids with a word cache in front of the tokenizers library.

The tokenizer's pieces never span a space, tab or line feed, so a text's ids are those of its space-separated words
in order; of Latin-1 texts, those of its pieces, if the tokenizer cuts as ``PIECES`` does. Words are encoded once each while they stay in a bounded cache that lives as long as the Python worker.
New words are encoded together, joined by a separator whose ids mark the borders. ``check_separable`` refuses
tokenizers for which this does not hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

CACHE_WORDS = 700_000
CHARS_AT_ONCE = 2_000_000
#: A private-use character: a word of its own, and rare in texts (words with it are encoded alone).
MARK = "\ue000"
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: Pieces of lower-case Latin-1 text: contractions, letters, single digits, and other characters.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.limit, self.cache = cache_words, {"": b""}
        self.mark = np.array(self._plain(MARK), self.dtype)
        self.check_separable()
        self.latin = self._lowers_pieces()

    def _plain(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def check_separable(self) -> None:
        probe = ["Ab'ré,", "x1.", "'s", "é", "<|endoftext|>", "«ß»", MARK]
        if self._plain(" ".join(probe)) != [i for w in probe for i in self._plain(w)] or not len(self.mark):
            raise ValueError("this tokenizer's pieces span spaces; encode whole texts instead")

    def _lowers_pieces(self) -> bool:
        """Whether the tokenizer lowers its text and cuts it as PIECES does; else words between spaces are the parts."""
        probe = "Ab'ré, x1.²½ 's «ß»...é\xa0µº-Ÿ?!'ll 'LL \x1c a\x85b".replace("Ÿ", "ÿ")
        return self._plain(probe) == [i for w in PIECES.findall(probe.lower()) for i in self._plain(w)]

    def _learn(self, words: Iterable[str]) -> None:
        """Put each word's own ids into the cache."""
        alone = [w for w in words if MARK in w or len(w) > 1000]
        together = sorted(set(words).difference(alone))
        for a in range(0, len(together), 5000):
            some = together[a : a + 5000]
            ids = np.array(self._plain(f" {MARK} ".join(some)), self.dtype)
            k = len(self.mark)
            hit = np.flatnonzero(ids == self.mark[0])
            hit = hit[hit + k <= len(ids)]
            for j in range(1, k):
                hit = hit[ids[hit + j] == self.mark[j]]
            if len(hit) != len(some) - 1:
                alone += some
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            starts, ends = [0, *((hit + k) * size).tolist()], [*(hit * size).tolist(), len(raw)]
            self.cache.update((w, raw[s:e]) for w, s, e in zip(some, starts, ends, strict=True))
        for w in alone:
            self.cache[w] = np.array(self._plain(w), self.dtype).tobytes()

    def _words(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after the other, are the text's."""
        if self.latin and "<|" not in text:
            try:
                text.encode("latin-1")  # no character that normalisation would compose or lower by its neighbours
                return PIECES.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def encode(self, texts: Iterable[str | None]) -> Iterable[np.ndarray]:
        """Ids of each text (null: none), in order."""
        group, size = [], 0
        for t in texts:
            group.append(self._words(t or ""))
            size += len(t or "")
            if size > CHARS_AT_ONCE:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterable[np.ndarray]:
        new = set().union(*group).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > self.limit:
                self.cache = {"": b""}
                new = set().union(*group) - {""}
            self._learn(new)
        get = self.cache.__getitem__
        for words in group:
            yield np.frombuffer(b"".join(map(get, words)), self.dtype)
