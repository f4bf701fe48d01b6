"""Tokenizer files of public vocabularies, and the word splits that go with them.

A text is cut into words by a pattern of Python's ``re``, and each distinct word is encoded
once by the tokenizers library, or by its model alone.  The pattern's character classes differ from the library's
for a few characters; every character is compared once with the library, and texts with one
that differs are cut by the library itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: the cut of the byte-level vocabulary
BYTE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: the cut of the word vocabulary, after lower case
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def vocabulary(name: str) -> str:
    """The path of a vocabulary file of the installed package; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Splitter:
    """Cuts texts into the words that the tokenizer of ``path`` encodes one by one."""

    def __init__(self, path: str, pattern: re.Pattern, lower: bool):
        self.library, self._pattern, self._lower = tokenizer(path), pattern, lower
        self._model = self.library.model
        self._special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._specials = re.compile("|".join(map(re.escape, self._special))) if self._special else None
        self._letters = {b: c for c, b in byte_letters().items()}
        self._same: set[str] = set()
        self._other: set[str] = {"Σ"} if lower else set()  # its lower case depends on its neighbours

    def _by_library(self, text: str) -> list[str]:
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pieces]

    def _by_pattern(self, text: str) -> list[str]:
        return self._pattern.findall(text.lower() if self._lower else text)

    def _agrees(self, chars: set[str]) -> bool:
        for c in chars - self._same - self._other:
            probes = (f"a{c}", f"{c}a", f"1{c}", f"!{c}", f"{c}!", c)
            agree = all(self._by_pattern(p) == self._by_library(p) for p in probes)
            (self._same if agree else self._other).add(c)
        return not chars & self._other

    def _cut(self, text: str) -> list[str]:
        if self._agrees(set(text)) and (not self._lower or unicodedata.is_normalized("NFC", text)):
            return self._by_pattern(text)
        return self._by_library(text)

    def words(self, text: str) -> list[str]:
        """The words in order; special tokens are words of their own."""
        if self._specials is None or not any(s in text for s in self._special):
            return self._cut(text)
        out, at = [], 0
        for m in self._specials.finditer(text):
            out += [*self._cut(text[at:m.start()]), m.group()]
            at = m.end()
        return out + self._cut(text[at:])

    def runs(self, text: str) -> list[str] | None:
        """What stands between white space, for patterns that leave white space out; None where the library has to cut."""
        plain = text.lower() if self._lower else text
        if any(s in plain or s in text for s in self._special) or not self._agrees(set(text)) or (
                self._lower and not unicodedata.is_normalized("NFC", text)):
            return None
        return plain.split()

    def words_of(self, run: str) -> list[str]:
        """The words of one of the ``runs``."""
        return self._pattern.findall(run)

    def ids(self, word: str) -> list[int]:
        """The ids of one word as it comes from a cut, by the library's model alone."""
        if word in self._special:
            return self.library.encode(word, add_special_tokens=False).ids
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(letters)]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        return [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def byte_splitter(path: str) -> Splitter:
    return Splitter(path, BYTE_WORDS, lower=False)


@lru_cache(maxsize=2)
def plain_splitter(path: str) -> Splitter:
    return Splitter(path, PLAIN_WORDS, lower=True)


class WordIds:
    """Ids of whole texts, packed; what was met lately is encoded once.

    For a splitter whose words never hold white space: what stands between white space is
    looked up as one run, and cut into words where it is new.  Two tables hold up to
    ``most`` runs and words together: a full one becomes the older, what is met again moves
    over, and what the older one still holds at the next change goes.  Words that the
    library has cut have tables of their own.
    """

    def __init__(self, splitter: Splitter, width: str, most: int = 800_000):
        self._splitter, self._most = splitter, most
        size = np.dtype(width).itemsize
        every = np.arange(max(splitter.library.get_vocab().values()) + 1).astype(width).tobytes()
        packed = [every[a:a + size] for a in range(0, len(every), size)]

        def of_word(word: str) -> bytes:
            return b"".join(map(packed.__getitem__, splitter.ids(word)))

        def of_run(run: str) -> bytes:
            words = splitter.words_of(run)
            return of_word(run) if words == [run] else b"".join(map(self._runs.__getitem__, words))

        self._runs, self._cut = _Known(of_run), _Known(of_word)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as one run of bytes."""
        out = []
        for text in texts:
            if len(self._runs) + len(self._cut) > self._most // 2:
                self._runs.age()
                self._cut.age()
            runs = self._splitter.runs(text)
            known, keys = (self._cut, self._splitter.words(text)) if runs is None else (self._runs, runs)
            out.append(b"".join(map(known.__getitem__, keys)))
        return out


class _Known(dict):
    """Values by key; a missing one is taken from the older table, or made."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self._make, self._older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        self[key] = value = self._make(key) if value is None else value
        return value

    def age(self) -> None:
        """What is held becomes the older table."""
        self._older = {}  # goes before the copy is made
        self._older = dict(self)
        self.clear()


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of rows whose sizes add up to ``most`` or little more."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            out.append((start, i + 1))
            start, total = i + 1, 0
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
