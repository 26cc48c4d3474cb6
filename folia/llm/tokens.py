"""Ids of public tokenizers for many texts: each pre-token is encoded once a worker and looked up from then on."""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

#: Characters of which Python's re and the tokenizers library agree what is letter, digit and space,
#: that lower one by one, and that no normalisation changes. A text with any other is encoded as a whole.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARKS = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞€™"
ODD = re.compile(f"[^\t\n\r 0-9{LETTERS}{MARKS}]")
#: The pre-tokenizers' patterns, for such texts.
BYTE_LEVEL = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
)
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
#: What a special token can start with; a text with it is encoded as a whole.
SPECIAL = "<|"
#: What a worker remembers of a function; then it forgets all and starts anew. Encoded pre-tokens are dearer to work out again.
REMEMBERED = 1 << 17
ENCODED = 400_000


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


class PreTokens:
    """Splits texts into pre-tokens and encodes these, by one tokenizer file.

    pieces(text) gives None for a text that has to be encoded as a whole: with characters outside of ODD's, with
    something like a special token, or if the file's normalizer or pre-tokenizer is none of the two known kinds.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        before = self.library.pre_tokenizer
        kind = type(before).__name__ if before is not None else ""
        norm = self.library.normalizer
        self.lower = norm is not None and not norm.normalize_str("A").isupper()
        self.pattern = {"ByteLevel": BYTE_LEVEL if norm is None else None, "Sequence": WORD_LEVEL if self.lower else None}.get(kind)
        self.chars = _byte_chars()
        if self.pattern and not self._agrees():
            self.pattern = None

    def _agrees(self) -> bool:
        probe = "It's  a Probe,\n\n of 1234 words\t(they'll é—Ünder…)  \n x's  "
        return [i for p in self.pieces(probe) for i in self.ids(p)] == self.whole(probe)

    def pieces(self, text: str) -> list[str] | None:
        if self.pattern is None or SPECIAL in text or ODD.search(text):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.chars))]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


_REMEMBERED: weakref.WeakSet = weakref.WeakSet()


def forget() -> None:
    """Empties all that this worker remembers, before a task that needs the memory."""
    for held in list(_REMEMBERED):
        held.clear()


class Remembered(dict):
    """A function's values, held until there are too many."""

    __hash__ = object.__hash__

    def __init__(self, of: Callable, most: int = REMEMBERED):
        super().__init__()
        self.of, self.most = of, most
        _REMEMBERED.add(self)

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.of(key)
        return value


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str):
        self.tokens = PreTokens(path)
        self.packed = Remembered(lambda p: np.array(self.tokens.ids(p), "<u4").tobytes(), ENCODED)

    def encode(self, text: str) -> np.ndarray:
        pieces = self.tokens.pieces(text)
        if pieces is None:
            return np.array(self.tokens.whole(text), "<u4")
        return np.frombuffer(b"".join(map(self.packed.__getitem__, pieces)), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker and file, with what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
