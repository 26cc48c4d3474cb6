"""Guards over token streams: they see a completion's pieces in order and say when it goes round in circles, or goes
on after its JSON has closed. The same classes run over a stored completion and in a stateful stream."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from functools import lru_cache

from folia.functions.completions import TAIL, Growing, compression


@dataclass
class Limits:
    """When to look, and what is too much. None switches a guard off."""

    window: int = 2000
    every: int = 800
    ratio: float = 15.0
    in_a_row: int = 2
    long_window: int | None = None
    long_ratio: float = 12.0
    length: int | None = None
    tokens: int | None = None
    periodic: int | None = None
    counter: int | None = None
    numeric: int | None = None
    repeated: int | None = None


#: The limits of the current contract.
CURRENT = Limits(length=60_000, periodic=3000, counter=6000, numeric=600, repeated=4000)


#: Guards that look at one stream side by side see the same windows.
_ratio = lru_cache(maxsize=4)(compression)


@dataclass
class LoopGuard:
    limits: Limits = field(default_factory=Limits)
    text: str = ""  # what the measures read: all if repeats are looked for, else the end
    size: int = 0  # characters of the whole
    next_look: int = 0
    strikes: int = 0
    long_strikes: int = 0
    usage: int | None = None
    fired: str | None = None
    at: int = 0

    def __post_init__(self):
        self.next_look = self.next_look or self.limits.window
        self._grown()

    def _grown(self) -> None:
        self.growing = Growing(units=bool(self.limits.repeated))

    def add(self, piece: str, tokens: int | None = None) -> str | None:
        """The name of the guard that fires with this piece, or None."""
        if self.fired:
            return None
        text, self.text = self.text, ""  # held once, it is not copied for every piece
        text += piece
        self.text = text
        self.size += len(piece)
        x = self.limits
        if not x.repeated and len(self.text) > 2 * (most := max(TAIL, x.window, x.long_window or 0)):
            self.text = self.text[-most:]
            self._grown()
        if tokens is not None:
            self.usage = max(self.usage or 0, tokens)
            if self.limits.tokens and tokens > self.limits.tokens:
                return self._fire("token_cap")
        if self.size < self.next_look:
            return None
        self.next_look = self.size + self.limits.every
        which = self._look()
        return self._fire(which) if which else None

    def _fire(self, which: str) -> str:
        self.fired, self.at = which, self.size
        return which

    def _look(self) -> str | None:
        x, n = self.limits, self.size
        if x.length and n >= x.length and not (x.tokens and self.usage is not None):
            return "length_cap"
        self.strikes = self.strikes + 1 if _ratio(self.text[-x.window :]) > x.ratio else 0
        if self.strikes >= x.in_a_row:
            return "window"
        if x.long_window and n >= x.long_window:
            self.long_strikes = self.long_strikes + 1 if _ratio(self.text[-x.long_window :]) > x.long_ratio else 0
            if self.long_strikes >= x.in_a_row:
                return "long_window"
        if x.periodic or x.numeric:
            p = self.growing.periodic(self.text)
            bound = (x.counter or x.periodic) if p["numbered_rows"] else x.periodic
            if x.periodic and p["score"] >= bound:
                return "periodic"
            if x.numeric and p["numeric_repeats"] >= x.numeric:
                return "numeric"
        return "repeated" if x.repeated and self.growing.repeated(self.text)["score"] >= x.repeated else None

    def dump(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "limits"})

    @classmethod
    def load(cls, limits: Limits, state: str | None) -> LoopGuard:
        return cls(limits, **json.loads(state)) if state else cls(limits)


#: The characters that the close guard's modes look for.
SIGNS = {"out": re.compile(r'["{\[\]}]'), "in": re.compile(r'["\\]'), "escape": re.compile(r"(?s:.)"), "closed": re.compile(r"\S")}


@dataclass
class JsonCloseGuard:
    """Fires on the first character after the top-level object has closed that is no white space."""

    depth: int = 0
    armed: bool = False  # the first opener has come
    mode: str = "out"  # out, in (a string), escape, closed, off
    seen: int = 0
    close: int = 0
    fired: bool = False

    def add(self, piece: str) -> bool:
        at, start = 0, self.seen
        while not self.fired and self.mode != "off" and (m := SIGNS[self.mode].search(piece, at)):
            ch, at = m[0], m.end()
            self.seen = start + at
            if self.mode == "closed":
                self.fired = True
            elif self.mode == "escape":
                self.mode = "in"
            elif self.mode == "in":
                self.mode = "escape" if ch == "\\" else "out"
            elif ch == '"':
                self.mode = "in"
            elif ch in "{[":
                if not self.armed and ch == "[":  # an array is not ours to judge
                    self.mode = "off"
                self.armed, self.depth = True, self.depth + 1
            elif self.armed:
                self.depth -= 1
                if not self.depth:
                    self.mode, self.close = "closed", self.seen
        self.seen = start + len(piece)
        return self.fired
