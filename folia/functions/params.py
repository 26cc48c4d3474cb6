"""Parameters given as text. A bad value is an error, never silently another value."""

from __future__ import annotations

SEEDS = 2**31


def page_range(text: str) -> tuple[int, int]:
    """(first, last) of "3" or "2-5"; both from 1 on."""
    first, _, last = text.partition("-")
    a = int(first)
    b = int(last) if "-" in text else a
    if not 1 <= a <= b:
        raise ValueError(f"no page range: {text}")
    return a, b


def within(value, low: float, high: float, name: str) -> float:
    try:
        v = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} is a number from {low} to {high}, not {value!r}") from None
    if not low <= v <= high:
        raise ValueError(f"{name} is from {low} to {high}, not {v}")
    return v


def temperature(value, name: str = "temperature") -> float:
    return within(value, 0.0, 2.0, name)


def flag(value, name: str) -> bool:
    word = str(value).strip().lower()
    if word not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
        raise ValueError(f"{name} is one of 1/0, true/false, yes/no, on/off, not {value!r}")
    return word in ("1", "true", "yes", "on")


def seed_policy(value, name: str = "seed_policy") -> str | int:
    """"fixed", "random", or an integer below 2^31."""
    word = str(value).strip().lower()
    if word in ("fixed", "random"):
        return word
    if not word.isdecimal() or int(word) >= SEEDS:
        raise ValueError(f"{name} is 'fixed', 'random' or an integer below 2^31, not {value!r}")
    return int(word)


def one_of(value, known: tuple[str, ...], name: str) -> str:
    if value not in known:
        raise ValueError(f"{name} is one of {', '.join(known)}, not {value!r}")
    return value


#: How a document's summary can be made, bounds of its length, and contracts.
SUMMARY_MODES = ("deterministic", "contract_sos", "summary_of_summaries", "model", "off")
SUMMARY_CHARS = (200, 20_000)
CONTRACTS = ("v0.4", "v0.5")


def summary_mode(value) -> str:
    return one_of(str(value).strip().lower(), SUMMARY_MODES, "summary mode")


def summary_chars(value) -> int:
    word = str(value).strip()
    if not word.lstrip("+-").isdecimal():
        raise ValueError(f"summary max chars is an integer, not {value!r}")
    return int(within(word, *SUMMARY_CHARS, "summary max chars"))


def contract(value, aliases: dict[str, str] | None = None) -> str:
    """A contract's name; a full version stands for its line ("v0.4.1" for "v0.4"), an alias for what it names."""
    word = "" if value is None else str(value).strip().lower()
    line = ".".join(word.split(".")[:2])
    if word not in CONTRACTS and line in CONTRACTS and word[len(line) + 1 :].isdecimal():
        word = line
    return one_of((aliases or {}).get(word, word) if word not in CONTRACTS else word, CONTRACTS, "contract")


#: What a request may override, and how each is read.
DECODE = {
    "temperature": temperature, "retry_temperature": lambda v: temperature(v, "retry_temperature"), "seed_policy": seed_policy,
    "retry_enforce": lambda v: flag(v, "retry_enforce"), "contract": contract, "figure_check": lambda v: flag(v, "figure_check"),
    "heading_fix": lambda v: flag(v, "heading_fix"), "summary_mode": summary_mode, "summary_max_chars": summary_chars,
}


def overrides(given: dict) -> dict:
    """The request's parameters, read; those that are None are left out, an unknown or bad one is an error."""
    return {one_of(k, tuple(DECODE), "parameter"): DECODE[k](v) for k, v in given.items() if v is not None}
