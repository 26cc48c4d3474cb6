"""Guards look at a growing text without reading it all again, and see what the measures of the whole text say."""

import random

import pytest
from folia.functions import completions
from folia.streaming import stateful
from folia.streaming.guards import JsonCloseGuard, Limits, LoopGuard

BITS = (
    "word ", "null", "nu", "l", " ", "  ", "\n", ". ", "! ", "。", "<b>", "</p>", "<br   >", "<", "<a ", ">", "</tr>", "\\n", "\\", '"', '"key":', "{", "]", ",", "---", "_", "12", "3.5", "1.2.3", ".", "XII",
    "I", "二十", "é", "\0", "the same sentence once more. ", "Another sentence that repeats itself! ", "Row 7 value 70\n", "<td>cell</td>", " " * 90, "q" * 100, "<" + "z" * 85 + ">",
)


def odd_text(rng, n):
    bits, out = rng.sample(BITS, rng.randint(1, 12)), ""
    while len(out) < n:
        unit = "".join(rng.choices(bits, k=rng.randint(1, 8)))
        rows = "".join(f"Row {k} value {k * 10}\n" for k in range(rng.randint(3, 30)))
        plain = " ".join("".join(rng.choices("abcdefnul", k=rng.randint(1, 7))) for _ in range(40))
        out += rng.choice((unit * rng.randint(1, 40), rows, plain, "".join(rng.choices((*bits, "word ", "word "), k=30))))
    return out[:n]


@pytest.mark.parametrize("limits", [(64_000, 16_000, 8_000), (600, 250, 300)])
def test_growing_as_whole(monkeypatch, limits):
    for name, x in zip(("TAIL", "PERIODIC", "WINDOW"), limits, strict=True):
        monkeypatch.setattr(completions, name, x)
    rng, seen = random.Random(7), set()
    for _ in range(60):
        text, growing, at = odd_text(rng, rng.randint(10, 2500)), completions.Growing(), 0
        while at < len(text):
            at = min(len(text), at + rng.randint(1, 150))
            want = completions.periodic(text[:at]), completions.repeated(text[:at])
            assert (growing.periodic(text[:at]), growing.repeated(text[:at])) == want
            seen.add((want[0]["score"] > 0, want[1]["score"] > 0, growing.at > 0))
    assert {s[0] for s in seen} == {s[2] for s in seen} == {True, False} and any(s[1] for s in seen)


def test_last_period():
    """Against all periods tried one by one."""
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choices("ab" if rng.random() < 0.5 else "abc ", k=rng.randint(0, 30))) + "".join(rng.choices("abc", k=rng.randint(1, 9))) * rng.randint(1, 9)
        same = {p: next((k for k in range(len(t) - p) if t[-1 - k] != t[-1 - k - p]), len(t) - p) for p in range(1, len(t) // 3 + 1)}
        assert completions.last_period(t) == max(((n, -p) for p, n in same.items() if n >= 2 * p), default=(0, 0))


def test_guard_reads_a_text_once(monkeypatch):
    """What the loop guard works over grows with the text, not with its square."""
    rng, read, plain = random.Random(1), [], completions.unmarked
    text = "".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 9))) + rng.choice((" ", " ", ", ", ". ")) for _ in range(9000))
    monkeypatch.setattr(completions, "unmarked", lambda raw, *a, **b: read.append(len(raw)) or plain(raw, *a, **b))
    loop = LoopGuard(Limits(window=1000, every=400, ratio=8.0, periodic=3000, numeric=600, repeated=4000))
    assert stateful.folds([text[k : k + 200] for k in range(0, len(text), 200)], JsonCloseGuard(), [loop]) == [None]
    assert loop.size == len(text) > 50_000 and sum(read) < 8 * len(text)


def test_compared_streams(spark):
    """Null and unordered places, a stream that one set of limits stops, one that closes, and one that nothing stops."""
    loop, closes = "say it again and again. " * 400, '{"a": "}"} \n' + "x" * 300
    texts = {1: loop, 2: closes, 3: "short", None: "of no document"}
    rows = [(d, 1, 1, k, t[k : k + 100]) for d, t in texts.items() for k in range(0, len(t), 100)]
    random.Random(2).shuffle(rows)
    made = stateful.compared(spark.createDataFrame(rows, "doc_id bigint, page int, attempt int, seq int, piece string"), Limits(ratio=1e9), Limits(ratio=1e9, periodic=3000))
    got = {r.doc_id: tuple(r)[3:] for r in made.collect()}
    assert got == {1: (len(loop), None, None, "periodic", got[1][4]), 2: (len(closes), "json_close", 100, "json_close", 100), 3: (5, None, None, None, None), None: (14, None, None, None, None)}
    assert 3000 < got[1][4] < 5000
