"""Streams against their batch forms."""

import json

import pytest

from folia.streaming import stateful
from folia.streaming.guards import JsonCloseGuard, Limits, LoopGuard

LIMITS = Limits(window=400, every=100, ratio=6.0)


def test_close_guard():
    def at(*pieces):
        g = JsonCloseGuard()
        return [k for k, p in enumerate(pieces) if g.add(p)][:1], g.close

    assert at('{"a": "}"', "}", " \n", "x") == ([3], 10)
    assert at('{"a": "\\"}"}', "\n")[0] == [] and at("[1]", "junk")[0] == [] and at("pre } {", "}", "!")[0] == [2]


def test_loop_guard():
    g = LoopGuard(Limits(length=5000))
    fired = [g.add("".join(chr(97 + (k * k + j * 31) % 26) for j in range(500))) for k in range(12)]
    assert "length_cap" in fired or "window" in fired
    t = LoopGuard(Limits(tokens=10))
    assert t.add("a", 10) is None and t.add("b", 11) == "token_cap" and t.add("c", 12) is None
    loop = LoopGuard(Limits(window=100, every=50, ratio=1e9, periodic=300))
    assert "periodic" in [loop.add("the same sentence once more. ") for _ in range(60)]
    same = LoopGuard.load(LIMITS, LoopGuard(LIMITS, text="abc", next_look=7, strikes=1).dump())
    assert (same.text, same.next_look, same.strikes) == ("abc", 7, 1)


@pytest.fixture()
def pieces(spark):
    texts = {1: "say it again. " * 200, 2: '{"a": 1}' + " " * 30 + "more", 3: json.dumps({"text": [f"{k * 7919 % 10007} words" for k in range(150)]})}
    rows = [(d, 1, 1, k, t[a : a + 50], a + 50 >= len(t)) for d, t in texts.items() for k, a in enumerate(range(0, len(t), 50))]
    return spark.createDataFrame(rows, "doc_id bigint, page int, attempt int, seq int, piece string, last boolean")


def run(spark, df, made, tmp_path, parts):
    """The stream's output after the rows have come in so many files, in order of seq."""
    stateful.use_rocks(spark)
    order = "seq" if "seq" in df.columns else "arrives"
    rows = sorted(df.collect(), key=lambda r: r[order])
    step = -(-len(rows) // parts)
    src = tmp_path / "in"
    q = None
    out = f"out_{tmp_path.name.replace('-', '_')}"
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = made(stream).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(out).collect()


def test_guards_in_a_stream(spark, pieces, tmp_path):
    want = {tuple(r) for r in stateful.replay(pieces, LIMITS).collect()}
    assert {r[0] for r in want} == {1, 2}
    got = run(spark, pieces, lambda s: stateful.guarded(s, LIMITS), tmp_path, 3)
    assert {tuple(r) for r in got} == want


def test_pages_in_order(spark, tmp_path):
    arrives = [(1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (1, 1, "a"), (2, 3, "z"), (1, 1, "again"), (2, 2, "y")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(arrives)], "doc_id bigint, page int, text string, arrives int")
    got = run(spark, df, lambda s: stateful.in_page_order(s.select("doc_id", "page", "text")), tmp_path, 4)
    assert [r.text for r in got if r.doc_id == 1] == ["a", "b", "c"] and [r.text for r in got if r.doc_id == 2] == ["x", "y", "z"]


def test_sections_of_a_stream(spark, tmp_path):
    paras = ["a" * 40, "b" * 40, "c" * 40, "d" * 40, "e" * 40]
    rows = [(1, k + 1, p, k == 4, k) for k, p in enumerate(paras)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, text string, last boolean, arrives int")
    got = run(spark, df, lambda s: stateful.sections(s.drop("arrives"), 30, 10), tmp_path, 3)
    assert [r.text for r in sorted(got, key=lambda r: r.section)] == ["\n\n".join(paras[:3]), "\n\n".join(paras[2:5])]


def test_heartbeats(spark, tmp_path):
    import time

    from folia.streaming.progress import Heartbeats

    told: list[dict] = []
    beats = Heartbeats(told.append, kept=2)
    spark.streams.addListener(beats)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
        lines = spark.readStream.text(str(tmp_path / "in"))
        run = lines.writeStream.format("memory").queryName("heartbeats").trigger(availableNow=True).start()
        run.awaitTermination()
        for _ in range(100):
            if any(b["event"] == "ended" for b in told):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(beats)
    assert [b["event"] for b in told][0] == "started" and told[-1]["event"] == "ended" and told[-1]["error"] is None
    assert sum(b.get("rows", 0) for b in told) == 2 and beats.live() == {} and len(beats.history(str(run.runId))) == 2
