"""Operators on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from folia.functions import columns as C
from folia.operators import assembly, pages, quality, summary, tables


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, None, "paper"), (1, 2, "", "report"), (1, 3, "T", "report"), (1, 4, "U", "paper"), (2, 1, None, None)], "doc_id int, page int, title string, kind string")
    assert rows(assembly.majority(df, "kind"), "doc_id", "kind") == [(1, "paper")]
    assert rows(df.groupBy("doc_id").agg(assembly.first_value(F.col("title")).alias("t")), "doc_id", "t") == [(1, "T"), (2, None)]


def stitched(spark, *chunks):
    kind = "array<struct<page:int,nth:int,content:string,keywords:array<string>>>"
    df = spark.createDataFrame([(list(chunks),)], f"c {kind}")
    return [(r.pages, r.content) for r in df.select(F.explode(assembly.stitched(F.col("c"))).alias("r")).select("r.*").collect()]


def test_stitch_prose(spark):
    assert stitched(spark, (1, 0, "It goes ", ["a"]), (2, 0, " on here", ["a", "b"]), (3, 0, "and on.", [])) == [([1, 2, 3], "It goes on here and on.")]
    assert len(stitched(spark, (1, 0, "Ends.", []), (2, 0, "on", []))) == 2
    assert len(stitched(spark, (1, 0, "goes", []), (2, 0, "Upper", []))) == 2
    assert len(stitched(spark, (1, 0, "goes", []), (3, 0, "on", []))) == 2
    assert len(stitched(spark, (1, 0, "- a\n- b", []), (2, 0, "on", []))) == 2
    assert len(stitched(spark, (1, 0, "goes", []), (2, 1, "on", []))) == 2
    # lines of a list add up over joined pages
    assert len(stitched(spark, (1, 0, "- a", []), (2, 0, "x\n- b", []), (3, 0, "on", []))) == 2
    assert stitched(spark) == []


def table(i, page, y0, y1, body="<tr><td>1</td><td>2</td></tr>", caption=None, nth=0, head="<tr><th>a</th><th>b</th></tr>"):
    return (1, f"t{i}", page, nth, [0.0, float(y0), 1000.0, float(y1)], caption, f"<table>{head}{body}</table>")


def test_stitch_tables(spark):
    schema = "doc_id bigint, table_id string, page int, nth int, bbox array<double>, caption string, html string"

    def run(*ts):
        out = tables.stitch_tables(spark.createDataFrame(list(ts), schema)).collect()
        return [(r.table_id, r.pages, r.continues, r.continued_by, r.flat_text.count("\n")) for r in sorted(out, key=lambda r: r.table_id)]

    assert run(table(1, 1, 500, 950), table(2, 2, 0, 990)) == [("t1", [1, 2], None, None, 2)]
    assert len(run(table(1, 1, 500, 800), table(2, 2, 0, 990))) == 2
    assert len(run(table(1, 1, 500, 950), table(2, 2, 200, 990))) == 2
    assert len(run(table(1, 1, 500, 950), table(2, 3, 0, 990))) == 2
    assert len(run(table(1, 1, 500, 950), table(2, 2, 0, 990, caption="Table 8. New"))) == 2
    assert len(run(table(1, 1, 500, 950), table(2, 2, 0, 990, caption="Table 8 (continued)."))) == 1
    assert len(run(table(1, 1, 500, 950), table(2, 2, 0, 990, body="<tr><td>1</td></tr>" + "<tr>" + "<td>x</td>" * 5 + "</tr>"))) == 2
    four = run(*(table(k, k, 0, 950, head="" if k > 1 else "<tr><th>a</th><th>b</th></tr>") for k in range(1, 5)))
    assert four == [("t1", [1, 2, 3], None, "t4", 3), ("t4", [4], "t1", None, 1)]
    two = run(table(1, 1, 500, 950), table(2, 2, 0, 300), table(3, 2, 400, 960, nth=1), table(4, 3, 0, 100))
    assert [(t[0], t[1]) for t in two] == [("t1", [1, 2]), ("t3", [2, 3])]


def test_render(spark):
    p = spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, page int")
    u = spark.createDataFrame([(1, 1, 1, 0, "<table/>"), (1, 1, 0, 0, "## T"), (1, 9, 2, 0, "![](img:1)"), (1, 2, 0, 0, "")], "doc_id int, page int, kind int, nth int, text string")
    got = assembly.rendered(p, u).first().markdown
    assert got == "<page 1>\n## T\n\n<table/>\n</page 1>\n\n<page 2>\n\n</page 2>\n\n<page 3>\n![](img:1)\n</page 3>"


def test_metrics(spark):
    df = spark.createDataFrame([(1, s) for s in ("ok", "ok", "ok_coerced", "degenerate", "oversize")] + [(2, "ok")], "doc_id int, status string")
    got = {r.doc_id: r for r in quality.gate_metrics(df).collect()}
    assert (got[1].first_pass_fail_rate, got[1].degeneration_rate, got[1].coerce_success_rate) == (0.6, 0.2, 0.5)
    assert got[2].coerce_success_rate is None


def test_attempts(spark):
    """The ladder: an ok of the same request, a stopped clock, a rescue, a rescue of nothing, and what failures are called."""
    a = [
        (1, 1, "first", "parse", "stop", "x", None), (1, 2, "retry_enforced", "ok", "stop", "y", 900),
        (2, 1, "first", "ok", "stop", "z", 5),
        (3, 1, "first", "length", "length", "a", None), (3, 2, "retry_enforced", "degenerate", "stop", "b", None),
        (4, 1, "first", "degenerate", "repetition_abort", "l" * 99, None), (4, 2, "reroll", "ok", "stop", "again", 5),
        (5, 1, "first", "degenerate", "repetition_abort", "l", None), (5, 2, "reroll", "empty", "stop", "", None), (5, 3, "retry_unenforced", "parse", "stop", "{", None),
        (6, 1, "first", "parse", "wall_clock_abort", "w", None),
        (7, 1, "first", "parse", "stop", "c" * 20_000, None), (7, 2, "retry_enforced", "ok", "stop", "few", 100),
        (8, 1, "first", "degenerate", "repetition_abort", "c" * 20_000, None), (8, 2, "reroll", "parse", "stop", "s" * 10, None), (8, 3, "retry_enforced", "ok", "stop", "few", 100),
        (9, 1, "first", "schema", "stop", "s", None), (9, 2, "retry_enforced", "degenerate", "repetition_abort", "b", None),
    ]
    df = spark.createDataFrame([(1, *x) for x in a], "doc_id int, page int, attempt int, rung string, verdict string, finish string, text string, chars long")
    cols = ("page", "status", "rescued_by", "attempts", "model_calls", "schema_coerced", "degenerate", "repetition_abort", "text")
    assert rows(quality.first_ok(df), *cols) == [
        (1, "ok_coerced", "retry_enforced", 2, 2, True, False, False, "y"), (2, "ok", "none", 1, 1, False, False, False, "z"),
        (3, "overlong_failed", "none", 2, 2, False, True, False, None), (4, "ok", "reroll", 2, 2, False, False, False, "again"),
        (5, "empty_completion", "none", 2, 3, False, False, False, None), (6, "wall_clock_abort", "none", 1, 1, False, False, False, None),
        (7, "coerced_empty", "none", 2, 2, True, False, False, None), (8, "ok_coerced", "retry_enforced", 2, 3, True, False, False, "few"),
        (9, "failed", "none", 2, 2, False, True, True, None),
    ]
    blank = df.where("page = 7").withColumn("ink", F.lit(0.001))
    assert quality.first_ok(blank).first().status == "ok_coerced"
    got = quality.with_fallback(quality.first_ok(df), spark.createDataFrame([(1, 3, "f"), (1, 2, "f"), (1, 6, None)], "doc_id int, page int, text string"))
    got = {r.page: r for r in got.collect()}
    assert (got[3].status, got[3].rescued_by, got[3].model_calls, got[3].text) == ("fallback_ok", "fallback", 3, "f")
    assert got[2].status == "ok" and got[6].status == "wall_clock_abort"


def test_case_rescue_of_repeated_tokens(spark):
    df = lambda words: spark.createDataFrame([(1, w) for w in words], "doc_id bigint, token string")
    assert rows(quality.case_matches(df(["FOOBAR", "ABc"]), df(["fooBar", "fooBar", "aBC", "AbC"])), "token", "closest") == [("FOOBAR", "fooBar")]


def test_wall_clock(spark):
    ts = "cast('2024-01-01 00:00:00' as timestamp) + make_interval(0, 0, 0, 0, 0, 0, s)"
    df = spark.createDataFrame([(1, 0.0, "abc"), (1, 9.5, "de"), (1, 10.5, "f"), (2, 0.0, "g"), (2, 10.0, "h")], "doc_id int, s double, piece string").withColumn("ts", F.expr(ts))
    got = quality.wall_clock(df, 10, ("doc_id",)).collect()
    assert [(r.doc_id, r.chars, r.stopped.second) for r in got] == [(1, 5, 10)]


def test_page_limits(spark):
    df = spark.createDataFrame([(k, s, c) for k, (s, c) in enumerate([(10.0, 4000), (600.0, 30_000), (10.0, 50_000), *[(20.0, 100)] * 10])], "order int, seconds double, chars int")
    got = sorted(quality.page_limits(df).collect(), key=lambda r: r.order)
    assert [(r.timeout, r.char_limit) for r in got[:3]] == [(600.0, 10_000), (541.5, 9600), (660.0, 17_000)]
    assert got[1].slow and got[1].long and (got[12].timeout, got[12].char_limit) == (900.0, 75_000) and not got[0].slow


def test_oversize_and_cut(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, "a" * 11), (3, "é" * 9), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in pages.oversize(df, 10, 17).collect()}
    assert [got[k].status for k in (1, 2, 3, 4)] == [None, "oversize", "oversize", None]
    assert got[2].error.startswith("11 chars (~3 tok)") and got[3].error.startswith("18 tokens")
    lines = spark.createDataFrame([(["aaaa", "bbbbbbbbbb", "cc"],)], "items array<string>").select(pages.packed(F.col("items"), 9, 6, cut=True).alias("g"))
    assert lines.first().g == [["aaaa"], ["bbbbbb"], ["cc"]]


def test_figures_and_responses(spark):
    import json

    from folia.operators import document

    ok = spark.createDataFrame([(1, "f1"), (1, "f2"), (2, "f1")], "doc_id int, figure_id string")
    assert document.validated(ok) is ok
    for bad in ((1, "f2"), (3, None), (3, "")):
        with pytest.raises(ValueError, match=f"document {bad[0]}"):
            document.validated(ok.union(spark.createDataFrame([bad], ok.schema)))
    d = spark.createDataFrame(
        [(1, 'a "q"', 3, '{"summary":"s","metadata":{"id":1},"images":[{"x":1}],"fidelity":{}}', "m", "no"), (2, "b", None, None, "m", "no")],
        "doc_id int, markdown string, total_pages int, structured string, modality string, fidelity string",
    ).withColumn("total_figures", F.lit(0)).withColumn("total_time_seconds", F.lit(1.5))
    got = {r.doc_id: json.loads(r.json) for r in document.response(d).collect()}
    log = {"total_pages": 3, "total_figures": 0, "total_time_seconds": 1.5, "modality": "m"}
    assert got[1] == {"markdown": 'a "q"', "images": [{"x": 1}], "processing_log": log, "metadata": {"id": 1}, "summary": "s", "semantic_chunks": [], "tables": []}
    assert got[2] == {"markdown": "b", "images": [], "processing_log": {**log, "total_pages": 0}}
    assert "metadata" not in json.loads(document.response(d, True).where("doc_id = 1").first().json)
    pics = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "doc_id int, figure_id string")
    page = [("a", ([(None, "", None), (None, "cap", None)], "sum")), ("b", ([], "sum"))]
    pg = spark.createDataFrame(page, "figure_id string, data struct<figures array<struct<bbox string, caption string, description string>>, summary string>")
    assert {r.figure_id: r.caption for r in document.media_captions(pics, pg).collect()} == {"a": "cap", "b": "sum", "c": ""}


def test_caption_chunks(spark):
    caps = spark.createDataFrame([(1, "Figure 1. A view of the  harbour"), (1, None), (2, "x")], "doc_id bigint, caption string")
    chunks = spark.createDataFrame(
        [(1, "a", "figure 1. a view of the harbour.", None), (1, "b", "Figure 1. A view of the harbor", None), (1, "c", "other words", "Figure 1. A view of the harbour"), (1, "d", "no", None), (2, "a", "Figure 1. A view of the harbour", "")],
        "doc_id bigint, chunk_id string, content string, title string",
    )
    assert rows(tables.caption_chunks(caps, chunks), "doc_id", "chunk_id") == [(1, "a"), (1, "b"), (1, "c")]


def test_summary_tree(spark):
    from folia.operators import summary

    items = spark.createDataFrame([(1, k, f"s{k}" * 3) for k in range(6)] + [(2, 0, "one"), (3, 0, "x" * 9), (3, 1, "y" * 9), (4, 0, " "), (5, 0, "a" * 30)], "doc_id int, nth int, text string")
    answers = [(1, 0, 0, "p"), (1, 0, 1, None), (1, 0, 2, "q"), (1, 1, 0, "Root of p and q. More."), (2, 0, 0, "Only."), (3, 0, 0, None), (5, 0, 0, "word " * 20)]
    got = {r.doc_id: r for r in summary.tree_summaries(items, spark.createDataFrame(answers, "doc_id int, level int, block int, text string"), 13, 17).collect()}
    assert (got[1].summary, got[1].calls, got[1].levels) == ("Root of p and q.", 4, 2) and (got[2].summary, got[2].calls) == ("Only.", 1)
    assert got[3].error == "every call of level 0 failed" and 4 not in got and got[5].error == "no sentence fits the budget"


def test_fidelity(spark):
    src = ["DCRectifierStatus01", "DCRectifierControl_PH", "fooBarBaz", "v2.14.3", "IEC-61850-7", "HTTP", "22.5", "abcdeF1", "abcdeF2"]
    out = ["DCRectifierStatus", "DCRectifierControl_P", "FOOBARBAZ", "v2.14", "IEC-61851-7", "HTTPS", "22.4", "abcdeF3", "fooBarBazz"]
    df = lambda words: spark.createDataFrame([(1, w) for w in words], "doc_id bigint, token string")
    unknown = quality.unknown_tokens(df(out), df(src))
    left = tables.without_stems(unknown, df(src))
    assert {r.token for r in left.collect()} == set(out) - {"DCRectifierStatus", "v2.14"}
    assert rows(quality.case_matches(left, df(src)), "token", "closest") == [("FOOBARBAZ", "fooBarBaz")]
    near = {r.token: (r.closest, r.distance, r.ambiguous) for r in quality.nearest_tokens(left, df(src)).collect()}
    assert near["DCRectifierControl_P"] == ("DCRectifierControl_PH", 1, False) and near["IEC-61851-7"] == ("IEC-61850-7", 1, False)
    assert near["abcdeF3"] == ("abcdeF1", 1, True) and near["22.4"] == ("22.5", 1, False) and near["HTTPS"] == ("HTTP", 1, False)
    assert not tables.correctable("code", "22.4", False) and not tables.correctable("acronym", "HTTPS", False) and tables.correctable("code", "v2.1", False)
    assert tables.corrected("xfooBar fooBar fooBar_2", {"fooBar": "foo"}) == "xfooBar foo fooBar_2"


def test_figures(spark):
    f = spark.createDataFrame([(1, "f1", 0, "Fig. 1: A plot.", "x"), (1, "f2", 1, "fig. 1:  a plot", "x"), (1, "f3", 2, "Other", None)], "doc_id bigint, figure_id string, nth int, caption string, crop_path string")
    c = spark.createDataFrame([(1, "c1", 0, "Text", None), (1, "c2", 1, "Fig. 1: a plot", None), (1, "c3", 2, "Other", None)], "doc_id bigint, chunk_id string, nth int, content string, title string")
    assert rows(tables.place_figures(f, c), "figure_id", "chunk_id") == [("f1", "c2")]


def test_summary(spark):
    pages_ = [(1, 1, "Alpha beta gamma delta. New things here!", ["body"]), (1, 2, "Alpha beta gamma delta.", ["conclusion"]), (1, 3, "Fresh matter entirely.", ["abstract"]), (1, 4, None, ["abstract"]), (2, 1, "", ["body"])]
    df = spark.createDataFrame(pages_, "doc_id int, page int, summary string, types array<string>")
    got = {r.doc_id: (r.summary, r.dropped) for r in summary.document_summaries(df, 200).collect()}
    assert got == {1: ("Alpha beta gamma delta. New things here! Fresh matter entirely.", 1), 2: (None, 0)}
    cut = df.select(summary.within_budget(F.lit("One two. Three four. Five"), 15).alias("s"), summary.within_budget(F.lit("x" * 30), 15).alias("n")).first()
    assert (cut.s, cut.n) == ("One two.", None)
    kept = df.limit(1).select(summary.without_similar_neighbours(F.array(*map(F.lit, ["a b c", "a b c d", "x y", "", "x y z w v"]))).alias("k")).first().k
    assert kept == ["a b c d", "x y", "", "x y z w v"]


def test_folds(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one.select(pages.packed(arr("aa", "b", "ccc", "d"), 2, 4).alias("p")).first().p == [["aa", "b"], ["ccc"], ["d"]]
    assert one.select(pages.packed_lines(arr("aa", "b", "x" * 9, "", "d"), 4).alias("p")).first().p == ["aa\nb", "x" * 9, "d"]
    got = one.select(pages.sections(arr("a" * 8, "b" * 4, "c" * 8), 3, 1).alias("s")).first().s
    assert got == [["a" * 8, "b" * 4], ["b" * 4, "c" * 8]]
    heads = one.select(pages.heading_lines(arr("# a", "```", "# no", "```", "### b", "#c")).alias("h")).first().h
    assert [(h.at, h.line) for h in heads] == [(0, "# a"), (4, "### b")]
    p = spark.createDataFrame([(1, list("abcde")), (2, ["f"])], "doc_id int, pages array<string>")
    assert rows(pages.page_range(p, None, 2), "doc_id", "page", "text", "total_pages") == [(1, 1, "a", 5), (1, 2, "b", 5), (2, 1, "f", 1)]
    assert rows(pages.page_range(p, 5, None), "page", "text") == [(5, "e")] and pages.page_range(p, 4, 2).count() == 0


def test_columns(spark):
    sizes = {(1152, 1152): 1476, (1152, 1536): 1920, (1536, 2304): 3672, (2304, 3072): 7152, (850, 1100): 1188, (1700, 2200): 7006, (1100, 1000): 1328, (1490, 2304): 3528}
    df = spark.createDataFrame(list(sizes), "w int, h int")
    assert {(r.w, r.h): r.t for r in df.select("w", "h", C.image_tokens(F.col("w"), F.col("h")).alias("t")).collect()} == sizes
    tags = spark.createDataFrame([("Body",), ("news-brief",), (None,), ("weather report",), ("zzz",), ("legacy_x",)], "t string")
    assert [r[0] for r in tags.select(C.section_type(F.col("t"), {"legacy_x": "sidebar"})).collect()] == ["body", "news_brief", "other", "weather_box", "other", "sidebar"]
    cut = spark.range(1).select(C.crop_pixels(*map(F.lit, (100, 100, 1200, 600, 850, 1100))).alias("c"), C.crop_pixels(*map(F.lit, (5, 5, 5, 9, 9, 9))).alias("n")).first()
    assert tuple(cut.c) == (85, 110, 850, 660) and cut.n is None
    assert spark.range(1).select(C.demoted(F.lit("# a\n##### b\n###### c\n#d"))).first()[0] == "## a\n###### b\n###### c\n#d"


def test_headings(spark):
    from folia.operators import document

    h = spark.createDataFrame([(1, 0, 0, "# A"), (1, 0, 2, "# B"), (1, 1, 0, "## C")], "doc_id int, chunk int, at int, line string")
    fixes = spark.createDataFrame([(1, 0, "## A"), (1, 1, "### A"), (1, 2, "#### C"), (1, 3, "no B")], "doc_id int, nth int, line string")
    new = document.levels_by_text(h, fixes)
    assert rows(new, "chunk", "at", "line") == [(0, 0, "## A"), (0, 2, "# B"), (1, 0, "#### C")]
    c = spark.createDataFrame([(1, 0, "# A\ntext\n# B"), (1, 1, "## C"), (1, 2, "none")], "doc_id int, chunk int, content string")
    assert rows(document.with_lines(c, new), "chunk", "content") == [(0, "## A\ntext\n# B"), (1, "#### C"), (2, "none")]
    one = spark.range(1).select(
        document.fixed_headings(F.array(F.lit("# A"), F.lit("# B")), F.lit("## A\n### B\n")).alias("ok"),
        document.fixed_headings(F.array(F.lit("# A"), F.lit("# B")), F.lit("## A\n### X")).alias("no"), document.fixed_headings(F.array(F.lit("# A")), F.lit("# A\n# B")).alias("more"),
    ).first()
    assert (one.ok, one.no, one.more) == (["## A", "### B"], None, None)


def test_structured(spark):
    import json

    from folia.operators import document
    from folia.sources import sinks

    d = spark.createDataFrame([(1, 2, "T", "paper", "S")], "doc_id int, n_pages int, title string, doc_type string, summary string")
    c = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 2, "a2"), (1, 1, 1, "a")], "doc_id int, page int, nth int, content string")
    t = spark.createDataFrame([], "doc_id int, page int, nth int, html string")
    f = spark.createDataFrame([(1, 1, 1, "cap")], "doc_id int, page int, nth int, caption string")
    got = json.loads(sinks.structured(d, c, t, f).first().json)
    assert [x["content"] for x in got["semantic_chunks"]] == ["a", "a2", "b"] and got["tables"] == []
    bare = {"caption": "cap", "description": None, "page": 1, "bbox": None, "format": None, "data": None}
    assert got["images"] == [{"index": 1, **bare}] and got["summary"] == "S"
    none = {"authors": None, "organization": None, "year": None, "file_path": None}
    assert got["metadata"] == {"title": "T", "type": "paper", "doc_type": "paper", "id": 1, "source_pages": 2, "num_chunks": 3, **none}
    f = spark.createDataFrame([(1, 2, 1, "late", None, "{}"), (1, 1, 1, "cap", bytearray(b"png"), None)], "doc_id int, page int, nth int, caption string, crop binary, chart_data string")
    got = json.loads(sinks.structured(d.withColumn("summary", F.lit(None).cast("string")), c, t, f).first().json)
    assert got["images"] == [{"index": 1, **bare, "format": "png", "data": "cG5n"}, {"index": 2, **bare, "caption": "late", "page": 2, "chart_data": "{}"}] and got["summary"] is None
    boxes = spark.createDataFrame([("[1, 2, 3, 4]",), ("[[5, 1], [9, 1], [9, 8], [5, 8]]",), ("[1, 2]",), (None,)], "b string")
    assert [r.e for r in boxes.select(document.box_of(F.col("b")).alias("e")).collect()] == [[1, 2, 3, 4], [5, 1, 9, 8], None, None]
