"""Text functions against literal cases and properties."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folia.functions import completions, html_text, latex, markdown, split


def test_line_passes():
    assert markdown.repeated_lines(["# a", "# a", "", "", "b"]) == ["# a", "", "", "b"]
    head = "Journal of Things"
    lines = ["12", head, "text", head, "1 2 3 4 5", "<!-- image -->", head, "end", "7", "8"]
    assert markdown.artifacts(lines) == [head, "text", "end"]
    assert markdown.hyphenated(["magne-", "ti-", "zation of", "Foo-", "Bar", "# x-", "y"]) == ["magnetization of", "Foo-", "Bar", "# x-", "y"]
    assert markdown.figure_numbers(["**Figure 6:** a", "x", "**Figure 6.** b"]) == ["**Figure 1:** a", "x", "**Figure 2.** b"]
    assert markdown.figure_numbers(["**Figure 6:** a", "**Figure 7:** b"]) == ["**Figure 6:** a", "**Figure 7:** b"]
    assert markdown.figure_captions(["**Figure 1:** a", "", "![](x)", "(a) one", "(b) two", "text"]) == ["**Figure 1:** a", "", "![](x)", "text"]
    assert markdown.image_placeholders(["![a](http://x)", "![a](img:1)", "b"]) == ["![a](img:1)", "b"]
    assert markdown.one_title(["# a", "# b", "## c"]) == ["# a", "## b", "## c"]


def test_text_passes():
    assert markdown.references("1508- - -13 and 2 - - - 3") == "1508-13 and 2-3"
    assert markdown.citations("a[^1] b[^2] c^3^ d<sup>4, 5</sup>") == "a[^1] b[^2] c[^3] d[^4][^5]"
    assert markdown.citations("a<sup>1</sup> b<sup>2</sup> c[^3] [^3]: note") == "a<sup>1</sup> b<sup>2</sup> c<sup>3</sup> [^3]: note"
    assert markdown.citations("a^1^") == "a^1^"
    assert markdown.raised_and_lowered("H<sub>2</sub>O x<sup>n</sup> y<sub>Q</sub>") == "H₂O xⁿ y<sub>Q</sub>"
    assert markdown.raised_and_lowered("$$a$$ x<sup>n</sup>") == "$$a$$ x<sup>n</sup>"
    assert markdown.equation_tags(["$$", "a = b, (8)", "$$", r"$$c \qquad (9)$$"]) == ["$$", r"a = b \tag{8}", "$$", r"$$c \tag{9}$$"]
    assert markdown.math_headings([r"$$\mathrm{III.~RESULTS~AND}$$", r"$$\mathrm { A . ~ S E T }$$", r"$$\mathrm{B.~SET}$$"]) == ["## III. RESULTS AND", "## A . SET", "### B. SET"]
    assert markdown.white_space("a\n# b\n\n\n\n\nc  \n") == "a\n\n# b\n\n\nc\n"


def test_dedup_passes():
    para = "This paragraph is long enough to be compared with the others of the text, really."
    assert markdown.similar_paragraphs(f"{para}\n\nshort\n\n{para[:-1]}!") == f"{para}\n\nshort"
    block = ["line one of the block", "line two of the block", "line three of it", "and a fourth"]
    assert markdown.similar_blocks([*block, "other words entirely here", *block]) == [*block, "other words entirely here"]
    half = "".join(f"{k:03d} words " for k in range(60))
    assert markdown.overlapping_lines([half + half])[0] == half.rstrip()
    assert markdown.postprocess("a\na\n\n\n\n\nb").startswith("a\n\n\nb")


def test_latex():
    assert latex.wrap(r"\alpha + \beta = 1") == r"$$\alpha + \beta = 1$$"
    assert latex.wrap(r"We see \begin{cases}a\end{cases} in the text") == r"We see $\begin{cases}a\end{cases}$ in the text"
    for same in (r"$\alpha$", "plain", r"# \alpha", "```\n\\alpha\n```", r"\begin{cases}a", r"- \alpha", r"\begin{itemize}a\end{itemize} word text"):
        assert latex.wrap(same) == same


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["\\alpha", "x", "word text", "\n", "$", "\\begin{cases}", "\\end{cases}", " ", "```", "+ 1", "\\[", "\\]"]), max_size=14))
def test_latex_inserts_only_dollars(parts):
    text = "".join(parts)
    bare = lambda t: [x.rstrip() for x in t.replace("$", "").split("\n")]
    assert bare(latex.wrap(text)) == bare(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. !?;。é\n", max_size=300), st.integers(5, 40), st.integers(8, 60))
def test_pages_rejoin(text, chars, tokens):
    line = text.replace("\n", "")
    pieces = split.split_line(line, chars, tokens)
    assert "".join(pieces) == line and all(len(p) <= chars and split.cost(p) <= tokens for p in pieces)
    pages = split.paginate(text, chars, tokens)
    assert "".join("".join(pages).split()) == "".join(text.split())
    assert all(len(p) <= chars for p in pages)


def test_paginate():
    assert split.paginate("a\n\nb\n\nccc", 4) == ["a\n\nb", "ccc"]
    assert split.paginate("x" * 9 + "\nyy\nzz\n\nq", 5) == ["x" * 9, "yy\nzz", "q"]
    assert split.paginate(" \n ") == []
    uri = "data:image/png;base64," + "A" * 300
    assert split.paginate(f"see {uri} here", 100, 100) == ["see data:image/png;base64,[payload removed] here"]


def page(**kw):
    meta = dict.fromkeys(("title", "authors", "organization", "year", "doc_type"))
    return {"metadata": meta, "summary": "s", "semantic_chunks": [{"content": "c", "section_type": "body"}], "figures": [], "tables": [], **kw}


def test_json():
    assert completions.lenient('```json\n{"a": 1}\n```') == ({"a": 1}, None)
    assert completions.lenient('so: {"a": "\\eta"}')[0] == {"a": "\\eta"}
    assert completions.lenient('{"a": "\\beta \\n"}')[0] == {"a": "\\beta \n"}
    assert completions.lenient('{"a": 1} {"b": 2}')[0] == {"a": 1}
    assert completions.lenient("nothing")[0] is None and completions.lenient("")[1] == "empty output"


def test_gate():
    good = json.dumps(page())
    assert completions.gate(good, "stop") == ("ok", None)
    assert [completions.gate(good, f)[0] for f in ("repetition_abort", "length")] == ["degenerate", "length"]
    assert completions.gate("  ", "stop")[0] == "empty" and completions.gate("{oops", "stop")[0] == "parse"
    assert completions.gate(json.dumps(page(tables=[{"html": 1}])), "stop")[0] == "schema"
    assert completions.gate("same words again " * 400, "stop")[0] == "degenerate"
    flat = page(figures=[{"bbox": [1, 2, 3, 4], "caption": None, "chart_data": {"header": ["a"], "rows": [["1", "2"]]}}])
    assert completions.gate(json.dumps(flat), "stop")[0] == "ok" and len(completions.repaired(flat)) == 2
    assert completions.content_chars(page()) == 2


def test_loops():
    assert completions.periodic("Intro text here. " + "the same sentence once more. " * 40)["score"] > 600
    rows = completions.periodic("".join(f"Row {k} value {k * 10}\n" for k in range(60)))
    assert rows["numbered_rows"] and rows["numeric_repeats"] >= 10
    data = completions.periodic("".join(f"Row {k} value {k * k * 7919 % 1009}\n" for k in range(60)))
    assert data["score"] == 0
    assert completions.numeral("XIV")[0] == 14 and completions.numeral("一百零三")[0] == 103 and completions.numeral("二〇二五")[0] == 2025
    unit = "A sentence that is said again and again. Another one of the same kind here. "
    assert completions.repeated(unit * 200)["score"] > 4000
    assert completions.repeated("".join(f"Notice number {chr(97 + k % 26) * 3}{k} about matters. {unit}" for k in range(150)))["score"] == 0


def test_html():
    md = html_text.markdown("<h1>T</h1><script>x</script><p>a <b>b</b> <a href='u'>c</a></p><ul><li>one<li>two</ul>")
    assert md == "# T\n\na **b** [c](u)\n\n* one\n* two"
    table = "<table><tr><th>a</th><th> b\n c</th></tr><tr><td>1<td>2</table>"
    assert html_text.flat_table(table, "Cap  x") == "Cap x\na | b c\n1 | 2" and html_text.widest_row(table) == 2
    one = "<table><tr><th>h</th></tr><tr><td>1</td></tr></table>"
    assert html_text.appended(one, "<table><tr><th>H</th></tr><tr><td>2</td></tr></table>") == "<table><tr><th>h</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    assert html_text.with_header(one, "<table><tr><td>2</td></tr></table>") == "<table><tr><th>h</th></tr><tr><td>2</td></tr></table>"


@pytest.mark.parametrize("text", ["", "<", "<p", "<table><tr>", "</td></tr>", "<tr><td>a</tr><td>b"])
def test_broken_markup(text):
    html_text.markdown(text)
    html_text.flat_table(text)


def test_params():
    from folia.functions import params

    assert params.page_range("2-5") == (2, 5) and params.page_range("3") == (3, 3)
    assert params.flag("Yes", "x") and not params.flag("off", "x") and params.seed_policy("7") == 7 and params.seed_policy(" Fixed ") == "fixed"
    for f, bad in ((params.page_range, "5-2"), (params.page_range, "0"), (params.temperature, 2.1), (params.temperature, "x"), (params.seed_policy, "-1")):
        with pytest.raises(ValueError):
            f(bad)


def test_closed_json():
    assert completions.closed('{"a": [1, 2,') == {"a": [1, 2]} and completions.closed('```json\n{"a": "\\alpha",}\n```') == {"a": "\\alpha"}
    with pytest.raises(ValueError):
        completions.closed("nothing")
    assert completions.ends_in_loop("abc" * 300) and not completions.ends_in_loop("abc" * 100)


def test_section_types_in_the_gate():
    chunk = lambda tag: {"content": "words", "title": None, "keywords": [], "section_type": tag}
    p = page(semantic_chunks=[chunk("Footnotes"), chunk("news-article"), chunk(None), chunk("body")])
    verdict, why, got = completions.gated(json.dumps(p), "stop")
    assert (verdict, why) == ("ok", None) and [c["section_type"] for c in got["semantic_chunks"]] == ["appendix", "news_article", "other", "body"]
    assert completions.gate(json.dumps(page(semantic_chunks=[chunk(5)])), "stop")[0] == "schema"
    assert completions.canonical("My Own", {"my_own": "legal_notice"}) == "legal_notice" and completions.canonical("导读", {"导读": "index"}) == "index"
    flat = page(figures=[{"bbox": [1, 2, 3, 4], "caption": None, "description": None}])
    assert completions.gate(json.dumps(flat), "stop", quads=False)[0] == "ok"


def test_fallback_page():
    foreign = {"metadata": "x", "summary": 5, "semantic_chunks": [{"content": "a", "chunk_id": 3, "section_type": "Lead Article", "title": 1}, {"content": 5}, 7],
               "figures": [{"bbox": [1, 2], "caption": 4}, {"bbox": [1, 2, 3, 4]}], "tables": [{"html": "<table>", "bbox": None}, {"html": 1}]}
    got = completions.five_keys(foreign)
    assert got["semantic_chunks"] == [{"chunk_id": "3", "title": None, "content": "a", "keywords": [], "section_type": "news_article"}] and got["summary"] is None
    assert got["metadata"] == {"title": None, "authors": [], "organization": None, "year": None, "doc_type": None} and len(got["tables"]) == 1
    assert [f["bbox"] for f in completions.fallback_page(json.dumps(foreign), "stop")["figures"]] == [None, [[1, 2], [3, 2], [3, 4], [1, 4]]]
    assert completions.five_keys({"metadata": {"authors": "A"}})["metadata"]["authors"] == ["A"]
    assert [completions.fallback_page(t, f) for t, f in ((json.dumps(foreign), "length"), ("", "stop"), ("{oops", "stop"), ("[1]", "stop"))] == [None] * 4


def test_repeated_units_weigh_their_characters():
    long, short = "A sentence that says the very same thing every time it comes.", "Quite another short one."
    loop = " ".join([long] * 30)
    assert completions.repeated(loop)["score"] == 27 * len(long)
    fresh = " ".join(f"{'abcdefghij'[k]}{'klmnopqrst'[k]} is some new sentence." for k in range(3))
    assert completions.repeated(loop + " " + fresh)["score"] == 27 * len(long)  # three of 33 units, but few of its characters
    assert completions.repeated(" ".join(f"{short} Number {'abcdefghij'[k % 10] * (k + 9)} is new here." for k in range(9)))["score"] == 0


def test_wrap_record():
    from folia.functions import latex

    record = {"summary": r"\alpha + \beta", "chunks": [{"content": r"\gamma = 1", "n": 1}, {"content": None}], "other": r"\alpha"}
    got, changed = latex.wrap_record(record, ("summary", "chunks.content", "missing.field"))
    assert got == {"summary": r"$$\alpha + \beta$$", "chunks": [{"content": r"$$\gamma = 1$$", "n": 1}, {"content": None}], "other": r"\alpha"}
    assert changed == {"summary": 1, "chunks.content": 1} and latex.wrap_record(got, ("summary",))[1] == {}


def test_parameters():
    from folia.functions import params, prompts

    assert params.contract("V0.4.1") == "v0.4" and params.contract("mine", {"mine": "v0.5"}) == "v0.5" and params.summary_chars("200") == 200
    assert params.overrides({"temperature": "0.4", "retry_enforce": "off", "contract": None}) == {"temperature": 0.4, "retry_enforce": False}
    for f, bad in ((params.contract, "v0.6"), (params.contract, None), (params.summary_mode, "loud"), (params.summary_chars, "199"), (params.summary_chars, "x"), (params.overrides, {"unknown": 1})):
        with pytest.raises(ValueError):
            f(bad)
    assert prompts.stage_parameters("Qwen/Qwen3.6-397B", "structured")["extra_params"]["reasoning"] == {"enabled": False}
    assert prompts.stage_parameters("qwen3-8b", "structured")["extra_params"] == {"top_p": 0.8, "top_k": 20, "presence_penalty": 1.5}
    assert prompts.stage_parameters("qwen3.5", "structured_page") == {"temperature": 0, "extra_params": {"presence_penalty": 0.3}}
    assert prompts.retry_parameters({"a": 1}, True, {"s": 1}, dialect="vllm") == {"a": 1, "structured_outputs": {"json": {"s": 1}}, "presence_penalty": 0.3}
    assert prompts.retry_parameters(None, False, {}) == {"presence_penalty": 0.3}
    assert prompts.context_chars() == 44688 and prompts.output_budget()["ok"] and prompts.output_budget(max_tokens=25_000)["short"] == {"B3": 24256}
    assert prompts.output_cut("text") == 7000 and prompts.output_cut("image", "B1") == 25500 and prompts.output_cut("image") == 29500


def test_requests(spark):
    import hashlib

    from folia.functions import prompts
    from pyspark.sql import functions as F

    text = 'say "é"\n\\ <x>'
    df = spark.createDataFrame([(text, b"\x89PNG" * 40)], "t string, png binary")
    r = df.select(
        prompts.text_messages(F.col("t")).alias("a"), prompts.image_messages(F.col("png"), prompts.CLASSIFY).alias("b"), prompts.plain_text_messages(F.col("t")).alias("c"),
        prompts.input_key(prompts.text_messages(F.col("t"))).alias("key"), prompts.rendered("cmd", F.col("t"), as_string=True).alias("p"),
        prompts.seed(F.lit("k"), F.lit(1), 0.4).alias("s"), prompts.seed(F.lit("k"), F.lit(1), 0.0).alias("s0"), prompts.seed(F.lit("k"), F.lit(1), 1.0, 7).alias("s7"),
    ).first()
    want = [{"role": "system", "content": "structured_extraction"}, {"role": "user", "content": [{"type": "text", "text": text}]}]
    assert json.loads(r.a) == want and r.key == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest()
    image = json.loads(r.b)[1]["content"][0]["image_url"]["url"]
    assert image.startswith("data:image/png;base64,iVBOR") and "\n" not in image and json.loads(r.c)[1]["content"] == text
    assert r.p == prompts.PREFIX.format(command="cmd") + " " * 8 + text + prompts.SUFFIX
    assert (r.s, r.s0, r.s7) == (int.from_bytes(hashlib.sha256(b"k:1").digest()[:4], "big") % 2**31, None, 7)


def test_figure_verdict(spark):
    from folia.functions import columns
    from pyspark.sql import functions as F

    said = [("Figure.", "figure"), (" artifact ", "artifact"), ("a figure", None), (None, None), ("figure\nbecause", None)]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(said)], "k int, s string").select("k", columns.figure_verdict(F.col("s")).alias("v"))
    assert [r.v for r in sorted(df.collect())] == [v for _, v in said]
