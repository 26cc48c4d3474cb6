"""The pipeline on planted cases, and on a whole small table against brute force where that is exact."""

import random

import corpus_pipeline as P
import pytest

RNG = random.Random(11)
WORD = ["".join(RNG.choices("abcdefghijklm", k=RNG.randint(3, 9))) for _ in range(3000)]


def text(n):
    return " ".join(RNG.choices(WORD, k=n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    bad = [(k, f"{text(40)} grublox {text(30)}") for k in range(100, 140)]
    base = {k: text(300) for k in range(10)}
    near = [(k + 20, t.replace(t.split()[150], "changed", 1)) for k, t in base.items()]
    passage = text(25)
    rows = bad + list(base.items()) + near + [(40, base[3]), (40, base[3]), (41, None), (42, ""), (43, f"{text(80)} {passage} {text(60)}"), (44, text(5000)), (None, text(90))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars", "7 as row_key")
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(k, 1, 1) for k in range(100, 130)] + [(k, 1, 0) for k in range(10)] + [(44, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, text(30)), (3, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, made):
    docs, ids = spark.read.parquet(f"{made}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, made).cache()
        assert docs.columns == columns
        ids[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    assert not {i for i in ids["toxicity"] if i is not None and 100 <= i < 140} and 0 in ids["toxicity"]
    assert 40 not in ids["exact_dedup"] and 3 in ids["exact_dedup"] and len([i for i in ids["exact_dedup"] if i in (41, 42)]) == 1
    assert not {i for i in ids["simhash"] if i is not None and 20 <= i < 30} and set(range(10)) <= set(ids["simhash"])
    assert 43 in ids["simhash"] and 43 not in ids["decontaminate"] and 44 in ids["decontaminate"] and None in ids["decontaminate"]
    packed = P.run(spark, made).collect()
    assert {r.doc_id for r in packed} == set(ids["decontaminate"])


def test_near_candidates(spark):
    """Pairs at the near-duplicate stage's radius all are linked, each on its own."""
    import numpy as np
    from folia.llm.simhash import SLOT, connected_components, links, nested_blocks, nested_miss

    near, rng, rows = P.NEAR, np.random.default_rng(5), []
    for k in range(300):
        a = rng.integers(0, 2, near["bits"], dtype=np.uint8)
        b = a.copy()
        b[rng.permutation(near["bits"])[: near["radius"]]] ^= 1
        rows += [(np.packbits(a).tobytes(), 2 * k), (np.packbits(b).tobytes(), 2 * k + 1)]
    nodes = spark.createDataFrame(rows, "fp binary, node bigint")
    blocks, further = nested_blocks(near["bits"], near["width"], near["tables"], near["inner"])
    for slot in (SLOT, 2):
        got = connected_components(links(nodes.limit(600 if slot == SLOT else 40), blocks, near["bits"], near["radius"], slot, further)).collect()
        assert {(r.node, r.component) for r in got} == {(k, k - k % 2) for k in range(600 if slot == SLOT else 40)}
    assert nested_miss(near["bits"], near["width"], near["tables"], near["inner"], near["radius"]) < 2e-6


def test_stages_at_the_edges(spark, tmp_path):
    """Empty tables, and clashing column names beside nulls, repeated rows and a very long text."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __key int, __d string, `a.b` int, kept boolean, fp string"
    long = text(40_000)
    rows = [(1, long), (2, None), (2, None), (3, ""), (None, long), (4, "one two"), (4, "one two"), (4, "three")]
    for name, data in (("none", []), ("some", [(*r, "en", "s", 1, 7, "d", 5, True, "f") for r in rows])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (stage, f) in enumerate(P.STAGES[:-1]):
            out = f(spark, docs, d)
            assert out.columns == docs.columns
            if stage != "toxicity":  # without labels every score is 0.5
                docs = out
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "none":
            assert got == [] and P.run(spark, d).count() == 0
        else:  # null and empty texts are one text, that of row 2, wherever ids tie one row stays
            assert [i for i, _ in got] == [1, 2, 4, 4] and {t for i, t in got if i == 4} == {"one two", "three"}
