"""Queries take whole texts: what stands past a prefix or before a tail counts."""

import random

import pytest

from folia.plans import registry

RNG = random.Random(4)


def prose(n):
    return " ".join("".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(3, 9))) for _ in range(n))


@pytest.fixture
def run(spark, tmp_path):
    def one(query, *texts, table="documents", key="doc_id"):
        spark.createDataFrame(list(enumerate(texts, 1)), f"{key} bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return sorted(registry.QUERIES[query](spark, str(tmp_path)).collect())

    return one


def test_loop_periodic(run):
    loop = prose(300)[:1999] + "\n"
    (got,) = run("loop_periodic", prose(200) + loop * 6)
    assert got.periodic > 6000


def test_fidelity_correct(run):
    # a letter is lost in all but fooBarBazz (upper case); an identifier and a code are put right, a number never is
    (got,) = run("fidelity_correct", "abcdefXy7 part-4711 12.345 fooBarBazz", table="benchmark", key="item_id")
    assert set(got.text.split()) == {"abcdefXy7", "part-4711", "12345", "fooBarBazz"}


def test_gate_wrap_windows(run):
    long = prose(120)
    (got,) = run("completion_gate", long)
    assert int(got.text) == len(long) + len("s")  # the summary counts as well
    assert run("latex_wrap", long)[0].wrapped.startswith(long)
    # two lines of 1,000 characters are more than a window of 1,700 holds
    assert [(r.window, r.n) for r in run("heading_windows", "x" * 1000 + "\n" + "y" * 1000)] == [(0, 1), (1, 1)]
