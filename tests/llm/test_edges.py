"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folia.llm import decontaminate, exact_dedup, html_main, licenses, packing, simhash, substring, token_counts, token_files, toxicity
from folia.llm.graph import connected_components

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(7)
WORD = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 8))) for _ in range(500)]
LONG = " ".join(RNG.choices(WORD, k=120_000))
BASE = " ".join(RNG.choices(WORD, k=120))
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, BASE + " tail word"), (None, BASE), (8, "one"),
    (9, "<|endoftext|> 你好 café  İstanbul ﬁ x"), (9, "another text under the same id"), (None, None),
]
CLASH = "copy row_key fp h k d n spans token keep_id kept words line base piece start length text_sha256 node u v".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def listed(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_simhash(docs, none):
    got = listed(simhash.simhash_components(docs), "doc_id", "component_id")
    assert len(got) == len(ROWS)
    group = dict(x for x in got if x[0] is not None)
    assert group[1] == group[2] == 1 and group[3] == group[4] == group[5] == 3 and group[6] == 6
    assert ("None", "1") in {(str(a), str(b)) for a, b in got} and ("None", "3") in {(str(a), str(b)) for a, b in got}
    wide = dict(listed(simhash.simhash_components(docs.where("doc_id is not null"), words=5, bits=256, radius=38, tables=24), "doc_id", "component_id"))
    assert wide[7] == 1
    assert simhash.simhash_components(none).count() == 0


def test_simhash_hot_buckets(spark):
    """Slots smaller than the group: the pairs of slots still find every link."""
    rng = np.random.default_rng(3)
    top = rng.integers(0, 2**63, 4).tolist()
    fps = sorted({(t ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))) for t in top for _ in range(60)})
    nodes = spark.createDataFrame([(f.to_bytes(8, "big"), k) for k, f in enumerate(fps)], "fp binary, node bigint")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for blocks in (simhash.exact_blocks(64, 4, 10), simhash.exact_blocks(64, 4, 1 << 22)):
        found = connected_components(simhash.links(nodes, blocks, 64, 4, slot=16))
        got = {r.node: r.component for r in found.collect()}
        assert got == {k: find(k) for k in range(len(fps)) if find(k) != k or any(find(j) == k for j in range(len(fps)) if j != k)}


def test_bit_sliced_pairs():
    rng = np.random.default_rng(5)
    for bits, radius in ((64, 4), (256, 38)):
        base = rng.integers(0, 256, (5, bits // 8), np.uint8)
        fps = np.repeat(base, 40, axis=0)
        flip = rng.random((len(fps), bits)) < radius / bits / 2
        fps = fps ^ np.packbits(flip, axis=1)
        ends = np.repeat([30, 31, 150, 200], [30, 1, 119, 50])
        got = {(int(a), int(b)) for x in simhash.pairs_within(fps, ends, radius) for a, b in zip(*x, strict=True)}
        on = np.unpackbits(fps, axis=1).astype(int)
        want = {(a, b) for a in range(200) for b in range(a + 1, ends[a]) if np.abs(on[a] - on[b]).sum() <= radius}
        assert got == want and want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (200, 199), (199, 200)], "u bigint, v bigint")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {**dict.fromkeys(range(61), 0), 199: 199, 200: 199}


def test_token_files(docs, none):
    shards = token_files.write_token_files(docs, BYTES, 2)
    got = token_files.read_token_files(docs, shards).collect()
    assert len(got) == len(ROWS) and sum(r.n_tokens for r in got) == shards[-1].start + shards[-1].ids
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {1}
    several = token_files.write_token_files(docs, BYTES, 2, file_docs=3)  # the same documents in the same order
    cols = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert len(several) > 1 and listed(token_files.read_token_files(docs, several), *cols) == listed(token_files.read_token_files(docs, shards), *cols)
    assert token_files.write_token_files(none, BYTES, 2) == [] and token_files.read_token_files(none, []).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_packing_bits(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 3 * token_files.BLOCK + 17).astype("<u4")
    assert (token_files.unpack(token_files.pack(ids[:1000], bits), bits, 1000) == ids[:1000]).all()
    w = token_files.Writer(f"file://{tmp_path}/a.ids", bits)
    for k in range(0, len(ids), 50_000):
        w.add(k, ids[k : k + 50_000])
    w.close()
    r = token_files.Reader(f"file://{tmp_path}/a.ids")
    for a, n in ((0, 10), (65_530, 20), (len(ids) - 5, 5), (100, 140_000), (7, 0)):
        assert (r.read(a, n) == ids[a : a + n]).all()


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS if i is not None)
    got = token_counts.token_counts(docs, WORDS, table=4)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect() if r.doc_id is not None) == want
    assert token_counts.token_counts(none, WORDS).count() == 0


def test_toxicity(spark, docs, none):
    bad = [(k, f"{' '.join(RNG.choices(WORD, k=30))} zrutobel {' '.join(RNG.choices(WORD, k=20))}", 1) for k in range(100, 160)]
    good = [(k, " ".join(RNG.choices(WORD, k=50)), 0) for k in range(200, 300)]
    table = spark.createDataFrame(bad + good, "doc_id bigint, text string, toxic int")
    labels = table.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (100, None), (9999, 1)], "doc_id bigint, toxic int"))
    model = toxicity.fit_toxicity(table.select("doc_id", "text"), labels)
    probe = spark.createDataFrame([(1, "here zrutobell is"), (2, " ".join(WORD[:40])), (3, LONG + " zrutobel")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(probe, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] > 0.5
    rest = toxicity.score_toxicity(docs, model).collect()
    assert len(rest) == len(ROWS) and all(0 <= r.score <= 1 for r in rest)
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.fit_toxicity(none, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.5}


def test_exact(docs, none):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs, "max").collect()}
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    assert (got[1, sha(BASE)].keep_id, got[1, sha(BASE)].group_size, got[1, sha(BASE)].kept) == (2, 4, False)
    assert got[None, sha(BASE)].kept is False and got[2, sha(BASE)].kept is True
    assert got[3, sha("")].keep_id == 4 and got[3, sha("")].group_size == 3
    assert len(exact_dedup.exact_groups(docs).collect()) == len(ROWS) and exact_dedup.exact_groups(none).count() == 0
    # a hash on which nearly all texts collide
    weak = exact_dedup.exact_groups(docs, "max", hashed=lambda t: F.pmod(F.length(t), F.lit(2)))
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert listed(weak, *cols) == listed(exact_dedup.exact_groups(docs, "max"), *cols)


def test_packing(docs, none):
    got = packing.pack_documents(docs, WORDS, 1, 64).collect()
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert sum(n for _, n in b) <= 64 and all(o == sum(n for p, n in b if p < o) for o, _ in b)
    assert sum(r.doc_id in (3, 4, 5) for r in got) == 3
    assert packing.pack_documents(none, WORDS).count() == 0
    pieces = packing.token_pieces(docs.where("doc_id < 8"), WORDS, 1, 64, ids=True)
    held = pieces.cache()
    made = packing.sequences(held, packing.place(held.drop("ids"), 64))
    assert all(len(r.ids) <= 256 for r in made.collect())


def test_sum_of_squares():
    rng = np.random.default_rng(1)
    sizes = np.sort(np.clip(rng.lognormal(6.8, 0.9, 5000), 1, 4096).astype(int))[::-1]
    loads = np.bincount(packing.sum_of_squares(sizes, 4096), sizes)
    assert loads.max() <= 4096 and len(loads) <= 1.005 * sizes.sum() / 4096
    assert packing.sum_of_squares(np.array([3, 3, 2, 2, 1, 1]), 4).max() == 2


def naive_sum_of_squares(sizes, capacity):
    """Each size where the squared counts of open bins, summed over their gaps, become smallest: every bin tried; of equal
    ones the fullest, a new bin last."""
    loads, out = [], []
    for s in sizes:
        def total(k, s=s):
            after = loads[:k] + [loads[k] + s] + loads[k + 1 :] if k < len(loads) else [*loads, s]
            counts: dict = {}
            for x in after:
                if x < capacity:
                    counts[capacity - x] = counts.get(capacity - x, 0) + 1
            return sum(n * n for n in counts.values())

        fits = [k for k in range(len(loads)) if loads[k] + s <= capacity]
        best = min([*fits, len(loads)], key=lambda k: (total(k), -(loads[k] if k < len(loads) else 0)))
        if best == len(loads):
            loads.append(0)
        loads[best] += s
        out.append(loads[best])
    return sorted(loads)


def test_sum_of_squares_naive():
    rng = np.random.default_rng(2)
    for capacity in (7, 20, 64):
        for _ in range(4):
            sizes = np.sort(rng.integers(1, capacity + 1, 60))[::-1]
            loads = np.bincount(packing.sum_of_squares(sizes, capacity), sizes)
            assert sorted(loads.astype(int).tolist()) == naive_sum_of_squares(sizes.tolist(), capacity)


def test_packing_ids(spark):
    """Large ids stay whole beside a null one."""
    big = [9007199254740993, 9007199254740995, None, -5]
    df = spark.createDataFrame([(i, "a few words") for i in big], "doc_id bigint, text string")
    assert sorted((r.doc_id for r in packing.pack_documents(df, WORDS).collect()), key=str) == sorted(big, key=str)


def test_decontaminate(spark, docs, none):
    words = BASE.split()
    items = [(1, " ".join(words[5:30])), (2, "one"), (3, None), (4, ""), (5, " ".join(words[20:34])), (None, "one"), (10, "x y z")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    bench = bench.drop("doc_id")
    one = decontaminate.contaminations(docs, bench)
    cols = ("doc_id", "n_words", "n_hit", "item_ids", "spans")
    got = {str(r.doc_id): r for r in one.collect()}
    assert (got["1"].n_hit, got["1"].item_ids, got["1"].spans) == (29, ["1", "5"], [[5, 34]])
    a, b = got["1"].byte_spans[0]
    assert BASE[a:b] == " ".join(words[5:34])
    assert got["8"].n_hit == 1 and got["8"].item_ids == ["2"] and got["3"].n_words == 0
    parts = decontaminate.contaminations(docs, bench, most=10)
    assert listed(parts, *cols) == listed(one, *cols)
    assert decontaminate.contaminations(none, bench).count() == 0
    assert decontaminate.contaminations(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_substring(docs, none, monkeypatch):
    # a sketch that takes nearly all windows for repeated, one that doesn't, and none but a shuffled count; places of runs in
    # a bitmap, in one where nearly all share cells, and in a shuffle
    for how in ({"width": 1 << 10}, {"width": 1 << 20}, {"sketched": 0}, {"most": 1}, {"crowded": True}):
        if how.pop("crowded", False):
            monkeypatch.setattr(substring, "LEAST_CELLS", 8)
            monkeypatch.setattr(substring, "PLACE_CELLS", 0)
        got = substring.without_repeats(docs, **how).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        assert len(got) == len(ROWS) and by[1][0].n_removed == 0
        assert [r.n_removed for r in by[2]] == [120, 120] and by[7][0].kept_text == "tail word"
        assert by[6][0].n_removed == 0 and by[6][0].n_words == 120_000
        assert all(r.n_removed == 0 for r in by[None])
    assert substring.without_repeats(none).count() == 0


def brute_repeats(docs: dict, window: int = 50) -> dict:
    least, gone = {}, {}
    words = {d: t.split() for d, t in docs.items()}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][k : k + window]), d)
    for d, w in words.items():
        gone[d] = sorted({j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < d for j in range(k, k + window)})
    return {d: " ".join(x for k, x in enumerate(w) if k not in set(gone[d])) for d, w in words.items()}


@pytest.mark.parametrize("how", [{}, {"sketched": 0, "most": 1}, {"crowded": True}])
def test_substring_passages(spark, how, monkeypatch):
    """Passages that many documents share, between words of their own, with repeats inside a document."""
    if how.pop("crowded", False):
        monkeypatch.setattr(substring, "LEAST_CELLS", 8)
        monkeypatch.setattr(substring, "PLACE_CELLS", 0)
    rng = random.Random(3)
    passages = [[rng.choice(WORD) for _ in range(n)] for n in (49, 50, 51, 70, 130, 400)]
    docs = {}
    for d in range(60):
        parts = [[rng.choice(WORD) for _ in range(rng.randint(0, 30))]]
        for p in rng.choices(passages, k=rng.randint(0, 4)):
            a = rng.randint(0, len(p) // 3)
            parts += [p[a:], [rng.choice(WORD) for _ in range(rng.randint(0, 30))]]
        docs[d] = rng.choice([" ", "\n", " \t "]).join(x for p in parts for x in p)
    docs |= {70: docs[3], 71: docs[3] + " and more", 72: "the " * 300, 73: "the " * 200}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.kept_text for r in substring.without_repeats(df, **how).collect()}
    assert got == brute_repeats(docs) and sum(map(len, got.values())) < 0.7 * sum(map(len, docs.values()))


def test_word_hashes():
    """The same word has the same hash wherever it stands; pieces and giant words count as any other."""
    words = [b"a", b"ab", b"ba", b"a" * substring.CHUNK, b"b" * (2 * substring.CHUNK + 5), b"\xc3\xa9", b"x" * 300]
    alone = [int(substring.word_hashes([w])[0][0]) for w in words]
    assert len(set(alone)) == len(words)
    rng = random.Random(1)
    texts = [b" ".join(rng.choices(words[:3] + words[5:], k=n)) for n in (0, 1, 5, 200_000, 3)] + [b" \t ".join(words), b" " * 300_000, b""]
    h, counts = substring.word_hashes(texts)
    known = dict(zip(words, alone, strict=True))
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert h.tolist() == [known[w] for t in texts for w in t.split()]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/x'>Menu</a></nav>{}<footer>f</footer></body></html>"
    rows = [
        (1, "http://a.example/1", page.format("<article><h1>Head</h1><p>One &amp; two\n three<p>Four<aside>no</aside><div class='ad box'>no</div></article>")),
        (2, "http://a.example/2", page.format("<article><h1>Other</h1><p>Five<br>six</article>")),
        (3, None, None), (4, "http://b.example/", ""), (5, "http://c.example/x", "no markup < at all"),
        (6, "http://d.example/1", page.format("<div id='c1'><div class='promo'>Buy</div><div id='main-text'><p>" + "Long text. " * 30 + "</p></div></div>")),
        (7, "http://d.example/2", page.format("<div id='c1'><div class='promo'>Buy</div><div id='main-text'><p>" + "Other text. " * 30 + "</p></div></div>")),
        (8, "http://e.example/", "<p>cut off <b>here &am"), (2, "http://a.example/2", page.format("<article><h1>Other</h1><p>Five<br>six</article>")),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("z")).withColumn("main", F.lit(1))
    got = {r.page_id: r.text for r in html_main.main_texts(df).collect()}
    assert got[1] == "Head\nOne & two three\nFour" and got[2] == "Other\nFive six" and got[3] == got[4] == ""
    assert got[5] == "no markup < at all" and got[8] == "cut off here &am"
    assert got[6].startswith("Long text.") and "Buy" not in got[6] and "Menu" not in got[6]
    assert html_main.main_texts(df.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    text = "x " * 50 + "Released under the MIT  License, and This work is licensed under the GNU general Public License, version 3. CC BY-NC"
    extra = spark.createDataFrame([(50, text), (51, None), (50, text), (52, "under the mit"), (53, "Licensed under the Apache License, Version 2.0")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.license_scan(extra).collect()}
    assert got[50].base_labels == "cc-by-nc,mit" and got[50].n_base == 2 and got[50].first_word == 51
    assert "gpl-3" in got[50].labels.split(",") and got[53].labels == got[53].base_labels == "apache-2"
    assert got[51].n_words == 0 and got[51].first_word is None and got[51].labels == "" and got[52].n_base == 0
    assert licenses.license_scan(docs).count() == len(ROWS) and licenses.license_scan(none).count() == 0


def test_html_template(spark):
    body = "<html><body><div class='top'>Site</div><div class='post'><h1>Head {0}</h1><div class='lead'>Lead {0}</div><div class='body'>{1}</div></div><div class='side'><p>About us</p></div></body></html>"
    box = "<p>Text {0} " + "word " * 60 + "</p><div class='box'><p>Write to us</p></div><p>End {0}</p>"
    rows = [(k, f"http://{host}/{k}", body.format(k, box.format(k))) for host, ks in (("a", range(12)), ("b", (20, 21))) for k in ks]
    odd = [(30, "http://a/30", None), (31, "http://a/31", "<html><body><div class='top'>Si"), (32, "http://a/32", "<html><body><article>Own</article><p>x</p></body></html>")]
    df = spark.createDataFrame(rows + odd, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_main.main_texts(df).collect()}
    for k in (*range(12), 20, 21):
        assert got[k] == f"Head {k}\nLead {k}\nText {k} {'word ' * 59}word\nEnd {k}"
    assert got[30] == "" and got[31] == "Si" and got[32] == "Own"


def test_html_classes(spark):
    """Headings are no notice whatever their class; deep and long pages take time by their length."""
    import time

    page = "<html><body><div class='m'>Menu</div><article><header><h1>Head {0}</h1></header><h2 class='related work'>Related {0}</h2><p>Text {0}</p><div class='notice'>Note {0}</div></article></body></html>"
    deep = "<div>" * 200_000 + "deep text" + "</div>" * 200_000
    rows = [(k, f"http://a/{k}", page.format(k)) for k in range(5)] + [(None, "http://b/1", deep), (9, "http://c/1", "<p>" * 300_000 + "end")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    began = time.time()
    got = {r.page_id: r.text for r in html_main.main_texts(df).collect()}
    assert [got[k] for k in range(5)] == [f"Head {k}\nRelated {k}\nText {k}" for k in range(5)]
    assert got[None] == "deep text" and got[9] == "end" and time.time() - began < 60


def test_remembered():
    from folia.llm.tokens import Remembered, forget

    asked: list = []
    held = Remembered(lambda x: asked.append(x) or len(x), most=2)
    assert [held[x] for x in ("a", "bb", "a", "ccc", "a")] == [1, 2, 1, 3, 1] and asked == ["a", "bb", "ccc", "a"]
    forget()
    assert held["a"] == 1 and asked[-2:] == ["a", "a"]


def test_batches_end_by_bytes(spark, docs):
    """A worker never gets more than a few texts of a megabyte at once."""
    import pyarrow as pa

    from folia.llm.common import BATCH_BYTES, text_only

    rows = text_only(spark.range(24).selectExpr("id as doc_id", "repeat('x', 1 << 20) as text").repartition(1))
    sizes = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [sum(len(x.as_py()) for x in b.column("text"))]}) for b in bs), "n bigint, size bigint").collect()
    assert sum(r.n for r in sizes) == 24 and max(r.size for r in sizes) <= BATCH_BYTES + (1 << 20)
