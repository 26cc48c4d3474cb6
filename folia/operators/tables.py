"""Tables across pages, figures at their captions, corrections from a source: per document, in Arrow groups."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions import html_text
from folia.functions.columns import caption_key as key_of
from folia.functions.columns import token_class
from folia.functions.markdown import alike
from folia.operators import assembly

MOST_PAGES = 3
NEW_TABLE, CONTINUED = (re.compile(x, re.I) for x in (assembly.NEW_TABLE, assembly.CONTINUED))


def goes_on(last: dict, first: dict) -> bool:
    """Whether a page's first table continues the last one of the page before."""
    a, b = last["bbox"], first["bbox"]
    if a is None or b is None or len(a) != 4 or len(b) != 4 or a[3] < 930 or b[1] > 100:
        return False
    x, y = html_text.widest_row(last["html"]), html_text.widest_row(first["html"])
    cap = first["caption"]
    return bool(x and y and abs(x - y) <= 1 and not (cap and NEW_TABLE.match(cap) and not CONTINUED.search(cap)))


def stitch(rows: list[dict]) -> list[dict]:
    """Tables of one document, in page order. A continued table keeps the box of its first part. After MOST_PAGES pages
    a new part starts, linked both ways and under the same header."""
    out: list[dict] = []
    tail, end = None, None
    pages: dict[int, list[dict]] = {}
    for t in rows:
        pages.setdefault(t["page"], []).append(t)
    for page in sorted(pages):
        first, *rest = pages[page]
        joins = tail is not None and end == page - 1 and goes_on(tail, first)
        if joins and len(tail["pages"]) < MOST_PAGES:
            tail["html"] = html_text.appended(tail["html"], first["html"])
            tail["pages"] = [*tail["pages"], page]
        else:
            if joins:
                first["continues"], tail["continued_by"] = tail["table_id"], first["table_id"]
                first["html"] = html_text.with_header(tail["html"], first["html"])
            out.append(first)
            tail = first
        out += rest
        tail, end = (rest[-1] if rest else tail), page
    for t in out:
        t["flat_text"] = html_text.flat_table(t["html"], t["caption"])
    return out


TABLE = "doc_id bigint, table_id string, page int, pages array<int>, bbox array<double>, caption string, html string, flat_text string, continues string, continued_by string"


TABLE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("table_id", pa.string()), ("page", pa.int32()), ("pages", pa.list_(pa.int32())), ("bbox", pa.list_(pa.float64())), ("caption", pa.string()),
    ("html", pa.string()), ("flat_text", pa.string()), ("continues", pa.string()), ("continued_by", pa.string()),
])


def stitch_tables(fragments: DataFrame) -> DataFrame:
    """fragments: doc_id, table_id, page, nth, bbox, caption, html. Rows come sorted by document, so that a task goes
    through its documents one after another and holds one at a time."""
    names = [f.strip().split(" ")[0] for f in TABLE.split(", ")]

    def rows(batches) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for _, group in groupby(rows(batches), key=lambda r: r["doc_id"]):
            held += stitch([{**r, "pages": [r["page"]], "continues": None, "continued_by": None} for r in group])
            if len(held) >= 2000:
                yield pa.RecordBatch.from_pylist([{n: t[n] for n in names} for t in held], TABLE_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([{n: t[n] for n in names} for t in held], TABLE_ARROW)

    cols = [F.col("doc_id").cast("bigint").alias("doc_id"), "table_id", F.col("page").cast("int").alias("page"), "nth", "bbox", "caption", "html"]
    return fragments.select(*cols).repartition("doc_id").sortWithinPartitions("doc_id", "page", "nth").mapInArrow(run, TABLE)


def caption_key(s: str | None) -> str:
    return re.sub(r"\s+", " ", (s or "").strip().lower()).rstrip(".")


def echoes(chunk: dict, key: str, least: float = 0.9) -> bool:
    """Whether the chunk's content or title nearly is the caption."""
    return bool(key) and any(k and alike(k, key, least) for k in map(caption_key, (chunk.get("content"), chunk.get("title"))))


def placements(figures: list[dict], chunks: list[dict]) -> Iterator[tuple]:
    """(figure_id, chunk_id): each figure with a crop at the first free chunk that echoes its caption."""
    free = list(chunks)
    for f in figures:
        key = caption_key(f["caption"])
        if f.get("crop_path") and key and (c := next((c for c in free if echoes(c, key)), None)):
            free.remove(c)
            yield f["figure_id"], c["chunk_id"]


def _other(df: DataFrame):
    """Grouped by document under a name of its own, so that both sides may come from one frame."""
    return df.select(F.col("doc_id").alias("other_doc"), *(F.col(c).alias(c) for c in df.columns if c != "doc_id")).groupBy("other_doc")


def place_figures(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, figure_id, chunk_id. Exact echoes and near ones alike; both sides come co-grouped by document."""

    def run(key: tuple, f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = list(placements(f.sort_values("nth").to_dict("records"), c.sort_values("nth").to_dict("records")))
        return pd.DataFrame([(key[0], *x) for x in found], columns=["doc_id", "figure_id", "chunk_id"])

    return figures.groupBy("doc_id").cogroup(_other(chunks)).applyInPandas(run, "doc_id bigint, figure_id string, chunk_id string")


def caption_chunks(captions: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id of chunks that are hardly more than a caption (captions: doc_id, caption; of figures and tables).

    Chunks that equal a caption meet it by its key; only the others are compared by likeness, document by document."""
    keys = captions.select("doc_id", key_of("caption").alias("key")).where("key != ''").distinct()
    both = chunks.select("doc_id", "chunk_id", "content", "title", F.explode(F.array(key_of(F.col("content")), key_of(F.col("title")))).alias("key"))
    same = both.join(keys, ["doc_id", "key"], "left_semi").select("doc_id", "chunk_id").distinct()
    rest = chunks.select("doc_id", "chunk_id", "content", "title").join(same, ["doc_id", "chunk_id"], "left_anti")

    def run(key: tuple, k: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows, keys = c.to_dict("records"), k["key"].tolist()
        found = [(key[0], r["chunk_id"]) for r in rows if any(echoes(r, y) for y in keys)]
        return pd.DataFrame(found, columns=["doc_id", "chunk_id"])

    near = keys.groupBy("doc_id").cogroup(_other(rest)).applyInPandas(run, "doc_id bigint, chunk_id string")
    return same.unionByName(near)


# -- fidelity to a source -----------------------------------------------------------------------------------------


#: Where a segment of a token starts or ends: at its ends and separators, where case or digits change, and before the
#: last capital of several.
BOUNDARY = re.compile(r"\A|\Z|(?<=[._-])|(?=[._-])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?![0-9])|(?<![0-9])(?=[0-9])")


def stem_of(token: str, v: str) -> bool:
    """Whether the token is a run of whole segments of v."""
    edges = {m.start() for m in BOUNDARY.finditer(v)}
    return any({m.start(), m.start() + len(token)} <= edges for m in re.finditer(f"(?={re.escape(token)})", v))


def without_stems(unknown: DataFrame, source: DataFrame) -> DataFrame:
    """Unknown tokens (doc_id, token) that are no stem of a source token of their document."""

    def run(key: tuple, u: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        words = s["token"].tolist()
        joined = "\0".join(words)  # most tokens are in no word at all, which one search tells
        keep = [t for t in u["token"] if t not in joined or not any(stem_of(t, v) for v in words if t in v)]
        return pd.DataFrame({"doc_id": [key[0]] * len(keep), "token": keep})

    return unknown.groupBy("doc_id").cogroup(_other(source)).applyInPandas(run, "doc_id bigint, token string")


def corrected(text: str, fixes: dict[str, str]) -> str:
    """Whole tokens replaced, the longest first; never inside a longer token."""
    if not fixes:
        return text
    any_of = "|".join(re.escape(t) for t in sorted(fixes, key=len, reverse=True))
    return re.sub(rf"(?<![A-Za-z0-9._\-])({any_of})(?![A-Za-z0-9._\-])", lambda m: fixes[m[1]], text)


def correctable(cls: str, token: str, case_only: bool) -> bool:
    """Case is always put right, identifiers are, codes unless they are numbers, acronyms never."""
    return case_only or cls == "ident" or cls == "code" and not re.fullmatch(r"[0-9]+(?:[.,\-][0-9]+)*", token)


def nearest_fixes(nearest: DataFrame) -> DataFrame:
    """doc_id, token, closest of nearest_tokens() where one source token is nearest and correctable() allows it."""
    cls = token_class(F.col("token"))
    number = F.col("token").rlike(r"^[0-9]+(?:[.,\-][0-9]+)*$")
    return nearest.where(~F.col("ambiguous") & ((cls == "ident") | (cls == "code") & ~number)).select("doc_id", "token", "closest")


def correct_fields(fields: DataFrame, fixes: DataFrame) -> DataFrame:
    """fields: doc_id, where, text; fixes: doc_id, token, closest. Every field of a document gets the same fixes."""

    def run(key: tuple, f: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        table = dict(zip(x["token"], x["closest"], strict=True))
        return f.assign(text=[corrected(t, table) for t in f["text"]])[["doc_id", "where", "text"]]

    return fields.groupBy("doc_id").cogroup(_other(fixes)).applyInPandas(run, "doc_id bigint, where string, text string")
