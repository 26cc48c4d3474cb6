"""HTML to Markdown and to flat text, from markup of any quality, with the standard library's parser."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

HEADS = {f"h{k}": k for k in range(1, 7)}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "ul", "ol", "table", "blockquote", "tr", "nav", *HEADS}


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0

    def _break(self, n: int = 2) -> None:
        text = "".join(self.out).rstrip(" ")
        missing = n - (len(text) - len(text.rstrip("\n"))) if text else 0
        self.out = [text + "\n" * max(0, missing)] if text else []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif tag in HEADS:
            self._break()
            self.out.append("#" * HEADS[tag] + " ")
        elif tag in ("ul", "ol"):
            self._break(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self._break(1)
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("  " * (len(self.lists) - 1) + ("* " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "br":
            self.out.append("  \n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "pre":
            self._break()
            self.out.append("```\n")
            self.pre += 1
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag in BLOCKS:
            self._break(1 if tag == "tr" else 2)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._break(1 if self.lists else 2)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```")
            self._break()
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag in BLOCKS:
            self._break(1 if tag == "tr" else 2)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown(html: str) -> str:
    """Headings, lists, emphasis, links and paragraphs; scripts, styles and their like go."""
    p = _Markdown()
    p.feed(html or "")
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


MARKUP = re.compile(r"<(?:html|body|div|p|br|table|h[1-6]|span|ul|ol|a)\b[^>]*>", re.I)


def markdown_if_html(text: str) -> str:
    return markdown(text) if MARKUP.search(text or "") else text


class Rows(HTMLParser):
    """The rows of all tables in a text: lists of (cell text, is a header), and the place of each row's markup."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.open: list[list | None] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.open.append(None)
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(["", tag == "th"])
            self.open.append(self.rows[-1][-1])

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr") and self.open:
            while self.open and self.open[-1] is not None and tag == "tr":
                self.open.pop()
            self.open.pop() if self.open else None

    def handle_data(self, data):
        if self.open and self.open[-1] is not None:
            self.open[-1][0] += data


#: Tables of which a worker remembers what it has read: continued ones and forms come again and again.
KNOWN = 1024


def collapsed(s: str) -> str:
    return re.sub(r"\s+", " ", s or "").strip()


@lru_cache(KNOWN)
def flat_table(html: str, caption: str | None = None) -> str:
    """The caption, then a line a row with its cells between bars."""
    head = [collapsed(caption)] if caption else []
    return "\n".join(head + [" | ".join(collapsed(c[0]) for c in row) for row in Rows(html).rows])


@lru_cache(KNOWN)
def widest_row(html: str) -> int:
    return max((len(r) for r in Rows(html).rows), default=0)


ROW = re.compile(r"<tr\b.*?</tr\s*>", re.S | re.I)


def row_text(row: str) -> str:
    return collapsed(re.sub(r"<[^>]*>", "", row)).lower()


def appended(first: str, second: str) -> str:
    """The first table with the second's rows at its end, less a header that they repeat."""
    mine, more = ROW.findall(first or ""), ROW.findall(second or "")
    if not re.search(r"<table\b", first or "", re.I) or not more:
        return first or ""
    if mine and row_text(mine[0]) == row_text(more[0]):
        more = more[1:]
    ends = list(re.finditer(r"</tbody\s*>", first, re.I))[:1] or list(re.finditer(r"</table\s*>", first, re.I))[:1]
    at = ends[0].start() if ends else len(first)
    return first[:at] + "".join(more) + first[at:]


def with_header(first: str, second: str) -> str:
    """The second table under the first's header row, if that has one and the second does not repeat it."""
    mine, more = ROW.findall(first or ""), ROW.findall(second or "")
    if not mine or not more or not re.search(r"<th\b", mine[0], re.I) or row_text(mine[0]) == row_text(more[0]):
        return second or ""
    return second.replace(more[0], mine[0] + more[0], 1)
