"""Outlook messages (.msg): a reader of the compound file format, and the message properties in it."""

from __future__ import annotations

import datetime as dt
import struct

from folia.functions import html_text

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Property ids, and codecs of code pages that Python names otherwise.
SUBJECT, BODY, HTML, SENDER, SENDER_MAIL, TO, CC = 0x0037, 0x1000, 0x1013, 0x0C1A, 0x0C1F, 0x0E04, 0x0E03
SUBMITTED, DELIVERED, LONG_NAME, SHORT_NAME = 0x0039, 0x0E06, 0x3707, 0x3704
INTERNET_PAGE, MESSAGE_PAGE = 0x3FDE, 0x3FFD
CODECS = {65001: "utf-8", 20127: "ascii", 28591: "latin-1", 28605: "iso8859-15", 932: "cp932", 936: "gbk", 949: "cp949", 950: "big5", 50220: "iso2022_jp", 51932: "euc_jp"}


class CompoundFile:
    """Streams of a compound file by path, as bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("no compound file")
        self.raw = raw
        shift, mini_shift = struct.unpack_from("<HH", raw, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        root, _, self.cutoff, mini_at, _, di_at, _ = struct.unpack_from("<IIIIIII", raw, 48)
        fat_at = [s for s in struct.unpack_from("<109I", raw, 76) if s < END]
        while di_at < END:
            more = struct.unpack_from(f"<{self.size // 4}I", raw, self._place(di_at))
            fat_at += [s for s in more[:-1] if s < END]
            di_at = more[-1]
        self.fat = [x for s in fat_at for x in struct.unpack_from(f"<{self.size // 4}I", raw, self._place(s))]
        table = self._chain(mini_at) if mini_at < END else b""
        self.mini_fat = struct.unpack(f"<{len(table) // 4}I", table)
        names = self._chain(root)
        self.entries = [names[k : k + 128] for k in range(0, len(names) - 127, 128)]
        first, size = struct.unpack_from("<IQ", self.entries[0], 116)
        self.mini = self._chain(first)[:size] if first < END else b""
        self.streams: dict[str, bytes] = {}
        self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "", set())

    def _place(self, sector: int) -> int:
        return (sector + 1) * self.size

    def _chain(self, at: int) -> bytes:
        out, met = [], set()
        while at < END and at not in met and at < len(self.fat):
            met.add(at)
            out.append(self.raw[self._place(at) : self._place(at) + self.size])
            at = self.fat[at]
        return b"".join(out)

    def _content(self, at: int, size: int) -> bytes:
        if size >= self.cutoff:
            return self._chain(at)[:size]
        out, met = [], set()
        while at < END and at not in met and at < len(self.mini_fat):
            met.add(at)
            out.append(self.mini[at * self.mini_size : (at + 1) * self.mini_size])
            at = self.mini_fat[at]
        return b"".join(out)[:size]

    def _walk(self, top: int, path: str, met: set[int]) -> None:
        waiting = [(top, path)]
        while waiting:
            k, path = waiting.pop()
            if k >= len(self.entries) or k in met:
                continue
            met.add(k)
            e = self.entries[k]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<III", e, 68)
            name = path + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            waiting += [(left, path), (right, path)]
            if kind == 1:
                waiting.append((child, name + "/"))
            elif kind == 2:
                self.streams[name] = self._content(*struct.unpack_from("<IQ", e, 116))


def stream_id(name: str) -> tuple[int, int] | None:
    """(property id, type) of a stream name like __substg1.0_0037001F."""
    tail = name.rpartition("__substg1.0_")[2]
    try:
        return (int(tail[:4], 16), int(tail[4:8], 16)) if len(tail) >= 8 and "__substg1.0_" in name else None
    except ValueError:
        return None


def filetime(ticks: int) -> str | None:
    """ISO time of a count of 100 ns since 1601; None for 0 or one out of range."""
    try:
        return (dt.datetime(1601, 1, 1) + dt.timedelta(microseconds=ticks // 10)).isoformat(timespec="seconds") if ticks else None
    except OverflowError:
        return None


class Message:
    """Properties by scope: "" is the message, others are its attachments and recipients."""

    def __init__(self, streams: dict[str, bytes]):
        self.scopes: dict[str, dict[tuple[int, int], bytes]] = {"": {}}
        self.fixed: dict[int, bytes] = {}
        for path, data in streams.items():
            scope, _, name = path.rpartition("/")
            if "/" not in scope and (key := stream_id(name)):
                self.scopes.setdefault(scope, {})[key] = data
            if path == "__properties_version1.0":
                for k in range(32, len(data) - 15, 16):
                    kind, prop = struct.unpack_from("<HH", data, k)
                    self.fixed.setdefault(prop, data[k + 8 : k + 16])
        page = next((struct.unpack_from("<I", self.fixed[p])[0] for p in (INTERNET_PAGE, MESSAGE_PAGE) if p in self.fixed), 1252)
        self.codec = CODECS.get(page, f"cp{page}")
        try:
            "".encode(self.codec)
        except LookupError:
            self.codec = "cp1252"

    def text(self, prop: int, scope: str = "") -> str | None:
        """The Unicode form if there is one, else the code page's."""
        held = self.scopes.get(scope, {})
        if (prop, 0x001F) in held:
            return held[prop, 0x001F].decode("utf-16-le", "replace").rstrip("\0")
        raw = held.get((prop, 0x001E))
        return None if raw is None else raw.decode(self.codec, "replace").rstrip("\0")

    def when(self) -> str | None:
        return next((filetime(struct.unpack("<Q", self.fixed[p])[0]) for p in (SUBMITTED, DELIVERED) if p in self.fixed), None)

    def attachments(self) -> list[str]:
        names = sorted(s for s in self.scopes if s.startswith("__attach"))
        return [self.text(LONG_NAME, s) or self.text(SHORT_NAME, s) or "unnamed" for s in names]

    def markdown(self) -> str:
        from folia.sources.mail import preamble

        sender = " ".join(filter(None, [self.text(SENDER), f"<{m}>" if (m := self.text(SENDER_MAIL)) else None]))
        head = preamble({"Subject": self.text(SUBJECT), "From": sender, "To": self.text(TO), "Cc": self.text(CC), "Date": self.when()}, self.attachments())
        body = self.text(BODY)
        if not (body or "").strip():
            raw = self.scopes[""].get((HTML, 0x0102))
            body = html_text.markdown(raw.decode(self.codec, "replace") if raw else self.text(HTML) or "")
        return f"{head}\n\n{body.strip()}".strip()


def msg_markdown(raw: bytes) -> str:
    return Message(CompoundFile(raw).streams).markdown()
