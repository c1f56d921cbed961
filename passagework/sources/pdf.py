"""Text of PDF pages: enough of the format for files that carry a text layer.

Objects are found by scanning, so a damaged cross-reference table doesn't matter; object streams and Flate streams are
opened, fonts' ToUnicode maps applied. Text is in the order of the page's operators.
"""

from __future__ import annotations

import re
import zlib

from ..schema import Limits

SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Refused(Exception):
    """The file gives no text; ``reason`` is a code of ``schema.REASONS``."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class Name(str):
    pass


class Ref(int):
    pass


class Operator(bytes):
    pass


class Reader:
    """Values of a byte string, one after the other: numbers, names, strings, arrays, dictionaries, references."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            c = data[self.at]
            if c in SPACE:
                self.at += 1
            elif c == 37:
                ends = [x for x in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if x >= 0]
                self.at = min(ends, default=len(data))
            else:
                return

    def value(self, depth: int = 0):
        """The next value; None at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data) or depth > 100:
            self.at = len(data)
            return None
        c = data[at : at + 1]
        if data[at : at + 2] == b"<<":
            self.at += 2
            return self.dictionary(depth)
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self.string()
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(data) or data[self.at] == 93:
                    self.at += 1
                    return out
                self.push(out, self.value(depth + 1))
        if c == b"/":
            found = _TOKEN.match(data, at + 1)
            self.at = found.end() if found else at + 1
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), found[0].decode("latin-1")) if found else "")
        found = _TOKEN.match(data, at)
        if not found:
            self.at = at + 1
            return Operator(c)
        self.at = found.end()
        try:
            return float(found[0]) if b"." in found[0] else int(found[0])
        except ValueError:
            return Operator(found[0])

    @staticmethod
    def push(out: list, value) -> None:
        """``n g R`` becomes a reference."""
        if isinstance(value, Operator) and value == b"R" and len(out) >= 2 and isinstance(out[-2], int):
            out[-2:] = [Ref(out[-2])]
        else:
            out.append(value)

    def dictionary(self, depth: int) -> dict:
        out: list = []
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return {k: v for k, v in zip(out[::2], out[1::2], strict=False) if isinstance(k, Name)}
            self.push(out, self.value(depth + 1))

    def string(self) -> bytes:
        data, out, open_ = self.data, bytearray(), 1
        at = self.at + 1
        while at < len(data) and open_:
            c = data[at]
            at += 1
            if c == 92 and at < len(data):
                e = data[at]
                at += 1
                if digits := re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2]):
                    out.append(int(digits[0], 8) & 255)
                    at += len(digits[0]) - 1
                elif e == 13:
                    at += data[at : at + 1] == b"\n"
                elif e != 10:
                    out.append(_ESCAPES.get(e, e))
                continue
            open_ += (c == 40) - (c == 41)
            if open_:
                out.append(c)
        self.at = at
        return bytes(out)


class Document:
    def __init__(self, data: bytes, most: int):
        self.most, self.objects, self.streams = most, {}, {}
        for found in _OBJECT.finditer(data):
            number, reader = int(found[1]), Reader(data, found.end())
            self.objects[number] = reader.value()
            reader.skip()
            if isinstance(self.objects[number], dict) and data.startswith(b"stream", reader.at):
                begin = reader.at + 6
                begin += 2 if data.startswith(b"\r\n", begin) else 1
                size = self.get(self.objects[number].get("Length"))
                end = begin + size if isinstance(size, int) and re.match(rb"\s*endstream", data[begin + size : begin + size + 20]) else data.find(b"endstream", begin)
                self.streams[number] = data[begin : end if end >= 0 else len(data)]
        for number in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            body, head = self.stream(number), self.objects[number]
            first, count = self.get(head.get("First")) or 0, self.get(head.get("N")) or 0
            reader = Reader(body[:first])
            for _ in range(min(count, 100_000)):
                inner, offset = reader.value(), reader.value()
                if isinstance(inner, int) and isinstance(offset, int):
                    self.objects.setdefault(inner, Reader(body, first + offset).value())

    def get(self, value, depth: int = 0):
        return self.get(self.objects.get(int(value)), depth + 1) if isinstance(value, Ref) and depth < 20 else value

    def stream(self, number: int) -> bytes:
        raw = self.streams.get(number, b"")
        filters = self.get(self.objects[number].get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(name) not in ("FlateDecode", "Fl"):
                return b""
            opened = zlib.decompressobj()
            try:
                raw = opened.decompress(raw, self.most + 1)
            except zlib.error as fault:
                raise Refused("damaged") from fault
            if len(raw) > self.most:
                raise Refused("too-large")
        return raw

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with the resources they inherit."""
        roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        out: list[dict] = []
        seen: set[int] = set()

        def below(node, resources) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or id(node) in seen:
                return
            seen.add(id(node))
            resources = self.get(node.get("Resources")) or resources
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    below(kid, resources)
            elif node.get("Type") == "Page":
                out.append(node | {"Resources": resources})

        for root in roots[-1:]:
            below(root.get("Pages"), {})
        if not out:
            out = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Page"]
        return out

    def maps(self, resources) -> dict[str, tuple[int, dict[int, str]]]:
        """Of each font with a ToUnicode map, by name: bytes of a code, and the text of each code."""
        out = {}
        fonts = self.get((self.get(resources) or {}).get("Font")) or {}
        for name, font in fonts.items():
            number = (self.get(font) or {}).get("ToUnicode")
            if isinstance(number, Ref) and int(number) in self.streams:
                out[name] = unicode_map(self.stream(int(number)))
        return out

    def text(self, page: dict) -> str:
        contents = page.get("Contents")
        several = contents if isinstance(contents, list) else self.get(contents) if isinstance(self.get(contents), list) else [contents]
        body = b"\n".join(self.stream(int(c)) for c in several if isinstance(c, Ref) and isinstance(self.get(c), dict))
        return shown(body, self.maps(page.get("Resources")))


def unicode_map(body: bytes) -> tuple[int, dict[int, str]]:
    table: dict[int, str] = {}
    width, reader, held = 1, Reader(body), []
    text = lambda b: b.decode("utf-16-be", "replace")
    while (value := reader.value()) is not None:
        if not isinstance(value, Operator):
            held.append(value)
            continue
        if value == b"endcodespacerange" and held and isinstance(held[0], bytes):
            width = max(1, len(held[0]))
        elif value == b"endbfchar":
            table.update((int.from_bytes(a), text(b)) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes))
        elif value == b"endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                first = int.from_bytes(a)
                for i in range(min(int.from_bytes(b) - first + 1, 65_536)):
                    if isinstance(c, list):
                        if i < len(c):
                            table[first + i] = text(c[i])
                    elif c:
                        table[first + i] = text((int.from_bytes(c) + i).to_bytes(len(c)))
        held = []
    return width, table


def shown(body: bytes, maps: dict[str, tuple[int, dict[int, str]]]) -> str:
    """Text that a content stream shows; moves of the line give line ends, wide gaps spaces."""
    out: list[str] = []
    reader, held, font = Reader(body), [], None

    def put(value: bytes) -> None:
        if font in maps:
            width, table = maps[font]
            out.append("".join(table.get(int.from_bytes(value[i : i + width]), "") for i in range(0, len(value), width)))
        else:
            out.append(value[2:].decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else value.decode("cp1252", "replace"))

    while (value := reader.value()) is not None:
        if not isinstance(value, Operator):
            held.append(value)
            continue
        if value == b"Tf" and held and isinstance(held[0], Name):
            font = held[0]
        elif value in (b"T*", b"'", b'"', b"ET") or (value in (b"Td", b"TD") and len(held) > 1 and held[-1]) or value == b"Tm":
            if out and not out[-1].endswith("\n"):
                out.append("\n")
        elif value in (b"Td", b"TD") and held and held[0] and out and not out[-1].endswith((" ", "\n")):
            out.append(" ")
        if value in (b"Tj", b"'", b'"') and held and isinstance(held[-1], bytes):
            put(held[-1])
        elif value == b"TJ" and held and isinstance(held[-1], list):
            for part in held[-1]:
                if isinstance(part, bytes):
                    put(part)
                elif isinstance(part, (int, float)) and part < -200 and out and not out[-1].endswith(" "):
                    out.append(" ")
        elif value == b"BI":
            end = body.find(b"EI", reader.at)
            reader.at = len(body) if end < 0 else end + 2
        held = []
    return "".join(out).strip("\n")


def pages(data: bytes, limits: Limits) -> list[str]:
    """The text of each page in order; one that can't be read is empty, so that numbers hold."""
    if b"%PDF-" not in data[:1024]:
        raise Refused("damaged")
    if re.search(rb"/Encrypt[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R|/Encrypt[\x00\t\n\x0c\r ]*<<", data):
        raise Refused("encrypted")
    document = Document(data, limits.max_text_bytes * 4)
    found = document.pages()
    if not found:
        raise Refused("damaged")
    if len(found) > limits.max_pages:
        raise Refused("too-large")
    texts, size = [], 0
    for page in found:
        try:
            text = document.text(page)
        except Refused as refused:
            if refused.reason == "too-large":
                raise
            text = ""
        except (ValueError, TypeError, AttributeError, OverflowError, KeyError):
            text = ""
        size += len(text.encode("utf-8", "replace"))
        if size > limits.max_text_bytes:
            raise Refused("too-large")
        texts.append(text)
    return texts


def write(pages_: list[str], compressed: bool = True) -> bytes:
    """A PDF with one string on each page, for tests and trials; an empty page has no text, like a scan."""
    bodies: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for text in pages_:
        shown_ = re.sub(rb"([()\\])", rb"\\\1", text.encode("cp1252", "replace"))
        content = b"BT /F1 12 Tf 72 720 Td (" + shown_ + b") Tj ET" if text else b""
        content = zlib.compress(content) if compressed else content
        bodies.append(b"<< /Length %d%s >>\nstream\n" % (len(content), b" /Filter /FlateDecode" if compressed else b"") + content + b"\nendstream")
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(bodies))
        kids.append(b"%d 0 R" % len(bodies))
    bodies[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))
