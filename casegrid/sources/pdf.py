"""Text of the pages of a PDF file: objects, compressed streams, fonts' maps to Unicode, and the operators that show text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

WHITE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
#: The escapes of a literal string.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name object, without its slash."""


class Ref(int):
    """A reference to an object, by its number."""


class Word(bytes):
    """An operator or keyword."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose first byte is at ``at``, and the place after it."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(raw, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            elif raw[at : at + 2] == b"\r\n":
                at += 2
            else:
                d = raw[at : at + 1]
                out += b"" if d in (b"\n", b"\r") else ESCAPES.get(d, d)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def values(raw: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The objects written in ``raw`` from ``at`` on, each with the place after it: numbers, names, strings (bytes), lists, dicts,
    references and words."""
    stack: list[list] = [[]]
    token = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
    closed: list[int] = []
    while at < len(raw):
        c = raw[at : at + 1]
        value: object = None
        if c in WHITE and c:
            at += 1
            continue
        if c == b"%":
            at = min((x for x in (raw.find(b"\n", at), raw.find(b"\r", at)) if x >= 0), default=len(raw))
            continue
        if c == b"(":
            value, at = _string(raw, at + 1)
        elif raw[at : at + 2] == b"<<" or c == b"[":
            stack.append([])
            closed.append(ord(c))
            at += 2 if c == b"<" else 1
            continue
        elif raw[at : at + 2] == b">>" or c == b"]":
            at += 2 if c == b">" else 1
            if len(stack) == 1:
                continue
            inner = stack.pop()
            kind = closed.pop()
            value = dict(zip((str(k) for k in inner[::2]), inner[1::2])) if kind == ord("<") else inner
        elif c == b"<":
            end = raw.find(b">", at)
            end = len(raw) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw[at + 1 : end])
            value, at = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
        elif c == b"/":
            found = token.match(raw, at + 1)
            name = found[0] if found else b""
            value, at = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), name).decode("latin-1")), at + 1 + len(name)
        elif found := token.match(raw, at):
            word, at = found[0], found.end()
            if re.fullmatch(rb"[+-]?\d+", word):
                value = int(word)
            elif re.fullmatch(rb"[+-]?\d*\.\d*", word) and word.strip(b"+-.") != b"":
                value = float(word)
            elif word == b"R" and len(stack[-1]) >= 2 and isinstance(stack[-1][-2], int):
                stack[-1].pop()
                value = Ref(stack[-1].pop())
            else:
                value = {b"true": True, b"false": False, b"null": None}.get(word, Word(word))
        else:
            at += 1
            continue
        if len(stack) == 1 and not isinstance(value, Ref):
            yield value, at
        stack[-1].append(value)
        if len(stack) == 1:
            del stack[0][:-2]


def _unpredicted(data: bytes, how: dict) -> bytes:
    """Rows that were written as differences from their neighbours (PNG filters)."""
    if how.get("Predictor", 1) < 10:
        return data
    bpp = max(1, how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
    width = (how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) + 7) // 8
    out, up = bytearray(), bytearray(width)
    for k in range(0, len(data), width + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        for i in range(len(row)):
            a, b, c = (row[i - bpp] if i >= bpp else 0), up[i], (up[i - bpp] if i >= bpp else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[i] = (row[i] + (0, a, b, (a + b) // 2, nearest)[kind if kind < 5 else 0]) & 255
        out += row
        up = row + bytearray(width - len(row))
    return bytes(out)


class Document:
    """The objects of a file.  They are found by their headers, so a damaged cross-reference table does not matter; of objects with
    one number the last counts, as after an update of the file."""

    def __init__(self, raw: bytes) -> None:
        if not raw.lstrip().startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s", raw):
            raise ValueError("the PDF file is encrypted")
        self.raw, self.at, self.packed = raw, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", raw):
            self.at[int(m[1])] = m.end()
        for n in [*self.at]:
            head = self.object(n)
            if isinstance(head, dict) and head.get("Type") == "ObjStm":
                data = self.stream(n)
                first = self.get(head["First"])
                numbers = [v for v, _ in values(data[:first]) if isinstance(v, int)]
                self.packed |= {k: data[first + o :] for k, o in zip(numbers[::2], numbers[1::2]) if k not in self.at}

    def object(self, n: int) -> object:
        if n in self.packed:
            return next((v for v, _ in values(self.packed[n])), None)
        return next((v for v, _ in values(self.raw, self.at[n])), None) if n in self.at else None

    def get(self, x: object) -> object:
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.object(x)
        return None

    def stream(self, n: int) -> bytes:
        """The bytes of a stream object, its filters undone; those of pictures are left as they are."""
        head, at = next(values(self.raw, self.at[n]))
        begin = re.compile(rb"\s*stream\r?\n").match(self.raw, at)
        if not isinstance(head, dict) or not begin:
            return b""
        size = self.get(head.get("Length"))
        end = begin.end() + size if isinstance(size, int) and re.match(rb"\s*endstream", self.raw[begin.end() + size : begin.end() + size + 20]) else self.raw.find(b"endstream", begin.end())
        data = self.raw[begin.end() : end]
        filters, how = self.get(head.get("Filter")) or [], self.get(head.get("DecodeParms")) or {}
        filters, how = ([filters] if isinstance(filters, Name) else filters), (how if isinstance(how, list) else [how])
        for k, f in enumerate(filters):
            if self.get(f) == "FlateDecode":
                data = _unpredicted(zlib.decompressobj().decompress(data), self.get(how[k]) or {} if k < len(how) else {})
            elif self.get(f) == "ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode())
        return data

    def pages(self) -> Iterator[dict]:
        """The pages in order, each with the resources that it inherits."""
        roots = [o for o in map(self.object, sorted({*self.at, *self.packed})) if isinstance(o, dict) and o.get("Type") == "Catalog"]
        todo, seen = [(r.get("Pages"), {}) for r in roots[-1:]], set()
        while todo:
            ref, passed = todo.pop(0)
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            seen.add(ref)
            passed = passed | {k: node[k] for k in ("Resources",) if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                todo = [(k, passed) for k in self.get(node.get("Kids")) or []] + todo
            else:
                yield node | passed


def unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code, of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    size, last = 1, []
    for v, _ in values(cmap):
        if isinstance(v, Word):
            codes = [x for x in last if isinstance(x, (bytes, list)) and not isinstance(x, Word)]
            if v == b"endcodespacerange" and codes:
                size = max(len(x) for x in codes)
            elif v == b"endbfchar":
                out |= {int.from_bytes(a): text(b) for a, b in zip(codes[::2], codes[1::2])}
            elif v == b"endbfrange":
                for a, b, to in zip(codes[::3], codes[1::3], codes[2::3]):
                    for i, code in enumerate(range(int.from_bytes(a), int.from_bytes(b) + 1)):
                        out[code] = text(to[i]) if isinstance(to, list) else text(to[:-2] + (int.from_bytes(to[-2:]) + i).to_bytes(4)[-2:])
            last = []
        else:
            last.append(v)
    return size, out


def _decoded(s: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if not font:
        return s.decode("cp1252", "replace")
    size, table = font
    codes = (int.from_bytes(s[i : i + size]) for i in range(0, len(s), size))
    return "".join(table.get(c, chr(c) if size == 1 else "") for c in codes)


def _shown(content: bytes, fonts: dict[str, tuple[int, dict[int, str]] | None]) -> str:
    """The text that a page's content shows: a new line where the text moves down, a blank where a gap is wider than a fifth of the
    size of a letter."""
    out: list[str] = []
    font, args = None, []

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for v, _ in values(content):
        if not isinstance(v, Word):
            args.append(v)
            continue
        if v == b"Tf" and len(args) >= 2:
            font = fonts.get(str(args[-2]))
        elif v == b"Tj" and args and isinstance(args[-1], bytes):
            out.append(_decoded(args[-1], font))
        elif v in (b"'", b'"') and args and isinstance(args[-1], bytes):
            line()
            out.append(_decoded(args[-1], font))
        elif v == b"TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    out.append(_decoded(x, font))
                elif isinstance(x, (int, float)) and x < -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        elif v in (b"Td", b"TD") and len(args) >= 2:
            if args[-1]:
                line()
            elif args[-2] and out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
        elif v in (b"T*", b"Tm", b"ET"):
            line()
        args = []
    return "".join(out).strip("\n")


def page_texts(raw: bytes) -> list[str]:
    """The text of each page.  Text in pictures, and fonts without a map whose codes are not Latin letters, give none or other letters; an
    encrypted file is an error."""
    doc = Document(raw)
    out = []
    for page in doc.pages():
        resources = doc.get(page.get("Resources")) or {}
        fonts: dict[str, tuple[int, dict[int, str]] | None] = {}
        for name, ref in (doc.get(resources.get("Font")) or {}).items():
            font = doc.get(ref)
            to = font.get("ToUnicode") if isinstance(font, dict) else None
            fonts[name] = unicode_map(doc.stream(to)) if isinstance(to, Ref) and to in doc.at else None
        parts = page.get("Contents")
        parts = parts if isinstance(parts, list) else doc.get(parts) if isinstance(doc.get(parts), list) else [parts]
        out.append(_shown(b"\n".join(doc.stream(p) for p in parts if isinstance(p, Ref) and p in doc.at), fonts))
    return out
