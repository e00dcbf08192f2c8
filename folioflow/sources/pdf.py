"""Text spans and page sizes of PDF files, after the published format; no library is needed.

Read are plain and compressed objects, object streams, FlateDecode contents, the text operators and fonts with a
ToUnicode map (others count as Latin-1). Widths are estimated from the font size, since glyph widths of the standard fonts
aren't in the file. Encrypted files raise. Coordinates run from the top left of the page.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Width of a character as a share of the font size.
WIDTH, ASCENT, DESCENT = 0.5, 0.8, 0.2
_SPACE = b" \t\r\n\x0c\x00"
_DELIMITERS = b"()<>[]{}/%" + _SPACE
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name such as /Type."""


class Reference(int):
    """The number of another object."""


@dataclass
class Stream:
    head: dict
    data: bytes

    def decoded(self) -> bytes:
        filters = self.head.get("Filter", [])
        for name in filters if isinstance(filters, list) else [filters]:
            if name != "FlateDecode" or self.head.get("DecodeParms"):
                raise ValueError(f"streams with {name} aren't read")
        return zlib.decompressobj().decompress(self.data) if filters else self.data


class Operator(bytes):
    """A word of a content stream."""


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Objects and operators one after another, each with where it ends."""
    n = len(data)
    while at < n:
        c = data[at : at + 1]
        if c in _SPACE and c:
            at += 1
        elif c == b"%":
            at = min((x for x in (data.find(b"\n", at), data.find(b"\r", at)) if x >= 0), default=n)
        elif c == b"(":
            value, at = _literal(data, at + 1)
            yield value, at
        elif data[at : at + 2] in (b"<<", b">>"):
            at += 2
            yield Operator(data[at - 2 : at]), at
        elif c == b"<":
            end = data.index(b">", at)
            digits = re.sub(rb"\s", b"", data[at + 1 : end])
            at = end + 1
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif c in b"[]{})>":
            at += 1
            yield Operator(c), at
        else:
            end = at + 1
            while end < n and data[end] not in _DELIMITERS:
                end += 1
            word, at = data[at:end], end
            if c == b"/":
                yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word[1:]).decode("latin-1")), at
            elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
                yield (float(word) if b"." in word else int(word)), at
            else:
                yield Operator(word), at


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    for m in re.finditer(rb"\\(\d{1,3}|\r\n|[\s\S])|([()])|[^\\()]+", data[at:]):
        if m[1] is not None:
            out += bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in (b"\r\n", b"\n", b"\r") else _ESCAPES.get(m[1], m[1])
            continue
        depth += (m[2] == b"(") - (m[2] == b")")
        if not depth:
            return bytes(out), at + m.end()
        out += m[0]
    raise ValueError("a string has no end")


def parsed(data: bytes, at: int = 0) -> tuple[object, int]:
    """The object that begins at ``at``, with dictionaries, arrays and references put together, and where it ends."""
    stack: list[list] = [[]]
    opened = []
    for value, end in tokens(data, at):
        if value in (b"<<", b"[") and isinstance(value, Operator):
            opened.append(value)
            stack.append([])
            continue
        if value in (b">>", b"]") and isinstance(value, Operator):
            items = stack.pop()
            value = dict(zip(items[::2], items[1::2], strict=False)) if opened.pop() == b"<<" else items
        elif isinstance(value, Operator):
            if value == b"R" and len(stack[-1]) > 1:
                number = stack[-1][-2]
                del stack[-1][-2:]
                value = Reference(number)
            elif value in (b"true", b"false", b"null"):
                value = {b"true": True, b"false": False}.get(bytes(value))
            else:
                return (stack[0][0] if stack[0] else None), end - len(value)
        stack[-1].append(value)
        if len(stack) == 1 and not isinstance(value, int):
            return value, end
    return (stack[0][0] if stack[0] else None), len(data)


class File:
    """The objects of a file; of two with one number the later holds."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF file")
        self.objects: dict[int, object] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            value, end = parsed(data, m.end())
            begin = re.compile(rb"\s*stream\r?\n").match(data, end)
            if begin and isinstance(value, dict):
                length = value.get("Length")
                stop = begin.end() + length if isinstance(length, int) and not isinstance(length, Reference) else data.index(b"endstream", begin.end())
                value = Stream(value, data[begin.end() : stop])
            self.objects[int(m[1])] = value
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted files aren't read")
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.head.get("Type") == "ObjStm":
                held = value.decoded()
                numbers = [int(x) for x in held[: value.head["First"]].split()]
                for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
                    self.objects.setdefault(number, parsed(held, value.head["First"] + offset)[0])

    def get(self, value):
        """What a value stands for."""
        while isinstance(value, Reference):
            value = self.objects.get(int(value))
        return value

    def pages(self) -> list[dict]:
        """The pages in order, each with what it inherits."""
        catalog = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if catalog is None:
            raise ValueError("the file has no catalog")
        found, todo, seen = [], [(catalog.get("Pages"), {})], set()
        while todo:
            reference, above = todo.pop()
            node = self.get(reference)
            if not isinstance(node, dict) or (isinstance(reference, Reference) and reference in seen):
                continue
            seen.add(reference if isinstance(reference, Reference) else None)
            node = above | node
            if "Kids" in node:
                passed = {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}
                todo += [(kid, passed) for kid in reversed(self.get(node["Kids"]) or [])]
            else:
                found.append(node)
        return found


@dataclass
class Font:
    """How a font's codes become text."""

    wide: bool = False
    unicode: dict[int, str] = field(default_factory=dict)

    def text(self, codes: bytes) -> str:
        step = 2 if self.wide else 1
        numbers = [int.from_bytes(codes[i : i + step], "big") for i in range(0, len(codes), step)]
        return "".join(self.unicode.get(n, "" if self.wide else bytes([n]).decode("latin-1")) for n in numbers)


def _font(file: File, held) -> Font:
    held = file.get(held) or {}
    made = Font(wide=held.get("Subtype") == "Type0")
    table = file.get(held.get("ToUnicode"))
    if isinstance(table, Stream):
        stack, within = [], None
        told = lambda x: x.decode("utf-16-be", "replace")
        for value, _ in tokens(table.decoded()):
            if value in (b"beginbfchar", b"beginbfrange"):
                stack, within = [], value
            elif value in (b"endbfchar", b"endbfrange"):
                within = None
            elif within and isinstance(value, bytes) and not isinstance(value, Operator):
                stack.append(value)
                if within == b"beginbfchar" and len(stack) == 2:
                    made.unicode[int.from_bytes(stack[0], "big")] = told(stack[1])
                    stack = []
                elif within == b"beginbfrange" and len(stack) == 3:
                    first, last, start = (int.from_bytes(x, "big") for x in stack)
                    made.unicode.update((first + i, told((start + i).to_bytes(len(stack[2]), "big"))) for i in range(min(last - first, 65535) + 1))
                    stack = []
    return made


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def page_spans(file: File, page: dict) -> tuple[float, float, list[tuple]]:
    """Width, height, and (block, line, span, text, x0, y0, x1, y1) of a page: a block is a text object, a line what stands at one height in it."""
    box = [float(file.get(x)) for x in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
    fonts = {k: _font(file, v) for k, v in (file.get((file.get(page.get("Resources")) or {}).get("Font")) or {}).items()}
    contents = file.get(page.get("Contents"))
    streams = [file.get(x) for x in contents] if isinstance(contents, list) else [contents]
    data = b"\n".join(x.decoded() for x in streams if isinstance(x, Stream))
    found: list[tuple] = []
    stack: list = []
    font, size, leading, matrix, line_matrix, graphics, saved, block = Font(), 0.0, 0.0, _ONE, _ONE, _ONE, [], -1
    lines: dict[tuple[int, float], int] = {}
    number = lambda i: float(stack[i]) if isinstance(stack[i], int | float) else 0.0

    def show(codes: bytes) -> None:
        nonlocal matrix
        text = font.text(codes)
        a, b, c, d, x, y = _times(matrix, graphics)
        height, width = size * abs(d or b), size * WIDTH * len(text) * abs(a or c)
        line = lines.setdefault((block, round(y, 1)), len(lines))
        if text:
            found.append((block, line, len(found), text, x - box[0], box[3] - y - ASCENT * height, x - box[0] + width, box[3] - y + DESCENT * height))
        matrix = _times((1, 0, 0, 1, size * WIDTH * len(text), 0), matrix)

    def move(x: float, y: float) -> None:
        nonlocal matrix, line_matrix
        matrix = line_matrix = _times((1, 0, 0, 1, x, y), line_matrix)

    array: list | None = None
    for value, _ in tokens(data):
        if not isinstance(value, Operator):
            (stack if array is None else array).append(value)
            continue
        word = bytes(value)
        if word == b"[":
            array = []
            continue
        if word == b"]":
            stack.append(array or [])
            array = None
            continue
        if word == b"BT":
            matrix, line_matrix, block = _ONE, _ONE, block + 1
        elif word == b"q":
            saved.append(graphics)
        elif word == b"Q" and saved:
            graphics = saved.pop()
        elif word == b"cm" and len(stack) >= 6:
            graphics = _times(tuple(number(i) for i in range(-6, 0)), graphics)
        elif word == b"Tf" and len(stack) >= 2:
            font, size = fonts.get(stack[-2], Font()), number(-1)
        elif word == b"TL" and stack:
            leading = number(-1)
        elif word in (b"Td", b"TD") and len(stack) >= 2:
            leading = -number(-1) if word == b"TD" else leading
            move(number(-2), number(-1))
        elif word == b"Tm" and len(stack) >= 6:
            matrix = line_matrix = tuple(number(i) for i in range(-6, 0))
        elif word == b"T*":
            move(0, -leading)
        elif word in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            if word != b"Tj":
                move(0, -leading)
            show(stack[-1])
        elif word == b"TJ" and stack and isinstance(stack[-1], list):
            for part in stack[-1]:
                if isinstance(part, bytes):
                    show(part)
                elif isinstance(part, int | float):
                    matrix = _times((1, 0, 0, 1, -part / 1000 * size, 0), matrix)
        stack = []
    return box[2] - box[0], box[3] - box[1], found


def read(content: bytes) -> list[tuple[float, float, list[tuple]]]:
    """``page_spans`` of all pages of a file."""
    file = File(content)
    return [page_spans(file, page) for page in file.pages()]


def page_text(spans: list[tuple]) -> str:
    """The text of a page's lines, from top to bottom."""
    lines: dict[int, list[tuple]] = {}
    for span in spans:
        lines.setdefault(span[1], []).append(span)
    ordered = sorted(lines.values(), key=lambda line: (min(s[5] for s in line), min(s[4] for s in line)))
    return "\n".join("".join(s[3] for s in line) for line in ordered)
