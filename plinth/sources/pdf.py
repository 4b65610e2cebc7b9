"""PDF files as rows of pages: files come as Spark's binary files (from any store), each is read in the task that has it.

Only text is read: the object table, inflated streams, the page tree and the text operators; fonts by their map to
Unicode, else as Windows-1252. A move to another line gives a line end, a wide step back inside a line a space.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import byteorder

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SPACE, _DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(<<|>>|[\[\](<]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+|[>{})])")
_STRING = re.compile(rb"\\([0-7]{1,3}|\r\n|.)|[()]|\r\n?", re.DOTALL)
_NUMBER, _NO_DIGIT = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)"), re.compile(rb"[^0-9A-Fa-f]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: A step back in a text array, in thousandths of the font's size, that stands for a space.
_GAP = 200
#: Characters of texts that a task holds before it gives their pages on.
_HELD = 1 << 20


class _Name(bytes):
    """A name, without its slash."""


class _Operator(bytes):
    """A word that is no value."""


class _Ref(int):
    """The number of another object."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins behind a bracket at ``at``, and where it ends."""
    out, depth, start = [], 1, at
    for m in _STRING.finditer(data, at):
        if m.start() < start:
            continue
        out.append(data[start : m.start()])
        start, what = m.end(), m.group(0)
        depth += (what == b"(") - (what == b")")
        if not depth:
            return b"".join(out), start
        if m.group(1) is None:
            out.append(b"\n" if what[:1] == b"\r" else what)
        else:
            out.append(bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1] in b"01234567" else _ESCAPES.get(m.group(1), m.group(1)))
    return b"".join(out), len(data)


def _values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The values and operators from a place on, each with where it ends; arrays and dictionaries are lists and dicts."""
    stack: list[list] = []
    while m := _TOKEN.match(data, at):
        word, at = m.group(1), m.end()
        value: object
        if word in (b"[", b"<<"):
            stack.append([])
            continue
        if word in (b"]", b">>"):
            items = stack.pop() if stack else []
            value = items if word == b"]" else dict(zip(items[::2], items[1::2], strict=False))
        elif word == b"(":
            value, at = _literal(data, at)
        elif word == b"<":
            end = data.find(b">", at)
            digits = _NO_DIGIT.sub(b"", data[at:end])
            value, at = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
        elif word[:1] == b"/":
            value = _Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), word[1:]))
        elif _NUMBER.fullmatch(word):
            value = float(word) if b"." in word else int(word)
        else:
            value = _Operator(word)
        if stack:
            if value == b"R" and isinstance(value, _Operator) and len(stack[-1]) >= 2:
                stack[-1][-2:] = [_Ref(stack[-1][-2])]
            else:
                stack[-1].append(value)
        else:
            yield value, at


class _Font(dict):
    """Text by code, of ``wide`` bytes, by a map to Unicode; codes without an entry are Windows-1252 where they are single bytes."""

    def __init__(self, wide: int, unicode_map: bytes):
        self.wide, self.ranges, held = wide, [], []
        for value, _ in _values(unicode_map):
            if not isinstance(value, _Operator):
                held.append(value)
                continue
            if value == b"endbfchar":
                self.ranges += [(int.from_bytes(a), int.from_bytes(a), b) for a, b in zip(held[::2], held[1::2], strict=False)]
            elif value == b"endbfrange":
                self.ranges += [(int.from_bytes(low), int.from_bytes(high), to) for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False)]
            held = []

    def __missing__(self, code: int) -> str:
        found = next((r for r in self.ranges if r[0] <= code <= r[1]), None)
        if found is None:
            text = bytes([code]).decode("cp1252", "replace") if self.wide == 1 else ""
        else:
            low, _, to = found
            raw = to[code - low] if isinstance(to, list) else (int.from_bytes(to) + code - low).to_bytes(len(to))
            text = raw.decode("utf-16-be", "surrogatepass")
        self[code] = text
        return text


    def text(self, code: bytes) -> str:
        """What a string of codes shows; the last one may be short."""
        if self.wide == 1:
            return "".join(map(self.__getitem__, code))
        whole = array("H", code[: len(code) // 2 * 2])
        if byteorder == "little":
            whole.byteswap()
        return "".join(map(self.__getitem__, whole)) + (self[code[-1]] if len(code) % 2 else "")


#: Fonts by what they are made of: files of one maker have the same maps.
_font = lru_cache(maxsize=8)(_Font)


class _File:
    """A file's objects by number; the last of a number counts, as updates are appended."""

    def __init__(self, data: bytes):
        self.data, self.objects, self.streams, self.fonts = data, {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj\b", data):
            self._add(int(m[1]), data, m.end())
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get(b"Type") == b"ObjStm":
                packed = self.content(number)
                first = self.value(value[b"First"])
                heads = [v for v, _ in _values(packed[:first])]
                for n, place in zip(heads[::2], heads[1::2], strict=False):
                    self.objects.setdefault(n, next(_values(packed, first + place), (None, 0))[0])

    def _add(self, number: int, data: bytes, at: int) -> None:
        found = []
        for value, end in _values(data, at):
            if isinstance(value, _Operator):
                if value == b"stream" and found:
                    self.streams[number] = end + (2 if data[end : end + 2] == b"\r\n" else 1)
                elif value == b"R" and len(found) == 2:
                    found = [_Ref(found[0])]
                break
            found.append(value)
        self.objects[number] = found[0] if found else None

    def value(self, x):
        """What a reference stands for."""
        for _ in range(32):
            if not isinstance(x, _Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def content(self, number: int) -> bytes:
        """A stream's bytes, inflated."""
        about, start = self.objects.get(number), self.streams.get(number)
        if start is None or not isinstance(about, dict):
            return b""
        size = self.value(about.get(b"Length"))
        end = start + size if isinstance(size, int) and self.data[start + size : start + size + 20].lstrip(_SPACE)[:9] == b"endstream" else self.data.find(b"endstream", start)
        raw, filters = self.data[start:end], self.value(about.get(b"Filter"))
        for f in filters if isinstance(filters, list) else [filters]:
            if f == b"FlateDecode":
                raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Each page with the resources that it has or inherits, in order."""
        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get(b"Type") == b"Catalog"]
        todo, seen = [(roots[-1].get(b"Pages"), {})] if roots else [], set()
        while todo:
            ref, resources = todo.pop()
            node = self.value(ref)
            if not isinstance(node, dict) or (isinstance(ref, _Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, _Ref) else -1)
            resources = self.value(node.get(b"Resources")) or resources
            if b"Kids" in node:
                todo += [(kid, resources) for kid in reversed(self.value(node[b"Kids"]) or [])]
            else:
                yield node, resources

    def font(self, ref) -> _Font:
        """A font by its reference, read once."""
        key = int(ref) if isinstance(ref, _Ref) else None
        if key not in self.fonts:
            about = self.value(ref)
            about = about if isinstance(about, dict) else {}
            codes = about.get(b"ToUnicode")
            self.fonts[key] = _font(2 if about.get(b"Subtype") == b"Type0" else 1, self.content(int(codes)) if isinstance(codes, _Ref) else b"")
        return self.fonts[key]

    def text(self, page: dict, resources: dict) -> str:
        """The text that a page shows, line by line."""
        contents = page.get(b"Contents")
        parts = contents if isinstance(contents, list) else self.value(contents) if isinstance(self.value(contents), list) else [contents]
        data = b"\n".join(self.content(int(p)) for p in parts if isinstance(p, _Ref))
        fonts = self.value((resources or {}).get(b"Font")) or {}
        out, font, held, y, shown, leading = [], _font(1, b""), [], 0.0, None, 0.0

        def show(code: bytes) -> None:
            nonlocal shown
            if shown is not None and shown != y:
                out.append("\n")
            shown = y
            out.append(font.text(code))

        for value, _ in _values(data):
            if not isinstance(value, _Operator):
                held.append(value)
                continue
            if value == b"Tf" and len(held) >= 2:
                font = self.font(fonts.get(held[-2]))
            elif value == b"TL" and held:
                leading = held[-1]
            elif value in (b"Td", b"TD") and len(held) >= 2:
                y += held[-1]
                leading = -held[-1] if value == b"TD" else leading
            elif value == b"Tm" and len(held) >= 6:
                y = held[-1]
            elif value in (b"T*", b"'", b'"'):
                y -= leading or 1
            elif value == b"BT":
                y = 0.0
            if value in (b"Tj", b"'", b'"') and held and isinstance(held[-1], bytes):
                show(held[-1])
            elif value == b"TJ" and held and isinstance(held[-1], list):
                for x in held[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif x < -_GAP:
                        out.append(" ")
            held = []
        return "".join(out).encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under a path, in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def pages(found: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(path, page_number, page_text) of the pages from ``first`` to ``last`` of files (path, content).

    Pages without any text are dropped and keep their number, so offsets are over what is left; what isn't a PDF gives
    no rows. Only pages in the range are read.
    """
    schema = pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("page_text", pa.string())])

    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if data is None or b"%PDF-" not in data[:1024]:
                    continue
                file = _File(data)
                texts = [(n, file.text(*page)) for n, page in enumerate(file.pages(), 1) if n >= first and (last is None or n <= last)]
                kept = [(path, n, x) for n, x in texts if x.strip()]
                held += kept
                size += sum(len(x) for _, _, x in kept)
                if size >= _HELD:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return found.select("path", "content").mapInArrow(work, "path string, page_number int, page_text string")


def write(pages_of: list[list[str]]) -> bytes:
    """A file whose pages show these lines."""
    two = lambda x: x.encode("utf-16-be", "surrogatepass").hex().encode()
    unicode = zlib.compress(b"1 begincodespacerange <0000> <FFFF> endcodespacerange " + b" ".join(b"1 beginbfrange <%02X00> <%02XFF> <%02X00> endbfrange" % (h, h, h) for h in range(256)))
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages_of))), len(pages_of))]
    bodies += [b"<< /Type /Font /Subtype /Type0 /BaseFont /F1 /Encoding /Identity-H /ToUnicode 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(unicode), unicode)]
    for i, lines in enumerate(pages_of):
        shown = zlib.compress(b"BT /F1 10 Tf 12 TL 50 700 Td " + b" T* ".join(b"<%s> Tj" % two(x) for x in lines) + b" ET")
        bodies += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(shown), shown)]
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in enumerate(bodies, 1))
    return out + b"trailer << /Root 1 0 R /Size %d >>\n%%%%EOF" % (len(bodies) + 1)
