"""Lines of PDF files, in Arrow batches, a file at a time.

Reads what text extraction needs: objects by their cross-references (tables and
streams; where those are broken, by a search for objects), object streams,
inflated contents, the text operators with their positions, and the fonts' maps
to Unicode.  Lines are what stands on one height, from the left.  A file that
cannot be read gives one row with the error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\x00\t\n\f\r ()<>\[\]{}/%]+")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A kern of so many thousandths between two strings stands for a space, and what counts as one height.
SPACE, SAME_LINE = 180, 2.0
#: Bytes that a stream may inflate to, and pages of a file; more is an error.
MOST_BYTES, MOST_PAGES = 1 << 28, 100_000


class Name(str):
    """/Name"""


class Ref(int):
    """n g R"""


class Word(str):
    """A keyword or operator."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string whose "(" is before ``at``, and the place behind it."""
    out, depth = bytearray(), 1
    for m in re.compile(rb"\\([0-7]{1,3}|\r\n|.)|[()]|[^\\()]+", re.S).finditer(data, at):
        piece = m[0]
        if piece == b"(":
            depth += 1
        elif piece == b")":
            depth -= 1
            if not depth:
                return bytes(out), m.end()
        if piece[:1] == b"\\":
            e = m[1]
            out += bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[0] < 56 else b"" if e in (b"\n", b"\r", b"\r\n") else ESCAPES.get(e, e)
        else:
            out += piece
    raise ValueError("a string without an end")


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Successive values (numbers, names, strings, lists, dicts, references, words) and the places behind them."""
    stack: list[list] = []
    while m := TOKEN.search(data, at):
        at, t = m.end(), m[0]
        if t[:1] == b"%":
            continue
        if t in (b"[", b"<<", b"{"):
            stack.append([t])
            continue
        if t in (b"]", b">>", b"}"):
            if not stack:
                continue
            items = stack.pop()
            value: object = dict(zip(items[1::2], items[2::2])) if items[0] == b"<<" else items[1:]
        elif t == b"(":
            value, at = _string(data, at)
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[+-]?\d+", t):
            value = int(t)
        elif re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", t):
            value = float(t)
        elif t == b"R" and stack and len(stack[-1]) > 2:
            number = stack[-1][-2]
            del stack[-1][-2:]
            value = Ref(number)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(t, Word(t.decode("latin-1")))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class File:
    """The objects of a PDF file."""

    def __init__(self, data: bytes):
        self.data, self.places, self.packed, self.trailer, self.held = data, {}, {}, {}, {}
        try:
            self._references(int(re.findall(rb"startxref\s+(\d+)", data)[-1]))
            self.pages = list(self._pages(self.at(self.at(self.trailer["Root"])["Pages"]), {}, set()))
        except (IndexError, KeyError, TypeError, ValueError, AttributeError, zlib.error):
            self._search()
            self.pages = list(self._pages(self.at(self.at(self.trailer["Root"])["Pages"]), {}, set()))

    def _references(self, start: int) -> None:
        seen = set()
        while start is not None and start not in seen:
            seen.add(start)
            if self.data[start : start + 4] == b"xref":
                at = start + 4
                while m := re.compile(rb"\s*(\d+)\s+(\d+)\s+(?=\d{10})").match(self.data, at):
                    at = m.end()
                    for number in range(int(m[1]), int(m[1]) + int(m[2])):
                        entry = self.data[at : at + 20]
                        if entry[17:18] == b"n":
                            self.places.setdefault(number, int(entry[:10]))
                        at += 20
                trailer = next(v for v, _ in values(self.data, self.data.index(b"trailer", at - 1) + 7))
            else:
                trailer, raw = self._object(start)
                widths, entries = trailer["W"], self.inflated(trailer, raw)
                index = trailer.get("Index", [0, trailer["Size"]])
                numbers = (n for a, c in zip(index[::2], index[1::2]) for n in range(a, a + c))
                for i, number in enumerate(numbers):
                    row, at, fields = entries[i * sum(widths) : (i + 1) * sum(widths)], 0, []
                    for w in widths:
                        fields.append(int.from_bytes(row[at : at + w], "big") if w else 1)
                        at += w
                    if fields[0] == 1:
                        self.places.setdefault(number, fields[1])
                    elif fields[0] == 2:
                        self.packed.setdefault(number, (fields[1], fields[2]))
            self.trailer = trailer | self.trailer
            start = trailer.get("Prev")

    def _search(self) -> None:
        """Objects where they stand, the last of each number; the trailers' keys."""
        self.packed, self.held, self.trailer = {}, {}, {}
        self.places = {int(m[1]): m.start() for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", self.data)}
        for number, place in self.places.items():
            try:
                found = self._object(place)[0]
            except (ValueError, StopIteration):
                continue
            if isinstance(found, dict) and found.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number)
            if isinstance(found, dict) and found.get("Type") == "ObjStm":
                self.packed |= {n: (number, i) for i, n in enumerate(self._pack(number)[0])}
        for number in self.packed:
            if isinstance(found := self.at(Ref(number)), dict) and found.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number)
        if "Root" not in self.trailer:
            raise ValueError("no catalog")

    def _object(self, place: int) -> tuple[object, bytes]:
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, place)
        if not m:
            raise ValueError("no object at its place")
        value, at = next(values(self.data, m.end()))
        s = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, at)
        if not s or not isinstance(value, dict):
            return value, b""
        length = self.at(value.get("Length"))
        end = s.end() + length if isinstance(length, int) else -1
        if not re.compile(rb"\s*endstream").match(self.data, end if end >= 0 else 0):
            end = self.data.index(b"endstream", s.end())
        return value, self.data[s.end() : end]

    def inflated(self, head: dict, raw: bytes) -> bytes:
        filters = self.at(head.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name}")
            inflate = zlib.decompressobj()
            raw = inflate.decompress(raw, MOST_BYTES)
            if inflate.unconsumed_tail:
                raise ValueError("a stream is too large")
        how = self.at(head.get("DecodeParms")) or {}
        return _unpredicted(raw, how.get("Columns", 1) * how.get("Colors", 1)) if isinstance(how, dict) and how.get("Predictor", 1) >= 10 else raw

    def _pack(self, number: int) -> tuple[list[int], list[object]]:
        if ("pack", number) not in self.held:
            head, raw = self._object(self.places[number])
            body = self.inflated(head, raw)
            numbers = [v for v, _ in zip((v for v, _ in values(body[: head["First"]])), range(2 * head["N"]))]
            self.held["pack", number] = numbers[::2], [next(values(body, head["First"] + at))[0] for at in numbers[1::2]]
        return self.held["pack", number]

    def at(self, value):
        """What a value refers to, itself if it is no reference."""
        if not isinstance(value, Ref):
            return value
        if value not in self.held:
            self.held[value] = self._pack(self.packed[value][0])[1][self.packed[value][1]] if value in self.packed else self._object(self.places[value])[0] if value in self.places else None
        return self.held[value]

    def stream(self, ref) -> bytes:
        return self.inflated(*self._object(self.places[ref]))

    def _pages(self, node: dict, given: dict, seen: set) -> Iterator[dict]:
        given = given | {k: node[k] for k in ("Resources",) if k in node}
        if "Kids" not in node:
            yield given | node
            return
        for kid in self.at(node["Kids"]):
            if kid in seen or len(seen) > MOST_PAGES:
                raise ValueError("pages without an end")
            seen.add(kid)
            yield from self._pages(self.at(kid), given, seen)


def _unpredicted(raw: bytes, width: int) -> bytes:
    """Rows of PNG filters none and up, which cross-reference streams use."""
    out, before = bytearray(), bytes(width)
    for at in range(0, len(raw), width + 1):
        row = raw[at + 1 : at + 1 + width]
        before = row if raw[at] == 0 else bytes((a + b) & 255 for a, b in zip(row, before))
        if raw[at] not in (0, 2):
            raise ValueError(f"row filter {raw[at]}")
        out += before
    return bytes(out)


class Font:
    """Codes of a font to text: by its map to Unicode, else as cp1252."""

    def __init__(self, file: File, font: dict):
        self.wide = font.get("Subtype") == "Type0"
        self.single, self.ranges = {}, []
        if "ToUnicode" in font:
            stack: list = []
            for value, _ in values(file.stream(font["ToUnicode"])):
                if isinstance(value, Word):
                    if value == "endbfchar":
                        self.single |= {int.from_bytes(a): b for a, b in zip(stack[::2], stack[1::2])}
                    elif value == "endbfrange":
                        self.ranges += [(int.from_bytes(a), int.from_bytes(b), c) for a, b, c in zip(stack[::3], stack[1::3], stack[2::3])]
                    stack = []
                elif isinstance(value, (bytes, list)):
                    stack.append(value)

    def text(self, codes: bytes) -> str:
        if not self.single and not self.ranges:
            return codes.decode("utf-16-be" if self.wide else "cp1252", "replace")
        out = b""
        for code in (int.from_bytes(codes[i : i + 2]) for i in range(0, len(codes), 2)) if self.wide else codes:
            found = self.single.get(code)
            for a, b, first in self.ranges if found is None else ():
                if a <= code <= b:
                    found = first[code - a] if isinstance(first, list) else first[:-2] + (int.from_bytes(first[-2:]) + code - a).to_bytes(2)
                    break
            out += found if found is not None else b"\xff\xfd"
        return out.decode("utf-16-be", "replace")


def page_lines(file: File, page: dict) -> list[str]:
    """A page's lines from the top, those of one height from the left."""
    contents = file.at(page.get("Contents"))
    refs = contents if isinstance(contents, list) else [page["Contents"]] if contents is not None else []
    named = file.at((file.at(page.get("Resources")) or {}).get("Font")) or {}
    fonts: dict = {}
    shown: list[tuple[float, float, int, str]] = []
    stack: list = []
    font, leading, matrix, line = None, 0.0, [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0]

    def move(x: float, y: float) -> list:
        return [*line[:4], x * line[0] + y * line[2] + line[4], x * line[1] + y * line[3] + line[5]]

    def show(pieces) -> None:
        text = "".join(" " if isinstance(p, (int, float)) and p < -SPACE else font.text(p) if isinstance(p, bytes) and font else "" for p in pieces)
        if text:
            shown.append((-matrix[5], matrix[4], len(shown), text))

    for value, _ in values(b"\n".join(file.stream(r) for r in refs)):
        if not isinstance(value, Word):
            stack.append(value)
            continue
        if value == "Tf":
            if stack[-2] not in fonts:
                fonts[stack[-2]] = Font(file, file.at(named[stack[-2]]))
            font = fonts[stack[-2]]
        elif value == "BT":
            matrix = line = [1.0, 0, 0, 1.0, 0, 0]
        elif value == "Tm":
            matrix = line = stack[-6:]
        elif value in ("Td", "TD"):
            leading = -stack[-1] if value == "TD" else leading
            matrix = line = move(*stack[-2:])
        elif value == "TL":
            leading = stack[-1]
        elif value in ("T*", "'", '"'):
            matrix = line = move(0, -leading)
        if value in ("Tj", "'", '"'):
            show(stack[-1:])
        elif value == "TJ":
            show(stack[-1])
        stack = []
    out: list[tuple[float, list]] = []
    for y, x, i, text in sorted(shown):
        if not out or y - out[-1][0] > SAME_LINE:
            out.append((y, []))
        out[-1][1].append((x, i, text))
    lines = (" ".join(t for _, _, t in sorted(parts)).strip() for _, parts in out)
    return [t for t in lines if t]


def parsed(files: DataFrame) -> DataFrame:
    """files(doc_id, content) -> (doc_id, page, line_no, line, error): a row for each line, or one with the error; null content has no row."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                doc, raw = batch.column("doc_id")[i].as_py(), batch.column("content")[i].as_py()
                if raw is None:
                    continue
                try:
                    file = File(raw)
                    rows = [(p, n, t, None) for p, page in enumerate(file.pages) for n, t in enumerate(page_lines(file, page))]
                except Exception as broken:  # whatever a damaged file leads to is that file's result
                    rows = [(None, None, None, f"{type(broken).__name__}: {broken}")]
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), batch.schema.field("doc_id").type), *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()))]], names=["doc_id", "page", "line_no", "line", "error"])

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, page int, line_no int, line string, error string")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """PDF files of a folder or pattern -> ``parsed``; doc_id is the first number in a file's name.  Spark's reader passes over files of no length."""
    from ..operators.text import file_number
    from .files import stem

    return parsed(spark.read.format("binaryFile").load(path).select(file_number(stem(F.col("path"))).alias("doc_id"), "content"))


def made_of(lines: list[str], to_a_page: int = 50) -> bytes:
    """A PDF file of these lines, ``to_a_page`` to a page, with a font of all characters; for exports and tests."""
    unicode_map = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 256 beginbfrange " + b" ".join(b"<%02X00> <%02XFF> <%02X00>" % (h, h, h) for h in range(256)) + b" endbfrange endcmap"
    stream = lambda head, body: b"<< %s /Filter /FlateDecode /Length %d >> stream\n%s\nendstream" % (head, len(z := zlib.compress(body)), z)
    pages = [lines[i : i + to_a_page] for i in range(0, len(lines), to_a_page)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages))))]
    objects += [b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 4 0 R >>", stream(b"", unicode_map)]
    for i, page in enumerate(pages):
        shown = b" ".join(b"<%s> Tj T*" % t.encode("utf-16-be").hex().encode() for t in page)
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * i), stream(b"", b"BT /F1 11 Tf 14 TL 50 800 Td " + shown + b" ET")]
    out, places = b"%PDF-1.7\n", []
    for i, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj %s endobj\n" % (i + 1, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))
