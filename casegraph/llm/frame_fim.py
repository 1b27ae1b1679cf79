"""Fill-in-the-middle over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES``, cut behind a line end
where there is one and between code points elsewhere, each with the line ends and code points that
come before it. A document is cut between units (lines), so a cut is found by its number alone: only
the frame that holds it is decompressed, all other frames go into the output as they are. The output
is again a list of frames, whose concatenation is a valid zstandard stream. Digests and the exact
restoration stream those frames in order, one open at a time.

Places of the cuts and the form come from the sha256 of seed, ``:`` and the id: the first two groups
of eight hex digits cut, the third decides whether a document is transformed at all, the fourth
between the forms ``psm`` and ``spm``. A text that is empty or holds a marker stays ``plain``.

Defined cases: a null text is empty; a null id hashes as an empty one; the text after the last line
end is a unit of its own; rows are independent, so repeated rows give equal rows and an empty table
an empty one; a line longer than a frame spans several. Other columns are kept as they are, whatever
their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import fields, place_of, unnamed

FRAME_BYTES = 1 << 15
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAMES = "array<struct<ends_before bigint, chars_before bigint, data binary>>"
STORED = f"struct<units bigint, marked boolean, frames {FRAMES}>"
FORMED = "struct<units bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>>"
DIGESTS = "struct<output_sha256 string, restored_sha256 string>"


def _mapped(df: DataFrame, column: str, name: str, kind: str, each, also: str | None = None) -> DataFrame:
    """``df`` with ``column`` replaced by ``name`` of type ``kind``: ``each(value, row id)`` of every row."""
    at, id_at = place_of(df, column), place_of(df, also) if also else None
    kept, plain = [i for i in range(len(df.columns)) if i != at], unnamed(df)
    taken = plain.drop(f"c{at}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                ids = part.column(id_at).cast(pa.string()).to_pylist() if also else [None] * len(part)
                out = [each(value, row) for value, row in zip(part.column(at).to_pylist(), ids, strict=True)]
                columns = [*[part.column(i) for i in kept], pa.array(out, _arrow_type(kind))]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f"c{i}" for i in kept], "each"])

    names = [df.columns[i] for i in kept]
    return plain.mapInArrow(run, ", ".join([*fields(taken), f"each {kind}"])).toDF(*names, _other(names, name))


def _other(taken: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _arrow_type(kind: str) -> pa.DataType:
    text, whole = pa.string(), pa.int64()
    return {
        STORED: pa.struct([("units", whole), ("marked", pa.bool_()), ("frames", pa.list_(
            pa.struct([("ends_before", whole), ("chars_before", whole), ("data", pa.binary())])))]),
        FORMED: pa.struct([("units", whole), ("form", text), ("prefix_chars", whole), ("middle_chars", whole), ("output", pa.list_(pa.binary()))]),
        "string": text,
        DIGESTS: pa.struct([("output_sha256", text), ("restored_sha256", text)]),
    }[kind]


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end behind a line end, or else between code points."""
    begin = 0
    while len(data) - begin > size:
        end = data.rfind(b"\n", begin, begin + size) + 1
        if end <= begin:
            end = begin + size
            while data[end] & 0xC0 == 0x80:
                end -= 1
        yield data[begin:end]
        begin = end
    if begin < len(data):
        yield data[begin:]


def stored_text(text: str | None, frame_bytes: int = FRAME_BYTES) -> dict:
    """The frames of a text with cumulative counts, its number of units, and whether it holds a marker."""
    data, ends, chars, frames = (text or "").encode("utf-8", "surrogatepass"), 0, 0, []
    pack = zstandard.ZstdCompressor(level=3)
    for piece in pieces(data, frame_bytes):
        frames.append({"ends_before": ends, "chars_before": chars, "data": pack.compress(piece)})
        ends, chars = ends + piece.count(b"\n"), chars + _chars(piece)
    return {"units": ends + (bool(data) and not data.endswith(b"\n")), "frames": frames,
            "marked": any(m in data for m in (PREFIX, SUFFIX, MIDDLE))}


def _chars(piece: bytes) -> int:
    return len(piece.decode("utf-8", "surrogatepass"))


class _Cutter:
    """Cuts of one stored text; frames that hold none are never opened."""

    def __init__(self, frames: list[dict], units: int):
        self.frames, self.units, self.open = frames, units, {}

    def frame(self, f: int) -> bytes:
        if f not in self.open:
            self.open[f] = zstandard.ZstdDecompressor().decompress(self.frames[f]["data"])
        return self.open[f]

    def place(self, unit: int) -> tuple[int, int]:
        """(frame, byte in it) at which ``unit`` begins."""
        if unit in (0, self.units):
            return (0, 0) if unit == 0 else (len(self.frames), 0)
        f = bisect_left(self.frames, unit, key=lambda x: x["ends_before"]) - 1
        at, body = 0, self.frame(f)
        for _ in range(unit - self.frames[f]["ends_before"]):
            at = body.index(b"\n", at) + 1
        return (f + 1, 0) if at == len(body) else (f, at)

    def chars(self, place: tuple[int, int]) -> int:
        f, at = place
        if f == len(self.frames):
            return self.frames[-1]["chars_before"] + _chars(self.frame(f - 1))
        return self.frames[f]["chars_before"] + (_chars(self.frame(f)[:at]) if at else 0)

    def between(self, begin: tuple[int, int], end: tuple[int, int]) -> list[bytes]:
        """Frames of the text from ``begin`` to ``end``: whole ones as stored, cut ones packed again."""
        (f, a), (g, b) = begin, end
        pack = zstandard.ZstdCompressor(level=3).compress
        if f == g:
            return [pack(self.frame(f)[a:b])] if a < b else []
        first = [pack(self.frame(f)[a:])] if a else [self.frames[f]["data"]]
        last = [pack(self.frame(g)[:b])] if b else []
        return first + [x["data"] for x in self.frames[f + 1 : g]] + last


def formed(stored: dict, row: str | None, seed: int, rate: int, spm: int) -> dict:
    """The output frames of one stored text."""
    units, frames = stored["units"], stored["frames"]
    groups = hashlib.sha256(f"{seed}:{'' if row is None else row}".encode()).hexdigest()
    h = [int(groups[i : i + 8], 16) for i in range(0, 32, 8)]
    if not frames or stored["marked"] or h[2] % 100 >= rate:
        return {"units": units, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": [x["data"] for x in frames]}
    text = _Cutter(frames, units)
    low, high = (text.place(x) for x in sorted((h[0] % (units + 1), h[1] % (units + 1))))
    prefix, middle, suffix = text.between((0, 0), low), text.between(low, high), text.between(high, (len(frames), 0))
    mark = zstandard.ZstdCompressor(level=3).compress
    form = "spm" if h[3] % 100 < spm else "psm"
    if form == "psm":
        output = [mark(PREFIX), *prefix, mark(SUFFIX), *suffix, mark(MIDDLE), *middle]
    else:
        output = [mark(SUFFIX), *suffix, mark(PREFIX), *prefix, mark(MIDDLE), *middle]
    before = text.chars(low)
    return {"units": units, "form": form, "prefix_chars": before, "middle_chars": text.chars(high) - before, "output": output}


def streamed(output: list[bytes], ranges: list[tuple[int, int]] | None = None, sizes: list[int] | None = None) -> Iterator[bytes]:
    """The bytes of the output, or those of ``ranges`` of it in their order, a frame at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    if ranges is None:
        yield from map(unpack, output)
        return
    for low, high in ranges:
        at = 0
        for frame, size in zip(output, sizes, strict=True):
            if at < high and at + size > low:
                yield unpack(frame)[max(low - at, 0) : high - at]
            at += size


def restored(output: list[bytes], form: str) -> Iterator[bytes]:
    """The exact text of an output, from the output and its form alone."""
    if form == "plain":
        yield from streamed(output)
        return
    sizes, places, at, tail = [], {}, 0, b""
    for body in streamed(output):
        both = tail + body
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in places and (found := both.find(mark)) >= 0:
                places[mark] = at - len(tail) + found
        sizes.append(len(body))
        at, tail = at + len(body), both[-2:]
    p, s, m = places[PREFIX], places[SUFFIX], places[MIDDLE]
    ranges = [(p + 3, s if form == "psm" else m), (m + 3, at), (s + 3, m if form == "psm" else p)]
    yield from streamed(output, ranges, sizes)


def _digested(value: dict, _: str | None) -> dict:
    whole, again = hashlib.sha256(), hashlib.sha256()
    for body in streamed(value["output"]):
        whole.update(body)
    for body in restored(value["output"], value["form"]):
        again.update(body)
    return {"output_sha256": whole.hexdigest(), "restored_sha256": again.hexdigest()}


def framed(docs: DataFrame, *, text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``docs`` with the last column ``stored`` (units, marked, frames) instead of the text."""
    return _mapped(docs, text_col, "stored", STORED, lambda text, _: stored_text(text, frame_bytes))


def fill_in_middle(
    stored: DataFrame, *, id_col: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50, column: str | None = None,
) -> DataFrame:
    """A result of ``framed`` with the last column ``fim`` (units, form, prefix_chars, middle_chars, output) instead of its frames.

    ``rate`` of a hundred documents are transformed, ``spm`` of a hundred of them suffix first.
    """
    return _mapped(stored, column or stored.columns[-1], "fim", FORMED, lambda value, row: formed(value, row, seed, rate, spm), also=id_col)


def digested(outputs: DataFrame, *, column: str | None = None) -> DataFrame:
    """A result of ``fill_in_middle`` with one more column ``digest`` (output_sha256, restored_sha256)."""
    column = column or outputs.columns[-1]
    at = place_of(outputs, column)
    both = unnamed(outputs).select("*", F.col(f"c{at}").alias("again")).toDF(*outputs.columns, _other(outputs.columns, "digest"))
    return _mapped(both, both.columns[-1], both.columns[-1], DIGESTS, _digested)


def texts(outputs: DataFrame, *, column: str | None = None, name: str = "output_text") -> DataFrame:
    """A result of ``fill_in_middle`` with its output as one string in the last column instead of its frames."""
    return _mapped(outputs, column or outputs.columns[-1], name, "string",
                   lambda value, _: b"".join(streamed(value["output"])).decode("utf-8", "surrogatepass"))
