"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands; every encoded region found in it is unwrapped
(lines and words with percent escapes, Unicode escapes and character references
decoded in place, base64 also over several lines, zlib / gzip / bzip2 / xz) into a further layer, which is scanned and unwrapped in turn until
nothing new appears.  A layer that was seen before is not entered again, so
self-reproducing data ends too.  Every layer keeps, for each of its characters,
the code points of the original text it came from, and findings are reported in
those.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hex digits are maximal, so asking for 24 at once finds the same matches as filtering runs afterwards.
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT_ONE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)")
#: Escapes are decoded in place in a line, which no finding leaves, and in each of its words, as a finding may end at another place there.
LINES = re.compile(r"[^\n]+")
WORDS = re.compile(r"\S+")
ESCAPE_ONE = re.compile(r"(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#\d{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A compressed layer over this many bytes is read in pieces, up to its end.
MAX_LAYER = 32 << 20
#: Characters of such a piece, and those that it repeats of the one before where it can't begin with a line.
PIECE, OVERLAP = 4 << 20, 64 << 10
#: Bytes that are inflated at once.
STEP = 1 << 20
Layer = tuple[str, Sequence[int], Sequence[int]]
#: base64 over several lines.
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
#: Where a compressed stream may begin in a text of single bytes, and how far such a text goes.
PACKED = re.compile(r"\x1f\x8b\x08|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]|\xfd7zXZ\x00")
SIGNS = ("\x1f\x8b\x08", "BZh", "x\x01", "x\x5e", "x\x9c", "x\xda", "\xfd7zXZ")
BYTES = re.compile(r"[\x00-\xff]*")


class Same(Sequence):
    """One number ``n`` times over, without a list of it."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        if isinstance(at, slice):
            return Same(self.value, len(range(*at.indices(self.n))))
        if not -self.n <= at < self.n:
            raise IndexError(at)
        return self.value


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base findings of one layer: (kind, start, end)."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            found.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _readable(data: bytes) -> str | None:
    """Text that a layer may hold; other bytes are no text."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    bad = sum(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)
    return text if text and bad * 20 <= len(text) else None


def _tool(data: bytes):
    """A decompressor for what begins like a compressed stream."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 6 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """All members of a compressed stream, in chunks of STEP bytes at most; ends at what is no further member."""
    tool, data, chunks = None, b"", iter(chunks)
    while True:
        if tool is None:
            while len(data) < 7 and (more := next(chunks, b"")):
                data += more
            if (tool := _tool(data)) is None:
                return
        try:
            out = tool.decompress(data, STEP)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        if out:
            yield out
        if tool.eof:
            tool, data = None, tool.unused_data
            continue
        data = getattr(tool, "unconsumed_tail", b"")
        if not data and len(out) < STEP and getattr(tool, "needs_input", True) and not (data := next(chunks, b"")):
            return


def _long_layers(chunks: Iterator[bytes], start: int, end: int) -> Iterator[Layer]:
    """A long layer in pieces that begin with a line, or else with a word and an overlap."""
    first = next(chunks, b"")
    while inner := next(_inflate([first]), b""):
        chunks = _inflate(chain([first], chunks))
        first = next(chunks, inner)
    decoder, text = codecs.getincrementaldecoder("utf-8")(), ""
    for chunk in chain([first], chunks):
        try:
            text += decoder.decode(chunk)
        except UnicodeDecodeError:
            break
        if len(text) >= PIECE:
            if at := text.rfind("\n") + 1:
                whole = text[:at]
            else:
                whole, at = text, max(text.rfind(" ", 0, -OVERLAP) + 1, 0) or (len(text) - OVERLAP) // 4 * 4
            yield whole, Same(start, len(whole)), Same(end, len(whole))
            text = text[at:]
    if text:
        yield text, Same(start, len(text)), Same(end, len(text))


def _bytes_layers(data: bytes, start: int, end: int) -> Iterator[Layer | Iterator[Layer]]:
    """Unwrap compression as often as it nests; every character then stands for the whole region."""
    seen = set()
    while True:
        chunks, inner, size = _inflate([data]), [], 0
        for chunk in chunks:
            inner.append(chunk)
            size += len(chunk)
            if size > MAX_LAYER:
                yield _long_layers(chain(inner, chunks), start, end)
                return
        if not inner or (key := hashlib.sha256(inner := b"".join(inner)).digest()) in seen:
            break
        seen.add(key)
        data = inner
    if seen and (text := _readable(data)) is not None:
        yield text, Same(start, len(text)), Same(end, len(text))


def _pieces(layer: Layer, region: re.Match, one: re.Pattern, decode) -> Layer | None:
    """Replace every escape in a region, carrying the positions along."""
    text, starts, ends = layer
    out, s, e, at, changed = [], array("q"), array("q"), region.start(), False
    for m in one.finditer(text, region.start(), region.end()):
        if (plain := decode(m.group())) is None:
            continue
        out.append(text[at : m.start()])
        s.extend(starts[at : m.start()])
        e.extend(ends[at : m.start()])
        out.append(plain)
        s.extend([starts[m.start()]] * len(plain))
        e.extend([ends[m.end() - 1]] * len(plain))
        at, changed = m.end(), True
    if not changed:
        return None
    out.append(text[at : region.end()])
    s.extend(starts[at : region.end()])
    e.extend(ends[at : region.end()])
    return "".join(out), s, e


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return bytes.fromhex(run.replace("%", "")).decode("latin-1")


def _escape(one: str) -> str | None:
    if one[0] == "&":
        return html.unescape(one)
    if one.count("\\u") == 2:
        return bytes.fromhex(one.replace("\\u", "")).decode("utf-16-be", "replace")
    value = int(one[2:].strip("{}"), 16)
    return chr(value) if value < 0xD800 or 0xDFFF < value < 0x110000 else None


def unwrap(layer: Layer) -> Iterator[Layer | Iterator[Layer]]:
    """The layers directly below one; those of a long one as an iterator."""
    text, starts, ends = layer
    for sign, one, decode in (("%", PERCENT_ONE, _percent), ("\\", ESCAPE_ONE, _escape), ("&#", ESCAPE_ONE, _escape)):
        if sign in text and one.search(text):
            for line in LINES.finditer(text):
                if sign in line.group():
                    for m in (line, *WORDS.finditer(text, *line.span())):
                        if sign in m.group() and (inner := _pieces(layer, m, one, decode)):
                            yield inner
    wrapped = 0
    for m in BASE64.finditer(text):
        yield from _base64_layers(layer, range(m.start(), m.end()))
        # a run that ends with its line may go on in the next one
        if m.start() >= wrapped and text[m.end() : m.end() + 1] in ("\n", "\r") and (more := WRAPPED.match(text, m.start())):
            wrapped = more.end()
            yield from _base64_layers(layer, [i for i in range(m.start(), wrapped) if text[i] not in "\r\n \t"])
    if not any(sign in text for sign in SIGNS):
        return
    for m in PACKED.finditer(text):
        end = BYTES.match(text, m.start()).end()
        steps = (text[i : min(i + STEP, end)].encode("latin-1") for i in range(m.start(), end, STEP))
        if next(_inflate(steps), b""):
            yield from _bytes_layers(text[m.start() : end].encode("latin-1"), starts[m.start()], ends[end - 1])


def _base64_layers(layer: Layer, places: Sequence[int]) -> Iterator[Layer | Iterator[Layer]]:
    """What the base64 characters at some places of a layer hold."""
    text, starts, ends = layer
    body = "".join([text[i] for i in places]).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    if (plain := _readable(data)) is None:
        yield from _bytes_layers(data, starts[places[0]], ends[places[-1]])
        return
    s, e, byte = array("q"), array("q"), 0
    for c in plain:
        n = len(c.encode())
        s.append(starts[places[byte * 4 // 3]])
        e.append(ends[places[min((byte + n - 1) * 4 // 3 + 1, len(body) - 1)]])
        byte += n
    yield plain, s, e


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base findings, all findings) of a text, sorted by start, kind and end."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    text = text or ""
    base = scan(text)
    name = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    every, seen = set(base), {(name(text), 0, len(text))}
    work: list[Layer | Iterator[Layer]] = list(unwrap((text, range(len(text)), range(1, len(text) + 1))))
    while work:
        layer = work.pop()
        if not isinstance(layer, tuple):
            pieces = layer
            if (layer := next(pieces, None)) is None:
                continue
            work.append(pieces)
        # the same wrapped text at another place is another finding; at the same place it is a cycle
        place = (name(layer[0]), layer[1][0], layer[2][-1])
        if place in seen:
            continue
        seen.add(place)
        for kind, a, b in scan(layer[0]):
            every.add((kind, layer[1][a], layer[2][b - 1]))
        work.extend(unwrap(layer))
    return sorted(base, key=order), sorted(every, key=order)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Find secrets in every text, plain or wrapped in any nesting of encodings.

    Returns one row per input row: the key, ``base`` and ``spans`` (arrays of
    kind, start, end in code points of the original text).  A null or empty text
    has no findings; repeated rows give repeated results; an empty table gives no rows; other
    columns are left out; texts of any length are scanned whole.
    Compressed layers are read to their end, all members of them; one of more than MAX_LAYER bytes in
    pieces, where only a run without blanks that is longer than PIECE is cut, with an overlap.
    """
    small_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches):
        for batch in batches:
            both = [find_secrets(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_rows(x) for x, _ in both], pa.list_(kind)), pa.array([as_rows(x) for _, x in both], pa.list_(kind))],
                names=[key, "base", "spans"],
            )

    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    chosen = docs.select(docs[key], docs[text])
    return chosen.mapInArrow(run, f"`{key}` {dict(chosen.dtypes)[key]}, base {item}, spans {item}")
