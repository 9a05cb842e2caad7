"""Secret scans through nested encodings: a worklist of layers, each rescanned, with spans mapped to the text itself.

A layer is a string and, for each of its characters, the stretch of the original text that it came from. Percent
escapes, Unicode and string escapes and entities are undone over the whole layer, so that a secret that is only partly escaped comes out in
one piece: each kind once, and all kinds together until none is left, however deep they are nested, in one pass. So is UTF-16 among bytes,
and lines of wrapped base64 are joined. Runs of base64 become layers of their own, and so does
compressed data in any layer, since bytes are characters below 256: compressed data inside of compressed data, or behind
percent escapes, is opened like any other. A layer seen before with the same sources is not opened again, so cycles end, while copies
elsewhere are opened each; the list runs until nothing new comes up.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import heapq
import io
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The kinds of secrets in their order, their patterns, and the least length of a match (assign: of group 2).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Some text of these must occur, in lower case, before ASSIGN can match.
HINTS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|[\\%]u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(quot|apos|amp|lt|gt);|\\([\"\\/])")
#: One escape of any kind that stands for a character; halves of a pair only together. The longest has 12 characters.
ANY = re.compile(r"%([0-9A-Fa-f]{2})|[\\%]u([Dd][89ABab][0-9A-Fa-f]{2})[\\%]u([Dd][C-Fc-f][0-9A-Fa-f]{2})|[\\%]u((?![Dd][89A-Fa-f])[0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(quot|apos|amp|lt|gt);|\\([\"\\/])")
LONGEST = 12
#: Escapes are undone layer by layer so many times; deeper ones all at once.
STEPS = 4
#: The named entities that every markup knows.
NAMED = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">"}
#: UTF-16 among bytes, either end first.
WIDE = re.compile("(?:[^\0]\0){6,}|(?:\0[^\0]){6,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
STANDARD = str.maketrans("-_", "+/")
#: Base64 broken over lines; the break with the character before it.
WRAPPED = re.compile(r"[A-Za-z0-9+/]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/]{4,})+={0,2}")
BREAK = re.compile(r"[^\s]\r?\n[\x20\t]*")
#: Where compressed data may start: gzip, zlib, bzip2, xz.
PACKED = re.compile("\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
#: Deflated data has no sign: it is tried at the start of decoded bytes and behind these. Its first PROBE bytes must be sound,
#: unfold to as many bytes as a secret has at least, and end where the bytes end or before one of BEHIND.
WORD_END = re.compile("[ \t\n\"'=]")
APART_64 = re.compile(r"[-_/+]+")
PROBE, LEAST_SECRET, BEHIND = 4096, 12, b" \t\r\n\"'<>&;,)%\\"
#: Uncompressed data is scanned in pieces of about CHUNK characters, cut behind a character that no pattern holds. A piece
#: without one grows to MOST_HELD; then the next begins OVERLAP before its end. So a decompression bomb takes time, not memory.
CHUNK, MOST_HELD, OVERLAP = 1 << 20, 8 << 20, 1 << 16
#: Bytes of compressed data that are read at once; after a fault the last of them are read one by one.
FEED = 1 << 16
APART = "\n\t,<>()|!*"

Span = tuple[str, int, int]


class Layer:
    """text, the layer it was decoded from (None: it is the original), and where in that one given characters start and end.

    bytes_at: where data without a sign may start in it. steps: how many times escapes were undone to come here, without other decoders.
    """

    def __init__(self, text: str, parent: Layer | None = None, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, bytes_at: Iterable[int] = (), steps: int = 0):
        self.text, self.parent, self.place, self.bytes_at, self.steps = text, parent, place, bytes_at, steps

    def places(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the original the characters `first` start and the characters `last` end."""
        layer = self
        while layer.parent is not None:
            first, last, layer = layer.place(first)[0], layer.place(last)[1] - 1, layer.parent
        return first, last + 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        low, high = self.places(np.array([start]), np.array([end - 1]))
        return int(low[0]), int(high[0])

    def key(self) -> bytes:
        """Equal for layers of the same text from the same places."""
        digest = hashlib.sha256(self.text.encode(errors="surrogatepass"))
        for at in range(0, len(self.text), CHUNK):
            every = np.arange(at, min(at + CHUNK, len(self.text)))
            for place in self.places(every, every):
                digest.update(np.ascontiguousarray(place, dtype=np.int64).tobytes())
        return digest.digest()

    def replaced(self, pieces: Iterable[tuple[int, int, str]], steps: int = 0) -> Layer | None:
        """A layer in which each text[start:end] became a string of characters that came from equally long parts of it; None without pieces."""
        out, at, columns = io.StringIO(), 0, [array("q") for _ in range(4)]
        for start, end, new in pieces:
            out.write(self.text[at:start])
            for column, value in zip(columns, (start, end, out.tell(), len(new)), strict=True):
                column.append(value)
            out.write(new)
            at = end
        if not columns[0]:
            return None
        out.write(self.text[at:])
        old, old_end, begin, size = (np.frombuffer(c, dtype=np.int64) for c in columns)

        def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.searchsorted(begin, x, side="right") - 1
            i = np.maximum(k, 0)
            within = x - begin[i]
            step = (old_end[i] - old[i]) // size[i]
            inside = (k >= 0) & (within < size[i])
            start = np.where(inside, old[i] + within * step, np.where(k < 0, x, old_end[i] + within - size[i]))
            return start, start + np.where(inside, step, 1)

        # Escaped data may start at a stretch of new characters, or at the word that it stands in
        fresh = begin[np.concatenate([[True], begin[1:] > begin[:-1] + size[:-1]])]
        new_text = out.getvalue()
        words = np.array([0, *(m.end() for m in WORD_END.finditer(new_text))], dtype=np.int64)
        return Layer(new_text, self, place, np.union1d(fresh, words[np.searchsorted(words, fresh, side="right") - 1]).tolist(), steps=steps)


def scan(text: str) -> list[Span]:
    """Secrets that stand in the text itself: leftmost, not overlapping within a kind, failing matches dropped."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _percent(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    return layer.replaced(((m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode("latin-1")) for m in PERCENT.finditer(layer.text)), steps=layer.steps + 1)


def _units(text: str) -> Iterator[tuple[int, int, str]]:
    """Escaped characters; halves of a pair are joined, and lone ones stay."""
    high = None
    for m in ESCAPE.finditer(text):
        if m[7] or m[8]:
            yield m.start(), m.end(), NAMED[m[7]] if m[7] else m[8]
            continue
        code, start = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16), m.start()
        if 0xDC00 <= code < 0xE000 and high and high[0] == start:
            start, code = high[1], 0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00
        high = (m.end(), start, code) if 0xD800 <= code < 0xDC00 else None
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield start, m.end(), chr(code)


def _escapes(layer: Layer) -> Layer | None:
    return layer.replaced(_units(layer.text), steps=layer.steps + 1) if "\\" in layer.text or "&" in layer.text or "%u" in layer.text else None


def _character(m: re.Match) -> str | None:
    """What an escape stands for; None if that is no character."""
    if m[10] or m[11]:
        return NAMED[m[10]] if m[10] else m[11]
    if m[2]:
        return chr(0x10000 + ((int(m[2], 16) - 0xD800) << 10) + int(m[3], 16) - 0xDC00)
    code = int(m[9]) if m[9] else int(next(g for g in m.groups()[:8] if g), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _each(text: str) -> Iterator[re.Match]:
    """Escapes at every place where one starts, overlapping ones too."""
    at = 0
    while m := ANY.search(text, at):
        yield m
        at = m.start() + 1


def _fixpoint(text: str) -> list[tuple[int, int, str]]:
    """The text's escapes of all kinds, undone until none is left, as pieces that became one character each.

    One pass with a stack of pieces: a new character can only complete or begin an escape together with the few characters around it,
    and each step makes the text shorter, so the time is linear however deep escapes are nested.
    """
    pieces: list[tuple[int, int, str]] = []
    whole = ((m.start(), m.end(), new) for m in _each(text) if (new := _character(m)) is not None)
    ahead = next(whole, None)  # the next escape of the text itself
    while ahead:
        pieces.append(ahead)
        at = ahead[1]  # what stands before is read
        while pieces[-1][1] == at:  # the last character read is a new one: it may be a part of an escape
            tail, spots, k, pos = [], [], len(pieces) - 1, at
            while pos > 0 and len(tail) < LONGEST - 1:
                if k >= 0 and pieces[k][1] == pos:
                    start, _, char = pieces[k]
                    k -= 1
                else:
                    start, char = pos - 1, text[pos - 1]
                tail.append(char)
                spots.append((start, k + 1))
                pos = start
            while ahead and ahead[0] < at:
                ahead = next(whole, None)
            # An escape that stands there is undone before its characters count
            near = "".join(reversed(tail)) + text[at : min(at + LONGEST - 1, ahead[0] if ahead else len(text))]
            for begin in range(len(tail)):
                if near[begin] in "%&\\" and (m := ANY.match(near, begin)) and m.end() >= len(tail) and (new := _character(m)) is not None:
                    break
            else:
                break
            start, left = spots[len(tail) - 1 - begin]
            at += m.end() - len(tail)
            del pieces[left:]
            pieces.append((start, at, new))
    return pieces


def _undone(layer: Layer) -> Iterator[Layer]:
    """Layers without percent escapes, and without other escapes, STEPS times; and, where escapes are nested or mixed, one without any."""
    once = [new for step in (_percent, _escapes) if (new := step(layer)) is not None]
    yield from once
    if layer.steps == 0 and once and (len(once) == 2 or ANY.search(once[0].text)):
        last = layer.replaced(_fixpoint(layer.text), steps=STEPS)
        if last is not None and all(last.text != x.text for x in once):
            yield last


def _wide(layer: Layer) -> Layer | None:
    if "\0" not in layer.text:
        return None
    return layer.replaced((m.start(), m.end(), m[0][m[0][0] == "\0" :: 2]) for m in WIDE.finditer(layer.text))


def _joined(layer: Layer) -> Layer | None:
    """Lines of base64 as one run: a break goes with the character before it."""
    if "\n" not in layer.text:
        return None
    return layer.replaced((m.start() + b.start(), m.start() + b.end(), b[0][0]) for m in WRAPPED.finditer(layer.text) for b in BREAK.finditer(m[0]))


def _tool(data: bytes, plain: bool = False):
    """What uncompresses the data, if it looks compressed; plain: deflated data without a sign."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(wbits=31)
    if len(data) > 1 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return zlib.decompressobj(wbits=-15) if plain else None


def _byte(text: str, start: int, end: int) -> bytes:
    """Characters as bytes, up to the first that is none."""
    try:
        return text[start:end].encode("latin-1")
    except UnicodeEncodeError as e:
        return text[start : start + e.start].encode("latin-1")


def _sound(head: bytes) -> bool:
    """Whether deflated data may start with these bytes; most others fail within a few."""
    try:
        zlib.decompressobj(wbits=-15).decompress(head, CHUNK)
    except zlib.error:
        return False
    return True


def _deflated(text: str, at: int) -> bool:
    """Whether sound deflated data starts there, as far as a probe tells."""
    tool, head = zlib.decompressobj(wbits=-15), _byte(text, at, at + PROBE)
    try:
        found = len(tool.decompress(head, CHUNK)) >= LEAST_SECRET
    except zlib.error:
        return False
    if tool.eof:
        return found and (not tool.unused_data or tool.unused_data[0] in BEHIND)
    return found and len(head) == PROBE


class Unpacked:
    """Uncompressed data from text[at:] on (characters are bytes), as far as it is sound; members that follow each other are one stream."""

    def __init__(self, text: str, at: int, plain: bool = False):
        self.text, self.at, self.plain = text, at, plain
        self.end = at  # behind the last whole member
        self.fed = at  # behind the last character that was read

    def __iter__(self) -> Iterator[bytes]:
        text, self.fed, begin = self.text, self.at, self.at
        tool = _tool(_byte(text, begin, begin + 6), self.plain)
        while tool is not None and self.fed < len(text):
            feed = _byte(text, self.fed, self.fed + FEED)
            if not feed:
                return
            before, given = tool.copy() if hasattr(tool, "copy") else None, 0
            try:
                for out in _unfolded(tool, feed):
                    given += len(out)
                    yield out
            except FAULTS:  # what stands before the fault is sound: the same bytes again, one by one
                yield from self._slowly(before or self._again(begin), feed, given)
                return
            self.fed += len(feed) - len(tool.unused_data if tool.eof else b"")
            if tool.eof:
                self.end, begin = self.fed, self.fed
                tool = _tool(_byte(text, begin, begin + 6), self.plain)

    def _again(self, begin: int):
        """A tool that has read text[begin:fed]."""
        tool = _tool(_byte(self.text, begin, begin + 6), self.plain)
        for at in range(begin, self.fed, FEED):
            for _ in _unfolded(tool, _byte(self.text, at, min(at + FEED, self.fed))):
                pass
        return tool

    def _slowly(self, tool, feed: bytes, given: int) -> Iterator[bytes]:
        """The data of some bytes up to a fault, without the first `given` bytes of it."""
        for k in range(len(feed)):
            try:
                for out in _unfolded(tool, feed[k : k + 1]):
                    if out[given:]:
                        yield out[given:]
                    given = max(0, given - len(out))
            except FAULTS:
                return
            self.fed += 1


FAULTS = (zlib.error, OSError, lzma.LZMAError, EOFError)


def _unfolded(tool, feed: bytes) -> Iterator[bytes]:
    """What a tool makes of some bytes, in pieces of CHUNK at most."""
    while True:
        out = tool.decompress(feed, CHUNK)
        if out:
            yield out
        feed = getattr(tool, "unconsumed_tail", b"")
        if tool.eof or not out and not feed:
            return


def _pieces(stream: Iterable[bytes]) -> Iterator[str]:
    """The data of a stream in pieces that leave no secret and, up to MOST_HELD, no blob cut."""
    held, tried = bytearray(), 0
    for chunk in stream:
        held += chunk
        if len(held) - tried < CHUNK:
            continue
        text, tried = held.decode("latin-1"), len(held)
        cut = max(text.rfind(c) for c in APART) + 1
        if cut or len(held) >= MOST_HELD:
            yield text[:cut] if cut else text
            del held[: cut or len(held) - OVERLAP]
            tried = len(held)
    if held:
        yield held.decode("latin-1")


def _packed(layer: Layer) -> Iterator[Layer]:
    """Layers of what is compressed in a layer. Each comes from the whole stretch that the data was read from."""
    text, done = layer.text, 0
    signs = (m.start() for m in PACKED.finditer(text))
    for at, plain in heapq.merge(((x, False) for x in signs), ((x, True) for x in layer.bytes_at)):
        if at < done or plain and not _deflated(text, at):
            continue
        stream = Unpacked(text, at, plain)
        held, size = [], 0
        for out in stream:  # how far it goes is known at its end, and only then its layers are: long data is read twice
            size += len(out)
            if size <= MOST_HELD:
                held.append(out)
        if not size:
            continue
        last = stream.end if stream.end > at else max(stream.fed, at + 1)
        for piece in _pieces(held if size <= MOST_HELD else stream):
            yield Layer(piece, layer, lambda x, at=at, last=last: (np.full(len(x), at), np.full(len(x), last)), (0,))
        done = stream.end if stream.end > at else 0


def _decoded(body: str) -> bytes:
    if len(body) % 4 == 1:
        body = body[:-1]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _base64(layer: Layer) -> Iterator[Layer]:
    """Runs of base64 from each of their first four characters on, as what stands before a blob may belong to its run.

    Bytes are read as Latin-1, one character each: the patterns are ASCII, and no other byte takes anything from them.
    """
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=").translate(STANDARD)
        start, length = m.start(), len(m[0])
        starts = [0, 1, 2, 3]
        for sign in APART_64.finditer(m[0]):
            for at in {sign.start() + 1, sign.end()}:
                if _sound(_decoded(run[at : at + 96])) and _deflated(_decoded(run[at : at + 2 * PROBE]).decode("latin-1"), 0):
                    starts.append(at)
        for skip in starts:
            data = _decoded(run[skip:])

            def place(x: np.ndarray, start=start, skip=skip, last=len(data) - 1, length=length) -> tuple[np.ndarray, np.ndarray]:
                return start + skip + x * 8 // 6, start + np.where(x == last, length, skip - (-(x + 1) * 8 // 6))

            yield Layer(data.decode("latin-1"), layer, place, (0,))


def _inside(layer: Layer) -> Iterator[Layer]:
    if layer.steps < STEPS:
        yield from _undone(layer)
    for step in (_wide, _joined):
        if (new := step(layer)) is not None:
            yield new
    yield from _base64(layer)
    yield from _packed(layer)


def _opens(layer: Layer) -> bool:
    """Whether there may be layers in the layer."""
    text = layer.text
    if any(sign in text and p.search(text) for sign, p in (("%", PERCENT), ("\\", ESCAPE), ("&", ESCAPE), ("%u", ESCAPE), ("\0", WIDE), ("", BASE64), ("", PACKED))):
        return True
    return any(_deflated(text, at) for at in layer.bytes_at)


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """The spans that stand in the text itself, and all spans, each sorted by start and then kind; code points, end exclusive."""
    text = text or ""
    base = scan(text)
    every, seen = set(base), set()
    work = [_inside(Layer(text))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        every |= {(kind, *new.source(s, e)) for kind, s, e in scan(new.text)}
        if not _opens(new) or (key := new.key()) in seen:
            continue
        seen.add(key)
        work.append(_inside(new))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(every, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, spans = [], [], []
        for text in batch.column(1):
            base, every = find_secrets(text.as_py())
            counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        table = np.array(counts, dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(3)), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts, digest and all spans of the secrets in every row of docs (doc_id, text).

    Null text counts as empty: no spans, and the digest of the empty string. Each row is judged alone, so repeated rows
    get equal results and an empty table an empty one; other columns are not read.
    """
    read = docs.select("doc_id", "text")
    schema = read.select("doc_id").schema.add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("spans", "string")
    return read.mapInArrow(_digests, schema)


def masked(text: str) -> str:
    """The text with every character of a secret but spaces replaced by an asterisk; lengths stay."""
    _, spans = find_secrets(text)
    if not spans:
        return text
    out = list(text)
    for _, start, end in spans:
        out[start:end] = ["*" if not c.isspace() else c for c in out[start:end]]
    return "".join(out)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in `text` masked; all rows and columns stay, null texts too."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new = pa.array([t if t is None else masked(t) for t in column.to_pylist()], column.type)
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
