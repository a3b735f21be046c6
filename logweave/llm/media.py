"""Media columns: find what a blob really is by its signatures, check it, correct its type, carve what it holds.

An Aho-Corasick automaton over all magic bytes reads each blob once. Every hit goes to the
format's validator, which follows the structure (chunk sizes, checksums, trailers) and gives
the length, or rejects the hit: text that merely contains "RIFF" or "BM" is no media.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, blocks, table

FRAME = 576  # payloads are padded to a multiple of this many samples
PAD = b"\xff"
NOTE = b"a note beside the medium\n"
# The magic bytes of each format.
MAGIC = {
    b"RIFF": "wav", b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"BM": "bmp",
    b"\xff\xd8\xff": "jpeg", b"%PDF-": "pdf", b"PK\x03\x04": "zip", b"\x1f\x8b\x08": "gzip",
}
TYPES = {
    "wav": "audio/wav", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "jpeg": "image/jpeg",
    "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip",
}


def wav_of(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono PCM."""
    pad = len(samples) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    size = 4 + len(fmt) + 8 + len(samples) + pad
    return b"".join((b"RIFF", struct.pack("<I", size), b"WAVE", fmt, b"data", struct.pack("<I", len(samples)), samples, b"\0" * pad))


def png_of(samples: bytes) -> bytes:
    """An 8-bit grey image of FRAME columns, its rows unfiltered and stored."""
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.frombuffer(samples, np.uint8).reshape(-1, FRAME)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", FRAME, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 0)) + part(b"IEND", b"")


def bmp_of(samples: bytes) -> bytes:
    """An 8-bit grey image of FRAME columns; rows go from bottom to top."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, FRAME)
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    grey[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(samples), 0, start, 40, FRAME, len(rows), 1, 8, 0, len(samples), 0, 0, 256, 0)
    return head + grey.tobytes() + rows[::-1].tobytes()


def zip_of(name: bytes, data: bytes) -> bytes:
    """An archive of one stored entry."""
    same = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(name), 0)
    entry = b"PK\x03\x04" + same + name + data
    listed = b"PK\x01\x02" + struct.pack("<H", 20) + same + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name
    return entry + listed + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(listed), len(entry), 0)


def samples_of(data: bytes, kind: str) -> bytes:
    """The samples of an intact WAV, or of an image that png_of or bmp_of made."""
    if kind == "wav":
        start, size = wav_samples(data)
        return data[start : start + size]
    if kind == "bmp":
        start, height = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<i", data, 22)[0]
        return np.frombuffer(data, np.uint8, height * FRAME, start).reshape(height, FRAME)[::-1].tobytes()
    place, packed = 8, []
    while place < len(data):
        size = int.from_bytes(data[place : place + 4], "big")
        if data[place + 4 : place + 8] == b"IDAT":
            packed.append(data[place + 8 : place + 8 + size])
        place += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, FRAME + 1)[:, 1:].tobytes()


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of RIFF chunks."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            return
        yield name, at + 8, size
        at += 8 + size + size % 2


def wav_samples(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(start, size) of the sample chunk of an intact WAV at this place."""
    if data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return None
    found = {}
    for name, start, size in _chunks(data, at + 12, end):
        found.setdefault(name, (start, size))
    if b"fmt " not in found or b"data" not in found or found[b"fmt "][1] < 16:
        return None
    return found[b"data"]


def _wav(data: bytes, at: int, marks: Marks) -> int | None:
    return 8 + int.from_bytes(data[at + 4 : at + 8], "little") if wav_samples(data, at) else None


def _png(data: bytes, at: int, marks: Marks) -> int | None:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size = int.from_bytes(data[place : place + 4], "big")
        name, end = data[place + 4 : place + 8], place + 12 + size
        if end > len(data) or first and (name != b"IHDR" or size != 13):
            return None
        if zlib.crc32(data[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if name == b"IEND":
            return end - at
        place, first = end, False
    return None


def _gif(data: bytes, at: int, marks: Marks) -> int | None:
    def blocks_end(place: int) -> int | None:
        while place < len(data):
            if data[place] == 0:
                return place + 1
            place += 1 + data[place]
        return None

    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    place: int | None = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while place is not None and place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return place + 1 - at
        if kind == 0x21:
            place = blocks_end(place + 2)
        elif kind == 0x2C and place + 10 <= len(data):
            flags = data[place + 9]
            place = blocks_end(place + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return None
    return None


def _bmp(data: bytes, at: int, marks: Marks) -> int | None:
    if at + 26 > len(data):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", data, at + 2)
    fits = zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size and at + size <= len(data)
    return size if fits else None


class Marks:
    """Places of the marks that end media, each kind searched once per blob."""

    def __init__(self, data: bytes):
        self.data = data
        self.held: dict[bytes, np.ndarray] = {}

    def places(self, pattern: bytes) -> np.ndarray:
        if pattern not in self.held:
            self.held[pattern] = np.array([m.start() for m in re.finditer(pattern, self.data)], np.int64)
        return self.held[pattern]

    def sections(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each %%EOF of a PDF that a startxref stands before: its start, end with the line end, that startxref and the number after it (-1: none)."""
        if b"pdf" not in self.held:
            ends = [(m.start(), m.end()) for m in _EOF.finditer(self.data)]
            marks = self.places(b"startxref")
            rows = []
            for start, end in ends:
                i = int(np.searchsorted(marks, start)) - 1
                if i >= 0 and (not rows or marks[i] >= rows[-1][1]):
                    digits = self.data[marks[i] + 9 : min(start, marks[i] + 60)].strip()
                    rows.append((start, end, int(marks[i]), int(digits) if digits.isdigit() and len(digits) < 19 else -1))
            self.held[b"pdf"] = np.array(rows, np.int64).reshape(-1, 4)
        return tuple(self.held[b"pdf"].T)


def _jpeg(data: bytes, at: int, marks: Marks) -> int | None:
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind, size = data[place + 1], int.from_bytes(data[place + 2 : place + 4], "big")
        if kind == 0xDA:
            ends = marks.places(b"\xff\xd9")
            i = np.searchsorted(ends, place + 2 + size)
            return None if i == len(ends) else int(ends[i]) + 2 - at
        if kind < 0xC0 or size < 2:
            return None
        place += 2 + size
    return None


_EOF = re.compile(rb"%%EOF(?:\r\n|\n|\r)?")
_XREF = re.compile(rb"xref|\d{1,10}\s{1,10}\d{1,10}\s{1,10}obj")
_MAGIC = re.compile(b"|".join(map(re.escape, MAGIC)))


def _other(data: bytes, at: int, end: int, marks: Marks) -> bool:
    """Whether another PDF's header or an intact medium of another format begins here or later, before the end."""
    return any(MAGIC[m.group()] == "pdf" or VALID[MAGIC[m.group()]](data, m.start(), marks) for m in _MAGIC.finditer(data, at, end))


def _sections(data: bytes, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """Of a blob's sections, once: from each one the first whose way to the next is barred by another medium (or the last), and those that name an offset, by that offset."""
    if b"pdf stops" not in marks.held:
        start, end, mark, digits = marks.sections()
        stops = np.arange(len(mark))
        for i in range(len(mark) - 2, -1, -1):
            if not _other(data, int(end[i]), int(start[i + 1]), marks):
                stops[i] = stops[i + 1]
        named = np.flatnonzero(digits >= 0)
        marks.held[b"pdf stops"] = stops, named[np.argsort(digits[named], kind="stable")]
    return marks.held[b"pdf stops"]


def _pdf(data: bytes, at: int, marks: Marks) -> int | None:
    """Up to the last %%EOF and its line end.

    A section after the first %%EOF belongs to the PDF if its startxref leads into it (an update, also one
    that holds other media), or if no other medium begins in between.
    """
    start, end, mark, digits = marks.sections()
    i = int(np.searchsorted(mark, at))
    if i == len(mark):
        return None
    stops, by_offset = _sections(data, marks)
    while (i := int(stops[i])) + 1 < len(mark):
        far = by_offset[np.searchsorted(digits[by_offset], int(end[i]) - at) :]
        updates = np.sort(far[(far > i) & (at + digits[far] < mark[far])])
        update = next((int(j) for j in updates if _XREF.match(data, at + int(digits[j]))), None)
        if update is None:
            break
        i = update
    return int(end[i]) - at


def _zip(data: bytes, at: int, marks: Marks) -> int | None:
    """Up to the end record whose offsets fit; entries that hold archives have end records of their own."""
    ends = marks.places(b"PK\x05\x06")
    if b"zip" not in marks.held:
        whole = ends[ends <= len(data) - 22]
        marks.held[b"zip"] = np.array([(e, *struct.unpack_from("<IIH", data, e + 12)) for e in whole.tolist()], np.int64).reshape(-1, 4)
    end, size, offset, note = marks.held[b"zip"].T
    fits = np.flatnonzero((end >= at) & (at + offset + size == end) & (end + 22 + note <= len(data)))
    return int(end[fits[0]] + 22 + note[fits[0]]) - at if len(fits) else None


def _gzip(data: bytes, at: int, marks: Marks) -> int | None:
    inner = zlib.decompressobj(31)
    try:
        for place in range(at, len(data), 1 << 16):  # decoded piece by piece; bombs don't fill memory
            piece = data[place : place + (1 << 16)]
            while piece:
                inner.decompress(piece, 1 << 20)
                piece = inner.unconsumed_tail
                if inner.eof:
                    return min(place + (1 << 16), len(data)) - len(inner.unused_data) - len(piece) - at
    except zlib.error:
        return None
    return None


VALID = {"wav": _wav, "png": _png, "gif": _gif, "bmp": _bmp, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "gzip": _gzip}


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        made.add_word(magic.decode("latin-1"), (kind, len(magic)))
    made.make_automaton()
    return made


def sniff(data: bytes, signs: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, length, format) of all intact media, nested ones too, in order of place."""
    found: list[tuple[int, int, str]] = []
    marks = Marks(data)
    for last, (kind, size) in signs.iter(data.decode("latin-1")):
        start = last + 1 - size
        if length := VALID[kind](data, start, marks):
            found.append((start, length, kind))
    return sorted(found)


def parents(found: list[tuple[int, int, str]]) -> list[int | None]:
    """For each of sniff's media the number of the innermost one that holds it whole."""
    out: list[int | None] = []
    open_: list[int] = []
    for i, (start, length, _) in enumerate(found):
        while open_ and sum(found[open_[-1]][:2]) <= start:
            open_.pop()
        out.append(next((j for j in reversed(open_) if sum(found[j][:2]) >= start + length), None))
        open_.append(i)
    return out


def sniff_column(df: DataFrame, blob: str, declared: str, keep: list[str]) -> DataFrame:
    """keep + declared, sniffed, corrected and parts (start, length, type, parent) of every embedded medium.

    A blob that starts with an intact medium that fills it gets that medium's type; null and empty
    blobs and such without one keep what was declared. parts lists every intact medium;
    parent is the number (from 0) of the part that holds it, null for outermost ones.
    """
    fields = [f for f in df.select(*keep).schema]
    parts = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("parent", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = automaton()
        for whole in batches:
            for batch in blocks(whole, "__blob"):
                types, fixed, all_parts = [], [], []
                for cell, said in zip(batch.column("__blob"), batch.column("__declared").to_pylist()):
                    data = cell.as_py() or b""
                    found = sniff(data, signs)
                    sure = TYPES[found[0][2]] if found and found[0][:2] == (0, len(data)) else None
                    types.append(sure)
                    fixed.append(sure or said)
                    all_parts.append([{"start": a, "length": n, "type": TYPES[k], "parent": p} for (a, n, k), p in zip(found, parents(found))])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name) for f in fields], batch.column("__declared"), pa.array(types, pa.string()), pa.array(fixed, pa.string()), pa.array(all_parts, parts)],
                    [*[f.name for f in fields], "declared", "sniffed", "corrected", "parts"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    source = df.select(*keep, F.col(blob).alias("__blob"), F.col(declared).alias("__declared"))
    return source.mapInArrow(run, f"{kinds}, declared string, sniffed string, corrected string, parts array<struct<start: bigint, length: bigint, type: string, parent: int>>")


def stored_form(payload: bytes) -> tuple[str, bytes]:
    """(declared type, blob) of a payload; what it becomes follows from its digest alone, so equal texts have equal blobs.

    A WAV, PNG or BMP, or a WAV in a ZIP; one in four stands behind a note and before another. The
    declared type is one of TYPES or none, mostly a wrong one.
    """
    digest = hashlib.sha256(payload).digest()
    form = digest[0] % 4
    made = wav_of(payload) if form == 0 else png_of(payload) if form == 1 else bmp_of(payload) if form == 2 else zip_of(b"sound.wav", wav_of(payload))
    if digest[1] % 4 == 0:
        made = NOTE + made + NOTE
    return [*TYPES.values(), "application/octet-stream"][digest[2] % (len(TYPES) + 1)], made


def media_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A media column of mixed formats, see stored_form: each text's UTF-8 bytes (null: none), padded to whole frames, as 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                made, said, sizes = [], [], []
                for cell in batch.column("text"):
                    data = cell.as_py() or b""
                    sizes.append(len(data))
                    declared, blob = stored_form(data + PAD * (-len(data) % FRAME if data else FRAME))
                    said.append(declared)
                    made.append(blob)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(said, pa.string()), pa.array(made, pa.binary())], ["key", "n_bytes", "declared", "media"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, n_bytes long, declared string, media binary")


def features(media: DataFrame) -> DataFrame:
    """Per blob of media_of's table: what was sniffed, and digests of the samples carved from the stored bytes.

    The first outermost part is the medium; of an archive, its first part. media_bytes and media_sha256 are
    the whole blob's. feature names the carved medium's type and place, the samples' number, mean and sum of
    absolute differences, the blob's corrected and declared type, and the number of media within the samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = {v: k for k, v in TYPES.items()}
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for whole in batches:
            for batch in blocks(whole, "media"):
                rows = []
                for key, n, said, type_, parts, cell in zip(*(batch.column(c).to_pylist() for c in ("key", "n_bytes", "declared", "corrected", "parts")), batch.column("media")):
                    data = cell.as_py()
                    part = next((i for i, p in enumerate(parts) if p["parent"] is None), None)
                    if part is not None and parts[part]["type"] == TYPES["zip"]:
                        part = next((i for i, p in enumerate(parts) if p["parent"] == part), None)
                    if part is None or parts[part]["type"] not in (TYPES["wav"], TYPES["png"], TYPES["bmp"]):
                        raise ValueError(f"row {key}: stored media isn't intact")
                    start, size, carved = parts[part]["start"], parts[part]["length"], parts[part]["type"]
                    payload = samples_of(data[start : start + size], kind_of[carved])
                    wave = np.frombuffer(payload, np.uint8).astype(np.int16)
                    inner = sum(p["start"] > start and p["start"] + p["length"] <= start + size for p in parts)
                    feature = f"{carved}@{start}+{size};samples={len(payload)};mean={int(wave.sum(dtype=np.int64)) / len(payload):.6f};delta={int(np.abs(np.diff(wave)).sum(dtype=np.int64))};blob={type_};declared={said};inner={inner}"
                    rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return sniff_column(media, "media", "declared", ["key", "n_bytes", "media"]).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document texts stored as media of mixed formats under mostly wrong types, read back, sniffed, checked, corrected and carved.

    Null texts are empty ones, repeated rows are rows of their own, null ids stay null, an empty table gives
    no rows; other columns aren't read, so none can clash.
    """
    stored = Scratch(spark, "media").save(media_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "blobs")
    return features(stored)
