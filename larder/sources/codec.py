"""The archive's byte layout: header, data, metadata, index, footer.

Everything is little-endian. Offsets in the index are absolute. The directory of an archive can be
read without its data: the footer says where the index is.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

# Fixed values of the format.
HEADER_MAGIC, FOOTER_MAGIC, VERSION = b"DESHEAD1", b"DESFOOT1", 1
HEADER = struct.Struct("<8sB7s")
NAME_LENGTH = struct.Struct("<H")
ENTRY = struct.Struct("<QQQQI")
FOOTER = struct.Struct("<8sB7s7Q")
EXTERNAL, COMPRESSED, ENCRYPTED, DELETED = 1, 2, 4, 8
BIG_FILE, NAME_BYTES, META_BYTES = 100 * 1024 * 1024, 65535, 10 * 1024 * 1024
FORBIDDEN = frozenset('/\\:*?"<>|')
MIN_SIZE = HEADER.size + FOOTER.size


class ArchiveError(ValueError):
    """A file is no valid archive, or a member may not be stored."""


@dataclass(frozen=True)
class Footer:
    version: int
    data_start: int
    data_length: int
    meta_start: int
    meta_length: int
    index_start: int
    index_length: int
    file_count: int


@dataclass(frozen=True)
class Entry:
    name: str
    data_offset: int
    data_length: int
    meta_offset: int
    meta_length: int
    flags: int

    @property
    def external(self) -> bool:
        return bool(self.flags & EXTERNAL)


def check_name(name: str) -> bytes:
    """The name's bytes, or an error that says what is wrong with it."""
    if not name:
        raise ArchiveError("empty name")
    try:
        raw = name.encode()
    except UnicodeEncodeError as e:
        raise ArchiveError("name cannot be encoded") from e
    if len(raw) > NAME_BYTES:
        raise ArchiveError("name too long")
    if bad := FORBIDDEN.intersection(name):
        raise ArchiveError(f"forbidden characters in name: {''.join(sorted(bad))}")
    return raw


class Writer:
    """Streams members to a binary file; metadata is held until the end. Refuses nothing silently."""

    def __init__(self, out: BinaryIO, external_prefix: str | None = None, big_file: int = BIG_FILE):
        self.out, self.prefix, self.big_file = out, external_prefix, big_file
        self.entries: list[tuple[bytes, int, int, int, int, int]] = []
        self.meta: list[bytes] = []
        self.meta_size = 0
        self.at = HEADER.size
        out.write(HEADER.pack(HEADER_MAGIC, VERSION, b"\0" * 7))

    def add(self, name: str, data: bytes, meta: dict | None = None, force_external: bool = False) -> str | None:
        """Add a member; returns the key under which the caller must store the data if it is external, else None."""
        raw = check_name(name)
        external = self.prefix is not None and (force_external or len(data) >= self.big_file)
        stored = dict(meta or {}) | {"size": len(data)}
        key = None
        if external:
            key = f"{self.prefix.rstrip('/')}/_bigFiles/{name}" if self.prefix else f"_bigFiles/{name}"
            stored |= {"is_external": True, "external_key": key}
        packed = json.dumps(stored, ensure_ascii=False, separators=(",", ":")).encode()
        if len(packed) > META_BYTES:
            raise ArchiveError("metadata too large")
        if external:
            self.entries.append((raw, 0, 0, self.meta_size, len(packed), EXTERNAL))
        else:
            self.out.write(data)
            self.entries.append((raw, self.at, len(data), self.meta_size, len(packed), 0))
            self.at += len(data)
        self.meta.append(packed)
        self.meta_size += len(packed)
        return key

    def finish(self) -> Footer:
        meta_start, index_start = self.at, self.at + self.meta_size
        size = 0
        for m in self.meta:
            self.out.write(m)
        for raw, offset, length, meta_at, meta_length, flags in self.entries:
            piece = NAME_LENGTH.pack(len(raw)) + raw + ENTRY.pack(offset, length, meta_start + meta_at, meta_length, flags)
            self.out.write(piece)
            size += len(piece)
        f = Footer(VERSION, HEADER.size, self.at - HEADER.size, meta_start, self.meta_size, index_start, size, len(self.entries))
        self.out.write(FOOTER.pack(FOOTER_MAGIC, VERSION, b"\0" * 7, f.data_start, f.data_length, f.meta_start, f.meta_length, f.index_start, f.index_length, f.file_count))
        return f


def parse_footer(raw: bytes, size: int) -> Footer:
    """The footer from an archive's last 72 bytes, fully checked against its size."""
    if size < MIN_SIZE or len(raw) < FOOTER.size:
        raise ArchiveError("file too small")
    magic, version, _, *numbers = FOOTER.unpack(raw[-FOOTER.size :])
    if magic != FOOTER_MAGIC:
        raise ArchiveError("invalid footer magic")
    if version != VERSION:
        raise ArchiveError(f"unsupported version {version}")
    f = Footer(version, *numbers)
    if f.file_count >= 1 << 63 or f.file_count * (NAME_LENGTH.size + 1 + ENTRY.size) > size:
        raise ArchiveError("invalid file_count")
    end = size - FOOTER.size
    for name, start, length in (("data", f.data_start, f.data_length), ("meta", f.meta_start, f.meta_length), ("index", f.index_start, f.index_length)):
        if start > end:
            raise ArchiveError(f"{name} start exceeds file size")
        if start < HEADER.size:
            raise ArchiveError(f"{name} overlaps header")
    for a, b, stop, start in (("data", "meta", f.data_start + f.data_length, f.meta_start), ("meta", "index", f.meta_start + f.meta_length, f.index_start), ("index", "footer", f.index_start + f.index_length, end)):
        if stop > start:
            raise ArchiveError(f"{a} overlaps {b}")
    if f.index_length < f.file_count * (NAME_LENGTH.size + 1 + ENTRY.size):
        raise ArchiveError("index too small for file_count")
    return f


def check_header(raw: bytes) -> None:
    if len(raw) < HEADER.size or raw[:8] != HEADER_MAGIC:
        raise ArchiveError("invalid header magic")
    if raw[8] != VERSION:
        raise ArchiveError(f"unsupported version {raw[8]}")


def parse_index(raw: bytes, count: int) -> Iterator[Entry]:
    """Entries in the order they were added; names may repeat."""
    at = 0
    for _ in range(count):
        if at + NAME_LENGTH.size > len(raw):
            raise ArchiveError("index truncated at a name's length")
        (n,) = NAME_LENGTH.unpack_from(raw, at)
        at += NAME_LENGTH.size
        if at + n > len(raw):
            raise ArchiveError("index truncated in a name")
        name = raw[at : at + n].decode()
        at += n
        if at + ENTRY.size > len(raw):
            raise ArchiveError("index truncated in an entry")
        yield Entry(name, *ENTRY.unpack_from(raw, at))
        at += ENTRY.size


def last_wins(entries: Iterable[Entry]) -> dict[str, Entry]:
    return {e.name: e for e in entries}


def merged_ranges(spans: list[tuple[int, int]], max_gap: int) -> list[tuple[int, int]]:
    """Start and end of the reads that cover (offset, length) spans, bridging gaps of up to ``max_gap`` bytes."""
    out: list[list[int]] = []
    for offset, length in sorted(s for s in spans if s[1]):
        if out and offset - out[-1][1] <= max_gap:
            out[-1][1] = max(out[-1][1], offset + length)
        else:
            out.append([offset, offset + length])
    return [(a, b) for a, b in out]
