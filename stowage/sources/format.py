"""The archive format in bytes: header, index entries and footer."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from stowage.functions import blake3
from stowage.functions.errors import ArchiveError

# Magic numbers, sizes and the layouts of header, entry and footer.
MAGIC, CONFIRM = b"ark!\n", 0x4B52410A
HEADER, FOOTER, FIXED = 16, 64, 79
CHUNK = 2**20
LONGEST = 1023
HEAD = struct.Struct("<5sBBBBB6s")
ENTRY = struct.Struct("<BIIIQQQQ32sH")
TAIL = struct.Struct("<QQ32sII8s")
FILE, FOLDER, SYMLINK, HARDLINK = 1, 2, 3, 4
BLAKE3, SHA256 = 1, 2

HASHERS: dict[int, Callable] = {BLAKE3: blake3.Hasher, SHA256: hashlib.sha256}


def digest(algorithm: int, data: bytes) -> bytes:
    h = HASHERS[algorithm]()
    h.update(data)
    return h.digest()


@dataclass
class Member:
    """One index entry; times and sizes are unsigned as stored, ``mtime_ns`` is signed."""

    path: str
    type: int = FILE
    mode: int = 0o644
    uid: int = 0
    gid: int = 0
    mtime_ns: int = 0
    size_original: int = 0
    size_compressed: int = 0
    data_offset: int = 0
    hash: bytes = bytes(32)
    link: str = ""
    chunk_sizes: list[int] = field(default_factory=list)


def header(algorithm: int) -> bytes:
    return HEAD.pack(MAGIC, 1, 0, 0, 1, algorithm, bytes(6))


def entry(m: Member) -> bytes:
    path, link = m.path.encode(), m.link.encode()
    if not 0 < len(path) <= LONGEST:
        raise ArchiveError("USAGE", "a member's path has from 1 to 1,023 bytes", m.path)
    if (m.type in (SYMLINK, HARDLINK)) != bool(link) or len(link) > LONGEST:
        raise ArchiveError("USAGE", "links, and only they, have targets of 1 to 1,023 bytes", m.path)
    fixed = ENTRY.pack(m.type, m.mode & 0xFFFF, m.uid, m.gid, m.mtime_ns % 2**64, m.size_original, m.size_compressed, m.data_offset, m.hash, len(path))
    tail = struct.pack("<H", len(link)) + link if link else b""
    return fixed + path + tail + struct.pack(f"<I{len(m.chunk_sizes)}I", len(m.chunk_sizes), *m.chunk_sizes)


def footer(index_offset: int, length: int, index_hash: bytes, count: int) -> bytes:
    return TAIL.pack(index_offset, length, index_hash, count, CONFIRM, bytes(8))


def read_header(data: bytes) -> int:
    """The digest algorithm of a valid header."""
    if len(data) != HEADER:
        raise ArchiveError("FMT_TRUNCATED", "the header is not whole", stage=1)
    magic, major, _, flags, compression, algorithm, reserved = HEAD.unpack(data)
    for fine, code in (
        (magic == MAGIC, "FMT_MAGIC"), (major == 1, "FMT_VERSION"), (flags == 0, "FMT_RESERVED"),
        (compression == 1, "FMT_COMP_ALG"), (algorithm in HASHERS, "FMT_HASH_ALG"), (reserved == bytes(6), "FMT_RESERVED"),
    ):
        if not fine:
            raise ArchiveError(code, "invalid header", stage=1)
    return algorithm


def read_footer(data: bytes, file_size: int) -> tuple[int, int, bytes, int]:
    """Offset, size and digest of the index, and the number of members; the bounds come before the magic."""
    if len(data) != FOOTER or file_size < HEADER + FOOTER:
        raise ArchiveError("FMT_TRUNCATED", "the footer is not whole", stage=2)
    offset, size, index_hash, count, confirm, reserved = TAIL.unpack(data)
    if offset < HEADER or (size == 0 and offset != HEADER) or offset + size != file_size - FOOTER:
        raise ArchiveError("FMT_INDEX", "the index does not fill the file up to the footer", stage=2)
    if confirm != CONFIRM:
        raise ArchiveError("FMT_MAGIC", "the footer's magic number is wrong", stage=3)
    if reserved != bytes(8):
        raise ArchiveError("FMT_RESERVED", "the footer's reserved bytes are in use", stage=3)
    return offset, size, index_hash, count


def path_code(raw: bytes) -> str | None:
    """The code of the first rule that a member path breaks."""
    if not raw:
        return "FMT_INDEX"
    if len(raw) > LONGEST:
        return "PATH_TOO_LONG"
    if raw[:1] == b"/":
        return "PATH_ABSOLUTE"
    if raw[-1:] == b"/" or b"\0" in raw:
        return "FMT_INDEX"
    return _utf8_code(raw) or next(("PATH_TRAVERSAL" if c == b".." else "FMT_INDEX" for c in raw.split(b"/") if c in (b"", b".", b"..")), None)


def _utf8_code(raw: bytes) -> str | None:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return "PATH_ENCODING"
    return None


def target_code(raw: bytes) -> str | None:
    """The same for a symlink's target."""
    if not 0 < len(raw) <= LONGEST:
        return "FMT_INDEX"
    if raw[:1] == b"/":
        return "PATH_ABSOLUTE"
    if b"\0" in raw:
        return "FMT_INDEX"
    return _utf8_code(raw) or ("PATH_TRAVERSAL" if b".." in raw.split(b"/") else None)


def read_index(data: bytes, count: int, index_hash: bytes, algorithm: int, index_offset: int) -> list[Member]:
    """The members of an index whose entries and whose relations are all valid.

    A rule that is broken raises the error of the first one in this order: the count,
    the digest, every entry by itself, the bytes left over, then the relations.
    """
    if count > len(data) // (FIXED + 5):
        raise ArchiveError("FMT_INDEX", "more members than the index can hold", stage=4)
    if digest(algorithm, data) != index_hash:
        raise ArchiveError("HASH_INDEX", "the index does not have its digest", stage=5)
    at = 0

    def take(n: int, pos: int) -> bytes:
        nonlocal at
        if len(data) - at < n:
            raise ArchiveError("FMT_INDEX", "an entry passes the end of the index", stage=6, pos=pos)
        at += n
        return data[at - n : at]

    def check(fine: bool, code: str, message: str, pos: int, path: str = "", stage: int = 6) -> None:
        if not fine:
            raise ArchiveError(code, message, path, stage, pos)

    members = []
    for pos in range(count):
        kind, mode, uid, gid, mtime, original, compressed, offset, hashed, length = ENTRY.unpack(take(FIXED, pos))
        check(kind in (FILE, FOLDER, SYMLINK, HARDLINK), "FMT_MEMBER_TYPE", "unknown type", pos)
        check(length > 0, "FMT_INDEX", "empty path", pos)
        check(length <= LONGEST, "PATH_TOO_LONG", "long path", pos)
        raw = take(length, pos)
        code = path_code(raw)
        check(code is None, code or "", "invalid path", pos, raw.decode(errors="replace"))
        path, link = raw.decode(), b""
        if kind in (SYMLINK, HARDLINK):
            size = struct.unpack("<H", take(2, pos))[0]
            check(0 < size <= LONGEST, "FMT_INDEX", "length of a link's target", pos, path)
            link = take(size, pos)
            code = target_code(link) if kind == SYMLINK else path_code(link)
            check(code is None, code or "", "invalid link target", pos, path)
        chunks = struct.unpack("<I", take(4, pos))[0]
        if kind != FILE or original == 0:
            check(not (original or compressed or offset or chunks), "FMT_INDEX", "numbers of a member without data", pos, path)
        else:
            check(chunks == -(-original // CHUNK), "FMT_INDEX", "number of chunks", pos, path)
        sizes = list(struct.unpack(f"<{chunks}I", take(4 * chunks, pos)))
        if kind == FILE and original:
            check(sum(sizes) == compressed, "FMT_INDEX", "sum of the chunks", pos, path)
            check(offset >= HEADER and offset + compressed <= index_offset, "FMT_INDEX", "place of the data", pos, path)
        members.append(Member(path, kind, mode, uid, gid, mtime - 2**64 if mtime >= 2**63 else mtime, original, compressed, offset, hashed, link.decode(), sizes))
    check(at == len(data), "FMT_INDEX", "bytes after the last entry", -1)
    _read_relations(members, index_offset, algorithm)
    return members


def _read_relations(members: list[Member], index_offset: int, algorithm: int) -> None:
    def fail(stage: int, pos: int, message: str, code: str = "FMT_INDEX") -> None:
        raise ArchiveError(code, message, members[pos].path if pos >= 0 else "", stage, pos)

    first: dict[str, int] = {}
    twice = []
    for pos, m in enumerate(members):
        if m.path in first:
            twice.append(pos)
        else:
            first[m.path] = pos
    for pos, m in enumerate(members):
        if m.type == HARDLINK and not first.get(m.link, pos) < pos:
            fail(7, pos, "a hard link's target must come before it")
    if twice:
        fail(8, twice[0], "a path occurs twice")
    for pos, m in enumerate(members):
        names = m.path.split("/")
        for depth in range(1, len(names)):
            up = first.get("/".join(names[:depth]), pos)
            if up >= pos or members[up].type != FOLDER:
                fail(9, pos, "every folder above a member must come before it")
    ranges = sorted(((m.data_offset, m.data_offset + m.size_compressed, pos) for pos, m in enumerate(members) if m.type == FILE and m.size_original), key=lambda r: (r[0], -r[1]))
    for (_, end, _), (start, _, pos) in zip(ranges, ranges[1:], strict=False):
        if start < end:
            fail(13, pos, "data overlaps")
    for pos, m in enumerate(members):
        if m.type == HARDLINK and members[first[m.link]].type != FILE:
            fail(14, pos, "a hard link's target must be a file")
    ends = [HEADER, *(r[1] for r in ranges)]
    starts = [*(r[0] for r in ranges), index_offset]
    for end, start in zip(ends, starts, strict=True):
        if start != end:
            fail(15, -1, "a gap in the data")
    empty = digest(algorithm, b"")
    for pos, m in enumerate(members):
        if (m.type != FILE or m.size_original == 0) and m.hash != empty:
            fail(16, pos, "the digest of no data", "HASH_MEMBER")
