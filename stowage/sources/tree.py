"""Folders as a data source, one partition for each entry of the root, and the sink that extracts an archive."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stowage.functions.errors import ArchiveError
from stowage.sources import format as fmt

ENTRIES = "root string, abs_path string, member_path string, kind string, dev long, ino long, nlink long, mode long, uid long, gid long, size long, mtime_ns long, link_target string"
FARTHEST = 9_223_372_036 * 10**9 + 10**9 - 1


def _kind(mode: int) -> str:
    for name, test in (("dir", stat.S_ISDIR), ("file", stat.S_ISREG), ("symlink", stat.S_ISLNK)):
        if test(mode):
            return name
    return "special"


def entry_row(root: str, path: str, member: str) -> tuple:
    s = os.lstat(path)
    kind = _kind(s.st_mode)
    if abs(s.st_mtime_ns) > FARTHEST:
        raise ArchiveError("USAGE", "a time beyond what nanoseconds in 64 bits hold", path)
    target = os.readlink(path) if kind == "symlink" else ""
    return root, path, member, kind, s.st_dev, s.st_ino, s.st_nlink, s.st_mode & 0xFFFF, s.st_uid, s.st_gid, s.st_size, s.st_mtime_ns, target


def walk(root: str, path: str, member: str, device: int) -> Iterator[tuple]:
    """An entry and all below it, at any depth, names in byte order; links are not followed.

    A folder of another device has the kind ``mount``, and nothing below it is an entry.
    """
    ahead = [(path, member)]
    while ahead:
        path, member = ahead.pop()
        row = entry_row(root, path, member)
        if row[3] != "dir":
            yield row
        elif row[4] != device:
            yield (*row[:3], "mount", *row[4:])
        else:
            yield row
            names = sorted(os.listdir(path), key=os.fsencode, reverse=True)
            ahead += [(os.path.join(path, name), f"{member}/{name}") for name in names]


@dataclass
class TreePart(InputPartition):
    root: str
    path: str
    member: str
    device: int


class TreeReader(DataSourceReader):
    """The root itself is no entry; a root that is a file is one, under its last name."""

    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [os.path.realpath(p) for p in options.get("paths", options.get("path", "")).split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        parts = []
        for root in self.roots:
            s = os.lstat(root)
            if stat.S_ISDIR(s.st_mode):
                parts += [TreePart(root, os.path.join(root, n), n, s.st_dev) for n in sorted(os.listdir(root), key=os.fsencode)]
            else:
                parts.append(TreePart(root, root, os.path.basename(root), s.st_dev))
        return parts

    def read(self, part: TreePart) -> Iterator[tuple]:
        return walk(part.root, part.path, part.member, part.device)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stowage_tree"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TreeReader(self.options)


def _own(target: str | int, m: fmt.Member) -> None:
    """Give what was made to the member's owner and group, as only root may."""
    if os.geteuid() == 0:
        os.chown(target, m.uid, m.gid, follow_symlinks=isinstance(target, int))


class Extraction:
    """Creates members in order below a folder; what it made goes again if it fails.

    Without ``overwrite`` nothing may exist yet. With it, a folder takes the place of a
    folder, and anything but a folder the place of anything but a folder.
    """

    def __init__(self, dest: str, overwrite: bool = False) -> None:
        self.dest, self.overwrite = os.path.realpath(dest), overwrite
        self.made: list[str] = []
        self.folders: list[tuple[str, fmt.Member]] = []

    def place(self, path: str) -> str:
        """The place of a member; no folder on the way may be a link."""
        now = self.dest
        names = path.split("/")
        for name in names[:-1]:
            now = os.path.join(now, name)
            try:
                s = os.lstat(now)
            except FileNotFoundError:
                os.mkdir(now, 0o700)
                self.made.append(now)
                continue
            if not stat.S_ISDIR(s.st_mode):
                raise ArchiveError("IO_MKDIR", "something that is no folder is in the way", path)
        return os.path.join(now, names[-1])

    def _room(self, target: str, m: fmt.Member) -> bool:
        """Make room; true if a folder is there to be used again."""
        try:
            there = os.lstat(target)
        except FileNotFoundError:
            return False
        if not self.overwrite:
            raise ArchiveError("IO_OPEN", "it exists already", m.path)
        old, new = stat.S_ISDIR(there.st_mode), m.type == fmt.FOLDER
        if old and new:
            return True
        if old or new:
            raise ArchiveError("IO_OPEN", "a folder and something else can't replace each other", m.path)
        os.unlink(target)
        return False

    def create(self, m: fmt.Member, pieces: Iterable[bytes]) -> None:
        target = self.place(m.path)
        if self._room(target, m):
            self.folders.append((target, m))
            return
        if m.type == fmt.FOLDER:
            os.mkdir(target, 0o700)
            self.folders.append((target, m))
        elif m.type == fmt.SYMLINK:
            os.symlink(m.link, target)
            _own(target, m)
            os.utime(target, ns=(m.mtime_ns, m.mtime_ns), follow_symlinks=False)
        elif m.type == fmt.HARDLINK:
            os.link(self.place(m.link), target, follow_symlinks=False)
        else:
            fd = os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600)
            self.made.append(target)
            with os.fdopen(fd, "wb") as f:
                for piece in pieces:
                    f.write(piece)
                _own(f.fileno(), m)
                os.fchmod(f.fileno(), m.mode & 0o777)
            os.utime(target, ns=(m.mtime_ns, m.mtime_ns))
            return
        self.made.append(target)

    def finish(self) -> None:
        """Modes and times of folders, the deepest first, once nothing is put into them any more."""
        for target, m in reversed(self.folders):
            _own(target, m)
            os.chmod(target, m.mode & 0o777)
            os.utime(target, ns=(m.mtime_ns, m.mtime_ns))

    def undo(self) -> None:
        for target in reversed(self.made):
            try:
                os.rmdir(target) if os.path.isdir(target) and not os.path.islink(target) else os.unlink(target)
            except OSError:
                continue
