"""Error codes of the archive format and the exit class of each."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, functions as F

# The codes by exit class, 1 usage, 2 input and output, 3 format, 4 integrity, 5 security, 6 modified.
CODES = {
    1: ("USAGE",),
    2: (
        "IO_READ", "IO_WRITE", "IO_SEEK", "IO_OPEN", "IO_FSYNC", "IO_COMMIT", "IO_MKDIR", "IO_SYMLINK",
        "IO_LINK", "IO_CHMOD", "IO_CHOWN", "IO_UTIMES", "IO_ALLOC",
    ),
    3: (
        "FMT_MAGIC", "FMT_VERSION", "FMT_COMP_ALG", "FMT_HASH_ALG", "FMT_RESERVED", "FMT_INDEX",
        "FMT_MEMBER_TYPE", "FMT_TRUNCATED", "FMT_DATA",
    ),
    4: ("HASH_INDEX", "HASH_MEMBER"),
    5: ("PATH_TRAVERSAL", "PATH_TOO_LONG", "PATH_ABSOLUTE", "PATH_ENCODING"),
    6: ("MODIFIED",),
}
EXIT = {code: number for number, codes in CODES.items() for code in codes}


_ALL = "; all: "


class ArchiveError(Exception):
    """A failure with its code, the check that found it, the path it is about, and all paths where there are several.

    Its text names all paths too, as they would be lost on the way from a task otherwise.
    """

    def __init__(self, code: str, message: str, path: str = "", stage: int = 0, pos: int = -1, paths: tuple[str, ...] = ()) -> None:
        several = f"{_ALL}{json.dumps(paths)}" if len(paths) > 1 else ""
        super().__init__(f"{code}: {message}" + (f": {path}" if path else "") + several)
        self.code, self.message, self.path, self.stage, self.pos = code, message, path, stage, pos
        self.exit, self.paths = EXIT.get(code, 1), paths or ((path,) if path else ())


_TOLD = re.compile(r"ArchiveError: ([A-Z_]+): (.*)")


@contextmanager
def from_tasks() -> Iterator[None]:
    """Give back as itself an ArchiveError that was raised in a task and comes wrapped by Spark."""
    try:
        yield
    except PySparkException as e:
        told = _TOLD.search(str(e))
        if told is None or told[1] not in EXIT:
            raise
        message, _, path = told[2].partition(": ")
        path, several, paths = path.partition(_ALL)
        raise ArchiveError(told[1], message, path, paths=tuple(json.loads(paths)) if several else ()) from e


def exit_class(code: Column) -> Column:
    """The exit class of a code; an unknown code counts as usage, a null one stays null."""
    table = F.create_map(*[F.lit(x) for pair in EXIT.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(table, code), F.lit(1)).cast("int"))
