"""Large files in segments of whole lines, so that one file is many rows and many tasks.

A segment begins at the first line that begins at or behind its place in the file and ends where
the next one begins. It comes with the text behind it up to a bound, which a search that starts
in the segment may read. Lines are not cut: a segment with a very long line is longer.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths, text
from lintlake.sources.tree import _absolute, _is_uri

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a segment, and of the text behind it that comes with it.
SEGMENT = 16 * 1024 * 1024
BEHIND = 256 * 1024
_READ = 1 << 16

_SEGMENT = "path string, segment bigint, own binary, behind binary, is_last boolean"
_ARROW = pa.schema([
    ("path", pa.string()), ("segment", pa.int64()), ("own", pa.binary()), ("behind", pa.binary()), ("is_last", pa.bool_()),
])


def _seeking(root: str) -> Callable[[str], BinaryIO]:
    """How to open a path below the root for reading from any place, on an executor."""
    if _is_uri(root):
        system, base = fs.FileSystem.from_uri(root)
        return lambda path: system.open_input_file(f"{base}/{path}" if path else base)
    return lambda path: open(f"{root}/{path}" if path else root, "rb")


def _line_start(file: BinaryIO, at: int) -> int | None:
    """The first place from `at` on where a line begins, None if there is no further line.

    A line ends in a newline, a carriage return or both.
    """
    if at == 0:
        return 0
    file.seek(at - 1)
    place, held = at - 1, file.read(_READ)
    while held:
        more = file.read(_READ)
        for end, byte in enumerate(held):
            if byte == 10 or byte == 13 and (held[end + 1 : end + 2] or more[:1]) != b"\n":
                begin = place + end + 1
                return begin if end + 1 < len(held) or more else None
        place, held = place + len(held), more
    return None


def _cut(file: BinaryIO, path: str, segment: int, size: int, behind: int) -> dict | None:
    """One segment's row, None where no line begins in its stretch of the file."""
    begin, following = _line_start(file, segment * size), _line_start(file, (segment + 1) * size)
    if begin is None or begin == following:
        return None
    file.seek(begin)
    own = file.read() if following is None else file.read(following - begin)
    rest = b"" if following is None else file.read(behind + 1)
    if is_last := len(rest) <= behind:
        kept = len(rest)
    else:
        kept = _whole_characters(rest[:behind])
    return {"path": path, "segment": segment, "own": own, "behind": rest[:kept], "is_last": is_last}


def _whole_characters(data: bytes) -> int:
    """How many bytes are left without a last character that may have been cut."""
    for back in range(1, min(4, len(data)) + 1):
        if data[-back] < 0x80:
            return len(data) - back + 1
        if data[-back] >= 0xC0:
            return len(data) - back
    return len(data)


def read_segments(
    listing: DataFrame, root: str, size: int = SEGMENT, behind: int = BEHIND
) -> DataFrame:
    """(path, segment, language, own, behind, is_last): the listed files' lines in segments.

    `listing` has path and size. `is_last` says that the text behind a segment reaches the
    file's end. Texts are decoded and their newlines unified. A segment in whose stretch no line
    begins is left out. A file that cannot be read fails the job.
    """
    root = _absolute(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _seeking(root)
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    made = _cut(file, row["path"], row["segment"], size, behind)
                if made is not None:
                    yield pa.RecordBatch.from_pylist([made], _ARROW)

    last = F.greatest(F.floor((F.col("size") - 1) / size), F.lit(0)).cast("bigint")
    places = listing.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("segment"))
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cores = listing.sparkSession.sparkContext.defaultParallelism
    dealt = places.repartition(max(4 * cores, -(-total // SEGMENT)))
    # A byte that is no part of a character stays within its line, so parts can be decoded alone.
    return dealt.mapInArrow(read, _SEGMENT).select(
        "path",
        "segment",
        paths.detect_language(F.col("path")).alias("language"),
        text.decode_text(F.col("own")).alias("own"),
        text.decode_text(F.col("behind")).alias("behind"),
        "is_last",
    )
