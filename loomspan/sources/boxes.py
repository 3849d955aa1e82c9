"""Frame counts of videos from their box headers alone.

A container is boxes of a size, a kind and a content that may be boxes again. The count
of the first video track's samples stands in one of three tables; nothing is decoded and
the content of other boxes is passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BoxError(ValueError):
    """Why a file has no frame count."""


def boxes(data: bytes | memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin of the content, end) of the boxes between two places. A size of 1 is followed by one of 64 bits, one of 0 goes to the end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > len(data):
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise BoxError("invalid_box")
        yield kind, start + head, start + size
        start += size


def _inside(data: bytes | memoryview, span: tuple[int, int] | None, *kinds: bytes) -> tuple[int, int] | None:
    """The content of the first box of each kind inside the one before; None where one is missing."""
    for kind in kinds:
        if span is None:
            return None
        span = next(((a, b) for k, a, b in boxes(data, *span) if k == kind), None)
    return span


def frame_count(data: bytes | memoryview) -> int:
    """Samples of the first video track; BoxError if there are none."""
    if len(data) < 8:
        raise BoxError("no_container")
    movie = _inside(data, (0, len(data)), b"moov")
    if movie is None:
        raise BoxError("no_movie")
    for kind, *track in boxes(data, *movie):
        media = _inside(data, tuple(track), b"mdia") if kind == b"trak" else None
        handler = _inside(data, media, b"hdlr")
        if handler and handler[0] + 12 <= handler[1] and bytes(data[handler[0] + 8 : handler[0] + 12]) == b"vide":
            break
    else:
        raise BoxError("no_video_track")
    samples = _inside(data, media, b"minf", b"stbl")
    if samples is None:
        raise BoxError("no_sample_table")
    for kind in (b"stsz", b"stz2"):
        sizes = _inside(data, samples, kind)
        if sizes and sizes[0] + 12 <= sizes[1] and (n := struct.unpack_from(">I", data, sizes[0] + 8)[0]):
            return n
    times = _inside(data, samples, b"stts")
    if times and times[0] + 8 <= times[1]:
        runs = struct.unpack_from(">I", data, times[0] + 4)[0]
        if times[0] + 8 + 8 * runs > times[1]:
            raise BoxError("cut_time_table")
        if n := sum(struct.unpack_from(">" + "I4x" * runs, data, times[0] + 8)):
            return n
    raise BoxError("no_count")


def _counts(contents: pd.Series) -> pd.DataFrame:
    rows: list[tuple] = []
    for data in contents:
        try:
            rows.append((None, "no_container") if data is None else (frame_count(memoryview(data)), None))
        except BoxError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["frames", "reason"], dtype=object)


def frame_counts(content: Column) -> Column:
    """(frames, reason) of binary contents: the count, or why there is none. A null has no container."""
    return F.pandas_udf(_counts, "frames long, reason string")(content)


def read_frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, frames, reason) of every .mp4 file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(path)
    return files.select("path", frame_counts(F.col("content")).alias("c")).select("path", "c.*")


def synchronized(df: DataFrame, episode: list[str], frames: str) -> DataFrame:
    """(episode, frames): the least count of each episode's videos; null where one has none."""
    return df.groupBy(*episode).agg(F.when(F.count(frames) == F.count(F.lit(1)), F.min(frames)).alias("frames"))
