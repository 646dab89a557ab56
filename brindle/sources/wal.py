"""Frames of SQLite write-ahead logs, by the public file format.

A log is read where its file is: `binaryFile` gives the bytes, and each file is walked in one task,
since every frame's checksum continues that of the frame before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, frame_no long, page_no long, db_size long, data binary"
# The two magic numbers (checksums in little and in big endian words) and the sizes of both headers.
LITTLE, BIG = 0x377F0682, 0x377F0683
HEADER, FRAME = 32, 24


def checksum(data: bytes, big: bool, s0: int, s1: int) -> tuple[int, int]:
    words = struct.unpack(f"{'>' if big else '<'}{len(data) // 4}I", data)
    for k in range(0, len(words), 2):
        s0 = (s0 + words[k] + s1) & 0xFFFFFFFF
        s1 = (s1 + words[k + 1] + s0) & 0xFFFFFFFF
    return s0, s1


def frames(log: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(frame_no, page_no, db_size, data) of committed frames: up to the last commit before a foreign salt or a wrong checksum."""
    if len(log) < HEADER:
        return
    magic, _, page_size, _, salt0, salt1, c0, c1 = struct.unpack(">8I", log[:HEADER])
    if magic not in (LITTLE, BIG) or checksum(log[:24], magic == BIG, 0, 0) != (c0, c1):
        return
    waiting: list[tuple[int, int, int, bytes]] = []
    at, number = HEADER, 0
    while at + FRAME + page_size <= len(log):
        page, size, f0, f1, k0, k1 = struct.unpack(">6I", log[at : at + FRAME])
        data = log[at + FRAME : at + FRAME + page_size]
        c0, c1 = checksum(log[at : at + 8] + data, magic == BIG, c0, c1)
        if (f0, f1) != (salt0, salt1) or (k0, k1) != (c0, c1):
            return
        number += 1
        waiting.append((number, page, size, data))
        if size:
            yield from waiting
            waiting = []
        at += FRAME + page_size


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Committed frames of all logs under a path."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                rows = [(row.path, *f) for f in frames(bytes(row.content))]
                yield pd.DataFrame(rows, columns=["path", "frame_no", "page_no", "db_size", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
