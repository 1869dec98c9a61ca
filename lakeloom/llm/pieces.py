"""Splitting oversized texts at natural boundaries.

Cuts are chosen by dynamic programming over the boundary positions of a text:
the cost of a piece is the penalty of the boundary that ends it plus the square
of its relative distance from the even size, and no piece may exceed the limit.
Each piece after the first begins with the last ``overlap`` bytes before its
cut (fewer where a character would be split), so pieces without their overlaps
are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 5120, 256

#: Boundary kinds from the best to the worst, and what a cut there costs.
PENALTY = {"definition": 0.0, "paragraph": 0.5, "line": 1.5, "sentence": 3.0, "word": 6.0, "character": 20.0}
#: What one more piece costs.
PIECE = 4.0
#: Weight of the square of a piece's distance from the even size.
BALANCE = 2.0

_DEFINITION = re.compile(
    rb"\n(?=(?:[ \t]*(?:@|///|/\*\*|#\[))|[ \t]*(?:export |public |private |protected |internal |static |pub(?:\([a-z]+\))? |async |abstract |final |default )*"
    rb"(?:def|class|fn|func|function|impl|struct|enum|trait|interface|type|mod|module|namespace|void|resource|section)\b|#{1,6} )"
)
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n+")
_LINE = re.compile(rb"\n")
_SENTENCE = re.compile(rb"[.!?;](?=[ \t])[ \t]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")
_WORD = re.compile(rb"[ \t]+|[,;:(){}\[\]<>=&|/]")


def boundaries(data: bytes, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties), ascending, with a position in every ``room`` bytes.

    Words and characters are looked up only in stretches that have no better
    boundary within a quarter of ``room``.
    """
    n = len(data)
    best: dict[int, float] = {}

    def add(pattern: re.Pattern, kind: str, lo: int = 0, hi: int = n, at_end: bool = True) -> None:
        p = PENALTY[kind]
        for m in pattern.finditer(data, lo, hi):
            at = m.end()
            if 0 < at < n and best.get(at, 99.0) > p:
                best[at] = p

    add(_DEFINITION, "definition")
    add(_PARAGRAPH, "paragraph")
    add(_LINE, "line")
    for pattern, kind in ((_SENTENCE, "sentence"), (_WORD, "word")):
        at = [0, *sorted(best), n]
        for lo, hi in zip(at, at[1:]):
            if hi - lo > room // 4:
                add(pattern, kind, lo, hi)
    at = [0, *sorted(best), n]
    for lo, hi in zip(at, at[1:]):
        if hi - lo > room // 4:
            step = max(1, room // 8)
            for c in range(lo + step, hi, step):
                while c > lo and data[c] & 0xC0 == 0x80:
                    c -= 1
                if c > lo:
                    best.setdefault(c, PENALTY["character"])
    pos = np.array([*sorted(best), n], dtype=np.int64)
    return pos, np.array([*(best[p] for p in sorted(best)), 0.0])


def overlap_start(data: bytes, cut: int, overlap: int) -> int:
    """Where the overlap before ``cut`` begins, moved forward to a whole character."""
    at = max(0, cut - overlap)
    while at < cut and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def cuts(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """End positions of the pieces of a text that is longer than ``limit``."""
    if not 0 <= overlap <= limit // 2 or limit < 16:
        raise ValueError("the overlap must be at most half of the limit, and the limit 16 bytes or more")
    n, room = len(data), limit - overlap
    pos, pen = boundaries(data, room)
    even = min(room, n / -(-n // room))
    starts = np.concatenate(([0], pos))
    size = len(starts)
    cost = np.full(size, np.inf)
    cost[0] = 0.0
    back = np.zeros(size, dtype=np.int64)
    low = np.searchsorted(starts, starts - room, side="left")
    first = int(np.searchsorted(starts, limit, side="right"))  # reachable as the first piece
    for i in range(1, size):
        lo = int(low[i])
        length = starts[i] - starts[lo:i]
        c = cost[lo:i] + BALANCE * ((length - even) / even) ** 2
        k = int(np.argmin(c)) if lo < i else -1
        value, prev = (c[k], lo + k) if k >= 0 else (np.inf, 0)
        if i < first and lo > 0:  # the first piece has no overlap and may fill the limit
            alone = BALANCE * ((starts[i] - even) / even) ** 2
            if alone < value:
                value, prev = alone, 0
        cost[i], back[i] = value + PIECE + pen[i - 1], prev
    ends, i = [], size - 1
    while i > 0:
        ends.append(int(starts[i]))
        i = int(back[i])
    return ends[::-1]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start byte of the new part, end byte, piece) of each piece in order."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return [(0, len(data), text)]
    out, last = [], 0
    for end in cuts(data, limit, overlap):
        out.append((last, end, data[overlap_start(data, last, overlap) if last else 0 : end].decode("utf-8", "surrogatepass")))
        last = end
    return out


SCHEMA = "source_table string, id string, piece_no int, n_pieces int, start_byte long, end_byte long, piece string"


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each distinct (source_table, id) of ``items`` whose content is over ``limit``.

    Null contents and contents within the limit have no pieces here: they stay
    as they are.  Repeated rows of an id are one item.  The size test runs in
    the JVM, so only oversized texts reach Python.
    """
    over = items.where(F.octet_length("content") > limit).select("source_table", "id", "content")
    over = over.groupBy("source_table", "id").agg(F.first("content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, key, text in zip(b["source_table"].to_pylist(), b["id"].to_pylist(), b["content"].to_pylist()):
                rows = pieces(text, limit, overlap)
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([table] * k), pa.array([key] * k, pa.string()), pa.array(range(1, k + 1), pa.int32()), pa.array([k] * k, pa.int32()),
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]),
                    ],
                    ["source_table", "id", "piece_no", "n_pieces", "start_byte", "end_byte", "piece"],
                )

    return over.mapInArrow(run, SCHEMA)


def contents(chunks: DataFrame, large_chunks: DataFrame) -> DataFrame:
    """(source_table, id, content) of both tables."""
    parts = [df.select(F.lit(name).alias("source_table"), "id", "content") for name, df in (("chunks", chunks), ("large_chunks", large_chunks))]
    return parts[0].unionByName(parts[1])
