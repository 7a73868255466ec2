"""Quality rules: base text statistics and zstandard compression bands.

A text is rejected when its compression ratio, over the whole text or over more than half of its fixed chunks,
leaves the band for its length: above it the text repeats itself, below it the text is close to random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes from which a band holds; least and most ratio of original to compressed size. Shorter texts pass.
BANDS = ((64, 0.5, 2.5), (256, 1.15, 2.6), (1024, 1.3, 2.8), (4096, 1.35, 3.0), (16384, 1.4, 3.3))
CHUNK, LEAST_CHUNK = 4096, 1024
LEVEL = 3
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8


def in_band(size: int, ratio: float) -> bool:
    found = [(low, high) for least, low, high in BANDS if size >= least]
    return not found or found[-1][0] <= ratio <= found[-1][1]


def compressed_well(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of its chunks outside their band, and whether both are as they should be."""
    if not data:
        return 0.0, 0.0, True
    ratio = len(data) / len(compressor.compress(data))
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    chunks = [c for c in chunks if len(c) >= LEAST_CHUNK]
    out = sum(not in_band(len(c), len(c) / len(compressor.compress(c))) for c in chunks)
    share = out / len(chunks) if chunks else 0.0
    return ratio, share, in_band(len(data), ratio) and share <= 0.5


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text the words inside windows of WINDOW words that occur in it twice or more. Windows are named by
    doubling, pairs of names of half the width, so equal names mean equal windows."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for ws in words for w in ws), np.int64)
    sizes = np.array([len(ws) for ws in words], np.int64)
    of = np.repeat(np.arange(len(words)), sizes)
    n, name, width = len(ids), ids, 1
    while width < WINDOW and n > width:
        pair = name[: n - width] * np.int64(n + 1) + name[width:n]
        _, name = np.unique(pair, return_inverse=True)
        n, width = n - width, 2 * width
    covered = np.zeros(len(ids), bool)
    if width == WINDOW and n > 0:
        inside = np.flatnonzero(of[:n] == of[WINDOW - 1 : WINDOW - 1 + n])
        _, key, count = np.unique(of[inside] * np.int64(n + 1) + name[inside], return_inverse=True, return_counts=True)
        edge = np.zeros(len(ids) + WINDOW, np.int64)
        twice = inside[count[key] > 1]
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        covered = np.cumsum(edge)[: len(ids)] > 0
    return np.bincount(of, covered, len(words)).astype(np.int64)


def measure(texts: list[str]) -> list[tuple]:
    compressor, out = zstandard.ZstdCompressor(level=LEVEL), []
    for begin, end in slices([len(x) for x in texts]):
        part = texts[begin:end]
        data = [x.encode() for x in part]
        words = [b.split() for b in data]  # of bytes: splits at just the six white characters above
        for x, b, ws, again in zip(part, data, words, repeated_words(words).tolist()):
            seen: set[bytes] = set()
            lines = [line for line in b.split(b"\n") if line.strip()]
            seen.update(lines)
            ratio, share, good = compressed_well(b, compressor)
            failed = len(ws) < 20 or 100 * again > 30 * len(ws)
            out.append((len(ws), len(x) - sum(map(x.count, WHITE)), sum(map(x.count, SYMBOLS)), len(lines) - len(seen), again, failed, not failed and good, ratio, share))
    return out


COLUMNS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("zstd_ratio", "double"), ("chunks_out", "double"))
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, zstd_ratio and chunks_out for every row of docs.

    A null text counts as empty: no words, so base_failed and not kept; its ratio is 0. Repeated rows each get their
    row, a null id stays null, other columns are not read. Very long texts are compressed whole and in chunks; there are
    no ties; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*measure(b.column(1).to_pylist()))) or [[] for _ in COLUMNS]
            arrays = [pa.array(x, ARROW[kind]) for x, (_, kind) in zip(found, COLUMNS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *[n for n, _ in COLUMNS]])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} {k}" for n, k in COLUMNS]]))
