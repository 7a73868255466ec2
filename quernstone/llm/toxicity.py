"""Toxicity by compression distance.

Two zstandard dictionaries are trained: an ordinary one, of ordinary text, and a toxic one, which holds the same
ordinary text and after it the segments that toxic texts have and ordinary ones lack. A window that the toxic
dictionary shortens by more bytes than the ordinary one is closer to toxic text. A logistic calibration on labelled
rows turns a text's window differences into a score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Bounds of what is learned from: toxic and ordinary rows, characters of each.
TOXIC_ROWS, ORDINARY_ROWS, ROW_CHARS = 1_500, 4_000, 4_000
#: Bytes of the pieces that segments are made of: short ones, and longer ones for languages in which short ones are
#: common; bytes of the toxic segments and of the ordinary text.
PIECES, TOXIC_BYTES, ORDINARY_BYTES = (5, 6, 7), 440, 30_000
#: A piece is toxic if toxic texts hold it so many times as often, and by so many standard deviations more.
TIMES, SIGMAS = 40, 10
#: Bytes of a window, and of the next one that it also sees.
WINDOW, OVERLAP = 64, 16
#: Bytes saved from which a window counts as close, as very close.
CLOSE, VERY_CLOSE = 3, 5


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def pieces(data: bytes, size: int) -> np.ndarray:
    """The bytes of every piece as one number, by place."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - size + 1), np.uint64)
    for j in range(size if len(out) else 0):
        out = out << np.uint64(8) | a[j : j + len(out)]
    return out


def telling_pieces(toxic: list[bytes], ordinary: list[bytes], size: int) -> dict[int, float]:
    """Pieces that set toxic texts apart, by their worth. Ordinary texts count only what toxic ones hold."""
    if not toxic:
        return {}
    found, n = np.unique(np.concatenate([np.unique(pieces(x, size)) for x in toxic]), return_counts=True)
    found, n = found[n > SIGMAS], n[n > SIGMAS]
    usual = np.zeros(len(found))
    for x in ordinary if len(found) else []:
        own = np.unique(pieces(x, size))
        at = np.minimum(np.searchsorted(found, own), len(found) - 1)
        usual[at[found[at] == own]] += 1
    expected = (usual + 0.5) / max(1, len(ordinary)) * len(toxic)
    sigmas = (n - expected) / np.sqrt(expected + 1)
    good = (n >= TIMES * expected) & (sigmas > SIGMAS)
    return dict(zip(found[good].tolist(), sigmas[good].tolist()))


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Segments, the best last (nearest to the window), that cover the pieces which set toxic texts apart."""
    worth: dict[tuple[int, int], float] = {}
    for k in PIECES:  # a longer piece counts where no shorter one inside of it does
        inner = lambda p: ((j, p >> 8 * i & (1 << 8 * j) - 1) for j in PIECES if j < k for i in range(k - j + 1))  # noqa: B023, E731
        worth |= {(k, p): w for p, w in telling_pieces(toxic, ordinary, k).items() if worth.keys().isdisjoint(inner(p))}
    known = {k: np.array([p for j, p in worth if j == k], np.uint64) for k in PIECES}
    runs: set[bytes] = set()
    for x in toxic:
        inside = np.zeros(len(x) + 1, bool)
        for k in PIECES:
            for i in np.flatnonzero(np.isin(pieces(x, k), known[k])):
                inside[i : i + k] = True
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        runs.update(x[i:j] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()))
    held = {s: [(k, p) for k in PIECES for p in set(pieces(s, k).tolist())] for s in runs}
    gain = lambda s: sum(left.get(p, 0.0) for p in held[s])
    left, out, size = dict(worth), [], 0
    queue = [(-gain(s), s) for s in runs]
    heapq.heapify(queue)
    while queue and size < TOXIC_BYTES:
        _, s = heapq.heappop(queue)
        now = gain(s)
        if now <= 0:
            continue
        if queue and now < -queue[0][0]:
            heapq.heappush(queue, (-now, s))
            continue
        out.append(s)
        size += len(s)
        for p in held[s]:
            left.pop(p, None)
    return b"\0".join(reversed(out))


@lru_cache(maxsize=2)  # of the current model; workers outlive a job
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=how)


def features(text: str, ordinary: bytes, toxic: bytes) -> tuple[float, ...]:
    data = text.lower().encode()
    a, b = compressor(ordinary).compress, compressor(toxic).compress
    saved = [len(a(w)) - len(b(w)) for w in (data[i : i + WINDOW + OVERLAP] for i in range(0, len(data), WINDOW))] or [0]
    close, very = (sum(s >= least for s in saved) for least in (CLOSE, VERY_CLOSE))
    top = sorted(saved, reverse=True)[:2]
    return 1.0, top[0] / 4, (top[1] if len(top) > 1 else 0) / 4, 10 * close / len(saved), 10 * very / len(saved), math.log(len(saved))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out: those with the smallest id hashes of
    each class. A document with several labels counts as toxic if one of them says so."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    spread = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic"), min(1.0, TOXIC_ROWS / counts.get(True, 1))).otherwise(min(1.0, ORDINARY_ROWS / counts.get(False, 1)))
    drawn = F.broadcast(known.where(spread < share))  # about TOXIC_ROWS + ORDINARY_ROWS ids by construction
    rows = docs.select(F.col(id_col).alias("id"), F.substring(text_col, 1, ROW_CHARS).alias("text")).join(drawn, "id").where(F.length("text") > 0).collect()
    rows.sort(key=lambda r: (r.id, r.text))
    low = [(r.toxic, r.text.lower().encode()) for r in rows]
    ordinary = b" ".join(x[:400] for t, x in low if not t)[:ORDINARY_BYTES] + b" "
    toxic = ordinary + toxic_segments([x for t, x in low if t], [x for t, x in low if not t])
    if not rows:
        return Model(ordinary, toxic, (-3.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    x = np.array([features(r.text, ordinary, toxic) for r in rows])
    return Model(ordinary, toxic, tuple(fit_logistic(x, np.array([r.toxic for r in rows], float)).tolist()))


def score(texts: list[str], model: Model) -> list[float]:
    w = np.array(model.weights)
    return [float(1 / (1 + np.exp(-np.clip(np.dot(w, features(x, model.ordinary, model.toxic)), -30, 30)))) for x in texts]


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A null text counts as empty, and an empty text gets the score of a text without a close window. With no labelled
    rows every text gets one low score. Repeated rows each get their row; a null id stays null and counts as held
    out. Very long texts are scored window by window and the closest window counts; equal ones score the same, so ties
    decide nothing; an empty table gives no rows. No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(score(b.column(2).to_pylist(), model), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), s], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
