"""Near-duplicate passages by compact windows.

A text is a sequence of tokens, overlapping runs of eight words (five would recur by chance in a large corpus). For
one hash function the Cartesian tree over the tokens' hash values has, for each node, the widest range in which it is the least: a compact window, which stands for all subsequences of
the range that contain the node and so have the same min-hash. Only ranges as long as a passage count, about 2/length
of all nodes. Windows of different documents that share a value are a group and are joined to the group's first
document, its head; overlapping aligned windows of all hash functions make one candidate, whose five-word shingles are compared.

A member that is not similar to its head may still share a passage with another member. In a small group they are
compared. Large groups go on without their head: whatever their members share with heads (a common line, say) is masked, and windows are formed anew over
what is left, so that the members meet by what sets their passages apart from the head. A round masks something in
each of its members, so the rounds end; no group's members are all paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, joined_ids, slices, stored
from .components import components

#: Words of a shingle and of the shortest passage; similarity of two passages' shingle sets.
SHINGLE, PASSAGE, SIMILAR = 5, 50, 0.8
#: Words of the tokens that are hashed; hash functions (7 at most), and how many must agree on a place. Comparing is
#: exact, so one is enough: with one word of 50 changed a function agrees with probability 0.69 at least, one of three
#: with 0.97, two of three with 0.77.
TOKEN, HASHES, AGREE = 8, 3, 1
#: Shingles of a tile, the unit in which texts are fetched for comparison; shingles fetched beyond a candidate (what a
#: passage around a window can reach, so that members of a group get the same masks); bytes of a shingle's hash.
TILE, SLACK, BYTES = 64, 46, 6
#: Pairs of windows aligned at once.
MOST_ALIGNED = 1 << 18
#: Tiles of pairs compared at once, and so fewer pairs than 1 << 16, which a key beside a shingle's hash can tell apart.
MOST_TILES = 1 << 12
#: Documents of a group whose open members are compared with each other at once, instead of going on without their head.
FEW = 32
#: The value of a masked shingle: no window is formed around it.
MASKED = (1 << 63) - 1
FACTOR = 0x9E3779B97F4A7C15


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """One hash of each `width` neighbours."""
    n = max(0, len(x) - width + 1)
    out = x[:n].copy()
    for i in range(1, width):
        out = mixed(out * np.uint64(FACTOR) + x[i : n + i])
    return out


def shingles_of(texts: pa.Array, width: int = SHINGLE, more: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of some texts, end to end, and their number in each text. With more, those of each run of
    so many shingles."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded, of = words.flatten().dictionary_encode(), np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
    known = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy()
    there = (pc.binary_length(coded.dictionary).to_numpy() > 0)[code]  # space around a text leaves an empty word
    hashes, of = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[code[there]], of[there]
    out = folded(folded(hashes, width), more)
    inside = of[: len(out)] == of[width + more - 2 :][: len(out)]
    return out[inside], np.bincount(of[: len(out)][inside], minlength=len(texts))


def shingles(text: str) -> np.ndarray:
    """The 64-bit hash of each shingle of a text, in order."""
    return shingles_of(pa.array([text]))[0]


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc and the number of words of each doc and text."""
    for b in batches:
        n = [len(x.encode().split()) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc", "n"])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def windowed(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over every `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = fold(out[: len(out) - step], out[step:])
        have += step
    return out


def compact_windows(values: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """first, node, last of every range of at least `length` values of which the node is the least; of equal ones each
    has the range in which it is the leftmost. A value 0 bounds all ranges and has none."""
    if len(values) < length:
        return []
    least = windowed(values, length, np.minimum)
    pad = np.zeros(length - 1, values.dtype)
    nodes = np.flatnonzero(windowed(np.concatenate([pad, least, pad]), length, np.maximum) == values)
    # whatever bounds the range of such a node is such a node too (or a 0), so the tree is built over these alone
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int, int]] = []  # value, first, node
    for at, v in zip(nodes.tolist(), values[nodes].tolist()):
        while stack and stack[-1][0] > v:
            _, first, node = stack.pop()
            if at - first >= length:
                out.append((first, node, at - 1))
        first = stack[-1][2] + 1 if stack else 0
        if not v:
            stack.clear()
        stack.append((v, first, at))
    for v, first, node in stack:
        if v and len(values) - first >= length:
            out.append((first, node, len(values) - 1))
    return out


class Powers:
    """Prefix sums by which the hash of any range of shingles is one subtraction."""

    inverse = pow(FACTOR, -1, 1 << 64)

    def __init__(self, x: np.ndarray):
        ones = np.full(len(x) + 1, FACTOR, np.uint64)
        ones[:1] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(ones)[:-1])])
        ones[1:] = self.inverse
        self.back = np.cumprod(ones)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin])


def window_rows(docs: DataFrame, length: int) -> DataFrame:
    """v (hash function and value), doc, l, c, r of compact windows; places are the numbers of tokens, and of the shingles
    that they begin with, and ranges reach no further than a passage (of `length` tokens) from the node. Of the windows of a document whose surroundings are equal, word for
    word, the first stands for all.

    docs: doc, text and, from the second round on, active (nodes of windows to go on with: only the shingles around
    them are used) and masked (ranges, begin and end, of shingles that are no nodes)."""
    again = "active" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            active, masked = (b.column(2).to_pylist(), b.column(3).to_pylist()) if again else (None, None)
            for begin, end in slices(pc.binary_length(texts).to_pylist()):
                values, counts = shingles_of(texts.slice(begin, end - begin), more=TOKEN - SHINGLE + 1)
                parts = np.split(values, np.cumsum(counts)[:-1])
                use = [i for i, p in enumerate(parts) if len(p) >= length]
                if not use:
                    continue
                zero = np.zeros(1, np.uint64)
                joined = np.concatenate([x for i in use for x in (zero, parts[i])] + [zero])
                starts = np.cumsum([0] + [len(parts[i]) + 1 for i in use])[:-1] + 1
                bounds, gone = np.zeros(len(joined), bool), np.zeros(len(joined), bool)
                if again:
                    bounds[:] = True
                    for i, s in zip(use, starts.tolist()):
                        for c in active[begin + i]:
                            bounds[s + max(0, c - length + 1) : s + min(c + length, len(parts[i]))] = False
                        for m in masked[begin + i] or ():
                            gone[s + m["b"] : s + max(m["b"], m["e"] - TOKEN + SHINGLE)] = True
                ends = np.append(starts[1:] - 1, len(joined) - 1)
                bounds[starts - 1] = bounds[-1] = True
                around, found = Powers(joined), []
                for j in range(HASHES):
                    v = mixed(joined ^ np.uint64((j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) & np.uint64((1 << 63) - 8) | np.uint64(j + 8)
                    v[gone] = MASKED
                    v[bounds] = 0
                    w = np.array(compact_windows(v, length), np.int64).reshape(-1, 3)
                    w = w[v[w[:, 1]] != MASKED]
                    of = np.searchsorted(starts, w[:, 1], "right") - 1
                    near = around.of(np.maximum(w[:, 1] - length + 1, starts[of]), np.minimum(w[:, 1] + length, ends[of]))
                    first = np.unique(mixed(v[w[:, 1]] * np.uint64(FACTOR) ^ mixed(near + of.astype(np.uint64))), return_index=True)[1]
                    w, of = w[first], of[first]
                    w[:, 0], w[:, 2] = np.maximum(w[:, 0], w[:, 1] - length + 1), np.minimum(w[:, 2], w[:, 1] + length - 1)
                    found.append((v[w[:, 1]].view(np.int64), ids[begin + np.array(use)[of]], *(w - starts[of][:, None]).astype(np.int32).T))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["v", "doc", "l", "c", "r"])

    return docs.mapInArrow(run, "v long, doc long, l int, c int, r int")


def regions(windows: pa.ListArray, length: int) -> tuple[np.ndarray, ...]:
    """windows: of each pair its windows (l, c, r), each with those of the head that share its value (theirs). Returns
    the pair and the first and last place in the document and in the other one of what overlaps, of enough hash
    functions. What is shifted by more than a passage is apart: where a shingle recurs, each of its places is aligned
    with each."""
    pair, flat = np.repeat(np.arange(len(windows)), windows.value_lengths().to_numpy()), windows.flatten()
    theirs = flat.field("theirs")
    l, c, r, l2, c2, r2 = (side.field(x).to_numpy().astype(np.int64) for side in (flat, theirs.flatten()) for x in ("l", "c", "r"))
    m = theirs.value_lengths().to_numpy().astype(np.int64)
    of = np.cumsum(m) - m
    kinds, parts, begin = 1 << flat.field("j").to_numpy().astype(np.int64), [], 0
    for end in np.append(np.flatnonzero(np.diff(np.cumsum(m) // MOST_ALIGNED)) + 1, len(m)).tolist():
        x = np.repeat(np.arange(begin, end), m[begin:end])
        y = np.arange(of[begin], of[begin] + len(x)) if end > begin else x
        shift = c[x] - c2[y]
        first, last = np.maximum(l[x], l2[y] + shift), np.minimum(r[x], r2[y] + shift)
        near = last - first + 1 >= length - 2 * TOKEN  # words more on one side shift what is beyond them
        parts.append(one_shift(np.stack([pair[x], kinds[x], shift, first, last])[:, near]))
        begin = end
    spans = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
    spans = spans[:, np.lexsort((spans[2], spans[0]))]
    band = np.cumsum((np.diff(spans[2], prepend=spans[2, :1]) > length) | (np.diff(spans[0], prepend=spans[0, :1]) > 0))
    order, starts = overlapping(band, spans[3], spans[4])
    if not len(starts):
        return tuple(np.zeros((5, 0), np.int64))
    pair, kind, shift, first, last = spans[:, order]
    enough = np.bitwise_count(np.bitwise_or.reduceat(kind, starts)) >= AGREE
    return tuple(x[enough] for x in (pair[starts], np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts), np.minimum.reduceat(first - shift, starts), np.maximum.reduceat(last - shift, starts)))


def overlapping(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by group and first place, and where in it the ranges that overlap within a group begin."""
    order = np.lexsort((first, group))
    base = (group[order] - group.min(initial=0)) << 32
    reached = np.maximum.accumulate(base + last[order])
    return order, np.flatnonzero(np.append(True, (base + first[order])[1:] > reached[:-1])[: len(order)])


def one_shift(spans: np.ndarray) -> np.ndarray:
    """pair, kind, shift, first, last: the overlapping ranges of each shift of a pair and kind as one."""
    spans = spans[:, np.lexsort((spans[2], spans[1], spans[0]))]
    group = np.cumsum(np.append(False, (np.diff(spans[:3]) != 0).any(axis=0))[: spans.shape[1]])
    order, starts = overlapping(group, spans[3], spans[4])
    if not len(starts):
        return spans
    return np.concatenate([spans[:4, order][:, starts], np.maximum.reduceat(spans[4, order], starts)[None]])


def longest(weights: np.ndarray) -> tuple[int, int]:
    """The longest range of which the weights' sum is not negative (begin, end)."""
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    lowest = np.minimum.accumulate(sums)
    begins = np.searchsorted(-lowest, -sums - 1e-9)
    end = int(np.argmax(np.arange(len(sums)) - begins))
    return int(begins[end]), end


def matched(keys: np.ndarray, x: np.ndarray, y: np.ndarray, place: np.ndarray, want: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For many pairs at once (keys name a shingle and its pair, place tells where it stands): those of x whose shingle is
    in y less than a passage away from the place wanted, and the nearest such places."""
    order = np.argsort(keys[y], kind="stable")
    sorted_, there = keys[y][order], place[y][order]
    kinds = np.cumsum(np.append(False, np.diff(sorted_) != 0)[: len(sorted_)])
    first = np.searchsorted(sorted_, keys[x])
    hit = np.flatnonzero(sorted_[np.minimum(first, len(sorted_) - 1)] == keys[x]) if len(sorted_) else np.zeros(0, np.int64)
    if not len(hit):
        return x[hit], hit
    kind, want = kinds[first[hit]], want[x[hit]]
    ordered = kinds << 32 | there
    after, best = np.searchsorted(ordered, kind << 32 | np.maximum(want, 0)), None
    for k in (np.maximum(after - 1, 0), np.minimum(after, len(ordered) - 1)):
        found = np.where(kinds[k] == kind, there[k], -(1 << 40))
        best = found if best is None else np.where(np.abs(found - want) < np.abs(best - want), found, best)
    near = np.abs(best - want) <= length
    return x[hit[near]], best[near]


def matches(x: np.ndarray, y: np.ndarray, shift: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of x whose shingle y has less than a passage away from the same place, and the nearest such places."""
    both, at = np.concatenate([x, y]), np.concatenate([np.arange(len(x)), np.arange(len(y))])
    return matched(both, np.arange(len(x)), np.arange(len(x), len(both)), at, at + shift, length)


def passages_of(shift: np.ndarray, tiles: pa.ListArray, length: int) -> pa.RecordBatch:
    """shift, and tiles (side, doc, at, hashes; in order) of some pairs. Returns doc, other, links and hits, as compared does."""
    flat, pair = tiles.flatten(), np.repeat(np.arange(len(tiles)), tiles.value_lengths().to_numpy())
    part = 2 * pair + flat.field("side").to_numpy()
    read = flat.field("hashes").cast(pa.large_binary())
    offsets = np.frombuffer(read.buffers()[1], np.int64)[read.offset : read.offset + len(read) + 1]
    n, sides = np.diff(offsets) // BYTES, np.arange(2 * len(tiles))
    hashes = np.zeros((int(n.sum()), 8), np.uint8)
    if len(hashes):
        hashes[:, :BYTES] = np.frombuffer(read.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, BYTES)
    hashes = hashes.view("<u8").reshape(-1)
    head = np.searchsorted(part, sides)  # the first tile of each side
    both = np.flatnonzero((np.searchsorted(part, sides, "right") > head).reshape(-1, 2).all(axis=1))
    head = np.minimum(head, len(part) - 1)
    at, docs = flat.field("at").to_numpy().astype(np.int64)[head], flat.field("doc").to_numpy()[head]
    size = np.bincount(part, n, 2 * len(tiles)).astype(np.int64)
    start, of = np.cumsum(size) - size, np.repeat(part, n)
    place = np.arange(len(of)) - start[of]
    moved = shift + at[0::2] - at[1::2]
    x, y = np.flatnonzero(of & 1 == 0), np.flatnonzero(of & 1)
    hit, there = matched(hashes << np.uint64(16) | (of >> 1).astype(np.uint64), x, y, place, place + moved[of >> 1], length)
    mine, here = of[hit] >> 1, place[hit]
    turn = np.diff(mine) != 0
    cut = np.append(True, turn | (np.diff(here) > 1))[: len(hit)]
    begin, end = np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(hit))
    counts = np.bincount(mine, minlength=len(tiles))
    # of one unbroken run both sides are equal: that is the passage; else it is looked for
    broken = np.bincount(mine[1:][~turn & ((np.diff(here) != 1) | (np.diff(there) != 1))], minlength=len(tiles)) > 0
    ends = np.cumsum(counts)
    whole = np.flatnonzero(~broken & (counts >= length))
    f, g = here[ends[whole] - counts[whole]], there[ends[whole] - counts[whole]]
    rows = [np.stack([whole, f, f + counts[whole], g, g + counts[whole], np.ones(len(whole))], axis=1)]
    for k in np.flatnonzero((counts >= SIMILAR * length) & (broken | (counts < length))).tolist():
        a, z, i, j = ends[k] - counts[k], ends[k], 2 * k, 2 * k + 1
        found = similar_passages(hashes[start[i] : start[i] + size[i]], hashes[start[j] : start[j] + size[j]], here[a:z], there[a:z], length)
        if found:
            rows.append(np.array([(k, *p) for p in found]))
    links = np.concatenate(rows)
    links = links[np.argsort(links[:, 0], kind="stable")]
    of = links[:, 0].astype(np.int64)
    shifts = [at[0::2][of], at[0::2][of], at[1::2][of], at[1::2][of]]
    kinds = [pa.array(links[:, c + 1].astype(np.int64) + s, pa.int32()) for c, s in enumerate(shifts)]
    listed = lambda of, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(tiles)))), pa.int32()), values)
    found = listed(of, pa.StructArray.from_arrays([*kinds, pa.array(links[:, 5])], names=["begin", "end", "other_begin", "other_end", "similarity"]))
    own = at[0::2][mine[begin]]
    runs = listed(mine[begin], pa.StructArray.from_arrays([pa.array(here[begin] + own, pa.int32()), pa.array(here[end - 1] + own + 1, pa.int32())], names=["b", "e"]))
    out = pa.RecordBatch.from_arrays([pa.array(docs[0::2]), pa.array(docs[1::2]), found, runs], names=["doc", "other", "links", "hits"])
    return out.take(pa.array(both))


def similar_passages(x: np.ndarray, y: np.ndarray, hit: np.ndarray, places: np.ndarray, length: int) -> list[tuple[int, int, int, int, float]]:
    """Begin and end in x, in y, and similarity, of the longest similar passages. With m shared shingles and u others on
    both sides, similarity is m / (m + u): a shared one weighs 1, another one the share that 0.8 allows, as many of y's
    as of x's at the ends."""
    cost = SIMILAR / (1 - SIMILAR)
    weights = np.full(len(x), -2 * cost)
    weights[hit] = 1.0
    more, theirs = np.diff(hit) - 1, np.abs(np.diff(places) - 1)
    gap = more > 0
    if gap.any():
        between = weights[hit[0] : hit[-1]]
        between[between < 0] = np.repeat(-cost * (1 + theirs[gap] / more[gap]), more[gap])
    weights[hit[1:][~gap]] -= cost * theirs[~gap]
    out, todo = [], [(0, len(x))]
    while todo:
        low, high = todo.pop()
        if high - low < length:
            continue
        begin, end = longest(weights[low:high])
        begin, end = begin + low, end + low
        if end - begin < length:
            continue
        a, z = np.searchsorted(hit, (begin, end))
        first, last = int(hit[a]), int(hit[z - 1]) + 1
        if last - first < length:  # changed words at the ends
            first = max(begin, first - (length - (last - first)))
            last = min(end, first + length)
        of = max(0, int(places[a:z].min()) - int(hit[a] - first))
        ol = min(len(y), int(places[a:z].max()) + 1 + int(last - 1 - hit[z - 1]))
        mine, other = set(x[first:last].tolist()), set(y[of:ol].tolist())
        share = len(mine & other) / len(mine | other)
        if share >= SIMILAR:
            out.append((first, last, of, ol, share))
            todo += [(low, begin), (end, high)]
        elif end - begin > 2 * length:  # what recurs inside counts once: look at the halves
            middle = (begin + end) // 2
            todo += [(low, begin), (begin, middle + length // 2), (middle - length // 2, end), (end, high)]
    return out


LINKS = "array<struct<begin:int,end:int,other_begin:int,other_end:int,similarity:double>>"


def compared(docs: DataFrame, grouped: DataFrame, length: int) -> DataFrame:
    """docs: doc, text; grouped: lo, doc, w (aligned windows of the pair). Returns doc, other, links (similar passages)
    and hits (runs of the document's shingles that the other one has there)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, *places = regions(b.column(2), length)
            ids = [b.column(k).take(pa.array(pair)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.int32()) for x in places)], names=["other", "doc", "l", "r", "ol", "or"])

    many = grouped.where(F.size("w") >= AGREE)
    candidates = stored(many.mapInArrow(merge, "other long, doc long, l int, r int, ol int, or int").withColumn("pair", F.monotonically_increasing_id()))
    wanted = stored(candidates.select("doc").union(candidates.select("other")).distinct())

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end in slices(pc.binary_length(b.column(1)).to_pylist()):
                values, counts = shingles_of(b.column(1).slice(begin, end - begin))
                n = -(-counts // TILE)
                of, tiles = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ends = np.minimum((tiles + 1) * TILE, counts[of]) + (np.cumsum(counts) - counts)[of]
                body = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
                hashes = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.append(0, ends * BYTES).astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin).take(pa.array(of)), pa.array(tiles, pa.int32()), hashes], names=["doc", "tile", "hashes"])

    tiles = joined_ids(docs.select("doc", "text"), wanted, "doc", "left_semi").mapInArrow(tile, "doc long, tile int, hashes binary")
    far = lambda c, by: F.greatest(F.col(c) + by, F.lit(0)).alias("to" if by > 0 else "from")
    side = lambda k, doc, a, b: candidates.select("pair", F.lit(k).alias("side"), F.col(doc).alias("doc"), (F.col("ol") - F.col("l")).alias("shift"), far(a, -SLACK), far(b, SLACK))
    sides = side(0, "doc", "l", "r").union(side(1, "other", "ol", "or")).withColumn("tile", F.explode(F.sequence((F.col("from") / TILE).cast("int"), (F.col("to") / TILE).cast("int"))))
    begin, end = F.greatest(F.col("from") - F.col("tile") * TILE, F.lit(0)), F.least(F.col("to") + 1 - F.col("tile") * TILE, F.lit(TILE))
    part = F.struct("side", "doc", (F.col("tile") * TILE + begin).alias("at"), F.substring("hashes", begin * BYTES + 1, (end - begin) * BYTES).alias("hashes"))
    fetched = sides.join(tiles, ["doc", "tile"]).select("pair", "shift", part.alias("x")).groupBy("pair").agg(F.first("shift").alias("shift"), F.array_sort(F.collect_list("x")).alias("t"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end in slices(b.column(1).value_lengths().to_pylist(), MOST_TILES):
                yield passages_of(b.column(0).slice(begin, end - begin).to_numpy().astype(np.int64), b.column(1).slice(begin, end - begin), length)

    found = stored(fetched.select("shift", "t").mapInArrow(verify, f"doc long, other long, links {LINKS}, hits array<struct<b:int,e:int>>"))
    forget(candidates)
    forget(wanted)
    return found


def with_head(members: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The members of each group compared with the group's head (lo)."""
    of = members.where("doc = lo").groupBy("v").agg(F.collect_list(F.struct("l", "c", "r")).alias("theirs"))
    pairs = members.where("doc <> lo").join(of, "v")
    return compared(docs, pairs.groupBy("lo", "doc").agg(F.collect_list(F.struct("l", "c", "r", "theirs", F.col("v").bitwiseAND(7).alias("j"))).alias("w")), length)


def left_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """v, doc, c of the groups, without their heads, in which some member has no passage at the value's place in common
    with the head, and so may share one with another member that the head has not."""
    near = found.where(F.size("links") > 0).groupBy("doc", F.col("other").alias("lo")).agg(F.flatten(F.collect_list("links")).alias("links"))
    held = F.coalesce(F.exists("links", lambda x: (x.begin <= F.col("c")) & (F.col("c") < x.end)), F.lit(False))
    flagged = stored(members.where("doc <> lo").join(near, ["lo", "doc"], "left").select("v", "doc", "l", "c", "r", held.alias("held")))
    some = stored(flagged.groupBy("v").agg(F.min("held").alias("all"), F.min("doc").alias("a"), F.max("doc").alias("b"), F.size(F.collect_set(F.pmod(F.xxhash64("doc"), F.lit(4 * FEW)))).alias("n")).where("NOT all AND a < b").select("v", (F.col("n") <= FEW).alias("few")))
    return stored(joined_ids(flagged, some, "v", "inner"))


def with_each_other(members: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Open members of small groups compared with the group's other members, some FEW each."""
    of = members.groupBy("v", F.col("doc").alias("lo")).agg(F.collect_list(F.struct("l", "c", "r")).alias("theirs"), F.min("held").alias("settled"))
    pairs = members.join(of, "v").where("lo < doc AND NOT (held AND settled)")
    return compared(docs, pairs.groupBy("lo", "doc").agg(F.collect_list(F.struct("l", "c", "r", "theirs", F.col("v").bitwiseAND(7).alias("j"))).alias("w")), length)


def passage_links(docs: DataFrame, length: int) -> DataFrame:
    """docs: doc, text. Returns doc, begin, end, other, other_begin, other_end (shingle numbers), similarity: passages of
    a document and the ones, in another document, that they are near copies of."""
    texts, hidden, all_links = docs.select("doc", "text"), None, None
    while True:
        windows = stored(window_rows(texts, length - TOKEN + SHINGLE))
        heads = stored(windows.groupBy("v").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("v", "lo"))
        members = stored(joined_ids(windows, heads, "v", "inner"))
        forget(windows)
        found = with_head(members, docs, length)
        rest = left_open(members, found)
        every = found.union(with_each_other(rest.where("few"), docs, length))
        links = every.select("doc", "other", F.explode("links").alias("x")).select("doc", "x.begin", "x.end", "other", "x.other_begin", "x.other_end", "x.similarity")
        all_links = links if all_links is None else all_links.union(links)
        places = stored(rest.where("NOT few").groupBy("doc").agg(F.collect_set("c").alias("active")))
        forget(members)
        if places.isEmpty():
            return all_links
        hits = found.select("doc", F.explode("hits").alias("m"))
        masks = joined_ids(hits if hidden is None else hits.union(hidden), places.select("doc"), "doc", "left_semi")
        state = stored(places.join(masks.groupBy("doc").agg(F.collect_set("m").alias("masked")), "doc", "left"))
        hidden = state.select("doc", F.explode("masked").alias("m"))
        texts = joined_ids(docs.select("doc", "text"), state.select("doc"), "doc", "left_semi").join(state, "doc").select("doc", "text", "active", "masked")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that shares a passage of PASSAGE words or more, exactly or nearly, with another:
    doc_id, class_id (least id of the documents that chains of such passages connect), n_links (the other documents of
    the class), n_words (words inside), passages (word numbers begin-end, end exclusive, comma-joined).

    Documents with equal texts are compared once, as the one with the least id, whose row the others get with their
    own id. Rows that share an id are one document, of which the text with the least hash is read; rows with a null id
    or text can't be named or compared and are left out, as are texts under PASSAGE words. Passages that recur only
    within one document don't count, and of a stretch that a document repeats word for word the first is compared and
    listed. A very long text is hashed in one piece (some 50 bytes a word). Ids are integers. Other columns are not
    read; an empty table gives no rows.
    """
    length = PASSAGE - SHINGLE + 1
    given = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    digest = [F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g"), F.octet_length("text").alias("n")]
    names = stored(given.select("doc", *digest).groupBy("doc").agg(F.min(F.struct("h", "g", "n")).alias("x"), F.count("*").alias("rows")).select("doc", "x.*", "rows"))
    firsts = names.groupBy("h", "g", "n").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
    same = stored(names.join(firsts.where("copies > 1"), ["h", "g", "n"]).select("doc", "first"))
    texts = joined_ids(given, stored(same.where("doc <> first").select("doc")), "doc", "left_anti")
    several = stored(names.where("rows > 1").select("doc", "h"))
    if not several.isEmpty():  # rows that share an id
        chosen = joined_ids(texts, several.select("doc"), "doc", "left_semi").withColumn("h", F.xxhash64("text")).join(several, ["doc", "h"]).groupBy("doc").agg(F.first("text").alias("text"))
        texts = joined_ids(texts, several.select("doc"), "doc", "left_anti").union(chosen)
    links = stored(passage_links(texts, length))
    roots = stored(components(links, "doc", "other"))
    spans = links.select("doc", "begin", "end").union(links.select(F.col("other").alias("doc"), F.col("other_begin").alias("begin"), F.col("other_end").alias("end")))
    # equal texts repeat all of their words
    heads = stored(same.select(F.col("first").alias("doc")).distinct())
    whole = joined_ids(texts, heads, "doc", "left_semi").select("doc", "text").mapInArrow(word_counts, "doc long, n int").where(F.col("n") >= PASSAGE)
    spans = spans.union(whole.select("doc", F.lit(0).alias("begin"), F.col("n") - SHINGLE + 1))
    ranges = spans.groupBy("doc", "begin").agg(F.max("end").alias("end"))
    order = W.partitionBy("doc").orderBy("begin")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = ranges.withColumn("new", F.when(F.col("begin") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "island").agg(F.min("begin").alias("begin"), (F.max("end") + SHINGLE - 1).alias("end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "end"))), lambda x: F.concat_ws("-", x.begin, x.end)), ",")
    passages = merged.groupBy("doc").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("n_words"), text.alias("passages"))
    rows = stored(passages.join(roots, passages.doc == roots.node, "left").select("doc", F.coalesce("root", "doc").alias("class_id"), "n_words", "passages"))
    every = stored(rows.union(same.where("doc <> first").join(rows.withColumnRenamed("doc", "first"), "first").select("doc", "class_id", "n_words", "passages")))
    sizes = every.groupBy("class_id").agg((F.count("*") - 1).alias("n_links"))
    return every.join(sizes, "class_id").select(F.col("doc").alias("doc_id"), "class_id", "n_links", "n_words", "passages")
