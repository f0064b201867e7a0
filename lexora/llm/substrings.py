"""Operator 8: removal of repeated substrings, exact to the byte.

A byte goes if a string of ``length`` bytes over it also starts earlier
(smaller doc_id, or the same document and an earlier start).

Why not one column-wise construction over whole documents: it takes one round
for each byte of the longest document, and each round rewrites the transform
of the collection; here that is over 100,000 rounds over gigabytes. So anchors
do most of the work, and the construction runs where it is at its best, on the
many short strings that they leave open:

1. Anchors. Each window of ``length`` bytes has an anchor, the k-gram with the
   least hash in it (the leftmost of equals), so equal windows have equal
   anchors; windows with one anchor position form a run of up to 69.
2. Runs meet by anchor hash. Of runs with equal context (two 64-bit hashes, of
   the anchor and of the whole context with the anchor's place in it, agree;
   bytes are not compared here), all but the first go as a whole. Inside a task's batch this is done before anything moves, so a
   passage in a third of all documents sends one run per batch.
3. What is left: first runs of different contexts that share an anchor (edges
   of repeated passages). Their contexts, strings of up to 168 bytes, are
   gathered by anchor hash. Most share little more than the anchor, and the more
   text there is the more of them meet; so parts of a context that no other can
   share, and parts that an earlier one has byte by byte, are settled first
   (`open_parts`), which also bounds the groups of common anchors. The rest is
   sorted by column-wise construction: one symbol
   per string is inserted each round into the collection's transform, read and
   written in sequence (in files where large). Common prefixes of neighbours are
   compared byte by byte when the order is complete, not updated each round;
   neighbours that share 100 bytes are equal windows, and all but the first of a
   class go.
4. Each scan task applies the removals of its own documents.

Texts never move: requests and removals are small files in the shared folder,
one per scan partition, that a scan task reads. The scan must have the same
partitions each time, as scans of files have; other inputs are staged first.

Defined cases: null texts are empty; texts shorter than ``length`` stay whole;
rows with null ids come first; equal ids are ordered by place in the input, so
of repeated rows the first stays; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import dealt, filesystem, pinned, shared_dir, small_batches, spread, stage, unstage, write_atomically
from lexora.llm.pieces import powers

K = 32
BLOCK = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)
RUN = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("s", "<u4"), ("n", "u1"), ("p", "u1")])
SPAN = np.dtype([("row", "<i8"), ("s", "<u4"), ("n", "u1"), ("ask", "u1"), ("p", "u1"), ("h", "<u8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any slice of a block of bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, anchor hash, context hash) of the runs of windows of a block; ends: where its texts end."""
    w = length - K + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    hashes = Hashes(data)
    at = np.arange(len(data) - K + 1)
    grams = hashes.of(at, at + K)
    low = sliding_minimum((grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64), w)
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    s = spread(starts, np.maximum(0, ends - starts - length + 1))
    if not len(s):
        return none
    a = anchor[s]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    count = np.diff(np.concatenate([first, [len(s)]]))
    start, where = s[first], a[first]
    context = _mixed(hashes.of(start, start + count + length - 1) + (where - start).astype(np.uint64) * _MIX + (count.astype(np.uint64) << np.uint64(32)))
    return start, count, where, grams[where], context


def _blocks(batch, base: int, length: int):
    """(bytes, ends, row, doc, offset of each piece): texts joined up to BLOCK bytes; longer ones cut so that each window lies in one piece."""
    parts, rows, docs, offsets, size = [], [], [], [], 0
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for k, (doc, text) in enumerate(zip(ids, texts)):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            piece = raw[at : at + BLOCK]
            if size and size + len(piece) > BLOCK:
                yield parts, rows, docs, offsets
                parts, rows, docs, offsets, size = [], [], [], [], 0
            parts.append(piece), rows.append(base + k), docs.append(_NONE if doc is None else doc), offsets.append(at)
            size += len(piece)
            if at + BLOCK >= len(raw):
                break
            at += BLOCK - length + 1
    if parts:
        yield parts, rows, docs, offsets


def _runs_of(parts, rows, docs, offsets, length) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    start, count, anchor, h, c = runs(data, ends, length)
    own = np.searchsorted(ends, start, side="right")
    out = np.empty(len(start), RUN)
    begin = np.concatenate([[0], ends[:-1]])
    out["h"], out["c"], out["n"], out["p"] = h, c, count, anchor - start
    out["row"], out["doc"] = np.array(rows, np.int64)[own], np.array(docs, np.int64)[own]
    out["s"] = start - begin[own] + np.array(offsets, np.int64)[own]
    return out


def _ordered(r: np.ndarray) -> np.ndarray:
    return r[np.lexsort((r["s"], r["row"], r["doc"], r["c"], r["h"]))]


def _repeats(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ordered runs: (whether it is the first of its context, its anchor's number)."""
    if not len(r):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    new_h = np.concatenate([[True], r["h"][1:] != r["h"][:-1]])
    new_c = new_h | np.concatenate([[True], r["c"][1:] != r["c"][:-1]])
    return new_c, np.cumsum(new_h) - 1


def _spans(r: np.ndarray, ask: bool) -> np.ndarray:
    out = np.empty(len(r), SPAN)
    for name in ("row", "s", "n", "p", "h"):
        out[name] = r[name]
    out["ask"] = ask
    return out


def _packed(kind: int, keys: np.ndarray, values: np.ndarray):
    """Record batch of (kind, key, data): values grouped by key."""
    import pyarrow as pa

    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.concatenate([first[1:], [len(keys)]])
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(first), pa.int32()), pa.array(keys[first].astype(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())], pa.binary())], ["kind", "key", "data"])


_PACKED = "kind int, key long, data binary"


def _find(length: int, buckets: int):
    """Scan 1: runs by anchor bucket (kind 0), and removals known inside a batch by scan partition (kind 1)."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in _blocks(batch, base, length):
                r = _ordered(_runs_of(*block, length))
                first, _ = _repeats(r)
                gone = _spans(r[~first], False)
                if len(gone):
                    yield _packed(1, gone["row"] >> 33, gone)
                r = r[first]
                if len(r):
                    yield _packed(0, (r["h"] % np.uint64(buckets)).astype(np.int64), r)
            base += batch.num_rows

    return run


def _by_key(batches):
    """(key, [data]) of rows sorted by key."""
    key, held = None, []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(data)
    if held:
        yield key, held


def _meet(batches):
    """Runs of an anchor bucket: removals (kind 1) and requests for contexts (kind 2), by scan partition."""
    for _, held in _by_key(batches):
        r = _ordered(np.frombuffer(b"".join(held), RUN))
        first, number = _repeats(r)
        gone = _spans(r[~first], False)
        contexts = np.bincount(number[first], minlength=int(number[-1]) + 1 if len(number) else 0)
        ask = _spans(r[first & (contexts[number] > 1)], True)
        if len(gone):
            yield _packed(1, gone["row"] >> 33, gone)
        if len(ask):
            yield _packed(2, ask["row"] >> 33, ask)


def _write_sides(folder: str):
    """Write the spans of each scan partition as a file."""

    def run(batches):
        import pyarrow as pa

        for key, held in _by_key(batches):
            spans = np.frombuffer(b"".join(held), SPAN)
            spans = spans[np.lexsort((spans["s"], spans["row"]))]
            write_atomically(f"{folder}/{key}", lambda out: out.write(spans.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(spans)])], ["key", "n"])

    return run


def _side(folder: str, partition: int) -> np.ndarray:
    fs, path = filesystem(f"{folder}/{partition}")
    if fs.get_file_info(path).type.name == "NotFound":
        return np.zeros(0, SPAN)
    with fs.open_input_stream(path, compression=None) as f:
        return np.frombuffer(f.read(), SPAN)


def _with_side(batches, folder: str):
    """(row, doc, bytes, spans of the row) of a scan partition's rows."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    spans, row, at = _side(folder, part), part << 33, 0
    own = spans["row"]
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            end = at
            if at < len(own) and own[at] == row:
                end = int(np.searchsorted(own, row, side="right"))
            yield row, doc, (text or "").encode("utf-8", "surrogatepass"), spans[at:end]
            row, at = row + 1, end


_CONTEXTS = "key long, h long, doc long, row long, s long, n int, p int, text binary"


def _gather(folder: str, length: int, buckets: int):
    """Scan 2: the contexts that were asked for."""

    def run(batches):
        import pyarrow as pa

        out = []

        def flush():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 5 + (pa.int32(),) * 2 + (pa.binary(),))], ["key", "h", "doc", "row", "s", "n", "p", "text"])

        for row, doc, raw, spans in _with_side(batches, folder):
            for x in spans:
                s, n, h = int(x["s"]), int(x["n"]), int(x["h"])
                out.append((h % buckets, h - (1 << 64) if h >> 63 else h, _NONE if doc is None else doc, row, s, n, int(x["p"]), raw[s : s + n + length - 1]))
            if len(out) > 20_000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def _room(n: int, kind, files: bool) -> np.ndarray:
    """An array, in a file that goes with it where files are asked for."""
    if files and n:
        with tempfile.TemporaryFile() as f:
            f.truncate(n * np.dtype(kind).itemsize)
            return np.memmap(f, kind, "r+", shape=(n,))
    return np.empty(n, kind)


def collection_order(strings: list[bytes], files_from: int = 64 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length of suffix) of all suffixes in sorted order, and the collection's Burrows-Wheeler transform (0: end mark).

    Column-wise: round j inserts the suffix of length j of each string. The
    rank of its first symbol in the transform so far is its place among all
    suffixes (end marks sort first, by string). Each round reads the transform
    once in sequence and writes the next.
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)

    def before(which: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the suffix of length j, plus one (no byte of UTF-8 is 255); 0 at the start of a string."""
        out = np.zeros(len(which), np.uint8)
        has = lengths[which] > j
        out[has] = flat[ends[which[has]] - j - 1] + np.uint8(1)
        return out

    which = np.arange(n)
    transform, owner, size = before(which, 0), which.astype(np.int32), np.zeros(n, np.uint16)
    place = which.copy()
    for j in range(1, int(lengths.max(initial=0)) + 1):
        active = lengths[which] >= j
        which, place = which[active], place[active]
        order = np.argsort(transform, kind="stable")
        done = int((transform == 0).sum())
        rank = np.empty(len(transform), np.int64)
        rank[order] = np.arange(n - done, n - done + len(transform))
        place = rank[place]
        total = len(transform) + len(which)
        files = 2 * total > files_from
        new, new_owner, new_size = _room(total, np.uint8, files), _room(total, np.int32, files), _room(total, np.uint16, files)
        old = np.ones(total, bool)
        old[place] = False
        new[place], new_owner[place], new_size[place] = before(which, j), which, j
        new[old], new_owner[old], new_size[old] = transform, owner, size
        transform, owner, size = new, new_owner, new_size
    return np.asarray(owner), np.asarray(size), np.asarray(transform)


def repeated_windows(strings: list[bytes], counts: list[int], rank: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its first counts[i] windows also start earlier; rank[i] + offset orders windows."""
    owner, size, _ = collection_order(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    offset = lengths[owner] - size
    window = offset < np.array(counts, np.int64)[owner]
    owner, offset = owner[window], offset[window]
    flat = np.frombuffer(b"".join(strings) + bytes(length), np.uint8)
    begin = np.cumsum(lengths) - lengths
    start = begin[owner] + offset
    same = np.zeros(len(start), bool)
    for a in range(0, len(start) - 1, 100_000):  # common prefixes of neighbours, compared byte by byte in bounded pieces
        b = min(len(start) - 1, a + 100_000)
        left, right = start[a:b], start[a + 1 : b + 1]
        equal = np.flatnonzero(flat[left + length - 1] == flat[right + length - 1])
        steps = np.arange(length)
        same[a + 1 + equal] = (flat[left[equal, None] + steps] == flat[right[equal, None] + steps]).all(1)
    group = np.cumsum(~same) - 1
    key = rank[owner] + offset
    order = np.lexsort((key, group))
    first = np.zeros(len(start), bool)
    if len(start):
        first[order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]] = True
    out = [np.zeros(c, bool) for c in counts]
    for i, o in zip(owner[~first].tolist(), offset[~first].tolist()):
        out[i][o] = True
    return out


def _bytes_of(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flat[spread(start, size)]


def _slice_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of a long array, in bounded pieces; a slice is short."""
    out, order, a = np.zeros(len(start), np.uint64), np.argsort(start, kind="stable"), 0
    places = start[order]
    while a < len(order):
        low = int(places[a])
        b = int(np.searchsorted(places, low + (BLOCK >> 3)))
        own = order[a:b]
        out[own] = Hashes(flat[low : int(end[own].max())]).of(start[own] - low, end[own] - low)
        a = b
    return out


def _equal_slices(flat: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of `size` bytes at one and two are equal, compared byte by byte in bounded pieces."""
    out = np.zeros(len(one), bool)
    for a in range(0, len(one), 20_000):
        n = size[a : a + 20_000]
        differ = _bytes_of(flat, one[a : a + 20_000], n) != _bytes_of(flat, two[a : a + 20_000], n)
        out[a : a + 20_000] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
    return out


def open_parts(flat: np.ndarray, begin: np.ndarray, count: np.ndarray, place: np.ndarray, h: np.ndarray, length: int, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(parts whose windows all start earlier, groups of parts that are open); parts are rows (context, first window, windows).

    Contexts are in the order of the collection; begin: where they are in flat,
    count: their windows, place: of the anchor in them, h: its hash. Windows are
    told apart by how far before the anchor they start, in ranges that are
    halved. All windows of a range hold the same bytes around the anchor, so a
    context shares none of them with others that differ there; and of parts
    that are equal as a whole (bytes are compared) only the first stays open.
    Two halvings leave 83 of 100 bytes that must be equal. A group of over
    `most` parts is halved further, until at one window a part is equal to all
    of its group: no group is larger, however common an anchor is.
    """
    at, cell, width = np.arange(len(begin)), np.zeros(len(begin), np.int64), length - K + 1
    low, high = place - count + 1, place.copy()
    gone, ready, halvings = [np.zeros((0, 3), np.int64)], [], 0
    while len(at):
        width, halvings = -(-width // 2), halvings + 1
        at, cell, low, high = (np.repeat(v, 2) for v in (at, cell, low, high))
        cell[1::2] += width
        low, high = np.maximum(low, cell), np.minimum(high, cell + width - 1)

        def only(mask):
            return at[mask], cell[mask], low[mask], high[mask]

        at, cell, low, high = only(low <= high)
        anchor = begin[at] + place[at]
        key = _mixed(_mixed(_slice_hashes(flat, anchor - cell, anchor - cell - width + 1 + length) + cell.astype(np.uint64)) ^ h[at])
        _, group, sizes = np.unique(key, return_inverse=True, return_counts=True)
        shared = sizes[group] > 1
        (at, cell, low, high), group, anchor = only(shared), group[shared], anchor[shared]
        start, size = anchor - high, high - low + length
        whole = _mixed(_slice_hashes(flat, start, start + size) + (low * 256 + high).astype(np.uint64))
        order = np.lexsort((at, whole, group))
        new = np.ones(len(order), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        again, first = order[~new], first[~new]
        alike = (size[again] == size[first]) & (low[again] == low[first])
        again, first = again[alike], first[alike]
        again = again[_equal_slices(flat, start[again], start[first], size[again])]
        gone.append(np.stack([at[again], place[at[again]] - high[again], high[again] - low[again] + 1], 1))
        left = np.ones(len(at), bool)
        left[again] = False
        sizes = np.bincount(group[left], minlength=1)
        left &= sizes[group] > 1
        if halvings >= 2:
            done = left & ((sizes[group] <= most) | (width == 1))
            own = np.flatnonzero(done)
            own = own[np.argsort(group[own], kind="stable")]
            if len(own):
                parts = np.stack([at[own], place[at[own]] - high[own], high[own] - low[own] + 1], 1)
                ready += np.split(parts, np.flatnonzero(np.diff(group[own])) + 1)
            left &= ~done
        at, cell, low, high = only(left)
    return np.concatenate(gone), ready


def _resolve(length: int, most: int):
    """Contexts of an anchor bucket, whole anchors at a time, their open parts in builds of about `most` strings: removals by scan partition."""

    def build(flat, begin, rank, parts):
        start = begin[parts[:, 0]] + parts[:, 1]
        strings = [flat[a : a + n].tobytes() for a, n in zip(start.tolist(), (parts[:, 2] + length - 1).tolist())]
        for (context, first, _), gone in zip(parts.tolist(), repeated_windows(strings, parts[:, 2].tolist(), rank[parts[:, 0]] + parts[:, 1], length)):
            at = np.flatnonzero(gone)
            if len(at):
                for a in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    yield context, first + int(a[0]), len(a)

    def solve(rows):
        flat = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        h, doc, row, s, n, p = (np.concatenate([r[0][k] for r in rows]) for k in range(6))
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        order = np.lexsort((s, row, doc))
        h, doc, row, s, n, p, begin = (v[order] for v in (h, doc, row, s, n, p, begin))
        # the order of windows: strings by (doc, row, start), then offset; windows of one document overlap in start, so starts are compared
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
        rank = (np.cumsum(new) << 33) + s
        gone, groups = open_parts(flat, begin, n, p, h.view(np.uint64), length, most)
        found, held, size = [gone], [], 0
        for parts in [*groups, None]:
            if held and (parts is None or size + len(parts) > most):
                found.append(np.array([*build(flat, begin, rank, np.concatenate(held))], np.int64).reshape(-1, 3))
                held, size = [], 0
            if parts is not None:
                held.append(parts)
                size += len(parts)
        found = np.concatenate(found)
        out = np.zeros(len(found), SPAN)
        out["row"], out["s"], out["n"] = row[found[:, 0]], s[found[:, 0]] + found[:, 1], found[:, 2]
        return out

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            columns, texts = [batch.column(k).to_numpy().astype(np.int64) for k in range(1, 7)], batch.column(7).to_pylist()
            a = 0
            if size >= most:
                cuts = np.flatnonzero(columns[0] != np.concatenate([rows[-1][0][0][-1:], columns[0][:-1]]))
                if len(cuts):
                    a = int(cuts[0])
                    rows.append(([c[:a] for c in columns], b"".join(texts[:a])))
                    if len(gone := solve(rows)):
                        yield _packed(1, gone["row"] >> 33, gone)
                    rows, size = [], 0
            if a < len(texts):
                rows.append(([c[a:] for c in columns], b"".join(texts[a:])))
                size += len(texts) - a
        if rows and len(gone := solve(rows)):
            yield _packed(1, gone["row"] >> 33, gone)

    return run


def _apply(folder: str, length: int):
    """Scan 3: remove, and report on each document."""

    def run(batches):
        import pyarrow as pa

        out = []
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(), pa.binary()))], names)

        for _, doc, raw, spans in _with_side(batches, folder):
            removed = n_spans = 0
            kept = raw
            if len(spans):
                a, b = spans["s"].astype(np.int64), spans["s"].astype(np.int64) + spans["n"] + length - 1
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                cut = np.concatenate([[True], a[1:] > b[:-1]])
                a, b = a[cut], b[np.concatenate([cut[1:], [True]])]
                removed, n_spans = int((b - a).sum()), len(a)
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
            out.append((doc, len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            if len(out) >= 2000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", build: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every document."""
    if not K < length <= 160:
        raise ValueError(f"length must be over {K} and at most 160")
    spark, docs = docs.sparkSession, pinned(docs)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    asked, gone = shared_dir(spark, "asked"), shared_dir(spark, "gone")

    def by_key(df: DataFrame, kind: int) -> DataFrame:
        return dealt(df.where(F.col("kind") == kind).select("key", "data"), "key").sortWithinPartitions("key")

    found = stage(rows.mapInArrow(_find(length, buckets), _PACKED), "runs")
    met = stage(by_key(found, 0).mapInArrow(_meet, _PACKED), "met")
    early = stage(found.where("kind = 1"), "early")
    unstage(found)
    by_key(met, 2).mapInArrow(_write_sides(asked), "key long, n long").agg(F.sum("n")).collect()
    contexts = dealt(rows.mapInArrow(_gather(asked, length, buckets), _CONTEXTS), "key").sortWithinPartitions("key", "h")
    late = contexts.mapInArrow(_resolve(length, build), _PACKED)
    every = early.unionByName(met.where("kind = 1")).unionByName(late)
    by_key(every, 1).mapInArrow(_write_sides(gone), "key long, n long").agg(F.sum("n")).collect()
    unstage(early, met)
    return rows.mapInArrow(_apply(gone, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
