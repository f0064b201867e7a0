"""Operator 6: sequence packing by lexical retrieval.

Documents are tokenised once and staged as ids. Term statistics (in how many
documents a token id occurs, number and mean length of documents) are summed
over the whole corpus. Documents are then ranged by a routing key, the least
hashes among their rarest terms, so that documents that share rare terms stand
together wherever they came from. Each range is read in shards of at most
``shard_tokens`` ids; a BM25 inverted index of the shard packs it: a seed
document opens a window; its best unused neighbours in the shard fill it
greedily; the document that crosses the end of the window is cut there and its
rest seeds the next one. So only the last window of a shard can be short, and
that is cut at powers of two, which need no padding.

Ranges are cut by key and place, so a key that a third of all documents share
is spread over several ranges. The query of a seed holds all of its terms, or
the ``query_terms`` rarest where that is set. The term table has a row per
vocabulary entry, which bounds what meets on the driver and is broadcast.

Defined cases: null and empty texts are the end id alone; null ids pass
through; repeated rows are packed each; ties in score go to the earlier row of
the range; an empty table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import small_batches, spread, stage
from lexora.llm.vocab import batched, encoder

WINDOW = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenise(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", frugal: bool = False) -> DataFrame:
    """doc_id, route and ids (little-endian 16-bit, with the end id) of each document; beside, rows without ids that carry sums of term counts."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        enc = encoder(path, frugal)
        size = enc.library.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        counts, n_docs, n_ids = np.zeros(size, np.int64), 0, 0
        schema = pa.schema([("doc_id", pa.int64()), ("route", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("docs", pa.int64()), ("tokens", pa.int64())])
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batched(texts):
                flat, sizes = enc.encode(texts[a:b])
                ids = np.insert(flat, np.cumsum(sizes), end_id).astype("<u2")
                ends = np.cumsum(sizes + 1)
                n_docs, n_ids = n_docs + b - a, n_ids + len(ids)
                raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1]])
                held = [distinct(ids[s:e])[0] for s, e in zip(starts.tolist(), ends.tolist())]
                counts += np.bincount(np.concatenate(held), minlength=size)
                data = [raw[2 * s : 2 * e] for s, e in zip(starts.tolist(), ends.tolist())]
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array([routing_key(h) for h in held], pa.int64()), pa.array(data, pa.binary()), pa.nulls(b - a, pa.binary()), none, none], schema=schema)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([n_docs]), pa.array([n_ids])], schema=schema)

    return stage(rows.mapInArrow(run, "doc_id long, route long, ids binary, terms binary, docs long, tokens long"), "packing-ids")


def statistics(staged: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(documents that hold each id, documents, ids), over all documents."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    sums = staged.where("terms is not null")
    n = sums.agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).first()
    found = sums.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per vocabulary entry at most
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["term"]] = r["n"]
    return out, n["d"] or 0, n["t"] or 0


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids in order, how often each occurs); 16-bit ids are sorted by radix."""
    ordered = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(first, append=len(ordered))


def routing_key(terms: np.ndarray, rarest: int = 16) -> int:
    """Two least hashes of the rarest terms: a BPE vocabulary numbers its entries by the order of merges, so the highest ids are the rarest."""
    hashes = np.sort(terms[-rarest:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33))
    return int(hashes[0]) << 31 | int(hashes[min(1, len(hashes) - 1)])


class Shard:
    """A BM25 inverted index over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75, query_terms: int | None = None):
        self.n, size = len(docs), len(idf)
        lengths = np.array([len(d) for d in docs], np.int64)
        found = [distinct(d) for d in docs]
        term, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
        held = np.array([len(t) for t, _ in found])
        own = np.repeat(np.arange(self.n, dtype=np.int32), held)
        self.bounds = np.concatenate([[0], np.cumsum(held)])
        self.terms = term
        self.idf, self.query_terms = idf, query_terms
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[own] / mean))
        order = np.argsort(term, kind="stable")
        self.post, self.weight = own[order], weight[order].astype(np.float32)
        self.begin = np.searchsorted(term[order], np.arange(size + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        if self.query_terms is not None and len(terms) > self.query_terms:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[: self.query_terms]]
        terms = terms.astype(np.int64)
        at = spread(self.begin[terms], self.begin[terms + 1] - self.begin[terms])
        score = np.bincount(self.post[at], self.weight[at], self.n) * unused
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW, query_terms: int | None = None):
    """Pieces (document, start, length, sequence, offset) of a shard; every id lies in one piece."""
    if not docs:
        return
    index = Shard(docs, idf, mean, query_terms=query_terms)
    unused = np.ones(len(docs), bool)
    sequence, fill, nxt = 0, 0, 0
    left = sum(len(d) for d in docs)
    limit = _limit(left, window)
    queue: list[int] = []
    while left:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while not unused[nxt]:
                nxt += 1
            doc = nxt
        unused[doc] = False
        start, n = 0, len(docs[doc])
        crossed = False
        while start < n:
            take = min(n - start, limit - fill)
            yield doc, start, take, sequence, fill
            start, fill, left = start + take, fill + take, left - take
            if fill == limit:
                sequence, fill, crossed = sequence + 1, 0, True
                limit = _limit(left, window)
        if crossed:
            queue = []
        if fill and not queue and left:
            queue = index.neighbours(doc, unused)[::-1].tolist()


def _limit(left: int, window: int) -> int:
    """A full window, or at the end of a shard the largest power of two that is left."""
    return window if left >= window else 1 << (max(1, left).bit_length() - 1)


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, shard_tokens: int = 1_000_000, query_terms: int | None = None, **columns) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    staged = tokenise(docs, path, end_id, **columns)
    size = encoder(path).library.get_vocab_size()
    df, n_docs, n_ids = statistics(staged, size)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, n_ids / max(1, n_docs))
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # one number per vocabulary entry

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        used = 0
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal used
            rows = [(keys[d], s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), len(ids[d]), base + used + q, o) for d, s, n, q, o in pack_shard(ids, shared.value, mean, window, query_terms)]
            used += rows[-1][5] - base - used + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                ids.append(np.frombuffer(data, "<u2"))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield flush()
                    keys, ids, held = [], [], 0
        if keys:
            yield flush()

    # a copy of a document is a row of its own, whatever their order
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("route", "doc_id", "size")
    rows = staged.where("ids is not null").select("route", "doc_id", F.length("ids").alias("size"), "ids")
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "ids").select("doc_id", "ids").mapInArrow(run, SCHEMA)
