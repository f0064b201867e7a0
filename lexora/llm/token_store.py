"""Operator 1: a content-addressed store of token ids.

Id streams are cut into chunks where a rolling hash of the last ids hits a
mask, so equal passages give equal chunks wherever they stand. A chunk is
stored once, under its hash; a document is a recipe of chunk addresses, with a
manifest whose Merkle root covers the chunk hashes. Reading back looks each
chunk up, checks its hash and the root, and puts the ids together.

Steps. (1) One pass tokenises and writes a pack of its own chunks per task,
each once, with an index row per chunk and a recipe per document. (2) Of equal
chunks in several packs the one in the smallest (pack, offset) stays: packs
that hold losers are rewritten without them. Only hashes and addresses are
shuffled, never ids. (3) Recipes are ranged by ascending doc_id, which fixes
each document's start: sums per range, then a running sum inside a range.
(4) Packs are read by the recipes of the documents that were written with
them; chunks held elsewhere are looked up in their packs.

File format of a pack: chunks back to back, each the ids as little-endian
unsigned integers of ``width`` bytes (2 or 4; a vocabulary that needs more is
refused), so that a trainer can map a pack into memory. Packs are bounded by
the size of a task's input slice.

Defined cases: a null or empty text is the end id alone; rows with a null id
come first; equal ids are ordered by their place in the packs; repeated rows
share all chunks; an empty table gives no pack; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexora.llm.common import dealt, filesystem, shared_dir, small_batches, stage, unstage, write_atomically
from lexora.llm.pieces import powers
from lexora.llm.vocab import batched, encoder

HASH_BYTES = 12
WINDOW, MASK_BITS, MOST = 16, 9, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cut_points(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents: after a position whose rolling hash of the last WINDOW ids ends with MASK_BITS zeros, at most MOST ids apart, and at document ends."""
    if not len(ids):
        return np.zeros(0, np.int64)
    hit = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        up, down = powers(len(ids) + 1)
        sums = np.zeros(len(ids) + 1, np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= up[: len(ids)]
        np.cumsum(mixed, out=sums[1:])
        rolling = sums[WINDOW:] - sums[:-WINDOW]
        rolling *= down[: len(rolling)]
        rolling *= _ODD
        hit = np.flatnonzero(rolling < np.uint64(1 << (64 - MASK_BITS))) + WINDOW
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # the window must lie inside the document: cuts near its start depend on it alone
    own = np.searchsorted(ends, hit, side="left")
    hit = hit[hit - starts[own] >= WINDOW] if len(hit) else hit
    cuts = np.union1d(hit, ends)
    gaps = np.diff(np.concatenate([[0], cuts]))
    if len(gaps) and gaps.max() > MOST:
        extra = [np.arange(c - g + MOST, c, MOST) for c, g in zip(cuts[gaps > MOST], gaps[gaps > MOST])]
        cuts = np.union1d(cuts, np.concatenate(extra))
    return cuts


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Of chunk hashes in order; an odd node moves up alone."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [chunk_hash(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _writer(folder: str, path: str, end_id: int, width: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        enc, kind = encoder(path), np.dtype(f"<u{width}")
        if max(enc.library.get_vocab_size(), end_id + 1) > 1 << 8 * width:
            raise ValueError(f"ids need more than {width} bytes")
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batched(texts):
                flat, sizes = enc.encode(texts[a:b])
                ends = np.cumsum(sizes)
                ids = np.insert(flat, ends, end_id).astype(kind)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                cuts = cut_points(ids, sizes)
                raw = ids.tobytes()
                seen: dict[bytes, tuple[int, int]] = {}
                body, place, leaves, at = [], 0, [], 0
                for cut in cuts.tolist():
                    data = raw[at * width : cut * width]
                    name = chunk_hash(data)
                    leaves.append(name)
                    if name not in seen:
                        seen[name] = (place, len(data))
                        body.append(data)
                        place += len(data)
                    at = cut
                pack = f"{folder}/pack-{part:06d}-{number:05d}"
                number += 1
                write_atomically(pack, lambda out: out.write(b"".join(body)))
                split = np.searchsorted(cuts, ends, side="right").tolist()
                recipes, roots, start = [], [], 0
                for stop in split:
                    recipes.append(b"".join(leaves[start:stop]))
                    roots.append(merkle_root(leaves[start:stop]))
                    start = stop
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([pack] * (b - a)), pa.array(range(b - a), pa.int32()), pa.array(keys[a:b], pa.int64()), pa.array(sizes, pa.int64()), pa.array(recipes, pa.binary()), pa.array(roots, pa.binary()),
                        pa.array([b"".join(seen) if k == 0 else None for k in range(b - a)], pa.binary()),
                        pa.array([np.array(list(seen.values()), "<i8").tobytes() if k == 0 else None for k in range(b - a)], pa.binary()),
                    ],
                    ["pack", "seq", "doc_id", "n_tokens", "recipe", "root", "chunks", "places"],
                )

    return run


_INDEX = "pack string, name binary, offset long, size long"


def _index(batches):
    import pyarrow as pa

    for batch in batches:
        for pack, names, places in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.frombuffer(places, "<i8").reshape(-1, 2)
            keys = [names[k : k + HASH_BYTES] for k in range(0, len(names), HASH_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array([pack] * len(keys)), pa.array(keys, pa.binary()), pa.array(at[:, 0]), pa.array(at[:, 1])], ["pack", "name", "offset", "size"])


def _kept_index(batches):
    import pyarrow as pa

    for batch in batches:
        for pack, names, offsets in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.frombuffer(offsets, "<i8")
            keys = [names[k : k + HASH_BYTES] for k in range(0, len(names), HASH_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([pack] * len(keys), pa.string()), pa.array(at[:-1]), pa.array(np.diff(at))], ["name", "home", "offset", "size"])


def _compactor(batches):
    """Rewrite packs without the chunks that another pack holds; yields the new index of each kept chunk."""
    import pyarrow as pa

    for batch in batches:
        for pack, names, places, lost in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.frombuffer(places, "<i8").reshape(-1, 2)
            keys = [names[k : k + HASH_BYTES] for k in range(0, len(names), HASH_BYTES)]
            gone = set(lost or [])
            fs, path = filesystem(pack)
            target = pack + ".kept"
            if fs.get_file_info(path + ".kept").type.name == "NotFound":
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                write_atomically(target, lambda out: out.write(b"".join(data[o : o + n] for k, (o, n) in zip(keys, at.tolist()) if k not in gone)))
            if fs.get_file_info(path).type.name != "NotFound":
                fs.delete_file(path)
            kept = [(k, n) for k, (_, n) in zip(keys, at.tolist()) if k not in gone]
            offsets = np.concatenate([[0], np.cumsum([n for _, n in kept])]).astype("<i8") if kept else np.zeros(1, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([pack]), pa.array([b"".join(k for k, _ in kept)], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), pa.array([sorted(gone)], pa.list_(pa.binary()))],
                ["pack", "names", "offsets", "away"],
            )


def _checked(name: bytes, data: bytes) -> bytes:
    if chunk_hash(data) != name:
        raise ValueError("a chunk differs from its hash")
    return data


def fetch(pack: str, names: bytes, offsets: bytes, away: list[dict]) -> dict[bytes, bytes]:
    """The chunks of a pack and those that its documents share with other packs: one read of the own pack, ranged reads elsewhere."""
    fs, path = filesystem(pack + ".kept")
    with fs.open_input_stream(path, compression=None) as f:
        data = f.read()
    at = np.frombuffer(offsets, "<i8").tolist()
    keys = [names[k : k + HASH_BYTES] for k in range(0, len(names), HASH_BYTES)]
    out = {x: _checked(x, data[at[k] : at[k + 1]]) for k, x in enumerate(keys)}
    handle, opened = None, None
    for r in sorted(away, key=lambda r: (r["home"], r["offset"])):
        if r["home"] != opened:
            if handle is not None:
                handle.close()
            fs, path = filesystem(r["home"] + ".kept")
            handle, opened = fs.open_input_file(path), r["home"]
        handle.seek(r["offset"])
        out[r["name"]] = _checked(r["name"], handle.read(r["size"]))
    if handle is not None:
        handle.close()
    return out


def _reader(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for pack, names, offsets, away, recipes in zip(*(c.to_pylist() for c in batch.columns)):
                chunks = fetch(pack, names, offsets, away)
                keys, sizes, sums, seqs = [], [], [], []
                for r in recipes:
                    leaves = [r["recipe"][k : k + HASH_BYTES] for k in range(0, len(r["recipe"]), HASH_BYTES)]
                    if merkle_root(leaves) != r["root"]:
                        raise ValueError(f"document {r['doc_id']}: the recipe differs from its Merkle root")
                    ids = np.frombuffer(b"".join([chunks[x] for x in leaves]), f"<u{width}")
                    if len(ids) != r["n_tokens"]:
                        raise ValueError(f"document {r['doc_id']}: {len(ids)} ids, not {r['n_tokens']}")
                    keys.append(r["doc_id"]), sizes.append(len(ids)), sums.append(zlib.crc32(ids.astype("<u4").tobytes())), seqs.append(r["seq"])
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(keys)), pa.array(seqs, pa.int32()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["pack", "seq", "doc_id", "n_tokens", "ids_crc32"])

    return run


def write_store(docs: DataFrame, path: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(recipes, packs): a row per document, and a row per pack with its chunk index; files go to the shared folder."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wrote = stage(rows.mapInArrow(_writer(folder, path, end_id, width), "pack string, seq int, doc_id long, n_tokens long, recipe binary, root binary, chunks binary, places binary"), "recipes")
    heads = wrote.where("chunks is not null").select("pack", "chunks", "places")
    index = heads.mapInArrow(_index, _INDEX)
    home = index.groupBy("name").agg(F.min("pack").alias("home"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "home")
    # a list per pack is bounded by the chunks that the pack holds
    lost = index.select("pack", "name").join(home, "name").where("pack <> home").groupBy("pack").agg(F.collect_list("name").alias("lost"))
    packs = stage(dealt(heads.join(lost, "pack", "left")).mapInArrow(_compactor, "pack string, names binary, offsets binary, away array<binary>"), "packs")
    return wrote, packs


def read_store(recipes: DataFrame, packs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (with pack, seq) of every document, read from the files and verified."""
    own = packs.select("pack", "names", "offsets")
    kept = packs.select(F.col("pack").alias("home"), "names", "offsets").mapInArrow(_kept_index, "name binary, home string, offset long, size long")
    wanted = packs.select("pack", F.explode("away").alias("name"))
    # the list of a pack is bounded by the chunks of its own documents
    away = wanted.join(kept, "name").groupBy("pack").agg(F.collect_list(F.struct("name", "home", "offset", "size")).alias("away"))
    lists = recipes.groupBy("pack").agg(F.collect_list(F.struct("seq", "doc_id", "n_tokens", "recipe", "root")).alias("recipes"))
    none = F.array().cast("array<struct<name:binary,home:string,offset:bigint,size:bigint>>")
    work = own.join(away, "pack", "left").join(lists, "pack").select("pack", "names", "offsets", F.coalesce("away", none).alias("away"), "recipes")
    return dealt(work).mapInArrow(_reader(width), "pack string, seq int, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame, order: list[str], size: str, start: str = "start") -> DataFrame:
    """Adds the sum of size over all rows before, in ascending order: ranges first, then inside a range; only a sum per range meets on the driver."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__range", F.spark_partition_id()), "ranged")
    total, base, at = {r["__range"]: r["s"] for r in ranged.groupBy("__range").agg(F.sum(size).alias("s")).collect()}, {}, 0
    for k in sorted(total):
        base[k], at = at, at + total[k]
    bases = F.broadcast(spark.createDataFrame(sorted(base.items()) or [(-1, 0)], "__range int, __base long"))  # a row per shuffle partition
    inside = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(bases, "__range").withColumn(start, F.col("__base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("__range", "__base")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the store, read it back: doc_id, start, n_tokens, ids_crc32."""
    recipes, packs = write_store(docs, path, end_id)
    read = stage(read_store(recipes, packs), "read")  # ranging reads its input twice
    out = with_starts(read, ["doc_id", "pack", "seq"], "n_tokens")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
