"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, each set where over half of a text's shingle hashes
have it. Two fingerprints link at ``radius`` or fewer differing bits.

Search. The bits are grouped by correlation into partitions, so that
dependent bits share one and the partitions are close to independent. With m
partitions, two fingerprints within the radius agree up to t_i bits in some
partition i as soon as the t_i sum to radius - m + 1; dynamic programming picks
the number of partitions and the t_i with the least estimated number of
candidates, from statistics over all fingerprints. Each fingerprint is filed under its
values of the partitions; probes flip up to t_i bits; what meets is verified.

Groups. Equal fingerprints are one node. A value of a partition shared by more
than ``bucket`` fingerprints would give a square of pairs; there links are
found without pairs: fingerprints of such a bucket agree outside of few bits,
and two of them are within 2 bits exactly if both are within one bit of a
common word, so each is filed under itself and its one-bit neighbours, and all
that meet there (65 at most) are linked to the smallest. This is exact for a
radius of 2 and keeps rows in proportion to fingerprints.

Defined cases: a null text is empty; a text without words has fingerprint
zero, linked like any other; ids that are null form no link, and have a null
component unless others share their fingerprint; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import fresh, pinned, small_batches, stage, unstage
from lexora.llm.components import components
from lexora.llm.pieces import PieceTable, held
from lexora.llm.vocab import batched

BITS = 64
MAP_BITS = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = {c: c + 32 for c in range(65, 91)}
_BYTES_LOWER = bytes(_LOWER.get(c, c) for c in range(256))
_SPACES = b"\t\n\x0b\x0c\r"
_TO_SPACE = bytes.maketrans(_SPACES, b" " * 5)
_TABLE = bytes(_TO_SPACE[_BYTES_LOWER[c]] for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, repeats included; of all words if there are fewer."""
    import xxhash

    parts = [w for w in text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if w]
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    n, digest = len(parts), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(line, 42)], np.uint64)
    return np.array([digest(line[s:e], 42) for s, e in zip(starts[: n - words + 1], ends[words - 1 :])], np.uint64)


@lru_cache(maxsize=1)
def _spread_table() -> np.ndarray:
    """For 8 bits, one count in each of 8 bytes."""
    return np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    table = _spread_table()
    as_bytes = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(as_bytes), 255):  # a byte holds a count of up to 255
        sums = np.add.reduce(table[as_bytes[at : at + 255]], axis=0)
        counts += sums.astype("<u8").view(np.uint8).astype(np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long), shingles (their number); texts stay where they are."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps, sizes = [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text or "", words)
                fps.append(fingerprint(h)), sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())], ["doc_id", "fp", "shingles"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, shingles long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, how often each two bits are set together), over all rows; a 64 by 64 table per task meets."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            v = batch.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(v)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1)), pa.array([*total.ravel().astype(np.int64).tolist(), n])], ["k", "v"])

    got = nodes.select("fp").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in got:
        flat[r["k"]] = r["v"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near equal width; each grows from the bit left that is most correlated with the rest by those most correlated with it."""
    p = np.diag(together) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = np.abs((together / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(rho, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        rest = sorted(left)
        first = max(rest, key=lambda b: (rho[b, rest].sum(), -b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            nxt = max(sorted(left), key=lambda b: (rho[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        out.append(sorted(group))
    return out


def estimates(n: int, together: np.ndarray, groups: list[list[int]], most: int) -> np.ndarray:
    """Estimated rows to make for each partition and threshold 0..most: probes, and pairs of rows whose parts differ in up to t bits (bits taken as independent)."""
    p = np.diag(together) / max(1, n)
    differ = 2 * p * (1 - p)
    out = np.zeros((len(groups), most + 1))
    for k, group in enumerate(groups):
        chance = np.array([1.0])
        for b in group:
            chance = np.convolve(chance, [1 - differ[b], differ[b]])
        signatures, total = 1.0, 0.0
        for t in range(most + 1):
            total += chance[t] if t < len(chance) else 0
            out[k, t] = n * signatures + total * n * (n - 1) / 2
            signatures = signatures * max(1, len(group) - t) / (t + 1) + signatures
    return out


def allocate(cost: np.ndarray, radius: int) -> tuple[float, list[int]]:
    """Thresholds (-1: partition not probed) that sum to radius - m + 1 at least cost, by dynamic programming over partitions."""
    m, most = len(cost), cost.shape[1] - 1
    need = radius - m + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k in range(m):
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, most + 1):
                price = c + (0.0 if t < 0 else cost[k, t])
                if s + t not in new or price < new[s + t][0]:
                    new[s + t] = (price, [*ts, t])
        best = new
    return best[need] if need in best else (float("inf"), [])


def plan(n: int, together: np.ndarray, radius: int, least_m: int = 2, most_m: int = 8) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds of least estimated cost."""
    options = []
    for m in range(least_m, min(most_m, radius + 1) + 1):
        groups = group_bits(n, together, m)
        cost, ts = allocate(estimates(max(2, n), together, groups, min(radius, 3)), radius)
        if ts:
            options.append((cost, m, groups, ts))
    _, _, groups, ts = min(options, key=lambda o: o[:2])
    return groups, ts


def _mask(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >= 1 << 63 else v


def _flips(bits: list[int], most: int) -> list[int]:
    from itertools import combinations

    return [_mask(list(c)) for t in range(most + 1) for c in combinations(bits, t)]


def _signed(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def link_fingerprints(nodes: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Links (a long, b long) between distinct fingerprints, enough of them to connect all within the radius; nodes: fp long, distinct."""
    if radius > 2:
        raise ValueError("the exact search of large buckets is for a radius of 2 or less")
    n, together = bit_statistics(nodes)
    groups, ts = plan(n, together, radius)
    out = None
    for k, (group, t) in enumerate(zip(groups, ts)):
        if t < 0:
            continue
        mask = _mask(group)
        filed = nodes.select("fp", F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("part"))
        if t == 0:
            sizes = filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            shared = filed.join(sizes, "part")
            small, large = shared.where(F.col("n") <= bucket), shared.where(F.col("n") > bucket)
            other = small.select("part", F.col("fp").alias("other"))
            pairs = small.join(other, "part").where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
            rest = [b for b in range(BITS) if b not in set(group)]
            found = pairs.unionByName(_cover(large, rest, radius))
        else:
            probes = nodes.select("fp", F.explode(_signed(_flips(group, t))).alias("flip")).select("fp", F.col("fp").bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.col("flip")).alias("part"))
            sizes = filed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
            small = filed.join(sizes.where(F.col("n") <= bucket), "part").select("part", F.col("fp").alias("other"))
            pairs = probes.join(small, "part").where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
            hot = probes.join(sizes.where(F.col("n") > bucket), "part")
            found = pairs.unionByName(_cover(hot, list(range(BITS)), radius))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _cover(rows: DataFrame, bits: list[int], radius: int) -> DataFrame:
    """Links of all rows (part, fp) of a part within the radius, without pairs: through shared one-bit neighbours."""
    near = rows.select("part", "fp", F.explode(_signed(_flips(bits, 1 if radius else 0))).alias("flip")).select("part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    if radius < 2:  # one bit apart: one of the two is the other's neighbour, so the word itself must be there
        there = rows.select("part", F.col("fp").alias("word"))
        return near.join(there, ["part", "word"]).where("fp <> word").select(F.col("fp").alias("a"), F.col("word").alias("b"))
    first = near.groupBy("part", "word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return near.join(first, ["part", "word"]).where("fp <> b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = stage(fingerprints(docs, words, id_col, text_col), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = link_fingerprints(nodes.select("fp"), radius)
    # nodes are named by fingerprint; a component's id is the smallest doc_id of its nodes
    parts = components(links)
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stage(named.join(ids, "component").select("fp", "component_id"), "classes")
    unstage(nodes)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- copies by similarity of shingle sets -----------------------------------


def prefix_length(size: int, similarity: float) -> int:
    """So many first shingles, in any order that all sets share, hold one in common with each set at the similarity."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def _word_codes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(p.translate(_BYTES_LOWER), 3) for p in pieces], np.uint64), np.ones(len(pieces), np.int64)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in ascending order; of all words if there are fewer."""
    table, out = held("words", lambda: PieceTable(_word_codes, np.uint64, b" " + _SPACES, frugal=True), idle=2), []
    for a, b in batched(texts):
        codes, sizes = table.encode([t.encode("utf-8", "surrogatepass") for t in texts[a:b]])
        hashes = np.zeros(len(codes), np.uint64)
        rolling = hashes.copy()
        for j in range(words):  # of the words from each place on
            n = len(codes) - j
            rolling = rolling * _ODD
            rolling[: max(n, 0)] += codes[j:]
        rolling = (rolling ^ (rolling >> np.uint64(32))) * _ODD
        rolling ^= rolling >> np.uint64(29)
        at = 0
        for n in sizes.tolist():
            if n >= words:
                out.append(np.unique(rolling[at : at + n - words + 1]))
            elif n:
                whole = n
                for c in codes[at : at + n].tolist():
                    whole = (whole * 0x9E3779B97F4A7C15 + c) & 0xFFFFFFFFFFFFFFFF
                out.append(np.array([whole ^ (whole >> 31)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def parity_map(hashes: np.ndarray) -> bytes:
    """A bit for each of MAP_BITS classes of hashes: whether a set has an odd number of them. Two maps differ in no more bits than their sets in members."""
    counts = np.bincount((hashes % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1
    return np.packbits(counts.astype(np.uint8)).tobytes()


def common_shingles(rows: DataFrame, words: int, every: int, least: int, most: int) -> np.ndarray:
    """Hashes of shingles that stand in `least` or more of the sampled texts (one of `every`), the rarest first; at most `most`, the most frequent."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets([t or "" for t in batch.column(0).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["hash"])

    sample = rows.where(F.pmod(F.xxhash64("__row", F.lit(17)), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(run, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "hash").limit(most).toArrow()["hash"].to_numpy()  # 8 bytes each
    return found[::-1].astype(np.int64).view(np.uint64)


def copy_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", sample_every: int = 20, max_common: int = 500_000, max_broadcast: int = 500_000, radius: int | None = None) -> DataFrame:
    """__row (the place in docs), doc_id, keeper (the __row of the document of its class that stays).

    A class holds documents linked by a Jaccard similarity of `similarity` or
    more of their sets of `words`-word shingles and, where a radius is given,
    also those whose fingerprints (of three-word shingles) differ in so many
    bits at most, which `link_fingerprints` finds. The search by similarity is
    exact: it uses no SimHash, whose bits differ in a sixth at 0.8, but prefixes
    of the sets in an order that all of them share. Any order gives the same
    links; so that few texts meet, shingles that a sample of the texts shows
    to be common come last. Equal sets are one node, and of prefix shingles
    only those that two nodes have are kept.

    Only the classes are wanted, so pairs within one are not: each text of a
    bucket is verified against the bucket's leader, the text with the most
    shingles from there on, and the components of these links are formed; then
    once more with leaders of what is outside of the bucket's largest
    component. At last every pair of a bucket whose texts are in different
    components is verified, however large the bucket, unless lengths or places
    of the shared shingle rule it out. Candidates are compared by parity maps
    first, which bound the difference of two sets from below, and those that
    pass by their whole sets.

    Defined cases: a null text is empty; texts without words are copies of
    each other; null ids pass through and are kept last; of equal ids the
    earlier row is kept; repeated rows are copies; an empty table gives an
    empty result; extra columns are ignored, whatever their names.
    """
    docs, context = pinned(docs), docs.sparkSession.sparkContext
    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = context.broadcast(common_shingles(rows, words, sample_every, 3, max_common))

    def prints(batches):
        import hashlib

        import pyarrow as pa

        late = common.value
        order = np.argsort(late)
        ordered = late[order]
        for batch in batches:
            digests, sizes, maps, prefixes = [], [], [], []
            texts = [t or "" for t in batch.column(2).to_pylist()]
            fps = [0 if radius is None else fingerprint(shingle_hashes(t, 3)) for t in texts]
            for h in shingle_sets(texts, words):
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sizes.append(len(h))
                maps.append(parity_map(h))
                if len(h) and len(ordered):
                    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                    rank = np.where(ordered[at] == h, order[at] + 1, 0)
                    h = h[np.argsort(rank, kind="stable")]
                prefixes.append(h[: prefix_length(len(h), similarity)].tobytes() if len(h) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["__row", "doc_id", "digest", "size", "map", "prefix", "fp"])

    every = stage(rows.mapInArrow(prints, "__row long, doc_id long, digest binary, size int, map binary, prefix binary, fp long"), "prints")
    # the prefix stays out of the aggregate: equal sets are one node, which has its prefix in its own row
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first")
    texts = stage(every.groupBy("digest").agg(first).select("digest", F.col("first.__row").alias("node"), F.col("first.doc_id").alias("doc_id")), "texts")

    def small(df: DataFrame) -> DataFrame:
        """A staged column of longs, broadcast where it is small enough (8 bytes a row)."""
        return F.broadcast(df) if df.count() <= max_broadcast else df

    def file(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, sizes, prefixes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            n = np.array([len(x) // 8 for x in prefixes], np.int64)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            size = np.repeat(sizes, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), "<i8")), pa.array(np.repeat(nodes, n)), pa.array(size), pa.array((size - at).astype(np.int32))], ["key", "node", "size", "rest"])

    lone = small(texts.select("node"))
    nodes = every.select(F.col("__row").alias("node"), "size", "prefix").join(lone, "node", "left_semi")
    filed = nodes.mapInArrow(file, "key long, node long, size int, rest int")
    met = stage(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "met")
    prefix = stage(filed.join(met, "key", "left_semi"), "prefixes")
    unstage(met)

    def near(size, rest, r_size, r_rest):
        """False only where no similar pair can have its first shared shingle here: `rest` counts a text's shingles from it on."""
        a, b = F.col(size), F.col(r_size)
        return (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9) & (F.least(F.col(rest), F.col(r_rest)) >= similarity / (1 + similarity) * (a + b) - 1e-9)

    def led(members: DataFrame) -> DataFrame:
        """Candidates (a, b): every member of a key with its leader."""
        leader = members.groupBy("key").agg(F.max(F.struct("rest", "size", "node")).alias("o"))
        pairs = members.join(leader, "key").where((F.col("node") != F.col("o.node")) & near("size", "rest", "o.size", "o.rest"))
        return pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()

    maps = every.select(F.col("__row").alias("node"), "size", "map")

    def verified(candidates: DataFrame) -> DataFrame:
        """Of staged candidates (a, b) those that are similar."""
        likely = stage(_judged(maps, candidates, _maps_allow(similarity), "map"), "likely")
        wanted = stage(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), "wanted")
        live = rows.select(F.col("__row").alias("node"), "text").join(small(wanted), "node", "left_semi")
        sets = stage(live.mapInArrow(_sets(words), "node long, size int, hashes binary"), "sets")
        out = stage(_judged(sets, likely, _sets_allow(similarity), "hashes"), "verified")
        unstage(likely, wanted, sets)
        return out

    def parted(links: DataFrame) -> DataFrame:
        """The prefix rows with the component of their node (itself where it has none) and the component's nodes."""
        parts = stage(components(links), "parts")
        weight = parts.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
        own = parts.join(weight, "component")
        named = prefix.join(own, "node", "left").select("key", "node", "size", "rest", F.coalesce("component", "node").alias("part"), F.coalesce("weight", F.lit(1)).alias("weight"))
        most = named.groupBy("key").agg(F.max(F.struct("weight", "part"))["part"].alias("most"), F.min("part").alias("least"), F.max("part").alias("last")).where("least <> last").select("key", "most")
        out = stage(named.join(most, "key"), "mixed")
        unstage(parts)
        return out

    seen = stage(led(prefix), "candidates")
    links = one = verified(seen)
    alike = _linked_nodes(every, texts, radius)
    links = links.unionByName(alike)
    mixed = parted(links)
    more = stage(led(mixed.where("part <> most")).join(seen, ["a", "b"], "left_anti"), "candidates")
    two = verified(more)
    links, found = links.unionByName(two), seen.unionByName(more)
    unstage(mixed)
    mixed = parted(links)
    outside = mixed.where("part <> most")
    # a text outside of the largest component meets all that are in others; where both are outside, from one side
    other = mixed.select("key", *[F.col(c).alias(f"r_{c}") for c in ("node", "size", "rest", "part", "most")])
    cross = outside.join(other, "key").where((F.col("part") != F.col("r_part")) & ((F.col("r_part") == F.col("r_most")) | (F.col("node") < F.col("r_node"))) & near("size", "rest", "r_size", "r_rest"))
    cross = cross.select(F.least("node", "r_node").alias("a"), F.greatest("node", "r_node").alias("b")).distinct()
    last = stage(cross.join(found, ["a", "b"], "left_anti"), "candidates")
    three = verified(last)
    parts = components(links.unionByName(three))
    unstage(one, two, three, seen, more, last, mixed, prefix, alike)
    classes = texts.join(parts, texts["node"] == parts["node"], "left").select("digest", texts["node"], "doc_id", F.coalesce("component", texts["node"]).alias("class"))
    keep = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("keep"))
    result = stage(classes.join(keep, "class").select("digest", F.col("keep.node").alias("keeper")), "classes")
    out = stage(every.select("__row", "doc_id", "digest").join(result, "digest").drop("digest"), "copy-classes")
    unstage(every, texts, result)
    return out


def _linked_nodes(every: DataFrame, texts: DataFrame, radius: int | None) -> DataFrame:
    """Links (a, b) of nodes that connect all rows with fingerprints within the radius (none without one), staged."""
    own = every.select("digest", "fp").distinct().join(texts.select("digest", "node"), "digest").select("node", "fp")
    if radius is None:
        return own.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    own = stage(own, "node-prints")
    first = stage(own.groupBy("fp").agg(F.min("node").alias("first")), "nodes")
    equal = own.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, two = (first.select(F.col("fp").alias(k), F.col("first").alias(f"node_{k}")) for k in ("a", "b"))
    near = link_fingerprints(first.select("fp"), radius).join(one, "a").join(two, "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    out = stage(equal.unionByName(near).where("a <> b").distinct(), "print-links")
    unstage(own, first)
    return out


def _sets(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "size", "hashes"])

    return run


def _maps_allow(similarity: float):
    def allow(m, x, n, y) -> np.ndarray:
        p, q = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (x, y))
        apart = np.bitwise_count(p ^ q).sum(1, dtype=np.int64) if len(p) else np.zeros(0, np.int64)
        return apart <= (1 - similarity) / (1 + similarity) * (m.to_numpy() + n.to_numpy()) + 1e-9

    return allow


def _sets_allow(similarity: float):
    def allow(m, x, n, y) -> np.ndarray:
        keep = []
        for u, v in zip(x, y):
            p, q = np.frombuffer(u.as_buffer(), "<u8"), np.frombuffer(v.as_buffer(), "<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
        return np.array(keep, bool)

    return allow


def _judged(facts: DataFrame, candidates: DataFrame, allow, column: str) -> DataFrame:
    """The candidates (a, b) that allow(size, fact, size, fact) lets through."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            mask = pa.array(allow(*(batch.column(k) for k in range(2, 6))), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(mask)

    one, two = (facts.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col(column).alias(f"fact_{k}")) for k in ("a", "b"))
    return candidates.join(one, "a").join(two, "b").select("a", "b", "size_a", "fact_a", "size_b", "fact_b").mapInArrow(run, "a long, b long")


def drop_copies(docs: DataFrame, max_broadcast: int = 1_000_000, **options) -> DataFrame:
    """docs with one document of each class (the smallest id, then the earliest), all columns kept under any names."""
    docs = pinned(docs)
    place = fresh(docs, "row")
    classes = copy_classes(docs, **options)
    gone = stage(classes.where("__row <> keeper").select(F.col("__row").alias(place)), "copies")
    unstage(classes)
    marked = docs.withColumn(place, F.monotonically_increasing_id())
    few = gone.count() <= max_broadcast  # 8 bytes each
    return marked.join(F.broadcast(gone) if few else gone, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
