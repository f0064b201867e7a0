"""Operator 4: WARC writing, a normaliser for monolithic gzip archives, and reading back.

Three steps. (1) Each task writes its pages as WARC records into archives that
are one gzip stream each (whole-file streams, as many crawlers leave them),
and yields a small index. (2) The normaliser inflates each stream once and
writes every record as a gzip member of its own, beside a sidecar index of
offsets; on the way, records whose payload repeats that of a response become
revisit records. (3) Archives are read back through their sidecar index, one
member at a time, and digests are verified.

Only digests and ids are shuffled, never payloads. Archives are bounded
(``max_archive_bytes``); files go to the folder in ``spark.checkpoint.dir``
under names fixed by partition and appear by an atomic rename, so that a lost
executor's task writes the same file again.

Defined cases: a null html is an empty payload; null urls and ids are written
as empty headers and come back as null; of equal payloads with equal page ids
the first in archive order is the response; empty tables give no archive.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import dealt, filesystem, shared_dir, small_batches, stage, unstage, write_atomically

DATE = "2024-01-01T00:00:00Z"
LEAST = 100
_READ = 1 << 20


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    """A response record; the page id is kept in a header of its own."""
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Target-URI: {_clean(url or '')}\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return head.encode() + payload + b"\r\n\r\n"


def revisit(head: dict[str, str], refers_to: int | None) -> bytes:
    """A revisit record in place of a response: no payload, but its digest and length."""
    return (
        f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {head['WARC-Record-ID']}\r\nWARC-Date: {head['WARC-Date']}\r\nWARC-Target-URI: {head['WARC-Target-URI']}\r\n"
        f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>\r\n"
        f"WARC-Payload-Digest: {head['WARC-Payload-Digest']}\r\nX-Payload-Length: {head['Content-Length']}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    ).encode()


def parse_head(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k: v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of bounded size."""
    decoder = zlib.decompressobj(31)
    while data := stream.read(_READ):
        while data:
            if piece := decoder.decompress(data, _READ):
                yield piece
            data = decoder.unconsumed_tail
            if decoder.eof:
                data, decoder = decoder.unused_data, zlib.decompressobj(31)
    if rest := decoder.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, payload, whole record) from a run of inflated bytes; memory is bounded by the longest record."""
    buffer, at = bytearray(), 0
    source = iter(pieces)

    def fill(need: int) -> bool:
        nonlocal at
        while len(buffer) - at < need:
            if at > 8 * _READ:
                del buffer[:at]
                at = 0
            piece = next(source, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(1):
        size = 4096
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not fill(size):
                raise ValueError("a record's headers are cut off")
            size = max(2 * size, len(buffer) - at + 1)
        start, block = at, bytes(buffer[at:end])
        head = parse_head(block)
        length = int(head["Content-Length"])
        skip = end + 4 - start
        if not fill(skip + length + 4):
            raise ValueError("a record is cut off")
        whole = bytes(buffer[at : at + skip + length + 4])
        at += skip + length + 4
        yield head, whole[skip : skip + length], whole


def normalise(source, out, replace: dict[int, int | None]) -> list[tuple[int, int]]:
    """Inflate source once; write each record to out as a member of its own; (offset, length) of each. replace: record number to the page it revisits."""
    index, at = [], 0
    for k, (head, _, whole) in enumerate(records(inflate(source))):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(revisit(head, replace[k]) if k in replace else whole) + packer.flush()
        out.write(member)
        index.append((at, len(member)))
        at += len(member)
    return index


def _writer(folder: str, max_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, pending, size = TaskContext.get().partitionId(), 0, [], 0
        schema = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())])

        def close():
            name = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"

            def write(out):
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                for p, u, body, d in pending:
                    out.write(packer.compress(record(p, u, body, d)))
                out.write(packer.flush())

            write_atomically(name, write)
            n = len(pending)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array([x[0] for x in pending], pa.int64()), pa.array([x[3] for x in pending]), pa.array([len(x[2]) for x in pending], pa.int64())], schema=schema
            )

        for batch in batches:
            for p, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                body = (h or "").encode()
                pending.append((p, u, body, hashlib.sha256(body).hexdigest()))
                size += len(body) + 400
                if size >= max_bytes:
                    yield close()
                    number, pending, size = number + 1, [], 0
        if pending:
            yield close()

    return run


def _normaliser(batches):
    import pyarrow as pa

    for batch in batches:
        names = []
        for name, swaps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, path = filesystem(name)
            target = name.removesuffix(".warc.gz") + ".members.warc.gz"
            index: list[tuple[int, int]] = []
            if not (fs.get_file_info(path).type.name == "NotFound"):  # else a former attempt has done all of it

                def write(out):
                    with fs.open_input_stream(path, compression=None) as source:
                        index[:] = normalise(source, out, {s["seq"]: s["refers_to"] for s in swaps or []})

                write_atomically(target, write)
                write_atomically(target + ".idx", lambda out: out.write(json.dumps(index).encode()))
                fs.delete_file(path)
            names.append(target)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def read_archive(name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record, by the sidecar index: a seek and one small inflate each."""
    fs, path = filesystem(name)
    with fs.open_input_stream(path + ".idx", compression=None) as f:
        index = json.loads(f.read())
    with fs.open_input_file(path) as f:
        for offset, length in index:
            f.seek(offset)
            head, payload, _ = next(records(iter([zlib.decompress(f.read(length), 31)])))
            yield head, payload


def _reader(batches):
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows: list[tuple] = []
            for head, payload in read_archive(name):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} differs from its digest")
                rows.append((_page(head["WARC-Record-ID"]), int(head.get("X-Payload-Length", len(payload))), digest, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_archive_bytes: int = 32 << 20) -> DataFrame:
    """Write, deduplicate and normalise; one row (archive) per archive in folder."""
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    index = stage(rows.mapInArrow(_writer(folder, max_archive_bytes), "archive string, seq long, page_id long, digest string, payload_bytes long"), "warc-index")
    large = index.where(F.col("payload_bytes") >= LEAST)
    first = large.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "archive", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = large.join(first, "digest").where((F.col("archive") != F.col("first.archive")) | (F.col("seq") != F.col("first.seq")))
    # the list of an archive is bounded by the records it may hold
    swaps = again.groupBy("archive").agg(F.collect_list(F.struct("seq", F.col("first.page_id").alias("refers_to"))).alias("swaps"))
    work = index.select("archive").distinct().join(swaps, "archive", "left")
    done = stage(dealt(work).mapInArrow(_normaliser, "archive string"), "warc-archives")
    unstage(index)
    return done


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    return dealt(archives).mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession, "warc"), **options))
