"""Media columns with content-defined chunks, deduplicated by Spark joins.

A payload is stored as a WAV file of 8-bit mono samples. The file is cut where
a rolling gear hash says so; chunks are kept once, by digest, and ordered chunk
lists put every file together again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctrail.llm.common import Rows, arrow_map, checkpoint, stored, utf8

RATE, UNIT, PAD = 8000, 192, b" "
#: Chunk lengths: at least, usually beyond that, at most.
LEAST, USUAL, MOST = 1024, 4096, 16384
#: Bytes that the gear hash looks back on.
REACH = 32
#: Shared chunks are broadcast, without their bytes, up to so many; places that one copy of a lent chunk serves.
ASKED, PLACES_SERVED = 500_000, 512
READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, chunks long"
)


def gear_table(seed: int = 192) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, np.uint32)


def payload_of(text: bytes) -> bytes:
    """The text and blanks up to a positive multiple of 192 bytes."""
    return text + PAD * (-len(text) % UNIT or (0 if text else UNIT))


def wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload) & 0xFFFFFFFF)
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a file that ``wav`` wrote."""
    riff, size, kind = struct.unpack_from("<4sI4s", media)
    bits, tag, n = struct.unpack_from("<H4sI", media, 34)
    if (riff, kind, bits, tag) != (b"RIFF", b"WAVE", 8, b"data") or size != n + 36 or len(media) != n + 44:
        raise ValueError("not a file of 8-bit samples")
    return media[44:]


def cuts(media: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last bytes has its low bits zero, within the least and greatest length."""
    n = len(media)
    if n <= LEAST:
        return [n]
    # The hash of a place is the sum of gear[byte] << age: doubled here from one byte to REACH bytes.
    h = gear[np.frombuffer(media, np.uint8)]
    age = 1
    while age < REACH:
        older = h[:-age] << np.uint32(age)
        h = h.copy()
        h[age:] += older
        age *= 2
    marks = (np.flatnonzero(h >> np.uint32(32 - (USUAL - LEAST).bit_length() + 1) == 0) + 1).tolist()
    out, start, k = [], 0, 0
    while n - start > LEAST:
        while k < len(marks) and marks[k] < start + LEAST:
            k += 1
        start = min(marks[k] if k < len(marks) else n, start + MOST, n)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def feature(data: bytes) -> str:
    """Mean, root mean square and zero crossings of the samples, in exact integers before the last division."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) / len(x):.4f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};crossings={crossings}"


def chunked(numbers: Rows, with_data: bool) -> DataFrame:
    """rid, doc_id, n_bytes, seq, digest, and data (compressed) if asked for: a row a chunk."""
    names = ["rid", "doc_id", "n_bytes", "seq", "digest"] + ["data"] * with_data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        for batch in batches:
            rows, held = [], 0
            for rid, doc, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                media, start = wav(payload_of(text)), 0
                for seq, end in enumerate(cuts(media, gear)):
                    chunk = media[start:end]
                    rows.append((rid, doc, len(text), seq, hashlib.sha256(chunk).digest(), *([zlib.compress(chunk, 6)] * with_data)))
                    start, held = end, held + end - start
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                    rows, held = [], 0
            if rows:
                kinds = [pa.int64()] * 4 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return arrow_map(numbers.numbered("doc_id", "text"), work, "rid long, doc_id long, n_bytes long, seq long, digest binary" + ", data binary" * with_data)


def round_trip(docs: DataFrame) -> DataFrame:
    """Each document's file put together from stored chunks, verified and read.

    A join on the digest finds the chunks that several places share; the first
    place, by row, is the one whose bytes are stored, and the others borrow
    them. Bytes meet in one shuffle by row; besides, only borrowed ones travel.
    Each file is put in order from its own and its borrowed chunks, checked
    against the digests and lengths of its chunk list, and read back as
    samples. A null or empty text is a payload of 192 blanks; a null doc_id stays
    null; repeated rows are each stored; an empty table gives no rows; other
    columns are ignored.
    """
    numbers, place = Rows(docs), F.struct("rid", "seq")
    lists = stored(chunked(numbers, False).select("rid", "seq", "digest"))
    shared = lists.groupBy("digest").agg(F.min(place).alias("owner"), F.count("*").alias("n")).where("n > 1")
    # A chunk that very many places share is lent in copies, each to so many of them, so no task serves them all.
    shared = checkpoint(shared.select("digest", "owner", F.ceil(F.col("n") / PLACES_SERVED).cast("int").alias("copies")))
    met = lists.join(F.broadcast(shared) if shared.count() <= ASKED else shared, "digest").where(place != F.col("owner"))
    borrowed = checkpoint(met.select("rid", "seq", "digest", F.pmod(F.xxhash64("rid", "seq"), "copies").cast("int").alias("copy")))
    lent = shared.groupBy(F.col("owner.rid").alias("rid")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("owner.seq").alias("seq"), "copies"))).alias("lent"))
    # All that a file needs is one value, so that both uses of it share one shuffle; an inner join would part them.
    files = chunked(numbers, True).groupBy("rid").agg(F.collect_list(F.struct("seq", "digest", "data", "doc_id", "n_bytes")).alias("own"))
    owned = files.join(lent, "rid", "left").select("lent", F.explode(F.filter("own", lambda x: F.map_contains_key("lent", x["seq"]))).alias("x"))
    owned = owned.select("x.digest", "x.data", F.explode(F.sequence(F.lit(0), F.element_at("lent", F.col("x.seq")) - 1)).alias("copy"))
    fetched = borrowed.join(owned, ["digest", "copy"]).groupBy("rid").agg(F.collect_list(F.struct("seq", "data")).alias("fetched"))
    whole = files.join(fetched, "rid", "left")
    away = F.transform("fetched", lambda x: x["seq"])
    kept = F.filter("own", lambda x: ~F.coalesce(F.array_contains(away, x["seq"]), F.lit(False)))
    parts = F.sort_array(F.concat(F.transform(kept, lambda x: F.struct(x["seq"].alias("seq"), x["data"].alias("data"))), F.coalesce("fetched", F.array().cast("array<struct<seq:bigint,data:binary>>"))))
    digests = F.transform(F.sort_array(F.transform("own", lambda x: F.struct(x["seq"].alias("seq"), x["digest"].alias("digest")))), lambda x: x["digest"])
    whole = whole.select(F.col("own")[0]["doc_id"].alias("doc_id"), F.col("own")[0]["n_bytes"].alias("n_bytes"), F.transform(parts, lambda x: x["data"]).alias("parts"), digests.alias("digests"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, parts, digests in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                chunks = list(map(zlib.decompress, parts))
                data = samples(media := b"".join(chunks))
                if [hashlib.sha256(x).digest() for x in chunks] != digests or len(data) != max(UNIT, -(-n // UNIT) * UNIT):
                    raise ValueError("a file differs from its chunk list")
                digest = hashlib.sha256(media).hexdigest()
                rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), digest, feature(data), len(parts)))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return arrow_map(whole, work, READ)
