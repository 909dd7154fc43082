"""Benchmark passages in documents, found by spaced seeds and verified with substitutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctrail.llm.common import small_batches, utf8
from doctrail.llm.tokens import batch_hashes, mixed, word_hashes

#: Fixed masks: a 0 is a word that may differ. Any 10 words or more of which at most a fifth differ hold three unchanged in
#: a row, so the last mask alone misses no overlap of them.
MASKS = ("110010111", "1011011001", "111001011", "111")
SIMILARITY, LEAST_WORDS = 0.8, 13
#: Bytes of benchmark text that one broadcast holds; a larger benchmark is worked off in blocks.
BLOCK_BYTES = 16 << 20
_WEIGHTS = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def spaced(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask's words at each place where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, x in enumerate(mask):
        if x == "1":
            out += h[k : k + n] * _WEIGHTS[k]
    return mixed(out + np.uint64(len(mask)) * _WEIGHTS[-1])


def longest(same: np.ndarray, similarity: float = SIMILARITY) -> int:
    """Length of the longest stretch in which at least this share is true."""
    gain = np.where(same, round((1 - similarity) * 1000), -round(similarity * 1000))
    total = np.concatenate([[0], np.cumsum(gain)])
    lowest = np.minimum.accumulate(total)
    # For each end, the first start whose total is not above the end's.
    first = np.searchsorted(-lowest, -total)
    return int((np.arange(len(total)) - first).max())


class Seeds:
    """The seeds of some benchmark items, sorted for a join by hash.

    Items of fewer words than a mask spans are sought as a whole, so they match
    only with all their words; items with the same words are kept once.
    """

    def __init__(self, items: list[tuple[int, bytes]], least: int = LEAST_WORDS):
        words: dict[bytes, list] = {}
        self.least = least
        for item, text in items:
            h, _ = word_hashes(text)
            if len(h):
                words.setdefault(h.tobytes(), []).append(item)
        self.words = [np.frombuffer(x, np.uint64) for x in words]
        self.items = list(words.values())
        short = {len(x) for x in self.words if len(x) < max(map(len, MASKS))}
        longest_mask = max(map(len, MASKS))
        self.masks = list(dict.fromkeys([*MASKS, *("1" * n for n in sorted(short))]))
        parts = []
        for mask in self.masks:
            for k, h in enumerate(self.words):
                if mask in MASKS and (len(h) >= longest_mask or mask != MASKS[-1]) or len(h) == len(mask):
                    s = spaced(h, mask)
                    parts.append((s, np.full(len(s), k), np.arange(len(s))))
        hashes, which, place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.which, self.place = hashes[order], which[order], place[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def diagonals(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, where the item would start among all words), each once."""
        out: set[tuple[int, int, int]] = set()
        for mask in self.masks:
            s = spaced(h, mask)
            at = np.flatnonzero(self.sieve[(s >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(self.hashes, s[at]), np.searchsorted(self.hashes, s[at], "right")
            at, low, high = (x[high > low] for x in (at, low, high))
            doc = np.searchsorted(bounds, at, "right") - 1
            fits = at + len(mask) <= bounds[doc + 1]
            for d, p, a, b in zip(doc[fits].tolist(), at[fits].tolist(), low[fits].tolist(), high[fits].tolist(), strict=True):
                out.update(zip([d] * (b - a), self.which[a:b].tolist(), (p - self.place[a:b]).tolist(), strict=True))
        return sorted(out)

    def overlaps(self, texts: list[bytes]) -> dict[int, dict[int, int]]:
        """By document, by item, the words of the longest verified overlap."""
        h, bounds = batch_hashes(texts)
        out: dict[int, dict[int, int]] = {}
        for doc, k, start in self.diagonals(h, bounds):
            item = self.words[k]
            low, high = max(start, int(bounds[doc])), min(start + len(item), int(bounds[doc + 1]))
            n = longest(h[low:high] == item[low - start : high - start])
            if n >= min(self.least, len(item)):
                for name in self.items[k]:
                    mine = out.setdefault(doc, {})
                    mine[name] = max(mine.get(name, 0), n)
        return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Seeds]:
    """Seeds of the benchmark, block after block, each under the given size.

    Items are dealt by hash; the number of blocks follows the measured size, so
    what is broadcast at once is bounded whatever the benchmark's size.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + size // max(1, block_bytes // 2)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        yield Seeds(sorted(((x.item_id, x.text.encode()) for x in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, words: each document's longest overlap with each item, from LEAST_WORDS words (or the whole item) and SIMILARITY on.

    Hashes of documents meet those of a block of the benchmark within the scan's
    tasks; nothing of the documents is shuffled, so passages that many of them
    share cost no more than others. Null or empty texts overlap nothing; a null
    doc_id or item_id stays null; repeated rows each have their rows; empty
    tables give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    out = None
    for seeds in blocks(benchmark):

        def work(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for doc, found in seeds.overlaps(utf8(batch, "text")).items():
                    rows += [(ids[doc], item, n) for item, n in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "words"])

        part = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, item_id long, words long")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that overlap no item."""
    small_batches(docs.sparkSession)
    for seeds in blocks(benchmark):

        def work(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[list(seeds.overlaps(utf8(batch, "text")))] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
