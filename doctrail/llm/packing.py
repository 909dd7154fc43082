"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from doctrail.llm.common import arrow_map

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Chunks of these characters alone are cut and merged here; others go to the tokenizers library whole.
PLAIN = regex.compile(r"[!-~\u00a1-\u012f\u0132-\u017e]*")
#: The vocabulary's own cuts and the numbers of its byte symbols.
CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


class WordIds(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of chunks without blanks.

    The vocabulary's pre-tokeniser never joins text across white space and drops
    it, so a text's ids are those of its chunks in turn. Plain chunks are merged
    by a byte-pair engine of the same ranks, where the byte FF, absent from
    UTF-8, ends a word; this equals the tokenizers library's result at a quarter
    of its cost. The cache is emptied when it holds ``limit`` chunks, so its
    size is bounded.
    """

    def __init__(self, tokenizer: str, limit: int = 400_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.limit, self.longest = Tokenizer.from_file(tokenizer), limit, longest
        symbols = byte_symbols()
        ranks = {}
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if not token.startswith("<|"):
                body = token.removesuffix(WORD_END)
                ranks[bytes(symbols[x] for x in body) + b"\xff" * (body != token)] = number
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            ids: list[int] = []
            for piece in CUTS.findall(chunk.lower()):
                ids += self.merge(piece.encode() + b"\xff")
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        out = array("I", ids).tobytes() if LITTLE else np.asarray(ids, "<u4").tobytes()
        if len(chunk) <= self.longest:
            if len(self) > self.limit:
                self.clear()
                self[""] = b""
            self[chunk] = out
        return out

    def __call__(self, text: str) -> bytes:
        return b"".join([self[x] for x in text.replace("\n", " ").split(" ")])


class SumOfSquares:
    """Open windows by fill level: ``counts[h]`` windows are filled up to h.

    Each piece goes to the level that makes the sum of the squared counts of
    partially filled windows smallest; a tie goes to the fullest window.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list] = {}

    def level(self, size: int) -> int:
        """The level, 0 for a new window, where a piece of this size goes."""
        c, n = self.capacity, self.counts
        best, at = (2 * int(n[size]) + 1 if size < c else 0), 0
        if size < c:
            below = n[1 : c - size]
            if below.size:
                change = np.where(below > 0, 2 * (n[1 + size : c] - below) + 2, 1 << 60)[::-1]
                k = int(change.argmin())
                if change[k] <= best:
                    best, at = int(change[k]), c - size - 1 - k
            if n[c - size] and 1 - 2 * int(n[c - size]) <= best:
                at = c - size
        return at

    def put(self, piece, size: int) -> list | None:
        """Place a piece; returns the window if that fills it."""
        at = self.level(size)
        window = self.open[at].pop() if at else []
        if at:
            self.counts[at] -= 1
        window.append(piece)
        if at + size == self.capacity:
            return window
        self.counts[at + size] += 1
        self.open.setdefault(at + size, []).append(window)
        return None

    def drain(self) -> list[tuple[int, list]]:
        """The open windows, fullest first, with their fill."""
        out = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.counts[:] = {}, 0
        return out


def _refill(windows: list[tuple[int, list]], capacity: int) -> Iterator[list]:
    """Windows left open at the end of a partition: pieces of the emptiest are cut into the gaps of the fullest."""
    full, last = 0, len(windows) - 1
    spare: list = []
    while full <= last or spare:
        fill, window = windows[full] if full <= last else (0, [])
        full += full <= last
        while fill < capacity and (spare or full <= last):
            if not spare:
                spare = windows[last][1][::-1]
                last -= 1
            doc, start, ids, total = spare.pop()
            take = min(len(ids) // 4, capacity - fill)
            window.append((doc, start, ids[: 4 * take], total))
            fill += take
            if 4 * take < len(ids):
                spare.append((doc, start + take, ids[4 * take :], total))
        yield window


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``capacity`` tokens.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Documents longer than a window fill whole windows first; the rest is
    placed online. Each scan partition packs its own rows in one pass without a
    shuffle, so a hot source or key changes nothing, and at most one window a
    partition is left with padding. Results depend on the split of the input,
    not on timing, so a lost executor's partition is packed again alike.

    A null or empty text is the end token alone; a null doc_id stays null;
    repeated rows are packed each; an empty table gives no rows; other columns
    are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, packer = WordIds(tokenizer), SumOfSquares(capacity)
        base, made, rows = TaskContext.get().partitionId() << 36, 0, []
        end = np.asarray([end_id], "<u4").tobytes()

        def close(window: list) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, base + made, at))
                at += n
            made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = ids_of(text or "") + end
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    close([(doc, start, ids[4 * start : 4 * (start + capacity)], total)])
                    start += capacity
                if start < total and (window := packer.put((doc, start, ids[4 * start :], total), total - start)):
                    close(window)
            yield out()
        for window in _refill(packer.drain(), capacity):
            close(window)
        yield out()

    return arrow_map(docs.select("doc_id", "text"), work, PIECES)
