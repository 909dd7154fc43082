"""Scores by a weighted backoff automaton of smoothed word n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctrail.llm.common import Rows, arrow_map, stored, utf8
from doctrail.llm.tokens import NOT_BLANK, batch_hashes, mixed

#: The token that ends a text and stands before its first word; no word holds a blank.
END = b" "
#: The most tokens and arcs that are broadcast. They only save rows of a join: results do not depend on them.
HOT_TOKENS, HOT_ARCS = 131_072, 262_144
#: Bigrams that the training texts hold so often are arcs, whatever the size of the input.
LEAST_ARC = 2
DISCOUNT = 0.5
#: Neighbouring tokens that a task counts at once.
CHUNK = 2_000_000
#: The end token among hashes of words.
END_CODE = 0x6A09E667F3BCC909
#: Bits of the sieve of arcs, a fixed size: bigrams that it does not hold are no arcs and need not meet the table. Where arcs are
#: many more than bits it lets all pass, to the same result.
SIEVE_BITS = 27


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 5; a null id is as an empty text, which does not."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts as 64-bit hashes, each text's end before its words and one more at last; and the texts' numbers of tokens."""
    h, bounds = batch_hashes(texts, NOT_BLANK)
    n = len(texts)
    ids = np.empty(len(h) + n + 1, np.uint64)
    ends = np.append(bounds[:-1] + np.arange(n), len(h) + n)
    words = np.ones(len(ids), bool)
    words[ends] = False
    ids[ends], ids[words] = END_CODE, h
    return ids, np.diff(ends)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Coded texts, so many that a chunk has about CHUNK tokens."""
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        texts += utf8(batch, "text")
        size += batch.nbytes
        if size > 5 * CHUNK:
            yield coded(texts)[0]
            texts, size = [], 0
    if texts:
        yield coded(texts)[0]


def token_counts(docs: DataFrame) -> DataFrame:
    """code, c: how often each token stands in ``docs``, by its 64-bit hash; counted within each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _chunks(batches):
            codes, n = np.unique(ids[:-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], ["code", "n"])

    return arrow_map(docs.select("text"), work, "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))


class Places:
    """Where numbers stand in a sorted array: a table by their highest bits, then at most a few steps."""

    def __init__(self, numbers: np.ndarray, bits: int = 20):
        self.numbers, self.shift = numbers, np.uint64(64 - bits)
        counts = np.bincount((numbers >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first, self.steps = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32), int(counts.max(initial=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The place of each, -1 where there is none."""
        out = np.full(len(x), -1, np.int64)
        if len(self.numbers):
            at = self.first[(x >> self.shift).astype(np.int64)]
            for k in range(self.steps):
                place = np.minimum(at + k, len(self.numbers) - 1)
                hit = self.numbers[place] == x
                out[hit] = place[hit]
        return out


class Automaton:
    """The model in one memory; ``score`` gives the same from tables of any size.

    States are tokens; state 0, the root, is the empty history.

    ``arcs[s]`` gives the log-probability of the tokens that have an arc from
    s; for the others the failure arc of weight ``fail[s]`` leads to the root,
    where each state's token has the weight ``unigram``.
    """

    def __init__(self, states: list[tuple[bytes, int]], pairs: dict[int, int], total: int, distinct: int):
        self.norm = total + 0.5 * (distinct + 1)
        self.number = {tok: k + 1 for k, (tok, _) in enumerate(states)}
        share = [0.0, *((c + 0.5) / self.norm for _, c in states)]
        self.unigram = [0.0, *(math.log10(x) for x in share[1:])]
        self.arcs: list[dict[int, float]] = [{} for _ in share]
        kept, covered, n = [0.0] * len(share), [0.0] * len(share), len(share)
        for pair, count in pairs.items():
            a, b = divmod(pair, n)
            p = (count - DISCOUNT) / states[a - 1][1]
            self.arcs[a][b] = math.log10(p)
            kept[a] += p
            covered[a] += share[b]
        self.fail = [math.log10(max(1 - k, 1e-12) / (1 - c)) for k, c in zip(kept, covered, strict=True)]

    def score(self, tokens: list[bytes]) -> tuple[float, float, int, Counter[bytes]]:
        """One traversal: the automaton's score and the base score without rare tokens' unigram weights, the tokens that are states, and the rare tokens."""
        number, arcs, fail, unigram = self.number.get, self.arcs, self.fail, self.unigram
        score = base = 0.0
        rare: list[bytes] = []
        state = number(END, 0)
        for token in tokens:
            k = number(token)
            if k is None:
                rare.append(token)
                score += fail[state]
                state = 0
                continue
            weight = arcs[state].get(k)
            score += fail[state] + unigram[k] if weight is None else weight
            base += unigram[k]
            state = k
        return score, base, len(tokens) - len(rare), Counter(rare)


def keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for two codes, as good as a 64-bit hash."""
    return first ^ (second << np.uint64(21) | second >> np.uint64(43))


def _key(first: str, second: str):
    return F.col(first).bitwiseXOR(F.shiftleft(second, 21).bitwiseOR(F.shiftrightunsigned(second, 43)))


def _pairs(docs: DataFrame) -> DataFrame:
    """a, b, n: how often token b follows token a, by their codes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _chunks(batches):
            _, at, n = np.unique(keys(ids[:-1], ids[1:]), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[:-1][at].view(np.int64), ids[1:][at].view(np.int64), n)], ["a", "b", "n"])

    return arrow_map(docs.select("text"), work, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _sieve(arcs: DataFrame) -> np.ndarray:
    """Words of 64 bits, 2 ** SIEVE_BITS in all: set where an arc's key (column h) begins with the bit's number."""
    place = F.shiftrightunsigned("h", 64 - SIEVE_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = arcs.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _most(table: DataFrame, name: str, most: int, least: int) -> int:
    """The least bound, from ``least`` on, that at most ``most`` rows reach."""
    bound, rows = None, 0
    for x in table.groupBy(name).count().orderBy(F.desc(name)).toLocalIterator():
        rows += x["count"]
        if rows > most or x[name] < least:
            break
        bound = x[name]
    return bound or (1 << 62)


def score(docs: DataFrame, hot_tokens: int = HOT_TOKENS, hot_arcs: int = HOT_ARCS) -> DataFrame:
    """Scores of all documents by a model of those that are not held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The
    base is a smoothed unigram model of every training token; the automaton
    adds every bigram that the training texts hold LEAST_ARC times, and backs
    off to the base, so both give a probability to every token.

    A text's score is its base, the failure weight of each of its tokens as a
    history, and for each arc what it gives above failing. So arcs and tokens
    are rows of one stored table, which the texts' tokens and bigrams meet in a
    join by hash. The most frequent ones, at most ``hot_tokens`` and
    ``hot_arcs``, are broadcast instead, so no key of a join is frequent, and
    a sieve of fixed size spares most bigrams that are no arcs the way.

    A null or empty text is the end token alone; a null doc_id trains; repeated
    rows are counted and scored each; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    train = docs.where(~held_out())
    counts = stored(token_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    norm = float(total + 0.5 * (distinct + 1))
    bound = _most(counts, "c", hot_tokens, 1)
    hot, rare = stored(counts.where(F.col("c") >= bound)), counts.where(F.col("c") < bound)

    def with_values(rows: DataFrame, code: str, few: DataFrame, many: DataFrame) -> DataFrame:
        """``rows`` with the columns that tables of hot and of rare tokens have for a code."""
        few, many = few.withColumnRenamed("code", code), many.withColumnRenamed("code", code)
        others = rows.join(F.broadcast(hot.select(F.col("code").alias(code))), code, "left_anti")
        return rows.join(F.broadcast(few), code).unionByName(others.join(many, code))

    share = lambda c: (F.col(c) + 0.5) / F.lit(norm)
    pairs = stored(_pairs(train).where(F.col("n") >= LEAST_ARC))
    arcs = with_values(pairs, "b", hot.withColumnRenamed("c", "cb"), rare.withColumnRenamed("c", "cb"))
    histories = arcs.groupBy(F.col("a").alias("code")).agg(F.sum(F.col("n") - DISCOUNT).alias("kept"), F.sum(share("cb")).alias("covered"))
    histories = with_values(histories, "code", hot, rare)
    fail = F.log10(F.greatest(1 - F.col("kept") / F.col("c"), F.lit(1e-12)) / (1 - F.col("covered")))
    histories = stored(histories.select("code", F.col("c").alias("ca"), fail.alias("fail")))
    hot_histories = stored(histories.join(F.broadcast(hot.select("code")), "code", "left_semi"))
    rare_histories = histories.join(F.broadcast(hot.select("code")), "code", "left_anti")
    gain = F.log10((F.col("n") - DISCOUNT) / F.col("ca")) - F.col("fail") - F.log10(share("cb"))
    arcs = stored(with_values(arcs, "a", hot_histories, rare_histories).select(_key("a", "b").alias("h"), "n", gain.alias("gain")))
    hot_bound = _most(arcs, "n", hot_arcs, LEAST_ARC)
    others = arcs.where(F.col("n") < hot_bound)

    def ordered(frame: DataFrame, key: str, *values: str) -> tuple[np.ndarray, ...]:
        found = frame.select(key, *values).toArrow()
        numbers = found[key].to_numpy().view(np.uint64)
        order = np.argsort(numbers)
        return numbers[order], *(found[x].to_numpy()[order] for x in values)

    known = hot.join(F.broadcast(hot_histories.select("code", "fail")), "code", "left")
    states, unigram, fails = ordered(known.select("code", F.log10(share("c")).alias("p"), F.coalesce("fail", F.lit(0.0)).alias("fail")), "code", "p", "fail")
    shared = spark.sparkContext.broadcast((states, unigram, unigram + fails, *ordered(arcs.where(F.col("n") >= hot_bound), "h", "gain"), _sieve(others)))
    names = ["rid", "h", "tf", "doc_id", "held_out", "n_tokens", "n_states", "base", "auto"]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, unigram, both, arc, gains, sieve = shared.value
        state_of, arc_of = Places(states), Places(arc)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, sizes = coded(utf8(batch, "text"))
            rid = batch.column("rid").to_numpy()
            # A text's tokens as histories, its end standing first, are its tokens; each is followed by the next or by the end.
            doc, first = np.repeat(np.arange(n), sizes), ids[:-1]
            at, pair = state_of(first), keys(first, ids[1:])
            known, place = at >= 0, arc_of(pair)
            held = place >= 0
            base = np.bincount(doc[known], unigram[at[known]], n)
            auto = np.bincount(doc[known], both[at[known]], n) + np.bincount(doc[held], gains[place[held]], n)
            # The row of the document itself has a key that spreads it and finds nothing.
            own = [rid, mixed(rid.view(np.uint64) + np.uint64(1)).view(np.int64), np.zeros(n, np.int64), batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), sizes, np.bincount(doc[known], minlength=n), base, auto]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(own, kinds, strict=True)], names)
            bit = pair >> np.uint64(64 - SIEVE_BITS)
            sought = (sieve[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool) & ~held
            # Other tokens count above zero, other bigrams below it.
            for value, chosen, sign in ((first, ~known, 1), (pair, sought, -1)):
                h, d = value[chosen], doc[chosen]
                _, one, times = np.unique(mixed(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                if len(one):
                    found = [pa.array(rid[d[one]]), pa.array(h[one].view(np.int64)), pa.array(sign * times)]
                    yield pa.RecordBatch.from_arrays(found + [pa.nulls(len(one), t) for t in kinds[3:]], names)

    rows = arrow_map(Rows(docs).numbered("doc_id", "text").withColumn("held_out", held_out()), work, "rid long, h long, tf long, doc_id long, held_out boolean, n_tokens long, n_states long, base double, auto double")
    tokens = rare.join(rare_histories.select("code", "fail"), "code", "left").select(F.col("code").alias("h"), "c", F.coalesce("fail", F.lit(0.0)).alias("more"))
    others = others.select("h", F.lit(0).cast("long").alias("c"), F.col("gain").alias("more"))
    met = rows.join(tokens.unionByName(others), "h", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("more", F.coalesce("more", F.lit(0.0)))
    own, token = F.col("n_tokens").isNotNull(), F.col("tf") > 0
    weight = F.when(token, F.col("tf") * F.log10(share("c"))).otherwise(0.0)
    out = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_states") + F.sum(F.when(token & (F.col("c") > 0), F.col("tf")).otherwise(0))).alias("n_known"),
        F.sum(F.when(own, F.col("base")).otherwise(weight)).alias("base_score"),
        F.sum(F.when(own, F.col("auto")).otherwise(weight + F.abs("tf") * F.col("more"))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
