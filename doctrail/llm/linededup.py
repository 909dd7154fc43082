"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. It is removed where an earlier
line (by doc_id, then position) of any document has a Jaccard similarity of at
least ``similarity`` with it. Lines of fewer than ``least`` different words stay.

The join orders words by rarity, looks up only the words of a prefix that two
similar sets must share, and tests length, position and a parity signature
before the sets themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctrail.llm.common import checkpoint, stored

SIMILARITY, LEAST = 0.8, 1
#: Words are counted in so many cells: a fixed size, whatever the corpus.
CELL_BITS = 18
CELLS = 1 << CELL_BITS
#: Lines with a key alike (their least and greatest hash, or their first RUN words) are compared with
#: the closest of the first HEADS of them before the join.
RUN, HEADS = 4, 16
#: Signatures of lines with more words have twice the cells.
LONG = 32
#: A line has a signature of its words from place 0 on, and from (2 << k) - 2 on for k to this one.
STEPS = 4
LOWEST = -(1 << 63)
#: Lines to be compared, and keys, are broadcast up to so many; more meet in a shuffle.
ASKED = 500_000
#: The positions that stay are broadcast to the texts up to so many, in lists of up to ASKED documents.
PLACES = 4_000_000
#: A posting's number: the line's words, the place, whether the line is settled, and the signature's step.
WORDS, PLACE, SETTLED, STEP = 32, 4, 8, 7


#: White space within a line besides the blank.
BLANKS = "\t\x0b\f\r"


def _words(line: Column) -> Column:
    """Lower-cased words, and empty ones; a split on one character is a plain search, so other white space becomes blanks where there is any."""
    other = F.lit(False)
    for x in BLANKS:
        other = other | line.contains(x)
    plain = F.when(other, F.translate(line, BLANKS, " " * len(BLANKS))).otherwise(line)
    return F.split(F.lower(plain), " ")


def _hashes(line: Column) -> Column:
    """Hashes of the different words, by their first places; the empty word's is taken out, as longs are cheaper to compare."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def rarity(texts: DataFrame) -> DataFrame:
    """One row: an array with the rank of each cell, rarest first, as the high bits of a word.

    All texts are counted, whole, by what stands between blanks and line ends:
    the order decides the work and not the result, so it can do without the
    other white space.
    """
    words = texts.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    counts = words.select(_cell(F.xxhash64("w")).alias("cell")).groupBy("cell").count()
    every = texts.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left").select("cell", F.coalesce("count", F.lit(0)).alias("count"))
    by_count = F.sort_array(F.collect_list(F.struct("count", "cell")))
    placed = every.agg(by_count.alias("s")).select(F.posexplode("s").alias("rank", "s")).select("rank", F.col("s.cell").alias("cell"))
    high = F.shiftleft(F.col("rank").cast("long") - (CELLS >> 1), 64 - CELL_BITS).alias("high")
    return placed.select("cell", high).agg(F.sort_array(F.collect_list(F.struct("cell", "high"))).alias("s")).select(F.transform("s", lambda x: x["high"]).alias("ranks"))


def _ranks(texts: DataFrame) -> Column:
    """The ranks as a scalar; while they are counted, the first hash map of an aggregation has room for all cells."""
    conf, room = texts.sparkSession.conf, "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = conf.get(room, None)
    conf.set(room, str(CELL_BITS))
    try:
        return checkpoint(rarity(texts)).scalar()
    finally:
        conf.unset(room) if before is None else conf.set(room, before)


def _ordered(hashes: Column, ranks: Column) -> Column:
    """Words as longs in order of rarity: the cell's rank, then the other bits; no two words' hashes become one.

    The rank is declared never null, so that the sort is one of plain longs.
    """
    rank = lambda h: F.coalesce(F.get(ranks, _cell(h)), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: rank(h).bitwiseOR(F.shiftrightunsigned(h, CELL_BITS))))


def _tag(word: Column) -> Column:
    """31 bits of a word's hash: the word itself in the join, and its cell in the signatures."""
    return F.shiftrightunsigned(word, 33).cast("int")


def _bit(tag: Column, unit: Column) -> Column:
    """The tag's cell, its low six bits, as a shift takes no others."""
    return F.call_function("shiftleft", unit, tag)


def _signature(words: Column, half: bool = False) -> Column:
    """Parity of the words in 64 cells, of all or of one half of them.

    A word in one of two sets alone flips one bit, so signatures differ in no
    more bits than the sets in words. The half's signature and the rest's make
    one of 128 cells, which tells longer lines apart.
    """
    unit = (lambda w: F.shiftrightunsigned(w, 39).bitwiseAND(F.lit(1))) if half else (lambda w: F.lit(1).cast("long"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(_bit(_tag(w), unit(w))))


def _parity(tags: Column, half: bool) -> Column:
    """The same of tags."""
    unit = (lambda p: F.shiftrightunsigned(p, 6).bitwiseAND(F.lit(1)).cast("long")) if half else (lambda p: F.lit(1).cast("long"))
    return F.aggregate(tags, F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(_bit(p, unit(p))))


def _apart(a: str, b: str, na: Column, nb: Column) -> Column:
    """Bits in which the signatures (sig and, for long lines, half) of two lines differ: at most the words in which they do."""
    whole = F.col(f"{a}sig").bitwiseXOR(F.col(f"{b}sig"))
    half = F.when((na > LONG) & (nb > LONG), F.col(f"{a}half").bitwiseXOR(F.col(f"{b}half"))).otherwise(F.lit(0).cast("long"))
    return F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)


def _need(n: Column, similarity: float) -> Column:
    """The least number of words that two similar sets of ``n`` words together share."""
    return F.ceil(n * (similarity / (1 + similarity)) - 1e-9)


def _sets(lines: DataFrame, ranks: Column, keep: list[str], least: int) -> DataFrame:
    """``keep``, hashes (of the words in their order) and words (ordered by rarity) of lines with enough words.

    A generator, unlike a projection or filter, is not merged with its
    neighbours, so that no array is computed twice; the ranks, a scalar
    subquery, are read within one projection and never copied into rows.
    """
    enough = lambda words: F.explode(F.filter(F.array(words), lambda w: F.size(w) >= least))
    hashed = lines.select(*keep, _hashes(F.col("line")).alias("hashes")).select(*keep, enough(F.col("hashes")).alias("hashes"))
    sets = hashed.withColumn("ranks", ranks).select(*keep, "hashes", _ordered(F.col("hashes"), F.col("ranks")).alias("words"))
    return sets.select(*keep, "hashes", enough(F.col("words")).alias("words"))


#: What tells a line: its document, its place, and its words for documents of one id.
LINE = ["did", "pos", "id"]


def _meet(rows: DataFrame, few: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join with a checkpointed table, which is broadcast where its counted rows are few."""
    return rows.join(F.broadcast(few) if few.count() <= ASKED else few, on, how)


def _similar(pairs: DataFrame, classes: DataFrame, lines: DataFrame, ranks: Column, similarity: float, least: int) -> DataFrame:
    """Of pairs of lines (y_..., x_... with did, pos, id), the y whose sets are similar: did, pos, id."""
    y, x = (F.struct(*[F.col(f"{s}_{c}").alias(c) for c in LINE]) for s in "yx")
    wanted = checkpoint(pairs.select(F.explode(F.array(y, x)).alias("l")).select("l.*").distinct())
    asked = checkpoint(_meet(classes.select("dh", *LINE), wanted, LINE))
    sets = _sets(_meet(lines, asked, ["did", "dh", "pos"]), ranks, LINE, least).drop("hashes").dropDuplicates(LINE)
    left = pairs.join(sets.select(*[F.col(c).alias(f"y_{c}") for c in LINE], F.col("words").alias("y_words")), [f"y_{c}" for c in LINE])
    both = left.join(sets.select(*[F.col(c).alias(f"x_{c}") for c in LINE], F.col("words").alias("x_words")), [f"x_{c}" for c in LINE])
    shared = F.size(F.array_intersect("y_words", "x_words"))
    good = both.where(shared >= _need(F.size("y_words") + F.size("x_words"), similarity))
    return good.select(*[F.col(f"y_{c}").alias(c) for c in LINE]).distinct()


def _led(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (y_..., x_...) of a line and the closest of the first lines that have a key in common with it, where it may be similar."""
    keys = F.array(*[F.when(F.col("n") > RUN, F.col(f"key{i}").cast("long") + (i << 32)) for i in range(2)])
    ends = classes.select(*LINE, "sig", "half", "n", F.explode(F.array_compact(keys)).alias("k"))
    shared = checkpoint(ends.groupBy("k").count().where("count > 1").select("k"))
    ends = stored(_meet(ends, shared, "k"))
    # Only the first few of a key leave each task, however many lines have it.
    first = ends.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*LINE))).where(F.col("r") <= HEADS)
    heads = checkpoint(first.select("k", *[F.col(c).alias(f"x_{c}") for c in (*LINE, "sig", "half", "n")]))
    met = _meet(ends.select("k", *[F.col(c).alias(f"y_{c}") for c in (*LINE, "sig", "half", "n")]), heads, "k")
    total, apart = F.col("y_n") + F.col("x_n"), _apart("y_", "x_", F.col("y_n"), F.col("x_n"))
    later = F.struct(*[f"y_{c}" for c in LINE]) > F.struct(*[f"x_{c}" for c in LINE])
    sized = F.least("y_n", "x_n") >= F.greatest("y_n", "x_n") * similarity - 1e-9
    close = met.where(later & sized & (apart <= total - 2 * _need(total, similarity)))
    best = close.groupBy(*[f"y_{c}" for c in LINE]).agg(F.min(F.struct((apart / total).alias("apart"), *[f"x_{c}" for c in LINE])).alias("x"))
    return best.select(*[f"y_{c}" for c in LINE], *[f"x.x_{c}" for c in LINE])


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """did, dh, kept: by document (its id, null as the lowest long, and its text's hash) the positions of its compared lines that stay."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("did"), F.coalesce("text", F.lit("")).alias("text")).select("did", F.xxhash64("text").alias("dh"), "text")
    ranks = _ranks(keyed.select("text"))
    lines = keyed.select("did", "dh", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    sets = _sets(lines, ranks, ["did", "dh", "pos"], least)
    n = F.size("words")
    prefix = F.transform(F.slice("words", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")), _tag)
    keys = [F.hash(F.array_min("hashes"), F.array_max("hashes")), F.hash(F.slice("hashes", 1, RUN))]
    half = F.when(n > LONG, _signature(F.col("words"), True)).otherwise(F.lit(0).cast("long"))
    first = F.struct("did", "pos", F.xxhash64("words").alias("id"), "dh", _signature(F.col("words")).alias("sig"), half.alias("half"), prefix.alias("prefix"), *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    # Lines with the same set are one class, led by the first of them; partial minima meet in the shuffle.
    classes = stored(sets.select(F.xxhash64("words").alias("c"), n.alias("n"), first.alias("f")).groupBy("c", "n").agg(F.min("f").alias("f")).select("n", "f.*"))

    # Most lines of a large group of near copies are settled in linear work, by one comparison each.
    settled = checkpoint(_similar(checkpoint(_led(classes, similarity)), classes, lines, ranks, similarity, least))

    # The join: every class is looked up by its prefix; only classes not settled look for an earlier one. A similar pair
    # passes at its first common word: all words before it differ, so the signatures from there on differ little. Both
    # sides are one exchange, as the condition tells settled lines.
    open_ = _meet(classes.select("n", "prefix", "sig", "half", *LINE), checkpoint(settled.withColumn("settled", F.lit(SETTLED))), LINE, "left")
    cut = lambda k, half: _parity(F.slice("prefix", (2 << k) - 1, 2 << k), half)
    cuts = [cut(k, False).alias(f"sig{k}") for k in range(STEPS)] + [F.when(F.col("n") > LONG, cut(k, True)).otherwise(F.lit(0).cast("long")).alias(f"half{k}") for k in range(STEPS)]
    postings = open_.select("*", *cuts).select("*", F.posexplode("prefix").alias("i", "w"))
    reached = [F.col("i") >= (4 << k) - 2 for k in range(STEPS)]

    def from_step(name: str) -> Column:
        out = F.col(name)
        for k in range(STEPS):
            out = out.bitwiseXOR(F.when(reached[k], F.col(f"{name}{k}")).otherwise(F.lit(0).cast("long")))
        return out.alias(name)

    step = sum((x.cast("long") for x in reached), F.coalesce("settled", F.lit(0)))
    number = F.shiftleft(F.col("n").cast("long"), WORDS).bitwiseOR(F.shiftleft(F.col("i").cast("long"), PLACE)).bitwiseOR(step)
    postings = postings.select(*LINE, from_step("sig"), from_step("half"), number.alias("number"), "w")
    y, x = postings.alias("y"), postings.alias("x")
    yn, xn = (F.shiftright(f"{s}.number", WORDS) for s in "yx")
    yi, xi = (F.shiftright(F.col(f"{s}.number").bitwiseAND(F.lit((1 << WORDS) - 1)), PLACE) for s in "yx")
    steps = [F.call_function("shiftleft", F.lit(2).cast("long"), F.col(f"{s}.number").bitwiseAND(F.lit(STEP)).cast("int")) for s in "yx"]
    later = (F.col("y.did") > F.col("x.did")) | ((F.col("y.did") == F.col("x.did")) & (F.struct("y.pos", "y.id") > F.struct("x.pos", "x.id")))
    open_y = F.col("y.number").bitwiseAND(F.lit(SETTLED)) <= F.col("x.number").bitwiseAND(F.lit(0))
    left = F.least(yn - yi, xn - xi) * ((1 + similarity) / similarity) >= yn + xn - 1e-9
    near = steps[0] + steps[1] - 4 + _apart("y.", "x.", yn, xn) <= (yn + xn) * ((1 - similarity) / (1 + similarity)) + 1e-9
    pairs = y.join(x, (F.col("y.w") == F.col("x.w")) & open_y & later & left & near)
    pairs = checkpoint(pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "yx" for c in LINE]).distinct())
    late = _similar(pairs, classes, lines, ranks, similarity, least)

    gone = checkpoint(settled.unionByName(late))
    kept = _meet(classes.select("dh", *LINE), gone, LINE, "left_anti")
    return kept.groupBy("did", "dh").agg(F.collect_list("pos").alias("kept"))


def cut_lines(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """row (all columns as a struct), text, n_lines, n_removed: texts without their removed lines.

    Rows alike in doc_id and text are one document and keep the same lines; a
    null doc_id comes before all others; a null text is empty; an empty table
    gives no rows; other columns pass as they are, whatever their names. A
    document all of whose lines are removed has an empty text.
    """
    kept = checkpoint(kept_lines(docs, similarity, least))
    rows, places = kept.agg(F.count("*"), F.coalesce(F.sum(F.size("kept")), F.lit(0))).first()
    kept = F.broadcast(kept) if rows <= ASKED and places <= PLACES else kept
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("did"), F.xxhash64(text).alias("dh"), F.split(text, "\n").alias("lines"))
    met = named.join(kept, ["did", "dh"], "left")
    # Places are put together and looked up, so that a document of many lines costs linear work.
    few = (lambda line: F.btrim(line, F.lit(" " + BLANKS)) == "") if least == 1 else (lambda line: F.size(_hashes(line)) < least)
    other = F.filter(F.transform("lines", lambda line, pos: F.when(few(line), pos)), lambda pos: pos.isNotNull())
    places = F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), other))
    left = met.withColumn("left", F.transform(places, lambda pos: F.get("lines", pos)))
    return left.select("row", F.array_join("left", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """The rows and columns of ``docs`` with the removed lines cut from ``text``; see ``cut_lines``."""
    cut = cut_lines(docs, similarity, least)
    return cut.select(*[F.col("text") if x == "text" else F.col("row")[x].alias(x) for x in docs.columns])
