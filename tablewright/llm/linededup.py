"""Line dedup: repeated runs of lines, found by prefix doubling over line-id sequences; later copies are deleted.

DataFrame functions only. The suffixes of every document's line-id sequence get, level by level, the rank of their first 2^k
lines among all suffixes (an order-preserving number from a range sort of the distinct pairs of ranks of level k - 1);
suffixes whose rank nobody shares drop out, so each level works on what still repeats; at the last level that any
repeated run reaches, ranks are those of the suffix array of all that repeats.

In a suffix array the suffixes that share their first m lines are one interval, inside which neighbours have common prefixes
of m lines or more. Here that interval is the group of equal (m, rank of the first 2^k lines, rank of the 2^k lines that end
at m), k being the last level with 2^k <= m: the two stretches cover the m lines, and ranks of a level are equal only for equal
lines, so the group holds exactly the suffixes of the interval. A run is right-maximal, and named, for every length at which
enough words are reached. Of each interval of enough words the first suffix stays and the lines of the others go; what goes
is merged into maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.shared import cut, named, unplaced, whole_row

#: Words that a repeated run of lines must have.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
_DOC = ["i", "t"]


def _keys(id_column: str, text_name: str) -> tuple[Column, Column, Column]:
    """Id (null as the least number), hash of the text, and the text with null as empty."""
    text = F.coalesce(named(text_name).cast("string"), F.lit(""))
    return F.coalesce(named(id_column).cast("bigint"), F.lit(-(1 << 63))), F.xxhash64(text), text


def _lines(docs: DataFrame, id_column: str, text_name: str) -> DataFrame:
    """(i, t, pos, h, g, w): the lines of distinct documents, named by two 64-bit hashes, with their words."""
    i, t, text = _keys(id_column, text_name)
    parts = F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.select(i.alias("i"), t.alias("t"), parts.alias("parts")).dropDuplicates(_DOC)
    return rows.select("i", "t", F.posexplode("parts").alias("pos", "x")).select("i", "t", "pos", "x.h", "x.g", "x.w")


def _least_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(i, t, s, m): from every start, and to every end, the shortest run of enough words, if all its lines repeat.

    Every longer run of repeated lines is the union of such runs.
    """
    before = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    summed = lines.select(*_DOC, "pos", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("p"), F.coalesce(F.sum((~F.col("again")).cast("int")).over(before), F.lit(0)).alias("b"), "w", "again")
    each = summed.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("pos", "p", "b", "w", "again"))).alias("x"), F.max("again").alias("some"))
    sums = each.where("some").selectExpr(
        *_DOC,
        "size(x) AS n",
        "concat(x.p, array(element_at(x, -1).p + element_at(x, -1).w)) AS p",
        "concat(x.b, array(element_at(x, -1).b + IF(element_at(x, -1).again, 0, 1))) AS b",
    )
    steps = "sequence(1, CAST(ceil(log2(n + 2)) AS INT) + 1)"

    def first(low: str, high: str, test: str) -> str:
        """The first number of [low, high) that passes a monotone test of ``mid``, else high: halving."""
        state = f"named_struct('lo', CAST({low} AS INT), 'hi', CAST({high} AS INT))"
        return f"aggregate({steps}, {state}, (z, k) -> IF(z.lo >= z.hi, z, IF({test.replace('mid', '((z.lo + z.hi) DIV 2)')}, named_struct('lo', z.lo, 'hi', CAST((z.lo + z.hi) DIV 2 AS INT)), named_struct('lo', CAST((z.lo + z.hi) DIV 2 + 1 AS INT), 'hi', z.hi))), z -> z.lo)"

    from_start = f"transform(sequence(0, n - 1), s -> named_struct('s', s, 'e', {first('s + 1', 'n + 1', f'get(p, mid) >= get(p, s) + {min_words}')}))"
    to_end = f"transform(sequence(1, n), e -> named_struct('s', {first('0', 'e', f'get(p, mid) > get(p, e) - {min_words}')} - 1, 'e', e))"
    runs = sums.selectExpr(*_DOC, f"filter(concat({from_start}, {to_end}), r -> r.s >= 0 AND r.e <= n AND get(b, r.e) = get(b, r.s)) AS runs")
    return runs.select(*_DOC, F.explode(F.array_distinct("runs")).alias("r")).selectExpr(*_DOC, "r.s AS s", "r.e - r.s AS m")


def _double(ranks: DataFrame, width: int) -> DataFrame:
    """Ranks (i, t, pos, r) of twice the width, of suffixes that share theirs with another."""
    ahead = ranks.select("i", "t", (F.col("pos") - width).alias("pos"), F.col("r").alias("b"))
    pairs = ranks.withColumnRenamed("r", "a").join(ahead, ["i", "t", "pos"])
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    # in the order of the pairs, so a rank's order is that of the lines
    ranked = cut(shared.orderBy("a", "b").withColumn("r", F.monotonically_increasing_id()))
    return cut(pairs.join(ranked, ["a", "b"]).select("i", "t", "pos", "r"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_name: str = "text") -> DataFrame:
    """(i, t, gone array<struct<s,e>>) for documents with lines to delete: maximal runs [s, e) of line numbers, in order.

    A line goes if it lies in a run of at least ``min_words`` words that also begins at an earlier place: in a
    document of smaller id (of equal id: of smaller text hash), or further up in the same one, where the two may overlap.
    """
    lines = _lines(docs, id_column, text_name)
    often = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    # level 0: a line's rank is its place among the names of the lines that repeat
    ranked = cut(often.orderBy("h", "g").withColumn("r", F.monotonically_increasing_id())).select(unplaced(F.col("h")).alias("h2"), unplaced(F.col("g")).alias("g2"), "r")
    marked = cut(lines.join(ranked, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")), "left").select(*_DOC, "pos", "r", "w", F.col("r").isNotNull().alias("again")))
    runs = cut(_least_runs(marked, min_words).withColumn("k", F.floor(F.log2("m")).cast("int")))
    most = runs.agg(F.max("k")).first()[0]
    ranks = marked.where("again").select(*_DOC, "pos", "r")
    gone = None
    for k in range((most if most is not None else -1) + 1):
        if k:
            ranks = _double(ranks, 1 << (k - 1))
        at_start = ranks.select("i", "t", F.col("pos").alias("s"), F.col("r").alias("a"))
        at_end = ranks.select("i", "t", (F.col("pos") + (1 << k)).alias("e"), F.col("r").alias("b"))
        mine = runs.where(F.col("k") == k).withColumn("e", F.col("s") + F.col("m"))
        named = mine.join(at_start, ["i", "t", "s"]).join(at_end, ["i", "t", "e"]).select("i", "t", "s", "e", "m", "a", "b") if k else mine.join(at_start, ["i", "t", "s"]).select("i", "t", "s", "e", "m", "a", F.col("a").alias("b"))
        first = named.groupBy("m", "a", "b").agg(F.min(F.struct("i", "t", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("m").alias("fm"), unplaced(F.col("a")).alias("fa"), unplaced(F.col("b")).alias("fb"), "first")
        # each level is computed once, so that no plan holds the joins of all levels
        later = cut(named.join(first, (F.col("m") == F.col("fm")) & (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where(F.struct("i", "t", "s") != F.col("first")).select("i", "t", "s", "e"))
        gone = later if gone is None else gone.unionAll(later)
    if gone is None:
        gone = runs.select("i", "t", "s", F.col("m").alias("e"))
    row = Window.partitionBy(*_DOC).orderBy("s", "e")
    reach = gone.distinct().withColumn("reach", F.max("e").over(row.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("s"), 0).otherwise(1)).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    merged = cut(island.groupBy(*_DOC, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")))
    return merged.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("gone"))


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_name: str = "text") -> DataFrame:
    """(row, text, n_lines, n_gone) for every row of ``docs``: all its columns as a struct, the text without later copies, its
    numbers of lines and of lines that went.

    Lines are parted by \\n only. Null texts stay null and empty ones empty; a document that loses all lines has an empty
    text. Rows that repeat an id and a text are one document and get the same answer. Null ids come before all others.
    """
    found = later_copies(docs, min_words, id_column, text_name).select(F.col("i").alias("of"), F.col("t").alias("hash"), "gone")
    i, t, _ = _keys(id_column, text_name)
    rows = docs.select(whole_row(docs), i.alias("i"), t.alias("t"))
    joined = rows.join(found, (F.col("i") == F.col("of")) & (F.col("t") == F.col("hash")), "left")
    parts = F.split(F.coalesce(F.col("row")[text_name].cast("string"), F.lit("")), "\n")
    kept = F.expr("transform(sequence(0, size(gone)), x -> named_struct('s', IF(x = 0, 0, get(gone, x - 1).e), 'e', IF(x = size(gone), size(parts), get(gone, x).s)))")
    joined = joined.withColumn("parts", F.when(F.col("gone").isNotNull(), parts)).withColumn("kept", kept)
    left = F.expr("array_join(transform(filter(kept, x -> x.e > x.s), x -> array_join(slice(parts, x.s + 1, x.e - x.s), '\n')), '\n')")
    n_gone = F.coalesce(F.expr("aggregate(gone, 0L, (z, x) -> z + x.e - x.s)"), F.lit(0).cast("bigint"))
    text = F.when(F.col("gone").isNull(), F.col("row")[text_name].cast("string")).otherwise(left)
    return joined.select("row", text.alias("text"), F.size(parts).cast("bigint").alias("n_lines"), n_gone.alias("n_gone"))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_name: str = "text") -> DataFrame:
    """``docs`` with all columns, the text without later copies, as ``cleaned`` gives it; emptied documents stay."""
    told = cleaned(docs, min_words, id_column, text_name)
    row = F.col("row")
    return told.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if c.lower() == text_name.lower() else row[c].alias(c) for c in docs.columns))
