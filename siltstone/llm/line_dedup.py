"""Repeated line runs by distributed prefix doubling over line-ID sequences, in DataFrame operations only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import KEY, Scratch, document_key

#: A repeated run of lines counts from so many words on (runs of characters that are no ASCII white space).
MIN_WORDS = 50

def number_lines(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``begin``, the number of lines in all earlier documents, to (*KEY, n_lines).

    Earlier: smaller id, then key. One range shuffle of small rows; only each part's total reaches
    the driver.
    """
    dealt = scratch.save(sizes.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "sizes")
    totals = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.sum("n_lines")).collect())
    before = [(part, end - n) for (part, n), end in zip(totals, accumulate(n for _, n in totals), strict=True)]
    offsets = sizes.sparkSession.createDataFrame(before, "part int, offset bigint")
    running = Window.partitionBy("part").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("offset") + F.coalesce(F.sum("n_lines").over(running), F.lit(0))
    return dealt.join(F.broadcast(offsets), "part").select(*KEY, begin.alias("begin"))


def ranked(groups: DataFrame, *key: str) -> DataFrame:
    """Adds ``rank``, which grows with the key: ids handed out along a global sort of distinct keys."""
    return groups.select(*key).orderBy(*key).withColumn("rank", F.monotonically_increasing_id())


def prefix_ranks(positions: DataFrame, longest: int, scratch: Scratch) -> list[DataFrame]:
    """The inverse suffix array by the first 1, 2, 4, ... lines, up to ``longest``: for each length (g, r, left).

    positions: place g, rank r of its line among repeated lines, and the repeated lines ``left``
    from here to the end of their stretch. Each round pairs the ranks of both halves of a prefix
    and ranks the pairs in one sort of the distinct ones, so ranks grow with suffix order; a suffix
    whose prefix is unique is settled and goes.
    """
    levels = [positions]
    while 1 << len(levels) <= longest:
        half = 1 << (len(levels) - 1)
        now = levels[-1]
        second = now.select((F.col("g") - half).alias("g"), F.col("r").alias("r2"))
        pairs = scratch.save(now.filter(F.col("left") >= 2 * half).join(second, "g"), "pairs")
        twice = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).filter("n > 1")
        names = scratch.save(ranked(twice, "r", "r2"), "names")
        levels.append(scratch.save(pairs.join(names, ["r", "r2"]).select("g", F.col("rank").alias("r"), "left"), "level"))
        scratch.drop(pairs, names)
    return levels


def lcp_intervals(wanted: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(begin, g, n, r, r2) of (begin, g, n): the LCP interval of depth n that the suffix at g lies in, named (n, r, r2).

    An LCP interval of depth n holds the suffixes whose common prefix has n lines or more, which are
    neighbours in suffix order. With 2**k the largest power up to n, these are the suffixes that agree
    in the ranks of the first and of the last 2**k of those lines, as both together cover them; so an
    interval is a key, and its members need not be brought to one place to be compared.
    """
    level = sum([F.when(F.col("n") >= 1 << k, 1).otherwise(0) for k in range(1, len(levels))], F.lit(0))
    sought = wanted.withColumn("level", level.cast("int"))
    ranks = levels[0].select("g", "r", F.lit(0).alias("level"))
    for k, one in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(one.select("g", "r", F.lit(k).alias("level")))
    tail = ranks.select(F.col("g").alias("tail"), F.col("r").alias("r2"), "level")
    found = sought.join(ranks, ["g", "level"]).withColumn("tail", F.expr("g + n - shiftleft(1, level)")).join(tail, ["tail", "level"])
    return scratch.save(found.select("begin", "g", "n", "r", "r2"), "found")


def shortest_units(units: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(begin, g, n) twice: the shortest n lines with min_words words that start at g, and those that end where
    some line does (g is their first).

    units: (begin, stretch, g, words, upto), upto being the words of the stretch up to and with g. As these
    grow along a stretch, a unit's other end is looked up in their order, however far away it is.
    """
    before = F.col("upto") - F.col("words")
    none = F.lit(None).cast("bigint")

    def looked_up(known: Column, wanted: Column, order: Column, best) -> DataFrame:
        pairs = F.array(F.struct(known.alias("at"), F.col("g").alias("place"), none.alias("asks")), F.struct(wanted.alias("at"), none.alias("place"), F.col("g").alias("asks")))
        rows = units.select("begin", "stretch", F.inline(pairs))
        # of equal values places come before those that ask for them
        passed = Window.partitionBy("begin", "stretch").orderBy(order, F.col("place").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("end", best("place").over(passed)).filter("asks IS NOT NULL AND end IS NOT NULL")

    fore = looked_up(F.col("upto"), before + min_words, F.desc("at"), F.min)
    back = looked_up(before, F.col("upto") - min_words, F.asc("at"), F.max)
    return fore.select("begin", F.col("asks").alias("g"), F.expr("end - asks + 1").alias("n")), back.select("begin", F.col("end").alias("g"), F.expr("asks - end + 1").alias("n"))


def repeated_runs(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(*KEY, runs): for documents with later copies of line runs, the stretches of lines [first, end) to delete.

    All lines of all documents, in the order of their ids, form one sequence of line IDs. A run
    of lines with min_words words or more that also occurs earlier in the sequence is a copy. Every
    such run is the union of its shortest qualifying parts that start or end at some line (units).
    The LCP interval of a unit's depth holds all places where it stands; all but the smallest are
    copies, and overlapping copies together are the maximal runs that go.
    """
    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    rows = docs.filter(F.col(f"`{text_col}`").isNotNull()).select(*document_key(id_col, text_col), lines.alias("lines"))
    sizes = rows.select(*KEY, F.size("lines").cast("bigint").alias("n_lines")).distinct()
    begins = scratch.save(number_lines(sizes, scratch), "begins")
    spaced = F.trim(F.translate("line", "\t\x0b\x0c\r", "    "))
    words = F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +")))
    each = rows.select(*KEY, F.posexplode("lines").alias("no", "line"))
    each = each.select(*KEY, "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words.alias("words"))
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    names = scratch.save(ranked(twice, "h1", "h2"), "lines")
    # equal rows (same id and text) share a key and stand in the sequence once
    known = scratch.save(each.join(names, ["h1", "h2"]).groupBy(*KEY, "no").agg(F.first("rank").alias("r"), F.first("words").alias("words")), "known")
    placed = known.join(begins, KEY).select((F.col("begin") + F.col("no")).alias("g"), "begin", "r", "words")

    in_doc = Window.partitionBy("begin").orderBy("g")
    stretch = Window.partitionBy("begin", "stretch").orderBy("g")
    whole = Window.partitionBy("begin", "stretch")
    units = placed.withColumn("stretch", F.col("g") - F.row_number().over(in_doc))
    units = units.select("g", "begin", "stretch", "r", F.col("words").cast("bigint").alias("words"), (F.max("g").over(whole) - F.col("g") + 1).alias("left"), F.sum("words").over(stretch.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("words").over(whole).alias("total"))
    units = scratch.save(units.filter(F.col("total") >= min_words).drop("total"), "units")
    fore, back = shortest_units(units, min_words)
    wanted = scratch.save(fore.unionByName(back).distinct(), "wanted")
    longest = wanted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    levels = prefix_ranks(units.select("g", "r", "left"), longest, scratch)

    found = lcp_intervals(wanted, levels, scratch)
    first = scratch.save(found.groupBy("n", "r", "r2").agg(F.min("g").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times"), "first")
    # as a written table both sides of the next join are shuffled for it, and a run with very many copies is split
    # where a copy overlaps the first occurrence, that one stays whole
    copies = found.join(first, ["n", "r", "r2"]).filter("g > first").select("begin", F.expr("greatest(g, first + n) - begin").alias("from"), F.expr("g + n - begin").alias("end"))
    in_order = Window.partitionBy("begin").orderBy("from", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    starts = copies.distinct().withColumn("starts", F.when(F.col("from") <= reached, 0).otherwise(1))
    islands = starts.withColumn("island", F.sum("starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("begin", "island").agg(F.min("from").alias("first"), F.max("end").alias("end"))
    runs = runs.groupBy("begin").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs"))
    out = scratch.save(runs.join(begins, "begin").select(*KEY, "runs"), "runs")
    scratch.drop(names, known, units, wanted, found, first, *levels[1:])
    return out


def _dedup(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """All columns of ``docs`` under the names __c0, __c1, ..., with lines, runs and kept lines.

    The join shuffles the texts whatever the number of runs, so the plan is the same at every size.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    place = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in place.items()))
    runs = repeated_runs(docs, scratch, place[id_col], place[text_col], **options)
    lines = F.split(F.col(place[text_col]), "\n", -1)
    kept = F.filter("lines", lambda _, i: ~F.exists("runs", lambda r: (i >= r["first"]) & (i < r["end"])))
    joined = docs.select("*", *document_key(place[id_col], place[text_col])).join(runs.hint("merge"), KEY, "left").withColumn("lines", lines)
    return joined.withColumn("kept", F.when(F.col("runs").isNull(), F.col("lines")).otherwise(kept))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_deleted, deleted (lines [first, end) from 0), text.

    Lines end at line feeds. Of each run of lines with 50 words or more (MIN_WORDS) that occurs
    more than once, in one document or several, the first copy stays and later ones are deleted;
    documents come in the order of their ids. A first copy may lie inside another run's later one
    and is then found in that run's first copy.

    A null text stays null with no lines; an empty one has one line. Rows with a null id come
    last, ordered by text keys; rows equal in id and text count as one document and get the same
    result. Other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    done = _dedup(docs, id_col, text_col, **options)
    return done.select(
        F.col(f"__c{docs.columns.index(id_col)}").cast("bigint").alias("doc_id"),
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines") - F.size("kept")), F.lit(0)).cast("bigint").alias("n_deleted"),
        F.array_join(F.transform(F.coalesce("runs", F.array().cast("array<struct<first:bigint,end:bigint>>")), lambda r: F.concat_ws("-", r["first"], r["end"])), ",").alias("deleted"),
        F.array_join("kept", "\n").alias("text"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with later copies of repeated runs cut from the text; rows of which no line is left go.

    Rows are judged as in ``dedup_lines``: null texts and empty ones stay as they are, rows with a null
    id come last, and rows equal in id and text are one document, which keeps its own first copies in
    all of them. An empty table stays empty. All columns stay, whatever their names; ``size_col``, where there is one, is the new text's length in changed rows.
    """
    done = _dedup(docs, id_col, text_col, **options).filter("runs IS NULL OR size(kept) > 0").withColumn("__new", F.array_join("kept", "\n"))
    out = []
    for i, (c, kind) in enumerate(docs.dtypes):
        value = F.col(f"__c{i}")
        if c == text_col:
            value = F.col("__new")
        elif c == size_col:
            value = F.when(F.col("runs").isNull(), value).otherwise(F.char_length("__new").cast(kind))
        out.append(value.alias(c))
    return done.select(*out)
