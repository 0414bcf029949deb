"""Benchmark decontamination by a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch

WINDOW = 13
#: Rarest terms of a window that its postings are kept for.
RAREST = 3
#: Words by which two of these may be out of place in a proximity match.
SLACK = 3
#: A document is contaminated from one hit word in so many on.
SHARE = 20
#: A table of benchmark terms with more rows or bytes of text than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def split_words(text: Column) -> Column:
    """Words with an empty string before and behind them where the text starts or ends with a gap."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP)


def leading(raw: Column) -> Column:
    """1 if the split has an empty string in front of the first word, else 0."""
    return (raw[0] == "").cast("int")


def word_count(raw: Column) -> Column:
    return F.size(raw) - leading(raw) - F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), 1).otherwise(0)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows and bytes allow it. A written table, so that a join by shuffle can split hot keys."""
    text = sum([F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"], F.lit(0))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def benchmark_windows(benchmark: DataFrame, scratch: Scratch, width: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, phrase, len) and the items that hold them (wid, item_id)."""
    words = F.filter(split_words(F.col(f"`{text_col}`")), lambda w: w != "")
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), words.alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    windows = items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), width).alias("w"))
    held = scratch.save(windows.select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("len")).distinct(), "held")
    distinct = scratch.save(held.select("phrase", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return distinct, scratch.save(held.filter("item_id IS NOT NULL").join(distinct, ["phrase", "len"]).select("wid", "item_id"), "items")


def rarest_terms(docs_raw: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, wid, off, bit, need): each window's RAREST terms in the documents, by counts over all of them.

    Terms that no document holds are passed over; a window with one cannot occur (need 0). Else
    need has the bits of all terms chosen. Counts are summed before they meet the vocabulary.
    """
    terms = scratch.save(windows.select("wid", F.posexplode(F.split("phrase", " ")).alias("off", "term")), "terms")
    vocabulary = scratch.save(terms.select("term").distinct(), "vocabulary")
    known = _small(vocabulary)
    words = docs_raw.select(F.explode("raw").alias("term"))
    if known is not vocabulary:  # broadcast: words of no window go before they are counted
        words = words.join(known, "term")
    counts = scratch.save(words.groupBy("term").agg(F.count("*").alias("n")).join(known, "term", "left_semi"), "counts")
    ranked = terms.join(counts, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy(F.col("n").asc_nulls_last(), "off")))
    ranked = ranked.withColumn("bit", F.when(F.col("rank") <= RAREST, F.expr("shiftleft(1, rank - 1)")).otherwise(0))
    of_window = Window.partitionBy("wid")
    lost = F.count("n").over(of_window) < F.count("*").over(of_window)
    ranked = ranked.withColumn("need", F.when(lost, 0).otherwise(F.sum("bit").over(of_window)).cast("int"))
    out = scratch.save(ranked.filter("bit > 0 AND n IS NOT NULL").select("term", "wid", "off", "bit", "need"), "rarest")
    scratch.drop(terms, vocabulary, counts)
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", width: int = WINDOW, slack: int = SLACK, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Phrase and proximity matches of benchmark windows in documents.

    Returns two tables. The first has a row per row of ``docs``: rid and text_key (its key, made of
    id and text), n_words, hits (start, len, wid of each occurrence of a window), near (windows
    without an exact occurrence of which two of the rarest terms stand within ``slack`` words of
    their places) and the input columns in ``keep``. The second names the items of a window.

    The index has postings of the terms that are among the rarest of some window; of each window
    these lists are shifted by the terms' offsets and intersected, and what is left is verified
    word by word on the text. Postings are keyed by document, so a term, passage or
    source with very many documents spreads over all tasks.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    key = [F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63))).alias("rid"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key")]
    raw = docs.select(*key, split_words(F.col(f"`{text_col}`")).alias("raw"))
    windows, items = benchmark_windows(benchmark, scratch, width, item_col, bench_text_col)
    rarest = rarest_terms(raw, windows, scratch)
    terms = _small(scratch.save(rarest.select("term").distinct(), "rare"))
    postings = raw.select("rid", "text_key", leading(F.col("raw")).alias("lead"), F.posexplode("raw").alias("pos", "term")).join(terms, "term")
    postings = scratch.save(postings.select("rid", "text_key", "term", (F.col("pos") - F.col("lead")).alias("pos")), "postings")
    shifted = postings.join(_small(rarest), "term").select("rid", "text_key", "wid", "need", (F.col("pos") - F.col("off")).alias("start"), "bit")
    starts = shifted.filter(F.col("start") >= -slack).groupBy("rid", "text_key", "wid", "need", "start").agg(F.bit_or("bit").alias("bits"))
    of_window = Window.partitionBy("rid", "text_key", "wid").orderBy("start")
    apart = (F.col("start") - F.lag("start").over(of_window) <= slack) & (F.col("bits") != F.lag("bits").over(of_window))
    several = F.bit_count("bits") > 1
    told = starts.withColumn("near", several | F.coalesce(apart, F.lit(False))).withColumn("whole", (F.col("bits") == F.col("need")) & (F.col("start") >= 0)).filter("near OR whole")
    told = told.join(_small(windows), "wid").select("rid", "text_key", "wid", "near", "whole", F.struct("start", "len", "wid", "phrase").alias("at"))
    found = told.groupBy("rid", "text_key").agg(F.collect_set(F.when(F.col("whole"), F.col("at"))).alias("places"), F.collect_set(F.when(F.col("near"), F.col("wid"))).alias("close"))
    found = scratch.save(found, "found")
    base = docs.select(*key, F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`") for c in keep or []))
    # the texts are shuffled however few matches there are, so the plan is the same at every size
    joined = base.join(found.hint("merge"), ["rid", "text_key"], "left").withColumn("raw", split_words(F.col("__text")))
    right = F.filter("places", lambda p: F.array_join(F.slice("raw", p["start"] + leading(F.col("raw")) + 1, p["len"]), " ") == p["phrase"])
    hits = F.transform(right, lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len"), p["wid"].alias("wid")))
    out = joined.select("rid", "text_key", word_count(F.col("raw")).cast("bigint").alias("n_words"), F.coalesce(hits, F.array().cast("array<struct<start:int,len:int,wid:bigint>>")).alias("hits"), F.coalesce("close", F.array().cast("array<bigint>")).alias("close"), *(F.col(f"`{c}`") for c in keep or []))
    return out.withColumn("near", F.array_except("close", F.transform("hits", lambda h: h["wid"]))).drop("close"), items


def hit_words() -> Column:
    """Number of words inside any hit."""
    inside = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    return F.size(F.array_distinct(inside)).cast("bigint")


def _contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and non-ASCII characters. An item
    of 13 words or more has all its windows of 13 consecutive words, a shorter one is one window,
    one without words has none. n_hit counts words inside any occurrence of a window, n_items the
    items with occurring windows (items without an id count for hits, not here), n_near the
    windows with a proximity match only (see ``find_matches``).

    Null texts have no words on either side. Null ids stay null; equal rows get equal results;
    empty tables give no matches; other columns are ignored, whatever their names.
    """
    matches, items = find_matches(docs, benchmark, id_col, text_col, **options)
    scratch = Scratch(docs.sparkSession, "contamination")
    found = scratch.save(matches.select("rid", "text_key", "n_words", hit_words().alias("n_hit"), F.size("near").cast("bigint").alias("n_near"), F.array_distinct(F.transform("hits", lambda h: h["wid"])).alias("wids")), "matches")
    named = found.select("rid", "text_key", F.explode("wids").alias("wid")).join(_small(items), "wid").groupBy("rid", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = found.join(named, ["rid", "text_key"], "left").withColumn("items", F.coalesce("items", F.array().cast(T.ArrayType(T.StringType()))))
    return out.select(
        F.when(F.col("rid") != -(1 << 63), F.col("rid")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated(share).alias("contaminated"), "n_near",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, width: int = WINDOW, **options) -> DataFrame:
    """``docs`` without the rows that leak benchmark text; all columns stay.

    A row goes if a whole window of ``width`` words of an item occurs in it, however long the row
    is. Items of fewer words may be common phrases: what they hit counts by the share of
    ``contamination_report`` only. Null and empty texts leak nothing and stay, as do all rows
    where the benchmark has no words; null ids and repeated rows are judged by their texts.
    """
    aliased = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)))
    place = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    matches, _ = find_matches(aliased, benchmark, place[options.pop("id_col", "doc_id")], place[options.pop("text_col", "text")], width=width, keep=aliased.columns, **options)
    whole = F.exists("hits", lambda h: h["len"] >= width)
    clean = matches.withColumn("n_hit", hit_words()).filter(~whole & ~_contaminated(share))
    return clean.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
