"""SimHash near-duplicates: fingerprints, pivot distance tables, and components of close fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import KEY, Scratch, document_key, text_blocks
from siltstone.llm.components import components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Reference fingerprints of the pivot tables.
PIVOTS = 16
#: Rows that share a candidate key by chance, at most about.
CHANCE_ROWS = 4
#: Groups of one key with more pairs to compare than this are split by further bits first.
SPLIT_PAIRS = 1 << 16

_SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of a text's word shingles as a signed 64-bit integer; 0 without a word."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    flat = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(x + 1 for x in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        stop = min(n, at + _SHINGLES_AT_ONCE)
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at:stop], ends[at + width - 1 : stop + width - 1], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *KEY, fp) of every whole text: a map without a shuffle. Null text has no words: fingerprint 0."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *document_key(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*(rows.schema[c] for c in ("doc_id", *KEY)), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("doc_id", *KEY)} | {"fp": pa.array([fingerprint(t) for t in texts], pa.int64())})

    return rows.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column) -> list[Column]:
    """Hamming distances to PIVOTS reference fingerprints, one byte each, eight in a bigint."""
    reference = [_signed(xxhash.xxh64_intdigest(f"pivot {i}")) for i in range(PIVOTS)]
    distance = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint") for p in reference]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(d, 8 * i) for i, d in enumerate(distance[at : at + 8])]) for at in range(0, PIVOTS, 8)]


def close(fp: Column, pivots: list[Column], other: Column, other_pivots: list[Column], bits: int) -> Column:
    """Whether two fingerprints differ in at most ``bits`` bits.

    Distances to a pivot differ by no more than the fingerprints do, so a pair whose largest
    coordinate difference is over ``bits`` goes unseen; the others are verified.
    """
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    near = [F.abs(byte(a, i) - byte(b, i)) <= bits for a, b in zip(pivots, other_pivots, strict=True) for i in range(8)]
    return reduce(lambda a, b: a & b, near) & (F.bit_count(fp.bitwiseXOR(other)) <= bits)


def block_masks(n: int, bits: int = MAX_BITS, chance: int = CHANCE_ROWS) -> list[int]:
    """Masks of the candidate keys: all ways to keep whole blocks of the 64 bits.

    Cut into b blocks, fingerprints that differ in at most ``bits`` bits agree in b - bits blocks
    at least, so each close pair shares a key whatever b is. b is chosen so that, of n random
    fingerprints, about ``chance`` or fewer share a key.
    """
    for blocks in range(bits + 2, bits + 6):
        cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(x) for x in combinations(parts, blocks - bits)]
        if n <= chance << min(m.bit_count() for m in masks):
            break
    return masks


def _cut(bits: list[int], blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of the given bit places."""
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _split_large(rows: DataFrame, masks: list[int], bits: int) -> DataFrame:
    """rows (k, part, fp, large, ...) with (piece, same): in large groups once for each of bits + 1 blocks of the bits
    that the key leaves open, else once. Rows within ``bits`` bits of each other agree in one of these blocks."""
    blocks = F.lit([[_signed(m) for m in _cut([b for b in range(64) if not mask >> b & 1], bits + 1)] for mask in masks])
    own = F.element_at(blocks, F.col("k") + 1)
    pieces = F.transform(own, lambda m, i: F.struct(i.alias("piece"), F.col("fp").bitwiseAND(m).alias("same")))
    whole = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("bigint").alias("same")))
    return rows.select(*[c for c in rows.columns if c != "large"], F.inline(F.when(F.col("large"), pieces).otherwise(whole)))


def _with_keys(nodes: DataFrame, masks: list[int], *columns: str) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).cast("smallint").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)])
    return nodes.select("fp", *columns, F.explode(keys).alias("key")).select("key.k", "key.part", "fp", *columns)


def link_fingerprints(nodes: DataFrame, scratch: Scratch, bits: int = MAX_BITS) -> DataFrame:
    """(fp, component) for every distinct fingerprint in ``nodes`` (fp, n) that has a close other one.

    Exact without all pairs of a group. First each row is held against three members of each of
    its keys' groups (smallest, largest, commonest), which already joins the large groups of near
    copies. Then only rows of different components that share a key are compared, those outside
    the key's largest component with all rows of the key; where these are many pairs, only those that
    agree in a further block of bits. What is left unlinked is further apart.
    """
    masks = block_masks(nodes.count(), bits)
    keyed = _with_keys(nodes, masks, "n")
    groups = keyed.groupBy("k", "part").agg(F.count("*").alias("rows"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.max_by("fp", "n").alias("most")).filter("rows > 1")
    centres = scratch.save(groups.select("k", "part", F.explode(F.array_distinct(F.array("low", "high", "most"))).alias("centre")), "centres")
    pa_, pb_ = pivot_table(F.col("fp")), pivot_table(F.col("centre"))
    left = _with_keys(nodes.withColumns({f"p{i}": c for i, c in enumerate(pa_)}), masks, "p0", "p1")
    right = centres.withColumns({f"q{i}": c for i, c in enumerate(pb_)})
    cols = lambda x: [F.col(f"{x}0"), F.col(f"{x}1")]
    stars = left.join(right, ["k", "part"]).filter((F.col("fp") != F.col("centre")) & close(F.col("fp"), cols("p"), F.col("centre"), cols("q"), bits))
    first = scratch.save(components(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b")), scratch), "stars")

    marked = nodes.join(first, nodes.fp == first.node, "left").select("fp", F.coalesce("component", "fp").alias("c")).withColumns({f"p{i}": c for i, c in enumerate(pa_)})
    marked = scratch.save(marked, "marked")
    rows = _with_keys(marked, masks, "c", "p0", "p1")
    sizes = rows.groupBy("k", "part", "c").agg(F.count("*").alias("rows"))
    of_key = sizes.groupBy("k", "part").agg(F.max_by("c", "rows").alias("main"), F.count("*").alias("kinds"), F.sum("rows").alias("all"), F.max("rows").alias("most")).filter("kinds > 1")
    mixed = scratch.save(of_key.select("k", "part", "main", ((F.col("all") - F.col("most")) * F.col("all") > SPLIT_PAIRS).alias("large")), "mixed")
    of_mixed = scratch.save(_split_large(rows.join(mixed, ["k", "part"]), masks, bits), "rows")
    a = of_mixed.filter("c <> main").drop("main")
    b = of_mixed.select("k", "part", "piece", "same", F.col("fp").alias("fp2"), F.col("c").alias("c2"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    more = a.join(b, ["k", "part", "piece", "same"]).filter((F.col("c") != F.col("c2")) & close(F.col("fp"), cols("p"), F.col("fp2"), cols("q"), bits))
    second = scratch.save(components(more.select(F.col("c").alias("a"), F.col("c2").alias("b")), scratch), "joined")
    out = scratch.save(marked.join(second, marked.c == second.node, "left").select("fp", F.coalesce("component", "c").alias("component")), "linked")
    scratch.drop(centres, first, marked, mixed, of_mixed, second)
    return out


def linked_rows(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """(doc_id, *KEY, fp, component_id, first) of every row: first is the key of the row that stands for its component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.min(F.struct(*KEY)).alias("first")), "nodes")
    linked = link_fingerprints(nodes.select("fp", "n"), scratch, bits)
    named = scratch.save(nodes.join(linked, "fp").select("fp", "low", "first", "component"), "named")
    # as a written table both sides of the next joins are shuffled for them, and a very large component is split
    ids = scratch.save(named.groupBy("component").agg(F.min("low").alias("component_id"), F.min("first").alias("first")), "ids")
    by_print = scratch.save(named.select("fp", "component").join(ids, "component").select("fp", "component_id", "first"), "by-print")
    scratch.drop(nodes, linked, named, ids)
    return prints.join(by_print, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked where their fingerprints differ in at most ``bits`` bits; component_id is
    the smallest doc_id that links lead to, the document's own included. Rows with equal
    fingerprints are one node from the start, so copies never meet as pairs.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id
    take part and get their component's smallest id, null if it has none. Repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    found = linked_rows(docs, id_col, text_col, bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id. All columns stay.

    A document is what rows with one id and one text are: where an id comes with several texts,
    each is judged on its own, and of several in one component that with the smallest text key
    stays. Rows without an id come last. All rows of a document that stays do; null and empty texts
    are one component, of which one document stays; an empty table stays empty.

    The join shuffles the texts however few rows go, so the plan is the same at every size.
    """
    place = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in place.items()))
    found = linked_rows(rows, place[id_col], place[text_col], bits)
    extra = found.filter(F.struct(*KEY) != F.col("first")).select(*KEY).distinct()
    kept = rows.select("*", *document_key(place[id_col], place[text_col])).join(extra.hint("merge"), KEY, "left_anti")
    return kept.select(*(F.col(n).alias(c) for c, n in place.items()))
