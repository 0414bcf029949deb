"""Content-addressed token store: chunked id streams, unique chunks, document recipes, Merkle manifests."""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, row_blocks

END_ID = 1
#: A chunk has at least so many ids, about MIN + 2**MASK_BITS on average, and never more than MAX_CHUNK.
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 128, 9, 4096
#: Ids that the rolling hash looks back on.
ROLL = 16
DIGEST_BYTES = 16
#: Bytes of text that are encoded at a time.
BLOCK = 4 << 20


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last ROLL ids has MASK_BITS zeros.

    Where a passage recurs the places inside it recur, whatever stands before it.
    """
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.cumsum(mixed)
    roll = total.copy()
    roll[ROLL:] -= total[:-ROLL]
    roll *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero(roll >> np.uint64(64 - MASK_BITS) == 0) + 1


def chunk_ends(ids: np.ndarray, stream_ends: list[int] | None = None) -> list[list[int]]:
    """Ends of the content-defined chunks of each stream, counted from the stream's start.

    ids: streams one behind another, up to ``stream_ends`` each. A chunk has MIN_CHUNK ids at least
    (unless the stream ends), so its first ROLL ids, whose hash would see the stream before, cut nothing.
    """
    stream_ends = [len(ids)] if stream_ends is None else stream_ends
    places = cut_places(ids)
    firsts = [0, *stream_ends[:-1]]
    low = np.searchsorted(places, firsts, "right").tolist()
    high = np.searchsorted(places, stream_ends, "left").tolist()
    out = []
    for first, end, a, b in zip(firsts, stream_ends, low, high, strict=True):
        n, start, ends = end - first, 0, []
        for cut in [*(places[a:b] - first).tolist(), n] if n > MIN_CHUNK else [n]:
            while cut - start > MAX_CHUNK:
                start += MAX_CHUNK
                ends.append(start)
            if cut - start >= MIN_CHUNK or cut == n and cut > start:
                ends.append(cut)
                start = cut
        out.append(ends)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is. Leaves and inner nodes hash differently."""
    level = [blake2b(b"\0" + x, digest_size=DIGEST_BYTES).digest() for x in leaves]
    while len(level) > 1:
        pairs = [blake2b(b"\1" + a + b, digest_size=DIGEST_BYTES).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0] if level else b"\0" * DIGEST_BYTES


def chunk_digest(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=DIGEST_BYTES).digest()


#: Words that the library encodes as one string.
JOINED = 256
#: Punctuation that is a pre-token of its own behind letters. Apostrophes start contractions.
_TAIL = "".join(c for c in string.punctuation if c != "'")


def _strings(words: pa.Array) -> list[str]:
    """Words without a space in them: one string tells them apart again, and costs less than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().split(" ")


def _ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first`` and have ``size`` items, one after another."""
    end = np.cumsum(size, dtype=np.int64)
    at = np.repeat(first - (end - size), size)
    at += np.arange(len(at))
    return flat[at]


class WordEncoder:
    """The tokenizers library with a memory of words.

    Spaces and line breaks separate pre-tokens in the library too and no id spans them, so a
    text's ids are its words' ids one after another. A block of texts is cut into words and these
    are numbered by Arrow, so each distinct word of a block is looked up once. Punctuation behind
    letters is a pre-token of its own, and the library lower-cases, so words that differ in these
    alone share a stem. Special tokens in a text have their own ids, as in the library's plain
    call; it looks for them before it lower-cases, so words with "<|" stay as they are. Words of
    letters are encoded many in one string and told apart by the vocabulary's word ends; if their
    number is not that of the words, each is encoded alone.

    Stems seen before stand in an Arrow array (``known``), their ids in one array behind each other.
    Beyond ``limit`` stems those go that no text used since the last time.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.limit = limit
        self.known, self.flat = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.first, self.size, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by the library."""
        out: list[np.ndarray | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        joined = [" ".join([words[i] for i in g]) for g in groups]
        for group, ids in zip(groups, self._alone(joined) if joined else (), strict=True):
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(group):
                for i, own in zip(group, np.split(ids, ends[:-1]), strict=True):
                    out[i] = own
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._alone([words[i] for i in rest]) if rest else (), strict=True):
            out[i] = ids
        return out

    def _places(self, stems: pa.Array) -> np.ndarray:
        """Where distinct stems stand in ``known``; new ones are encoded and added."""
        if len(self.known) + len(stems) > self.limit:
            keep = np.flatnonzero(self.used)
            self.flat = _ragged(self.flat, self.first[keep], self.size[keep])
            self.known, self.size, self.used = self.known.take(pa.array(keep)), self.size[keep], np.zeros(len(keep), bool)
            self.first = np.cumsum(self.size) - self.size
        place = pc.index_in(stems, value_set=self.known)
        if place.null_count:
            new = pc.filter(stems, pc.is_null(place))
            ids = self._encode(_strings(new))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            before = len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, *ids])
            self.used = np.concatenate([self.used, np.ones(len(ids), bool)])
            out = pc.fill_null(place, -1).to_numpy().astype(np.int64)
            out[out < 0] = np.arange(before, before + len(ids))
        else:
            out = place.to_numpy().astype(np.int64)
        self.used[out] = True
        return out

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and the end of each text's ids. Null counts as empty."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        if not len(split):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        trimmed = pc.utf8_rtrim(words, _TAIL)
        stem = pc.if_else(pc.utf8_is_alpha(trimmed), trimmed, words)
        plain = pc.and_(pc.string_is_ascii(stem), pc.invert(pc.match_substring(stem, "<|")))
        cut = np.flatnonzero(pc.binary_length(stem).to_numpy() < pc.binary_length(words).to_numpy())
        tails = [w[n:] for w, n in zip(_strings(words.take(pa.array(cut))), pc.utf8_length(stem.take(pa.array(cut))).to_pylist(), strict=True)] if len(cut) else []
        parts = pa.concat_arrays([pc.if_else(plain, pc.ascii_lower(stem), stem), pa.array(["", *tails], pa.string())]).dictionary_encode()
        found = self._places(parts.dictionary)[parts.indices.to_numpy()]
        place = np.empty((len(words), 2), np.int64)  # each word's stem and tail
        place[:, 0], place[:, 1] = found[: len(words)], found[len(words)]
        place[cut, 1] = found[len(words) + 1 :]
        place = place.ravel()
        ids = _ragged(self.flat, self.first[place], self.size[place])
        size = self.size[place].reshape(-1, 2).sum(1)
        word = coded.indices.to_numpy()
        long = size[word]
        last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return _ragged(ids, (np.cumsum(size) - size)[word], long), np.cumsum(long)[last - 1]

    def ids(self, text: str) -> np.ndarray:
        return self.block(pa.array([text], pa.string()))[0]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """A worker's encoder, kept from task to task."""
    return WordEncoder(path)


STAGED = "doc_id bigint, uid bigint, n_tokens bigint, sizes array<int>, digests array<binary>, root binary, ids binary"


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """STAGED: each document's ids with END_ID behind them, cut into chunks. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = encoder(tokenizer_path), TaskContext.get()
        uid = task.partitionId() << 33 if task else 0
        types = {"sizes": pa.list_(pa.int32()), "digests": pa.list_(pa.binary()), "root": pa.binary(), "ids": pa.binary(), "n_tokens": pa.int64()}
        for part in row_blocks(batches, "text", BLOCK):
            ids, ends = words.block(part.column("text"))
            ids, ends = np.insert(ids, ends, END_ID), (ends + np.arange(1, len(ends) + 1)).tolist()
            packed, w = ids.astype(f"<u{words.width}").tobytes(), words.width
            out = {c: [] for c in ("n_tokens", "sizes", "digests", "root", "ids")}
            for first, end, cuts in zip([0, *ends[:-1]], ends, chunk_ends(ids, ends), strict=True):
                raw = packed[first * w : end * w]
                starts = [0, *cuts[:-1]]
                digests = [chunk_digest(raw[a * w : b * w]) for a, b in zip(starts, cuts, strict=True)]
                for c, v in zip(out, (end - first, [b - a for a, b in zip(starts, cuts, strict=True)], digests, merkle_root(digests), raw), strict=True):
                    out[c].append(v)
            n = part.num_rows
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "uid": pa.array(range(uid, uid + n), pa.int64())} | {c: pa.array(v, types[c]) for c, v in out.items()})
            uid += n

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, STAGED)


def running_starts(staged: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, start): ids of all documents before, in the order of doc_id (nulls first) and uid.

    One range shuffle of small rows; only each part's total reaches the driver.
    """
    order = ["doc_id", "uid"]
    dealt = scratch.save(staged.select(*order, "n_tokens").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    totals = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.sum("n_tokens")).collect())
    before = [(part, end - n) for (part, n), end in zip(totals, accumulate(n for _, n in totals), strict=True)]
    offsets = staged.sparkSession.createDataFrame(before, "part int, offset bigint")
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(offsets), "part").select("uid", (F.col("offset") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).alias("start"))


STORED = "doc_id bigint, start bigint, n_tokens bigint, sizes array<int>, digests array<binary>, root binary, alone boolean, shared array<binary>, own binary, pool array<struct<digest:binary,chunk:binary>>, segment bigint"


def _split(row: dict, shared: set[bytes], owned: set[bytes]) -> tuple[bytes, list[dict]]:
    """A document's chunks that no other place holds, and those shared ones that are kept with it."""
    own, pool, at, width = [], [], 0, len(row["ids"]) // row["n_tokens"]
    for size, digest in zip(row["sizes"], row["digests"], strict=True):
        chunk = row["ids"][at * width : (at + size) * width]
        at += size
        if digest not in shared:
            own.append(chunk)
        elif digest in owned:
            owned.discard(digest)
            pool.append({"digest": digest, "chunk": chunk})
    return b"".join(own), pool


def write_store(staged: DataFrame, path: str, scratch: Scratch) -> None:
    """Write the store's documents in ascending order of doc_id.

    A row is a document's recipe (chunk sizes and digests, Merkle root) with the chunks that no
    other place holds inline (``own``). A chunk that recurs anywhere is kept once, in the ``pool``
    of one of its documents; the others name it by digest.
    """
    refs = staged.select("uid", F.explode("digests").alias("digest"))
    recurring = scratch.save(refs.groupBy("digest").agg(F.min("uid").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n"), "recurring")
    of_doc = refs.join(recurring, "digest").groupBy("uid").agg(F.collect_set("digest").alias("shared"), F.collect_set(F.when(F.col("owner") == F.col("uid"), F.col("digest"))).alias("owned"))
    small = staged.select("doc_id", "uid").join(running_starts(staged, scratch), "uid").join(of_doc, "uid", "left")
    # one shuffle of the ids: what is known of a document travels as a row of its own in front of them
    facts = small.select("doc_id", "uid", F.lit(0).alias("kind"), "start", "shared", "owned")
    rows = facts.unionByName(staged.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stored = _arrow(STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held = TaskContext.get().partitionId(), []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            kind = table.column("kind")
            docs, facts = table.filter(pc.equal(kind, 1)).combine_chunks(), table.filter(pc.equal(kind, 0)).combine_chunks()
            n = docs.num_rows
            held = facts.slice(n).to_batches()  # its document comes in the next batch
            facts = facts.slice(0, n)
            if not facts.column("uid").equals(docs.column("uid")):
                raise ValueError("a document without its place in the order")
            own, shared, pools = docs.column("ids").to_pylist(), [[]] * n, [[]] * n
            for i in np.flatnonzero(pc.fill_null(pc.list_value_length(facts.column("shared")), 0).to_numpy()).tolist():
                row, fact = docs.slice(i, 1).to_pylist()[0], facts.slice(i, 1).to_pylist()[0]
                own[i], pools[i] = _split(row, set(fact["shared"]), set(fact["owned"] or ()))
                shared[i] = sorted(fact["shared"])
            if n:
                columns = {c: docs.column(c) for c in ("doc_id", "n_tokens", "sizes", "digests", "root")} | {"start": facts.column("start"), "alone": [not x for x in shared], "shared": shared, "own": own, "pool": pools, "segment": [segment] * n}
                columns = [columns[f.name] if isinstance(columns[f.name], pa.ChunkedArray) else pa.array(columns[f.name], f.type) for f in stored]
                yield from pa.table(columns, schema=stored).to_batches()
        if held:
            raise ValueError("a place in the order without its document")

    ordered = rows.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid", "kind")
    ordered.mapInArrow(run, STORED).write.option("compression", "zstd").parquet(path)
    scratch.drop(recurring)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def write_manifest(store: DataFrame, path: str) -> None:
    """(segment, documents, first_start, root): a root over the documents' Merkle roots in their order, per segment."""
    roots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("root").alias("root")))), lambda x: x["root"]), "")
    store.groupBy("segment").agg(F.count("*").alias("documents"), F.min("start").alias("first_start"), F.sha2(roots, 256).alias("root")).write.parquet(path)


REBUILT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, segment bigint, root binary"


def _join(sizes: list[int], digests: list[bytes], own: bytes, pieces: dict[bytes, bytes]) -> list[bytes]:
    """A document's chunks, from its own ones and the shared ones by digest."""
    own_tokens = sum(n for n, d in zip(sizes, digests, strict=True) if d not in pieces)
    width, chunks, at = len(own) // own_tokens if own_tokens else 0, [], 0
    for size, digest in zip(sizes, digests, strict=True):
        if digest in pieces:
            chunks.append(pieces[digest])
        else:
            chunks.append(own[at : at + size * width])
            at += size * width
    return chunks


def _rebuild(rows: DataFrame, with_ids: bool) -> DataFrame:
    ddl = REBUILT + (", ids binary" if with_ids else "")
    rebuilt = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: (batch.column(c).flatten().to_pylist(), np.cumsum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False)).tolist()) for c in ("sizes", "digests")}
            (sizes, ends), (digests, _) = lists["sizes"], lists["digests"]
            shared = pc.list_value_length(batch.column("shared")).to_numpy(zero_copy_only=False).tolist()
            out: dict[str, list] = {c: [] for c in ("n_tokens", "ids_crc32", "root", "ids")}
            for i, (a, b, n, own) in enumerate(zip([0, *ends[:-1]], ends, batch.column("n_tokens").to_pylist(), batch.column("own").to_pylist(), strict=True)):
                if shared[i]:
                    pieces = {x["digest"]: x["chunk"] for x in batch.column("pieces")[i].as_py()}
                    chunks = _join(sizes[a:b], digests[a:b], own, pieces)
                else:
                    width, cuts = len(own) // n, [0, *accumulate(sizes[a:b])]
                    chunks = [own[x * width : y * width] for x, y in pairwise(cuts)]
                found = list(map(chunk_digest, chunks))
                if found != digests[a:b]:
                    raise ValueError(f"a chunk of document {batch.column('doc_id')[i].as_py()} does not match its digest")
                raw = b"".join(chunks) if shared[i] else own
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                for c, v in zip(out, (len(ids) // 4, zlib.crc32(ids), merkle_root(found), ids if with_ids else None), strict=True):
                    out[c].append(v)
            columns = {c: batch.column(c) for c in ("doc_id", "start", "segment")} | out
            yield pa.record_batch([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in rebuilt], schema=rebuilt)

    return rows.mapInArrow(run, ddl)


def read_store(store: DataFrame, with_ids: bool = False) -> DataFrame:
    """REBUILT for every document of a store, each chunk held against its digest.

    Documents with no shared chunk are read as they stand; only shared chunks are shuffled, by
    digest, to the documents that name them.
    """
    keep = ["doc_id", "start", "n_tokens", "sizes", "digests", "shared", "own", "segment"]
    alone = _rebuild(store.filter("alone").select(*keep), with_ids)
    pool = store.filter("NOT alone").select(F.explode("pool").alias("x")).select("x.digest", "x.chunk")
    wanted = store.filter("NOT alone").select("start", F.explode("shared").alias("digest"))
    pieces = wanted.join(pool, "digest").groupBy("start").agg(F.collect_list(F.struct("digest", "chunk")).alias("pieces"))
    return alone.unionByName(_rebuild(store.filter("NOT alone").select(*keep).join(pieces, "start"), with_ids))


def verify_manifest(rebuilt: DataFrame, manifest: DataFrame) -> DataFrame:
    """Segments whose rebuilt documents do not give the manifest's root: none, if all is well."""
    roots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("root").alias("root")))), lambda x: x["root"]), "")
    seen = rebuilt.groupBy("segment").agg(F.count("*").alias("n"), F.sha2(roots, 256).alias("again"))
    return manifest.join(seen, "segment", "full").filter(~F.col("again").eqNullSafe(F.col("root")) | ~F.col("n").eqNullSafe(F.col("documents"))).select("segment")


def store_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode documents into a store under ``root`` (a shared folder; by default in spark.checkpoint.dir).

    Returns (documents, manifest) as read from the files; ``read_store`` rebuilds the ids.
    Null and empty texts have the end id only. Rows with a null id come first; repeated ids follow
    each other; other columns are ignored; an empty table gives an empty store.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tokens")
    root = root or scratch.root
    staged = scratch.save(encode_documents(docs, tokenizer_path, id_col, text_col), "staged")
    write_store(staged, f"{root}/documents", scratch)
    scratch.drop(staged)
    store = spark.read.schema(STORED).parquet(f"{root}/documents")
    write_manifest(store, f"{root}/manifest")
    return store, spark.read.parquet(f"{root}/manifest")


def token_report(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from a store that is written, read back and verified."""
    store, manifest = store_tokens(docs, tokenizer_path, **options)
    scratch = Scratch(docs.sparkSession, "token-report")
    rebuilt = scratch.save(read_store(store), "rebuilt")
    if bad := verify_manifest(rebuilt, manifest).take(3):
        raise ValueError(f"segments {bad} do not match the manifest")
    return rebuilt.select("doc_id", "start", "n_tokens", "ids_crc32")
