"""Byte-level BPE by a sentencepiece model that is serialised straight from the rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from public_tokenizers import PATTERN

from siltstone.llm.common import BLOCK_CHARS, text_blocks

#: Pre-tokens whose ids a worker remembers.
CACHE = 400_000

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable, else from U+0100 on in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("the ranks are not 0, 1, 2, ...")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the tokens as byte-mapped pieces scored by negative rank.

    Piece id = rank; the unknown piece that the format demands comes last. Floats hold ranks
    exactly up to 2**24. The normaliser is the identity and adds no prefix.
    """
    letters = byte_letters()
    pieces = b"".join(
        _field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    )
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """0 for white space, 1 letters, 2 numbers, 3 others, by code point."""
    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, kind in ((0, "White_Space"), (1, "L"), (2, "N")):
        for run in regex.finditer(rf"\p{{{kind}}}+", every):
            out[ord(run[0][0]) : ord(run[0][-1]) + 1] = value
    return out


#: The endings that stay with their apostrophe, in the pattern's order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def split_points(text: str) -> np.ndarray:
    """Starts of the pre-tokens that the public pattern finds, computed on whole arrays.

    A run of one class starts a pre-token and takes one space in front of it; of other white space
    in front of text the last character stands alone; an apostrophe that starts a pre-token takes
    an ending of CONTRACTIONS. The tests hold this against the pattern itself.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = char_classes()[codes]
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    starts = change.copy()
    space = kind == 0
    # the last of each run of white space before text starts a pre-token of its own or the next one
    last = np.flatnonzero(space[:-1] & ~space[1:])
    starts[last] = True
    starts[last[codes[last] == 32] + 1] = False
    quotes = np.flatnonzero(codes == 39)
    for i in quotes[starts[quotes]].tolist():
        for ending in CONTRACTIONS:
            if text.startswith(ending, i + 1):
                starts[i + 1] = False
                if i + 1 + len(ending) < len(text):
                    starts[i + 1 + len(ending)] = True
                    after = i + 2 + len(ending)
                    if kind[after - 1] == 0 and codes[after - 1] == 32 and after < len(text) and not space[after]:
                        starts[after] = False
                break
    return np.flatnonzero(starts)


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches flat[begin : begin + length] one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class ByteBpe:
    """Encoder and decoder of one worker; remembers the ids of up to ``CACHE`` short pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.find = None if pattern == PATTERN else regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.whole = {t.decode(): i for i, t in enumerate(tokens) if is_utf8(t)}
        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(model_bytes(tokens))
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(t) for t in tokens])
        self.token_begin = np.cumsum(self.token_length) - self.token_length
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.length = np.empty(1 << 20, np.uint32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used = 0

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if self.find:
            return self.find(text)
        if not text:
            return []
        out, start = [], 0
        for start, end in parts(text):
            part = text[start:end]
            cuts = split_points(part).tolist()
            out += map(part.__getitem__, map(slice, cuts, [*cuts[1:], len(part)]))
        return out

    def learn(self, words: list[str]) -> None:
        """Add pre-tokens: one that is a token by itself is that token, others are merged by sentencepiece."""
        whole = self.whole
        rest = [w for w in words if w not in whole]
        mapped = "\n".join(rest).encode().decode("latin-1").translate(self.letters | {10: "\n"}).split("\n") if rest and not any("\n" in w for w in rest) else [w.encode().decode("latin-1").translate(self.letters) for w in rest]
        merged = dict(zip(rest, self.pieces.encode(mapped, out_type=int, num_threads=1) if rest else (), strict=True))
        ids, sizes = [], []
        for w in words:
            own = merged.get(w)
            if own is None:
                ids.append(whole[w])
                sizes.append(1)
            else:
                ids += own
                sizes.append(len(own))
        n = len(self.index)
        self.flat = grown(self.flat, self.used + len(ids))
        self.begin, self.length = grown(self.begin, n + len(words)), grown(self.length, n + len(words))
        self.flat[self.used : self.used + len(ids)] = ids
        size = np.array(sizes)
        self.length[n : n + len(words)] = size
        self.begin[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text, unsigned 32-bit."""
        words = self.split(text)
        if len(self.index) > CACHE or self.used > 8 * CACHE:
            self.forget()
        index = self.index
        try:
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn([w for w in dict.fromkeys(words) if w not in index])
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        return gather(self.flat, self.begin[at], self.length[at])

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_begin[ids], self.token_length[ids]).tobytes()


def is_utf8(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, enlarged at least twofold where it is shorter than ``size``."""
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def parts(text: str, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Stretches of a long text that split alike alone: each ends between text and a line break, or the like."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE_CUT.search(text, start + limit)
        if not cut:
            break
        yield start, cut.start() + 1
        start = cut.start() + 1
    yield start, len(text)


#: Between a word character and one space or line break with a letter behind it, both sides split alike alone.
SAFE_CUT = regex.compile(r"\p{L}(?=[ \n]\p{L})")


@lru_cache(2)
def coder(vocabulary: str, pattern: str, tokens: tuple[bytes, ...]) -> ByteBpe:
    """A worker's coder, kept from task to task."""
    return ByteBpe(list(tokens), pattern)


def bpe_roundtrip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode every whole text and decode the ids again, one row per row of ``docs``.

    Returns doc_id, n_tokens, the SHA-256 of the ids (little-endian unsigned 32-bit) and of the
    decoded bytes; ``with_ids`` adds the ids themselves, ``keep`` further input columns. A map
    without a shuffle; each worker remembers the ids of at most ``CACHE`` short pre-tokens.

    Null text counts as empty: no tokens, digests of no bytes. Repeated rows give repeated
    results; null ids stay null; other columns are ignored, whatever their names.
    """
    tokens, keep = tuple(read_ranks(vocabulary)), [c for c in keep or [] if c not in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*SCHEMA, *([T.StructField("ids", T.BinaryType())] if with_ids else []), *(frame.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern, tokens)
        for part, texts in text_blocks(batches, "__text"):
            ids = [bpe.encode(x or "") for x in texts]
            columns = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([x.tobytes() for x in ids], pa.binary())
            columns |= {c: part.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns)

    return frame.mapInArrow(run, schema)
