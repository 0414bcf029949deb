"""Language ID by mixture inference: EM over word likelihoods from character trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import BLOCK_CHARS, text_blocks

BUCKETS = 1 << 15
#: Labelled documents of one language that the model is fitted on, at most (about; picked by a hash of the id).
TRAIN_DOCS = 2000
#: Rounds of EM with all languages, and with each smaller set.
ROUNDS, REFIT_ROUNDS = 6, 2
#: A further language must gain this many times log(words)/2 of log-likelihood.
PENALTY = 6.0
UNDETERMINED = "und"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("mixture", T.StringType()),
])


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """Lower-case code point of each letter; a space for all other characters."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x30000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[0x30000:0x323B0] = np.arange(0x30000, 0x323B0)  # the third ideographic plane, caseless
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of a text's words, each word's first index in them, and the place in the text where it starts.

    A word's grams end at each of its letters and at the space behind it; what lies before the word counts as spaces.
    """
    z = letter_codes()[np.frombuffer((text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = z != 32
    before = np.zeros_like(letter)
    before[1:] = letter[:-1]
    one = np.full_like(z, 32)
    one[1:] = z[:-1]
    two = np.full_like(z, 32)
    two[2:] = z[:-2]
    two[~before] = 32
    at = np.flatnonzero(letter | before)
    h = z[at] * np.uint32(0x9E3779B1) + one[at] * np.uint32(0x85EBCA77) + two[at] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    first = np.flatnonzero(letter[at] & ~before[at])
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64), first, at[first]


def pieces(text: str, limit: int = BLOCK_CHARS) -> Iterator[str]:
    """A very long text in parts, cut at a space where one is near."""
    start = 0
    while len(text) - start > limit:
        cut = text.rfind(" ", start + limit // 2, start + limit)
        cut = start + limit if cut < 0 else cut
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def word_likelihoods(text: str, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word in each language, and the words' places."""
    bucket, first, at = grams(text)
    if not len(first):
        return np.empty((0, logp.shape[1]), np.float32), at
    return np.add.reduceat(logp[bucket], first, axis=0), at


def infer(ll: np.ndarray, begin: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each document.

    ll: words by languages, the documents' words one after another, ``begin`` the first word of
    each (no document without a word). EM estimates the proportions with all languages. Sets of the
    heaviest one, two, ... languages are refitted for as long as each further one raises the
    penalised likelihood; a document stops on its own, at whatever number.
    """
    n, langs = len(begin), ll.shape[1]
    words = np.diff(np.append(begin, len(ll)))
    top = ll.max(1)
    like = np.exp(ll - top[:, None])
    base = np.add.reduceat(top.astype(np.float64), begin)
    doc = np.repeat(np.arange(n), words)

    def rounds(pi: np.ndarray, times: int) -> np.ndarray:
        for _ in range(times):
            r = like * pi[doc]
            r /= np.maximum(r.sum(1, keepdims=True), np.float32(1e-30))
            pi = np.add.reduceat(r, begin, axis=0) / words[:, None].astype(np.float32)
        return pi

    full = rounds(np.full((n, langs), 1 / langs, np.float32), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    cost = penalty * np.log(words + 1.0) / 2
    alone = np.add.reduceat(ll.astype(np.float64), begin, axis=0)
    best = np.zeros((n, langs), np.float32)
    best[np.arange(n), alone.argmax(1)] = 1
    value, grows = alone.max(1), np.arange(n)
    for k in range(2, langs + 1):
        pi = np.where(rank[grows] < k, np.maximum(full[grows], np.float32(1e-6)), np.float32(0))
        pi = rounds(pi / pi.sum(1, keepdims=True), REFIT_ROUNDS if k < langs else 1)
        mixed = np.log(np.maximum((like * pi[doc]).sum(1), np.float32(1e-30))).astype(np.float64)
        got = base[grows] + np.add.reduceat(mixed, begin) - (k - 1) * cost[grows]
        better = got > value[grows]
        best[grows[better]], value[grows[better]] = pi[better], got[better]
        if not better.any():
            break
        # words of the documents that grow
        like, grows, words = like[better[doc]], grows[better], words[better]
        doc, begin = np.repeat(np.arange(len(grows)), words), np.cumsum(words) - words
    return best


def held_out(id_column: str = "doc_id"):
    """The rows that no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Sorted language names, and log-probabilities by bucket and language.

    Learns from rows with text, language and id that are not held out. Each language's fraction is
    set from its count so that about ``bound`` documents are learned from; which ones, a hash of
    the id decides. Only the model (buckets x languages) reaches the driver.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, bound / sizes[lang]) * (1 << 32))))])
    sample = rows.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part, texts in text_blocks(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                into = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in pieces(text):
                    into += np.bincount(grams(piece)[0], minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at, "n": n[at]})

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BUCKETS, len(langs)))
    column = {lang: i for i, lang in enumerate(langs)}
    n[counted["bucket"].to_numpy(), [column[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    smooth = 0.5
    return langs, np.log((n + smooth) / (n.sum(0) + smooth * BUCKETS)).astype(np.float32)


def detect_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The language of every whole text, one row per row of ``docs``: a map without a shuffle.

    ``lang_pred`` is the language with the largest inferred proportion (``score``), ``mixture``
    lists the chosen set. Ties go to the smaller name. ``keep`` passes input columns through.

    A null or empty text and one without a letter is ``und`` with score 0, and so is everything
    where the model has no language. Very long texts are read in parts, all of which count.
    Repeated rows give repeated results; a null id stays null and is not held out; other columns
    are ignored, whatever their names.
    """
    langs, logp = model
    keep = [c for c in keep or [] if c not in SCHEMA.fieldNames()]
    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), held_out(f"`{id_col}`").alias("held_out"), F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*SCHEMA, *(frame.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, "__text"):
            names, scores, mixtures = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            lls, sizes = [np.empty((0, len(langs)), np.float32)], np.zeros(len(texts), np.int64)
            short = []
            for i, text in enumerate(texts if langs else ()):
                if text and len(text) > BLOCK_CHARS:
                    own = [word_likelihoods(x, logp)[0] for x in pieces(text)]
                    short.append((i, None, np.concatenate(own)))
                elif text:
                    short.append((i, text, None))
            # neighbouring short texts are one string; the words' places say whose they are
            run_of: list[tuple[int, str]] = []

            def flush(run_of: list[tuple[int, str]], sizes: np.ndarray = sizes, lls: list = lls) -> None:
                if not run_of:
                    return
                ll, at = word_likelihoods("\n".join(t for _, t in run_of), logp)
                ends = np.cumsum([len(t) + 1 for _, t in run_of])
                sizes[[i for i, _ in run_of]] = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
                lls.append(ll)

            for i, text, ll in short:
                if text is not None:
                    run_of.append((i, text))
                else:
                    flush(run_of)
                    run_of = []
                    sizes[i] = len(ll)
                    lls.append(ll)
            flush(run_of)
            with_words = np.flatnonzero(sizes)
            if len(with_words):
                begin = np.concatenate([[0], np.cumsum(sizes[with_words])[:-1]])
                pi = infer(np.concatenate(lls), begin)
                pi = pi / pi.sum(1, keepdims=True)
                for i, p in zip(with_words.tolist(), pi.astype(np.float64), strict=True):
                    j = int(p.argmax())
                    names[i], scores[i] = langs[j], min(1.0, p[j])
                    mixtures[i] = ",".join(f"{langs[k]}:{p[k]:.3f}" for k in np.argsort(-p, kind="stable") if p[k] > 0.0005)
            columns = {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "mixture": pa.array(mixtures, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {c: part.column(c) for c in keep})

    return frame.mapInArrow(run, schema)


#: A document of which no language holds so large a share of the words is rejected.
MIN_SHARE = 0.3


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or spread too thin; all columns stay.

    Null and empty texts and those without a letter go; so does everything where no labelled row
    teaches a language. Rows are judged by their text alone, so repeated rows and null ids are no
    exception; an empty table stays empty.
    """
    place = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in place.items()))
    model = fit(named, place[id_col], place[text_col], place[lang_col])
    found = detect_languages(named, model, place[id_col], place[text_col], keep=named.columns)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_share))
    return kept.select(*(F.col(n).alias(c) for c, n in place.items()))
