"""The registered opN_ queries and the pipeline over whole tables, against plain versions."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from test_documents import WORDS, ascii_words, plain_components, plain_contamination, plain_dedup, plain_fingerprint, plain_scan, tiktoken_coder  # noqa: F401
from test_other_tables import nearest, whole
from tokenizers import Tokenizer

from siltstone.llm import transcripts
from siltstone.llm.common import Scratch
from siltstone.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def bench(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]


def answer(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_op1(spark, texts):
    rows = answer(spark, "op1_language_mixture")
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    told = [r for r in rows if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in told) > 0.95 * len(told) > 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def near_groups(texts):
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    group = plain_components(prints, 4)
    low = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in group}
    return {i: (f"{p:016x}", low[g]) for i, p, g in zip(ids, prints, group, strict=True)}


def test_op2(spark, texts):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in answer(spark, "op2_simhash_components")} == near_groups(texts)


def test_op3(spark, texts, tiktoken_coder):  # noqa: F811
    rows = answer(spark, "op3_bpe_roundtrip")
    want = {i: tiktoken_coder.encode_ordinary(t or "") for i, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha((texts[i] or "").encode())) for i, x in want.items()}
    assert regex.findall(public_tokenizers.PATTERN, "a b") == ["a", " b"]


def test_op4(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    good = [(r.vec_id, r.embedding) for r in table if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, e = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float64)
    want, rows = nearest(ids, e, 50), answer(spark, "op4_nearest_vectors")
    assert len(rows) == sum(map(len, want.values())) and sum(r.vec_id in want[r.query_id] for r in rows) >= 0.9 * len(rows)


def test_op5(spark, texts):
    rows = answer(spark, "op5_license_scan")
    assert {r.doc_id: (r.n_words, r.n_base, r.base_labels, r.labels, r.score) for r in rows} == {i: plain_scan(t or "") for i, t in texts.items()}


def test_op6(spark, texts):
    want = plain_dedup([(i, t) for i, t in texts.items() if t is not None], 50)
    rows = {r.doc_id: r for r in answer(spark, "op6_line_runs")}
    assert {i: r.text for i, r in rows.items()} == want | {i: None for i, t in texts.items() if t is None}
    assert all(r.n_lines - r.n_deleted == (len(want[i].split("\n")) if want[i] or not r.n_deleted else 0) for i, r in rows.items() if texts[i] is not None)


def test_op7(spark, texts):
    library, start, want = Tokenizer.from_file(WORDS), 0, {}
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in answer(spark, "op7_token_store")} == want


def test_op9(spark):
    talks = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    written = Scratch(spark, "t").save(transcripts.write_transcripts(talks), "w")
    model, text = transcripts.fit(written), {r.conv_id: r.transcript for r in written.orderBy("conv_id", "part").collect()}
    rows = answer(spark, "op9_transcript_roles")
    assert written.agg(F.max("parts")).first()[0] == 1 and {r.conv_id for r in rows} == text.keys()
    for r in rows:
        assert (r.rendered, r.roles.split(",") if r.roles else []) == whole(model, text[r.conv_id])


def test_op10(spark, texts, bench):
    rows = answer(spark, "op10_decontamination")
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == plain_contamination(texts.items(), bench)


def test_pipeline(spark, texts, bench, tiktoken_coder):  # noqa: F811
    """All five stages, each in plain form."""
    kept = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    cut = plain_dedup(list(kept.items()), 50)
    kept = {i: cut[i] for i, t in kept.items() if cut[i] or not t}
    kept = {i: kept[i] for i, (_, low) in near_groups(kept).items() if low == i}
    assert min(len(ascii_words(t)) for _, t in bench) >= 13
    hit = {r[0] for r in plain_contamination(kept.items(), bench) if r[2]}
    kept = {i: t for i, t in kept.items() if str(i) not in hit}
    want = {i: tiktoken_coder.encode_ordinary(t or "") for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in rows} == {i: (len(x), sha(np.array(x, "<u4").tobytes())) for i, x in want.items()}
