"""Operators on vectors, pages and conversations, and the pipeline, against plain versions."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from siltstone.llm import ann, transcripts, warc
from siltstone.llm.common import Scratch


# -- nearest neighbours ---------------------------------------------------------------------------


def nearest(ids, e, every, k=5):
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = unit @ unit[q]
        s[q] = -9
        out[int(ids[q])] = [int(x) for x in ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    e = np.concatenate([rng.normal(size=(900, 24)), rng.normal(size=(1, 24)) + 0.05 * rng.normal(size=(300, 24))])
    ids = np.arange(len(e))
    rows = spark.createDataFrame([(int(i), [float(x) for x in v], "clash") for i, v in zip(ids, e, strict=True)], "vec_id bigint, embedding array<double>, node string")
    found = ann.nearest(rows, 50).collect()
    want = nearest(ids, e, 50)
    assert len(found) == 5 * len(want)
    assert sum(r.vec_id in want[r.query_id] for r in found) / len(found) >= 0.9
    for r in found[:50]:
        assert abs(r.score - e[r.query_id] @ e[r.vec_id] / np.linalg.norm(e[r.query_id]) / np.linalg.norm(e[r.vec_id])) < 1e-12


@pytest.mark.parametrize("noise", [0.01, 0.001])
def test_recall_among_near_copies(spark, noise):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(1, 64))
    e = np.concatenate([rng.normal(size=(1000, 64)), centre + noise * rng.normal(size=(500, 64))])
    ids = rng.permutation(len(e))
    rows = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, e, strict=True)], "vec_id bigint, embedding array<double>")
    found, want = ann.nearest(rows, 10).collect(), nearest(ids, e, 10)
    close = {int(i) for i in ids[1000:]}
    among = [r for r in found if r.query_id in close]
    assert len(among) == 5 * len(close & want.keys()) > 150
    assert sum(r.vec_id in want[r.query_id] for r in among) / len(among) >= 0.95


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (100, [1.0, 1.0])]
    bad = [(1, None), (2, [0.0, 0.0]), (150, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0])]
    found = ann.nearest(spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>"), 50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 3), (0, 50), (0, 100), (0, 4), (50, 0), (50, 3), (50, 100), (50, 4), (100, 0), (100, 3), (100, 4), (100, 50)]
    assert ann.nearest(spark.createDataFrame(bad[:3], "vec_id bigint, embedding array<float>"), 50).count() == 0


def test_start_of_the_graph_is_near_and_merges_are_exact(spark):
    rng = np.random.default_rng(6)
    e = rng.normal(size=(3000, 16))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    scratch = Scratch(spark, "t")
    nodes = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "node bigint, embedding array<double>")
    rows = ann._sides(scratch.save(ann.pack(nodes), "packed")).repartitionByRange(3, "u", "x").sortWithinPartitions("u", "x")
    offers = ann._start(rows, 300).select("*", F.lit(1).alias("fresh")).collect()
    at_first = {(r.v, w) for r in offers for w in r.ws}
    near = np.argsort(-(e @ e.T), axis=1)[:, 1:6]
    assert max(len(r.ws) for r in offers) <= ann.START_OFFERS and all(v != w for v, w in at_first)
    # 300 of 3000 nodes at random in each of the tables would be 0.47 of the pairs
    assert sum((i, int(w)) in at_first for i, ws in enumerate(near) for w in ws) / near.size > 0.7

    old = [(0, [1, 2, 3], [-0.1, -0.2, -0.3], 0), (7, [1], [-0.5], 0)]
    new = [(0, [2, 4], [-0.2, -0.15], 1), (0, [4, 5], [-0.15, -0.9], 1), (3, [0], [-0.3], 1)]
    merged = ann._best(spark.createDataFrame(old + new, f"{ann._EDGE_LISTS}, fresh int"), 3).collect()
    assert {r.v: (r.ws, r.fresh) for r in merged} == {0: ([1, 4, 2], 1), 3: ([0], 1), 7: ([1], 0)}
    graph = {r.u: sorted(r.xs) for r in ann.neighbourhoods(spark.createDataFrame(old + new[2:], f"{ann._EDGE_LISTS}, fresh int"), 1, 0).collect()}
    assert graph[3] == [0] and graph[2] == [0] and graph[7] == [1] and graph[1] in ([0], [7]) and graph[0] == [1, 2, 3]
    scratch.clear()


# -- WARC -----------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 30
    rows = [(5, "http://a/ b\r\nX: y", big), (2, None, big), (9, "u", big), (9, "u", big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", big), (7, "u", "<b>\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    files, found = warc.archive_pages(pages, root=f"file://{tmp_path}")
    size = lambda h: len((h or "").encode())
    want = [(i, size(h), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i in (5, 9) else "response", 2 if h == big and i in (5, 9) else None) for i, _, h in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert not (tmp_path / "monolithic").exists()
    members = 0
    for path, index in files.collect():
        data = open(path, "rb").read()
        for line in open(index):
            offset, length, kind, _ = line.split()
            one = zlib.decompress(data[int(offset) : int(offset) + int(length)], 31)
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and one.endswith(b"\r\n\r\n")
            members += 1
    assert members == len(rows) + files.count()
    assert warc.archive_pages(pages.limit(0))[1].count() == 0


def test_a_broken_archive_is_refused():
    whole = warc.file_info("x") + warc.page_record(1, "u", b"payload", "d", None, False)
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    stream = packed.compress(whole) + packed.flush()
    parts = lambda b: iter([b[i : i + 7] for i in range(0, len(b), 7)])
    assert len(list(warc.records(warc.inflate(parts(stream + stream))))) == 4
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.records(iter([whole[:-3]])))
    for cut in (1, 4, 8, 9, len(stream) - 1):
        for data in (stream[:-cut], stream + stream[:-cut]):
            with pytest.raises(ValueError, match="breaks off"):
                list(warc.records(warc.inflate(parts(data))))
    large = zlib.compress(b"x" * (5 * warc.BLOCK), wbits=31)
    assert sum(map(len, warc.inflate(iter([large])))) == 5 * warc.BLOCK


def test_one_very_long_payload_and_many_copies(spark):
    long = "<p>long</p>" * 400_000
    rows = [(1, "u", long), (2, "u", long), *((i, "u", "<b>copy</b>" * 20) for i in range(3, 300))]
    found = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))[1].collect()}
    assert found[2].refers_to == 1 and found[1].payload_bytes == len(long) and len(found) == len(rows)
    assert all(found[i].refers_to == 3 for i in range(4, 300)) and found[3].record_type == "response"


# -- transcripts ----------------------------------------------------------------------------------


def test_roles_are_recovered(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    written = Scratch(spark, "t").save(transcripts.write_transcripts(talks.withColumn("part", F.lit("clash")).withColumn("pos", F.lit(1))), "w")
    model = transcripts.fit(written)
    found = transcripts.parse_transcripts(written, model).join(written.select("conv_id", F.array_join("roles", ",").alias("truth"), "spaced"), "conv_id")
    marked = found.filter("spaced")
    assert marked.filter("roles = truth").count() / marked.count() > 0.85


def test_awkward_transcripts(spark):
    rows = [(1, 0, "user", "Hi?"), (1, 1, "assistant", "Yes.\n\nMore <|im_end|>"), (1, 1, "assistant", "Yes.\n\nMore <|im_end|>"), (2, None, None, None), (None, 0, "user", "x"), (3, 300, "system", ""), (3, 1, "user", "a")]
    written = transcripts.write_transcripts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted((str(r.conv_id), r.part, r.parts) for r in written.collect()) == [("1", 0, 1), ("2", 0, 1), ("3", 0, 1), ("None", 0, 1)]
    model = transcripts.fit(written)
    assert transcripts.parse_transcripts(written, model).count() == 4
    assert transcripts.parse_transcripts(written.limit(0), transcripts.fit(written.limit(0))).count() == 0
    assert transcripts.parse(None, model) == []
    text = "User: hi\nAssistant: yes\nstill\n\nmore\nUser: ok"
    known = transcripts.Hmm.from_counts(["assistant", "user"], {("start", 0, 2): 5, ("step", 2, 0): 5, ("step", 0, 1): 3, ("step", 1, 2): 3, ("step", 1, 1): 3, ("f0", 2, 0): 9, ("f0", 0, 1): 9, ("f0", 1, 4): 9, ("f0", 3, 4): 9})
    assert transcripts.parse(text, known) == [("user", "hi"), ("assistant", "yes\nstill\n\nmore"), ("user", "ok")]
    assert whole(known, "User: a<|b\n\nAssistant: c\n\n\nd\n\n") == ("<|im_start|>user\na< |b<|im_end|>\n<|im_start|>assistant\nc\n\n\nd<|im_end|>\n", ["user", "assistant"])


def whole(model, text):
    """Canonical turns and roles of a transcript in one piece, from its parsed turns."""
    turns = transcripts.parse(text, model)
    return "".join(f"<|im_start|>{role}\n{body.replace('<|', '< |')}<|im_end|>\n" for role, body in turns), [role for role, _ in turns]


@pytest.mark.parametrize(("turns", "group"), [(3, 2), (7, 4), (1, 3)])
def test_parts_are_parsed_as_one_transcript(spark, monkeypatch, turns, group):
    monkeypatch.setattr(transcripts, "PART_TURNS", turns)
    monkeypatch.setattr(transcripts, "GROUP", group)
    rng = random.Random(turns)
    bodies = ["Hi?", "yes", "more\nlines here", "", "a\n\nb\n", "\n", "Q: odd", "what <|is|> this?", None]
    rows = [(conv, turn if (conv or 1) % 3 else (None if turn % 2 else 4), rng.choice(["user", "assistant", "system", None]), rng.choice(bodies) and f"{rng.choice(bodies) or ''} {turn}") for conv in (1, 2, 3, 4, 5, 6, 7, 8, None) for turn in range(rng.choice([1, 5, 40]))]
    rows += [(9, i, "user", "") for i in range(30)] + [(10, i, "user", "" if i % 9 else "only this?") for i in range(30)]
    written = Scratch(spark, "t").save(transcripts.write_transcripts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")), "w")
    model = transcripts.fit(written)
    found, text = {}, {}
    for r in written.orderBy("conv_id", "part").collect():
        assert len(r.roles) <= turns
        text[r.conv_id] = text.get(r.conv_id, "") + r.transcript
    assert written.agg(F.max("parts")).first()[0] > group
    for r in transcripts.parse_transcripts(written, model).orderBy("conv_id", "part").collect():
        shown, roles, n = found.get(r.conv_id, ("", [], 0))
        found[r.conv_id] = (shown + r.rendered, roles + (r.roles.split(",") if r.roles else []), n + r.n_turns)
        assert r.rendered_sha256 == hashlib.sha256(r.rendered.encode()).hexdigest()
    assert found.keys() == text.keys()
    for conv, (shown, roles, n) in found.items():
        want = whole(model, text[conv])
        # of equally likely paths parts may take another, so the scores are compared where the turns differ
        if (shown, roles) != want:
            raise AssertionError(f"{conv}: {shown!r} {want[0]!r}")
        assert n == len(roles)


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    emit = [np.log(rng.dirichlet(np.ones(k), 4)) for k in transcripts.SIZES]
    model = transcripts.Hmm(["a", "b"], np.log(rng.dirichlet(np.ones(4))), np.log(rng.dirichlet(np.ones(4), 4)), emit)
    rows = np.array([[rng.integers(k) for k in transcripts.SIZES] for _ in range(6)])
    score = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(e[s, r[k]] for s, r in zip(p, rows, strict=True) for k, e in enumerate(emit))
    paths = [[i // 4**k % 4 for k in range(6)] for i in range(4**6)]
    assert model.decode(rows).tolist() == max(paths, key=score)


# -- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_matches_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Scratch(spark, "t").save(stage(spark, docs, folder), str(i))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    final = {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert final == {tuple(r) for r in docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for earlier, later in zip(names, names[1:], strict=False):
        assert kept[later] <= kept[earlier]
    assert kept["language ID"] == {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").filter("text rlike '[a-zA-Z]'").collect()}
    assert len(kept["SimHash near-dedup"]) < len(kept["language ID"]) and kept["benchmark decontamination"] < kept["SimHash near-dedup"]


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(entry.oracle_sql().keys() & {"op6_line_runs", "op8_warc_archive", "op10_decontamination"}))
def test_sql_equivalents(spark, name):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = entry.queries()[name](spark, folder), con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_scratch_is_cleared(spark):
    from siltstone.llm.common import clear_scratch

    saved = Scratch(spark, "t").save(spark.range(3), "numbers")
    assert saved.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        saved.count()


def test_scratch_starts_few_processes_and_sees_damage(spark):
    scratch = Scratch(spark, "t")
    saved = scratch.save(spark.range(0, 1000, 1, 1), "numbers")
    folder = Path(saved.scratch_path.removeprefix("file:"))
    part, *others = folder.iterdir()
    assert not others and saved.count() == 1000
    data = bytearray(part.read_bytes())
    data[len(data) // 4] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|corrupt"):
        saved.agg(F.sum("id")).collect()
    scratch.clear()
