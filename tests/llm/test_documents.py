"""Operators on documents against plain versions, on a table of awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import bpe, components, decontaminate, language_id, license_scan, line_dedup, simhash, token_store
from siltstone.llm.common import Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, g int, rid int, __c0 string"

LONG = "the quick brown fox jumps over the lazy dog and runs away. " * 4000
ROWS = [
    (1, "Under the MIT license. Le chat est là.\nSecond line", "en"), (2, None, "en"), (3, "", "fr"), (4, "   \n\t ", "de"),
    (5, LONG, "en"), (6, LONG, None), (None, "no id here at all", "en"), (7, "same text", "en"), (7, "same text", "en"),
    (8, "123 ###", "fr"), (9, "x" * 5000, "es"), (10, "İstanbul ΣΑΣ 中文 😀 don't we'll l'eau  two  spaces\r\n", "fr"), (None, None, None),
]


def frame(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, "z", 1, 2, "clash") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ascii_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def sha(data):
    return hashlib.sha256(data).hexdigest()


# -- language ID ----------------------------------------------------------------------------------


def test_language_of_awkward_rows(spark, docs):
    model = language_id.fit(docs)
    assert model[0] == ["de", "en", "es", "fr"]
    rows = language_id.detect_languages(docs, model).collect()
    assert len(rows) == len(ROWS)
    for r, (i, text, _) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(ROWS, key=lambda r: str(r[0])), strict=True):
        assert r.doc_id == i and 0 <= r.score <= 1
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or "") and i is not None:
            assert (r.lang_pred, r.score) == ("und", 0)
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.detect_languages(docs, nothing).collect()} == {"und"}
    assert language_id.detect_languages(docs.limit(0), model).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {t for _, t, _ in ROWS if any(c.isalpha() for c in t or "")}


def test_mixtures_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    found = language_id.detect_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = found.filter("lang = lang_pred").count()
    assert right / found.count() > 0.97
    ll, begin, size = [], [], 0
    for text in ("the of and that with this " * 30, "der die und nicht das ist " * 30 + "the of and that with this " * 30):
        part, _ = language_id.word_likelihoods(text, model[1])
        begin.append(size)
        size += len(part)
        ll.append(part)
    pure, mixed = language_id.infer(np.concatenate(ll), np.array(begin))
    names = model[0]
    assert pure[names.index("en")] > 0.99
    assert abs(mixed[names.index("de")] - 0.5) < 0.15 and abs(mixed[names.index("en")] - 0.5) < 0.15


def plain_inference(ll):
    """One document's proportions, word by word: nested sets grow while the penalised likelihood does."""
    words, langs = ll.shape
    like = np.exp(ll.astype(np.float64) - ll.max(1, keepdims=True))

    def rounds(pi, times):
        for _ in range(times):
            total = np.zeros(langs)
            for row in like:
                total += row * pi / max((row * pi).sum(), 1e-30)
            pi = total / words
        return pi

    full = rounds(np.full(langs, 1 / langs), language_id.ROUNDS)
    heaviest = sorted(range(langs), key=lambda i: (-full[i], i))
    value, best = max((ll[:, i].sum(dtype=np.float64), -i) for i in range(langs)), None
    best = np.eye(langs)[-value[1]]
    value = value[0]
    for k in range(2, langs + 1):
        pi = np.array([max(full[i], 1e-6) if i in heaviest[:k] else 0 for i in range(langs)])
        pi = rounds(pi / pi.sum(), language_id.REFIT_ROUNDS if k < langs else 1)
        got = sum(m + np.log(max((row * pi).sum(), 1e-30)) for m, row in zip(ll.max(1).astype(np.float64), like, strict=True)) - (k - 1) * language_id.PENALTY * np.log(words + 1) / 2
        if got <= value:
            break
        value, best = got, pi
    return best


def test_mixtures_match_a_plain_inference():
    rng = np.random.default_rng(6)
    langs, parts = 7, []
    for true in ([0], [3], [0, 1], [2, 4, 6], [0, 1, 2, 3, 4], list(range(7)), [5]):
        words = int(rng.integers(1, 60)) * len(true)
        ll = rng.normal(-30, 1, (words, langs))
        ll[np.arange(words), rng.choice(true, words)] += 8
        parts.append(ll.astype(np.float32))
    found = language_id.infer(np.concatenate(parts), np.cumsum([0, *(len(p) for p in parts[:-1])]))
    for got, ll in zip(found, parts, strict=True):
        assert np.allclose(got, plain_inference(ll), atol=2e-3)
    assert (found > 0).sum(1).tolist()[:3] == [1, 1, 2] and (found[5] > 0).sum() > 4


def test_long_texts_are_read_whole():
    assert "".join(language_id.pieces("ab cd " * 1000, 100)) == "ab cd " * 1000
    assert "".join(language_id.pieces("x" * 1000, 100)) == "x" * 1000


# -- SimHash --------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash_of_awkward_rows(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t, _ in ROWS]
    group = plain_components(prints, 4)
    smallest = {g: min((r[0] for r, h in zip(ROWS, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), f"{p:016x}", smallest[g]) for r, p, g in zip(ROWS, prints, group, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.select("__c0", "score").distinct().count() == 1
    by_component = {g: min((r[0] is None, r[0] or 0) for r, h in zip(ROWS, group, strict=True) if h == g) for g in group}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r, g in zip(ROWS, group, strict=True) if (r[0] is None, r[0] or 0) == by_component[g])


def test_near_duplicates_of_a_repeated_id(spark):
    a, b, c = "some text that comes twice", "another text which stands alone here", "a third one with words of its own"
    rows = [(3, a, "en"), (7, a, "en"), (7, b, "en"), (9, c, "en"), (9, c, "en"), (None, c, "en"), (None, "no id and no copy at all", "en"), (4, None, None), (5, "", None)]
    kept = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("3", a), ("4", None), ("7", b), ("9", c), ("9", c), ("None", "no id and no copy at all")]
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("chance", "pairs"), [(4, 0), (1 << 40, simhash.SPLIT_PAIRS), (4, 20)])
def test_links_are_exact(spark, monkeypatch, chance, pairs):
    monkeypatch.setattr(simhash, "SPLIT_PAIRS", pairs)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centres for _ in range(25)} | {rng.getrandbits(64) for _ in range(30)}
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "block_masks", lambda n, bits, f=simhash.block_masks: f(n if chance == 4 else 1 << 40, bits))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 1) for p in prints], "fp bigint, n bigint")
    found = {r.fp % (1 << 64): r.component for r in simhash.link_fingerprints(nodes, Scratch(spark, "t")).collect()}
    group = plain_components(prints, 4)
    assert len({found[p] for p in prints}) == len(set(group)) == len({(found[p], g) for p, g in zip(prints, group, strict=True)})


def test_components_of_a_chain_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a bigint, b bigint")
    found = {r.node: r.component for r in components.components(edges, Scratch(spark, "t")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0), Scratch(spark, "t")).count() == 0


# -- byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_coder():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_of_awkward_rows(docs, tiktoken_coder):
    want = []
    for i, text, _ in ROWS:
        ids = tiktoken_coder.encode_ordinary(text or "")
        want.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    found = bpe.bpe_roundtrip(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == sorted(want)
    assert bpe.bpe_roundtrip(docs.limit(0), RANKS, public_tokenizers.PATTERN, with_ids=True, keep=["lang", "ids"][:1]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "lang"]


PIECES = ["a", "é", "中", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "1", "²", "٣", "!", "?", "\x1c", "\x85", "​", "😀", "Σ", "\r\n", "the", "d"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_pretokens_and_ids_are_those_of_the_pattern(tiktoken_coder, text):
    coder = bpe.coder(RANKS, public_tokenizers.PATTERN, tuple(bpe.read_ranks(RANKS)))
    assert coder.split(text) == regex.findall(public_tokenizers.PATTERN, text)
    ids = coder.encode(text)
    assert ids.tolist() == tiktoken_coder.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_long_texts_split_alike_in_parts():
    text = "some words, l'eau\n\nand 12 more  here " * 500
    coder = bpe.coder(RANKS, public_tokenizers.PATTERN, tuple(bpe.read_ranks(RANKS)))
    cuts = [text[a:b] for a, b in bpe.parts(text, 1000)]
    assert len(cuts) > 5 and "".join(cuts) == text
    assert [w for c in cuts for w in coder.split(c)] == regex.findall(public_tokenizers.PATTERN, text)


# -- licence scan ---------------------------------------------------------------------------------


def test_licenses_of_awkward_rows(docs):
    rows = {str(r.doc_id): r for r in license_scan.scan_licenses(docs).collect()}
    for i, text, _ in ROWS[:12]:
        words = ascii_words(text)
        places = sorted(p for phrase in license_scan.BASE_PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        if i is not None:
            r = rows[str(i)]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), *((places[0], places[-1]) if places else (None, None)))
    assert rows["1"].base_labels == "mit" and rows["3"].labels == "" and rows["2"].score == 0
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_licence_expressions():
    assert license_scan.to_postfix("MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0) */") == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    assert license_scan.evaluate(license_scan.to_postfix("MIT AND GPL-3.0")) == (False, ["mit", "gpl-3.0"])
    assert license_scan.evaluate(license_scan.to_postfix("GPL-3.0 OR MIT"))[0]
    for wrong in ("", "AND MIT", "(MIT", "MIT OR", ")"):
        with pytest.raises(ValueError):
            license_scan.to_postfix(wrong)
    row = license_scan.scan("// SPDX-License-Identifier: Apache-2.0 OR GPL-3.0-only\nunder the MIT license under the mit LICENSE; all rights reserved")
    assert row[1] == 2 and row[4] == "mit" and row[5] == "apache-2,gpl-3,mit,proprietary" and row[8] is True


def test_compound_and_unknown_licences():
    read = lambda t: license_scan.scan(f"x SPDX-License-Identifier: {t}\n")[5:]
    assert read("(MIT OR Apache-2.0) WITH LLVM-exception")[::3] == ("apache-2,mit", True)
    assert read("GPL-2.0+ WITH Classpath-exception-2.0 WITH other")[::3] == ("gpl-2", False)
    assert read("MIT AND no-such-licence")[::3] == ("mit", False) and read("MIT OR no-such-licence")[::3] == ("mit", True)
    for nothing in ("foo bar baz", "MIT WITH (A OR B)", "WITH MIT", "MIT WITH", "(MIT", "", "OR", "MIT OR spdx-license-identifier: nothing"):
        assert read(nothing) == ("", 0.0, None, None)
    assert license_scan.scan("SPDX-License-Identifier: MIT OR\nMIT")[5] == ""
    assert license_scan.scan("license-expression : MPL-2.0 é")[5] == "mpl-2.0"


LICENSE_PIECES = [*license_scan.BASE_PHRASES, *license_scan.NOTICE_PHRASES, "under the", "MIT", "license", "and", "é", "Permission", "\n", "SPDX-License-Identifier: ", "mit", "isc AND (zlib or nope)", " WITH x", "gpl-3.0-only or bsd-2-clause", ")", "("]


def plain_scan(text):
    """Phrases by search at every place, expressions by recursive descent."""
    w = ascii_words(text)
    at = lambda phrases: [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base, more = at(license_scan.BASE_PHRASES), at(license_scan.NOTICE_PHRASES)
    labels, weight = {x for _, x in [*base, *more]}, 2 * len(base) + len(more)
    for line in text.split("\n"):
        for value in re.split("(?i)spdx-license-identifier: ", line)[1:]:
            tokens, names = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", value.split("spdx-license-identifier")[0]), []

            def primary():
                if not tokens:
                    raise ValueError
                t = tokens.pop(0).lower()
                if t == "(":
                    either()
                    if not tokens or tokens.pop(0) != ")":
                        raise ValueError
                elif t in ("and", "or", "with", ")"):
                    raise ValueError
                else:
                    names.append(t)
                while tokens and tokens[0].lower() == "with":
                    tokens.pop(0)
                    if not tokens or tokens[0].lower() in ("(", ")", "and", "or", "with"):
                        raise ValueError
                    tokens.pop(0)

            def both():
                primary()
                while tokens and tokens[0].lower() == "and":
                    tokens.pop(0)
                    primary()

            def either():
                both()
                while tokens and tokens[0].lower() == "or":
                    tokens.pop(0)
                    both()

            try:
                either()
                if tokens and tokens[0] == ")":
                    raise ValueError
            except ValueError:
                continue
            if known := [x for x in names if license_scan.is_known(x)]:
                labels |= {license_scan.TAG_LABELS.get(x, x) for x in (y.removesuffix("-only") for y in known)}
                weight += 3
    return len(w), len(base), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1 - 0.5 ** min(weight, 50)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(LICENSE_PIECES), max_size=10).map(" ".join))
def test_labels_match_a_plain_scan(text):
    row = license_scan.scan(text)
    assert (row[0], row[1], row[4], row[5], row[6]) == plain_scan(text)


def test_tags_on_long_lines():
    two = "/* SPDX-License-Identifier: MIT */ x=1; /* SPDX-License-Identifier: GPL-3.0-only */ y"
    row = license_scan.scan(two)
    assert (row[5], row[7], row[8]) == ("gpl-3,mit", "mit; gpl-3.0-only", False)
    names = [f"LicenseRef-{i:04d}" for i in range(300)]
    row = license_scan.scan("SPDX-License-Identifier: " + " OR ".join([*names, "MIT"]) + "\nMIT")
    assert row[5].split(",") == [*(n.lower() for n in names), "mit"] and row[8] is True
    row = license_scan.scan("spdx-license-identifier:\nSPDX-License-Identifier: (" + " " * 2000 + "MIT)")
    assert (row[7], row[8]) == ("mit", True)


# -- line dedup -----------------------------------------------------------------------------------


def plain_dedup(docs, min_words):
    """Each line inside a run of min_words words that also occurs earlier goes, but never one of the first occurrence."""
    lines, gone = [(x, d) for d, t in sorted(docs) for x in t.split("\n")], set()
    end = {d: i + 1 for i, (_, d) in enumerate(lines)}
    count = [len(x.split()) for x, _ in lines]
    text = [x for x, _ in lines]
    for g in range(len(lines)):
        for m in range(1, end[lines[g][1]] - g + 1):
            if sum(count[g : g + m]) >= min_words:
                first = next((f for f in range(g) if f + m <= end[lines[f][1]] and text[f : f + m] == text[g : g + m]), None)
                if first is not None:
                    gone |= set(range(max(g, first + m), g + m))
    out = defaultdict(list)
    for i, (x, d) in enumerate(lines):
        if i not in gone:
            out[d].append(x)
    return {d: "\n".join(out[d]) for d, _ in docs}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_runs_match_a_plain_search(spark, seed):
    rng = random.Random(seed)
    lines = ["a b", "c", "d e f", "g", "", "h i", "a b c d e", "x y"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))) for i in range(25)]
    docs += [(25, docs[3][1]), (26, docs[3][1] + "\nzz"), (27, ""), (28, "a b c d e\n" * 6)]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, [(i, t, "en") for i, t in docs]), min_words=6).collect()}
    assert found == plain_dedup(docs, 6)


def test_sparse_line_runs(spark):
    sparse = "".join(f"w{i}" + "\n" * 5 for i in range(60))
    parted = "\n".join(f"v{i}" for i in range(30)) + "\n" * 100 + "\n".join(f"u{i}" for i in range(30))
    tail = "t " * 60 + "\n" * 90 + "end"
    docs = [(i, t, "en") for i, t in enumerate([sparse, parted, tail, sparse, "other\n" + parted, tail])]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert found == {0: sparse, 1: parted, 2: tail, 3: "", 4: "other", 5: ""}


def test_words_of_lines_with_other_white_space(spark):
    docs = [(i, "\n".join("\tw%d \r" % n for n in range(49)), "en") for i in range(2)] + [(i, "\n".join("\tv%d\x0bz\r" % n for n in range(25)), "en") for i in range(2, 4)]
    found = {r.doc_id: r.n_deleted for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 25}


def test_sparse_line_runs_match_a_plain_search(spark):
    rng = random.Random(7)
    docs = [(i, "\n".join(rng.choice(["", "", "", "a", "b c"] if rng.random() < 0.2 else [""]) for _ in range(90))) for i in range(3)]
    docs += [(3, docs[0][1] + "\nz"), (4, "y\n" + docs[1][1][20:])]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, [(i, t, "en") for i, t in docs]), min_words=6).collect()}
    assert found == plain_dedup(docs, 6)


def test_line_dedup_of_awkward_rows(spark, docs):
    found = line_dedup.dedup_lines(docs).collect()
    assert len(found) == len(ROWS)
    text = {str(r.doc_id): r.text for r in found if r.doc_id is not None}
    assert text["5"] == LONG and text["6"] == "" and text["2"] is None and text["3"] == "" and text["7"] == "same text"
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# -- decontamination ------------------------------------------------------------------------------


def plain_contamination(docs, bench):
    windows = defaultdict(set)
    for item, text in bench:
        w = ascii_words(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[i : i + 13])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = ascii_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[k]
        out.append((str(doc), len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_matches_a_plain_search(spark):
    rng = random.Random(3)
    words = ["Été", "the", "of", "x1", "so", "ÄB", "now"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "! "]) for _ in range(n))
    bench = [(1, text(30)), (2, text(13)), (3, "now so"), (4, "the"), (5, ""), (6, None), (10, text(20)), (11, "absentword the of")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(20)] + [(20, "!! " + bench[0][1].upper()), (21, bench[1][1] * 2), (22, None), (23, ""), (None, bench[0][1]), (7, bench[1][1]), (7, bench[1][1])]
    table = spark.createDataFrame([(*b, 0) for b in bench], "item_id bigint, text string, wid int")
    found = decontaminate.contamination_report(frame(spark, [(i, t, "en") for i, t in docs]), table)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == plain_contamination(docs, bench)
    clean = decontaminate.drop_contaminated(frame(spark, [(i, t, "en") for i, t in docs]), table)
    long = [(i, t) for i, t in bench if len(ascii_words(t)) >= 13]
    want = [a[0] for a, b in zip(plain_contamination(docs, bench), plain_contamination(docs, long), strict=True) if not a[-1] and not b[2]]
    assert sorted(str(r.doc_id) for r in clean.collect()) == want and clean.columns == frame(spark, []).columns


def test_no_kept_document_holds_a_window(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = [(1, "clean words " * 400 + item + " more words" * 400, "en"), (2, "clean words " * 400, "en"), (3, " ".join(item.split()[:12]) + " else " * 300, "en"), (4, "a few short words " * 50, "en"), (5, None, "en")]
    table = spark.createDataFrame([(1, item), (2, "few short"), (3, "short " * 3)], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(frame(spark, docs), table)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    report = {r.doc_id: r for r in decontaminate.contamination_report(frame(spark, docs), table).collect()}
    assert report[1].n_hit == 14 and not report[1].contaminated and report[4].contaminated


def test_contamination_of_empty_tables_and_near_matches(spark, docs):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination_report(docs, empty).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.contamination_report(docs.limit(0), empty).count() == 0
    bench = spark.createDataFrame([(1, "alpha one two three omega")], "item_id bigint, text string")
    rows = [(1, "so alpha one two extra three omega", "en"), (2, "one one one one", "en"), (3, "alpha one two three omega", "en"), (4, "alpha one two other omega", "en"), (5, "alpha and then very many other words before omega", "en")]
    found = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination_report(frame(spark, rows), bench).collect()}
    assert found == {1: (0, 1), 2: (0, 0), 3: (5, 0), 4: (0, 1), 5: (0, 0)}
    never = spark.createDataFrame([(1, "alpha one two lost omega")], "item_id bigint, text string")
    found = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination_report(frame(spark, rows), never).collect()}
    assert found[3] == (0, 1) and found[2] == (0, 0)


def test_large_benchmark_tables_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "of", "a1", "b2", "É", "so"]) for _ in range(n))
    bench = [(i, text(rng.randint(1, 20))) for i in range(6)]
    docs = [(i, text(rng.randint(0, 60)) + (bench[i][1] if i < 6 else "")) for i in range(12)] + [(20, "long " * 30_000 + bench[0][1])]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    found = decontaminate.contamination_report(frame(spark, [(i, t, "en") for i, t in docs]), table)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == plain_contamination(docs, bench)


# -- token store ----------------------------------------------------------------------------------


def test_store_of_awkward_rows(spark, docs):
    library = Tokenizer.from_file(WORDS)
    want, start = [], 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    nulls = []
    for i, text, _ in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        row = (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        (nulls if i is None else want).append(row)
        start += len(ids)
    found = [tuple(r) for r in token_store.token_report(docs, WORDS).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(r for r in found if r[0] is not None) == sorted(want)
    assert sorted(r[2:] for r in found if r[0] is None) == sorted(r[2:] for r in nulls)
    assert token_store.token_report(docs.limit(0), WORDS).count() == 0


def test_special_tokens_in_texts_are_those_of_the_library():
    library, words = Tokenizer.from_file(WORDS), token_store.encoder(WORDS)
    for text in ("abc <|endoftext|> def", "<|ENDOFTEXT|> A", "X<|startoftext|>Y.\nÉ<|endoftext|>", "<|endoftext|>.", "<|EndOfText|>a, <|endoftext|><|endoftext|>", "<| endoftext |> A<|B.", "a<|"):
        assert words.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


WORD_PIECES = ["a", "B", "Word", "É", "é", "J\u030c", "I\u0307", "中", "'", "'s", "'LL", " ", "  ", "\n", "\t", "\xa0", "1", "²", ".", ",", "###", "$$", "<|", "|>", "<|endoftext|>", "_", "-", "😀", "Σ", "ς", "ing"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORD_PIECES), max_size=12).map("".join), max_size=4))
def test_word_ids_are_those_of_the_library(texts):
    library, words = word_library(), token_store.encoder(WORDS)
    ids, ends = words.block(pa.array([*texts, None], pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and ends.tolist()[:-1] == np.cumsum([len(w) for w in want]).tolist()


@lru_cache
def word_library():
    return Tokenizer.from_file(WORDS)


def test_chunks_of_streams_are_those_of_each_alone():
    streams = [np.random.default_rng(i).integers(0, 40000, n).astype(np.uint32) for i, n in enumerate((5, 3000, 128, 0, 129, 9000, 1))]
    together = token_store.chunk_ends(np.concatenate(streams), np.cumsum([len(s) for s in streams]).tolist())
    assert together == [token_store.chunk_ends(s)[0] for s in streams]


def test_chunks_recur_and_damage_is_seen(spark):
    ids = np.random.default_rng(0).integers(0, 40000, 20000).astype(np.uint32)
    ends = token_store.chunk_ends(ids)[0]
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= token_store.MAX_CHUNK and len(ends) > 10
    shifted = [e - 100 for e in token_store.chunk_ends(np.concatenate([ids[:100][::-1], ids]))[0]]
    assert len(set(ends) & set(shifted)) > len(ends) * 0.8
    assert token_store.merkle_root([b"a", b"b"]) != token_store.merkle_root([b"b", b"a"]) != token_store.merkle_root([b"ab"])
    store, manifest = token_store.store_tokens(frame(spark, [(i, LONG, "en") for i in range(6)]), WORDS)
    assert store.selectExpr("sum(size(pool))").first()[0] < store.selectExpr("sum(size(digests))").first()[0] / 3
    rebuilt = token_store.read_store(store, with_ids=True)
    assert token_store.verify_manifest(rebuilt, manifest).count() == 0 and rebuilt.select("ids").distinct().count() == 1
    wrong = rebuilt.withColumn("root", rebuilt.ids.substr(1, 4))
    assert token_store.verify_manifest(wrong, manifest).count() > 0
