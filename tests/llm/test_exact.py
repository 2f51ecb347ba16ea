"""Operators that have an exact answer, against brute force or a round trip, with odd rows."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, components, embedding_dedup, line_dedup, ngram_join, packing, quality_rules, registry
from tessera.llm import textblocks as tb

from ..conftest import DATA
from . import brute

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
LINE = "this line has more than eight words so that it counts as evidence here"
OTHER = "another line with many words that several documents of the table share too"
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (7, "ONE Two"), (8, LONG), (9, LONG + " tail of it"), (10, "a b c d e f g h i j"), (10, "a b c d e f g h i j"),
    (11, "a b c d e f g h i k"), (12, "$%^ ### |||| <> &&"), (13, f"{LINE}\n{LINE}\nrest"), (14, f"{OTHER}\nmiddle\n{LINE}"), (15, f"{LINE}\n{OTHER}\nend"), (16, "İstanbul 日本語 🎉 \x00 'll we've"), (17, "<|endoftext|> x <|startoftext|>"),
]


def table(spark, rows=ODD):
    return spark.createDataFrame([(a, b, "score?", 7, 1.5) for a, b in rows], "doc_id long, text string, score string, n_words int, version double")


def base_rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_library(spark, path):
    lib = tokenizers.Tokenizer.from_file(path)
    rows = [*base_rows(spark), *ODD]
    got = bpe.encode(table(spark, rows), path)
    assert "score" in got.columns
    expected = sorted((d, lib.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == expected
    back = bpe.decode(got.select("doc_id", "ids"), path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((d, lib.decode(i, skip_special_tokens=False)) for d, i in expected)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab's tTSlevrd \n\t1²éÉ!<|>́Σ’ 日"), max_size=60))
def test_bpe_any_text(text):
    for path in (WORD, BYTE):
        ids, _ = bpe.vocabulary(path).encode_block([text])
        assert ids.tolist() == _library(path).encode(text, add_special_tokens=False).ids


_known = {}


def _library(path):
    if path not in _known:
        _known[path] = tokenizers.Tokenizer.from_file(path)
    return _known[path]


def test_op1_digests(spark):
    lib = _library(WORD)
    for r in bpe.round_trip_digests(table(spark), WORD).collect():
        texts = [t or "" for d, t in ODD if d == r.doc_id]
        ids = lib.encode(texts[0], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(table(spark, []), WORD).count() == 0
    assert bpe.encode(table(spark, []), WORD).count() == 0


def test_packing(spark):
    lib = _library(BYTE)
    rows = [*base_rows(spark), *ODD]
    got = packing.pack(table(spark, rows), BYTE, group_rows=120).toPandas()
    pieces = sorted((d, zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), s, len(ids[s : s + 1024]), len(ids)) for d, t in rows for ids in [lib.encode(t or "", add_special_tokens=False).ids + [0]] for s in range(0, len(ids), 1024))
    assert sorted(zip(got.doc_id, got.ids_crc32, got.start, got.length, got.doc_tokens)) == pieces
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 1024
    assert packing.pack(table(spark, []), BYTE).count() == 0
    whole = packing.sequences(table(spark, base_rows(spark)), packing.pack(table(spark, base_rows(spark)), BYTE), BYTE)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in base_rows(spark))


def test_packing_groups_are_bounded(spark, monkeypatch):
    """Equal rows are spread over groups, and full windows need none."""
    sizes = []
    rows = [*[(1, "the same words in each row")] * 300, *[(k, " ".join(f"w{i}" for i in range(3000))) for k in range(2, 5)]]
    docs = table(spark, rows)
    got = packing.pack(docs, BYTE, group_rows=50).toPandas()
    sizes = got[got.length < 1024].groupby(got.sequence_id // (1 << 40)).size()
    assert len(sizes) >= 6 and sizes.max() < 100
    assert (got[got.length == 1024].offset == 0).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got[got.length == 1024].sequence_id.is_unique and (got.groupby("doc_id").length.sum() > 0).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=12), st.integers(0, 40))
def test_fill_is_optimal(lengths, room):
    counts = {x: lengths.count(x) for x in lengths}
    used = packing.fill(counts, room)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    assert all(used[k] <= counts[k] for k in used)
    assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_assign_fits(lengths):
    x = np.array(lengths, np.int64)
    sequence, offset = packing.assign(x, 16)
    taken = {(s, o + i) for s, o, n in zip(sequence, offset, x) for i in range(n)}
    assert len(taken) == x.sum() and all(p < 16 for _, p in taken)


def test_ngram_join(spark):
    rows = [*base_rows(spark), *ODD]
    expected = sorted(brute.similar(rows))
    for block in (2000, 2):
        got = ngram_join.similar(table(spark, rows), block=block, range_rows=5000)
        assert sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in got.collect()) == expected
    assert ngram_join.similar(table(spark, [])).count() == 0


def test_ngram_join_of_a_large_group(spark):
    """Near copies of one text, all hot: none is lost when groups are split into blocks."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 6), replace=False):
            w[k] = f"n{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.similar(table(spark, rows), block=20, range_rows=300)
    assert sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in got.collect()) == sorted(brute.similar(rows))


def test_one_of_each(spark):
    rows = [*ODD, (None, "null id text here"), (None, "other null id text")]
    docs = table(spark, rows)
    left = ngram_join.one_of_each(docs, ngram_join.similar(docs))
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in left.collect())
    assert ids == [-1, -1, *sorted({c for *_, c in brute.similar(ODD)})] and left.columns == docs.columns


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(edges.where("a > 1000")).count() == 0


def test_quality_rules(spark):
    rows = [*base_rows(spark), *ODD]
    got = quality_rules.annotate(table(spark, rows))
    assert "score" in got.columns and got.columns.count("n_words") == 1
    found = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert found == sorted((d, *brute.base_counts(t)) for d, t in rows)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.annotate(table(spark, [])).count() == 0


def test_cascade_order_does_not_change_verdicts(spark):
    data, at = tb.buffers(pa.array([t for _, t in base_rows(spark)], pa.large_string()))
    block = quality_rules.Block(data, at, quality_rules.base_counts(data, at))
    names = list(quality_rules.RULES)
    together = ~quality_rules.base_failed(block.counts)
    for test in quality_rules.RULES.values():
        together &= ~test(block)
    assert (quality_rules.verdicts(block, names) == together).all() and (quality_rules.verdicts(block, names[::-1]) == together).all()
    order = quality_rules.plan(table(spark, base_rows(spark)), sample=10**6)
    assert sorted(n for n, *_ in order) == sorted(names) and quality_rules.plan(table(spark, []))
    value = [share / max(cost, 1e-12) for _, cost, share in order]
    assert value == sorted(value, reverse=True)


PASSAGE = "\n".join(f"short line {i} of a passage" for i in range(12))
LINES = [f"{LINE} number {i}" for i in range(30)]


def dedup_rows():
    """Rows (id, text) with blocks of all kinds; the ids leave room for a corpus before them."""
    first = f"Short head\n\n{LINE} a\nshort middle\n\n{LINE} b\nend"
    made = [
        first, first, f"own head\n{LINE} a\nshort middle\nown\n{LINE} b\nend\nown tail", f"{OTHER}\nx\n{LINE}\ny",
        LINES[5], LINES[2], "\n".join(LINES[:8]), "\n".join(["intro", *LINES[:8]]), "\n".join(LINES), "\n".join(LINES[i] for i in (5, 6, 7, 1, 2, 20, 21, 22, 23)),
        f"mine\n{PASSAGE}\nmore of mine", f"{PASSAGE}\n{PASSAGE}\nother", PASSAGE, PASSAGE, "a few\nshort\nlines only", "a few\nshort\nlines only", f"  {LINES[9]}  \n\n\n{LINES[10]}",
        f"{LINES[9]}\nput between\n{LINES[10]}\r\n",
    ]
    return [(2600 + i, t) for i, t in enumerate(made)]


@pytest.mark.parametrize("rare", [1000, 2])
def test_line_dedup(spark, rare):
    rows = [*base_rows(spark), *[(d + 2500, t) for d, t in ODD], *dedup_rows(), (2602, "another text of an id that is not alone, with words enough"), (None, LINES[3]), (None, f"{LINES[3]}\nx")]
    docs = spark.createDataFrame([(a, b, 3, "x", 1) for a, b in rows], "doc_id long, text string, n_lines int, deleted string, version int")
    got = line_dedup.dedup(docs, rare=rare)
    assert got.columns == ["doc_id", "text", "version", "n_lines", "n_deleted", "deleted"]
    version = {(r.doc_id, r.text): r.v for r in docs.select("doc_id", "text", F.xxhash64("text").alias("v")).collect()}
    expected = brute.line_dedup([(d, version[d, t], t) for d, t in rows], 8, rare)
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.n_lines, r.deleted) for r in got.collect())
    assert found == sorted((-1 if d is None else d, text, n, gone) for d, text, n, gone in expected)
    assert line_dedup.dedup(table(spark, [])).count() == 0


def test_line_dedup_by_cases(spark):
    """Blocks go whole, short and blank lines in them too, whoever owns their lines; an exact copy ends empty."""
    rows = dedup_rows()
    got = {r.doc_id - 2600: r.text for r in line_dedup.dedup(table(spark, rows)).collect()}
    text = [t for _, t in rows]
    assert got[0] == text[0] and got[1] == "" and got[2] == "own head\nown\nown tail" and got[3] == text[3]
    assert got[6] == "\n".join(x for i, x in enumerate(LINES[:8]) if i not in (2, 5)) and got[7] == "intro" and got[9] == ""
    assert got[11] == "other" and got[12] == got[13] == "" and got[14] == got[15] == text[15] and got[10] == text[10]
    assert got[16] == "" and got[17] == "put between\n"
    base = base_rows(spark)
    seen, copies = set(), set()
    for d, t in sorted(base):
        if t in seen and len(brute.words(t)) >= 8:
            copies.add(d)
        seen.add(t)
    got = registry.op2_line_dedup(spark, DATA).collect()
    assert copies and all(r.text == "" and r.n_deleted == r.n_lines for r in got if r.doc_id in copies)


def test_line_dedup_of_a_hot_owner(spark):
    """Thousands of documents with one passage: its owner's pairs are split, and each document loses it."""
    rows = [(i, f"own text {i} with a number of words that nobody has but {i}\n{LINE}\nshort end") for i in range(2500)]
    got = line_dedup.dedup(table(spark, rows)).collect()
    assert sum(r.n_deleted for r in got) == 2 * 2499 and all((r.deleted == [1, 2]) == (r.doc_id > 0) for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=14), st.lists(st.integers(1, 6), max_size=14))
def test_patience(a, b):
    found = line_dedup.patience(a, b)
    assert found == brute.patience(a, b, 0, len(a), 0, len(b))
    assert all(a[i] == b[j] for i, j in found) and all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=25))
def test_increasing(values):
    x = np.array(values, np.int64)
    at = line_dedup.increasing(values)
    assert len(at) == brute.longest_increasing(values) and (np.diff(x[at]) > 0).all() and (np.diff(at) > 0).all()


def vectors(spark, rows):
    return spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, key string")


def test_embedding_dedup(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [None] + [1.0] * 63), (9005, [float("nan")] * 64), (9006, [float("inf")] + [1.0] * 63), (9007, rows[0][1]), (9007, rows[0][1]), (9008, rows[1][1][:30])]
    expected = brute.near_vectors(rows)
    for block in (4096, 16):
        got = embedding_dedup.near_duplicates(vectors(spark, rows), block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((rows[i][0], n, c, c == rows[i][0]) for i, (n, c) in enumerate(expected))
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("rows,pairs", [(20_000, 100), (20_000, 700)])
def test_embedding_recall_of_planted_pairs(spark, tmp_path, rows, pairs):
    """Pairs of vectors near the least cosine, found whatever their share of the table."""
    rng = np.random.default_rng(rows + pairs)
    x = embedding_dedup.unit(rng.normal(size=(rows, 64)).astype(np.float32))
    y = embedding_dedup.at_cosine(x[:pairs], 0.905, seed=9)
    both = np.concatenate([x, y]).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(both) + 1) * 64, pa.int32()), pa.array(both.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(len(both)), "embedding": lists}), tmp_path / "v.parquet", row_group_size=20_000)
    measured = {}
    got = embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet")), measured=measured)
    got = {r.vec_id: r.n_links for r in got.where("n_links > 0").collect()}
    # Random vectors of 64 components are never so near by chance: each planted pair is one link for either end.
    expected = dict.fromkeys([*range(pairs), *range(rows, rows + pairs)], 1)
    assert all(n <= expected.get(i, 0) for i, n in got.items())
    assert sum(got.values()) >= 0.99 * len(expected) and measured["recall"] >= 0.995


def test_embedding_search_grows_to_all_cells(spark):
    """Where the first visits miss the target, the search goes on; at all cells it is exact.  Near, unequal vectors, equal ones and rows without an id."""
    rng = np.random.default_rng(5)
    x = embedding_dedup.unit(rng.normal(size=(400, 6)))
    y = embedding_dedup.at_cosine(x[:150], 0.93, seed=3)
    rows = [(i if i % 7 else None, v.tolist()) for i, v in enumerate(np.concatenate([x, y, x[:20]]), 1)]
    expected = brute.near_vectors([(-i if a is None else a, v) for i, (a, v) in enumerate(rows, 1)])
    got = embedding_dedup.near_duplicates(vectors(spark, rows), target_recall=1.0, per_cell=4).collect()
    assert sorted(r.n_links for r in got) == sorted(n for n, _ in expected)
    named = {a: n for (a, _), (n, _) in zip(rows, expected) if a is not None}
    assert {r.vec_id: r.n_links for r in got if r.vec_id is not None} == named
    assert all(r.kept is not None and (not r.kept or r.component_id == r.vec_id) for r in got)
    classes = spark.createDataFrame([(v,) for _, v in rows], "vector array<double>")
    z = embedding_dedup.unit(np.array([v for _, v in rows]))
    plan = embedding_dedup.calibrate(classes, z, embedding_dedup.Grid.fit(z, 12), 0.9, 1.0, 6, first_visits=4)
    assert plan["visits"] > 4 and plan["recall"] >= 1 - 1e-9


def test_multi_sequence_is_in_order():
    rng = np.random.default_rng(0)
    x = embedding_dedup.unit(rng.normal(size=(50, 8)))
    grid = embedding_dedup.Grid.fit(x, 6)
    a, b = grid._distances(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    assert (np.take_along_axis(total, grid.visits(x, 9), 1) == np.sort(total, axis=1)[:, :9]).all()


def test_hashes_of_very_long_texts(monkeypatch):
    text = np.frombuffer(("ab cde f " * 4000).encode(), np.uint8)
    at = np.array([0, len(text)])
    s, e, _ = tb.words(text, at)
    whole = tb.hashes(text, s, e)
    monkeypatch.setattr(tb, "SEGMENT", 1000)
    assert (tb.hashes(text, s, e) == whole).all()
    assert len(set(whole.tolist())) == 3


def test_queries_are_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_bpe_cache_is_bounded():
    """A cache of a few pieces, dropped again and again, changes no id, holds no more than its bound and a block, and keeps what recurs."""
    import public_tokenizers

    v, free = (bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")) for _ in range(2))
    for k in range(40):
        block = [f"always the same words {k * 1000 + i}q{i * 7919 % 1000}" for i in range(100)]
        ids, cut = v.encode_block(block, most_cached=500)
        more, at = free.encode_block(block)
        assert (ids == more).all() and (cut == at).all() and v.entries <= 500 + 600
    assert free.entries > 1100
    v.forget(10)
    assert 0 < v.entries <= 10 and (v.encode_block(["always the same"])[0] == free.encode_block(["always the same"])[0]).all()
