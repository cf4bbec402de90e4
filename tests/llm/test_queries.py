"""Every ``opN_`` query on small tables, against its SQL or the contract restated, and the pipeline against its parts."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece

from emberline.llm import queries

from .test_text_ops import base_spans, fingerprint
from .test_trained_ops import brute, pages
from .util import SCHEMA, VOCABULARY, awkward, fold, frame

LIB = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def rows():
    texts = [t for _, t, *_ in awkward(30)]
    return [(3 * k + 1, t, "en" if k % 3 else None, "s", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    item = next(t for _, t, *_ in rows if t and 300 < len(t) < 2000)
    unique = list({p[0]: p for p in pages() if p[0] is not None}.values())
    frame(spark, rows).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(unique, "page_id long, url string, html string").coalesce(2).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, item[:200]), (2, "one two"), (3, None), (4, "no such words anywhere at all")], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, *_ in rows[::2]], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    plain = lambda f: sorted((tuple(None if pd.isna(v) else v for v in row) for row in f[sorted(f.columns)].itertuples(index=False)), key=repr)
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want) and len(got)


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def test_op1(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op1_toxicity")}
    assert got.keys() == {i for i, *_ in rows}
    for i, r in got.items():
        assert r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op2(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op2_simhash_neardup")}
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    group = {p: p for p in prints.values()}
    for _ in range(4):
        for p in group:
            for q in group:
                if (p ^ q).bit_count() <= 2:
                    group[p] = group[q] = min(group[p], group[q])
    least = {}
    for i, p in prints.items():
        least[group[p]] = min(least.get(group[p], i), i)
    assert {i: r.component_id for i, r in got.items()} == {i: least[group[p]] for i, p in prints.items()}


def test_op4(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op4_lm_interpolation")}
    for i, held, n_tokens, n_known, total, base in brute(rows)[0]:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score <= 1e-9


def test_op6_and_op10(spark, folder, rows):
    counts = {r.doc_id: r for r in run(spark, folder, "op6_token_counts")}
    coded = {r.doc_id: r for r in run(spark, folder, "op10_sentencepiece")}
    for i, text, *_ in rows:
        ids = LIB.encode(text or "", add_bos=True, add_eos=True)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((text or "").encode()), len(ids) - 2, len(ids) - 2 > 4096)
        assert coded[i].n_tokens == len(ids) and coded[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_op8(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op8_fertility_rules")}
    for i, text, *_ in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(covered), failed) and not (failed and r.kept)


def test_op9(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op9_secret_scan")}
    for i, text, *_ in rows:
        kinds = ("assign", "access", "hex")
        spans = base_spans(text or "")
        line = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(got[i].spans.split(","))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == m for _, k, _ in spans) for m in range(3))


def test_folds_are_crc32_of_the_id_as_text():
    assert fold(17) == zlib.crc32(b"17") % 5 and SCHEMA.startswith("doc_id long")


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
