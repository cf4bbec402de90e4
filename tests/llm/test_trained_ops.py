"""Toxicity, language model, WARC and the pipeline."""

import collections
import hashlib
import math
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from emberline.llm import lm, toxicity, warc
from emberline.llm.scratch import new_path

from .util import SCHEMA, awkward, fold, frame, words


def prose(draw, n, bad=()):
    pool = ["tion", "the", "er", "ing", "and", "re", "on", "st", "en", "ha", "le", "ou"]
    out = ["".join(draw.choice(pool) for _ in range(draw.randrange(1, 4))) for _ in range(n)]
    for w in bad:
        out.insert(draw.randrange(len(out)), w)
    return " ".join(out)


def labelled(n=400, seed=1):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        bad = [draw.choice(["vexolgarb", "zumpfkwix", "quazjub"]) + draw.choice(["", "s", "ly"]) for _ in range(4)] if toxic else []
        rows.append((k, prose(draw, draw.randrange(30, 200), bad), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k, *_ in rows if fold(k) == 0]
    assert len(held) > 50 and sum((got[k] >= 0.5) == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s < 0.5}


def test_toxicity_learns_from_the_whole_of_long_texts(spark):
    rows, labels = labelled(160, seed=4)
    draw = random.Random(9)
    lead = [prose(draw, 3200) for _ in range(8)]
    docs = frame(spark, [(k, draw.choice(lead)[:14_000] + " " + t, *rest) for k, t, *rest in rows])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    assert b"vexol" in model.toxic or b"zumpf" in model.toxic or b"quazj" in model.toxic
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k, *_ in rows if fold(k) == 0]
    assert sum((got[k] >= 0.5) == (k % 4 == 0) for k in held) >= 0.9 * len(held)
    assert min(len(t) for t in lead) > 10_000 and toxicity.train(docs, marks, most_bytes=1).toxic is not None


def test_toxicity_of_awkward_texts(spark):
    rows, labels = labelled(80)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = awkward()
    got = toxicity.score(frame(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score(frame(spark, odd), none).collect())


def brute(rows, order=2):
    """Counts, totals and base scores as the contract states them."""
    texts = [(i, [*words(t), None]) for i, t, *_ in rows]
    learned = [t for i, t in texts if i is not None and fold(i) != 1]
    c = collections.Counter(w for t in learned for w in t)
    n, v = sum(c.values()), len(c)
    base = [(i, i is not None and fold(i) == 1, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in texts]
    return base, learned, c, n, v


def test_lm_counts_and_mixture(spark):
    draw = random.Random(8)
    rows = awkward() + [(1000 + k, prose(draw, 80), "en", "s", 0) for k in range(60)]
    got = lm.score(frame(spark, rows), part_bytes=2000).collect()
    base, learned, c, n, v = brute(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[5], 6))
    mine = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    want = sorted(base, key=key)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] <= 1e-9
    held = [(r.score, r.base_score) for r in got if r.held_out and r.n_tokens > 20 and r.n_tokens < 1000]
    assert sum(s for s, _ in held) > sum(b for _, b in held)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_score_is_the_mixture(spark, order):
    """The scores follow from brute-force n-gram counts and the fitted weights."""
    rows = [(k, "a b a c" if k % 2 else "b a b d", "en", "s", 0) for k in range(40)]
    seen = {}
    fitted = lm.mixture

    def spy(*args, **kwargs):
        seen["w"] = fitted(*args, **kwargs)
        return seen["w"]

    lm.mixture = spy
    try:
        got = {r.doc_id: r.score for r in lm.score(frame(spark, rows), order=order).collect()}
    finally:
        lm.mixture = fitted
    _, learned, c, n, v = brute(rows)
    grams, before = collections.Counter(), collections.Counter()
    for t in learned:
        padded = ["^"] * (order - 1) + t
        for i in range(len(t)):
            for k in range(1, order):
                context = tuple(padded[i + order - 1 - k : i + order - 1])
                before[context] += 1
                grams[(*context, t[i])] += 1
    for k, text, *_ in rows:
        t, total = [*words(text), None], 0.0
        padded = ["^"] * (order - 1) + t
        for i, w in enumerate(t):
            contexts = [tuple(padded[i + order - 1 - j : i + order - 1]) for j in range(1, order)]
            cls = 0
            for j, h in enumerate(contexts):
                cls = j * lm.LEVELS + int(math.log2(before[h])) + 1 if before[h] else cls
            mix = seen["w"][cls]
            p = mix[0] / (v + 1) + mix[1] * c[w] / n + sum(mix[j + 2] * grams[(*h, w)] / before[h] for j, h in enumerate(contexts) if before[h])
            total += math.log10(p)
        assert got[k] == pytest.approx(total, abs=1e-9)


def test_mixture_learns_from_set_aside_counts():
    estimates = 2.0 ** np.array([[-1, -10], [-10, -1]])
    weights = lm.mixture(np.array([3, 3]), estimates, np.array([900, 100]), 2, 1e-9)
    assert weights[3][1] > 0.8 and weights.sum(axis=1) == pytest.approx(1)
    assert (lm.mixture(np.zeros(0), np.zeros((0, 2)), np.zeros(0), 2, 0.1) >= 0).all()


def test_lm_of_an_empty_and_an_unlearned_table(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [k for k in range(50) if fold(k) == 1][:2]
    got = lm.score(frame(spark, [(k, "a b", "en", "s", 0) for k in only])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 2


def pages():
    big, small = "<p>" + "é" * 100, "x" * 99
    rows = [(5, "http://a/\r\nb", big), (3, None, big), (9, "u", big), (3, "twice", big), (7, "s", small), (8, "s", small), (1, "n", None), (2, "", ""), (None, "z", big), (4, "crlf", "a\r\n\r\nb" * 50), (6, "long", "<html>" * 100_000)]
    return rows + [(100 + k, f"p{k}", f"<html>{k}</html>" * 12) for k in range(30)]


def test_warc_round_trip(spark):
    got = warc.round_trip(spark.createDataFrame(pages(), "page_id long, url string, html string"))
    least = {}
    for i, _, h in pages():
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(least.get(h, i), i)
    want = collections.Counter()
    for i, _, h in pages():
        body = (h or "").encode()
        first = least.get(h) if least.get(h) != i else None
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if first is not None else "response", first)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    assert {bytes(r.payload) for r in got.filter("page_id = 6").collect()} == {b"<html>" * 100_000}
    narrow = got.drop("payload")
    assert warc.checked(narrow).count() == got.count()
    for bad in (narrow.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", 1).otherwise(F.col("payload_bytes"))), narrow.filter("NOT (record_type = 'response' AND page_id = 3)")):
        with pytest.raises(Exception, match="no response that fits"):
            warc.checked(bad).collect()
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_closed_at_a_size(spark):
    path = new_path(spark, "rolled")
    warc.write_archives(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1), path, archive_bytes=300)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").count()
    assert files > 3 and warc.read_archives(spark, path).count() == len(pages())


def test_archive_layout(spark, tmp_path):
    path = new_path(spark, "layout")
    warc.write_archives(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1), path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    files = [f for f in files if f]
    assert files
    for data in files:
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICT_MAGIC
        words_ = data[8 : 8 + size]
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words_))
        for at, record in warc.frames(data):
            assert unpack.decompress(data[at : warc.frame_end(memoryview(data), at)]) == record
            assert warc.parse(record)[0]["warc-type"] in ("response", "revisit")


def test_damaged_archives_are_refused():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "1970-01-01T00:00:00Z")
    headers, block = warc.parse(good)
    assert warc.payload_of(headers, block)[0] == b"payload"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good[:-1], good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"payload", b"paylord"), good.replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(ValueError):
            warc.payload_of(*warc.parse(bad))
    frame_ = zstandard.ZstdCompressor().compress(good)
    assert [r for _, r in warc.frames(frame_ + warc.EMPTY_SKIP.encode())] == [good]
    for data in (frame_[:-3], frame_ + b"junkjunkjunk", b"\x50\x2a\x4d\x18\xff\x00\x00\x00"):
        with pytest.raises(ValueError):
            list(warc.frames(data))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(200)
    draw = random.Random(3)
    item = prose(draw, 30)
    leak = (900, prose(draw, 60) + "\n" + item, "en", "s", 0)
    copy = (901, rows[1][1], "en", "s", 0)
    rows += [leak, copy, (902, "same line of some length\n" + prose(draw, 60), "en", "s", 0), (903, "Same line of some length \n" + prose(draw, 60), "en", "s", 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        sizes.append(out.count())
        docs = out
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 900 not in left and left[902].startswith("same line") and not left[903].lower().startswith("same line")
    assert sizes[0] < len(rows) and sizes[1] == sizes[0] and sizes[3] < sizes[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == left.keys() and all(len(r.ids) == 4 * r.n_tokens for r in final)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and F is not None
