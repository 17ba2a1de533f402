"""The pipeline over a small table: each stage's decisions hold, clean documents stay, run() is the chain of stages."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from test_corpus_operators import brute_classes, brute_hits, brute_substrings

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
R = random.Random(0)
EN = ["the", "of", "and", "ing", "tion", "her", "that", "with", "from", "which", "there", "stone", "river"]
FR = ["les", "eau", "oui", "ment", "être", "dans", "que", "pour", "avec", "là", "près", "rivière", "maison"]


def text(words, n):
    return " ".join(R.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t"))
    rows = [(k, text(EN if k % 2 else FR, 80 + k), "en" if k % 2 else "fr", "s", 0) for k in range(60)]
    passage, item = text(EN, 60), text(EN, 25)
    rows += [(100, rows[5][1], "en", "s", 0), (101, rows[5][1] + " extra", "en", "s", 0), (102, "12345 !!", "en", "s", 0), (103, None, "en", "s", 0)]
    rows += [(110, text(EN, 90) + " " + passage, "en", "s", 0), (111, passage + " " + text(EN, 90), "en", "s", 0), (112, text(EN, 50) + " " + item + " " + text(EN, 40), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def brute(spark, tables, kept, placed):
    """What language ID accepts, taken through the other stages by their definitions."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect() if r.doc_id in kept["language"]}
    classes = brute_classes(sorted(text.items()))
    text = {d: t for d, t in text.items() if classes[d] == d}
    assert kept["near_copies"] == set(text)
    left = brute_substrings(sorted(text.items()))
    gone = {d for d, (words, removed, _) in left.items() if words == removed > 0}
    assert kept["repeated_passages"] == set(text) - gone
    # Words that are left, as the stage joins them; untouched texts stay as they are.
    kept_words = cut(sorted(text.items()))
    text = {d: t if not left[d][1] else " ".join(kept_words[d]) for d, t in text.items() if d not in gone}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    text = {d: t for d, t in text.items() if not brute_hits(t, items)[4]}
    assert kept["benchmark"] == set(text)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in text.items():
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, len(ids)] if len(ids) <= 1024 else [0, *range(first, len(ids), 1024), len(ids)]
        want[d] = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = {}
    for r in placed.collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {d: sorted(x) for d, x in got.items()} == want


def cut(rows, window=20):
    seen, out = set(), {}
    for d, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[d] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages_take_odd_rows(spark, tables):
    """Null and repeated doc_ids, clashing names and an empty table."""
    names = "doc_id long, text string, lang string, source string, places string, _id string, _hash string, _w_id string, kept string, content string, group string"
    more = (None,) * 8
    one, two, three = text(EN, 90), text(EN, 95), text(EN, 100)
    rows = [(1, one, "en", *more), (1, two, "en", *more), (1, two, "en", *more), (None, three, "en", *more), (None, three + " more", "en", *more), (None, None, None, *more), (2, "", "en", *more)]
    rows += [(100 + k, text(EN if k % 2 else FR, 80), "en" if k % 2 else "fr", *more) for k in range(20)]
    odd = spark.createDataFrame([r[:11] for r in rows], names)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        alone = stage(spark, odd, tables)
        assert alone.columns == odd.columns and alone.count() >= 20, name
        docs = corpus_pipeline.Stored(stage(spark, docs, tables), "test").df
        assert docs.columns == odd.columns, name
        assert stage(spark, odd.where("false"), tables).count() == 0, name
    kept = sorted((str(r.doc_id), len(r.text.split())) for r in docs.where("doc_id is null or doc_id < 100").collect())
    assert kept in ([("1", 90), ("1", 95), ("None", n)] for n in (100, 101))
    assert corpus_pipeline.packed(spark, docs, tables).where("doc_id is null").count() == 1
    assert corpus_pipeline.packed(spark, odd.where("false"), tables).count() == 0


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Stored(stage(spark, docs, tables), "test").df
        if name != "packed":
            assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "repeated_passages":
            now = {r.doc_id: r for r in docs.collect()}
    clean = set(range(60)) | {110}
    assert clean <= kept["benchmark"] and kept["language"] >= clean and not kept["language"] & {102, 103}
    assert not kept["near_copies"] & {100, 101} and {5, 111} <= kept["near_copies"]
    assert len(now[111].text.split()) == 90 and now[111].n_chars == len(now[111].text) and 112 not in kept["benchmark"]
    assert kept["packed"] == kept["benchmark"]
    brute(spark, tables, kept, docs)
    out = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, out.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
