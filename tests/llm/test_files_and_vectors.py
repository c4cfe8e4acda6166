"""Archives, URL filters, piece encoding, embeddings, and the pipeline."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import pieces, urlfilter, vectors, warc


def test_records_are_framed_and_checked():
    data = warc.record(1, "http://a/\r\nx", b"<p>" * 900) + warc.record(2, None, b"<p>" * 900, refers_to=1) + warc.record(None, "u", b"")
    got = list(warc.read_records(io.BytesIO(data), with_payload=True))
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [(1, "response", None, 2700), (2, "revisit", 1, 2700), (None, "response", None, 0)]
    assert got[0]["payload"] == b"<p>" * 900 and got[0]["payload_digest"] == got[1]["payload_digest"] == hashlib.sha1(b"<p>" * 900).hexdigest()
    plain = gzip.decompress(warc.record(3, "u", b"abcdef"))
    for bad in (plain.replace(b"abcdef", b"abcdeg"), plain.replace(b"abcdef", b"abcde"), plain + b"x"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-9])))


def test_archives_round_trip(spark):
    big = "ä<b>" * 400
    rows = [(1, "u1", big, 0), (2, "u2", big, 0), (9, None, big, 0), (4, "u4", "small", 0), (5, "u5", "small", 0), (6, "u6", None, 0), (None, "u7", big, 0), (7, "u", "z" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").repartition(3)
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 9), 7: ("response", None),
    }
    for i, _, html, _ in rows:
        assert got[i]["payload_bytes"] == len((html or "").encode()) and got[i]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
    assert warc.round_trip(pages.where("page_id = -1")).collect() == []


def test_url_rules(spark):
    urls = [
        ("https://WWW.Example.com/en/a?x", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/7#t", "m.example.com", "/en/7", "example.com/en/", "block"),
        ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("ftp://a.net/fr/x", "a.net", "/fr/x", "net/fr/", "block"),
        ("http://com", "com", "", None, "allow"),
        ("http://x.org?u=http://net/es/", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://" + "a." * 5000 + "net/es/", "a." * 5000 + "net", "/es/", "net/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate([*urls, urls[1]])], "page_id long, url string, rule string")
    got = urlfilter.judge_urls(pages, urlfilter.rule_table(spark)).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [*urls, urls[1]]
    assert urlfilter.judge_urls(pages.where("page_id < 0"), urlfilter.rule_table(spark)).collect() == []
    none = urlfilter.judge_urls(pages, urlfilter.rule_table(spark).where("host = 'x'"))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Pieces.load())


TEXTS = ["", "a", " ", "▁ ▁x", "the quick brown fox. The end!", "日本語漢字" * 30, "the" * 300, "  " * 70, "\x00\ttab\n\nline", "naïve café — ok 🙂"]


def test_ids_are_the_library_s(codec):
    """Whole, and by chunks that end anywhere, against the library that the vocabulary is for."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    r = random.Random(1)
    several = 0
    for t in [*TEXTS, "aaaa bbbb   cccc" + " " * 50 + "d", "x" * 300, *("".join(r.choice("abcde thn▁é日") for _ in range(80)) for _ in range(20))]:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        if "▁" not in t:
            assert ids == library.encode(t)
        if t:
            for size in (33, 70):
                cut = codec.chunks(t, size)
                matrices = [codec.transfer(*c) for c in cut]
                several += sum(len(m) > 1 or len(m[0]) > 1 for m in matrices)
                assert pieces.joined([codec.back(*c, v) for c, v in zip(cut, pieces.entry_weights(matrices), strict=True)]) == ids
    assert several > 100


def test_matrix_product_is_associative():
    r = random.Random(3)
    m = lambda a, b: [[r.choice([None, r.randint(-9, 9)]) for _ in range(b)] for _ in range(a)]
    for _ in range(50):
        a, b, c = m(1, 3), m(3, 2), m(2, 4)
        assert pieces.times(pieces.times(a, b), c) == pieces.times(a, pieces.times(b, c))
        assert pieces.scan([a, b, c])[2] == pieces.times(pieces.times(a, b), c)


def test_encoding_of_tables(spark, codec):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, "word " * 400, "日x" * 500, "word " * 400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("row", F.lit("clash")).repartition(2)
    got = pieces.decode(pieces.encode(docs, codec.pieces, giant=300, size=120), codec.pieces).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == (r["text"] or "") and list(r["token_ids"]) == codec.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"])
        assert (r["n_chunks"] > 1) == (len(r["text"] or "") > 300) and r["row"] == "clash"
        assert r["n_states"] >= max(0, r["n_chunks"] - 1)
    assert pieces.encode(docs.where("doc_id < 0"), codec.pieces).collect() == []


def test_near_duplicate_vectors(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 16))
    x[700:1000] = x[:300] + 0.12 * r.standard_normal((300, 16))
    x[1000:1040] = x[5]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(2000, None, ""), (2001, [0.0] * 16, ""), (2002, [1.0, None] * 8, ""), (2003, [float("nan")] * 16, ""), (2004, [1.0] * 4, ""), (2005, [1.0] * 4, ""), (2006, [], ""), (None, x[5].tolist(), "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    got = {q["vec_id"]: q for q in vectors.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    extra = links[5].astype(int) + (np.arange(len(x)) == 5)  # the row without an id is a copy of vector 5
    degree = links.sum(axis=1) + extra
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= degree).all() and found.sum() >= 0.98 * degree.sum()
    assert got[1000]["component_id"] == got[5]["component_id"] <= 5 and not got[1000]["kept"] and not got[None]["kept"]
    assert [got[i]["n_links"] for i in (2000, 2001, 2002, 2003, 2006)] == [0] * 5 and got[2005]["component_id"] == 2004
    assert all(got[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004, 2006))
    assert vectors.near_duplicates(table.where("vec_id < 0")).collect() == []


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(60)), "xx", f"s{i % 3}", 0) for i in range(40)]
    rows += [(40, rows[3][1] + " more", "xx", "s0", 0), (41, "12 34", "xx", "s0", 0), (42, None, None, None, 0), (43, rows[7][1], "xx", "s1", 0), (44, rows[8][1] + " a.b@mail.example.com", None, "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = {x["doc_id"] for x in got.collect()}
    assert ids and not ids & {40, 41, 42, 43, 44}
    assert got.where(F.size("token_ids") != F.col("n_tokens")).isEmpty()


def test_leaves_are_split_again(spark, monkeypatch):
    """Small leaves, dense ones that can't be split, and blocks: the same links."""
    r = np.random.default_rng(8)
    x = r.standard_normal((900, 12))
    x[:150] = x[0] + 0.05 * r.standard_normal((150, 12))  # nearly all links of one another
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    for name, value in (("LEAF", 32), ("MAX_DEPTH", 2), ("LARGE", 60), ("BLOCK", 50)):
        monkeypatch.setattr(vectors, name, value)
    found = {q["vec_id"]: q["n_links"] for q in vectors.near_duplicates(table).collect()}
    found = np.array([found[i] for i in range(len(x))])
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.98 * links.sum()
