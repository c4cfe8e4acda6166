"""Stages of the pipeline on rows that agree in id or text, against plain Python."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_near_duplicates_go_by_row(spark):
    r = random.Random(3)
    a, b, c, d = (text(r, 60) for _ in range(4))
    rows = [
        (None, a, "x", "s", 1), (None, a + " more", "x", "s", 2), (None, a.upper(), "x", "s", 3),  # of null ids one stays
        (5, b, "x", "s", 1), (5, c, "x", "s", 2), (3, b + " tail", "x", "s", 3),  # b goes for 3, c stays though its id is 5
        (7, d, "x", "s", 1), (7, d, "y", "t", 2), (8, d, "x", "s", 3), (None, d, "x", "s", 4),  # one row of 7 stays
        (9, "", "x", "s", 0), (9, "", "x", "s", 0), (None, None, "x", "s", None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(x["doc_id"], x["text"]) for x in got.collect()]
    assert sorted((i, t) for i, t in kept if i is not None) == sorted([(5, c), (3, b + " tail"), (7, d), (9, ""), (9, "")])
    nulls = [t for i, t in kept if i is None]
    assert len(nulls) == 2 and None in nulls and sum(t is not None and t.lower().startswith(a) for t in nulls) == 1
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id = 1000"), "").collect() == []


def test_mix_emits_the_words_it_takes(spark):
    from thalweg.llm import mixing

    r = random.Random(4)
    same, other = text(r, 7), text(r, 7)
    rows = [(None, same, "x", "a", 1)] * 5 + [(None, other, "x", "a", 1), (4, same, "x", "a", 1), (4, same, "x", "a", 1), (4, other, "x", "a", 1), (None, same, "x", None, 1)]
    rows += [(i, text(r, r.randint(0, 30)), "x", r.choice("bcd"), 1) for i in range(10, 60)] + [(60, None, "x", "b", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want: dict = {}
    for x in mixing.mix_sources(docs).collect():
        want[x["doc_id"], x["source"]] = want.get((x["doc_id"], x["source"]), 0) + x["taken"]
    got: dict = {}
    texts = {x[1] for x in rows}
    for x in corpus_pipeline.mix_sources(spark, docs, "").collect():
        assert x["text"] in texts or any(t and t.startswith(x["text"]) for t in texts)
        got[x["doc_id"], x["source"]] = got.get((x["doc_id"], x["source"]), 0) + len(WORDS.findall(x["text"]))
    assert got == {k: v for k, v in want.items() if v}
    assert corpus_pipeline.mix_sources(spark, docs.where("doc_id = 1000"), "").collect() == []


def shingles(t):
    w = WORDS.findall(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_the_whole_against_plain_python(spark, tmp_path):
    """What each stage must do, with loops: rows with ids and texts of their own."""
    import hashlib

    import sentencepiece

    from thalweg.llm import pieces, pii

    r = random.Random(9)
    rows = [(i, text(r, r.randint(3, 60)), r.choice(["x", "x", None]), r.choice(["a", "b", "c", None]), 0) for i in range(70)]
    for i in range(70, 90):  # near and exact copies
        w = rows[r.randrange(70)][1].split(" ")
        if i % 2:
            w[r.randrange(len(w))] = "other"
        rows.append((i, " ".join(w), "x", r.choice("abc"), 0))
    rows += [(90, "12 34 !", "x", "a", 0), (91, None, "x", "a", 0), (92, "", "x", "a", 0)]
    rows += [(i, text(r, 30) + f" write to Mr. Keller or user{i}@mail{i % 3}.example.com", "x", "b", 0) for i in range(93, 100)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: (t, s) for i, t, _, s, _ in rows if t and any(c.isalpha() for c in t)}
    sets = {i: shingles(t) for i, (t, _) in kept.items()}
    root = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    kept = {i: v for i, v in kept.items() if root[i] == i}
    assert len(kept) < 90
    size = {i: len(WORDS.findall(t)) for i, (t, _) in kept.items()}
    names = sorted({s for _, s in kept.values() if s is not None}) + [None] * any(s is None for _, s in kept.values())
    total = {s: sum(size[i] for i in kept if kept[i][1] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(total.values())
    while True:
        over = {s for s in free if weight[s] * rest / sum(weight[k] for k in free) >= 3 * total[s]}
        if not over:
            break
        target |= {s: 3 * total[s] for s in over}
        rest -= sum(3 * total[s] for s in over)
        free -= over
    target |= {s: weight[s] * rest // sum(weight[k] for k in free) for s in free}
    want: list[tuple[int, int]] = []
    for s in names:
        epochs, cut = divmod(target[s], total[s])
        before = 0
        for i in sorted((i for i in kept if kept[i][1] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            want += [(i, size[i])] * epochs
            if cut > before:
                want.append((i, min(size[i], cut - before)))
            before += size[i]
    assert sorted((x["doc_id"], len(WORDS.findall(x["text"]))) for x in got) == sorted(want)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    for x in got:
        was = kept[x["doc_id"]][0]
        if not pii.find(was):
            assert was.startswith(x["text"])
        assert "Keller" not in x["text"] and not re.search(r"user\d+@mail", x["text"]) and x["n_chars"] == len(x["text"])
        assert list(x["token_ids"]) == library.encode(x["text"])
