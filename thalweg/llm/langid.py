"""Language identification by mixture inference (operator 2).

The n-gram model gives every word a likelihood in each language; expectation
maximisation then estimates a document's language proportions from its words,
and the set of languages is the one with the best penalised likelihood (BIC:
half the logarithm of the number of words per language beyond the first), found
by removing the weakest language as long as the criterion doesn't fall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import extended, fresh, lean, limit_arrow_rows

#: Bound of the training sample: about so many documents of each language, chosen by hash.
TRAIN_DOCS_PER_LANG = 3000
#: Hash buckets of letter trigrams and of their two leading letters.
TRI_BITS, BI_BITS = 18, 14
#: Added to each trigram count, as a share of ALPHA.
ALPHA, LETTERS = 2.0, 60.0
EM_ROUNDS = 12
#: Work on at most about this many characters at a time.
CHUNK_CHARS = 1 << 18
UNDETERMINED = "und"
_GAP = re.compile(r"[ \n]")


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK_CHARS characters, one document at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about CHUNK_CHARS characters, cut at spaces and line ends."""
    at = 0
    while at < len(text):
        found = _GAP.search(text, at + CHUNK_CHARS)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents' letters: trigram bucket, context bucket, where words
    start, and each word's document.  A context never reaches across a word's start."""
    low = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letters()[np.minimum(code, 0x10FFFF)], code, 0).astype(np.uint32)
    at = np.flatnonzero(x)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    x1 = np.concatenate(([0], x[:-1])).astype(np.uint32)
    x2 = np.where(x1 > 0, np.concatenate(([0], x1[:-1])), 0).astype(np.uint32)
    a, b, c = x[at], x1[at], x2[at]
    context = b * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA77)
    tri = (context ^ (a * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    starts = np.flatnonzero(b == 0)
    return (tri >> np.uint32(32 - TRI_BITS)).astype(np.int64), (context >> np.uint32(32 - BI_BITS)).astype(np.int64), starts, np.searchsorted(ends, at[starts], "right")


def held_out(doc_id) -> F.Column:
    """Documents that no model learns from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


class LanguageModel:
    """Per-language log-likelihoods of letters after their two predecessors."""

    def __init__(self, langs: list[str], tri: np.ndarray, bi: np.ndarray) -> None:
        self.langs = langs
        self.tri = np.log(tri + ALPHA / LETTERS).astype(np.float32)
        self.bi = np.log(bi + ALPHA).astype(np.float32)

    def word_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by language, document, how often) of words.  A long text's words come
        once each, so that it takes memory for its different words."""
        if len(texts) == 1 and len(texts[0] or "") > 2 * CHUNK_CHARS:
            scores, counts = np.zeros((0, len(self.langs))), np.zeros(0)
            for piece in _pieces(texts[0]):
                more, _, _ = self.word_scores([piece])
                scores, place = np.unique(np.concatenate((scores, more)), axis=0, return_inverse=True)
                counts = np.bincount(place.ravel(), np.concatenate((counts, np.ones(len(more)))), len(scores))
            return scores, np.zeros(len(scores), np.int64), counts
        tri, bi, starts, doc = _grams(texts)
        if not len(tri):
            return np.zeros((0, len(self.langs))), doc, np.zeros(0)
        return np.add.reduceat(self.tri[tri] - self.bi[bi], starts, axis=0, dtype=np.float64), doc, np.ones(len(doc))

    def mixtures(self, texts: list[str | None]) -> np.ndarray:
        """Proportions (documents x languages), 0 outside the chosen set; a row of
        zeros for a document without letters."""
        n, k = len(texts), len(self.langs)
        out = np.zeros((n, k))
        score, doc, often = self.word_scores(texts)
        if not len(doc):
            return out
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        ids, count, words_of = doc[first], np.diff(np.append(first, len(doc))), np.add.reduceat(often, first)
        top = score.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(score - top, -700.0))
        base = np.add.reduceat(top[:, 0] * often, first)

        def fit(like, first, count, allowed, often):
            share = allowed / allowed.sum(axis=1, keepdims=True)
            for i in range(EM_ROUNDS + 1):
                part = like * np.repeat(share, count, axis=0)
                total = part.sum(axis=1)
                if i == EM_ROUNDS:
                    break
                part *= (often / np.maximum(total, 1e-300))[:, None]
                share = np.add.reduceat(part, first, axis=0) / np.add.reduceat(often, first)[:, None]
            return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)) * often, first)

        penalty = 0.5 * np.log(np.maximum(words_of, 2.0))
        single = np.add.reduceat(score * often[:, None], first, axis=0)
        best = single.argmax(axis=1)
        share, ll = fit(like, first, count, np.ones((len(ids), k)), often)
        alone = ll + base - single.max(axis=1) <= penalty
        out[ids[alone], best[alone]] = 1.0
        # the others: take away the weakest language while that pays
        live = np.flatnonzero(~alone)
        allowed, now, value = np.ones((len(live), k)), share[live], ll[live] - penalty[live] * (k - 1)
        while len(live):
            words = np.repeat(~np.isin(np.arange(len(ids)), live), count)
            part, n_words = like[~words], count[live]
            begin = np.concatenate(([0], np.cumsum(n_words)[:-1]))
            weakest = np.where(allowed > 0, now, np.inf).argmin(axis=1)
            fewer = allowed.copy()
            fewer[np.arange(len(live)), weakest] = 0
            trial, ll2 = fit(part, begin, n_words, fewer, often[~words])
            value2 = ll2 - penalty[live] * (fewer.sum(axis=1) - 1)
            pays = value2 >= value
            out[ids[live[~pays]]] = now[~pays]
            done = pays & (fewer.sum(axis=1) == 1)
            out[ids[live[done]]] = trial[done]
            go = pays & ~done
            live, allowed, now, value = live[go], fewer[go], trial[go], value2[go]
        return out


def fit(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG) -> LanguageModel:
    """Learn from the rows of (doc_id, text, lang) that are not held out and have
    text and lang: a hash sample of about ``per_lang`` documents a language, whole
    texts.  What comes to the driver are counts per bucket, whose number doesn't
    depend on the documents."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = {r["lang"]: per_lang / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(rates)
    if not langs:
        return LanguageModel([], np.zeros((1, 0)), np.zeros((1, 0)))
    where = {x: i for i, x in enumerate(langs)}
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in rates.items() for v in kv]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches):
        tri, bi = np.zeros((1 << TRI_BITS) * len(langs)), np.zeros((1 << BI_BITS) * len(langs))
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), np.array([where[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi in _chunks(texts):
                t, b, starts, doc = _grams(texts[lo:hi])
                lang = np.repeat(of[lo:hi][doc], np.diff(np.append(starts, len(t))))
                tri += np.bincount(t * len(langs) + lang, minlength=len(tri))
                bi += np.bincount(b * len(langs) + lang, minlength=len(bi))
        for kind, table in ((0, tri), (1, bi)):
            at = np.flatnonzero(table)
            for i in range(0, len(at), 100_000):
                j = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), kind, np.int32)), pa.array(j), pa.array(table[j])], ["kind", "at", "n"])

    sample = rows.where(draw < rate).select("text", "lang")
    sums = sample.mapInArrow(count, "kind int, at long, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for kind, bits in ((0, TRI_BITS), (1, BI_BITS)):
        part = sums[sums["kind"] == kind]
        table = np.zeros((1 << bits) * len(langs))
        table[part["at"].to_numpy(np.int64)] = part["n"].to_numpy()
        tables.append(table.reshape(-1, len(langs)))
    return LanguageModel(langs, *tables)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with lang_pred, score, lang_set and
    lang_share in place of columns of these names.

    lang_pred has the largest share of the chosen set (ties: the first by code
    point), score is that share; lang_set and lang_share list the set by share.
    Null texts and those without a letter, and all texts if nothing was learnt,
    are ``und`` with score 0 and an empty set.
    """
    limit_arrow_rows(docs.sparkSession)
    new = ["lang_pred", "score", "lang_set", "lang_share"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    (given,) = fresh([*kept, *new], "given")
    frame = docs.select(*kept, F.col("text").alias(given))
    types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]

    @lean
    def predict(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for lo, hi in _chunks(texts):
                rows = []
                mix = model.mixtures(texts[lo:hi]) if model.langs else np.zeros((hi - lo, 0))
                for p in mix:
                    order = [int(j) for j in np.argsort(-p, kind="stable") if p[j] > 0]
                    rows.append((model.langs[order[0]], min(1.0, float(p[order[0]])), [model.langs[j] for j in order], [float(p[j]) for j in order]) if order else (UNDETERMINED, 0.0, [], []))
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(kept))] + made, kept + new)

    schema = extended(frame.select(*kept).schema, "lang_pred string, score double, lang_set array<string>, lang_share array<double>")
    return frame.mapInArrow(predict, schema)
