"""Language of every word by a linear-chain conditional random field, and of texts by their words.

Words are runs of letters (ASCII letters and bytes of other characters). A word's features
are its affixes, its byte n-grams with word edges, the word itself, and whether it stands
in a language's lexicon (words of the training sample that are nearly all of one
language). Weights and transitions are learned together by maximum likelihood with
forward-backward on sequences of words from the sample, in which pieces of documents
of different languages follow each other, so that switches are learned as well. A text's
words get their marginals by forward-backward over the whole text; the language with the
largest mean marginal is the text's, that mean is its score (runs that touch a digit, as in
keys and numbers, weigh ``DIGIT_WEIGHT``).

Training sees a bounded sample of every language that is labelled: ``SAMPLE_DOCS`` documents of it (with many languages
fewer, ``SAMPLE_TOTAL`` in all, but ``LEAST_DOCS`` of each at least), those with the smallest hash, and
of each a window of ``SAMPLE_CHARS`` characters. Its model is a few MB for a few dozen languages, however large the corpus.

Whether a text is of a learned language at all is told by its letter pairs (``fits``), by a floor that each language's own
sample sets, whatever the number of languages.

Work per text is vectorised: features once per distinct word of a batch, forward-backward in
segments whose transfer matrices are chained, so long texts cost no more per word.

Defined results: null text, or one without a letter, is ``und`` with score 0; so is every text
when nothing is labelled; equal means go to the language that sorts first; repeated rows
are predicted alike; keys may be null; an empty table gives no rows; other columns are not inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import python_ready
from .textkernel import byte_view, parts, span_hashes

SAMPLE_DOCS = 100
SAMPLE_TOTAL = 6400
LEAST_DOCS = 8
SAMPLE_CHARS = 16_384
TABLE_BITS = 15
SEGMENT = 32
ROUNDS = 30
UNKNOWN = "und"
DIGIT_WEIGHT = 0.05
MIN_PAIRS = 40  # letter pairs of a sample's text that tells of its language's floor

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # rows by feature, columns by language; row 0 is nothing
    transitions: np.ndarray  # log potentials
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # language of each
    pairs: np.ndarray  # rows by language: log probability of a byte behind another inside a word, 256 by 256
    floors: np.ndarray  # mean log probability below which a long text is hardly of the language


def _lowered(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 65) & (buf < 91)] += 32
    if len(buf) > 1:  # Latin-1 capitals
        capital = np.zeros(len(buf), dtype=bool)
        capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[capital] += 32
    return out


def letter_runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, index of each text's first word and one more)."""
    buf, bounds = byte_view(col)
    buf = _lowered(buf)
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _LETTER[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return buf, start, end, np.searchsorted(start, bounds, side="left")


def word_weights(buf: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word counts once, a run that touches a digit of its text (a piece of a key or number) hardly at all."""
    digit = np.zeros(len(buf) + 2, dtype=bool)
    digit[1:-1] = (buf >= 48) & (buf < 58)
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    return np.where((digit[start] & ~edge[start]) | (digit[end + 1] & ~edge[end]), DIGIT_WEIGHT, 1.0)


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Rows of a feature kind in the weight table; kinds have a table of 2^TABLE_BITS rows each."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64) + 1 + (kind << TABLE_BITS)


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(affix and word rows, n-gram rows of all words in a row, where each word's n-grams begin)."""
    affixes = [_slot(hashes, 2)]
    for n in (3, 5):
        affixes.append(_slot(span_hashes(buf, start, np.minimum(end, start + n)) ^ np.uint64(n), 1))
        affixes.append(_slot(span_hashes(buf, np.maximum(start, end - n), end) ^ np.uint64(16 + n), 1))
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    at = np.arange(int(size.sum())) + np.repeat(start - 1 - first, size)
    flat = buf[np.clip(at, 0, max(0, len(buf) - 1))].astype(np.uint64) if len(buf) else np.zeros(0, np.uint64)
    flat[first] = 1
    flat[first + size - 1] = 2
    two = np.zeros((len(flat), 2), dtype=np.int64)
    if len(flat) > 2:
        pair = flat[:-1] * np.uint64(257) + flat[1:]
        two[:-1, 0] = _slot(pair + np.uint64(1 << 20), 0)
        two[:-2, 1] = _slot(pair[:-1] * np.uint64(257) + flat[2:] + np.uint64(1 << 40), 0)
        ends = first + size - 1
        two[ends] = 0
        two[ends - 1, 1] = 0
    return np.stack(affixes, axis=1), two, first


def _lexicon_scores(model: Model, hashes: np.ndarray) -> np.ndarray:
    n = len(model.langs)
    out = np.zeros((len(hashes), n), dtype=np.float32)
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        known = np.flatnonzero(model.lexicon[at] == hashes)
        out[known] = model.weights[(3 << TABLE_BITS) + 1 + model.member[at[known]]]
    return out


def word_scores(model: Model, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros((0, len(model.langs)), np.float32)
    return _feature_scores(model, *word_features(buf, start, end, hashes), hashes)


def _feature_scores(model: Model, affixes: np.ndarray, grams: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    w = model.weights
    total = w[affixes[:, 0]]
    for k in range(1, affixes.shape[1]):
        total = total + w[affixes[:, k]]
    total += np.add.reduceat(w[grams[:, 0]] + w[grams[:, 1]], first, axis=0)
    return total + _lexicon_scores(model, hashes)


def letter_pairs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair of neighbouring bytes, its word) of all words, with their edges as bytes 1 and 2."""
    size = end - start + 1
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = start[word] + place
    before = np.where(place == 0, 1, buf[at - 1]) if len(word) else np.zeros(0, np.int64)
    after = np.where(place == size[word] - 1, 2, buf[np.minimum(at, len(buf) - 1)]) if len(word) else np.zeros(0, np.int64)
    return before.astype(np.int64) * 256 + after, word


def pair_model(codes: np.ndarray, text_of: np.ndarray, gold_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of letter pairs by language, and each language's floor: as far below the median of its sample's
    texts as four times the distance of their lower tenth."""
    counts = np.bincount(gold_of[text_of] * 65536 + codes, minlength=k * 65536).reshape(k, 256, 256) + 0.1
    pairs = np.log(counts / counts.sum(2, keepdims=True)).reshape(k, 65536).astype(np.float32)
    n = np.bincount(text_of, minlength=len(gold_of))
    mean = np.bincount(text_of, pairs[gold_of[text_of], codes], minlength=len(gold_of)) / np.maximum(n, 1)
    floors = np.full(k, -np.inf)
    for lang in range(k):
        own = mean[(gold_of == lang) & (n >= MIN_PAIRS)]
        if len(own):
            middle, low = np.quantile(own, [0.5, 0.1])
            floors[lang] = middle - 4 * max(middle - low, 0.05)
    return pairs, floors


def fits(model: Model, buf: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, lang: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """By how much the letter pairs of each text's words are likelier, on the mean, than the floors of the words' languages;
    a short text, whose mean is uncertain, gets more room. Below 0: hardly of any learned language."""
    codes, word = letter_pairs(buf, start, end)
    some = weight[word] == 1  # not pieces of keys and numbers
    codes, word = codes[some], word[some]
    n = np.bincount(doc[word], minlength=n_docs)
    over = model.pairs[lang[word], codes] - np.maximum(model.floors[lang[word]], -1e6)
    return np.where(n > 0, np.bincount(doc[word], over, minlength=n_docs) / np.maximum(n, 1) + 4 / np.sqrt(np.maximum(n, 1)), 0.0)


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """P(label | whole sequence) of every word; sequence d is rows first[d] to first[d + 1]."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    own = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    length = np.diff(first)
    per = -(-length // segment)  # segments of each sequence
    seg_seq = np.repeat(np.arange(len(length)), per)
    nth = np.arange(len(seg_seq)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][seg_seq] + nth * segment
    size = np.minimum(segment, first[1:][seg_seq] - begin)
    g = len(begin)
    by_size = np.argsort(-size, kind="stable")  # so that the segments still running are a prefix
    begin, size, nth, seg_seq = begin[by_size], size[by_size], nth[by_size], seg_seq[by_size]
    running = [int(np.searchsorted(-size, -t, side="left")) for t in range(segment)]
    where = np.empty(g, np.int64)
    where[by_size] = np.arange(g)
    head = np.cumsum(per) - per

    # transfer matrix of each segment
    move = np.broadcast_to(np.eye(k, dtype=np.float32), (g, k, k)).copy()
    for t in range(segment):
        r = running[t]
        if not r:
            break
        e = own[begin[:r] + t][:, None, :]
        after = (move[:r].reshape(-1, k) @ step).reshape(r, k, k) if t else np.where((nth[:r] > 0)[:, None, None], step[None], np.eye(k, dtype=np.float32)[None])
        move[:r] = after * e
        move[:r] /= move[:r].sum(axis=(1, 2), keepdims=True)

    # chained over each sequence's segments
    into = np.full((g, k), 1.0 / k, dtype=np.float32)
    back = np.full((g, k), 1.0 / k, dtype=np.float32)
    order = np.argsort(-per, kind="stable")
    most = int(per.max())
    alive = [int(np.searchsorted(-per[order], -s, side="left")) for s in range(most + 1)]
    for s in range(1, most):
        q = order[: alive[s]]
        at, was = where[head[q] + s], where[head[q] + s - 1]
        v = np.einsum("gi,gij->gj", into[was], move[was])
        into[at] = v / v.sum(1, keepdims=True)
    for s in range(most - 2, -1, -1):
        q = order[: alive[s + 1]]
        at, after = where[head[q] + s], where[head[q] + s + 1]
        v = np.einsum("gij,gj->gi", move[after], back[after])
        back[at] = v / v.sum(1, keepdims=True)

    # vectors inside the segments
    forward = np.empty((n, k), dtype=np.float32)
    a = into.copy()
    for t in range(segment):
        r = running[t]
        if not r:
            break
        a[:r] = (a[:r] @ step if t else np.where((nth[:r] > 0)[:, None], a[:r] @ step, a[:r])) * own[begin[:r] + t]
        a[:r] /= a[:r].sum(1, keepdims=True)
        forward[begin[:r] + t] = a[:r]
    out = np.empty((n, k), dtype=np.float32)
    b = back.copy()
    for t in range(segment - 1, -1, -1):
        r = running[t]
        if not r:
            continue
        here = begin[:r] + t
        both = forward[here] * b[:r]
        out[here] = both / both.sum(1, keepdims=True)
        b[:r] = (own[here] * b[:r]) @ step.T
        b[:r] /= b[:r].sum(1, keepdims=True)
    return out


def train(texts: list[str], labels: list[str], rounds: int = ROUNDS, rate: float = 0.5, seed: int = 11) -> Model | None:
    """Learn from labelled texts; pieces of 8 to 64 words of all texts are put in a random order to learn switches."""
    langs = sorted(set(labels))
    if not langs:
        return None
    k = len(langs)
    buf, start, end, first = letter_runs(pa.array(texts, pa.string()))
    if not len(start):
        return None
    gold_of = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    pieces = []
    for d in range(len(texts)):
        at = int(first[d])
        while at < first[d + 1]:
            to = min(int(first[d + 1]), at + int(rng.integers(8, 65)))
            pieces.append((at, to, gold_of[d]))
            at = to
    # mostly with the piece that follows in the text, now and then another one
    order = np.arange(len(pieces))
    moved = np.flatnonzero(rng.random(len(pieces)) < 0.3)
    order[moved] = order[rng.permutation(moved)]
    words = np.concatenate([np.arange(pieces[i][0], pieces[i][1]) for i in order])
    gold = np.concatenate([np.full(pieces[i][1] - pieces[i][0], pieces[i][2]) for i in order])
    n = len(words)
    cuts = np.append(np.arange(0, n, 256), n)

    hashes = span_hashes(buf, start, end)
    distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    which = which[words]
    counts = np.zeros((len(distinct), k))
    np.add.at(counts, (which, gold), 1)
    sums = counts.sum(1)
    sure = np.flatnonzero((sums >= 5) & (counts.max(1) >= 0.9 * sums))
    member = counts[sure].argmax(1)
    affixes, grams, at = word_features(buf, start[one], end[one], distinct)
    codes, of_word = letter_pairs(buf, start, end)
    learned = pair_model(codes, (np.searchsorted(first, np.arange(len(start)), side="right") - 1)[of_word], gold_of, k)
    rows = (3 << TABLE_BITS) + 1 + k
    model = Model(langs, np.zeros((rows, k), np.float32), np.zeros((k, k), np.float32), distinct[sure], member, *learned)
    squares, squares_t = np.full((rows, k), 1e-6), np.full((k, k), 1e-6)
    word_of_gram = np.repeat(np.arange(len(distinct)), np.diff(np.append(at, len(grams))))
    same = np.zeros((k, k))
    inside = np.ones(n, dtype=bool)
    inside[cuts[:-1]] = False
    np.add.at(same, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)

    def add(gradient: np.ndarray, rows_: np.ndarray, values: np.ndarray) -> None:
        for c in range(k):
            gradient[:, c] += np.bincount(rows_, weights=values[:, c], minlength=len(gradient))

    for _ in range(rounds):
        scores = _feature_scores(model, affixes, grams, at, distinct)[which]
        p = marginals(scores, cuts, model.transitions)
        error = -p.astype(np.float64)
        error[np.arange(n), gold] += 1
        by_word = np.stack([np.bincount(which, weights=error[:, c], minlength=len(distinct)) for c in range(k)], axis=1)
        gradient = np.zeros((rows, k))
        for c in range(affixes.shape[1]):
            add(gradient, affixes[:, c], by_word)
        for c in range(2):
            add(gradient, grams[:, c], by_word[word_of_gram])
        add(gradient, (3 << TABLE_BITS) + 1 + member, by_word[sure])
        gradient[0] = 0
        gradient = gradient / n - 1e-6 * model.weights
        # expected transitions: pair marginals from the words' scores on both sides
        pairs = _expected_pairs(scores, p, cuts, model.transitions, inside)
        turn = (same - pairs) / n
        squares += gradient**2
        squares_t += turn**2
        model.weights[:] += (rate * gradient / np.sqrt(squares)).astype(np.float32)
        model.transitions[:] += (rate * turn / np.sqrt(squares_t)).astype(np.float32)
    return model


def _expected_pairs(scores: np.ndarray, p: np.ndarray, cuts: np.ndarray, transitions: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Expected transition counts: P(i at t - 1, j at t), from filtered forward and marginal vectors."""
    k = scores.shape[1]
    step = np.exp(transitions - transitions.max())
    own = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    n_seq, out = len(cuts) - 1, np.zeros((k, k))
    size = np.diff(cuts)
    a = np.full((n_seq, k), 1.0 / k)
    for t in range(int(size.max())):
        q = np.flatnonzero(size > t)
        at = cuts[:-1][q] + t
        if t:
            joint = a[q][:, :, None] * step[None]  # filtered P(i), weight of i to j
            reached = joint.sum(1)
            out += np.einsum("gij,gj->ij", joint, p[at] / reached)
            a[q] = reached * own[at]
        else:
            a[q] = own[at]
        a[q] /= a[q].sum(1, keepdims=True)
    return out


def sample_of(labelled: DataFrame, text: str, lang: str, key: str) -> tuple[list[str], list[str]]:
    """The bounded training sample, on the driver: of every language the same number of documents, those with the
    smallest hashes, and of a long document a window at a place that its hash names."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).filter("text is not null and lang is not null")
    slim = rows.select("lang", F.xxhash64("text", "key").alias("h"))
    n_langs = slim.agg(F.count_distinct("lang")).first()[0]
    each = max(LEAST_DOCS, min(SAMPLE_DOCS, SAMPLE_TOTAL // max(1, n_langs)))
    drawn = Window.partitionBy("lang").orderBy("h")
    chosen = slim.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= each).select("h", "lang").distinct()
    # at most SAMPLE_TOTAL hashes, or LEAST_DOCS a language
    got = rows.withColumn("h", F.xxhash64("text", "key")).join(F.broadcast(chosen), ["h", "lang"]).dropDuplicates(["h", "lang"])
    spare = F.char_length("text") - SAMPLE_CHARS
    window = F.when(spare <= 0, F.col("text")).otherwise(F.substring("text", F.pmod(F.col("h"), F.greatest(spare, F.lit(1))).cast("int") + 1, F.lit(SAMPLE_CHARS)))
    got = got.select("lang", "h", window.alias("text")).orderBy("lang", "h").select("lang", "text").toArrow()
    return got.column("text").to_pylist(), got.column("lang").to_pylist()


def predict_languages(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", spans: bool = True, with_text: bool = False, with_fit: bool = False) -> DataFrame:
    """key, lang_pred, score[, spans][, fit][, text] of every row; spans are runs of words of one language
    (start and end as UTF-8 byte offsets); fit is below 0 where the letters are hardly those of a learned language (see ``fits``)."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = T.StructType([rows.schema["key"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
    if spans:
        schema = schema.add("spans", span)
    if with_fit:
        schema = schema.add("fit", T.DoubleType())
    if with_text:
        schema = schema.add(rows.schema["text"])
    shared = spark.sparkContext.broadcast(model)  # 3 * 2^TABLE_BITS rows of a weight per language
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, col in parts(batch.column(1), 1 << 20):
                n = len(col)
                letters = batch.column(2).slice(at, n).to_numpy(zero_copy_only=False).astype(bool)
                name, score, runs, fit = np.full(n, UNKNOWN, dtype=object), np.zeros(n), [[] for _ in range(n)], np.zeros(n)
                if m is not None:
                    buf, start, end, first = letter_runs(col)
                    hashes = span_hashes(buf, start, end)
                    distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
                    p = marginals(word_scores(m, buf, start[one], end[one], distinct)[which], first, m.transitions)
                    has = np.flatnonzero(np.diff(first) > 0)
                    if len(has):
                        weight = word_weights(buf, byte_view(col)[1], start, end)
                        mean = np.add.reduceat(p * weight[:, None], first[:-1][has], axis=0, dtype=np.float64) / np.add.reduceat(weight, first[:-1][has])[:, None]
                        best = mean.argmax(1)
                        ok = letters[has]
                        name[has[ok]] = np.array(m.langs, dtype=object)[best[ok]]
                        score[has[ok]] = np.clip(mean[np.arange(len(has)), best][ok], 0, 1)
                        word = p.argmax(1) if spans or with_fit else None
                        if with_fit:
                            fit = fits(m, buf, start, end, weight, word, np.repeat(np.arange(n), np.diff(first)), n)
                        if spans:
                            _, bounds = byte_view(col)
                            for d in has[ok].tolist():
                                a, b = int(first[d]), int(first[d + 1])
                                edges = [a, *(np.flatnonzero(np.diff(word[a:b])) + a + 1).tolist(), b]
                                runs[d] = [{"start": int(start[x] - bounds[d]), "end": int(end[y - 1] - bounds[d]), "lang": m.langs[word[x]]} for x, y in zip(edges, edges[1:])]
                columns = [batch.column(0).slice(at, n), pa.array(name, pa.string()), pa.array(score)]
                columns += ([pa.array(runs, arrow_span)] if spans else []) + ([pa.array(fit)] if with_fit else []) + ([col] if with_text else [])
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(label, schema).withColumnRenamed("key", key)


def language_model(docs: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model learned from the sample of the rows that ``may_learn`` selects."""
    return train(*sample_of(docs.filter(may_learn), text, lang, key))
