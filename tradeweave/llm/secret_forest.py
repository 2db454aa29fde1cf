"""Secrets in texts: candidates, and a random forest that tells them from false findings.

Candidates are found on the bytes of whole texts: every value behind a credential's name and
``=`` or ``:`` (quoted, then blanks may be inside, or not; from ``MIN_ASSIGNED``); the body of a private key (of up
to 20 000 characters, as large as such keys are) and the password in an address; every known key format between word edges; of the rest, runs of at least ``MIN_LENGTH`` characters
of keys (letters, digits, ``+ / _ = -``, cut behind each ``name=``) that hold a digit or change
case again and again, and shorter ones that are quoted right behind an assignment. Features of a candidate:
length, character classes and transitions (how often the class changes, entropy, mean
log probability of its letter pairs), dictionary coverage, path (slashes, dots, a path
or address around it, words such as "test" in the document's path) and neighbouring words.

The forest is fitted on labelled findings: ``shipped_findings``, a fixed set that comes with the
operator, and those of the table, at most ``MAX_LABELLED`` distinct feature vectors with the
smallest hashes (a vector's weight grows with the logarithm of its copies). So there is
one way to a verdict at every size. A caller may bring a table of findings; else ``rule_label`` labels the clear cases among the
candidates (a known key format or a key assigned to a credential's name; plain numbers,
words, paths, placeholders), and the forest decides all. Letter pairs are counted over all
words of all documents; the dictionary holds every word that stands by itself (no digit or
key character beside it) in two documents and one more for each ``1 / MIN_SHARE`` documents, kept as
64-bit hashes: at most (distinct words a document) / ``MIN_SHARE`` of them, by one rule at every size.

Time and memory are linear in a text's length and its candidates: a text is held once, however many
it has.

Defined results: null and empty texts have no candidates; repeated rows give repeated
findings; keys may be null; an empty table gives no rows; extra columns are not carried by
findings and are kept by ``redact``.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import python_ready, staged, text_or_empty
from .textkernel import byte_view, parts, span_hashes

MIN_LENGTH = 16
MIN_ASSIGNED = 8
MAX_LABELLED = 20_000
MIN_SHARE = 4e-5
HELD_WORDS = 500_000
CONTEXT = 48
TREES, DEPTH, LEAF = 40, 8, 3
THRESHOLD = 0.5

#: Public formats of keys (fixed values).
FORMATS = {
    "aws_access_key": rb"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": rb"gh[pousr]_[0-9A-Za-z]{36,}",
    "slack_token": rb"xox[abprs]-[0-9A-Za-z-]{10,}",
    "google_api_key": rb"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": rb"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "json_web_token": rb"eyJ[0-9A-Za-z_-]{8,}(?:\.[0-9A-Za-z_-]+){0,2}",
    "gitlab_token": rb"gl(?:pat|rt|dt|ptt|soat)-[0-9A-Za-z_-]{20,}",
    "package_token": rb"npm_[0-9A-Za-z]{36}|pypi-AgE[0-9A-Za-z_-]{40,}",
    "sendgrid_key": rb"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}",
}
#: The text of a private key between its marks, and what stands for user and password in an address.
_PEM = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----\s{0,4}([0-9A-Za-z+/=\s:,.-]{0,20000}?)\s{0,4}-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY")
_USER_INFO = re.compile(rb"[a-z][a-z0-9+.-]{1,30}://[^\s:/@\"'<>]{0,100}:([^\s:/@\"'<>]{3,200})@", re.I)
_FORMATS = {k: re.compile(rb"(?<![0-9A-Za-z])" + v + rb"={0,2}(?![0-9A-Za-z])") for k, v in FORMATS.items()}
_ANY_FORMAT = re.compile(rb"(?<![0-9A-Za-z])(?:" + b"|".join(FORMATS.values()) + rb")={0,2}(?![0-9A-Za-z])")
_CREDENTIAL = re.compile(rb"(?:api[_-]?key|access[_-]?key|auth|credential|passw(?:or)?d|pwd|private[_-]?key|secret|token)", re.I)
#: A credential's name, what assigns, and the value: quoted, or up to the next blank.
_VALUE = re.compile(
    rb"(?:api[_-]?key|access[_-]?key|auth(?!or(?!iz))|credential|passw(?:or)?d|pwd|private[_-]?key|secret|token)[0-9a-z_.-]{0,40}"
    rb"[\"'`]?\]?\s{0,2}(?:=>|:=|={1,3}|:)[ \t]{0,8}(?:bearer |basic )?(?:\"(?P<double>[^\n\r\"]+)\"|'(?P<single>[^\n\r']+)'|(?P<bare>[^\s\"'`]+))", re.I)
_URL_VALUE = re.compile(rb"[?&;][0-9A-Za-z_.\[\]-]{0,60}\Z")
_ASSIGNED = re.compile(rb"(?:=|:|=>)\s{0,8}(?:bearer |basic )?[\"'`]?\Z", re.I)
_HARMLESS = re.compile(rb"(?:test|example|sample|fixture|mock|dummy|doc)", re.I)
#: A value that stands for one: by how it begins or ends, not by what a random value may hold inside.
_PLACEHOLDER = re.compile(rb"(?:x{6,}|0{8,}|\A(?:0?1234567|abc(?:def|123)|example|changeme|your[_-]|\$[({]?[a-z_]|%[a-z_]+%|<[a-z]|\{\{|(?:my)?(?:pass(?:word)?|secret)\Z)|example[0-9]{0,3}\Z)", re.I)
_BEFORE_PASSWORD = re.compile(rb"[a-z][a-z0-9+.-]{1,30}://[^\s:/@\"'<>]{0,100}:\Z", re.I)
_BEFORE_PEM = re.compile(rb"PRIVATE KEY(?: BLOCK)?-----\s{0,4}\Z")
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")

_KEY = np.zeros(256, dtype=bool)
_KEY[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BESIDE = np.zeros(256, dtype=bool)
_BESIDE[[*range(48, 58), *b"+/_="]] = True
_CLASS = np.full(256, 3, dtype=np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2

FEATURES = [
    "length", "share_digit", "share_upper", "share_lower", "share_symbol", "class_changes", "entropy", "pair_log_probability",
    "dictionary_coverage", "hex_only", "distinct", "slashes", "in_path", "path_harmless", "quoted", "assigned", "credential_before",
    "credential_near", "word_before_known", "word_after_known", "words_around", "known_format", "placeholder",
]


class Language(NamedTuple):
    pairs: np.ndarray  # log probability of the next letter, 27 by 27 (26: anything else)
    dictionary: np.ndarray  # sorted word hashes

    def knows(self, words: list[bytes]) -> np.ndarray:
        """Which of the words are in the dictionary?"""
        if not words or not len(self.dictionary):
            return np.zeros(len(words), dtype=bool)
        ends = np.cumsum([len(w) for w in words])
        hashes = span_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)
        return self.dictionary[np.minimum(np.searchsorted(self.dictionary, hashes), len(self.dictionary) - 1)] == hashes

    def covered(self, raw: bytes) -> int:
        """Bytes that the longest dictionary words, taken from the left of each run of letters, cover."""
        buf, best = np.frombuffer(raw, np.uint8), np.zeros(len(raw), dtype=np.int64)
        left = np.zeros(len(raw), dtype=np.int64)  # letters from here to the end of the run
        for m in _WORD.finditer(raw):
            left[m.start() : m.end()] = np.arange(m.end() - m.start(), 0, -1)
        for width in range(3, min(24, int(left.max(initial=0))) + 1):
            at = np.flatnonzero(left >= width)
            if not len(self.dictionary):
                break
            hashes = span_hashes(buf, at, at + width)
            best[at[self.dictionary[np.minimum(np.searchsorted(self.dictionary, hashes), len(self.dictionary) - 1)] == hashes]] = width
        at = total = 0
        for start in np.flatnonzero(best).tolist():
            if start >= at:
                at = start + int(best[start])
                total += int(best[start])
        return total


def count_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words, the number of texts that hold each by itself, letter pairs of all words 27 by 27)."""
    buf, bounds = byte_view(col)
    low = np.where((buf >= 65) & (buf < 91), buf + 32, buf).astype(np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _LETTER[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    letters = low.astype(np.int64) - 97
    letters[(letters < 0) | (letters > 25)] = 26
    both = np.flatnonzero(inside[1:-2] & inside[2:-1] & ~edge[1:-1]) if len(buf) > 1 else np.zeros(0, np.int64)
    pairs = np.bincount(letters[both] * 27 + letters[both + 1], minlength=27 * 27)
    beside = np.zeros(len(buf) + 2, dtype=bool)
    beside[1:-1] = _BESIDE[buf]
    alone = (end - start >= 3) & ~(beside[start] & ~edge[start]) & ~(beside[end + 1] & ~edge[end])
    start, end = start[alone], end[alone]
    hashes = span_hashes(low, start, end)
    text_of = np.searchsorted(bounds, start, side="right") - 1
    order = np.lexsort((text_of, hashes))
    hashes, text_of = hashes[order], text_of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
    words, times = np.unique(hashes[new], return_counts=True)
    return words, times, pairs


def certain_spans(text: bytes) -> list[tuple[int, int]]:
    """Private keys and passwords in addresses; outside of these, values behind a credential's name; outside of all, known
    formats: in order and apart from each other."""
    spans = sorted(m.span(1) for pattern, mark in ((_PEM, b"PRIVATE KEY"), (_USER_INFO, b"://")) if mark in text for m in pattern.finditer(text) if m.end(1) > m.start(1))
    spans = [x for k, x in enumerate(spans) if not k or x[0] >= spans[k - 1][1]]
    sure = np.array(spans, dtype=np.int64).reshape(-1, 2)
    for m in _VALUE.finditer(text):
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "bare":
            if _URL_VALUE.search(text, max(0, m.start() - 61), m.start()):
                b = a + len(re.split(rb"[&#;]", text[a:b], maxsplit=1)[0])
            b = a + len(text[a:b].rstrip(b",;.)]}>"))
        k = int(np.searchsorted(sure[:, 0], b))
        if b - a >= MIN_ASSIGNED and (not k or sure[k - 1, 1] <= a):
            spans.append((a, b))
    spans.sort()
    values = np.array(spans, dtype=np.int64).reshape(-1, 2)
    for m in _ANY_FORMAT.finditer(text):
        k = int(np.searchsorted(values[:, 0], m.end()))
        if not k or values[k - 1, 1] <= m.start():
            spans.append(m.span())
    return sorted(spans)


def candidate_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all candidates of the texts."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _KEY[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    # name=value: a sign that a key goes on behind ends the name (others pad a key)
    assigns = np.flatnonzero((buf[:-1] == 0x3D) & _KEY[buf[1:]] & (buf[1:] != 0x3D) & ~edge[1:-1]) if len(buf) > 1 else np.zeros(0, np.int64)
    inside[assigns + 1] = False
    sure = [(int(x) + a, int(x) + b) for x, y in zip(bounds[:-1], bounds[1:]) for a, b in certain_spans(buf[x:y].tobytes())]
    for a, b in sure:
        inside[a + 1 : b + 1] = True
        edge[[a, b]] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    long = end - start >= MIN_ASSIGNED
    start, end = start[long], end[long]
    kind = _CLASS[buf]
    digits = np.concatenate([[0], np.cumsum(kind == 0)])
    turns = np.zeros(len(buf) + 1, dtype=np.int64)
    if len(buf) > 1:
        turns[2:] = np.cumsum((kind[:-1] == 2) & (kind[1:] == 1))
    has_digit = digits[end] > digits[start]
    mixed = (end - start >= 20) & (turns[end] - turns[np.minimum(start + 1, end)] >= 3)
    quoted = np.zeros(len(start), dtype=bool)
    some = start > 0
    quoted[some] = np.isin(buf[start[some] - 1], np.frombuffer(b"\"'", np.uint8))
    certain = np.isin(start, np.array([a for a, _ in sure], dtype=np.int64))
    wanted = certain | ((end - start >= MIN_LENGTH) & (has_digit | mixed)) | (quoted & (has_digit | mixed))
    # short quoted ones only behind an assignment
    for i in np.flatnonzero(wanted & ~certain & (end - start < MIN_LENGTH)).tolist():
        wanted[i] = bool(_ASSIGNED.search(buf[max(0, start[i] - 6) : start[i]].tobytes()))
    return start[wanted], end[wanted]


def features_of(text: bytes, a: int, b: int, path: bytes, language: Language) -> tuple[list[float], str]:
    """(features, kind) of the candidate text[a:b]."""
    c = text[a:b]
    raw = np.frombuffer(c, np.uint8)
    kinds = _CLASS[raw]
    n = len(c)
    counts = np.bincount(raw, minlength=256)
    p = counts[counts > 0] / n
    letters = np.frombuffer(c.lower(), np.uint8).astype(np.int64) - 97
    letters[(letters < 0) | (letters > 25)] = 26
    covered = language.covered(c.lower())
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    previous, following = _WORD.findall(before.lower()), _WORD.findall(after.lower())
    known_before, known_after = (bool(x) and bool(language.knows(x)[0]) for x in (previous[-1:], following[:1]))
    line = before.rpartition(b"\n")[2]
    around = (before.rsplit(None, 1)[-1] if before and not before[-1:].isspace() else b"") + c + (after.split(None, 1)[0] if after and not after[:1].isspace() else b"")
    known = next((k for k, r in _FORMATS.items() if r.search(c)), "")
    if after[:1] == b"@" and _BEFORE_PASSWORD.search(text, max(0, a - 140), a):
        known = "user_info"
    elif b"PRIVATE KEY" in before and _BEFORE_PEM.search(before):
        known = "private_key"
    quoted = before[-1:] in (b'"', b"'")
    assigned = bool(_ASSIGNED.search(before))
    values = [
        n, (kinds == 0).mean(), (kinds == 1).mean(), (kinds == 2).mean(), (kinds == 3).mean(), (kinds[1:] != kinds[:-1]).mean() if n > 1 else 0,
        float(-(p * np.log2(p)).sum()), float(language.pairs[letters[:-1], letters[1:]].mean()) if n > 1 else 0, covered / n,
        bool(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", c)), (counts > 0).sum() / n, c.count(b"/"), bool(re.search(rb"://|www\.|@|\.(?:com|org|net|html?)\b", around)) or around.startswith(b"/"),
        bool(_HARMLESS.search(path)), quoted, assigned, bool(_CREDENTIAL.search(line if assigned else line[-24:])), bool(_CREDENTIAL.search(before) or _CREDENTIAL.search(after)),
        known_before, known_after, len(previous) + len(following), bool(known), bool(_PLACEHOLDER.search(c)),
    ]
    return [float(v) for v in values], known or ("hex" if values[9] else "mixed")


def rule_label(f: list[float]) -> int | None:
    """1, 0 or None of the clear cases: what a reviewer would tell at first sight."""
    v = dict(zip(FEATURES, f))
    if v["placeholder"]:
        return 0
    if v["known_format"] or (v["assigned"] and v["credential_before"] and v["share_digit"] > 0.1 and v["share_digit"] < 0.95 and v["entropy"] >= 3):
        return 1
    if v["share_digit"] >= 0.99 or v["dictionary_coverage"] >= 0.6 or v["in_path"] or v["slashes"] >= 3:
        return 0
    return None


class Forest(NamedTuple):
    feature: np.ndarray  # trees by nodes; -1 at a leaf
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                go = f >= 0
                right = x[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(go, 2 * node + 1 + right, node)
            total += value[node]
        return total / len(self.feature)


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES, seed: int = 5) -> Forest:
    """Trees on bootstrap samples (rows drawn by weight), the best of a random third of the features at each node (Gini)."""
    rng = np.random.default_rng(seed)
    nodes, width = 2 ** (DEPTH + 1) - 1, x.shape[1]
    forest = Forest(np.full((trees, nodes), -1, dtype=np.int64), np.zeros((trees, nodes)), np.full((trees, nodes), y.mean()))
    share = None if weight is None else weight / weight.sum()
    for t in range(trees):
        stack = [(0, 0, rng.choice(len(x), len(x), p=share))]
        while stack:
            node, depth, rows = stack.pop()
            yy = y[rows]
            forest.value[t, node] = yy.mean()
            if depth == DEPTH or len(rows) < 2 * LEAF or yy.min() == yy.max():
                continue
            best = (1e-9, -1, 0.0)
            parent = yy.mean() * (1 - yy.mean())
            for f in rng.choice(width, size=max(3, width // 3), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows[order], f], np.cumsum(yy[order])
                n = np.arange(1, len(v))
                ok = np.flatnonzero((v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF))
                if not len(ok):
                    continue
                left, right = ones[ok] / (ok + 1), (ones[-1] - ones[ok]) / (len(v) - ok - 1)
                gain = parent - ((ok + 1) * left * (1 - left) + (len(v) - ok - 1) * right * (1 - right)) / len(v)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    low, high = float(v[ok[k]]), float(v[ok[k] + 1])
                    best = (float(gain[k]), int(f), (low + high) / 2 if (low + high) / 2 < high else low)
            if best[1] < 0:
                continue
            forest.feature[t, node], forest.cut[t, node] = best[1], best[2]
            right = x[rows, best[1]] > best[2]
            stack += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return forest


def language_of(docs: DataFrame, text: str = "text") -> Language:
    """Letter pairs and dictionary of all documents: counted in each task, added up by word."""
    python_ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, texts = np.zeros(27 * 27, dtype=np.int64), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(kind: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["kind", "item", "n"])

        for batch in batches:
            for _, col in parts(batch.column(0)):
                words, times, more = count_words(col)
                pairs += more
                texts += len(col)
                held.append((words, times))
                if sum(len(w) for w, _ in held) > HELD_WORDS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_WORDS // 2:
                        yield rows("word", *held.pop())
        if held:
            yield rows("word", *merged())
        yield rows("pair", np.arange(27 * 27), pairs)
        yield rows("texts", np.zeros(1, np.int64), np.array([texts]))

    counted = docs.select(text_or_empty(text).alias("text")).mapInArrow(count, "kind string, item long, n long")
    # a word of one text is never kept
    total = staged(counted.groupBy("kind", "item").agg(F.sum("n").alias("n")).filter("kind <> 'word' OR n >= 2"), "words")
    pairs, texts = np.ones(27 * 27), 0
    for r in total.filter("kind <> 'word'").collect():  # 730 rows
        if r["kind"] == "pair":
            pairs[r["item"]] += r["n"]
        else:
            texts = r["n"]
    pairs = pairs.reshape(27, 27)
    common = total.filter((F.col("kind") == "word") & (F.col("n") >= 2 + int(texts * MIN_SHARE))).select("item").toArrow()
    return Language(np.log(pairs / pairs.sum(1, keepdims=True)), np.sort(common.column(0).to_numpy().astype(np.int64).view(np.uint64)))


def secret_candidates(docs: DataFrame, language: Language, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """key, start, end (UTF-8 bytes), kind, crc32 (of the candidate), features, label (of the rule) of every candidate."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"))
    schema = T.StructType([rows.schema["key"], *[T.StructField(n, t) for n, t in (
        ("start", T.LongType()), ("end", T.LongType()), ("kind", T.StringType()), ("crc32", T.LongType()), ("features", T.ArrayType(T.DoubleType())), ("label", T.IntegerType()))]])
    shared = spark.sparkContext.broadcast(language)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(2)
            for at, col in parts(batch.column(1)):
                row, out = [], []
                for i, text_, a, b in _each(col):
                    f, kind = features_of(text_, a, b, paths[at + i].as_py().encode(), shared.value)
                    row.append(at + i)
                    out.append((a, b, kind, zlib.crc32(text_[a:b]), f, rule_label(f)))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array([x[k] for x in out], t) for k, t in enumerate(types)]], names=schema.fieldNames())

    return rows.mapInArrow(find, schema)


def _each(col: pa.Array) -> Iterator[tuple[int, bytes, int, int]]:
    """(row, its text, start, end) of every candidate of a column."""
    buf, bounds = byte_view(col)
    start, end = candidate_spans(buf, bounds)
    row = np.searchsorted(bounds, start, side="right") - 1
    at, text, first = -1, b"", 0
    for i, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
        if i != at:  # one copy of a text, however many candidates it has
            at, first = i, int(bounds[i])
            text = buf[first : bounds[i + 1]].tobytes()
        yield i, text, a - first, b - first


def _shipped_texts(seed: int = 71) -> Iterator[tuple[str, str, str, int]]:
    """(what stands before, value, what stands behind, label), the same in every run; no value is a real key."""
    rng = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def of(characters: str, *lengths: int) -> str:
        return "".join(rng.choice(characters) for _ in range(rng.choice(lengths)))

    def uuid() -> str:
        return "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12))

    known = [lambda: "AKIA" + of(alnum[:26] + alnum[52:], 16), lambda: "ghp_" + of(alnum, 36), lambda: "xoxb-" + of(alnum, 24, 40), lambda: "AIza" + of(alnum, 35),
             lambda: "sk_live_" + of(alnum, 24), lambda: f"eyJ{of(alnum, 24)}.{of(alnum, 30, 60)}.{of(alnum, 43)}"]
    keys = [lambda: of(hexes, 32, 40, 64), lambda: of(alnum, 20, 32, 40), lambda: of(alnum + "+/", 40, 43) + "=", lambda: of(alnum, 6, 9) + of("@!#$%.*", 1, 2) + of(alnum, 4, 6), uuid]
    assigned = [('token = "', '" is set here.'), ("export API_KEY=", "\nexport LEVEL=2"), ("db:\n  password: ", "\n  host: db"), ('{"client_secret": "', '", "id": 7}'),
                ("https://api.site.org/v1?access_token=", "&page=2"), ("AWS_SECRET_ACCESS_KEY=", "\n"), ("Authorization: Bearer ", "\n"), ("the password = '", "' was changed")]
    loose = [("we saw ", " in the log."), ("", "\n"), ("value: ", ", then more"), ("use (", ") now"), ("A=", "\n")]
    ids = [lambda: of(hexes, 40), lambda: of(hexes, 7, 32, 64), uuid, lambda: of("0123456789", 16, 19, 24), lambda: of(alnum[:26] + "0123456789", 16, 20), lambda: of(alnum, 22)]
    named = [("commit ", " fixes the build."), ("request id ", " failed"), ("see https://site.org/", "/page for more"), ("id: ", "\n"), ("order ", " was sent on Monday"),
             ("sha256:", "\n"), ("revision = ", "\n"), ('"etag": "', '",'), ("", " is the number of the file"), ("the ", " is listed below."), ("/data/files/", "/part.html")]
    words = ["chapter_12_of_the_book", "HTTP2RequestHandlerFactory", "version-2024-10-long-release", "table_3_results_by_year", "section/14/paragraph/2/line", "Utf8StringBuilderTest"]
    empty = ["changeme123", "xxxxxxxxxxxxxxxx", "your_token_here", "${SECRET_TOKEN}", "<password-here>", "00000000000000000000", "1234567890123456"]
    for before, after in assigned + loose:
        for make in known:
            yield from ((before, make(), after, 1) for _ in range(3))
    for before, after in assigned:
        for make in keys:
            yield from ((before, make(), after, 1) for _ in range(6))
        for value in empty:
            yield before, value, after, 0
        for value in ("information", "required-field", "documentation"):
            yield before, value, after, 0
    for scheme in ("postgres://admin:", "amqp://svc-user:", "https://deploy:"):
        for make in keys[1:4]:
            yield from ((scheme, make(), "@db.site.org/main", 1) for _ in range(3))
        for value in ("password", "changeme", "${DB_PASS}", "xxxxxxxx"):
            yield scheme, value, "@db.site.org/main", 0
    for name in ("RSA ", "", "EC "):
        yield from ((f"-----BEGIN {name}PRIVATE KEY-----\n", "\n".join(of(alnum + "+/", 64) for _ in range(6)), f"\n-----END {name}PRIVATE KEY-----", 1) for _ in range(3))
    for before, after in named + loose[:4]:
        for make in ids:
            yield from ((before, make(), after, 0) for _ in range(4))
        for value in words:
            yield before, value, after, 0


def shipped_findings(language: Language, seed: int = 71) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the findings that come with the operator; another ``seed`` gives others of their kind, to test on."""
    x, y = [], []
    for before, value, after, label in _shipped_texts(seed):
        text = (before + value + after).encode()
        a, b = len(before), len(before) + len(value)
        x.append(features_of(text, a, b, b"", language)[0])
        y.append(float(label))
    return np.array(x), np.array(y)


def learn_forest(labelled: DataFrame, language: Language, features: str = "features", label: str = "label") -> Forest:
    """From the shipped findings and a table of labelled ones."""
    rows = labelled.filter(F.col(label).isNotNull()).groupBy(F.col(features).alias("f")).agg(F.avg(label).alias("y"), F.count("*").alias("n"))
    rows = rows.orderBy(F.xxhash64("f", F.lit(9)), "f").limit(MAX_LABELLED).collect()  # bounded: MAX_LABELLED
    x, y = shipped_findings(language)
    if rows:
        x, y = np.concatenate([x, np.array([r["f"] for r in rows])]), np.concatenate([y, [r["y"] for r in rows]])
    weight = np.concatenate([np.ones(len(x) - len(rows)), 1 + np.log2([r["n"] for r in rows])])
    return fit_forest(x, y, weight)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, start, end, kind, crc32, probability, is_secret of every candidate."""
    language = language_of(docs, text)
    candidates = staged(secret_candidates(docs, language, key, text, path), "candidates")
    forest = learn_forest(candidates if labelled is None else labelled, language)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*candidates.select("key", "start", "end", "kind", "crc32").schema.fields, T.StructField("probability", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(5).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(shared.value.predict(x))], names=schema.fieldNames())

    scored = candidates.select("key", "start", "end", "kind", "crc32", "features").mapInArrow(score, schema)
    return scored.withColumn("is_secret", F.col("probability") >= threshold).withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", path: str | None = "source", labelled: DataFrame | None = None, threshold: float = THRESHOLD, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret of the text replaced by ``mark``; other columns as they are."""
    spark = docs.sparkSession
    language = language_of(docs, text)
    if labelled is None:
        labelled = staged(secret_candidates(docs.withColumn("_key", F.lit(0)), language, "_key", text, path).select("features", "label"), "candidates")
    shared = spark.sparkContext.broadcast((language, learn_forest(labelled, language)))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("rest") if len(docs.columns) > 1 else F.struct(F.lit(0).alias("none")).alias("rest"), F.col(text).alias("text"), (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language_, forest = shared.value
        for batch in batches:
            texts, paths = batch.column(1), batch.column(2)
            for at, col in parts(texts):
                found: dict[int, list] = {}
                for i, text_, a, b in _each(col):
                    f, _ = features_of(text_, a, b, paths[at + i].as_py().encode(), language_)
                    found.setdefault(i, []).append((text_, a, b, f))
                if found:
                    flat = [x for group in found.values() for x in group]
                    p = iter(forest.predict(np.array([x[3] for x in flat])).tolist())
                    values = col.to_pylist()
                    for i, group in found.items():
                        out, last = [], 0
                        for text_, a, b, _ in group:
                            if next(p) >= threshold:
                                out += [text_[last:a], mark.encode()]
                                last = b
                        values[i] = (b"".join(out) + group[0][0][last:]).decode()
                    col = pa.array(values, texts.type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), col], names=["rest", "text"])

    python_ready(spark)
    out = rows.mapInArrow(clean, T.StructType([rows.schema["rest"], rows.schema["text"]]))
    return out.select(*[F.col("text").alias(text) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])
