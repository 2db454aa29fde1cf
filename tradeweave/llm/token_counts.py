"""Token counts of whole texts by overlap resynchronisation.

A text of at most ``chunk`` bytes is encoded as it stands. A longer one is cut in one pass into
chunks that overlap the next one, dealt over all tasks and encoded each by itself,
with the byte offset of every token. Two neighbours are spliced at the first stable
boundary behind the later one's start: a place where the pre-tokeniser must end a
token whatever stands around (``bpe.stable_cut``), and at which both encodings indeed
have a token boundary. Where an overlap holds none, the document goes round again
with a wider overlap, until the overlap reaches the text's end and the earlier chunk
takes all the rest; so every count is exact.

Defined results: null text is empty (0 bytes, 0 tokens); repeated rows each get their
row; keys may be null; an empty table gives no rows. Extra columns are not carried. Time and memory
are linear in a text's length: one task reads and cuts it, all of them encode its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import stable_cut
from .common import python_ready, staged, text_or_empty
from .textkernel import byte_view

CHUNK = 32_768
OVERLAP = 256
WIDEN = 16

_shared: dict[str, tuple] = {}


def _library(path: str):
    """(tokenizer, bytes of each id); the file has no normaliser, so a text's ids hold exactly its bytes."""
    if path not in _shared:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
        width = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            width[i] = special.get(i, len(token))  # one character of a byte-level token is one byte
        _shared[path] = tokenizer, width
    return _shared[path]


def first_stable(body: bytes, over: bytes, ends: bool) -> int | None:
    """Bytes from the start of ``over`` to its first stable boundary (never 0); all of them where the
    text ``ends`` first; None where the overlap is too short to tell."""
    found = np.flatnonzero(stable_cut(np.frombuffer(body[-4:] + over, dtype=np.uint8))) - len(body[-4:])
    found = found[found >= 1]
    if len(found):
        return int(found[0])
    return len(over) if ends else None


def splice_counts(ids_width: np.ndarray, left: int | None, right: int | None) -> tuple[int, bool]:
    """Tokens between byte ``left`` and byte ``right``, and whether both are token boundaries."""
    if left is None or right is None:
        return 0, False
    upto = np.concatenate([[0], np.cumsum(ids_width)])
    a, b = np.searchsorted(upto, [left, right])
    aligned = a < len(upto) and b < len(upto) and upto[a] == left and upto[b] == right
    return (int(b - a), True) if aligned and b >= a else (0, False)


def _count_short(rows: DataFrame, tokenizer: str) -> DataFrame:
    schema = T.StructType([*rows.select("key", "n_bytes").schema.fields, T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, _ = _library(tokenizer)
        for batch in batches:
            n: list[int] = []
            texts = batch.column(2).to_pylist()
            for a in range(0, len(texts), 256):
                n += map(len, library.encode_batch_fast(texts[a : a + 256], add_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=schema.fieldNames())

    return rows.select("key", "n_bytes", "text").mapInArrow(count, schema)


def _cuts(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """A row per chunk: its own bytes ``body``, those behind it that it overlaps, and whether the text ``ends`` with them.

    A text's bytes are cut in one pass, between characters, and the pieces are dealt over all tasks.
    """
    fields = rows.select("key", "n_bytes", "text_hash").schema.fields
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in (("chunk", T.IntegerType()), ("body", T.StringType()), ("over", T.StringType()), ("ends", T.BooleanType()))]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = byte_view(batch.column(3))
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                text = buf[a:b]

                def between(places: np.ndarray, text: np.ndarray = text) -> np.ndarray:
                    """Each place, or the next one where a character begins (at most three bytes on)."""
                    for _ in range(3):
                        inside = places < len(text)
                        inside[inside] = (text[places[inside]] & 0xC0) == 0x80
                        places = places + inside
                    return places

                edges = between(np.minimum(np.arange(-(-len(text) // chunk) + 1) * chunk, len(text)))
                beyond = between(np.minimum(edges[1:] + overlap, len(text)))
                for at in range(0, len(beyond), 64):
                    some = range(at, min(at + 64, len(beyond)))
                    yield pa.RecordBatch.from_arrays([
                        *[batch.column(k).take(pa.array([row] * len(some))) for k in range(3)], pa.array(some, pa.int32()),
                        pa.array([text[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary()).cast(pa.string()), pa.array([text[edges[k + 1] : beyond[k]].tobytes() for k in some], pa.binary()).cast(pa.string()),
                        pa.array([bool(beyond[k] == len(text)) for k in some])], names=schema.fieldNames())

    return rows.select("key", "n_bytes", "text_hash", "text").mapInArrow(cut, schema)


def _count_chunks(rows: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """A row per chunk: key, n_bytes, text_hash, chunk, n_tokens, aligned, and the places ``left`` and ``right`` of its splices."""
    cuts = _cuts(rows, chunk, overlap).repartition(F.xxhash64("text_hash", "chunk", "key"))
    keys = cuts.select("key", "n_bytes", "text_hash", "chunk").schema.fields
    schema = T.StructType([*keys, T.StructField("n_tokens", T.LongType()), T.StructField("aligned", T.BooleanType()), T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, width = _library(tokenizer)
        for batch in batches:
            tokens, good, lefts, rights = [], [], [], []
            for number, body, over, ends in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
                ids = np.array(library.encode_batch_fast([body + over], add_special_tokens=False)[0].ids, dtype=np.int64)
                b, o = body.encode(), over.encode()
                left = first_stable(b"", b + o, ends) if number else 0
                # behind the last chunk nothing is left to splice
                right = first_stable(b, o, ends)
                n, aligned = splice_counts(width[ids], left, None if right is None else len(b) + right)
                tokens.append(n)
                good.append(aligned)
                lefts.append(left)
                rights.append(right)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(tokens, pa.int64()), pa.array(good, pa.bool_()), pa.array(lefts, pa.int64()), pa.array(rights, pa.int64())], names=schema.fieldNames())

    return cuts.mapInArrow(count, schema)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens of every row; ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = _count_short(rows.filter(F.col("n_bytes") <= chunk), tokenizer)

    huge = rows.filter(F.col("n_bytes") > chunk).withColumn("text_hash", F.xxhash64("text"))
    done = None
    while True:
        counted = staged(_count_chunks(huge, tokenizer, chunk, overlap), "chunks")
        # what neighbours say of the splice between them cancels out, also for repeated rows
        said = F.bit_xor(
            F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.xxhash64("chunk", "left"))
            .bitwiseXOR(F.when(F.col("chunk") == F.col("last"), F.lit(0)).otherwise(F.xxhash64(F.col("chunk") + 1, "right")))
        )
        last = counted.groupBy("key", "n_bytes", "text_hash").agg(F.max("chunk").alias("last"))
        same = [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("key", "n_bytes", "text_hash")]
        per = counted.alias("c").join(last.alias("l"), same).select("c.*", "l.last").groupBy("key", "n_bytes", "text_hash").agg(
            F.sum("n_tokens").alias("total"), F.min("aligned").alias("aligned"), said.alias("said"),
            F.sum(F.when(F.col("chunk") == 0, 1).otherwise(0)).cast("int").alias("copies"),
        ).withColumn("whole", F.col("aligned") & (F.col("said") == 0))
        good = per.filter("whole").select("key", "n_bytes", F.expr("total div copies").alias("n_tokens"), F.explode(F.expr("array_repeat(0, copies)")).alias("_")).drop("_")
        done = good if done is None else done.unionByName(good)
        missed = staged(per.filter("NOT whole").select("key", "text_hash"), "missed")
        if missed.isEmpty():
            break
        same = [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("key", "text_hash")]
        huge = huge.alias("h").join(missed.alias("m"), same, "left_semi")
        overlap *= WIDEN
    return short.unionByName(done).select(F.col("key").alias(key), "n_bytes", "n_tokens")
