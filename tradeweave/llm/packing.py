"""Packing token ids into fixed windows by minimum bin slack.

A document's ids (and the closing id) are cut into full windows, which are
sequences of their own, and one remainder shorter than a window. Remainders are
packed by minimum bin slack: for each window the longest remaining length is
taken as seed and a subset-sum bitset over the multiset of remaining lengths
finds the fill closest to capacity; backtracking gives how often each length is
used. Only the histogram of remaining lengths matters, so the solver sees at most
``window - 1`` lengths with counts, however many documents there are, and one
solution is applied as often as the counts allow. Spark does the rest: tokenising,
the histogram, the rank of every remainder among those of its length (dealt out by
hash, so that a length that holds a third of all rows is ranked by many tasks),
and the join of ranks to the plan, which has a few thousand rows at most.

Defined results: null text is empty (one piece that holds the closing id); an empty
table gives no rows; repeated rows each get their own pieces; ties between
documents of equal length fall by hash, key and text checksum. Key columns may
hold nulls. Extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bpe import IdEncoder
from .common import python_ready, staged, text_or_empty

WINDOW = 2048
EOS = 1
RANK_BUCKET_ROWS = 2_000


def fill_window(lengths: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """{index: times} of the lengths whose sum is as close to ``capacity`` as the counts allow, never above.

    ``reach`` has bit s set where sum s can be made; counts go in by powers of two
    (1, 2, 4, ... and the rest), each a shift of the bitset, kept for backtracking.
    """
    limit = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left, k = min(count, capacity // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((i, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            k *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for i, take, before in reversed(steps):
        if not before >> total & 1:
            used[i] = used.get(i, 0) + take
            total -= lengths[i] * take
    return used


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(repeats, [(length, times), ...])] that uses up the histogram; the seed comes first in each pattern."""
    left = {k: v for k, v in histogram.items() if v > 0}
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    while left:
        seed = max(left)
        lengths = sorted((x for x in left if x <= window - seed), reverse=True)
        counts = [left[x] - (x == seed) for x in lengths]
        fill = {lengths[i]: n for i, n in fill_window(lengths, counts, window - seed).items()} if window > seed else {}
        fill[seed] = fill.get(seed, 0) + 1
        repeats = min(left[x] // n for x, n in fill.items())
        plan.append((repeats, sorted(fill.items(), reverse=True)))
        for x, n in fill.items():
            left[x] -= n * repeats
            if not left[x]:
                del left[x]
    return plan


def token_pieces(docs: DataFrame, key: str, text: str, tokenizer: str, window: int, eos: int, keep_ids: bool) -> DataFrame:
    """The pieces of every document: key, start, length, ids_crc32, doc_tokens, text_crc32[, ids]."""
    python_ready(docs.sparkSession)
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("text_crc32", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = IdEncoder.shared(tokenizer)
        for batch in batches:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(batch.column(1))):
                own = np.append(ids, np.uint32(eos)).astype("<u4")
                for a in range(0, len(own), window):
                    piece = own[a : a + window]
                    row.append(i)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
                    if keep_ids:
                        kept.append(piece.astype(np.int32))
            which = pa.array(row, pa.int64())
            columns = [batch.column(0).take(which), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), batch.column(2).take(which)]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return rows.withColumn("text_crc32", F.crc32("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, eos: int = EOS, keep_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library.
    With ``keep_ids`` the ids themselves come with each piece; without, only their checksum does.
    """
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, key, text, tokenizer, window, eos, keep_ids), "pieces")
    pieces = pieces.withColumn("rank_key", F.xxhash64("key", "start", "ids_crc32"))
    pieces = pieces.withColumn("bucket_hash", F.xxhash64("rank_key", F.lit(7)))

    # bounded: at most ``window`` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_windows({k: v for k, v in histogram.items() if k < window}, window)
    slots, sequence, taken = [], 0, {}
    for repeats, fill in plan:
        offset = 0
        for length, times in fill:
            before = taken.get(length, 0)
            slots.append((length, before, before + repeats * times, times, sequence, offset))
            taken[length] = before + repeats * times
            offset += length * times
        sequence += repeats
    # a full piece is a sequence by itself
    slots.append((window, 0, histogram.get(window, 0), 1, sequence, 0))
    by_length: dict[int, list[tuple]] = {}
    for length, low, high, times, first, offset in slots:
        by_length.setdefault(length, []).append((low, high, times, first, offset))
    plan_schema = "length long, buckets long, slots array<struct<low:long,high:long,times:long,first:long,offset:long>>"
    lookup = spark.createDataFrame([(k, max(1, -(-histogram.get(k, 0) // RANK_BUCKET_ROWS)), v) for k, v in sorted(by_length.items())], plan_schema)

    dealt = pieces.join(F.broadcast(lookup), "length")  # at most ``window`` lengths
    dealt = dealt.withColumn("bucket", F.pmod("bucket_hash", "buckets"))
    # rows before each bucket of a length
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("rank_key", "key", "start", "text_crc32", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    slot = F.expr("filter(slots, s -> s.low <= rank AND rank < s.high)[0]")
    placed = ranked.withColumn("slot", slot).withColumn("nth", F.col("rank") - F.col("slot.low"))
    return placed.select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.first") + F.expr("nth div slot.times")).alias("sequence_id"),
        (F.col("slot.offset") + F.col("length") * F.expr("nth % slot.times")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )
