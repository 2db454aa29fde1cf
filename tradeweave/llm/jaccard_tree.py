"""N-gram Jaccard join by signature trees.

A document's set is that of its distinct word shingles (64-bit hashes of whole texts).
Documents with equal sets are one node. Nodes meet in blocks, each keyed by ``ROWS``
minimum hashes of the set; ``bands`` such keys are drawn until a pair at the threshold shares
none of them with a probability below ``MISS``, which is of the order of a hash collision.
With ``exact`` the keys are the set's least hashes instead, so many that two sets which link must have one in
common (a prefix filter): no link is left to probability, for more and larger blocks.

In a block the sets are packed into a signature tree by size: every tree node holds the
OR of its sets' token bitmaps, the range of their sizes, the most bit collisions and
whether all carry one component label. Two trees (or one with itself) are traversed
together from their roots; a pair of nodes goes if its sizes cannot match, if the
common bits bound the overlap below what the least sizes need, or if both lie in one
component. Surviving leaf pairs are checked on the sets themselves.

Blocks are bounded. From one with more than ``BLOCK`` nodes go those that cannot link with any
node of the block: shingles that no other node of large blocks has bound their overlap
below what the block's least size needs (``shared_counts``: packed arrays per chunk of nodes, no row per
shingle). What is left is dealt into chunks; the first
round compares every chunk with itself and with the ``BLOCK`` nodes that have the smallest
share of such shingles, so that a large group of near copies falls into one component
in linear work. The second round takes all keys and only blocks that still hold two
labels; in a large one, every node outside the commonest label is compared with all
others, in chunks of ``DEAL`` nodes. Any two nodes that share a block thus either cannot link, lie in
one component already, or have been compared: no link between components is lost.

Defined results: words are those of ``textkernel``; a text with fewer words than a shingle is
one shingle; null, empty or blank text has an empty set, links with nothing and is its own
component; repeated rows share a set; a null key is never the component's id unless all
keys are null; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import python_ready, staged, text_or_empty
from .components import components
from .textkernel import mix, parts, span_hashes, words_of

ROWS = 3
MISS = 1e-12
BLOCK = 256
DEAL = 1024  # nodes on either side of a task of the second round
FRONTIER = 1 << 14
CHUNK_BYTES = 16 << 20
PASSES = 2  # of the search for nodes without a partner; any number gives the same links
FIRST_BANDS = 2
FANOUT = 8
MAX_BITS = 4096
SEED = 77


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Keys so that a pair at the threshold shares none with a probability below ``miss``."""
    p = (percent / 100) ** rows
    return 1 if p >= 1 else math.ceil(math.log(miss) / math.log(1 - p))


def shingle_sets(col: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (words with A-Z lower-cased)."""
    w = words_of(col, lower=True)
    h = span_hashes(w.buf, w.start, w.end)
    odd = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def joined(words: np.ndarray, k: int, n: int) -> np.ndarray:
        total = np.full(n, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            total += mix(words[j : j + n] ^ odd[j]) * odd[j]
        return mix(total)

    n = max(0, len(h) - size + 1)
    whole = joined(h, size, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            s = np.sort(whole[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(joined(h[a:b], b - a, 1) if b > a else np.zeros(0, np.uint64))
    return out


def node_id(s: np.ndarray) -> bytes:
    """The set's identity: its size and two 64-bit sums over differently mixed members."""
    return struct.pack(">QQI", int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)), len(s))


def band_keys(s: np.ndarray, bands: int, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flip, times = (rng.integers(0, 1 << 64, size=(bands * rows, 1), dtype=np.uint64) for _ in range(2))
    times |= np.uint64(1)
    least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        np.minimum(least, ((s[None, at : at + 2048] ^ flip) * times).min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def prefix_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The least members of the set, as many as it takes that every set it links with has one of them among its own."""
    return s[: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64)


class Tree:
    """Signature tree over sets in the given order: ``levels[0]`` are the sets, the last level is the root."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, bits: int) -> None:
        n = np.array([len(s) for s in sets], dtype=np.int64)
        maps = np.zeros((len(sets), bits), dtype=bool)
        for i, s in enumerate(sets):
            maps[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        packed = np.packbits(maps, axis=1).view(np.uint64)
        clash = n - maps.sum(1)
        self.levels = [(packed, n, n, clash, labels, labels)]
        while len(self.levels[-1][1]) > 1:
            m, low, high, c, first, last = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(c, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def _may_link(a: Tree, b: Tree, top_a: int, top_b: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of tree nodes may hold a link between components."""
    ma, low_a, high_a, ca, fa, la = (x[i] for x in a.levels[top_a])
    mb, low_b, high_b, cb, fb, lb = (x[j] for x in b.levels[top_b])
    if top_a or top_b:
        overlap = np.bitwise_count(ma & mb).sum(1, dtype=np.int64) + np.minimum(ca, cb)
    else:
        overlap = np.minimum(low_a - np.bitwise_count(ma & ~mb).sum(1, dtype=np.int64), low_b - np.bitwise_count(mb & ~ma).sum(1, dtype=np.int64))
    keep = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a) & ((100 + percent) * overlap >= percent * (low_a + low_b))
    return keep & ~((fa == la) & (fb == lb) & (fa == fb))


def dual_traversal(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (i of a, j of b) that may link, in slices; i < j where both are one tree.

    Depth first over slices of ``FRONTIER`` pairs, so memory doesn't follow the number of pairs.
    """
    one, step = a is b, np.arange(FANOUT)
    work = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        top_a, top_b, i, j = work.pop()
        if len(i) > FRONTIER:
            work += [(top_a, top_b, i[k : k + FRONTIER], j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]
            continue
        keep = _may_link(a, b, top_a, top_b, i, j, percent)
        if one and not top_a:
            keep &= i < j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not (top_a or top_b):
            yield i, j
            continue
        if top_a:
            i, j = (i[:, None] * FANOUT + step).ravel(), np.repeat(j, FANOUT)
            top_a -= 1
            inside = i < len(a.levels[top_a][1])
            i, j = i[inside], j[inside]
        if top_b:
            i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + step).ravel()
            top_b -= 1
            inside = j < len(b.levels[top_b][1])
            i, j = i[inside], j[inside]
        if one:
            i, j = i[i <= j], j[i <= j]
        work.append((top_a, top_b, i, j))


def overlap_size(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def block_links(nodes: list, sets: list[np.ndarray], labels: list, sides: np.ndarray, percent: int) -> list[tuple]:
    """Links that join components, of side 0 with itself and with side 1."""
    names = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    label = np.array([names[x] for x in labels], dtype=np.int64)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    alone = np.bincount(label)[label] == 1
    bits = 1 << int(min(MAX_BITS, max(64, 2 * int(n.max()))) - 1).bit_length()
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = [np.flatnonzero(sides == s) for s in (0, 1)]
    order = [o[np.lexsort((n[o], np.where(alone[o], -1, label[o])))] for o in order]
    trees = [Tree([sets[k] for k in o], label[o], bits) if len(o) else None for o in order]
    out = []
    for other in (0, 1):
        if trees[0] is None or trees[other] is None:
            continue
        for left, right in dual_traversal(trees[0], trees[other], percent):
            for x, y in zip(order[0][left].tolist(), order[other][right].tolist()):
                p, q = root(int(label[x])), root(int(label[y]))
                if p != q and (100 + percent) * overlap_size(sets[x], sets[y]) >= percent * int(n[x] + n[y]):
                    parent[p] = q
                    out.append((nodes[x], nodes[y]))
    return out


def _sets(rows: DataFrame, size: int, percent: int, exact: bool) -> DataFrame:
    """key, text_hash, n, node, keys of every row of (key, text_hash, text)."""
    bands = bands_for(percent)
    schema = T.StructType([*rows.select("key", "text_hash").schema.fields, T.StructField("n", T.IntegerType()), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, col in parts(batch.column(2)):
                sets = shingle_sets(col, size)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(col)), batch.column(1).slice(at, len(col)), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([node_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([(prefix_keys(s, percent) if exact else band_keys(s, bands)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=schema.fieldNames())

    return rows.select("key", "text_hash", "text").mapInArrow(make, schema)


def _members(rows: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingles, of rows with (node, text)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, col in parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array([s.tobytes() for s in shingle_sets(col, size)], pa.binary())], names=["node", "members"])

    return rows.select("node", "text").mapInArrow(make, "node binary, members binary")


def _tree_links(tasks: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of all tasks (block, i, j, side, node, label), each in one Python call."""
    rows = tasks.join(members, "node").select("block", "i", "j", "side", "node", "label", "members")
    rows = rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "node")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                out.extend(block_links([r[4] for r in held], [np.frombuffer(r[6], dtype=np.uint64) for r in held], [r[5] for r in held], np.array([r[3] for r in held]), percent))
            held.clear()

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
            out.clear()
            return done

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if held and held[0][:3] != row[:3]:
                    close()
                held.append(row)
            yield flush()
        close()
        yield flush()

    return rows.mapInArrow(solve, "a binary, b binary")


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (as tuples) of sorted batches by their first ``n_keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:n_keys] != row[:n_keys]:
                yield held[0][:n_keys], held
                held = []
            held.append(row)
    if held:
        yield held[0][:n_keys], held


def _tokens(parts_of: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts_of), dtype=np.uint64)


def shared_counts(sets: DataFrame) -> DataFrame:
    """node, common: how many shingles of each node of (node, members) another node has as well.

    Nodes are dealt into chunks. A chunk tells which shingles one of its nodes has and which several have, as two packed
    arrays per slice of the hash range; a slice tells each chunk which of the former no other chunk has. Rows are chunks
    times slices, both of some ``CHUNK_BYTES``; no shingle is a row.
    """
    n_bytes = sets.agg(F.coalesce(F.sum(F.octet_length("members")), F.lit(0))).first()[0]
    chunks, slices = -(-max(n_bytes, 1) // CHUNK_BYTES), -(-max(n_bytes, 1) // (4 * CHUNK_BYTES))
    n_parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = staged(sets.select(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(chunks)).alias("chunk"), "node", "members"), "dealt")
    width = -(-(1 << 64) // slices)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), rows in _grouped(batches, 1):
            tokens, times = np.unique(_tokens([r[2] for r in rows]), return_counts=True)
            ends = np.searchsorted(tokens, np.array([k * width for k in range(1, slices)], dtype=np.uint64)).tolist()
            for k, (x, y) in enumerate(zip([0, *ends], [*ends, len(tokens)])):
                if y > x:
                    some, once = tokens[x:y], times[x:y] == 1
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([chunk], pa.int64()), pa.array([some[once].tobytes()], pa.binary()), pa.array([some[~once].tobytes()], pa.binary())], names=["slice", "chunk", "once", "several"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_,), rows in _grouped(batches, 1):
            tokens, chunks_with = np.unique(np.concatenate([_tokens([r[2] for r in rows]), _tokens([r[3] for r in rows])]), return_counts=True)
            single = tokens[chunks_with == 1]
            for _, chunk, once, _ in rows:
                own = np.intersect1d(_tokens([once]), single, assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([None], pa.binary()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "node", "members"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            own = np.sort(_tokens([r[2] for r in rows if r[1] is None]))
            nodes = [r for r in rows if r[1] is not None]
            held = _tokens([r[2] for r in nodes])
            place = np.minimum(np.searchsorted(own, held), max(len(own) - 1, 0))
            shared = own[place] != held if len(own) else np.ones(len(held), bool)
            ends = np.cumsum([len(r[2]) // 8 for r in nodes])
            total = np.concatenate([[0], np.cumsum(shared)])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in nodes], pa.binary()), pa.array(np.diff(total[np.concatenate([[0], ends]).astype(np.int64)]), pa.int64())], names=["node", "common"])

    by_slice = dealt.repartition(n_parts, "chunk").sortWithinPartitions("chunk").mapInArrow(told, "slice long, chunk long, once binary, several binary")
    lone = by_slice.repartition(n_parts, "slice").sortWithinPartitions("slice").mapInArrow(alone, "chunk long, node binary, members binary")
    return dealt.unionByName(lone).repartition(n_parts, "chunk").sortWithinPartitions("chunk").mapInArrow(count, "node binary, common long")


def _without_partner(blocks: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``blocks`` (block, band, node, n, held) without the nodes of large blocks that cannot link there,
    with ``common`` (shingles that another node of large blocks has) and ``held`` counted anew."""
    large = blocks.filter(F.col("held") > BLOCK)
    for _ in range(PASSES):
        common = shared_counts(members.join(large.select("node").distinct(), "node", "left_semi"))
        least = large.groupBy("block").agg(F.min("n").alias("least"))
        bound = large.drop("common").join(common, "node").join(least, "block")
        large = staged(bound.filter((100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("least"))).select("block", "band", "node", "n", "common"), "large")
    held = large.groupBy("block").agg(F.count("*").alias("held")).filter("held > 1")
    large = large.join(held, "block").select("block", "band", "node", "n", "held", "common")
    return blocks.filter(F.col("held") <= BLOCK).withColumn("common", F.col("n").cast("long")).unionByName(large)


def _number(chunks: str):
    return F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))


def _chunk(chunks: str, salt: int):
    return F.pmod(F.xxhash64("node", "block", F.lit(salt)), F.col(chunks)).cast("int")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """key, text_hash, n_shingles, component_id (least key of the component), first (is the row the
    component's least by key and text hash): one row per row of ``docs``. ``exact``: blocks without probability."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = staged(_sets(rows, size, percent, exact), "sets")
    nodes = sets.filter("n > 0").groupBy("node").agg(F.min(F.struct("key", "text_hash")).alias("pick"), F.min("key").alias("least_key"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = staged(nodes, "nodes")

    # blocks with two nodes or more, of all bands
    in_band = nodes.select("node", "n", F.posexplode("keys").alias("band", "block"))
    sizes = in_band.groupBy("block").agg(F.count("*").alias("held")).filter("held > 1")
    shared = staged(in_band.join(sizes, "block").select("block", "band", "node", "n", "held"), "blocks")

    picked = shared.select("node").distinct().join(nodes.select("node", "pick"), "node").select("node", F.col("pick.key").alias("p_key"), F.col("pick.text_hash").alias("p_hash"))
    texts = rows.join(picked, rows["key"].eqNullSafe(picked["p_key"]) & (rows["text_hash"] == picked["p_hash"]))
    members = staged(_members(texts.select("node", "text").dropDuplicates(["node"]), size), "members")
    shared = staged(_without_partner(shared, members, percent), "blocks")

    # first round: each chunk with itself and, in large blocks, with the nodes that share most
    early = shared.filter(F.col("band") < FIRST_BANDS).withColumn("chunks", F.ceil(F.col("held") / BLOCK).cast("int"))
    early = early.select("block", "node", "n", "common", "chunks", F.lit(0).alias("j"), F.col("node").alias("label"))
    most = Window.partitionBy("block").orderBy((F.col("n") - F.col("common")) / F.col("n"), "node")
    pivots = early.filter("chunks > 1").withColumn("nth", F.row_number().over(most)).filter(F.col("nth") <= BLOCK)
    columns = ["block", "i", "j", "side", "node", "label"]
    tasks = early.withColumn("i", _chunk("chunks", 1)).withColumn("side", F.lit(0)).select(columns).unionByName(pivots.withColumn("i", _number("chunks")).withColumn("side", F.lit(1)).select(columns))
    links = staged(_tree_links(tasks, members, percent), "found")
    labels = components(links)

    # second round: blocks that still hold two labels
    labelled = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("block").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("block")
    labelled = staged(labelled.join(mixed, "block", "left_semi").select("block", "node", "held", "label"), "mixed")
    small = labelled.filter(F.col("held") <= BLOCK).select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "label")
    large = labelled.filter(F.col("held") > BLOCK)
    per_label = large.groupBy("block", "label").agg(F.count("*").alias("n"), F.first("held").alias("held"))
    common = per_label.groupBy("block").agg(F.max(F.struct("n", "label")).alias("top"), F.first("held").alias("held"))
    common = common.select("block", F.col("top.label").alias("common"), F.ceil(F.col("held") / DEAL).cast("int").alias("n_i"), F.ceil((F.col("held") - F.col("top.n")) / DEAL).cast("int").alias("n_j"))
    dealt = large.join(common, "block")
    others = dealt.filter("label != common").withColumn("j", _chunk("n_j", 2)).withColumn("i", _number("n_i")).withColumn("side", F.lit(0))
    every = dealt.withColumn("i", _chunk("n_i", 3)).withColumn("j", _number("n_j")).withColumn("side", F.lit(1))
    more = _tree_links(small.unionByName(others.select(columns)).unionByName(every.select(columns)), members, percent)
    labels = components(links.unionByName(more))

    named = nodes.select("node", "least_key", "pick").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_key").alias("component_id"), F.min("pick").alias("lead"))
    named = staged(named.join(least, "label").select("node", "component_id", "lead"), "named")
    out = sets.select("key", "text_hash", "n", "node").join(named, "node", "left")
    return out.select(
        F.col("key").alias(key), "text_hash", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("node").isNull() | (F.struct("key", "text_hash") == F.col("lead"))).alias("first"),
    )
