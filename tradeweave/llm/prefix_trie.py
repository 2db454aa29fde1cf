"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the head of one stored conversation followed by the suffix of
another. Neither texts nor rebuilt turns are put together: every turn is an affine map
``x -> m x + a`` modulo the prime 2^61 - 1, drawn from its digest and a seed, and the fingerprint of
a sequence is the product of its turns' maps. These products form a monoid (a group, as m
is never 0), so the fingerprint of "first k turns of the base, then own turns from h on to t" is

    base(k) * own(h)^-1 * own(t)

of products that were each computed once, over the stored turns.

1. Turns become references (conversation, turn, digest, code points). The digest stands for role
   and text once all turns with one digest are known to be equal in both.
2. References are range-partitioned in the conversations' order; each partition gives running
   products. A conversation that crosses partitions gets the product of its earlier parts,
   of which there are at most as many as partitions.
3. Every member of every node is one row: conversation, depth, product, the product without the
   last turn, and the last turn's digest. A node is a depth and a product. Equality is verified
   along the references: all members of a node must agree in the last turn's digest and in
   the parent's product, so that, down from the root, equal products are equal sequences.
   If any node fails, the next seed is taken.
4. A node's representative is its least member, which then represents all nodes below on its own
   path. Subtree sums therefore need no walk over levels: they add, over the members of a node, what
   each represents, less what the node's representative represents above the node (a running sum over
   range partitions).
5. Ids of the members that end at a node are joined in pieces of ``PIECE`` and hashed as a stream, so no
   task holds the ids of a node.

Defined results: turns come by number, null first; equal numbers by role, then by the text's
SHA-256; repeated rows are turns of their own. A null role or text is empty. Rows without a
conv_id belong to no conversation and give nothing. A missing base gives an empty head. An
empty table gives no node, not even a root. Texts of any length are only hashed. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradeweave.operators.keys import cumulative, ranged

from .common import python_ready, staged

PRIME = (1 << 61) - 1
SPREAD = 4  # range partitions per shuffle partition
PIECE = 4096
SEEDS = 8
MAX_HEAD = 5

Map = tuple[int, int]
ONE: Map = (1, 0)


def turn_map(digest: bytes, seed: int) -> Map:
    h = hashlib.blake2b(digest, digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(h[:8], "little") % (PRIME - 1) + 1, int.from_bytes(h[8:], "little") % PRIME


def product(x: Map, y: Map) -> Map:
    """First ``x``, then ``y``."""
    return x[0] * y[0] % PRIME, (x[1] * y[0] + y[1]) % PRIME


def inverse(x: Map) -> Map:
    m = pow(x[0], -1, PRIME)
    return m, -x[1] * m % PRIME


def _emit(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def turn_references(conversations: DataFrame) -> DataFrame:
    """conv, has_turn, turn, role, text_digest, digest (hex of role and text), chars; one row per turn. Verified."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").isNotNull().alias("has_turn"), "turn", role.alias("role"), text.alias("text"))
    text_digest = F.sha2("text", 256)
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), text_digest), 256)
    turns = turns.withColumn("text_digest", text_digest).withColumn("digest", digest)
    several = turns.groupBy("digest", "role", "text").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("different")).filter("different > 1")
    if several.limit(1).count():
        raise ValueError("turns that differ share a SHA-256 digest")
    return turns.select("conv", "has_turn", "turn", "role", "text_digest", "digest", F.char_length("text").cast("long").alias("chars"))


def _running(turns: DataFrame, seed: int) -> DataFrame:
    """Products before each turn inside its partition, and one row (chars null) with the product of the part's end."""
    order = ["conv", "has_turn", "turn", "role", "text_digest"]
    n = SPREAD * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", F.spark_partition_id().alias("part"), "digest", "chars")
    names = ["conv", "part", "pos", "m", "a", "em", "ea", "d1", "d2", "chars"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pos, total, part = None, 0, ONE, 0
        for batch in batches:
            out = []
            for conv, part, digest, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != at:
                    if at is not None:
                        out.append((at, part, pos, *total, None, None, None, None, None))
                    at, pos, total = conv, 0, ONE
                raw = bytes.fromhex(digest)
                own = turn_map(raw, seed)
                out.append((conv, part, pos, *total, *own, int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:16], "big", signed=True), chars))
                pos, total = pos + 1, product(total, own)
            yield _emit(out, names, types)
        if at is not None:
            yield _emit([(at, part, pos, *total, None, None, None, None, None)], names, types)

    return spread.mapInArrow(run, "conv long, part int, pos long, m long, a long, em long, ea long, d1 long, d2 long, chars long")


def _whole_products(run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``run`` with positions and products from the conversation's first turn on, and (conv, n_own).

    Only parts of conversations that cross partitions are composed on the driver: at most two per partition.
    """
    spark = run.sparkSession
    ends = run.filter("chars IS NULL")
    sizes = ends.groupBy("conv").agg(F.sum("pos").alias("n_own"), F.count("*").alias("parts"))
    split = ends.join(sizes.filter("parts > 1").select("conv"), "conv", "left_semi").select("conv", "part", "pos", "m", "a").collect()
    earlier, at, pos, total = [], None, 0, ONE
    for r in sorted(split):
        if r["conv"] != at:
            at, pos, total = r["conv"], 0, ONE
        earlier.append((at, r["part"], pos, *total))
        pos, total = pos + r["pos"], product(total, (r["m"], r["a"]))
    before = spark.createDataFrame(earlier, "conv long, part int, pos0 long, m0 long, a0 long")
    joined = run.join(F.broadcast(before), ["conv", "part"], "left")  # at most two rows per range partition
    names, types = run.columns, [pa.int64(), pa.int32(), *[pa.int64()] * 8]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("m0").null_count == batch.num_rows:
                yield batch.select(names)
                continue
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv, part, pos, m, a, *rest, pos0, m0, a0 = row
                if m0 is not None:
                    pos, (m, a) = pos + pos0, product((m0, a0), (m, a))
                out.append((conv, part, pos, m, a, *rest))
            yield _emit(out, names, types)

    whole = joined.select(*names, "pos0", "m0", "a0").mapInArrow(compose, run.schema)
    return staged(whole, "products"), sizes.select("conv", "n_own")


MEMBER = "conv long, depth long, m long, a long, pm long, pa long, d1 long, d2 long, chars long, ends boolean"
_MEMBER_NAMES = [x.split()[0] for x in MEMBER.split(", ")]
_MEMBER_TYPES = [*[pa.int64()] * 9, pa.bool_()]


def _members(turns: DataFrame, seed: int, base: Column, head: Column) -> DataFrame:
    """A row for every rebuilt conversation and every prefix of it, the empty one included."""
    whole, sizes = _whole_products(staged(_running(turns, seed), "running"))
    # products after 0 .. MAX_HEAD turns with the turn that follows; the end of a short conversation is one of them
    firsts = whole.join(sizes, "conv").filter(f"pos <= {MAX_HEAD} AND (chars IS NOT NULL OR pos = n_own)")
    firsts = firsts.groupBy("conv").agg(F.first("n_own").alias("n_own"), F.sort_array(F.collect_list(F.struct("pos", "m", "a", "d1", "d2", "chars"))).alias("firsts"))
    firsts = staged(firsts.select("conv", "n_own", "firsts", base.alias("base"), head.alias("h")), "firsts")
    bases = firsts.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"), F.col("firsts").alias("base_firsts"))
    convs = firsts.join(bases, "base", "left").select("conv", "n_own", "h", "firsts", "n_base", "base_firsts")
    bridged = MEMBER + ", bm long, ba long, skip long"

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, n_own, h, own, n_base, stem in zip(*(c.to_pylist() for c in batch.columns)):
                k = min(h, n_base or 0)
                more = n_own > h
                bridge = (None, None, None)
                if more:
                    stem_end = (stem[k]["m"], stem[k]["a"]) if k else ONE
                    bridge = (*product(stem_end, inverse((own[h]["m"], own[h]["a"]))), h - k)
                out.append((conv, 0, *ONE, None, None, None, None, 0, not k and not more, *bridge))
                for d in range(1, k + 1):
                    last, now = stem[d - 1], stem[d]
                    out.append((conv, d, now["m"], now["a"], last["m"], last["a"], last["d1"], last["d2"], last["chars"], d == k and not more, None, None, None))
            yield _emit(out, [*_MEMBER_NAMES, "bm", "ba", "skip"], [*_MEMBER_TYPES, *[pa.int64()] * 3])

    top = staged(convs.mapInArrow(heads, bridged), "heads")
    bridges = top.filter("bm IS NOT NULL").select("conv", "bm", "ba", "skip").join(firsts.select("conv", "h", "n_own"), "conv")
    suffixes = whole.filter("chars IS NOT NULL").join(bridges, "conv").filter("pos >= h")
    suffixes = suffixes.select("conv", (F.col("pos") - F.col("skip") + 1).alias("depth"), "m", "a", "em", "ea", "d1", "d2", "chars", (F.col("pos") == F.col("n_own") - 1).alias("ends"), "bm", "ba")

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, depth, m, a, em, ea, d1, d2, chars, ends, bm, ba in zip(*(c.to_pylist() for c in batch.columns)):
                parent = product((bm, ba), (m, a))
                out.append((conv, depth, *product(parent, (em, ea)), *parent, d1, d2, chars, ends))
            yield _emit(out, _MEMBER_NAMES, _MEMBER_TYPES)

    return staged(top.select(_MEMBER_NAMES).unionByName(suffixes.mapInArrow(tails, MEMBER)), "members")


def _nodes(members: DataFrame) -> DataFrame:
    same = ["pm", "pa", "d1", "d2", "chars"]
    spans = [f(c).alias(f"{name}_{c}") for c in same for f, name in ((F.min, "least"), (F.max, "most"))]
    nodes = members.groupBy("depth", "m", "a").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *spans)
    verified = reduce(lambda x, y: x & y, [F.col(f"least_{c}").eqNullSafe(F.col(f"most_{c}")) for c in same])
    return staged(nodes.select("depth", "m", "a", "conv_id", "n_convs", *[F.col(f"least_{c}").alias(c) for c in ("pm", "pa", "chars")], verified.alias("verified")), "nodes")


def _end_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, streamed over pieces in order."""
    ids = ranged(members.filter("ends").select("depth", "m", "a", "conv"), ["depth", "m", "a", "conv"])
    piece = (F.col("_rk_pos") / PIECE).cast("long").alias("piece")
    pieces = ids.groupBy("depth", "m", "a", F.col("_rk_part").alias("part"), piece).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition("depth", "m", "a").sortWithinPartitions("depth", "m", "a", "part", "piece").select("depth", "m", "a", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["depth", "m", "a", "ends_sha256"], [*[pa.int64()] * 3, pa.string()]
        at, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _emit(out, names, types)
        if at is not None:
            yield _emit([(*at, state.hexdigest())], names, types)

    return pieces.mapInArrow(digest, "depth long, m long, a long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column]) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: the first ``head`` turns (at most ``MAX_HEAD``)
    of conversation ``base``, then the conversation's own turns after its first ``head``.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    python_ready(conversations.sparkSession)
    turns = staged(turn_references(conversations), "turns")
    conv = F.col("conv")
    for seed in range(SEEDS):
        members = _members(turns, seed, base(conv), head(conv).cast("long"))
        nodes = _nodes(members)
        if not nodes.filter("NOT verified").limit(1).count():
            break
    else:
        raise ValueError(f"no seed below {SEEDS} tells all prefixes apart")

    key = ["depth", "m", "a"]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pm").alias("m"), F.col("pa").alias("a")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # what each representative stands for, along its path
    weight = (F.col("n_convs") - 1) * F.col("chars")
    path = staged(cumulative(nodes.select("conv_id", "depth", "n_children", weight.alias("weight")), ["conv_id", "depth"], F.col("weight"), "above"), "path")
    stands = path.groupBy("conv_id").agg(F.sum("weight").alias("weight"), F.min("above").alias("start"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    own = path.join(stands.select("conv_id", "start"), "conv_id").select("conv_id", "depth", (F.col("above") - F.col("start")).alias("above"))
    sums = members.join(stands.select(F.col("conv_id").alias("conv"), "weight", "leaves"), "conv").groupBy(key).agg(F.sum("weight").alias("weight"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("m").alias("pm"), F.col("a").alias("pa"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, ["depth", "pm", "pa"], "left").join(own, ["conv_id", "depth"]).join(sums, key).join(_end_digests(members), key, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("weight") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
