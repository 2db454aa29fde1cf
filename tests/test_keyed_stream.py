"""Landing with keyed state: restarts, replayed batches and keep-first order against the batch form."""

from __future__ import annotations

import glob
import os
import random

from tradeweave.operators.clean import DEFAULT_DEDUP_KEYS, clean_flows
from tradeweave.sources.files import INGEST_ORDER, read_raw
from tradeweave.streaming.keyed_stream import clean_schema, first_of_key, land_by_key, start_first_of_key_stream

HEADER = "refYear,reporterCode,reporterISO,partnerCode,partnerISO,cmdCode,cmdDesc,flowCode,primaryValue,netWgt,qty,qtyUnitAbbr"


def put(root, name, seed, n=40):
    rng = random.Random(seed)
    os.makedirs(root, exist_ok=True)
    lines = [f"{rng.choice(['2019', '2020', '20x0'])},376,ISR,{rng.choice(['156,CHN', '842,USA', ','])},{rng.choice(['84', '7'])},d,{rng.choice('MXQ')},{rng.randrange(1000)},5,,kg" for _ in range(n)]
    with open(f"{root}/{name}.csv", "w") as fh:
        fh.write("\n".join([HEADER, *lines]) + "\n")


def values(df):
    return sorted(str(tuple(r)) for r in df.select(*DEFAULT_DEDUP_KEYS, "trade_value_usd").collect())


def expected(spark, landing):
    """Files were landed in the order of their names."""
    return values(clean_flows(read_raw(spark, landing, required=HEADER.split(",")), INGEST_ORDER))


def test_keys_are_kept_over_runs_and_replays(spark, scratch):
    landing, root = f"{scratch}/in", f"{scratch}/out"
    put(landing, "a", 1, 12)
    assert values(land_by_key(spark, landing, root)) == expected(spark, landing)
    before = set(glob.glob(f"{root}/clean/**/*.parquet", recursive=True))
    put(landing, "b", 2, 25)
    out = land_by_key(spark, landing, root)
    assert values(out) == expected(spark, landing)
    # the second run added files and left the first one's alone
    assert before < set(glob.glob(f"{root}/clean/**/*.parquet", recursive=True))
    # nothing new: nothing changes
    assert values(land_by_key(spark, landing, root)) == expected(spark, landing)
    # executors or driver lost after the work and before the commit of the last batch: both streams run it again
    for stream in ("cleaning", "keys"):
        last = max(int(os.path.basename(p)) for p in glob.glob(f"{root}/state/{stream}/commits/[0-9]*"))
        os.remove(f"{root}/state/{stream}/commits/{last}")
        os.remove(f"{root}/state/{stream}/commits/.{last}.crc")
    assert values(land_by_key(spark, landing, root)) == expected(spark, landing)


def test_no_batch_reads_the_table_and_order_is_that_of_batches(spark, scratch):
    root = f"{scratch}/out"
    schema = clean_schema(spark)
    rows = lambda vs: spark.createDataFrame([{"year": 2020, "partner_code": None, "hs_code": "84", "trade_value_usd": float(v)} for v in vs], schema)
    # two cleaned batches wait for one run of the second stream: the lower number was first, whatever the files' times
    rows([2]).write.parquet(f"{root}/batches/batch=2")
    rows([1]).write.parquet(f"{root}/batches/batch=1")
    q = start_first_of_key_stream(spark, root, clean_schema(spark))
    q.awaitTermination()
    assert [r[0] for r in spark.read.parquet(f"{root}/clean").select("trade_value_usd").collect()] == [1.0]
    assert ["/batches" in source["description"] for source in q.lastProgress["sources"]] == [True]
    stream = spark.readStream.schema(clean_schema(spark).add("batch", "long")).parquet(f"{root}/batches")
    assert first_of_key(stream, DEFAULT_DEDUP_KEYS).isStreaming
