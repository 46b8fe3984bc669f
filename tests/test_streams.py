"""Streams against the batch results of the same rows: killed batches, restarts, rows out of order."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import contracts
from tessera.streaming import attempts, chains

LOG = "case_id long, attempt long, status string, config string"


def test_a_killed_batch_is_made_again_and_each_row_comes_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, a, "ok" if a == ok else "no", rng.choice(["now", "now", "old"])) for c in range(40) for ok in [rng.randint(1, 9)] for a in range(1, 8)]
    rows += rows[::3]
    for i in range(6):
        spark.createDataFrame(rows[i::6], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source, sink, state = f"{tmp_path}/in/*", f"{tmp_path}/log", f"{tmp_path}/state"

    def run(watch=None):
        return attempts.resumed_log(spark, source, LOG, sink, state, F.col("status") == "ok", F.col("config") == "now", watch=watch)

    def kill(n):
        if n == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(kill)
    seen = []
    got = sorted(map(tuple, run(seen.append).collect()))
    assert seen[0] == 1  # the killed batch, though it had written its folder
    own = {(c, a): (c, a, s, k) for c, a, s, k in rows if k == "now"}
    done = {c: min([a for (d, a), r in own.items() if d == c and r[2] == "ok"], default=99) for c, _ in own}
    assert got == sorted(r for (c, a), r in own.items() if a <= done[c])
    before = len(seen)
    assert sorted(map(tuple, run(seen.append).collect())) == got and len(seen) == before  # nothing new: no batch
    rejected = spark.read.parquet(*(f"{sink}-rejected/batch-{n}" for n in range(3)))
    assert rejected.where("reason = 'foreign'").count() == sum(k == "old" for *_, k in rows)
    assert rejected.where("reason = 'after_accepted' AND config = 'old'").count() == 0


def test_empty_log(spark, tmp_path):
    spark.createDataFrame([], LOG).write.parquet(f"{tmp_path}/in")
    assert attempts.resumed_log(spark, f"{tmp_path}/in", LOG, f"{tmp_path}/log", f"{tmp_path}/state", F.lit(True), F.lit(True)).count() == 0


def test_chains_are_checked_while_they_stream(spark, tmp_path):
    """Rows up to six places late, stopped and started again; changes, swaps and losses are named, and as in the batch check."""
    rng = random.Random(5)
    rows = [(f"c{c}", p, f"v{rng.random()}") for c in range(6) for p in range(1, 31)]
    log = contracts.chain_log(spark.createDataFrame(rows, "chain string, place long, value string"), ["chain"], "place", "value")
    held = [list(r) for r in log.collect()]
    by = {(r[0], r[1]): r for r in held}
    by["c0", 7][2] = "other"
    by["c1", 3][3:], by["c1", 4][3:] = by["c1", 4][3:], by["c1", 3][3:]  # digests swapped
    by["c2", 30][2] = None
    lost = {("c3", 10), ("c3", 11)}
    kept = [r for k, r in by.items() if k not in lost]
    rng.shuffle(kept)
    late = {id(r): min(3, (r[1] - 1 + rng.randint(0, 6)) // 9) for r in kept}
    for i in range(4):
        spark.createDataFrame([r for r in kept if late[id(r)] == i], log.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", chains.STORE)
    try:
        for last in (2, 4):  # half of the files, then all, on one checkpoint
            stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/[0-{last - 1}]")
            found = chains.faults(stream, "chain", "place", "value", patience=12)
            found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {tuple(r) for r in spark.read.schema(chains.FAULTS).parquet(f"{tmp_path}/out").collect()}
    batch = {(r["chain"], r["place"]) for r in contracts.tampered(spark.createDataFrame(list(map(tuple, by.values())), log.schema), ["chain"], "place", "value").collect()}
    assert {(c, p) for c, p, what in got if c != "c3"} == {k for k in batch if k[0] != "c3"} and ("c0", 7, "changed") in got and ("c2", 30, "changed") in got
    assert {(c, p, what) for c, p, what in got if c == "c3"} == {("c3", 10, "missing"), ("c3", 11, "missing"), ("c3", 12, "unlinked")}
