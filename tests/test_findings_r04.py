"""Cases of the findings of round 4."""

import time
from io import BytesIO
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.serializers import CPickleSerializer
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.map_state_client import MapStateClient
from pyspark.sql.streaming.stateful_processor import MapState
from pyspark.sql.streaming.stateful_processor_api_client import StatefulProcessorApiClient

from assethealth.llm import shared, simhash
from assethealth.streaming import asset_stream


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    before, setting = shuffle_files(spark), spark.conf.get(shared.RELEASED)
    rows = spark.range(10_000).withColumn("k", F.col("id") % 100)
    first = shared.written(rows.groupBy("k").agg(F.count("*").alias("n")), "counted")
    both = shared.written(rows.join(first.hint("merge"), "k").groupBy("n").agg(F.sum("id").alias("total")), "joined")
    for _ in range(50):  # files go on another thread
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert [tuple(r) for r in both.collect()] == [(100, 49_995_000)]
    assert spark.conf.get(shared.RELEASED) == setting


class Wire(BytesIO):
    """What a state's client sends, and how often it does."""

    flushes = 0

    def flush(self):
        self.flushes += 1


class Client(StatefulProcessorApiClient):
    """Spark's client of a state server that answers ``status`` to everything."""

    def __init__(self, status=0):
        self.sockfile, self.pickleSer, self.status = Wire(), CPickleSerializer(), status

    def _receive_proto_message(self):
        return self.status, "refused", b""


def map_state(client):
    schemas = (T.StructType([T.StructField("event_id", T.StringType())]), T.StructType([T.StructField("arrival", T.LongType())]))
    return MapState(MapStateClient(client, *schemas), "ids")


def test_a_map_state_takes_many_entries_for_one_answer():
    entries = [((f"evt-{i}",), (i * 1_000_000_007,)) for i in range(150)]
    one, many = Client(), Client()
    for key, value in entries:
        map_state(one).updateValue(key, value)
    asset_stream._put_all(map_state(many), entries)
    assert many.sockfile.getvalue() == one.sockfile.getvalue()
    assert (one.sockfile.flushes, many.sockfile.flushes) == (150, 3)
    with pytest.raises(Exception, match="refused"):
        asset_stream._put_all(map_state(Client(status=1)), entries)
    taken = {}
    asset_stream._put_all(SimpleNamespace(updateValue=taken.__setitem__), entries)  # a state of another kind
    assert list(taken.items()) == entries


def test_statistics_of_all_frames_at_once_are_those_of_each():
    r = np.random.default_rng(5)
    frames = [[tuple(x) for x in r.normal(50, 9, (n, 4))] for n in (1, 2, 3, 9, 30)] + [[(1.0, 2.0, 3.0, 4.0)] * 2]
    times = [sorted(r.integers(0, 30_000_000, len(f)).tolist()) for f in frames[:-1]] + [[7, 500]]  # the last two are within a millisecond
    lone = [(np.nan, np.nan, 1.0, 1.0)]
    each = asset_stream._statistics([*times, [5]], [*frames, lone])  # a missing value: each by itself
    assert each[-1][:4] == [1, None, 0.0, None] and each[-1][-3:] == [None, 0.0, 0.0]
    whole = asset_stream._statistics(times, frames)
    assert len(whole) == 6 and all(a == pytest.approx(b, rel=1e-12, abs=1e-12) for a, b in zip(whole, each, strict=False))
    assert whole[0][0] == 1 and whole[5][-2:] == [0.0, 0.0] and whole[4][-1] != 0


def test_summaries_of_all_windows_at_once_are_those_of_each():
    r = np.random.default_rng(6)
    panes = [[(int(t), i, *r.normal(50, 9, 3).tolist(), int(r.integers(2))) for i, t in enumerate(r.integers(0, 5_000_000, n))] for n in (1, 2, 5, 12)]
    each = asset_stream._summaries([*panes, [(1, 1, 5.0, None, 5.0, 1)]])
    assert each[-1] == [1, 5.0, 0.0, 0.0, None, None, 0.0, 5.0, 0.0, 1]
    whole = asset_stream._summaries(panes)
    assert all(a == pytest.approx(b, rel=1e-12, abs=1e-12) for a, b in zip(whole, each, strict=False)) and len(whole) == 4


def test_wide_maps_tell_large_sets_apart_and_lose_no_pair(spark):
    r = np.random.default_rng(7)
    pool = r.integers(-(1 << 62), 1 << 62, 40_000)
    sets = {0: pool[:5000], 1: pool[5000:10_000], 2: np.concatenate((pool[:4500], pool[10_000:10_500])), 3: pool[20_000:24_000], 4: pool[20_000:24_900], 5: pool[:900], 6: pool[100:1024]}
    assert len(simhash.wide_map(sets[0])) * 64 == 8192 and len(simhash.wide_map(sets[3])) * 64 == 4096 and simhash.wide_map(sets[6]) is None
    wide = simhash.wide_map(sets[4])
    assert (wide[:64] ^ wide[64:]).tolist() == simhash.parity_map(sets[4], 4096).tolist()

    def lists(x):
        return None if x is None else x.tolist()

    known = spark.createDataFrame([(k, len(v), lists(simhash.parity_map(v)), lists(simhash.wide_map(v))) for k, v in sets.items()], "id long, n long, parity array<long>, wide array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 4), (5, 6)], "a long, b long")
    assert {tuple(x) for x in simhash.possible_by_wide(pairs, known, 0.8).collect()} == {(0, 2), (3, 4), (5, 6)}

    def left(of):
        block = known.select("id", F.array(F.struct(F.col("id").alias("label"), "n", F.expr(of).alias("parity"))).alias("members"))
        both = pairs.join(block.select(F.col("id").alias("a"), F.col("members").alias("one")), "a").join(block.select(F.col("id").alias("b"), F.col("members").alias("two")), "b")
        return {tuple(x) for x in simhash.possible_blocks(both.withColumnsRenamed({"a": "block_a", "b": "block_b"}), 0.8).collect()}

    assert left("parity") == {(0, 1), (0, 2), (1, 2), (3, 4), (5, 6)}  # what the small maps leave open
    assert left("coalesce(wide, parity)") == {(0, 2), (3, 4), (5, 6)}
