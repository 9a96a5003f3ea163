"""Repeated events, also in long chains, against a plain loop; components against union by hand."""

import random

from pyspark.sql import functions as F

from assethealth.operators import graph, quality


def plain(rows):
    """Events in order of arrival: what each repeats of the valid ones before it."""
    ids, slots, out = set(), set(), {}
    for arrival, sound, own, slot in sorted(rows):
        twice = (own is not None and own in ids, slot is not None and slot in slots)
        if any(twice):
            out[arrival] = twice
        elif sound:
            ids.add(own)
            slots.add(slot)
    return out


def judged(spark, rows):
    """Rows as ``repeats`` reads them: a slot is an asset and a time."""
    made = [(a, s, i, "STRING" if i is not None else None, "asset" if t is not None else "", float(t or 0), ["x"]) for a, s, i, t in rows]
    return spark.createDataFrame(made, "arrival long, sound boolean, event_id string, k_event_id string, asset_id string, timestamp double, keys array<string>")


def found(spark, rows):
    return {r.arrival: (r.again_id, r.again_time) for r in quality.repeats(judged(spark, rows)).collect()}


def test_a_chain_of_ten_thousand_takes_a_fixed_number_of_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for n in (400, 10_000):
        # event i shares its id with i + 1 if i is even and its time if i is odd
        rows = [(i, True, f"e{i // 2}", (i + 1) // 2 + 1) for i in range(n)]
        spark.sparkContext.setJobGroup(f"chain-{n}", "")
        assert found(spark, rows) == plain(rows)
        jobs[n] = len(tracker.getJobIdsForGroup(f"chain-{n}"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[10_000] <= 2 * jobs[400]  # chains 25 times as long


def test_repeats_in_random_order_with_a_common_id(spark):
    r = random.Random(7)
    for seed in range(3):
        rows = [(i, r.random() < 0.8, r.choice([None, "hot", f"e{r.randrange(60)}"]), r.choice([None, r.randrange(1, 80)])) for i in range(500)]
        assert found(spark, rows) == plain(rows), seed


def test_no_events_and_no_repeats(spark):
    assert found(spark, []) == {} and found(spark, [(1, True, "a", 1), (2, True, "b", 2)]) == {}


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    for n, m in ((60, 40), (400, 380), (3000, 2600)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        label = list(range(n))
        while True:
            old = list(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if old == label:
                break
        got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
        assert {x.node: x.label for x in got} == {x: label[x] for e in edges for x in e} and len(got) == len({x for e in edges for x in e})


def test_components_of_a_shuffled_chain(spark):
    nodes = list(range(2000))
    random.Random(1).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long")
    assert graph.components(edges).select("label").distinct().collect() == [(0,)]
    assert graph.components(edges.where("false")).count() == 0 and graph.components(edges.where(F.lit(True)).limit(1)).count() == 2
