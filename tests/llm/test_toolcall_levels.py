import random

import pytest

from ledgerline.llm import toolcalls

CALLS, WAITS = "conv_id bigint, call_id string, turn bigint, pos int", "conv_id bigint, call_id string, after string"


def plain_levels(calls, waits):
    """Longest chain of waits; None for cycles and what waits on them."""
    on = {(v, c): {(v, b) for w, a, b in waits if (w, a) == (v, c) and (v, b) in {x[:2] for x in calls}} for v, c, _, _ in calls}
    level = {}
    while ready := [k for k in on if k not in level and all(b in level for b in on[k])]:
        level |= {k: max((level[b] + 1 for b in on[k]), default=0) for k in ready}
    return {k: level.get(k) for k in on}


def test_levels_equal_plain_ones(spark):
    rng, calls, waits = random.Random(4), [], []
    for conv in range(30):  # sparse to dense, waits in both directions, cycles, waits for itself and for nothing known
        calls += [(conv, f"c{k}", k // 2, k % 2) for k in range(10)]
        for k in range(10):
            for _ in range(rng.randrange(1 + conv % 4)):
                j = rng.randrange(k) if k and rng.random() < 0.85 else rng.randrange(11)
                waits.append((conv, f"c{k}", f"c{j}"))
    got = toolcalls.levels(spark.createDataFrame(calls, CALLS), spark.createDataFrame(waits, WAITS)).collect()
    want = plain_levels(calls, waits)
    assert len(got) == len(want) and {(r.conv_id, r.call_id): r.level for r in got} == want
    assert None in want.values() and max(v or 0 for v in want.values()) > 2


def test_long_chain_needs_no_round_a_link(spark):
    calls = [(1, f"c{k}", k, 0) for k in range(300)] + [(1, "early", 0, 1)]
    waits = [(1, f"c{k}", f"c{k - 1}") for k in range(1, 300)] + [(1, f"c{k}", f"c{k - 2}") for k in range(2, 300, 3)] + [(1, "early", "c299")]
    got = toolcalls.levels(spark.createDataFrame(calls, CALLS), spark.createDataFrame(waits, WAITS), max_rounds=1).collect()
    assert {r.call_id: r.level for r in got} == {"early": 300, **{f"c{k}": k for k in range(300)}}


def test_too_many_rounds_are_an_error(spark):
    calls = [(1, f"c{k}", 9 - k, 0) for k in range(6)]  # forward waits, two each
    waits = [(1, f"c{k}", f"c{k - d}") for k in range(2, 6) for d in (1, 2)]
    with pytest.raises(ValueError, match="max_rounds"):
        toolcalls.levels(spark.createDataFrame(calls, CALLS), spark.createDataFrame(waits, WAITS), max_rounds=2)
