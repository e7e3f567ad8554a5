from collections import Counter

import pytest

from chronoledger.llm import mixing

from .fixtures import clashing, corpus, frame, table


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 1, "c": 1, "d": 1}, {f"s{i}": i + 1 for i in range(20)}])
def test_every_prefix_is_within_one_block_of_its_target(weights):
    total = sum(weights.values())
    order = mixing.period(weights) * 2
    had = Counter()
    for t, s in enumerate(order, 1):
        had[s] += 1
        for name, w in weights.items():
            assert abs(had[name] * total - t * w) < total
    assert Counter(order) == {s: 2 * w for s, w in weights.items()}


def test_phases_place_every_block_once_and_keep_the_rest_in_proportion():
    weights, blocks = {"a": 5, "b": 3, "c": 2}, {"a": 7, "b": 20, "c": 1}
    plan = mixing.phases(weights, blocks)
    slots = {}
    for i, p in enumerate(plan):
        for s in p["first"]:
            later = [q["first"][s] for q in plan[i + 1 :] if s in q["first"]]
            until = later[0] if later else blocks[s]
            for k in range(p["first"][s], until):
                j = k - p["first"][s]
                slots[s, k] = p["start"] + j // weights[s] * len(p["order"]) + p["places"][s][j % weights[s]]
    assert sorted(slots.values()) == list(range(sum(blocks.values())))
    assert all(slots[s, k] < slots[s, k + 1] for s, k in slots if (s, k + 1) in slots)


def test_mixture_of_a_table(spark, tmp_path):
    rows = corpus() + corpus()[:9]
    weights = {"src0": 3, "src1": 2, "src2": 1}
    got = mixing.mix(table(clashing(spark, rows), tmp_path), weights, 500, other=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.block == r.start_byte // 500 and (r.source in weights or r.source == mixing.OTHER)
    blocks = {}
    for s, own in by.items():
        own.sort(key=lambda r: r.start_byte)
        at = 0
        for r in own:  # the stream has no hole and no overlap
            assert r.start_byte == at
            at += r.size
        blocks[s] = -(-at // 500)
    seen = {(r.source, r.block): r.slot for r in got}
    assert len(set(seen.values())) == len(seen) and max(seen.values()) < sum(blocks.values())
    first = [p["start"] for p in mixing.phases({**weights, mixing.OTHER: 2}, blocks)]
    limit = first[1] if len(first) > 1 else sum(blocks.values())
    for (s, b), slot in seen.items():  # release and deadline in the first phase
        if slot < limit:
            w = {**weights, mixing.OTHER: 2}[s]
            assert b * 8 // w <= slot < -(-(b + 1) * 8 // w)


def scheduled(weights, blocks):
    """(source, block) of each slot, slot by slot: of the blocks that are released
    the one due first.  When a source ends the others begin anew."""
    done, out = dict.fromkeys(weights, 0), []
    while any(done[s] < blocks.get(s, 0) for s in weights):
        live = [s for s in weights if done[s] < blocks.get(s, 0)]
        total, since, t = sum(weights[s] for s in live), dict.fromkeys(live, 0), 0
        while all(done[s] < blocks[s] for s in live):
            ready = [s for s in live if since[s] * total // weights[s] <= t]
            s = min(ready, key=lambda s: (-(-(since[s] + 1) * total // weights[s]), live.index(s)))
            out.append((s, done[s]))
            done[s] += 1
            since[s] += 1
            t += 1
    return out


def test_slots_are_those_of_a_slot_by_slot_schedule(spark, tmp_path):
    rows = corpus(240, seed=8)
    weights = {"src0": 5, "src1": 3, "src2": 1}
    got = mixing.mix(table(frame(spark, rows), tmp_path), weights, 700, other=2).collect()
    size = Counter()
    for _, t, s in rows:
        size[s if s in weights else mixing.OTHER] += len((t or "").encode()) + 1
    want = {place: slot for slot, place in enumerate(scheduled({**weights, mixing.OTHER: 2}, {s: -(-b // 700) for s, b in size.items()}))}
    assert len(got) == len(rows) and all(want[r.source, r.block] == r.slot for r in got)


def test_order_keeps_rows_and_columns(spark, tmp_path):
    rows = corpus()
    docs = table(clashing(spark, rows), tmp_path)
    out = mixing.in_mixed_order(docs, {"src0": 1, "src1": 1}, 500)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(k for k, _, _ in rows)
    place = {r.doc_id: (r.slot, r.start_byte) for r in mixing.mix(docs, {"src0": 1, "src1": 1}, 500).collect()}
    order = [place[r.doc_id] for r in out.coalesce(1).collect()]
    assert order == sorted(order)


def test_empty_table_and_bad_weights(spark, tmp_path):
    assert mixing.mix(table(frame(spark, []), tmp_path), {"a": 1}, 10).count() == 0
    for bad in ({"a": 0}, {"a": mixing.MAX_PERIOD + 1}):
        with pytest.raises(ValueError):
            mixing.period(bad)
