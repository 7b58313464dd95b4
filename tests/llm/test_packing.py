import random

import pytest

from talkgrid.llm.packing import fill_report, pack, plan, tier_report
from tests.helpers import rows


def test_plan_uses_every_piece():
    r = random.Random(1)
    for _ in range(60):
        cap = r.randint(1, 60)
        hist = {r.randint(1, cap): r.randint(1, 50) for _ in range(r.randint(0, 20))}
        used = {}
        for tier, filling, times in plan(hist, cap):
            assert times > 0 and sum(s * n for s, n in filling) <= cap >> tier
            for s, n in filling:
                used[s] = used.get(s, 0) + n * times
        assert used == hist
    with pytest.raises(ValueError):
        plan({5: 1}, 4)


def test_pack(spark):
    r = random.Random(2)
    data = [(i, r.choice([None, 0, -1, 3, 7, 50, 64, 100, 101, 250, r.randint(1, 99)])) for i in range(3000)] + [(9000 + i, 40) for i in range(1500)]
    df = spark.createDataFrame(data, "id long, n int")
    got = pack(df, "id", "n", 100, group=8).collect()
    by, want = {}, {i: n for i, n in data if n and n > 0}
    total = {}
    for p in got:
        by.setdefault(p.container, []).append(p)
        total[p.id] = total.get(p.id, 0) + p.size
        assert want[p.id] > 100 or p.piece_no == 0 and p.item_from == 0
    assert total == want and sorted(by) == list(range(len(by)))
    for ps in by.values():
        ps.sort(key=lambda p: p.offset)
        assert all(a.offset + a.size <= b.offset for a, b in zip(ps, ps[1:])) and ps[-1].offset + ps[-1].size <= 100
        assert len({p.step_group for p in ps}) == 1
    groups = {}
    for c, ps in by.items():
        groups.setdefault(ps[0].step_group, set()).add(c)
    assert max(map(len, groups.values())) <= 8
    for p in got:
        assert p.window_tier <= p.tier and p.window_from <= p.offset and p.offset + p.size <= p.window_from + (100 >> p.window_tier)
        assert p.window_from % (100 >> p.window_tier) == 0
    made = spark.createDataFrame(got)
    report = rows(fill_report(made, 100))[0]
    assert report[3] > 0.9
    tiers = tier_report(made, 100).collect()
    assert sum(t.used for t in tiers) == report[1] and sum(t.pieces for t in tiers) == len(got) and any(t.from_shorter for t in tiers)
    assert rows(pack(df.limit(0), "id", "n", 100)) == []
