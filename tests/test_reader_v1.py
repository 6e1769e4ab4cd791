"""The first reader version against plain Python, and how its work is dealt."""

import random
import re

import pytest

from gapweave.operators import reader, reader_v1
from gapweave.plans import queries, views
from tests.oracle import DATA
from tests.test_engine import frame


def plain_kpis(calls, gaps, bases, names):
    """The counts of the first reader version, position by position."""
    own, out = {(s, x) for p, s, a, b in gaps if p == "gt" for x in range(a, b)}, {}
    anyone = {x for _, x in own}
    at = {}
    for p, s, x, a in calls:
        at.setdefault((p, x), []).append((s, a))
    n = {p: len({s for q, s, _, _ in calls if q == p} - {None}) for p in names}
    core = {p: {x for (q, x), c in at.items() if q == p and x in bases and len({s for s, _ in c} - {None}) == n[p]} for p in names}
    same = {p: {x for x in core[p] if len({a for _, a in at[p, x]} - {None}) == 1 and all(a != bases[x] for _, a in at[p, x])} for p in names}
    truth = {(s, x) for p, s, x, _ in calls if p == "gt" and s is not None and x is not None}
    for p in names:
        mine = [c for c in calls if c[0] == p]
        called = sum((s, x) in truth for _, s, x, _ in mine)
        versus = [sum(c[0] == "gt" for c in calls) - called, called, len(core["gt"] - core[p]), len(same["gt"] - same[p]), sum((s, x) in own for _, s, x, _ in mine), len(core[p] & anyone), len(same[p] & anyone)]
        plain = [sum(x in bases and a is not None and a != bases[x] for _, _, x, a in mine), sum(b - a for q, _, a, b in gaps if q == p), len(core[p]), len(same[p])]
        out[p] = (p, *plain, *(versus if p != "gt" else [None] * 7))
    return sorted(out.values())


@pytest.mark.parametrize("parts", [None, 3])
def test_v1_kpis_plain(spark, parts):
    """Borders of bins, long and repeated gaps, repeated calls, calls off the reference or without sample, position or allele."""
    rng = random.Random(11)
    names = ["gt", "p1", "p2", "none"]
    spots = [-3, -1, 0, 1, *range(505, 520), *range(1020, 1030), 3000]
    bases = {x: "ACGT"[x % 4] for x in spots if x != 3000}
    calls = [(rng.choice(names[:3]), rng.choice(["S0", "S1"]), rng.choice(spots), rng.choice("ACGT")) for _ in range(300)]
    calls += [(p, s, x, "ACGT"[(x + 1) % 4]) for p in names[:3] for s in ("S0", "S1") for x in (5000, 5001, 5600)] + [("p1", None, 511, "A"), ("gt", None, 511, "A"), ("p2", "S1", None, "A"), ("gt", "S1", None, "A"), ("p2", "S0", 512, None)]
    bases |= {x: "ACGT"[x % 4] for x in (5000, 5001, 5600)}
    gaps = [("gt", "S0", -2, 1), ("gt", "S0", 510, 512), ("gt", "S0", 510, 511), ("gt", "S1", 1022, 5001), ("gt", "S1", 1024, 1025), ("p1", "S0", 0, 600)] * 2
    args = frame(spark, calls, "pipeline string, sample string, pos long, alt string"), frame(spark, gaps, "pipeline string, sample string, start long, end long"), frame(spark, list(bases.items()), "pos long, base string"), frame(spark, [(p,) for p in names], "pipeline string")
    got = sorted(map(tuple, reader_v1.kpis(*args, "gt", parts=parts).collect()))
    assert got == plain_kpis(calls, gaps, bases, names)
    assert any(r[4] for r in got) and any(r[-1] for r in got)


def test_v1_kpis_calls_move_once(spark):
    """Memory of a task is bounded as calls, gaps and reference are dealt once, to parts whose number grows with the table."""
    v = views.Views(spark, DATA)
    v._lines = 13 * views.LARGEST_PART - 1
    df = queries.v1_kpis(v)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search("SortMergeJoin|ShuffledHashJoin", final)
    # One by their number for calls, gaps and reference each; none after it holds calls.
    assert len(re.findall(r"Exchange hashpartitioning\(bin#\d+L?, 13\)", final)) == 3
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bpos#", final)


@pytest.mark.parametrize("parts", [None, 3])
def test_kpi_totals_plain(spark, parts):
    """The truth's totals are its counts among those by pipeline; repeated calls count each, and no call leaves zeros."""
    calls = [("gt", s, x, "ACGT"[(x + 1) % 4]) for s in ("S0", "S1") for x in (511, 512, 600)] + [("gt", "S0", 512, "A"), ("gt", "S1", 700, "G"), ("gt", None, 600, "C"), ("gt", "S0", 9000, "A"), ("gt", "S1", 9000, "A"), ("p1", "S2", 511, "T")]
    bases = {x: "ACGT"[x % 4] for x in (511, 512, 600, 700)}
    ref, names = frame(spark, list(bases.items()), "pos long, base string"), frame(spark, [("gt",), ("p1",)], "pipeline string")
    samples = frame(spark, [("S0",), ("S1",), ("S2",)], "sample string")
    df = frame(spark, calls, "pipeline string, sample string, pos long, alt string")
    want = plain_kpis(calls, [], bases, ["gt", "p1"])[0]
    got = reader.kpi_totals(df, ref, samples, names, "gt", 1000, parts=parts)
    assert [tuple(r) for r in got.collect()] == [(11, want[3], want[4], 3, 2, 1000)]
    assert want[3] == 3 and want[4] == 2
    none = reader.kpi_totals(df.where("pipeline = 'p1'"), ref, samples, names, "gt", 1000, parts=parts)
    assert [tuple(r) for r in none.collect()] == [(0, 0, 0, 3, 2, 1000)]
