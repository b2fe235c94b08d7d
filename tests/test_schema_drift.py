import datetime as dt
import itertools
import random
import time

import numpy as np

from conftest import rows
from kinetra.operators import schema_drift as drift_module
from kinetra.operators.schema_drift import GROUP, Leaf, cheapest_pairs, consistent_readings, edit_script, schema_drift, tree_edit, tree_of

SCHEMA = "file_id bigint, campaign_id bigint, recorded_at timestamp, line_no int, raw_line string"
Q = {"q1": 0.11, "q2": -0.52, "q3": 0.33, "q4": 0.74, "t1": 150.0, "t2": -420.0, "t3": 88.0}


def leaves(body, shift=0.0, roles=Q):
    return [Leaf(f"{body}_{r}", "decimal", v + shift, False) for r, v in roles.items()]


def best_total(cost):
    """Brute force over all ways to pair rows with columns or leave them alone."""
    n, m = len(cost), len(cost[0])
    return min(sum(cost[i][j] - 2 for i, j in enumerate(p) if j is not None) for p in set(itertools.permutations([*range(m), *[None] * n], n)))


def test_cheapest_pairs_is_optimal():
    r = random.Random(4)
    for _ in range(60):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        cost = [[r.choice([r.random() * 2, r.random() * 3, 9.0]) for _ in range(m)] for _ in range(n)]
        pairs = cheapest_pairs(cost)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert abs(sum(cost[i][j] - 2 for i, j in pairs) - best_total(cost)) < 1e-9
    assert cheapest_pairs([]) == []


def test_many_fields_are_assigned_in_time():
    r = random.Random(1)
    old = [Leaf(f"f{i}_x", "decimal", 10.0 * i + 10, False) for i in range(300)]
    new = [Leaf(f"g{i}_x", "decimal", 10.0 * i + 10.1, False) for i in range(300)]
    r.shuffle(new)
    began = time.perf_counter()
    found = edit_script(old, new)
    assert {(a, b.replace("g", "f")) for _, a, b in found} == {(x.name, x.name) for x in old}
    assert time.perf_counter() - began < 20


def random_tree(r):
    """A tree of up to 3 groups with up to 3 fields, as the groups of its fields."""
    words = ["a", "b", "c"]
    groups = [()]
    for _ in range(r.randrange(3)):
        groups.append((*r.choice(groups), r.choice(words)))
    return [r.choice(groups) for _ in range(r.randrange(1, 4))]


def brute_tree_edit(old, new, cost):
    """The best saving over all mappings that keep ancestors, and keep apart what lies apart."""

    def nodes(root):
        out = []

        def walk(node, above):
            me = (node.words, None)
            out.append((me, above))
            for i in node.leaves:
                out.append(((node.words, i), (*above, me)))
            for k in node.kids:
                walk(k, (*above, me))

        walk(root, ())
        return out

    xs, ys = nodes(old), nodes(new)

    def lca(a, b):
        """The line down to the lowest common ancestor (itself included)."""
        la, lb = (*a[1], a[0]), (*b[1], b[0])
        k = 0
        while k < min(len(la), len(lb)) and la[k] == lb[k]:
            k += 1
        return la[:k]

    def fits(pairs):
        for (a, x), (b, y), (c, z) in itertools.product(pairs, repeat=3):
            if (a[0] in b[1]) != (x[0] in y[1]) or (lca(a, b)[-1] in c[1]) != (lca(x, y)[-1] in z[1]):
                return False
        return True

    def saved(a, x):
        if a[0][1] is not None:
            return cost[a[0][1]][x[0][1]] - 2
        return -2 * GROUP if a[0][0][-1:] == x[0][0][-1:] else -GROUP

    best = 0.0

    def grow(i, pairs, free, total):
        nonlocal best
        if i == len(xs):
            best = min(best, total)
            return
        grow(i + 1, pairs, free, total)
        for y in free:
            if (y[0][1] is None) == (xs[i][0][1] is None):
                more = [*pairs, (xs[i], y)]
                if fits(more):
                    grow(i + 1, more, [f for f in free if f is not y], total + saved(xs[i], y))

    grow(1, [(xs[0], ys[0])], ys[1:], 0.0)
    return best


def test_tree_edit_is_the_cheapest_script():
    r = random.Random(7)
    for _ in range(250):
        old, new = random_tree(r), random_tree(r)
        cost = np.array([[r.choice([0.1, r.random() * 2, 3.0]) for _ in new] for _ in old])
        trees = tree_of(old), tree_of(new)
        assert abs(tree_edit(*trees, cost)[0] - brute_tree_edit(*trees, cost)) < 1e-9, (old, new, cost)


def renames(old, new, *names):
    return {(a, b) for _, a, b in edit_script(old, new, *names)}


HEADER = [f"{b}_{r}" for b in ("A_F_MID", "A_T_MEP") for r in Q]


def test_scripts():
    other = leaves("C_F_PRO", 0.05, {r: -v for r, v in Q.items()})
    assert renames(leaves("A_F_MID"), [*leaves("K_474"), *other]) == {(f"A_F_MID_{r}", f"K_474_{r}") for r in Q}
    assert renames(leaves("A_T_MEP"), leaves("A_T_MEPX", 0.3)) == set()
    assert renames([Leaf("A_F_MID_q3", "decimal", 0.33, False)], [Leaf("marker75.j", "decimal", 0.331, False)]) == {("A_F_MID_q3", "marker75.j")}
    assert renames([Leaf("A_F_MID_q3", "decimal", 0.33, False)], [Leaf("ch1", "integer", 330.0, False)]) == {("A_F_MID_q3", "ch1")}
    assert renames([Leaf("utc_epoch_ms", "integer", 1.8e12, True)], [Leaf("stamp", "datetime", 2028.0, True)]) == {("utc_epoch_ms", "stamp")}
    assert renames([Leaf("A_F_MID_q3", "decimal", 0.33, False)], [Leaf("A_F_MID_res", "decimal", 0.331, False)]) == set()
    unseen = [Leaf(f"A_T_MEP_{r}", None, None, False) for r in Q]
    assert len(renames(unseen, [Leaf(f"T_MEP_{r}", None, None, False) for r in Q])) == 7
    assert renames(unseen, leaves("C_T_DIS")) == set()
    # a label that both headers use for parts is no other part, whatever the values say
    assert renames([Leaf("A_F_MID_q3", "decimal", 0.33, False)], [Leaf("K_9_q4", "decimal", 0.33, False)], HEADER, [*HEADER, "K_9_q4"]) == set()


def test_moves_and_nesting():
    deep = [("knee", "left", "femur"), ("knee", "left", "tibia"), ("knee", "right")]
    root = tree_of(deep)
    assert [k.words for k in root.kids] == [("knee",)] and {k.words for k in root.kids[0].kids} == {("knee", "left"), ("knee", "right")}
    old = [Leaf(f"knee_left_femur_{p}", "decimal", v, False) for p, v in (("ax", 1e3), ("ay", 2e3), ("az", 3e3))] + [Leaf(f"knee_left_tibia_{p}", "decimal", v, False) for p, v in (("ax", 4e3), ("ay", 5e3), ("az", 6e3))]
    new = [Leaf(f"knee_right_femur_{p}", "decimal", v, False) for p, v in (("ax", 1e3), ("ay", 2e3), ("az", 3e3))] + [Leaf(f"rig_7_{p}", "decimal", v, False) for p, v in (("ax", 4e3), ("ay", 5e3))]
    found = edit_script(old, [*new, Leaf("spare", "decimal", 6e3, False)])
    assert {(a, b) for _, a, b in found} == {(f"knee_left_femur_{p}", f"knee_right_femur_{p}") for p in ("ax", "ay", "az")} | {(f"knee_left_tibia_{p}", f"rig_7_{p}") for p in ("ax", "ay")} | {("knee_left_tibia_az", "spare")}
    assert ("move", "knee_left_tibia_az", "spare") in found


def lines(files):
    out = []
    for n, (file_id, text) in enumerate(files):
        out += [(file_id, 1, dt.datetime(2028, 1, 1 + n), i, line) for i, line in enumerate(text.split("\n"), 1)]
    return out


FILES = [
    (30, "# log\n﻿utc_epoch_ms;A_F_MID_q1;A_F_MID_t1;note\n1841670173946;0,612;150,20;\n1841670174946;0,613;150,30;NaN"),
    (10, '"utc_epoch_ms","A_F_MID_q1","A_F_MID_t1"\n1841670173946,0.612,150'),
    (20, "utc_epoch_ms\tch01\tA_F_MID_t1\textra\n2028-05-11T15:02:53.946Z\t612\tnull\t1"),
    (40, "utc_epoch_ms,ch01,A_F_MID_t1,extra\n2028-05-11T15:02:54.946Z,0.612,150.1 mm,2"),
]
WANT = [
    (10, "removed", "note", ""), (10, "retyped", "A_F_MID_t1", "A_F_MID_t1"), (20, "added", "", "extra"), (20, "renamed", "A_F_MID_q1", "ch01"), (20, "retyped", "A_F_MID_q1", "ch01"),
    (20, "retyped", "utc_epoch_ms", "utc_epoch_ms"), (40, "retyped", "A_F_MID_t1", "A_F_MID_t1"), (40, "retyped", "ch01", "ch01"),
]


def test_report_and_readings(spark):
    data = lines(FILES)
    data = data[::-1] + data[:3] + [(None, 1, None, 1, "x"), (30, 1, dt.datetime(2028, 1, 1), None, "y"), (50, 2, None, 1, "   "), (60, 1, None, 1, None)]
    df = spark.createDataFrame(data, SCHEMA + "")
    drift = schema_drift(df)
    assert rows(drift.changes) == sorted(WANT, key=repr)
    got = consistent_readings(df, drift, {"utc_epoch_ms": "ms", "A_F_MID_q1": "double", "A_F_MID_t1": "double"})
    values = {(r.file_id, r.line_no): (r.utc_epoch_ms, round(r.A_F_MID_q1, 3), r.A_F_MID_t1, dict(r.others)) for r in got.collect()}
    assert values == {
        (30, 3): (1841670173946, 0.612, 150.2, {}), (30, 4): (1841670174946, 0.613, 150.3, {}), (10, 2): (1841670173946, 0.612, 150.0, {}),
        (20, 2): (1841670173946, 0.612, None, {"extra": "1"}), (40, 2): (1841670174946, 0.612, 150.1, {"extra": "2"}),
    }


def test_empty_and_starts_anew_after_removal(spark):
    assert schema_drift(spark.createDataFrame([], SCHEMA)).changes.count() == 0
    files = [(1, "a,b\n1,x"), (2, "a\n1"), (3, "a,b\n1,2"), (4, "a,b\n,3")]
    got = schema_drift(spark.createDataFrame(lines(files), SCHEMA)).changes
    assert rows(got) == [(2, "removed", "b", ""), (3, "added", "", "b")]


def test_fields_outside_the_columns_have_one_type_and_scale(spark):
    """Integer thousandths, decimal commas, units and times of any field come out as in the neighbouring files."""
    files = [
        (1, "utc_epoch_ms;B_N_STY_q1;B_N_STY_t1;note;start\n1841670173946;0,612;150,2;3;2028-05-11T15:02:53.946Z"),
        (2, "utc_epoch_ms,B_N_STY_q1,B_N_STY_t1,note,start\n1841670174946,612,150.3 mm,all seen,1841670174946"),
        (3, "utc_epoch_ms,B_N_STY_q1,B_N_STY_t1,note,start\n1841670175946,612,lost,all seen,1841670175946"),
    ]
    files += [(4, "utc_epoch_ms,B_N_STY_q1,B_N_STY_t1,note,start\n1841670176946,~0.612,(mm 150.3),all seen,1841670176946")]
    other = [(9, 2, dt.datetime(2028, 1, 1), i, line) for i, line in enumerate(("utc_epoch_ms;B_N_STY_q1;B_N_STY_q2", "1841670173946;31;-702"), 1)]
    df = spark.createDataFrame(lines(files) + other, SCHEMA)
    got = {r.file_id: r for r in consistent_readings(df, schema_drift(df), {"utc_epoch_ms": "ms"}).collect()}
    assert got[1].numbers == {"B_N_STY_q1": 0.612, "B_N_STY_t1": 150.2} and got[1].texts == {"note": "3"}
    assert got[2].numbers == {"B_N_STY_q1": 0.612, "B_N_STY_t1": 150.3} and got[2].texts == {"note": "all seen"}
    assert got[3].numbers == {"B_N_STY_q1": 0.612} and got[3].texts == {"B_N_STY_t1": "lost", "note": "all seen"}
    assert got[4].numbers == {"B_N_STY_q1": 0.612, "B_N_STY_t1": 150.3}
    assert [got[i].times for i in (1, 2, 3, 4)] == [{"start": 1841670172946 + 1000 * i} for i in (1, 2, 3, 4)]
    assert got[9].numbers == {"B_N_STY_q1": 0.031, "B_N_STY_q2": -0.702}  # no decimal file in the lineage


def test_blocks_of_files_change_nothing(spark, monkeypatch):
    """A campaign of many files (null campaign): names and types go on from block to block."""
    r, files = random.Random(5), []
    for i in range(40):
        name = f"ch{i // 7:02d}5"
        value = "" if i % 5 == 2 else "0.61" if i % 11 else "610"
        files.append((1000 - i, f"utc_epoch_ms,A_F_MID_q2,{name}\n{1841670173946 + i},{0.1 + i / 1e4:.4f},{value}"))
    data = [(f, None, t, n, x) for f, _, t, n, x in lines([(f, t) for f, t in files][:11])]
    data += [(f, None, dt.datetime(2028, 2, 1 + k // 24, k % 24, n), n, x) for k, (f, t) in enumerate(files[11:]) for n, x in enumerate(t.split("\n"), 1)]
    r.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA)
    whole = rows(schema_drift(df).changes)
    monkeypatch.setattr(drift_module, "BLOCK_FILES", 3)
    assert rows(schema_drift(df).changes) == whole
    assert sum(x[1] == "renamed" for x in whole) == 4 and sum(x[1] == "retyped" for x in whole) > 4


def test_changes_join_nothing_that_is_broadcast_for_its_small_files(spark):
    lines = [(f, 1, dt.datetime(2024, 1, f), n, t) for f in (1, 2, 3) for n, t in enumerate((";".join(f"{b}_{p}" for b in ("A", "B" if f < 3 else "C") for p in Q), *[";".join(str(v + i) for i in (0, 50) for v in Q.values())] * 3), 1)]
    changes = schema_drift(spark.createDataFrame(lines, SCHEMA)).changes
    assert "Broadcast" not in changes._jdf.queryExecution().sparkPlan().toString()
    assert {(x.file_id, x.change_kind) for x in changes.collect()} == {(3, "renamed")}
