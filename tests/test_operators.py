"""Golden cases and brute force for single operators."""

import random

import numpy as np
import pandas as pd
import pytest

from spanloom.functions import parse
from spanloom.functions import probability as prob
from spanloom.operators import breaks, chaining, contacts, graph, intervals, layout, stats


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_coverage_golden(spark):
    iv = table(spark, [("s", 10, 20), ("s", 1, 3), ("s", 1, 4), ("s", 7, 8), ("s", 1, 14), ("s", 5, 6)], "seq string, beg long, end long")
    want = [(1, 3, 3), (3, 4, 2), (4, 5, 1), (5, 6, 2), (6, 7, 1), (7, 8, 2), (8, 10, 1), (10, 14, 2), (14, 20, 1)]
    assert [r[1:] for r in rows(intervals.coverage(iv))] == want
    whole = rows(intervals.coverage(iv, table(spark, [("s", 30), ("t", 5)], "seq string, len long")))
    assert whole[0] == ("s", 0, 1, 0) and ("s", 20, 30, 0) in whole and ("t", 0, 5, 0) in whole


def test_unions_golden(spark):
    iv = lambda x: table(spark, [("s", b, e) for b, e in x], "seq string, beg long, end long")
    assert rows(intervals.merge_ranges(iv([(0, 5), (5, 8), (9, 10)]))) == [("s", 0, 8), ("s", 9, 10)]
    assert rows(intervals.measures(iv([(0, 5), (3, 8), (4, 6)]))) == [("s", 12, 8, 5, 4)]
    assert rows(intervals.overlap_size(iv([(0, 5), (10, 15)]), iv([(3, 12)]))) == [("s", 4)]


def test_lift_golden(spark):
    seg = table(spark, [("o", 1, "c", 10, 20, True, 0, 100)], "object string, part long, comp string, x long, y long, rev boolean, a long, b long")
    p = table(spark, [("c", 10), ("c", 29), ("c", 30)], "seq string, pos long")
    assert [r[-1] for r in rows(layout.lifted(p, seg))] == [119, 100]
    back = layout.lowered(layout.lifted(p, seg).select("object", "object_pos"), seg)
    assert sorted(r.comp_pos for r in back.collect()) == [10, 29]


def test_built_sequences(spark):
    seg = table(spark, [("o", 1, "c", 0, 3, False), ("o", 2, "d", 1, 3, True)], "object string, part long, comp string, x long, y long, rev boolean")
    seqs = table(spark, [("c", "AACGT"), ("d", "GATTC")], "seq string, text string")
    assert rows(layout.built(seg, seqs, gap=2)) == [("o", "AACNNAAT")]


def test_copy_number_of_nothing(spark):
    assert rows(stats.copy_number(table(spark, [], "copies long, bases long"))) == [(1,)]


def test_numbers():
    assert parse.size("10k") == 10_000 and parse.size("2.5M") == 2_500_000 and parse.seconds("2h") == 7200
    with pytest.raises(ValueError):
        parse.size("3x")


def test_tails_against_sums():
    from math import comb, exp, factorial

    for mean in (0.3, 2.0, 7.5, 20.0):
        term = [exp(-mean) * mean**k / factorial(k) for k in range(120)]
        for k in range(0, 60, 3):
            assert prob.poisson_upper(k, mean) == pytest.approx(sum(term[k:]), abs=1e-12)
            assert prob.poisson_lower(k, mean) == pytest.approx(sum(term[: k + 1]), abs=1e-12)
    for n, p in ((10, 0.3), (60, 0.05), (60, 0.5), (200, 0.93)):
        want = [sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) for k in range(n + 2)]
        assert prob.binomial_upper(np.arange(n + 2), n, p) == pytest.approx(want, rel=1e-9, abs=1e-15)
    assert prob.binomial_upper([0, 1, 5, 6], 5, [0.0, 0.0, 1.0, 1.0]).tolist() == [1.0, 0.0, 1.0, 0.0]


def test_chain_scores_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 12)
        x0 = np.array([rng.randint(0, 50) for _ in range(n)])
        y0 = np.array([rng.randint(0, 50) for _ in range(n)])
        x1, y1 = x0 + [rng.randint(1, 12) for _ in range(n)], y0 + [rng.randint(1, 12) for _ in range(n)]
        size = (x1 - x0 + y1 - y0).astype(float)
        score, before = chaining.chain(x0, x1, y0, y1, size, 0.25)
        want = {}

        def best(i):
            if i not in want:
                want[i] = size[i] + max([0.0, *(best(j) - 0.25 * (x0[i] - x1[j] + y0[i] - y1[j]) for j in range(n) if x1[j] <= x0[i] and y1[j] <= y0[i])])
            return want[i]

        assert score.tolist() == pytest.approx([best(i) for i in range(n)])
        members = [m for _, c in chaining.chains(score, before, size) for m in c]
        assert sorted(members) == list(range(n))


def test_one_long_overlap():
    g = pd.DataFrame([(i * 1000, i * 1000 + 900, 5000 + i * 1000, 5900 + i * 1000, False, 880) for i in range(60)], columns=["abpos", "aepos", "bbpos", "bepos", "rev", "mlen"])
    o = chaining.overlap_of(g, 60_000, 70_000)
    assert o and not o["brev"] and o["abpos"] == 0 and o["bbpos"] == 5000 and o["type"] & 0x01 and o["qual"] == 1.0 and o["neff"] == pytest.approx(60)
    turned = g.assign(bbpos=70_000 - g.bepos, bepos=70_000 - g.bbpos, rev=True)
    t = chaining.overlap_of(turned, 60_000, 70_000)
    assert t["brev"] and t["alen"] == o["alen"] and t["score"] == o["score"]


def test_second_copies_agree(spark):
    from spanloom.plans.queries import QUERIES
    from spanloom.plans import adapters as ad

    d = "/root/testdata/sf0.001"
    got = rows(QUERIES["second_copies"](spark, d))
    want = []
    for r in ad.alns(spark, d).where("abpos < 15000 and aepos > 5000").collect():
        want += [(r.aread, r.bread, r.abpos, r.bbpos, b, e) for b, e in chaining.second_copy((5000, 15000), (5000, 15000), (r.abpos, r.aepos), (r.bbpos, r.bepos), r.rev)]
    assert got == sorted(want)


def test_running_median():
    rng = random.Random(1)
    x = np.array([rng.randint(0, 9) for _ in range(200)], float)
    assert breaks.prefix_medians(x).tolist() == [float(np.median(x[: i + 1])) for i in range(200)]


def test_valley_is_called():
    x = np.full(100, 50.0)
    x[48:52] = [10, 3, 2, 12]
    called = breaks.valleys(x, 10)
    assert [c[0] for c in called] == [50] and called[0][4] < 1e-6
    assert breaks.valleys(np.full(100, 50.0), 10) == []


def test_spike_goes():
    x = np.array([10.0] * 10 + [90, 95, 60] + [10.0] * 10)
    assert breaks.without_spikes(x, 0.0, 5.0, 20).max() == 10.0


def test_merged_calls_keep_their_distance(spark):
    c = table(spark, [("s", 5, 0.1), ("s", 100, 0.2), ("s", 110, 0.01), ("s", 150, 0.3), ("s", 300, 0.1), ("s", 395, 0.1)], "seq string, pos long, p double")
    s = table(spark, [("s", 400)], "seq string, len long")
    assert [r[1] for r in rows(breaks.merged_calls(c, s, 20))] == [110, 150, 300]


def test_adjacent_mates(spark):
    r = [(0, "a", "x", 0, 10, 5), (1, "a", "y", 20, 30, 3), (2, "b", "x", 0, 2, 9), (3, "a", "x", 4, 6, 9), (4, "b", "x", 8, 10, 9), (5, "b", "z", 0, 4, 7)]
    t = table(spark, r, "rank long, stem string, seq string, beg long, end long, q long")
    assert rows(contacts.pair_adjacent(t)) == [("x", 5, "y", 25, 3), ("x", 9, "z", 2, 7)]


def test_pixels(spark):
    s = table(spark, [("a", 100, 0), ("b", 2500, 1), ("c", 100, 2), ("d", 150, 3), ("e", 3000, 4)], "seq string, len long, rank long")
    got = {}
    for r in contacts.pixels(s, 1000, merge_below=200).collect():
        got.setdefault(r.seq, []).append(r.pixel)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0], "b": [1, 2, 3], "c": [4], "d": [4], "e": [5, 6, 7]}


def test_assignment_by_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5):
        w = rng.integers(-9, 10, (n, n))
        got = graph.assignment(w)
        assert sorted(got) == list(range(n))
        assert sum(w[i, got[i]] for i in range(n)) == max(sum(w[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_labels_align(spark):
    e = table(spark, [(1, 0, 2, 1, 5.0), (1, 1, 2, 0, 4.0), (2, 0, 3, 0, 7.0), (1, 0, 3, 0, -1.0)], "a long, la long, b long, lb long, w double")
    to = {(r.grp, r.label): r.to for r in graph.align_labels(e, 2).collect()}
    assert to[1, 0] == to[2, 1] and to[2, 0] == to[3, 0]


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for g in (range(0, 5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5, 1.0)]
    for refine in (False, True):
        got = {r.node: r.community for r in graph.communities(table(spark, e, "a long, b long, w double"), refine=refine).collect()}
        assert {got[i] for i in range(5)} == {0} and {got[i] for i in range(5, 10)} == {5}


def test_line_of_a_path(spark):
    e = [(i, i + 1, 1.0) for i in range(9)]
    got = [r.node for r in graph.line_order(table(spark, e, "a long, b long, w double")).orderBy("rank").collect()]
    assert got == list(range(10))


def test_forest_positions(spark):
    f = table(spark, [(1, 2, 1), (2, 3, 1), (7, 8, 1)], "a long, b long, w long")
    s = table(spark, [(1, 2, 5), (2, 3, -9), (7, 8, 4)], "a long, b long, shift long")
    assert rows(graph.forest_positions(f, s)) == [(1, 1, 4), (2, 1, 9), (3, 1, 0), (7, 7, 0), (8, 7, 4)]


def test_backbone_of_three(spark):
    from spanloom.functions.overlap import EXTENDS
    from spanloom.operators import scaffold

    s = table(spark, [(1, 101), (2, 100), (3, 100), (9, 50)], "seq long, len long")
    # 2 goes on from the end of 1, and 3, turned, from the end of 2
    o = table(spark, [(1, 2, 81, 101, 0, 20, False, 5.0, EXTENDS), (2, 3, 80, 100, 80, 100, True, 5.0, EXTENDS)], "aread long, bread long, abpos long, aepos long, bbpos long, bepos long, rev boolean, score double, type int")
    assert rows(scaffold.backbones(o, s, 10)) == [(1, 0, 1, False, 0), (1, 1, 2, False, 81), (1, 2, 3, True, 161), (9, 0, 9, False, 0)]


def test_groups_merge_by_what_they_share(spark):
    from spanloom.operators import scaffold

    sizes = table(spark, [(1, 1000), (2, 1000), (3, 1000), (4, 1000)], "grp long, size long")
    pairs = table(spark, [(1, 2, 900), (2, 3, 300), (1, 3, 300), (3, 4, 10)], "a long, b long, shared long")
    assert rows(scaffold.merged_groups(pairs, sizes)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_variants_that_nothing_spans(spark):
    from spanloom.functions.overlap import INTERNAL
    from spanloom.operators import scaffold

    o = table(spark, [(1, 1000, 4000, INTERNAL), (1, 1050, 3900, INTERNAL), (1, 3000, 6000, 0)], "aread long, abpos long, aepos long, type int")
    s = table(spark, [(1, 9000)], "seq long, len long")
    low = table(spark, [(1, 9000)], "seq long, low long")
    assert rows(scaffold.variant_candidates(o, low, s, least=500, share=0.1, near=200)) == [(1, 1000, 2)]
