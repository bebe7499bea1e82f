"""Steps that round 3 found to grow with the input: what a task takes does not, and results are those of plain loops."""

import random

from pyspark.sql import functions as F

from spanloom.operators import intervals, ranges


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_deals_its_rows_to_tasks_by_their_number(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 3).alias("seq"), (F.col("id") * 3 % 5000).alias("beg"), (F.col("id") * 3 % 5000 + 40).alias("end"))
    want = sorted(map(tuple, intervals.coverage(df).collect()))
    monkeypatch.setattr(ranges, "TASK_ROWS", 500)
    assert ranges.tasks_for(df, 2) == 16
    got = intervals.coverage(df)
    assert "RepartitionByExpression" in plan_of(got) and ", 16" in plan_of(got)
    assert sorted(map(tuple, got.collect())) == want
    # positions are summed after the shuffle, by range: none before it has to be held
    assert "Aggregate [seq" not in plan_of(got)


def test_step_sum_keeps_first_and_last_positions(spark):
    rng = random.Random(4)
    steps = lambda n: [(s, b, b + 5, rng.choice([0, 0, 1, 2])) for s in range(3) for b in range(0, n, 5)]
    a, b = steps(60), steps(40)
    df = lambda x: spark.createDataFrame(x, "seq long, beg long, end long, cov long")
    got = sorted(map(tuple, intervals.step_sum(df(a), df(b), F.lit(7)).collect()))
    old = intervals.coalesced(intervals.coverage(df(a).unionByName(df(b).withColumns({"beg": F.col("beg") + 7, "end": F.col("end") + 7})), weight=F.col("cov")))
    assert got == sorted(map(tuple, old.collect()))
    assert plan_of(intervals.step_sum(df(a), df(b), F.lit(7))).count("Window [") < plan_of(old).count("Window [")


def test_pairs_of_one_alignment_as_by_the_general_way(monkeypatch):
    import numpy as np
    import pandas as pd

    from spanloom.operators import chaining

    rng = np.random.default_rng(5)
    n = 3000
    alen, blen = rng.integers(20_000, 300_000, n), rng.integers(20_000, 300_000, n)
    a0, b0 = (rng.random(n) * alen * rng.choice([0, 0.05, 0.9], n)).astype(np.int64), (rng.random(n) * blen * rng.choice([0, 0.05, 0.9], n)).astype(np.int64)
    a1, b1 = a0 + 1 + ((alen - a0 - 1) * rng.choice([0.3, 0.97, 1], n)).astype(np.int64), b0 + 1 + ((blen - b0 - 1) * rng.choice([0.3, 0.97, 1], n)).astype(np.int64)
    rev, mlen = rng.random(n) < 0.5, rng.integers(1, 40_000, n)
    want = {}
    for i in range(n):
        g = pd.DataFrame({"abpos": a0[i : i + 1], "aepos": a1[i : i + 1], "bbpos": b0[i : i + 1], "bepos": b1[i : i + 1], "rev": rev[i : i + 1], "mlen": mlen[i : i + 1]})
        if o := chaining.overlap_of(g, int(alen[i]), int(blen[i])):
            want[i] = o
    kept, cols = chaining.single_overlaps(a0, a1, b0, b1, rev, mlen, alen, blen)
    assert kept.tolist() == sorted(want) and len({o["type"] for o in want.values()}) > 3 and len(want) < n
    for k, i in enumerate(kept.tolist()):
        assert want[i] == {c: v[k] for c, v in cols.items()} | {"frags": []}


def test_overlaps_call_nothing_for_each_pair_of_one_alignment(spark):
    from spanloom.operators import chaining

    rows = [(i, i + 1 + k, 0, 19_000, 100, 19_900, bool(i % 2), 15_000) for i in range(40) for k in range(3)]
    alns = spark.createDataFrame(rows, "aread long, bread long, abpos long, aepos long, bbpos long, bepos long, rev boolean, mlen long")
    seqs = spark.createDataFrame([(i, 20_000) for i in range(50)], "seq long, len long")
    assert chaining.overlaps(alns, seqs).count() == len(rows)


def test_groups_that_cannot_come_together_are_no_task_together(spark, monkeypatch):
    from spanloom.operators import graph, scaffold

    rng = random.Random(6)
    n, shape = 60, (1.0, 3.0, 0.5, 0.1)
    sizes = spark.createDataFrame([(i, rng.choice([10, 20, 100])) for i in range(n)], "grp long, size long")
    pairs = spark.createDataFrame([(a, b, rng.choice([0, 1, 1, 2, 3, 6])) for a in range(n) for b in range(n) if a != b and rng.random() < 0.06], "a long, b long, shared long")
    got = sorted(map(tuple, scaffold.merged_groups(pairs, sizes, shape).collect()))
    sets = scaffold.mergeable(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("shared").alias("shared")), sizes, shape)
    assert 1 < sets.select("component").distinct().count() < n < sets.count() + 1
    whole = lambda e, s, shape: graph.components(e.select("a", "b"), s.select(F.col("grp").alias("node"))).withColumnRenamed("node", "grp")
    monkeypatch.setattr(scaffold, "mergeable", whole)
    assert got == sorted(map(tuple, scaffold.merged_groups(pairs, sizes, shape).collect()))
    assert any(a != b for a, b in got)


def test_lines_before_the_first_that_grows_are_no_task(spark, monkeypatch):
    from spanloom.functions.overlap import EXTENDS
    from spanloom.operators import scaffold

    rng = random.Random(7)
    n = 80
    seqs = spark.createDataFrame([(i, 1000 + rng.choice([0, 0, 50])) for i in range(n)], "seq long, len long")
    rows = [(a, b, x := rng.randint(0, 500), x + 400, y := rng.randint(0, 500), y + 400, rng.random() < 0.5, float(rng.randint(1, 99)), EXTENDS) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.95]
    e = spark.createDataFrame(rows, "aread long, bread long, abpos long, aepos long, bbpos long, bepos long, rev boolean, score double, type int")
    got = sorted(map(tuple, scaffold.backbones(e, seqs, 100).collect()))
    kept, before = [], scaffold.before_growth

    def none_alone(*args):
        kept.append(before(*args))
        return kept[-1].withColumn("alone", F.lit(False))

    monkeypatch.setattr(scaffold, "before_growth", none_alone)
    assert got == sorted(map(tuple, scaffold.backbones(e, seqs, 100).collect()))
    assert 5 < kept[0].where("alone").count() < n and any(r[1] > 0 for r in got)


def test_libraries_are_merged_in_as_many_tasks_as_there_are_rows_for(spark):
    from spanloom.operators import contacts

    rows = [(i % 3, i % 2, i % 5, i % 4, 1 + i % 2) for i in range(200)]
    m = spark.createDataFrame(rows, "aseq long, abin long, bseq long, bbin long, n long")
    got = contacts.merged_counts(m, m, tasks=3)
    assert "RepartitionByExpression" in plan_of(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, contacts.merged_counts(m, m).collect()))


def test_labels_are_told_to_neighbours_once(spark, monkeypatch):
    from spanloom.operators import graph

    rng = random.Random(8)
    edges = [(i, j, float(rng.randint(0, 9)), 1.0) for i in range(30) for j in range(i) if rng.random() < 0.3]
    told, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["other", "label"]:
            told.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    df = spark.createDataFrame(edges, "a long, b long, overlap double, contact double")
    got = graph.partition(df, spark.createDataFrame([(i, 10 + i) for i in range(30)], "node long, len long"), k=2)
    assert got.count() == sum(told) == 30 and len(told) > 3


def test_points_meet_slices_of_all_sizes_by_one_width_of_bins(spark):
    rng = random.Random(10)
    assert intervals.bin_widths([(6, 10, 300), (12, 1000, 2_000_000), (18, 1000, 9_000_000)]) == {6: 12, 12: 12, 18: 12}
    assert intervals.bin_widths([(6, 10, 300), (30, 10, 9_000_000_000)]) == {6: 12, 30: 30}
    for far in (20_000, 1 << 27):
        slices = [(s, *x) for s in range(3) for cuts in [sorted({0, far, *(rng.randint(0, 300) for _ in range(9)), *(rng.randint(0, far) for _ in range(9))})] for x in zip(cuts, cuts[1:])]
        points = [(rng.randint(0, 3), rng.choice([rng.randint(-9, 400), rng.randint(0, far)])) for _ in range(400)]
        df = spark.createDataFrame(points, "seq long, pos long")
        got = intervals.point_join(df, spark.createDataFrame(slices, "of long, lo long, hi long"), ("seq", "pos"), ("of", "lo", "hi"))
        assert sorted(map(tuple, got.collect())) == sorted((*p, *s) for p in points for s in slices if p[0] == s[0] and s[1] <= p[1] < s[2])
        assert far > 20_000 or "explode(array" not in plan_of(got)


def test_pairs_are_cut_within_their_rows(spark):
    from spanloom.operators import layout

    rng = random.Random(11)
    ends = [sorted({0, 70_000, *(rng.randint(1, 69_999) for _ in range(rng.choice([0, 3, 40])))}) for _ in range(6)]
    pieces = [(s, f"{s}_{i}", b, e) for s, c in enumerate(ends) for i, (b, e) in enumerate(zip(c, c[1:]))]
    pairs = []
    for i in range(300):
        n, m = rng.choice([1, 50, 5_000, 60_000]), rng.choice([1, 70, 4_096, 40_000])
        x, y = rng.randint(0, 70_000 - n), rng.randint(0, 70_000 - m)
        pairs.append((i, rng.randrange(6), x, x + n, rng.randrange(6), y, y + m, rng.random() < 0.5))
    got = layout.split_pairs(
        spark.createDataFrame(pairs, "id long, aread long, abpos long, aepos long, bread long, bbpos long, bepos long, rev boolean"), spark.createDataFrame(pieces, "seq long, name string, beg long, end long")
    )
    assert "Window" not in plan_of(got) and plan_of(got).count("Join") == 2
    want = []
    for i, a, x0, x1, b, y0, y1, rev in pairs:
        n, m = x1 - x0, y1 - y0
        at = {x0, *(c for c in ends[a] if x0 < c < x1), *(x0 + (y1 - c if rev else c - y0) * n // m for c in ends[b] if y0 < c < y1)}
        at = [*sorted(at), x1]
        for lo, hi in zip(at, at[1:]):
            p, q = (lo - x0) * m // n, (hi - x0) * m // n
            c, d = (y1 - q, y1 - p) if rev else (y0 + p, y0 + q)
            for s, name, b0, e0 in pieces:
                if s == a and b0 <= (lo + hi) // 2 < e0:
                    for t, name2, b1, e1 in pieces:
                        if t == b and b1 <= (c + d) // 2 < e1:
                            want.append((i, name, max(lo, b0), min(hi, e0), name2, min(max(c, b1), e1), max(min(d, e1), b1), rev))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 400


def test_lines_are_split_into_fields_once(spark, tmp_path):
    from spanloom.sources import readers

    (tmp_path / "a.paf").write_text("x\t9\t1\t5\t-\ty\t8\t0\t4\t3\t4\t60\nshort\t1\n")
    names = spark.createDataFrame([("x", 9, 0), ("y", 8, 1)], "name string, len long, seq long")
    got = readers.paf(spark, str(tmp_path / "a.paf"), names)
    assert plan_of(got).count("split(") == 1
    assert [tuple(r) for r in got.collect()] == [(0, 1, True, 1, 5, 0, 4, 3, 4, 60)]


def test_search_rounds_give_the_best_and_few_rows(spark, monkeypatch):
    from spanloom.llm import search

    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    docs = [(None if i == 77 else i % 600, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(3, 60)))) for i in range(640)]
    docs += [(1000 + i, "w0 w1 w250 w299") for i in range(160)]  # a group of copies
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    made, inner = [], search.cut

    def counted(x):
        out = inner(x)
        if out.columns == ["query_id", "doc_id", "points", "rank"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(search, "cut", counted)
    index = inner(search.build_index(df, shard_rows=16))
    asked = df.where("doc_id % 50 = 0")
    got = sorted(map(tuple, search.search(index, search.query_terms(asked), k=5, block=200).collect()))
    monkeypatch.setattr(search, "strides", lambda n: [1])
    assert index.count() > 32 and got == sorted(map(tuple, search.search(index, search.query_terms(asked), k=5, block=200).collect()))
    assert len(made) == 2


def test_search_of_many_queries_at_once_is_exact():
    import numpy as np

    from spanloom.llm import search

    rng = np.random.default_rng(13)
    n, t = 1000, 400
    held = rng.random((t, n)) < np.linspace(0.002, 0.7, t)[:, None] ** 2
    held[5] = False
    held[5, 3] = True
    terms, lengths = np.flatnonzero(held.any(axis=1)), rng.integers(5, 90, n).astype(np.int32)
    which, doc = np.nonzero(held[terms])
    tf = rng.integers(1, 5, len(doc)).astype(np.int32)
    new, apart = np.append(True, which[1:] != which[:-1]), np.ones(len(doc), bool)
    apart[1:] = new[1:] | (doc[1:] >> search.BLOCK != doc[:-1] >> search.BLOCK)
    of = np.flatnonzero(apart)
    arrays = {
        "lengths": lengths, "terms": terms, "block_at": np.append(np.searchsorted(of, np.flatnonzero(new)), len(of)), "block": doc[of] >> search.BLOCK, "posting_at": np.append(of, len(doc)),
        "most": np.maximum.reduceat(tf, of), "least": np.minimum.reduceat(lengths[doc], of), "posting_doc": doc, "posting_tf": tf,
    }
    shard = search.Shard(None, arrays, 40.0, terms, np.log(1 + n / held[terms].sum(axis=1)))
    assert 0 < len(shard.rows) < len(terms)
    points = np.zeros((len(terms), n))
    points[which, doc] = shard.points
    asks = [np.sort(rng.choice(len(terms), rng.integers(0, 60), replace=False)) for _ in range(60)] + [np.array([], int), np.flatnonzero(shard.row >= 0)[:9]]
    truth = [points[a].sum(axis=0) for a in asks]
    order, place, of = rng.permutation(n), np.concatenate(asks), np.repeat(np.arange(len(asks)), [len(a) for a in asks])
    for share in (0, 0.5, 0.9):
        worst = np.array([share * x.max() if i % 3 else 0.0 for i, x in enumerate(truth)])
        for x, w, (d, s) in zip(truth, worst, shard.top_of(place, of, worst, 10, order), strict=True):
            want = [i for i in np.lexsort((order, -x))[:10] if x[i] >= max(w, 1)]
            assert d.tolist() == want and s.tolist() == x[want].tolist()


def test_communities_take_no_join_of_all_edges_for_a_score(spark, monkeypatch):
    from spanloom.operators import graph

    rng = random.Random(14)
    edges = [(i, j, 1.0) for i in range(40) for j in range(i) if rng.random() < (0.8 if i // 10 == j // 10 else 0.02)] + [(50, 50, 2.0)]
    monkeypatch.setattr(graph, "modularity", None)  # scores come from the degrees, and edges that are dealt once
    df = spark.createDataFrame(edges, "a long, b long, w double")
    assert {r.node: r.community for r in graph.communities(df).collect()} == {i: i // 10 * 10 for i in range(40)} | {50: 50}


def counting(df):
    """`df`, and a counter of its rows as they are worked out."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(through, df.schema), seen


def test_linkages_work_out_contacts_once(spark):
    from spanloom.operators import contacts

    rng = random.Random(6)
    rows = sorted({(a, rng.randrange(20), b, rng.randrange(20), rng.randrange(1, 9)) for a in range(12) for b in range(a, 12) for _ in range(9)})
    matrix, seen = counting(spark.createDataFrame(rows, "aseq long, abin long, bseq long, bbin long, n long"))
    seqs = spark.range(12).select(F.col("id").alias("seq"), F.lit(20_000).cast("long").alias("len"))
    over = spark.createDataFrame([(0, 1), (1, 0), (2, 5), (5, 2)], "aread long, bread long")
    got = contacts.linkages(matrix, seqs, over, 1000, 4, least=1, alpha=0.99).collect()
    assert seen.value == len(rows)
    ends = {}
    for a, i, b, j, n in rows:
        for x, p, y, q in ((a, i, b, j), (b, j, a, i)) if a != b else ():
            if (p < 4 or p >= 16) and (q < 4 or q >= 16):
                ends[x, p >= 16, y, q >= 16] = ends.get((x, p >= 16, y, q >= 16), 0) + n
    pairs = {(r.a, r.b) for r in got}
    assert pairs and pairs == {(b, a) for a, b in pairs} and not pairs & {(0, 1), (2, 5)}
    assert all(any((a, s, b, t) in ends for s in (0, 1) for t in (0, 1)) for a, b in pairs)


def test_break_calls_work_out_spans_once(spark):
    import numpy as np

    from spanloom.operators import breaks

    rng = np.random.default_rng(3)
    x = {s: rng.integers(40, 60, 400) for s in range(5)}
    for s in (1, 3):
        x[s][190:194] = 1
    spans, seen = counting(spark.createDataFrame([(s, i, int(v)) for s, xs in x.items() for i, v in enumerate(xs)], "seq long, bin long, span long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")  # a sequence's rows come in several frames
    try:
        got = breaks.call_breaks(spans, 1000, 3000, alpha=0.5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen.value == 2000
    step = np.concatenate([np.diff(v) for v in x.values()]).astype(float)
    rise = float(np.median(step))
    limit = float(np.median(np.abs(step - rise))) * 3.5 / 0.6745
    want = [(s, b * 1000, *rest) for s, v in x.items() for b, *rest in breaks.valleys(breaks.without_spikes(v, rise, limit, 3), 3)]
    assert {w[0] for w in want} == {1, 3} and sorted(map(tuple, got)) == sorted(want)


def test_forest_looks_at_light_edges_once(spark, monkeypatch):
    from spanloom.operators import graph

    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([None, *range(40)])) for _ in range(3000)]
    edges += [(100, 101, 1), (101, 102, 1), (100, 102, 1), (103, 103, 5), (5, 100, 0)]  # far ends that no heavy edge has
    looked, between = [], graph._between
    monkeypatch.setattr(graph, "_between", lambda x, to: looked.append(x.count()) or between(x, to))
    got = sorted(map(tuple, graph.spanning_forest(spark.createDataFrame(edges, "a long, b long, w long")).collect()), key=str)
    root = {}

    def find(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    want = []
    for none, _, a, b, w in sorted({(w is None, -(w or 0), min(a, b), max(a, b), w) for a, b, w in edges if a != b}, key=lambda r: r[:4]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert got == sorted(want, key=str)
    # the rounds look at a layer's edges again, and all the others are looked at once a layer
    assert len(looked) > 2 and sum(looked) < 2 * len(edges)


def test_edges_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    from spanloom.plans import adapters as ad

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, ad.edges(spark, d).collect()))
    monkeypatch.setattr(ranges, "TASK_ROWS", 500)
    got = ad.edges(spark, d)
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 500)
    assert got.rdd.getNumPartitions() == tasks > 4 and sorted(map(tuple, got.collect())) == want


def test_longest_join_deals_its_intervals_once(spark):
    rng = random.Random(9)
    rows = [(s, b, b + rng.randrange(0, 90)) for s in range(3) for b in (rng.randrange(200) for _ in range(80))]
    got = intervals.longest_join(spark.createDataFrame(rows, "seq long, beg long, end long"), 25)
    longest = {}
    for s, b, e in rows:
        longest[s, b] = max(e, longest.get((s, b), e))
    want = sorted((s, b, e, t, x, y) for (s, b), e in longest.items() for t, x, y in rows if s == t and b < y and x < e)
    assert sorted((r.a_seq, r.a_beg, r.a_end, r.b_seq, r.b_beg, r.b_end) for r in got.collect()) == want
    from spanloom.plans.queries import QUERIES

    # starts are put together where both sides were dealt to, not before
    plan = plan_of(QUERIES["band_join"](spark, "/root/testdata/sf0.001"))
    assert plan.count("RepartitionByExpression") == 2 and plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("Generate")


def test_long_queries_are_added_up_whole_and_exact(monkeypatch):
    import numpy as np

    from spanloom.llm import search

    rng = np.random.default_rng(17)
    n, t = 700, 500
    held = rng.random((t, n)) < np.linspace(0.01, 0.8, t)[:, None] ** 2
    terms, lengths = np.flatnonzero(held.any(axis=1)), rng.integers(5, 90, n).astype(np.int32)
    which, doc = np.nonzero(held[terms])
    tf = rng.integers(1, 5, len(doc)).astype(np.int32)
    apart = np.ones(len(doc), bool)
    apart[1:] = (which[1:] != which[:-1]) | (doc[1:] >> search.BLOCK != doc[:-1] >> search.BLOCK)
    of, new = np.flatnonzero(apart), np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    arrays = {
        "lengths": lengths, "terms": terms, "block_at": np.append(np.searchsorted(of, new), len(of)), "block": doc[of] >> search.BLOCK, "posting_at": np.append(of, len(doc)),
        "most": np.maximum.reduceat(tf, of), "least": np.minimum.reduceat(lengths[doc], of), "posting_doc": doc, "posting_tf": tf,
    }
    shard = search.Shard(None, arrays, 40.0, terms, np.log(1 + n / held[terms].sum(axis=1)))
    points = np.zeros((len(terms), n))
    points[which, doc] = shard.points
    asks = [np.sort(rng.choice(len(terms), 300, replace=False)) for _ in range(40)] + [np.arange(3)]
    order, place, of = rng.permutation(n), np.concatenate(asks), np.repeat(np.arange(len(asks)), [len(a) for a in asks])
    order[7], order[8] = order[8], order[7]
    looked = []
    monkeypatch.setattr(shard, "pruned", lambda place, of, worst, *a, f=shard.pruned: looked.append(len(worst)) or f(place, of, worst, *a))
    for share in (0, 0.6, 1):
        truth = [points[a].sum(axis=0) for a in asks]
        worst = np.array([share * np.sort(x)[-10] for x in truth])
        for x, w, (d, s) in zip(truth, worst, shard.top_of(place, of, worst, 10, order), strict=True):
            want = [i for i in np.lexsort((order, -x))[:10] if x[i] >= max(w, 1)]
            assert d.tolist() == want and s.tolist() == x[want].tolist()
    assert looked == [1, 1, 1]  # bounds of blocks for the short one only
