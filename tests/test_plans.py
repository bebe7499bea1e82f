"""Resumable steps and the stream replay."""

import os

from spanloom.plans.steps import Step, copy_number_steps, run_steps
from spanloom.streaming import events

DATA = "/root/testdata/sf0.001"


def test_steps_resume(spark, tmp_path):
    made = []

    def step(name, needs=(), **p):
        return Step(name, lambda s, t: (made.append(name), s.range(p.get("n", 3)))[1], needs, p)

    run_steps(spark, [step("a", n=3), step("b", ("a",))], str(tmp_path))
    run_steps(spark, [step("a", n=3), step("b", ("a",))], str(tmp_path))
    assert made == ["a", "b"]
    run_steps(spark, [step("a", n=4), step("b", ("a",))], str(tmp_path))
    assert made == ["a", "b", "a", "b"]
    t = run_steps(spark, [step("a", n=4), step("b", ("a",))], str(tmp_path), from_step="b")
    assert made[4:] == ["b"] and t["a"].count() == 4


def test_copy_number_plan(spark, tmp_path):
    from spanloom.plans.queries import _chain_input

    t = run_steps(spark, copy_number_steps(lambda s: _chain_input(s, DATA)[0], lambda s: _chain_input(s, DATA)[1]), str(tmp_path))
    assert t["ploidy"].first().ploidy >= 1


def test_stream_equals_table(spark, tmp_path):
    os.symlink(f"{DATA}/events.parquet", tmp_path / "e.parquet")
    e = spark.read.parquet(f"{DATA}/events.parquet")
    want = sorted(tuple(r) for r in events.windowed(e).select("beg", "event_type", "n").collect())
    got = events.replayed(spark, str(tmp_path), "w", lambda s: events.windowed(s).select("beg", "event_type", "n"))
    assert sorted(tuple(r) for r in got.collect()) == want
