"""Components out of posting lists against all confirmed pairs of a list."""

import random

import pytest

from tarmaq.llm import rounds


@pytest.mark.parametrize("first", [8])
def test_op5_lists_of_one_component_meet_no_centre(spark, monkeypatch, first):
    r = random.Random(first)
    group, others = range(30), range(100, 140)
    lists = {k: r.sample(group, 20) for k in range(60)}  # copies of one image
    lists |= {k: r.sample(others, 3) for k in range(60, 70)} | {k: [r.choice(group), r.choice(others)] for k in range(70, 74)}
    holds = {(a, b) for a in group for b in group if a < b and r.random() < 0.9} | {(a, b) for a in others for b in others if a < b and r.random() < 0.15} | {(7, 120)}
    lists[80] = [7, 120, 121]
    post = spark.createDataFrame([(k, i, sum(i in x for x in lists.values())) for k, x in lists.items() for i in x], "key long, id long, score long")
    pairs = spark.createDataFrame(sorted(holds), "a long, b long")
    met, plain = [], rounds.centred

    def spy(part, *rest, **more):
        met.append(part.count())
        return plain(part, *rest, **more)

    monkeypatch.setattr(rounds, "centred", spy)
    confirm = lambda x: x.join(pairs, ["a", "b"], "left_semi")
    got = {x["id"]: x["component"] for x in rounds.settled(post, confirm, rounds.in_turns(post, confirm, first)).collect()}
    want = {i: i for x in lists.values() for i in x}
    for _ in want:
        for x in lists.values():
            for a in x:
                for b in x:
                    if (a, b) in holds:
                        want[a] = want[b] = min(want[a], want[b])
    assert {i: got.get(i, i) for i in want} == want
    assert sum(met) < 0.7 * post.count()
