import random

import pytest

from sparkscrub.llm.components import components
from tests.llm.brute import Union


@pytest.mark.parametrize("local", [300_000, 40])
def test_components(spark, local):
    rng = random.Random(local)
    links = [(k, k + 1) for k in range(100, 180)] + [(7, 3000 + k) for k in range(120)] + [(5, 5), (6, 5), (5, 6)]
    links += [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(150)]
    rng.shuffle(links)
    union = Union()
    for a, b in links:
        union.join(a, b)
    frame = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(frame, "a", "b", local).collect()}
    assert got == {x: union.find(x) for a, b in links if a != b for x in (a, b)}
    assert components(frame.limit(0), "a", "b").collect() == []
