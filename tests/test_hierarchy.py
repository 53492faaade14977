import random

import pytest

from geostrata.operators import hierarchy


def brute(links):
    out = {}
    for i in links:
        seen = [i]
        while True:
            p = links[seen[-1]]
            if p is None:
                out[i] = (seen[-1], len(seen) - 1, None, tuple(reversed(seen)))
                break
            if p not in links:
                out[i] = (seen[-1], len(seen) - 1, "orphan", tuple(reversed(seen)))
                break
            if p in seen:
                k = seen.index(p)
                out[i] = (min(seen[k:]), k, "cycle" if k == 0 else "below_cycle", tuple(reversed(seen[: k + 1])))
                break
            seen.append(p)
    return out


@pytest.mark.parametrize(("seed", "task_rows"), [(1, 500_000), (2, 9), (3, 20)])
def test_against_walking_every_chain(spark, seed, task_rows):
    r = random.Random(seed)
    links = {i: None if r.random() < 0.1 else r.choice([r.randrange(40), i + 1, i + 1, i + 1]) for i in range(36)}
    links[100] = 100
    links |= {200 + k: 200 + (k + 1) % 9 for k in range(9)} | {300: 203, 301: 300, 400: 999, 401: 400}
    df = spark.createDataFrame([(i, p, None) for i, p in links.items()], "id long, parent long, hint long")
    got = {x.id: (x.top_id, x.links_up, x.fault, tuple(x.path)) for x in hierarchy.resolve(df, "hint", paths=True, task_rows=task_rows).collect()}
    assert got == brute(links)


def test_closure_lists_every_ancestor(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long")
    got = sorted(tuple(x) for x in hierarchy.closure(hierarchy.resolve(df, paths=True)).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0)]


def test_empty(spark):
    assert hierarchy.resolve(spark.createDataFrame([], "id long, parent long"), paths=True).count() == 0


def test_latest_takes_the_newest_row_and_survives_nulls(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (None, 9, "x"), (2, None, None)], "id long, t int, v string")
    assert sorted((x.id, x.v) for x in hierarchy.latest(df, "id", "t").collect()) == [(1, "b"), (2, None)]
