"""Flows against every possible flow, and choices with overlapping sources, ties, repeated rows and nulls."""

import itertools
import random
from collections import Counter

from riskspark.llm import mixing


def best(sizes, members, quotas, repeats):
    arcs = [(i, j) for i, own in enumerate(members) for j in own]
    found = (0, 0)
    for words in itertools.product(*(range(min(repeats * sizes[i], quotas[j]) + 1) for i, j in arcs)):
        used, filled = Counter(), Counter()
        for (i, j), w in zip(arcs, words, strict=True):
            used[i] += w
            filled[j] += w
        if all(used[i] <= repeats * s for i, s in enumerate(sizes)) and all(filled[j] <= q for j, q in enumerate(quotas)):
            found = max(found, (sum(words), -price(used, sizes, repeats)))
    return found


def price(used, sizes, repeats):
    return sum((r + 1) * max(0, min(used[i] - r * s, s)) for i, s in enumerate(sizes) for r in range(repeats))


def test_route_is_the_cheapest_largest_flow():
    rng = random.Random(8)
    for _ in range(150):
        p, s = rng.randrange(1, 4), rng.randrange(1, 4)
        sizes, quotas = [rng.randrange(4) for _ in range(p)], [rng.randrange(5) for _ in range(s)]
        members = [sorted(rng.sample(range(s), rng.randrange(1, min(s, 2) + 1))) for _ in range(p)]
        flow = mixing.route(sizes, members, quotas)
        used, filled = Counter(), Counter()
        for (i, j), w in flow.items():
            assert j in members[i] and w > 0
            used[i] += w
            filled[j] += w
        assert all(used[i] <= 2 * x for i, x in enumerate(sizes)) and all(filled[j] <= q for j, q in enumerate(quotas))
        assert (sum(flow.values()), -price(used, sizes, 2)) == best(sizes, members, quotas, 2)


def test_route_of_many_patterns_ends_soon():
    rng = random.Random(9)
    members = [sorted(rng.sample(range(300), rng.randrange(1, 4))) for _ in range(20_000)]
    sizes = [rng.randrange(1, 10**6) for _ in members]
    quotas = [sum(sizes) // 200 for _ in range(300)]
    flow = mixing.route(sizes, members, quotas)
    assert sum(flow.values()) == min(sum(quotas), 2 * sum(sizes))


def test_choice_with_overlaps_ties_repeats_and_nulls(spark):
    rows = [(i, ["a"] if i % 3 else ["a", "b"], 10 + i % 7) for i in range(3000)] + [(5, ["c"], 3)] * 4000 + [(None, [None], 4)] * 50 + [(7, None, 9), (8, [], 9), (9, ["b"], 0), (10, ["b"], None)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    df = df.withColumns({"taken": df["size"], "docs": df["size"], "n": df["size"]})
    out = [mixing.mix(df.repartition(n)).collect() for n in (3, 7)]
    alike = [Counter((r.doc_id, r["size"], r.copies, r.taken) for r in x) for x in out]
    assert alike[0] == alike[1] and len(out[0]) == len(rows)
    assert all(r.copies == 0 for r in out[0] if not r["size"] or not r.sources)
    sizes = {"a": sum(x[2] for x in rows[:3000]), "b": sum(x[2] for x in rows[:3000:3]), "c": 12_000, None: 200}
    target = mixing.source_targets(list(sizes.values()), [5, 2, 1, 5], 1.5 * sum(x[2] or 0 for x in rows[:7050]))
    flow = mixing.route([sizes["a"] - sizes["b"], sizes["b"], 12_000, 200], [[0], [0, 1], [2], [3]], [round(t) for t in target])
    for patterns, numbers in (((["a"], ["a", "b"]), (0, 1)), ((["c"],), (2,)), (([None],), (3,))):  # how two patterns share a source isn't unique
        words = sum(w for (k, _), w in flow.items() if k in numbers)
        assert abs(sum(r.taken for r in out[0] if r.sources in patterns) - words) <= 16 * len(patterns)
    assert mixing.mix(df.where("false")).count() == 0
