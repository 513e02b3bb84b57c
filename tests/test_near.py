"""Edit distance over blocks: the kernel against plain recursion, and what becomes of the pairs."""

import functools
import random

import pytest

from lexiphyte import match_names
from lexiphyte.operators import near
from lexiphyte.plans.distance import pairs_within


@functools.cache
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near_enough(q, t, k):
    d = distance(q, t)
    if d != k:
        return d < k
    differ = q[-1:] != t[-1:] or not q
    return not (t and distance(q, t[:-1]) + 1 == d and d < distance(q[:-1], t[:-1]) + differ and d < distance(q[:-1], t) + 1)


@pytest.mark.parametrize("longest", [3, 12, 70, 135])
def test_kernel(longest):
    draw = random.Random(longest)
    base = "".join(draw.choice("abc×") for _ in range(longest))

    def key():
        letters = list(base[: draw.randint(0, longest)] if draw.random() < 0.5 else base)
        for _ in range(draw.randint(0, 4)):
            letters.insert(draw.randint(0, len(letters)), draw.choice("abz"))
        for _ in range(min(len(letters), draw.randint(0, 4))):
            letters.pop(draw.randrange(len(letters)))
        return "".join(letters)

    queries, references = [key() for _ in range(12)] + [""], [key() for _ in range(12)] + [""]
    for k in (-1, 0, 1, 2, 2.5, 3, 10):
        got = sorted((int(a), int(b)) for q, r in pairs_within(queries, references, k) for a, b in zip(q, r, strict=True))
        assert got == [(a, b) for a, q in enumerate(queries) for b, r in enumerate(references) if near_enough(q, r, k)]


def names(spark, n, letter):
    return spark.range(n).selectExpr(f"concat('Foo b', substr('aeiou', cast(id % 5 as int) + 1, 1), '{letter}', substr('aeiou', cast(id div 5 as int) + 1, 1)) AS name", "id AS pos")


def test_blocks_of_a_genus(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 2)
    monkeypatch.setattr(near, "BATCH", 7)
    # The pairs' letters differ in one place, their vowels in up to two.
    got = match_names(spark, names(spark, 20, "x"), names(spark, 15, "z"), max_dist=2.5, simple=True).collect()
    want = {(f"Foo b{a}x{b}", f"Foo b{c}z{d}", "auto_fuzzy") for a in "aeiou" for b in "aeio" for c in "aeiou" for d in "aei" if (a != c) + (b != d) < 2}
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("options", [{}, {"collapse_infra": True}, {"manual_match": True}])
def test_pairs_are_not_joined(spark, options):
    q = names(spark, 5, "x")
    if "manual_match" in options:
        options = {"manual_match": q.limit(1).selectExpr("name AS query", "'Foo baza' AS match")}
    plan = match_names(spark, q, names(spark, 5, "z"), **options)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan
    assert "Join" not in above
