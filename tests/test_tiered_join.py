import random

from sievework.operators import joins

LEFT, RIGHT = "id int, a string, b string", "other int, ra string, rb string"


def best(left, right):
    out = {}
    for i, *keys in left:
        for tier, key in enumerate(keys):
            for o, *others in right:
                if key and others[tier] == key:
                    mine = (tier, o is None, o)
                    out[i] = min(out.get(i, mine), mine, key=lambda x: (x[0], x[1], x[2] or 0))
    return {i: (o, tier) for i, (tier, _, o) in out.items()}


def test_tiers_equal_all_pairs(spark):
    rng = random.Random(4)
    pick = lambda *more: rng.choice(["", None, *more])
    left = [(rng.choice([None, *range(40)]), pick(*"abcdefgh"), pick("x", "y", "z", "w")) for _ in range(60)]
    right = [(rng.choice([None, *range(9)]), pick(*"abcdij"), pick("x", "y", "v")) for _ in range(30)] + [(None, "g", "w")]
    got = joins.tiered_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), [("a", "ra"), ("b", "rb")], "id", "other").collect()
    assert {r.id: (r.other, r.tier) for r in got} == best(left, right) and len(got) == len({r.id for r in got})


def test_a_null_id_comes_last(spark):
    got = joins.tiered_join(spark.createDataFrame([(1, "a", "b")], LEFT), spark.createDataFrame([(None, "a", "b"), (7, "a", "c"), (3, "q", "b")], RIGHT), [("a", "ra"), ("b", "rb")], "id", "other").collect()
    assert [tuple(r) for r in got] == [(1, 7, 0)]


def test_a_key_of_many_rows_on_both_sides_meets_one_row(spark):
    left = spark.range(1, 2001).selectExpr("cast(id as int) id", "concat('n', id) a", "'same' b")
    right = spark.range(5, 2005).selectExpr("cast(id as int) other", "concat('m', id) ra", "'same' rb")
    out = joins.tiered_join(left, right, [("a", "ra"), ("b", "rb")], "id", "other")
    assert out.where("other = 5 and tier = 1").count() == out.count() == 2000
    joined = []

    def walk(p):
        if p.nodeName() == "Join":
            joined.append(p.children().apply(1))
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(out._jdf.queryExecution().optimizedPlan())
    assert joined and all("Aggregate" in p.toString() for p in joined)
