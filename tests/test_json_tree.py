import json
import random
import re

from sievework.operators import json_tree as jt


def walk(v, path="$", depth=0, key=None):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    yield path, depth, key, kind, v if not isinstance(v, dict | list) else None
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        step = f"[{k}]" if isinstance(v, list) else f".{k}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else "['" + k.replace("'", "\\'") + "']"
        yield from walk(x, path + step, depth + 1, None if isinstance(v, list) else k)


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, False, 7, -3, 2.5, "", "text", "é'", "a.b"])
    if rng.random() < 0.5:
        return [grown(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: grown(rng, depth - 1) for k in rng.sample(["a", "b_1", "c d", "it's", "é", "token", "0"], rng.randint(0, 4))}


def shuffled(v, rng):
    if isinstance(v, dict):
        return {k: shuffled(v[k], rng) for k in rng.sample(list(v), len(v))}
    return [shuffled(x, rng) for x in v] if isinstance(v, list) else v


def said(kind, v):
    return None if kind in ("object", "array", "null") else json.dumps(v) if kind == "boolean" else v if kind == "string" else float(v)


def test_nodes_of_any_depth(spark):
    rng = random.Random(4)
    values = [grown(rng, 6) for _ in range(120)]
    deep = "x"
    for k in range(40):
        deep = {"n": deep} if k % 2 else [deep]
    values.append(deep)
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False), "p") for i, v in enumerate(values)] + [(900, None, "p"), (901, "{", "p"), (902, "", "p")], "id int, j string, path string")
    found = jt.nodes(df, "id", "j")
    got = {(r.id, r.path): (r.depth, r.key, r.kind, r.value) for r in found.collect()}
    want = {(i, p): (d, k, kind, said(kind, v)) for i, value in enumerate(values) for p, d, k, kind, v in walk(value)}
    assert set(got) == set(want) and max(d for d, *_ in got.values()) == 40
    for at, (depth, key, kind, v) in want.items():
        d, k, kd, x = got[at]
        assert (d, k) == (depth, key) and (kd == kind or kind == "number" and kd not in ("string", "boolean", "object", "array", "null"))
        assert x == v if kind != "number" else float(x) == v
    tips = {(r.id, r.path) for r in jt.leaves(found).collect()}
    assert tips == {at for at in want if not any(b != at and b[0] == at[0] and b[1].startswith(at[1]) and b[1][len(at[1])] in ".[" for b in want)}
    again = spark.createDataFrame([(i, json.dumps(shuffled(v, rng))) for i, v in enumerate(values)], "id int, j string")
    one, two = ({r.id: r.digest for r in jt.stable_digest(x).collect()} for x in (found, jt.nodes(again, "id", "j")))
    assert one == two and len(set(one.values())) == len({json.dumps(v, sort_keys=True) for v in values})
    assert jt.nodes(df.limit(0), "id", "j").count() == 0


def test_names_are_hidden_with_all_beneath(spark):
    v = {"user": {"token": {"deep": ["s1", 2, None]}, "name": "n"}, "Token": "s3", "list": [{"token": "s4"}, "ok"]}
    df = spark.createDataFrame([(1, json.dumps(v))], "id int, j string")
    values = {r.path: r.value for r in jt.nodes(df, "id", "j", hide="(?i)^token$").collect() if r.value is not None}
    assert values == {"$.user.token.deep[0]": jt.HIDDEN, "$.user.token.deep[1]": jt.HIDDEN, "$.user.name": "n", "$.Token": jt.HIDDEN, "$.list[0].token": jt.HIDDEN, "$.list[1]": "ok"}
    texts = jt.texts_under(jt.nodes(df, "id", "j"), "token|list").collect()
    assert {(r.path, r.value) for r in texts} == {("$.user.token.deep[0]", "s1"), ("$.Token", "s3"), ("$.list[0].token", "s4"), ("$.list[1]", "ok")}


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "[[1]]")], "id int, j string")
    plan = jt.nodes(df, "id", "j")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
