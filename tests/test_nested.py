"""Nested differences against a plain recursion."""

import json
import random

from quire.sources import nested


def plain(path, a, b, out, page, block, tol=1e-6):
    if isinstance(a, dict):
        page = a["page"] if isinstance(a.get("page"), int) else page
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted(a.keys() | b.keys()):
            if k in a and k in b:
                plain(f"{path}.{k}", a[k], b[k], out, page, block)
            else:
                out.add((f"{path}.{k}", dump(a[k]) if k in a else "<missing>", dump(b[k]) if k in b else "<missing>", a[k].get("page", page) if isinstance(a.get(k), dict) else page, block))
    elif isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            out.add((f"{path}.len()", str(len(a)), str(len(b)), page, block))
        for i, (x, y) in enumerate(zip(a, b)):
            plain(f"{path}[{i}]", x, y, out, page, i if path.endswith(".blocks") else block)
    else:
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        if number(a) and number(b) and not (isinstance(a, int) and isinstance(b, int)):
            same = abs(a - b) <= tol * max(1, abs(a), abs(b))
        else:
            same = dump(a) == dump(b)
        if not same:
            out.add((path, dump(a), dump(b), page, block))


def dump(v):
    return json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def value(r, depth):
    kind = r.choice(["n", "f", "s", "b", "z", "o", "a"] if depth else ["n", "f", "s", "b", "z"])
    if kind == "o":
        return {k: value(r, depth - 1) for k in r.sample(["a", "b", "text"], r.randint(0, 3))} | ({"page": r.randint(1, 9)} if r.random() < 0.5 else {}) | ({"blocks": [value(r, depth - 1) for _ in range(r.randint(0, 3))]} if r.random() < 0.5 else {})
    if kind == "a":
        return [value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {"n": r.randint(0, 3), "f": r.choice([0.5, 0.5000001, 0.6]), "s": r.choice(["x", "é\"q"]), "b": r.random() < 0.5, "z": None}[kind]


def changed(r, v):
    if r.random() < 0.15:
        return value(r, 1)
    if isinstance(v, dict):
        return {k: changed(r, x) for k, x in v.items() if r.random() < 0.95}
    return [changed(r, x) for x in v if r.random() < 0.95] if isinstance(v, list) else v


def test_all_places_that_differ(spark):
    r, left, right, want = random.Random(3), [], [], set()
    for i in range(120):
        a = {"page": 1, "blocks": [value(r, 3) for _ in range(3)], "more": value(r, 2)}
        b = changed(r, a)
        left.append((i, json.dumps(a)))
        right.append((i, json.dumps(b)))
        found = set()
        plain("$", a, b, found, None, None)
        want |= {(i, *x) for x in found}
    left += [(500, "{}"), (501, None), (502, "no json"), (503, "[1, 2]")]
    right += [(501, None), (502, "null"), (503, "[1.0000001, 3]"), (504, "7")]
    want |= {(500, "$", "{}", "<missing>", None, None), (503, "$[1]", "2", "3", None, None), (504, "$", "<missing>", "7", None, None)}
    got = {tuple(x) for x in nested.nested_difference(spark.createDataFrame(left, "id int, value string"), spark.createDataFrame(right, "id int, value string"), ["id"]).collect()}
    assert got == want and len(want) > 100


def test_sides_meet_in_one_join_and_equal_parts_are_not_opened(spark, monkeypatch):
    steps, real = [], nested.kept
    monkeypatch.setattr(nested, "kept", lambda df: steps.append(df) or real(df))
    rows = [(1, '{"page":3,"blocks":[{"a":1,"b":null},{"a":[1,2]}]}'), (2, "[1]")], [(1, '{"page":3,"blocks":[{"a":1},{"a":[1,5]}]}'), (2, "[1]")]
    got = nested.nested_difference(*(spark.createDataFrame(r, "doc long, value string") for r in rows), ["doc"]).collect()
    assert sorted(map(tuple, got)) == [(1, "$.blocks[0].b", "null", "<missing>", 3, 0), (1, "$.blocks[1].a[1]", "2", "5", 3, 1)]
    assert sum(x._jdf.queryExecution().optimizedPlan().toString().count("Join ") for x in steps) == 1
    assert not [r for x in steps for r in x.select("doc").collect() if r["doc"] == 2]
