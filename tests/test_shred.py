import json
import random

from loam.operators import shred as sh


def brute(data, root="xhr_responses[0]"):
    """Objects that are elements of arrays, by a plain walk."""
    out = []

    def walk(v, path, parent, element):
        if isinstance(v, dict):
            if element:
                out.append((path, parent))
                parent = path
            for k, x in v.items():
                walk(x, f"{path}.{k}", parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent, True)

    walk(data, f"{root}.data", root, False)
    return sorted(out)


def leaves(data, path=""):
    if isinstance(data, dict):
        return [x for k, v in data.items() for x in leaves(v, f"{path}.{k}")]
    if isinstance(data, list):
        return [x for i, v in enumerate(data) for x in leaves(v, f"{path}[{i}]")]
    return [] if data is None else [(path, data if isinstance(data, str) else json.dumps(data))]


def rebuilt_objects(data):
    out = []
    for path, column in sh.shred(data, markers_only=True).items():
        for index, n in sh.indices(path[:-1], column):
            if column.values[n] == "object":
                out.append(sh.spell("xhr_responses[0]", path[:-1], index))
    return sorted(out)


def rebuilt_leaves(data):
    out = []
    for path, c in sh.shred(data).items():
        if path and path[-1] == sh.MARK:
            continue
        for index, n in sh.indices(path, c):
            if c.defs[n] == len(path) + 1:
                out.append((sh.spell("r", path, index)[0][len("r.data") :], c.values[n]))
    return sorted(out)


def value(rng, depth=0):
    kind = rng.choice(["o", "a", "s", "n", "z"] if depth < 5 else ["s", "n", "z"])
    if kind == "o":
        return {rng.choice("abc[]"): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if kind == "a":
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {"s": "x", "n": rng.randint(0, 9), "z": None}[kind]


def test_round_trip():
    for seed in range(400):
        data = value(random.Random(seed))
        assert rebuilt_objects(data) == brute(data), data
        assert rebuilt_leaves(data) == sorted(leaves(data)), data


def test_levels():
    c = sh.shred({"a": [{"b": [1, 2]}, {}, {"b": []}, {"b": [3]}]})[("a", sh.REP, "b", sh.REP)]
    assert (c.reps, c.defs, c.values) == ([0, 2, 1, 1, 1], [5, 5, 2, 3, 5], ["1", "2", None, None, "3"])


def test_edges(spark):
    deep = "[" * 5000 + "{}" + "]" * 5000
    rows = [(1, [("u", 200, '[{"a":1},[{"b":{"c":[{}]}}],null,3]')]), (2, [("u", 200, x) for x in (None, "", "{bad", "NaN", "[NaN]", '{"a":[{"x":"\\ud800"}],"a":[{}]}')]), (3, None), (4, []), (5, [("u", 200, deep)])]
    df = spark.createDataFrame(rows, "page_id bigint, xhr_responses array<struct<url:string,status:int,data:string>>")
    got = sorted(tuple(r) for r in sh.object_rows(df).collect())
    assert got == [
        (1, "xhr_responses[0].data[0]", "xhr_responses[0]"),
        (1, "xhr_responses[0].data[1][0]", "xhr_responses[0]"),
        (1, "xhr_responses[0].data[1][0].b.c[0]", "xhr_responses[0].data[1][0]"),
        (2, "xhr_responses[5].data.a[0]", "xhr_responses[5]"),
        (5, "xhr_responses[0].data" + "[0]" * 5000, "xhr_responses[0]"),
    ]
    assert sh.leaf_columns(df).count() > 0 and sh.field_rows(df).count() == 2


def test_tables(spark):
    df = spark.createDataFrame([(1, [[["a", None], []], []]), (2, None)], "page_id bigint, tables array<array<array<string>>>")
    assert sorted((r["path"], r["parent_path"]) for r in sh.table_rows(df).collect()) == [("tables[0][0]", "tables[0]"), ("tables[0][1]", "tables[0]")]
