"""Nested states: round trips, differences and patches against plain Python."""

import copy
import json
import random

from finlode.operators import state

LONG = "id long, state string"


def steps(path):
    return [f"[{p}]" if isinstance(p, int) else (f"\\{p}" if p[:1] in ("[", "\\") else p) for p in path]


def random_value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.45:
        return rng.choice([1, -2.5, "x", "é \"q\"\n", None, True, False, {}, [], 10**20])
    if kind < 0.75:
        return {rng.choice(["a", "b", "c.d", "[0]", "\\e", "ü", ""]): random_value(rng, depth - 1) for _ in range(rng.randint(1, 4))}
    return [random_value(rng, depth - 1) for _ in range(rng.randint(1, 3))]


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, json.dumps(random_value(rng, rng.randint(0, 5)), ensure_ascii=rng.random() < 0.5)) for i in range(150)]
    rows += [(900, '{"n": 1.50, "e": 1e5, "big": 12345678901234567890}'), (901, None), (902, "not json"), (903, "")]
    leaves = state.flattened(spark.createDataFrame(rows, LONG))
    got = {r["id"]: r["state"] for r in state.rebuilt(leaves).collect()}
    assert set(got) == {i for i, _ in rows} - {901, 902, 903}
    for i, text in rows[:-3]:
        assert json.loads(got[i]) == json.loads(text)
        assert list(json.loads(got[i])) == list(json.loads(text)) if isinstance(json.loads(text), dict) else True
    assert got[900] == '{"n":1.50,"e":1e5,"big":12345678901234567890}'
    assert state.rebuilt(leaves.limit(0)).count() == 0


def test_paths(spark):
    row = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": true}]}, "d": null}')], LONG)
    got = {r["p"]: (r["kind"], r["value"]) for r in state.flattened(row).withColumn("p", state.dotted(state.F.col("path"))).collect()}
    assert got == {"a.b[0]": ("number", "1"), "a.b[1].c": ("boolean", "true"), "d": ("null", "null")}
    back = spark.createDataFrame([("a.b[1].c",), ("x",), ("[2].y",)], "t string").select(state.step_path(state.F.col("t")).alias("p")).collect()
    assert [r["p"] for r in back] == [["a", "b", "[1]", "c"], ["x"], ["[2]", "y"]]


def test_differences(spark):
    a = state.flattened(spark.createDataFrame([(1, '{"x": 1, "y": {"z": 2}}'), (2, "[1, 2]")], LONG))
    b = state.flattened(spark.createDataFrame([(1, '{"x": 3, "w": 0, "y": {"z": 2}}'), (2, "[1]")], LONG))
    got = {(r["id"], tuple(r["path"])): (r["change"], r["old"], r["new"]) for r in state.changed(a, b).collect()}
    assert got == {(1, ("x",)): ("changed", "1", "3"), (1, ("w",)): ("added", None, "0"), (2, ("[1]",)): ("removed", "2", None)}


def brute_patch(value, changes):
    """Changes in order, on nested values: parents are made, values without parts give way, arrays that get keys become objects."""
    value = copy.deepcopy(value)
    for path, new in changes:
        if not path:
            value = copy.deepcopy(new)
            continue
        holder = {"": value}
        at, key = holder, ""
        for p in path:
            if not isinstance(at[key], dict if isinstance(p, str) else list):
                if new is None:
                    break
                at[key] = {str(i): v for i, v in enumerate(at[key])} if isinstance(at[key], list) else {} if isinstance(p, str) else []
            at, key = at[key], p
            if isinstance(at, list):
                while len(at) <= key and new is not None:
                    at.append(None)
                if key >= len(at):
                    break
            elif key not in at:
                if new is None:
                    break
                at[key] = None
        else:
            if new is None:
                del at[key]
            else:
                at[key] = copy.deepcopy(new)
        value = holder[""]
    return value


def test_patches(spark):
    rng = random.Random(2)
    keys = ["a", "b", "c"]

    def nested(depth):
        return {k: (nested(depth - 1) if depth and rng.random() < 0.6 else rng.choice([1, "s", [1, 2], None, True])) for k in rng.sample(keys, 2)}

    states, changes, want = [], [], {}
    for i in range(80):
        value = nested(3)
        own = []
        for seq in range(rng.randint(0, 5)):
            path = [rng.choice(keys) for _ in range(rng.randint(1, 4))]
            own.append((path, rng.choice([7, "new", {"q": {"r": 1}}, [3], False])))
            changes.append((i, seq, steps(path), json.dumps(own[-1][1])))
        states.append((i, json.dumps(value)))
        want[i] = brute_patch(value, own)
    leaves = state.flattened(spark.createDataFrame(states, LONG))
    rng.shuffle(changes)
    after = state.patched(leaves, spark.createDataFrame(changes, "id long, seq int, path array<string>, value string"))
    got = {r["id"]: json.loads(r["state"]) for r in state.rebuilt(after).collect()}

    assert got == want


def test_removals_and_mixed_parents(spark):
    leaves = state.flattened(spark.createDataFrame([(1, '{"a": [1, 2, 3], "b": {"c": 1, "d": 2}, "e": 5}')], LONG))
    rows = [(1, 1, ["a", "[1]"], None), (1, 2, ["b"], None), (1, 3, ["e", "f", "[0]"], '"x"'), (1, 4, ["a", "k"], "true"), (2, 1, ["new"], "[]")]
    after = state.patched(leaves, spark.createDataFrame(rows, "id long, seq int, path array<string>, value string"))
    got = {r["id"]: json.loads(r["state"]) for r in state.rebuilt(after).collect()}
    assert got == {1: {"a": {"0": 1, "2": 3, "k": True}, "e": {"f": ["x"]}}, 2: {"new": []}}
    assert state.patched(leaves, spark.createDataFrame([], "id long, seq int, path array<string>, value string")).count() == leaves.count()


def test_states_are_taken_apart_a_few_at_a_time(monkeypatch):
    """What a worker holds is bounded by bytes of text, not by rows of a batch; a long text, nulls and blanks are in some part."""
    import pyarrow as pa

    monkeypatch.setattr(state, "TEXTS", 20)
    texts = ["x" * 9, None, "y" * 9, "", "z" * 50, "w", None, "v" * 19]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "state": texts})
    found = [part.column(1).to_pylist() for part in state._slices(batch)]
    assert sum(found, []) == texts and found == [texts[:4], texts[4:5], texts[5:8]]
    assert [p.num_rows for p in state._slices(batch.slice(0, 0))] == [0]
