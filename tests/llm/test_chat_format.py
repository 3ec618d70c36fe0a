import json
import random

from pyspark.sql import functions as F

from shelfmark.llm import chat_format as cf

FIELDS = "array<struct<name:string,type:string,required:boolean,max_length:int>>"


def schemas(spark, rows):
    return spark.createDataFrame(rows, f"tool string, fields {FIELDS}, id string")


def calls(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id string, parent string, tool string, arguments string, root string")


def results(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "id string, content string, depth int")


WEATHER = [("weather", [("city", "string", True, 8), ("days", "integer", False, None), ("c", "number", False, None)], "x")]


def test_links_and_errors(spark):
    rows = [
        ("1", None, "weather", '{"days": 2, "city":"Rome"}'),
        ("2", "1", "weather", '{"days": "2", "city":"Constantinople", "sea": null}'),
        ("3", "2", "weather", "[1]"),
        ("4", "unknown", "weather", "{bad"),
        ("5", "1", "other", "{}"),
        ("6", "5", "weather", None),
        ("7", None, None, '{"b":{"z":1,"a":[1.50,1e2,true,null]},"a":"ü/\\n\\u0041"}'),
        ("8", "1", "weather", '{"city":null,"c":1.5}'),
        (None, None, "weather", "{}"),
        ("1", None, "weather", '{"zzz": 2}'),
    ]
    answers = [("1", "sunny"), ("2", None), ("9", "lost"), (None, "nobody"), ("9", "found")]
    every = cf.link_calls(calls(spark, rows), results(spark, answers), schemas(spark, WEATHER)).collect()
    check_records(every, rows, answers)
    got = {r.id: r for r in every if r.number == 1 and r.id and r.id not in "19"}
    assert {i: r.status for i, r in got.items()} == {"2": "linked", **dict.fromkeys("345678", "no result")}
    assert {i: r.errors for i, r in got.items()} == {
        "2": ["length: city", "type: days", "unknown: sea"],
        "3": ["not an object"],
        "4": ["not an object"],
        "5": ["tool"],
        "6": ["not an object"],
        "7": ["tool"],
        "8": ["type: city"],
    }
    assert {i: (r.root, r.depth) for i, r in got.items()} == {
        "2": ("1", 1), "3": ("1", 2), "4": ("4", 0), "5": ("1", 1), "6": ("1", 2), "7": ("7", 0), "8": ("1", 1)
    }
    ones = sorted((r.number, r.status, r.root, r.depth) for r in every if r.id == "1")
    assert ones == [(1, "linked", "1", 0), (2, "no result", "1", 0)]
    assert sorted(map(str, (r.errors for r in every if r.id == "1"))) == ["['missing: city', 'unknown: zzz']", "[]"]
    assert sorted(json.loads(r.json)["content"] for r in every if r.id == "9") == ["found", "lost"]
    for r in every:
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert '"arguments":{"a":"ü/\\nA","b":{"a":[1.5,100.0,true,null],"z":1}}' in got["7"].json
    assert json.loads(got["5"].json) == {"arguments": {}, "depth": 1, "errors": ["tool"], "id": "5", "root": "1", "tool": "other"}


def check_records(got, call_rows, result_rows):
    """Every record is in one row: statuses, numbers and contents by brute force."""
    ids = {i for i, *_ in call_rows} | {i for i, _ in result_rows}
    want = []
    for i in ids:
        n, m = sum(r[0] == i for r in call_rows), sum(r[0] == i for r in result_rows)
        if i is None:
            want += [(None, "no id")] * (n + m)
        else:
            want += [(i, "linked")] * min(n, m) + [(i, "no result")] * (n - m) + [(i, "no call")] * (m - n)
    assert sorted(((r.id, r.status) for r in got), key=str) == sorted(want, key=str)
    contents = [json.loads(r.json).get("content") for r in got if r.status in ("linked", "no call", "no id")]
    assert sorted(c for c in contents if c is not None) == sorted(c for _, c in result_rows if c is not None)
    assert sum(r.errors is not None for r in got) == len(call_rows)
    tools = sorted(json.loads(r.json).get("tool", "") for r in got if r.errors is not None)
    assert tools == sorted(r[2] or "" for r in call_rows)


def test_every_record_stays(spark):
    """Ids that repeat, one id with most records, no ids, equal records."""
    rnd = random.Random(21)
    name = lambda: rnd.choice([None, "hot", "hot", "hot", "a", "b", *map(str, range(40))])
    rows = [(name(), rnd.choice([None, "a", "hot", "b"]), rnd.choice(["weather", "x", None]), rnd.choice(["{}", "bad", '{"city":"R"}'])) for _ in range(400)]
    answers = [(name(), rnd.choice(["x", "y", None, "z"])) for _ in range(400)]
    got = cf.link_calls(calls(spark, rows), results(spark, answers), schemas(spark, WEATHER)).collect()
    check_records(got, rows, answers)
    for i in ("hot", "a", None):
        for kinds in (("linked", "no result", "no id"), ("linked", "no call")):
            numbers = sorted(r.number for r in got if r.id == i and r.status in kinds and (i is not None or r.errors is not None))
            assert numbers == list(range(1, len(numbers) + 1)) or i is None
    again = cf.link_calls(calls(spark, rows[::-1]).repartition(7), results(spark, answers), schemas(spark, WEATHER)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_fuller_schemas(spark):
    inner = "array<struct<name:string,type:string,required:boolean,max_length:int,maximum:double>>"
    fields = f"array<struct<name:string,type:string,required:boolean,max_length:int,minimum:double,maximum:double,enum:array<string>,items:string,fields:{inner}>>"
    tool = [
        ("unit", "string", True, None, None, None, ["C", "F"], None, None),
        ("days", "integer", False, None, 1.0, 7.0, None, None, None),
        ("tags", "array", False, None, None, None, None, "string", None),
        ("place", "object", False, None, None, None, None, None, [("city", "string", True, 5, None), ("lat", "number", False, None, 90.0)]),
    ]
    known = spark.createDataFrame([("weather", tool)], f"tool string, fields {fields}")
    cases = {
        '{"unit":"C","days":7,"tags":["a"],"place":{"city":"Rome","lat":41.9}}': [],
        '{"unit":"K","days":0,"tags":["a",1]}': ["below: days", "items: tags", "not one of: unit"],
        '{"unit":"F","days":8,"place":{"lat":91,"x":1}}': ["above: days", "above: place.lat", "missing: place.city", "unknown: place.x"],
        '{"unit":"F","place":{"city":"Florence"},"tags":[]}': ["length: place.city"],
        '{"unit":5,"place":[],"tags":{}}': ["type: place", "type: tags", "type: unit"],
    }
    rows = [(str(i), None, "weather", text) for i, text in enumerate(cases)]
    got = cf.link_calls(calls(spark, rows), results(spark, []), known).collect()
    assert {r.id: r.errors for r in got} == {str(i): errors for i, errors in enumerate(cases.values())}


def test_topological_order(spark):
    rnd = random.Random(8)
    parent = {f"n{i}": (f"n{rnd.randrange(i)}" if i and rnd.random() < 0.95 else None) for i in range(300)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(500)}
    parent |= {"l0": "l2", "l1": "l0", "l2": "l1", "behind": "l1", "self": "self"}
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r.id: (r.root, r.depth) for r in cf.topological(df).collect()}

    def walk(i):
        seen = []
        while i is not None and i not in seen:
            seen.append(i)
            i = parent.get(i)
        return (None, -1) if i is not None else (seen[-1], len(seen) - 1)

    assert got == {i: walk(i) for i in parent}


def test_hot_tool_and_empty_tables(spark):
    rows = [(str(i), str(i - 1), "weather", '{"city":"x"}') for i in range(200)]
    got = cf.link_calls(calls(spark, rows), results(spark, []), schemas(spark, WEATHER))
    assert got.filter("errors = array() and status = 'no result'").count() == 200
    none = cf.link_calls(calls(spark, []), results(spark, []), schemas(spark, []))
    assert none.collect() == []
    only = cf.link_calls(calls(spark, []), results(spark, [("1", "x")]), schemas(spark, []))
    assert [(r.id, r.status) for r in only.collect()] == [("1", "no call")]


def test_conversations(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "system", "be kind", "a"), (1, 1, "user", "hi", "a"), (1, 2, "assistant", "hello", "a"),
            (1, 3, "user", "bye", "a"), (2, 0, "user", None, "a"), (2, 1, "assistant", None, "a"),
            (3, 0, "assistant", "unasked", "a"), (4, 0, None, "?", "a"), (None, 0, "user", "x", "a"), (5, None, "user", "x", "a"),
        ],
        "conv_id long, turn long, role string, text string, id string",
    )
    known = [(t, [("content", "string", True, None), ("turn", "integer", True, None)], "x") for t in ("user", "system")]
    every = cf.link_calls(*cf.conversation_records(turns), schemas(spark, known)).collect()
    got = {r.id: r for r in every if r.id}
    assert {i: (r.status, r.depth) for i, r in got.items()} == {
        "1:0": ("no result", 0), "1:1": ("linked", 1), "1:3": ("no result", 2), "2:0": ("linked", 0), "3:-1": ("no call", None), "4:0": ("no result", 0)
    }
    assert got["2:0"].errors == ["missing: content"] and got["4:0"].errors == ["tool"] and got["1:1"].errors == []
    assert [(r.status, json.loads(r.json)["arguments"]["content"]) for r in every if not r.id] == [("no id", "x")] * 2


def test_canonical(spark):
    df = spark.createDataFrame([('{ "b" : 1 , "a" : [ ] }',), ("nope",), (None,), ('{"a":1,"a":2}',)], "s string")
    assert [r.c for r in df.select(cf.canonical(F.col("s")).alias("c")).collect()] == ['{"a":[],"b":1}', None, None, None]
