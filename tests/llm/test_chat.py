import duckdb

from quillmine.llm import queries_chat
from quillmine.llm.chat import perspectives

SCHEMA = "conv_id long, turn long, role string, text string, mask string, perspective string"


def by_hand(turns, me):
    text, mask = "", []
    for role, said in turns:
        head = "<|assistant|>\n" if role == me else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        start = len(text) + len(head)
        text += head + said.replace("<|", "<\\|") + "<|end|>\n"
        if role == me:
            mask.append((start, len(text) - start))
    return text, mask


def test_rotation(spark):
    turns = [("system", "be kind"), ("ann", "hi <|end|> \U0001f600"), ("bob", "hello"), ("ann", ""), ("cy", "日本")]
    rows = spark.createDataFrame([(1, k, r, t, "x", "y") for k, (r, t) in enumerate(turns)], SCHEMA)
    got = {r.perspective: r for r in perspectives(rows).collect()}
    assert set(got) == {"ann", "bob", "cy"}
    for me, r in got.items():
        text, mask = by_hand(turns, me)
        assert r.text == text and [(m.start, m.length) for m in r["mask"]] == mask and r.n_turns == 5
        assert all(r.text[s : s + n].endswith("<|end|>\n") for s, n in mask)


def test_segments(spark):
    rows = spark.createDataFrame([(1, k, "ab"[k % 2], f"t{k}", None, None) for k in range(150)], SCHEMA)
    got = perspectives(rows, 64).where("perspective = 'a'").orderBy("segment").collect()
    assert [r.n_turns for r in got] == [64, 64, 22]
    assert "".join(r.text for r in got) == by_hand([("ab"[k % 2], f"t{k}") for k in range(150)], "a")[0]


def test_equal_and_null_turn_numbers_are_cut(spark):
    rows = spark.createDataFrame([(1, (None, 7)[k % 2], "ab"[k % 3 > 0], f"t{k:03}", None, None) for k in range(100)], SCHEMA)
    got = perspectives(rows, 64, part_rows=16).where("perspective = 'b'").orderBy("segment", "part").collect()
    assert [r.n_turns for r in got] == [16] * 6 + [4] and [r.part for r in got] == list(range(7))
    order = sorted(range(100), key=lambda k: (k % 2, "ab"[k % 3 > 0], f"t{k:03}"))
    assert "".join(r.text for r in got) == by_hand([("ab"[k % 3 > 0], f"t{k:03}") for k in order], "b")[0]


def test_rendered_turns_are_not_shuffled(spark):
    """One exchange carries the texts."""
    plan = queries_chat.op5_perspective_rotation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "Exchange" in line]
    assert sum("hashpartitioning(conv" in line and "segment" in line and "perspective" not in line for line in lines) >= 1
    assert not any("perspective" in line.split("hashpartitioning(")[1].split(")")[0] and "segment" in line.split("hashpartitioning(")[1].split(")")[0] for line in lines if "hashpartitioning(" in line)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, None, "", ""), (1, None, " ", "x", "", ""), (None, 0, "ann", "x", "", ""), (None, 0, "ann", "x", "", ""), (2, 0, "system", "s", "", ""), (3, 0, "b", "y", "", ""), (3, 0, "a", "x", "", "")], SCHEMA)
    got = {(r.conv_id, r.perspective): r for r in perspectives(rows).collect()}
    assert set(got) == {(1, "unknown"), (None, "ann"), (3, "a"), (3, "b")}
    assert got[1, "unknown"].text.startswith("<|assistant|>\nx<|end|>") and got[None, "ann"].n_turns == 2
    assert got[3, "a"].text.index("x") < got[3, "a"].text.index("y")
    assert perspectives(rows.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries_chat.op5_perspective_rotation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    found = con.sql(queries_chat.SQL["op5_perspective_rotation"])
    got = queries_chat.op5_perspective_rotation(spark, sf).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
