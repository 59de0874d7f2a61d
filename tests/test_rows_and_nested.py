"""The row tokenizer against a character loop, records cut anywhere, and JSON triples."""

import json
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netquarry.sources import nested as N
from netquarry.sources import quoted_rows as R


def by_hand(record: str):
    """The record's fields, null if its quoting is broken."""
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            i, field = i + 1, ""
            while True:
                if i >= n:
                    return None
                if record[i] == '"':
                    if record[i + 1 : i + 2] == '"':
                        field, i = field + '"', i + 2
                        continue
                    i += 1
                    break
                field, i = field + record[i], i + 1
            if i < n and record[i] != ",":
                return None
        else:
            j = record.find(",", i)
            j = n if j < 0 else j
            field, i = record[i:j], j
            if '"' in field:
                return None
        fields.append(field)
        if i >= n:
            return fields
        i += 1


def tokens(records):
    marks, final, _ = R.tokenize([r.encode() for r in records])
    out = []
    for r, at, state in zip(records, marks, final):
        raw = r.encode()
        cut = [-1, *at.tolist(), len(raw)]
        out.append(None if state in (R.QUOTED, R.BROKEN) else [R.unquote(raw[a + 1 : b]) for a, b in zip(cut, cut[1:])])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='a",\n é', max_size=30), min_size=1, max_size=8))
def test_tokenizer_equals_a_character_loop(records):
    assert tokens(records) == [by_hand(r) for r in records]


def test_records_longer_than_a_chunk():
    rng = random.Random(3)
    records = ["".join(rng.choice('ab",') for _ in range(n)) for n in (0, 255, 256, 257, 5000)]
    records.append("x," * 700 + '"' + "y,\n" * 400 + '"')
    assert tokens(records) == [by_hand(r) for r in records]


def test_where_quoting_breaks():
    records = ['a,"b', '"a"b,c', 'a,b"c', '"ok",x', 'x,"' + "y" * 600, "z" * 700 + '"', ""]
    assert R.tokenize([r.encode() for r in records])[2].tolist() == [2, 3, 3, -1, 2, 700, -1]


def test_broken_records_end_with_their_line(spark):
    text = 'a"b,c\n"d\ne",f\n'
    for size in (1, 4, 50):
        chunks = [("f", k, text[i : i + size]) for k, i in enumerate(range(0, len(text), size))]
        got = R.split_records(spark.createDataFrame(chunks, "file string, chunk_no int, text string")).orderBy("chunk_no", "piece_no").collect()
        assert [r.record for r in got] == ['a"b,c', '"d\ne",f']


def test_composition_of_chunk_functions():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 3, (12, R.WIDTH)).astype(np.uint8)
    starts = np.zeros(12, bool)
    starts[[0, 5]] = True
    got = R.compose(R.chunk_functions(classes), starts)
    state = R.START
    for k in range(12):
        state = R.START if starts[k] else state
        assert got[k] == state
        for c in classes[k]:
            state = R._RECORD[c, state]


def test_reasons(spark):
    rows = [
        (1, "i,set_load,set_load 1 [get_ports a],3,"),
        (2, 'i,set_load,"set_load 1 [get_ports ""a""]",3,f'),
        (3, 'i,set_load,set"_load 1,3,f'),
        (4, "i,set_load,x"),
        (5, "i,set_lod,set_lod 1,3,f"),
        (6, "i,set_load,set_load 1,0,f"),
        (7, "i,set_load,set_load 1,٣,f"),
        (8, "i,set_load,set_load 1 [a}],3,f"),
        (9, "i,set_load,load 1,3,f"),
        (10, None),
        (11, ""),
        (12, f"i,set_load,set_load 1,{'9' * 6000},f"),
        (13, f"i,set_load,set_load 1,{'0' * 6000}7,f"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id bigint, raw_row string, reason string")
    got = {r.row_id: r.reason for r in R.parse_constraint_rows(df).collect()}
    assert got == {1: None, 2: None, 3: "quoting", 4: "column_count", 5: "bad_command", 6: "bad_line_number", 7: "bad_line_number", 8: "bad_raw_line", 9: "bad_raw_line", 10: "column_count", 11: "column_count", 12: "bad_line_number", 13: None}
    at = {r.row_id: r.error_at for r in R.parse_constraint_rows(df).collect()}
    assert (at[1], at[3], at[4], at[5], at[6], at[8]) == (None, 14, 0, 2, 22, 11)
    valid = R.parse_constraint_rows(df).where("row_id = 2").first()
    assert (valid.raw_line, valid.line_number, valid.file_path) == ('set_load 1 [get_ports "a"]', 3, "f")
    assert R.parse_constraint_rows(df.limit(0)).count() == 0


def test_records_of_files_cut_anywhere(spark):
    text = 'a,b\n"c\nd",e\r\n\n"x""\n",y\n' + "long," * 40 + "\nlast"
    for size in (1, 3, 7, 50, 1000):
        chunks = [("f", k, text[i : i + size]) for k, i in enumerate(range(0, len(text), size))]
        got = R.split_records(spark.createDataFrame([*chunks, ("g", 0, None)], "file string, chunk_no int, text string")).orderBy("chunk_no", "piece_no").collect()
        assert [r.record for r in got] == ["a,b", '"c\nd",e', '"x""\n",y', "long," * 40, "last"]


def leaves(value, path="", ordinals=()):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, (path + "." if path else "") + k, ordinals)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, path + "[]", (*ordinals, str(i)))
    else:
        yield path, ordinals, value


_JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(_JSON)
def test_triples_hold_every_leaf(value):
    got = []
    for path, ordinals, kind, text in N.stream(json.dumps(value, indent=1)):
        got.append((path, ordinals, {"string": text, "number": int(text) if kind == "number" else None, "boolean": text == "true", "null": None, "empty_array": [], "empty_object": {}}[kind]))
    assert got == list(leaves(value))


def test_depth_has_no_bound_and_errors_are_told(spark):
    deep = "[" * 5000 + "1" + "]" * 5000
    assert list(N.stream(deep)) == [("[]" * 5000, ("0",) * 5000, "number", "1")]
    df = spark.createDataFrame([(1, '{"a": [1, {"b": null}]}'), (2, '{"a": [1,, 2]}'), (3, None), (4, " "), (5, '{"a": 1} x')], "id bigint, body string")
    rows = [(r.record_id, r.path, r.kind) for r in N.triples(df, "id", "body").orderBy("record_id", "path").collect()]
    assert rows == [("1", "a[]", "number"), ("1", "a[].b", "null"), ("2", "!error", "error"), ("5", "!error", "error")]


def test_single_values_count_as_position_0(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": [1, null, 2]}, null]}'), (2, '{"a": {"b": 3}}'), (3, '{"a": [}')], "id bigint, body string")
    made = N.flat_tables(df, "id", "body", {"b": ("a[].b[]", [""])})
    assert {(r.record_id, tuple(r.ordinals), r.value) for r in made["b"].collect()} == {("1", ("0", "0"), "1"), ("1", ("0", "1"), None), ("1", ("0", "2"), "2"), ("2", ("0", "0"), "3")}
    assert [tuple(r) for r in made["errors"].collect()] == [("3", "no value at 7")]


def test_tables_keep_parents_repeats_and_map_keys(spark):
    body = '{"s": [{"n": "x", "n": "y", "m": {"k": [1], "l": 2}, "t": [{"u": 5, "v": {"w": 6}}, {"u": 7}]}, {"n": null}], "other": 1}'
    df = spark.createDataFrame([(1, body, "z"), (2, None, "z"), (3, " ", "z")], "id bigint, body string, tbl string")
    t = N.flat_tables(df, "id", "body", {"s": ("s[]", ["n"]), "m": ("s[].m{}[]", [""]), "t": ("s[].t[]", ["u", "v.w"])}, ("s[].m",))
    assert {(tuple(r.ordinals), r.n, tuple(tuple(x) for x in r.overwritten)) for r in t["s"].collect()} == {(("0",), "y", (("n", "x"),)), (("1",), None, ())}
    assert {(tuple(r.parent_ordinals), r.pos, r.value) for r in t["m"].collect()} == {(("0", "k"), "0", "1"), (("0", "l"), "0", "2")}
    assert {(tuple(r.parent_ordinals), r.pos, r.u, r.v_w) for r in t["t"].collect()} == {(("0",), "0", "5", "6"), (("0",), "1", "7", None)}
    assert N.flat_tables(df.limit(0), "id", "body", {"s": ("s[]", ["n"])})["s"].count() == 0
    found = {r.ancestor: r.fields for r in N.ancestors(N.triples(df, "id", "body", ("s[].m",))).collect()}
    assert found == {"": ["other"], "s[]": ["n"], "s[].m{}": [""], "s[].m{}[]": [""], "s[].t[]": ["u", "v.w"]}


def test_long_records_take_linear_time_and_errors_leave_nothing(spark):
    took = []
    for n in (50_000, 400_000):
        body = "[" + ",".join(["1"] * n) + "]"
        df = spark.createDataFrame([(1, body)], "id bigint, body string")
        began = time.perf_counter()
        assert N.triples(df, "id", "body").count() == n
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]
    broken = spark.createDataFrame([(0, "[1]"), (1, "[" + ",".join(["1"] * 120_000) + ",]")], "id bigint, body string").coalesce(1)
    assert [(r.record_id, r.kind) for r in N.triples(broken, "id", "body").collect()] == [("0", "number"), ("1", "error")]
