import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grovelight.sources.record_lines import Rejected, bisected, parse_block, parse_lines, rejected_lines, strict, valid_records

def parsed(lines, fmt, features, classes):
    """A record or a reason for each line."""
    runs, rest = parse_block(pa.array(lines, pa.string()), fmt, features, classes)
    out = dict(rest)
    for places, cols in runs:
        out |= dict(zip(places.tolist(), zip(*(c.to_pylist() for c in cols), strict=True), strict=True))
    return [out[k] for k in range(len(lines))]


SVM = [
    ("1 1:2.5 3:-1e2 4:NaN", None), (" -1  2:0 ", None), ("0", None), ("+1.0 1:1", None), ("1 1:1 .5", "pair"), ("1 :5", "index"), ("1 2:1 2:1", "ascending"), ("1 3:1 2:1", "ascending"),
    ("1 0:1", "outside"), ("1 9:1", "outside"), ("1.5 1:1", "whole"), ("3 1:1", "class"), ("yes 1:1", "label"), ("NaN 1:1", "label"), ("1 1:1e999", "range"), ("1 1:", "value"), ("1 1:.5", "value"),
    ("1 1:5.", "value"), ("1 1:inf", "value"), ("1 1:1_0", "value"), ("1 1:٣", "value"), ("1 1:2:3", "value"), ("1\t1:2", "label"), ("1 1.0:2", "index"), ("1e999 1:1", "range"), ("-1e999 1:1", "range"),
]
ARFF = [
    ("1,2,3,0", None), (" 1 , ?,,2", None), ("'1',\"2\",NaN,'1'", None), ("1,2,3,-4", None), ("1,2,0", "few"), ("1,2,3,4,0", "many"), ("1,'2,3,0", "quot"), ("1,'2\",3,0", "quot"), ("1,2'3,3,0", "quot"),
    ("1,''2'',3,0", "quot"), ("1,2,3,?", "label"), ("1,2,3,", "label"), ("1,2,x,0", "value"), ("1,1 .5,3,0", "value"), ("1,2,1e400,0", "range"), ("1,2,3,3", "class"), ("1,2,3,0.5", "whole"), ("1;2;3;0", "few"), ("", "few"),
]


@pytest.mark.parametrize("fmt,cases", [("LIBSVM", SVM), ("ARFF", ARFF)])
def test_reasons(fmt, cases):
    lines = [x for x, _ in cases]
    n = 4 if fmt == "LIBSVM" else 3
    for (line, reason), got in zip(cases, parsed([x.strip(" ") for x in lines], fmt, n, 3), strict=True):
        if reason is None:
            assert not isinstance(got, str), (line, got)
        else:
            assert isinstance(got, str) and reason in got, (line, got)


def test_record_values():
    assert strict("3 1:2596 20:51 37:3", "LIBSVM", 54, 7) == (3, [0, 19, 36], [2596.0, 51.0, 3.0])
    assert strict("5.1,3.5,1.4,0.2,0", "ARFF", 4, 3) == (0, [0, 1, 2, 3], [5.1, 3.5, 1.4, 0.2])
    assert strict("-1 1:NaN", "LIBSVM", 2, 2) == (0, [0], [None])


FIELD = st.one_of(st.floats(allow_nan=False).map(repr), st.sampled_from(["?", "", "NaN", "'1'", "x", "1e5", "+3", "1 ", "0.5", '"2"']))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=3, max_size=4), min_size=1, max_size=12))
def test_bulk_equals_strict(rows):
    lines = [",".join(r).strip(" ") for r in rows]
    for line, got in zip(lines, parsed(lines, "ARFF", 2, 50), strict=True):
        try:
            want = strict(line, "ARFF", 2, 50)
        except Rejected as e:
            want = str(e)
        assert got == want


PAIR = st.one_of(st.sampled_from(["1:2", "2:NaN", "3:1e5", "3:+1.5", "4:1e300", "2:0x1", "1:", ":3", "5:1", "0:1", "2:1:1", "x"]), st.tuples(st.integers(1, 4), st.floats(allow_nan=False, allow_infinity=False)).map(lambda t: f"{t[0]}:{t[1]!r}"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["0", "1", "-1", "+2", "1.0", "2.5", "9", "1e999", "a"]), st.lists(PAIR, max_size=4), st.sampled_from([" ", "  "])), min_size=1, max_size=12))
def test_columns_equal_strict_for_pairs(rows):
    lines = [sep.join([label, *pairs]) for label, pairs, sep in rows]
    for line, got in zip(lines, parsed(lines, "LIBSVM", 4, 3), strict=True):
        try:
            want = strict(line, "LIBSVM", 4, 3)
        except Rejected as e:
            want = str(e)
        assert got == want


@given(st.lists(st.booleans(), max_size=70))
def test_bisection_isolates_bad_lines(bad):
    runs, alone = bisected(np.array(bad, bool))
    assert sorted(alone) == [k for k, x in enumerate(bad) if x]
    assert sorted(k for a, b in runs for k in range(a, b)) == [k for k, x in enumerate(bad) if not x]


def test_table(spark):
    files = spark.createDataFrame([("a", "LIBSVM", "s", 4, 3), ("b", "ARFF", "s", 2, 2), ("c", None, "s", None, None), ("a", "LIBSVM", "s", 4, 3), ("d", "ARFF", "s", 2, 2), ("d", "ARFF", "s", 3, 2)], "file_id string, fmt string, source string, num_features int, num_classes int")
    rows = [(1, "a", 1, "1 1:2"), (2, "a", 2, "# note"), (3, "a", 3, "  "), (4, "a", 4, "% 1"), (5, "b", 1, "@data"), (6, "b", 2, "1,2,0"), (7, "b", 3, None), (8, "c", 1, "1"), (9, None, 1, "1"), (11, "d", 1, "1,2,0"), (1, "a", 1, "1 1:2"), (10, "a", 9, "1 " + " ".join(["1:1"] * 20000))]
    lines = spark.createDataFrame([(*r, "clash", 5) for r in rows], "line_id long, file_id string, line_no int, raw_line string, fmt string, num_features int")
    p = parse_lines(lines, files).cache()
    assert sorted(r.line_id for r in valid_records(p).collect()) == [1, 1, 6]
    assert sorted((r.line_id, r.reason.split(":")[0]) for r in rejected_lines(p).collect()) == [(4, "label"), (7, "line"), (8, "file"), (9, "file"), (10, "index"), (11, "file")]
    assert parse_lines(lines.limit(0), files.limit(0)).count() == 0
    assert math.isclose(p.filter("line_id = 6").first().val[1], 2.0)
