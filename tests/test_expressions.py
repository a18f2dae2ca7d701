"""Expressions and scalar functions: the vectors of FIXTURES.md A3 and the numeric rules."""

import math

import pytest

from rillstone import StreamFrame, col, sql, value
from rillstone.errors import ParseError, PlanError
from rillstone.expr import Alias, Binary, Call, Column, Literal, Unary, Wildcard
from rillstone.functions.registry import all_functions, lookup
from rillstone.sql.parser import parse_expr
from rillstone.types import can_widen, literal_type


@pytest.fixture(scope="module")
def one(spark):
    df = spark.createDataFrame([(1, None, None, None, None, 7, 2.0, 0.0)], "id long, s string, b boolean, i int, d double, j int, x double, z double")
    frame = StreamFrame.source(df, seq="id")
    return lambda text: sql(f"select {text} as v from t", {"t": frame}).to_df().first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("chr(75)", "K"), ("chr(22909)", "好"), ("chr(i)", None), ("chr(55296)", None), ("chr(1114112)", None), ("chr(0 - 1)", None),
        ("concat('a','bc','def')", "abcdef"), ("concat('a',s,'def')", "adef"), ("concat(s,s)", None),
        ("concat_ws(',','a','bc','def')", "a,bc,def"), ("concat_ws(',','a',s,'def')", "a,def"), ("concat_ws(',',s,s)", None), ("concat_ws(s,'a')", None),
        ("encode('abc','utf8','hex')", "616263"), ("encode('616263','hex','utf8')", "abc"), ("encode('abc','utf8','base64')", "YWJj"), ("encode('YWJj','base64','utf8')", "abc"),
        ("encode('YWJj','base64','HEX')", "616263"), ("encode('616263','hex','base64')", "YWJj"), ("encode(s,'hex','utf8')", None),
        ("instr('abcabc','ca')", 2), ("instr('abcabc','de')", None), ("instr('abcabc','bc',3)", 4), ("instr('abcabc','ab',0)", 0), ("instr('abcabc','bcd',3)", None),
        ("instr('abcabc','a',-3)", 3), ("instr('abcabc','c',-2)", 2), ("instr('abcabc','c',-5)", None), ("instr('abcabc','a',0,2)", 3), ("instr('abcabc','a',2,2)", None),
        ("instr('abcabc','c',-1,1)", 5), ("instr('abcabc','c',-1,2)", 2), ("instr('abcabc','c',-1,3)", None), ("instr(s,'ca')", None),
        ("lcase('aBc')", "abc"), ("ucase('aBc')", "ABC"), ("len('aBc')", 3), ("len('好')", 3), ("len(s)", None),
        ("lpad('abc',6,'0')", "000abc"), ("lpad('abc',2,'0')", "ab"), ("lpad('abc',0,'0')", ""), ("lpad('abc',-2,'0')", None), ("lpad('abc',6,s)", None),
        ("rpad('abc',6,'0')", "abc000"), ("rpad('abc',2,'0')", "ab"), ("rpad('abc',0,'0')", ""), ("rpad('abc',-2,'0')", None), ("rpad('abc',6,s)", None),
        ("replace('abcabc','bc','A')", "aAaA"), ("replace(s,'bc','A')", None),
        ("substring('abcdef',0)", "abcdef"), ("substring('abcdef',3)", "def"), ("substring('abcdef',6)", ""), ("substring('abcdef',0,3)", "abc"), ("substring('abcdef',3,3)", "def"),
        ("substring('abcdef',3,0)", ""), ("substring('abcdef',6,1)", None), ("substring('abcdef',3,4)", None), ("substring('abcdef',0,8)", None), ("substring(s,0)", None),
        ("trim('  abc     ')", "abc"), (r"trim('\t abc \t\t    ')", "abc"), ("trim(s)", None),
        ("coalesce(i,i,88,i)", 88), ("coalesce(s,s,'haha',s)", "haha"), ("ifnull(33,44)", 33), ("ifnull(i,44)", 44), ("ifnull('a','b')", "a"), ("ifnull(s,'b')", "b"),
        ("signum(0.0)", 1.0), ("trunc(-2.5)", -2.0), ("round(-2.5)", -3.0), ("round(2.5)", 3.0), ("floor(1e300)", 1e300), ("ln(0)", -math.inf), ("sqrt(4)", 2.0), ("ln(d)", None),
        ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("2000+4/2", 2002), ("(2000+4)/2", 1002), ("-1 + 2", 1), ("1.0 / 0", math.inf), ("-1 / z", -math.inf), ("i + 1", None),
        ("1 < 2 and 2 <= 2", True), ("b and false", None), ("b or true", None), ("not b", None), ("not 1 = 2", True), ("'a' < 'b'", True), ("1 = 1.0", True), ("d = 1.0", None),
        ("5m", 300000), ("2 seconds", 2000), ("'it''s'", "it's"), (r"'a\n'", "a\n"), ("f.between(2, 3, 1)", True), ("f.between(3, 3, 1)", False),
    ],
)
def test_vectors(one, text, want):
    assert one(text) == want


def test_nan_results(one):
    assert math.isnan(one("ln(-1.0)")) and math.isnan(one("z / z")) and math.isnan(one("sqrt(-1.0)")) and math.isnan(one("asin(2.0)"))


def test_times(one):
    f = "'%Y %b %d %H:%M:%S%.3f'"
    assert one(f"parse_timestamp('1983 Apr 13 12:09:14.274', {f})").timestamp() == pytest.approx(419083754.274)
    assert one(f"parse_timestamp('1983 Apr 13 12:09:14.274', {f}, 'Asia/Shanghai')").timestamp() == pytest.approx(419054954.274)
    assert one(f"parse_timestamp(s, {f})") is None
    assert one("format_timestamp(timestamp_add(parse_timestamp('2020-01-31', '%Y-%m-%d'), 1 day), '%F')") == "2020-02-01"
    with pytest.raises(Exception, match="CANNOT_PARSE|parse"):
        one("parse_timestamp('x', '%Y')")


@pytest.mark.parametrize("text", ["1 / 0", "9223372036854775807 + j", "1 % 0", "encode('a', 'utf9', 'hex')"])
def test_runtime_errors(one, text):
    with pytest.raises(Exception):  # noqa: B017
        one(text)


@pytest.mark.parametrize("text", ["nosuch(1)", "sqrt('a')", "nosuch", "concat()", "1 + 'a'", "'a' % 1", "not 1", "f.ma(x, j)", "1.5 % 2", "s = 1"])
def test_plan_errors(one, text):
    with pytest.raises(PlanError):
        one(text)


@pytest.mark.parametrize("text", ["1 +", "(1", "a b", "'x", "5 parsecs 3", ""])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse_expr(text)


def test_parse_shapes():
    e = parse_expr("a + b * -c")
    assert isinstance(e, Binary) and e.op == "+" and isinstance(e.right.right, Unary)
    assert parse_expr("a or b and c").op == "or"
    assert parse_expr("notation").name == "notation" and parse_expr("truely").name == "truely"
    c = parse_expr("abc.sum(a, 1)")
    assert isinstance(c, Call) and c.namespace == "abc" and c.args[1].value == 1
    assert isinstance(parse_expr("t.*"), Wildcard) and parse_expr("t.a").qualifier == "t"
    assert parse_expr("a <= 3").op == "<=" and parse_expr("a <> 3").op == "!="


def test_display_and_names():
    e = (col("a") + 1).eq(value("x"))
    assert e.display() == '((a + 1) = "x")'
    assert Call("ma", (col("a"), Literal(3)), "f").display() == "f.ma(a,3)"
    assert Alias(col("a"), "b").output_name() == "b" and Column("a", "t").output_name() == "a"


def test_lattice():
    assert can_widen("int8", "int64") and can_widen("int64", "float32") and can_widen("float32", "float64") and can_widen("int8", "string")
    assert not can_widen("int64", "int32") and not can_widen("float64", "float32") and not can_widen("timestamp", "int64") and not can_widen("string", "int8")
    assert [literal_type(x) for x in (127, 128, -32769, 1 << 40, 1.5, True, "a", None)] == ["int8", "int16", "int32", "int64", "float64", "boolean", "string", "null"]


def test_users_can_add_functions(one):
    from rillstone.functions.registry import Function, exact, register, unregister

    register(Function("twice", exact("float64"), "float64", namespace="my", build=lambda types, x: x * 2))
    try:
        assert one("my.twice(j)") == 14.0
    finally:
        unregister("my", "twice")
    with pytest.raises(PlanError, match="no such function"):
        one("my.twice(j)")


def test_registry_is_complete():
    assert len(all_functions()) == 74
    assert lookup("F", "MA").name == "ma"
