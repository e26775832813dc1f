import pytest

from factloom.code import structural as s


def test_metavariables_and_ellipsis():
    assert s.match("unserialize($X)", "\\UnSerialize( ( $_GET['a'] ) )") == {"$X": "$_GET['a']"}
    assert s.match("f($X, $X)", "f($a [ 'k' ], $a[\"k\"])") == {"$X": "$a [ 'k' ]"}
    assert s.match("f($X, $X)", "f($a, $b)") is None
    assert s.match("f(..., $LAST)", "f(1, g(2), $c)") == {"$LAST": "$c"}
    assert s.match("f($A, ...)", "f($a)") == {"$A": "$a"} and s.match("f(...)", "f()") == {}
    assert s.match("f($A, $B)", "f($a)") is None
    assert s.match("$O->run($A)", "$this->db->run(1 + 2)") == {"$O": "$this->db", "$A": "1 + 2"}
    assert s.match("f(['k' => false])", "f(array(\"k\" => FALSE))") == {}
    assert s.match("$X", None) is None and s.match("f($X)", "f($x") is None


def test_compile():
    assert s.callees("\\F($X)") == ["f"] and s.callees("$A->b()") == []
    with pytest.raises(ValueError):
        s.compile_pattern("if (")


def test_column(spark):
    df = spark.createDataFrame([("f($a)", "f", "function"), ("g(1)", "g", "function"), (None, "f", "function"), ("f(null)", "f", "function")], "text string, callee string, how string")
    got = s.calls_matching(df, "f($X)", ("f(null)",)).collect()
    assert [(r.text, r.bindings) for r in got] == [("f($a)", {"$X": "$a"})]
