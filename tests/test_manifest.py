import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from factloom.functions import jsonread
from factloom.plans.code import ORACLE, QUERIES
from oracle import connect, same


def write(folder, contents, more=()):
    rows = [(i, 1, f"p{i}/composer.JSON", c) for i, c in enumerate(contents)] + list(more)
    cols = dict(zip(("file_id", "repo_id", "file_path", "content"), map(list, zip(*rows))))
    schema = pa.schema([("file_id", pa.int64()), ("repo_id", pa.int32()), ("file_path", pa.string()), ("content", pa.binary())])
    pq.write_table(pa.table(cols, schema), f"{folder}/source_file.parquet")
    return str(folder)


def test_manifest_of_bytes_that_are_no_text_or_no_object(spark, tmp_path):
    texts = [
        b'{"name": "a/b", "type": "library", "version": "1.2"}', b'\x89\x00IMG\xff', b'{"name": "nul"}\x00', b'{"name": "tail"} x', b'{"name": "two"} {"name": "b"}', b'\xef\xbb\xbf{"name": "mark"}', None, b"", b"[]",
        b'{"name": "first", "name": "second"}', b'{"name": "comma",}', b'{"name": "nan", "x": NaN}', b'{"name": 5, "type": {"b": 1, "a": []}, "version": 2.10}', b'{"name": null}', b'{"name": "half \\ud800"}', b'{"name": "deep", "x": ' + b"[" * 3000 + b"]" * 3000 + b"}",
    ]
    good = texts[0]
    more = [(0, 1, "p0/composer.JSON", good), (0, 1, "other.json", good), (None, 2, "n.json", good), (None, 2, "n.json", good), (90, 1, "x.php", b"\xff")]
    d = write(tmp_path, texts, more)
    same(QUERIES["q_manifest"](spark, d), connect(d), ORACLE["q_manifest"])
    # the SQL stops at bytes that are not UTF-8 and have no NUL; such a file is no manifest
    d = write(tmp_path, [good, b'{"name": "\xff"}', b'{"name": "cut \xc3', b'{"name": "\xed\xa0\x80"}', b'{"name": "\xc0\x80"}'])
    assert [(r.file_id, r.name) for r in QUERIES["q_manifest"](spark, d).collect()] == [(0, "a/b")]


def test_json_as_the_sql_engine_shows_it():
    con = duckdb.connect()
    numbers = "1 -0 1.0 2.10 1e5 1E20 1e21 1e-6 1e-7 -1.5e-7 1e400 -0.0 0e9 18446744073709551616 123456789012345678901234567890 4.35 5e-324 NaN -inf Infinity 01 1. +1 - .5 1e".split()
    others = ["[1, 2.0,]", "[,]", '{"b":1,"a":"\\u00e9\\/\\u001f\\\\u001f\\"","b":{}}', '"\\ud83d\\ude00"', '"\\udc00"', '["\t"]', "[null, true ,false]", "{,}", '{"a":1,}', "[[[]]", "[]]", '{"a" 1}', '{"a":}', "tru", "'a'", '"\\x"']
    for t in numbers + others:
        text = '{"name":' + t + "}"
        want = con.execute("SELECT CASE WHEN json_valid(?) THEN ?::JSON->>'name' END", [text, text]).fetchone()[0]
        assert jsonread.shown(jsonread.member(jsonread.document(text.encode()), "name")) == want, t


def test_classes_at_their_place_beside_a_file_that_is_no_text(spark, tmp_path):
    psr4 = b'{"autoload": {"psr-4": '
    texts = [
        b"\x89\x00IMG\xff", psr4 + b'{"App\\\\": "src", "App\\\\B\\\\": ["x", "y/"], "App": null, "A": "a/", "": "r/", "aPP\\\\": "w//", "App\\\\X": "z/\\n"}}}',
        psr4 + b'["App"]}}', psr4 + b'"App"}}', psr4 + b'{"App\\\\": "one/", "App\\\\": 2.0}}, "autoload": {"psr-4": {"App\\\\": "never"}}}', psr4 + b'{"App\\\\": "nul/"}}}\x00', psr4 + b'{"App\\\\": "tail/"}}}]', b'{"autoload": []}',
    ]
    rows = [(1, 1, "App\\X", "src/X.php"), (1, 1, "App\\X", "src/X.php"), (2, 1, "app\\B\\Y", "x/Y.php"), (3, 2, "App\\X", "src/X.php"), (4, 1, None, "a"), (5, 1, "App\\Z", None), (6, 1, "Apple", "x"), (7, 1, "\\App\\X", "src/X.php"), (8, 1, "App", "src/App.php")]
    pq.write_table(pa.table(dict(zip(("class_id", "repo_id", "full_name", "file_path"), zip(*rows)))), f"{tmp_path}/class_symbol.parquet")
    d = write(tmp_path, texts)
    same(QUERIES["q_psr4"](spark, d), connect(d), ORACLE["q_psr4"])
    n = QUERIES["q_psr4"](spark, d).count()
    # the SQL stops at bytes that are not UTF-8 and have no NUL
    d = write(tmp_path, [*texts, psr4 + b'{"App\\\\": "\xff"}}}'])
    assert QUERIES["q_psr4"](spark, d).count() == n > 0
