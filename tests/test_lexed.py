"""Records across line ends: pieces of a few bytes give what whole files give."""

import csv
import io
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quadweave import Mapping, csv_source, ref, template, triples_map
from quadweave.sources.lexed import csv_lexer, pieces, read_records, turtle_lexer
from quadweave.sources.logical import read_csv

V = "http://example.org/"


@pytest.fixture
def tiny_pieces(spark):
    """Files are read in pieces of 64 bytes."""
    values = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b"}
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def written(folder, texts):
    for i, text in enumerate(texts):
        (folder / f"f{i}.csv").write_bytes(text.encode())
    return str(folder)


CELLS = ["", "a", "line\nbreak", 'quote " inside', '"', ",", "\n", 'x",\n"y', "ends with\n", "ä€😀", "two\n\nbreaks", "long " * 30]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_pieces_is_csv_whole(spark, tmp_path, tiny_pieces, end):
    rng = random.Random(5)
    texts, expected = [], []
    for _ in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", "na me", "x`y"])
        for _ in range(60):
            row = [str(rng.randint(0, 9)), rng.choice(CELLS), rng.choice(CELLS)]
            expected.append(tuple(row))
            writer.writerow(row)
        texts.append(out.getvalue())
    frame = read_csv(spark, written(tmp_path, texts))
    assert frame.columns == ["id", "na me", "x`y"] and frame.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, frame.collect())) == sorted(expected)


def test_quotes_that_open_no_field(spark, tmp_path, tiny_pieces):
    text = 'id,size,note\n1,5" pipe,plain\n2,"a ""b""\nc",end\n3, "x",y\n\n4,"","last ""line"""\n5,"no end of line","z"'
    frame = read_csv(spark, written(tmp_path, [text]))
    assert sorted(map(tuple, frame.collect())) == [
        ("1", '5" pipe', "plain"), ("2", 'a "b"\nc', "end"), ("3", ' "x"', "y"), ("4", "", 'last "line"'), ("5", "no end of line", "z")
    ]


def test_a_record_over_many_pieces(spark, tmp_path, tiny_pieces):
    note = "\n".join(f"line {i} of a long note" for i in range(100))
    texts = [f'id,note\n1,"{note}"\n2,short\n', '"id","head\ner"\n3,x\n', f'id,note\n4,"{note}"']
    found = {r[0]: r[1] for r in read_csv(spark, written(tmp_path, texts)).collect()}
    assert found == {"1": note, "2": "short", "3": "x", "4": note}


def test_other_separator_and_null_value(spark, tmp_path, tiny_pieces):
    text = 'id|note\n1|"a|b\n,c"\n2|-\n3|""\n'
    frame = read_csv(spark, written(tmp_path, [text]), {"sep": "|", "null_value": "-"})
    assert sorted(map(tuple, frame.collect())) == [("1", "a|b\n,c"), ("2", None), ("3", "")]


@pytest.mark.parametrize("row", ["1", "1,2,3"])
def test_a_row_of_another_length_is_an_error(spark, tmp_path, tiny_pieces, row):
    path = written(tmp_path, [f"a,b\n{row}\n"])
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        read_csv(spark, path).collect()


def test_header_only_and_empty_files(spark, tmp_path, tiny_pieces):
    assert read_csv(spark, written(tmp_path, ["a,b\n", "", "a,b\n1,2"])).collect() == [("1", "2")]


def test_a_csv_source_is_read_by_many_tasks_without_options(spark, tmp_path, tiny_pieces):
    rows = "\n".join(f'{i},"name\n{i}"' for i in range(50))
    written(tmp_path, ["id,name\n" + rows])
    item = triples_map("m", csv_source("f0.csv"), template("m/{id}")).add(V + "name", ref("name"))
    frame = Mapping.of(item).run(spark, root=str(tmp_path))
    assert frame.rdd.getNumPartitions() > 5
    assert {r.o for r in frame.collect()} == {f"name\n{i}" for i in range(50)}


def test_states_are_composed_per_file(spark, tmp_path, tiny_pieces):
    path = written(tmp_path, ['a\n"' + "x\n" * 100 + '"\nb\n' + "c\n" * 50])
    rows = pieces(spark, [path], csv_lexer()).orderBy("block").collect()
    assert [r.state for r in rows] == [0, *[1] * (len(rows) - 3), 0, 0] or {r.state for r in rows} == {0, 1}
    opened = [r for r in rows if r.state == 1]
    assert opened and {r.origin for r in opened} == {0} and rows[-1].end == 0


@pytest.mark.parametrize(
    ("text", "states"),
    [
        ("ex:a ex:b ex:c .", [0]),
        ("ex:a ex:b\n ex:c . # no end .\n# . \n ex:d\n", [1, 0, 0, 1, 1]),
        ('ex:a ex:b """one .\n# two .\n"" three """ .\n', [2, 2, 0, 0]),
        ("ex:a ex:b '''it's .\n'''' .\n", [3, 0, 0]),
        ("ex:a.b ex:c 1.5 , 3. \n", [0, 0]),
        ("ex:a <http://x/a.b#c.> 'a.' .", [0]),
        (r"ex:a ex:b ex:c\., 'it\'s' , ex:d" + "\n.", [1, 0]),
        ("ex:g { ex:a ex:b ex:c . \n ex:d ex:e '''x\n''' . } \nex:a ex:b ex:c .", [4, 6, 0, 0]),
        ("[] ex:b ( 1 2\n ) ; ex:c [ ex:d 5 ] .", [1, 0]),
    ],
)
def test_turtle_states(text, states):
    lexer, found = turtle_lexer(), [0]
    for line in text.split("\n"):
        found.append(lexer.line(line, found[-1]))
        easy = lexer.easy(line)
        assert easy is None or list(easy) == [lexer.line(line, state) for state in range(lexer.states)]
    assert found[1:] == states


def test_records_of_turtle_are_statements(spark, tmp_path, tiny_pieces):
    statements = ['ex:a ex:b """x .\n y .\n""" .', "# note .\nex:c ex:d\n  ex:e .", "ex:g { ex:a ex:b 1 .\n ex:c ex:d 2 . }"] * 20
    path = written(tmp_path, ["\n".join(statements)])
    for chunk in (0, 100):
        rows = read_records(spark, [path], turtle_lexer(), chunk).orderBy("block", "number").collect()
        assert "\n".join(r.value for r in rows) == "\n".join(statements)
        assert len(rows) == 80 if chunk == 0 else 20 <= len(rows) < 60  # a comment is a record of its own
    assert len(set(itertools.chain.from_iterable([[r.block for r in rows]]))) > 10
    assert read_records(spark, [path], turtle_lexer()).where(F.length("value") == 0).isEmpty()
