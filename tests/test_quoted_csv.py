import csv
import io
import random

import pytest

from facsimile.sources import quoted_csv
from facsimile.sources.tables import _DIALECT, EmptyTableError, read_table


@pytest.fixture
def small_splits(spark):
    """Byte ranges of a few lines, so that records cross them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("499", "1", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def written(tmp_path, *texts):
    folder = tmp_path / "table.csv"
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"part-{i}.csv").write_bytes(text.encode())
    return str(folder)


def both(spark, path):
    """Rows of the parallel reader and of Spark's own, which takes a file in one task."""
    plain = spark.read.options(**_DIALECT, multiLine=True).csv(path)
    got = quoted_csv.read(spark, path, plain.columns, _DIALECT)
    assert got.columns == plain.columns
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    return key(got.collect()), key(plain.collect())


def test_end_of_a_line_by_both_assumptions():
    inside = quoted_csv.ends_inside_quotes
    for line, from_record, from_quotes in [
            (b'a,b', False, True), (b'"a,b', True, False), (b'a,"b', True, False), (b'a,"b"', False, False), (b'"a""b', True, False),
            (b'a""b', False, True), (b'5" pipe,x', False, False), (b'",', True, False), (b'","', False, True), (b'""', False, True),
            (b'"",""', False, True), (b'x"",y', False, True), (b'x",y', False, False), (b'', False, True)]:
        got = inside(line, False), inside(line, True)
        assert got == (from_record, from_quotes), line
        # by definition: the same line after an opened value
        assert got[1] == inside(b'"' + line, False), line


def test_many_tasks_read_one_file_as_one_task_does(spark, tmp_path, small_splits):
    draw = random.Random(3)
    texts, expected = [], []
    for newline in ("\n", "\r\n"):
        out = io.StringIO()
        rows = csv.writer(out, lineterminator=newline)
        rows.writerow(["id", "text", "more"])
        for i in range(200):
            body = "".join(draw.choice(['a', 'é', '"', ',', ' ', "\n", "\r\n", "\n\n", "line of text "]) for _ in range(draw.randrange(14)))
            more = draw.choice(["", "x", '"', 'q"q', "long " * 60 + "\n" + "text " * 60 if i % 50 == 0 else "y"])
            rows.writerow([i, body, more])
            expected.append(repr((str(i), body or None, more or None)))
        texts.append(out.getvalue())
    path = written(tmp_path, *texts)
    # Spark's own reader turns \r\n inside quotes into \n where records end with it; here every text stays as it is
    assert both(spark, path)[0] == sorted(expected)
    got, plain = both(spark, path + "/part-0.csv")
    assert len(plain) == 200 and got == plain
    lines = spark.read.text(path, lineSep="\n")
    assert lines.rdd.getNumPartitions() > 20


def test_bare_quotes_blank_lines_and_short_rows(spark, tmp_path, small_splits):
    path = written(tmp_path, 'h1,"h\n2",h3\n5" pipe,x,y\n\n3" pipe,"a\n\nb",z\n"",,""\nonly\n  \n1,2,3,4\n"open at the end,\nof file',
                   'h1,"h\n2",h3\n', "\n\nh1,h2,h3\n1,2,3")
    got, plain = both(spark, path)
    assert got == plain and any("a\\n\\nb" in r for r in got)


def test_read_table_takes_line_breaks_and_rejects_empty_files(spark, tmp_path):
    table = read_table(spark, written(tmp_path, 'n,t\n1,"a\nb"\nNA,c\n'), multi_line=True)
    assert dict(table.dtypes) == {"n": "bigint", "t": "string"}
    assert sorted(map(tuple, table.collect()), key=str) == [(1, "a\nb"), (None, "c")]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(EmptyTableError):
        read_table(spark, str(empty), multi_line=True)
    only = tmp_path / "only.csv"
    only.write_text('a,"b\nc"\n')
    assert read_table(spark, str(only), multi_line=True).count() == 0
