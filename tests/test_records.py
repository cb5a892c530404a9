"""Records with line breaks read by many tasks are those of a read by one task."""
import random

import pytest

from modelscout.sources import read_table, scratch_path, write_table
from modelscout.sources import records as R


@pytest.fixture
def small_ranges(spark):
    """Files are dealt out in ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def deal(size):
        for n, v in zip(names, (str(size), str(size), "1000000")):
            spark.conf.set(n, v)

    yield deal
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def one_task(spark, path, sep=","):
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return sorted(map(tuple, reader.csv(path).collect()), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


FIELDS = ["", "plain", "with , comma", 'quo"te', '"', '""', "two\nlines", "\n", '",\n"', "ends with quote\"\n", " blanks ", "é\n日本", "x" * 90 + "\n" + "y" * 90, 'a"b\n"c', '\n"\n', "5", "NA"]


def quoted(text):
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


def build(folder, end="\n", seed=0, n=60, files=1, last=True):
    rng = random.Random(seed)
    for k in range(files):
        lines = ["a,b,c"]
        for i in range(n):
            lines.append(",".join([str(i + 1000 * k), quoted(rng.choice(FIELDS)), quoted(rng.choice(FIELDS))]))
            if rng.random() < 0.05:
                lines.append("")
        (folder / f"{k}.csv").write_bytes((end.join(lines) + (end if last else "")).encode())
    return str(folder)


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 27])
def test_equals_the_read_by_one_task(spark, tmp_path, small_ranges, size):
    path = build(tmp_path, n=8 if size == 7 else 60, files=2, last=size != 64)
    want = one_task(spark, path)
    small_ranges(size)
    ranges = R.find_ranges(spark, path, ",")
    assert not ranges.plain and ranges.split == (size < 1 << 27)
    df = read_table(spark, path, "csv", schema="a string, b string, c string")
    assert rows_of(df) == want
    if size == 64:
        assert df.rdd.getNumPartitions() > 10 and ranges.inside.any() and not ranges.inside.all()
        # types by the one rule, markers blanked
        typed = read_table(spark, path, "csv", null_values=["NA"])
        assert typed.dtypes == [("a", "int"), ("b", "string"), ("c", "string")]
        assert sorted(str(r[1]) for r in typed.collect()) == sorted("None" if r[1] == "NA" else str(r[1]) for r in want)


def test_carriage_returns(spark, tmp_path, small_ranges):
    path = build(tmp_path, end="\r\n")
    want = one_task(spark, path)
    small_ranges(50)
    assert rows_of(read_table(spark, path, "csv", schema="a string, b string, c string")) == want


def test_quotes_out_of_place(spark, tmp_path, small_ranges):
    """A quote within a field that does not begin with one is a character; what follows a closing quote goes on to the separator."""
    text = 'a,b,c\n1,5" disk,x\n2,"in"side,y\n3,a "b, c"\n4,"x\ny",z\n5,\' "q",w\n6,"""","\n"""\n7,x""y,"1,\n2"\n'
    (tmp_path / "f.csv").write_text(text * 1)
    path = str(tmp_path)
    want = one_task(spark, path)
    small_ranges(9)
    assert rows_of(read_table(spark, path, "csv", schema="a string, b string, c string")) == want


def test_column_names_over_two_lines(spark, tmp_path, small_ranges):
    (tmp_path / "f.csv").write_text('"a\nb",c\n1,"x\ny"\n2,z\n')
    small_ranges(4)
    df = read_table(spark, str(tmp_path), "csv")
    assert df.columns == ["a\nb", "c"] and rows_of(df) == [(1, "x\ny"), (2, "z")]


def test_plain_files_are_left_to_the_reader_of_lines(spark, make, small_ranges):
    path = write_table(make([(i, f"text {i}", 'q"' if i % 7 else None) for i in range(500)], "i int, t string, q string").coalesce(1), scratch_path(spark, "t"), "csv")
    small_ranges(100)
    ranges = R.find_ranges(spark, path, ",")
    assert ranges.plain and ranges.split and not ranges.inside.any()
    df = read_table(spark, path, "csv")
    assert df.count() == 500 and df.rdd.getNumPartitions() > 20 and "MapInArrow" not in df._jdf.queryExecution().toString()


def test_other_ranges_than_looked_through_are_an_error(spark, tmp_path, small_ranges):
    path = build(tmp_path)
    small_ranges(100)
    df = read_table(spark, path, "csv", schema="a string, b string, c string")
    small_ranges(300)
    with pytest.raises(Exception, match="read them again"):
        df.collect()


def test_stays_open():
    cases = {
        "a,b": (False, False), '"a': (True, False), 'a,"b': (True, False), 'x"y': (False, False), '"a""': (True, True), '""': (False, True),
        '"","': (True, True), "": (False, True), ',"a"b"c",d': (False, False), '"""': (True, False),
    }
    for line, (outside, inside) in cases.items():
        assert R.stays_open(line, False, ",") == outside, line
    assert R.stays_open('end","next', True, ",") and not R.stays_open('end",next', True, ",") and R.stays_open('no ""', True, ",")
    assert not R.stays_open('a""', False, ",") and R.stays_open('\t"x', False, "\t")


def test_empty_folder_of_names_only(spark, tmp_path, small_ranges):
    (tmp_path / "f.csv").write_text("a,b\n")
    assert read_table(spark, str(tmp_path), "csv").collect() == []
