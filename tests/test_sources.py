import gzip
import zipfile

import pytest

from loomframe.sources import files
from loomframe.sources.generate import create_frame


def test_guess():
    s = files.guess(["# c", "a;b;c", "1;x;2024-01-02", "2;y;2024-01-03"])
    assert (s.sep, s.header, s.names, s.types) == (";", True, ["a", "b", "c"], ["double", "string", "time"])
    assert files.guess(["1,2", "3,4"]).names == ["C1", "C2"]
    assert files.guess(["1 1:2.0 3:1", "0 2:1"]).kind == "svmlight"
    with pytest.raises(ValueError):
        files.guess(["a,a", "1,2"])


def test_number_beats_text(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('id,v,u\n1,3.5,"a,b"\n2,oops,c\n3,NA,d\n')
    rows = files.read(spark, str(p)).orderBy("id").collect()
    assert [r.v for r in rows] == [3.5, None, None] and rows[0].u == "a,b"


def test_compressed(spark, tmp_path):
    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(b"a,b\n1,x\n2,y\n"))
    assert files.read(spark, str(tmp_path / "x.csv.gz")).count() == 2
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,x\n2,y\n")
    assert [r.a for r in files.read(spark, str(tmp_path / "x.zip")).orderBy("a").collect()] == [1.0, 2.0]


def test_svmlight(spark, tmp_path):
    (tmp_path / "x.svm").write_text("1 qid:1 1:2.5 3:1\n0 2:4\n")
    assert sorted(tuple(r) for r in files.read(spark, str(tmp_path / "x.svm")).collect()) == [(0.0, 0.0, 4.0, 0.0), (1.0, 2.5, 0.0, 1.0)]


def test_round_trip(spark, tmp_path):
    df = create_frame(spark, 50, 5, seed=2)
    files.export(df, str(tmp_path / "out"))
    assert files.read(spark, str(tmp_path / "out")).count() == 50
    assert len(list(files.csv_lines(df, hex_doubles=True))) == 51
    assert files.upload(spark, b"a,b\n1,2\n").first().b == 2.0


def test_created_frames_do_not_depend_on_partitions(spark):
    a = create_frame(spark, 200, 6, seed=3).collect()
    b = create_frame(spark, 200, 6, seed=3).repartition(5).orderBy("id").collect()
    assert sorted(a) == sorted(b) if all(None not in r for r in a) else {tuple(r) for r in a} == {tuple(r) for r in b}


def test_svmlight_rows_are_whole(spark, tmp_path):
    path = tmp_path / "wide.svm"
    path.write_text("1 " + " ".join(f"{i}:0" for i in range(3, 1_000_003)) + " 1:7 # end\n2 qid:4 2:5\n3\n")
    got = files.read_svmlight(spark, [str(path)], 2).collect()
    assert [(r.target, r.C1, r.C2) for r in got] == [(1.0, 7.0, 0.0), (2.0, 0.0, 5.0), (3.0, 0.0, 0.0)]
