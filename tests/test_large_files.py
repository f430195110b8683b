"""Text files and archives in pieces: the same lines as whole, for pieces of any size."""

import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from swellframe.operators import windows
from swellframe.sources import texts


@pytest.fixture(params=[7, 64, 1 << 20])
def piece(request, monkeypatch):
    monkeypatch.setattr(texts, "PIECE", request.param)
    monkeypatch.setattr(texts, "TASK", 3 * request.param)
    monkeypatch.setattr(texts, "LINES", 50)
    return request.param


def in_order(df):
    out = {}
    for r in df.orderBy("file", "line_no").collect():
        out.setdefault(r["file"], []).append(r["line"])
    return out


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_lines_of_pieces(spark, tmp_path, piece, ending):
    """Lines shorter and longer than a piece, empty ones, no last line break, an empty file."""
    r = random.Random(piece)
    want = {f"{i}.txt": ["x" * r.choice([0, 1, 5, 6, 7, 8, 30, 90]) + str(k) * (k % 3) for k in range(60)] for i in range(3)}
    for name, own in want.items():
        (tmp_path / name).write_text(ending.join(own) + (ending if name != "1.txt" else ""), newline="")
    (tmp_path / "empty.txt").write_text("")
    if want["1.txt"][-1] == "":
        want["1.txt"].pop()
    got = texts.lines(spark, str(tmp_path))
    assert in_order(got) == want
    assert got.groupBy("file", "line_no").count().where("count > 1").count() == 0
    if piece > 1000:
        assert {r["line_no"] for r in got.where("file = '0.txt'").collect()} == set(range(60))


def test_archives_are_read_by_index(spark, tmp_path, piece):
    """Members in folders, empty ones, long names, links and folders, a second archive; each member's lines are its own."""
    want = {}
    for a in range(2):
        with tarfile.open(tmp_path / f"{a}.tar", "w", format=tarfile.GNU_FORMAT if a else tarfile.PAX_FORMAT) as t:
            for i in range(4):
                station = f"s{a}{i}" + "é" * (i == 3)
                data = "".join(f" 20200101{k:02d} {station} {'y' * (k * 7 % 40)}\n" for k in range(i * 9)).encode("latin-1")
                folder = "deep/" * 30 if i == 2 else "out/"
                info = tarfile.TarInfo(f"{folder}gefs.{station}.ts")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
                if data:
                    want[station] = data.decode("latin-1").split("\n")[:-1]
            for kind in (tarfile.DIRTYPE, tarfile.SYMTYPE):
                info = tarfile.TarInfo(f"other{kind.decode()}")
                info.type, info.linkname = kind, "out"
                t.addfile(info)
    index = texts.tar_index(spark, str(tmp_path))
    assert index.count() == 8
    got = in_order(texts.tar_lines(spark, str(tmp_path)))
    assert {k.rstrip("é\ufffdÃ©"): v for k, v in got.items()} == {k.rstrip("é"): v for k, v in want.items()}


def test_a_large_file_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "PIECE", 1000)
    monkeypatch.setattr(texts, "TASK", 5000)
    (tmp_path / "a.txt").write_text("some line\n" * 5000)
    found = texts.lines(spark, str(tmp_path / "a.txt"))
    assert found.count() == 5000 and found.rdd.getNumPartitions() == 10


def test_values_are_carried_over_parts(spark):
    r = random.Random(1)
    rows = [(k, i * 3, r.choice([None, None, None, i])) for k in ("a", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t bigint, v int").repartition(4)
    got = {(x["k"], x["t"]): x["c"] for x in windows.carried(df, ["k"], "t", F.col("v"), "c", 20).collect()}
    last = {}
    for k, t, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[k, t] == last[k]
    assert len(got) == len(rows)


def test_spectra_steps_in_pieces(spark, tmp_path, piece):
    """Steps over several pieces and parts, of several files."""
    for name, steps in (("a", 5), ("b", 1)):
        out = ["'SPECTRA'     3     2     1 'grid'", " 0.05 0.06", " 0.07", " 0.1 1.6"]
        for k in range(steps):
            out += [f"2024010{k + 1} 000000", f"'{name}1   '  20.0 -72.7 4000.0 5.0 180.0", " ".join(str(float(10 * k + x)) for x in range(4)), " ".join(str(float(10 * k + x)) for x in (4, 5))]
        (tmp_path / f"{name}.spec").write_text("\n".join(out) + "\n")
    got = sorted(texts.spectra_text(spark, str(tmp_path)).collect(), key=lambda x: (x["file"], x["time"]))
    assert [(r["file"], r["station"], r["lat"], r["wnddir"]) for r in got] == [("a.spec", "a1", 20.0, 180.0)] * 5 + [("b.spec", "b1", 20.0, 180.0)]
    for k, r in enumerate(got[:5]):
        assert r["time"] == 1704067200.0 + 86400 * k and r["freq"] == [0.05, 0.06, 0.07] and r["dir"] == [0.1, 1.6]
        assert r["efth"] == [[10.0 * k + i + 3 * j for j in range(2)] for i in range(3)]
