"""Recordings read in splits equal those read whole."""

import numpy as np
import pytest

from tidegrid.config import Acquisition
from tidegrid.sources import signals, split_text


@pytest.fixture()
def small_splits(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k in sizes:
        spark.conf.unset(k)


def lines(x):
    return "\n".join(" ".join(str(int(v)) for v in row) for row in x.T)


def test_files_cut_into_splits_equal_the_whole(spark, small_splits, tmp_path):
    rng = np.random.default_rng(1)
    data = {f"0000000{k}.txt": rng.integers(-1000, 1000, (3, n)) for k, n in ((1, 400), (2, 37), (3, 1))}
    data["00000004.txt"] = np.where(rng.random((3, 300)) < 0.1, data["00000001.txt"][:, :300] + 2**32 - 5000, data["00000001.txt"][:, :300])
    for name, x in data.items():
        (tmp_path / name).write_text(lines(x) + "\n")
    (tmp_path / "00000005.txt").write_text(lines(data["00000001.txt"]).replace("\n", "\n\n \n"))  # blank lines
    (tmp_path / "00000006.txt").write_text("\r\n".join(lines(data["00000002.txt"]).split("\n")))
    cfg = Acquisition()
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    samples, reports = split_text.read_split(spark, str(tmp_path), cfg)
    whole = {r.source_name: r for r in signals.read_recordings(spark, str(tmp_path), cfg).collect()}
    found = {r.source_name: r for r in reports.collect()}
    assert found.keys() == whole.keys() and len(found) == 6
    rows = {}
    for r in samples.collect():
        rows.setdefault(r.source_name, {})[r.i] = r.x
    for name, own in whole.items():
        r = found[name]
        assert own.error is None and r.error is None and (r.n_samples, r.n_wraparound_fixed) == (own.n_samples, own.n_wraparound_fixed) and r.dc_offset == pytest.approx(own.dc_offset)
        assert np.array([rows[name][i] for i in range(own.n_samples)]).T.tolist() == [list(c) for c in own.data]


def test_broken_files_are_error_rows_with_their_line(spark, small_splits, tmp_path):
    fine = "\n".join("1 2 3" for _ in range(500))
    texts = {
        "00000001.txt": fine,
        "00000002.txt": fine + "\n4 5\n" + fine + "\n6 7 8 9\n",
        "00000003.txt": "\n\n1 2 3\n1 x 3\n",
        "00000004.txt": "",
        "00000005.txt": "1 2 3\n1 nan 3",
        "00000006.txt": "1 2 3\n1 2.5 3\n1 2",
        "00000007_walk.txt": fine,
        "7.txt": fine,
        "00000008.txt": " \n\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    samples, reports = split_text.read_split(spark, str(tmp_path), Acquisition())
    errors = {r.source_name: r.error for r in reports.collect()}
    assert errors == {
        "00000001.txt": None,
        "00000002.txt": "line 501: expected 3 columns",
        "00000003.txt": "line 4: a value that is no number",
        "00000004.txt": "no samples",
        "00000005.txt": "line 2: a value that is not finite",
        "00000006.txt": "line 2: a value that is not an integer",
        "00000007_walk.txt": "task walk is not expected",
        "7.txt": "name not accepted",
        "00000008.txt": "no samples",
    }
    assert {r.source_name for r in samples.select("source_name").distinct().collect()} == {"00000001.txt"}
    long = split_text.read_split(spark, str(tmp_path), Acquisition(fs=1.0, max_seconds=100.0))[1]
    assert {r.error for r in long.filter("source_name = '00000001.txt'").collect()} == {"recording is too long"}


def test_an_empty_file_is_an_error_of_the_whole_reader_too(spark, tmp_path):
    (tmp_path / "00000001.txt").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "00000002.txt").write_text("")
    got = {r.source_name: (r.n_samples, r.error) for r in signals.read_recordings(spark, str(tmp_path), Acquisition()).collect()}
    assert got == {"00000001.txt": (2, None), "00000002.txt": (None, "expected 3 columns in every row")}
    assert {r.source_name: len(r.sha256) for r in signals.discover(spark, str(tmp_path)).collect()} == {"00000001.txt": 64, "00000002.txt": 64}
