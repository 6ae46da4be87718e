"""Recording blocks: streams and epochs of a block made from the given tables, time segments, partitions, failures."""

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual
from pyspark.sql.types import _parse_datatype_string

from oscilla import model
from oscilla.sources import datasets, tdt

BEGAN = 1_700_000_000.25


def record(kind, store, time, place=0, size=10, channel=0, form=0, rate=0.0):
    return np.array([(size, kind, store, channel, 0, time, place, form, rate)], tdt.RECORD).tobytes()


def mark(code, time):
    return record(tdt.MARK, bytes([code, 0, 0, 0]), time)


def strobe(kind, store, time, value=0.0):
    return record(kind, store, time, int(np.array([value]).view("<i8")[0]))


def write_block(folder, streams, epochs=(), stop=True, chunk=64):
    """streams: {store: (format, rate, start, channels x samples)}; epochs: (kind, store, time, value)."""
    folder.mkdir()
    data, heads = b"", []
    for store, (form, rate, start, x) in streams.items():
        for at in range(0, x.shape[1], chunk):
            for c, row in enumerate(x):
                part = row[at : at + chunk].astype(tdt.FORMATS[form]).tobytes()
                part += b"\0" * (-len(part) % 4)
                heads.append((BEGAN + start + at / rate, record(tdt.STREAM, store, BEGAN + start + at / rate, len(data), 10 + len(part) // 4, c + 1, form, rate)))
                data += part
    heads += [(BEGAN + t, strobe(kind, store, BEGAN + t, v)) for kind, store, t, v in epochs]
    body = b"".join(h for _, h in sorted(heads, key=lambda p: p[0]))
    ends = mark(tdt.STOP, BEGAN + 1000.0) if stop else b""
    (folder / "block.tsq").write_bytes(record(0, b"", 0.0) + mark(tdt.START, BEGAN) + body + ends)
    (folder / "block.tev").write_bytes(data)
    return str(folder)


@pytest.fixture(scope="module")
def events(spark):
    """Samples of the events table by channel."""
    rows = model.event_signal(spark, "/root/testdata/sf0.001").orderBy("channel", "i").collect()
    by = {}
    for r in rows:
        by.setdefault(r.channel, []).append(r.value)
    n = min(map(len, by.values())) // 64 * 64
    return np.array([v[:n] for _, v in sorted(by.items())])


def test_streams_of_a_block(spark, tmp_path, events):
    counts = np.round(events * 10)
    path = write_block(tmp_path / "b", {b"Wav1": (4, 1000.0, 0.0, events), b"EMG1": (2, 500.0, 0.5, counts[:2]), b"Raw_": (0, 250.0, 0.0, events[:1])})
    for split in (7, 1 << 14):
        rows = tdt.read_streams(spark, f"file://{path}", split=split).collect()
        got = {(r.store, r.channel, r.i): (r.value, r.t, r.fs) for r in rows}
        assert len(got) == len(rows) == events.size + counts[:2].size + events.shape[1]
        for c in range(len(events)):
            assert [got["Wav1", c + 1, i][0] for i in range(events.shape[1])] == events[c].tolist()
        assert [got["EMG1", 2, i][0] for i in range(events.shape[1])] == counts[1].tolist()
        assert abs(got["EMG1", 1, 10][1] - 0.52) < 1e-6 and got["EMG1", 1, 0][2] == 500.0
        assert np.allclose([got["Raw_", 1, i][0] for i in range(events.shape[1])], events[0].astype("f4"))
    assert spark.read.format("tdt").load(path).rdd.getNumPartitions() == 1 and tdt._read(spark, path, "streams", 7).rdd.getNumPartitions() >= 3


def test_time_segments_and_selections(spark, tmp_path, events):
    path = write_block(tmp_path / "b", {b"Wav1": (4, 1000.0, 0.0, events), b"EMG1": (4, 1000.0, 0.25, events)})
    got = tdt.read_streams(spark, path, ["Wav1"], [2], 0.0505, 0.1205, split=5).orderBy("i").collect()
    assert [r.value for r in got] == events[1, 51:121].tolist() and [r.i for r in got] == list(range(70))
    reader = tdt.PushedTdtReader({"path": path}, _parse_datatype_string(tdt.STREAMS))
    rest = list(reader.pushFilters([EqualTo(("store",), "Wav1"), In(("channel",), (1, 2)), GreaterThanOrEqual(("t",), 0.01), GreaterThan(("t",), 0.01), LessThanOrEqual(("t",), 0.5), LessThan(("t",), 0.5), EqualTo(("value",), 1.0)]))
    assert len(rest) == 1 and (reader.lo, reader.strict_lo, reader.hi, reader.strict_hi) == (0.01, True, 0.5, True) and reader.channels == {1, 2}
    # data outside the segment are not touched
    size = (tmp_path / "b" / "block.tev").stat().st_size
    (tmp_path / "b" / "block.tev").write_bytes((tmp_path / "b" / "block.tev").read_bytes()[: size // 8])
    assert tdt.read_streams(spark, path, ["Wav1"], [1], 0.0, 0.01).count() == 10
    with pytest.raises(Exception, match="beyond the end"):
        tdt.read_streams(spark, path).count()


def test_epochs_of_a_block(spark, tmp_path, events):
    marks = [(tdt.ON, b"Tick", 1.0, 1.0), (tdt.ON, b"Tick", 2.0, 2.0), (tdt.ON, b"Stim", 1.5, 7.5), (tdt.OFF, b"Stim", 1.75, 0.0), (tdt.ON, b"Stim", 3.0, 8.5), (tdt.OFF, b"Stim", 3.5, 0.0)]
    path = write_block(tmp_path / "b", {b"Wav1": (4, 1000.0, 0.0, events)}, marks)
    got = sorted(tuple(r) for r in tdt.read_epochs(spark, path, split=9).collect())
    assert got == [("Stim", 1.5, 1.75, 7.5), ("Stim", 3.0, 3.5, 8.5), ("Tick", 1.0, 2.0, 1.0), ("Tick", 2.0, 1000.0, 2.0)]
    assert {r.store for r in tdt.read_epochs(spark, path, ["Stim"]).collect()} == {"Stim"}
    datasets.write_epochs(tdt.read_epochs(spark, path, ["Tick"]), str(tmp_path / "epochs"))
    assert sorted(tuple(r) for r in datasets.read_epochs(spark, str(tmp_path / "epochs")).collect()) == [(1.0, 1.0, 2.0), (2.0, 2.0, 1000.0)]
    endless = write_block(tmp_path / "c", {}, marks[:1], stop=False)
    assert [tuple(r) for r in tdt.read_epochs(spark, endless).collect()] == [("Tick", 1.0, None, 1.0)]
    assert tdt.read_streams(spark, endless).count() == 0


def test_blocks_become_datasets(spark, tmp_path, events):
    path = write_block(tmp_path / "b", {b"Wav1": (4, 1000.0, 0.0, events[:2]), b"EMG1": (4, 500.0, 0.0, events[2:3])}, [(tdt.ON, b"Tick", 1.0, 1.0)])
    assert [(r.store, r.channels, r.fs, r.samples) for r in tdt.available(spark, path).orderBy("store").collect()] == [("EMG1", [1], 500.0, events.shape[1]), ("Wav1", [1, 2], 1000.0, events.shape[1])]
    made = tdt.convert(spark, path, str(tmp_path / "out"), start=0.01, end=0.05)
    assert [p.rsplit("/", 1)[1] for p in made] == ["EMG1_t0.01-0.05.ant", "Wav1_t0.01-0.05.ant", "Tick.parquet"]
    wide, meta = datasets.read_stream(spark, made[1])
    rows = wide.orderBy("i").collect()
    assert [(r["0"], r["1"]) for r in rows] == list(zip(events[0, 10:50].tolist(), events[1, 10:50].tolist())) and meta.fs == 1000.0 and meta.number_of_samples == 40
    assert meta.other["segment_info"]["segment_start_time"] == 0.01
    (array,) = tdt.convert(spark, path, str(tmp_path / "arrays"), ["EMG1"], [], form="zarr")
    from oscilla.sources import zarr

    assert [r["0"] for r in zarr.read_zarr(spark, array).orderBy("i").collect()] == events[2].tolist() and zarr.attributes(array)["metadata"]["fs"] == 500.0
    with pytest.raises(ValueError):
        tdt.convert(spark, path, str(tmp_path / "x"), form="csv")


def test_blocks_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="0 .tsq files"):
        tdt.read_streams(spark, str(tmp_path / "none")).count()
    path = write_block(tmp_path / "b", {b"Wav1": (4, 1000.0, 0.0, np.ones((1, 64)))})
    heads = np.frombuffer((tmp_path / "b" / "block.tsq").read_bytes(), tdt.RECORD).copy()
    heads["format"][heads["kind"] == tdt.STREAM] = 9
    (tmp_path / "b" / "block.tsq").write_bytes(heads.tobytes())
    with pytest.raises(Exception, match="unknown format 9 .* record 2"):
        tdt.read_streams(spark, path).count()
