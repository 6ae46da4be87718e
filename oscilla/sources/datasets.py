"""Stored streams and events: Parquet with a JSON side-car; sorted-spike folders."""

from __future__ import annotations

import io
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.model import SignalMeta, wide_to_long


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the file system that the path names, whichever it is."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _listed(spark: SparkSession, folder: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p))


def write_stream(wide: DataFrame, folder: str, meta: SignalMeta, channels: list[str] | None = None) -> str:
    """``data_<name>.parquet`` (i and one column for each channel, named 0..n-1, sorted by i in each file) and ``metadata_<name>.json``."""
    spark = wide.sparkSession
    channels = channels or [c for c in wide.columns if c != "i"]
    rows = wide.select("i", *(F.col(c).alias(str(k)) for k, c in enumerate(channels))).repartitionByRange("i").sortWithinPartitions("i")
    rows.write.option("compression", "snappy").mode("overwrite").parquet(f"{folder}/data_{meta.name}.parquet")
    meta.channel_names = meta.channel_names or [str(k) for k in range(len(channels))]
    meta.number_of_samples = meta.number_of_samples or (wide.agg(F.max("i")).first()[0] or -1) + 1
    _write_text(spark, f"{folder}/metadata_{meta.name}.json", meta.to_json())
    return folder


def read_meta(spark: SparkSession, folder: str) -> SignalMeta | None:
    names = [n for n in _listed(spark, folder) if n.startswith("metadata_") and n.endswith(".json")]
    if not names:
        return None
    return SignalMeta.from_json(spark.read.text(f"{folder}/{names[0]}", wholetext=True).first()[0])


def read_stream(spark: SparkSession, folder: str) -> tuple[DataFrame, SignalMeta | None]:
    """The wide signal and its metadata (None without a side-car); a direct .parquet path is read as it is."""
    if folder.endswith(".parquet"):
        return spark.read.parquet(folder), None
    data = [n for n in _listed(spark, folder) if n.startswith("data_") and n.endswith(".parquet")]
    if not data:
        raise FileNotFoundError(f"no data_*.parquet in {folder}")
    return spark.read.parquet(f"{folder}/{data[0]}"), read_meta(spark, folder)


def traces(spark: SparkSession, folder: str, start: int = 0, end: int | None = None, channels: list[int] | None = None, long: bool = True) -> DataFrame:
    """Samples [start, end) of some channels: the range and the columns reach the scan."""
    wide, _ = read_stream(spark, folder)
    names = [str(c) for c in channels] if channels is not None else [c for c in wide.columns if c != "i"]
    rows = wide.select("i", *names).where(F.col("i") >= start)
    rows = rows if end is None else rows.where(F.col("i") < end)
    if not long:
        return rows
    out = wide_to_long(rows, names)
    return out if channels is None else out.withColumn("channel", F.element_at(F.array(*map(F.lit, channels)), F.col("channel") + 1))


def time_vector(df: DataFrame, fs: float) -> DataFrame:
    return df.withColumn("t", F.col("i") / fs)


def write_epochs(events: DataFrame, path: str) -> None:
    """data, onset, offset as doubles (seconds)."""
    events.select(*(F.col(c).cast("double").alias(c) for c in ("data", "onset", "offset"))).write.mode("overwrite").parquet(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- sorted spikes ----------------------------------------------------------------------------


def _array(spark: SparkSession, path: str) -> np.ndarray:
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return np.load(io.BytesIO(bytes(content)), allow_pickle=False)


def read_params(text: str) -> dict:
    """key = value lines: numbers, booleans and quoted strings."""
    out: dict = {}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        if not sep or key.strip().startswith("#"):
            continue
        value = value.strip().strip("'\"")
        if value in ("True", "False"):
            out[key.strip()] = value == "True"
            continue
        try:
            out[key.strip()] = float(value) if "." in value or "e" in value.lower() else int(value)
        except ValueError:
            out[key.strip()] = value
    return out


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster properties: cluster_info if there is one, else cluster_group (or the spikes' clusters) with every other property table joined on."""
    names = [n for n in _listed(spark, folder) if n.startswith("cluster_") and n.endswith((".tsv", ".csv"))]
    table = lambda n: spark.read.csv(f"{folder}/{n}", header=True, sep="\t" if n.endswith(".tsv") else ",", inferSchema=True)
    info = [n for n in names if n.startswith("cluster_info")]
    if len(info) == 1:
        out = table(info[0])
    else:
        group = [n for n in names if n.startswith("cluster_group")]
        base = table(group[0]) if group else spark.createDataFrame([(int(c),) for c in np.unique(_array(spark, f"{folder}/spike_clusters.npy"))], "cluster_id int")
        out = base
        for n in names:
            if n in group:
                continue
            more = table(n)
            more = more.toDF(*(c if c == "cluster_id" or c not in out.columns else f"{c}_repeat" for c in more.columns))
            out = out.join(more, "cluster_id", "left")
    out = out.withColumnRenamed("id", "cluster_id") if "cluster_id" not in out.columns and "id" in out.columns else out
    return out.withColumn("group", F.coalesce("group", F.lit("unsorted"))) if "group" in out.columns else out.withColumn("group", F.lit("unsorted"))


def read_sorting(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), good_only: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """spikes (unit_id, sample), units, and the parameters of a template-sorting folder."""
    names = _listed(spark, folder)
    params = read_params(spark.read.text(f"{folder}/params.py", wholetext=True).first()[0]) if "params.py" in names else {}
    times = _array(spark, f"{folder}/spike_times.npy").ravel()
    which = "spike_clusters.npy" if "spike_clusters.npy" in names else "spike_templates.npy"
    clusters = _array(spark, f"{folder}/{which}").ravel()
    import pandas as pd

    spikes = spark.createDataFrame(pd.DataFrame({"unit_id": clusters.astype("int32"), "sample": times.astype("int64")}), "unit_id int, sample long")
    units = read_units(spark, folder)
    units = units.where(~F.col("group").isin(list(exclude))) if exclude else units
    if good_only and "KSLabel" in units.columns:
        units = units.where("KSLabel = 'good'")
    units = units.withColumn("unit_id", F.col("cluster_id").cast("int"))
    return spikes.join(units.select("unit_id"), "unit_id", "left_semi"), units, params


def derived_folder(base: str, elsewhere: str | None = None) -> str:
    """Where a recording's derived data belongs: drv_<recording> inside it, or under its parent's name elsewhere."""
    base = base.rstrip("/")
    parent, name = os.path.split(base)
    return f"{elsewhere.rstrip('/')}/{os.path.basename(parent)}/drv_{name}" if elsewhere else f"{base}/drv_{name}"


def stream_folder(derived: str, name: str) -> str:
    """The folder of one stream of a recording."""
    return f"{derived.rstrip('/')}/{name}.ant"


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Template waveforms of a sorting folder: template, offset, channel, value; channels by channel_map.npy where there is one.

    Templates are a few hundred arrays, whatever the recording's length.
    """
    import pandas as pd

    names = _listed(spark, folder)
    t = _array(spark, f"{folder}/templates.npy")
    k, j, c = (x.ravel() for x in np.indices(t.shape))
    channel = _array(spark, f"{folder}/channel_map.npy").ravel()[c] if "channel_map.npy" in names else c
    rows = pd.DataFrame({"template": k.astype("int32"), "offset": j.astype("int32"), "channel": channel.astype("int32"), "value": t.ravel().astype(float)})
    return spark.createDataFrame(rows, "template int, offset int, channel int, value double")


def _column_files(rows: DataFrame, columns: dict[str, tuple[str, str, tuple[int, ...]]]) -> int:
    """Columns of a sorted table as .npy files, filled part by part: the driver holds one part at a time."""
    n = rows.count()
    files = {c: np.lib.format.open_memmap(path, "w+", kind, (n, *width)) if n else np.zeros((0, *width), kind) for c, (path, kind, width) in columns.items()}
    at = 0
    buffer: list = []

    def flush() -> None:
        nonlocal at, buffer
        for c, f in files.items():
            if buffer:
                f[at : at + len(buffer)] = [r[c] for r in buffer]
        at, buffer = at + len(buffer), []

    for r in rows.toLocalIterator():
        buffer.append(r)
        if len(buffer) == 1 << 16:
            flush()
    flush()
    for c, f in files.items():
        if n:
            f.flush()
        else:
            np.save(columns[c][0], f)
    return n


def write_sorting(folder: str, spikes: DataFrame, units: DataFrame, fs: float, templates: np.ndarray | None = None, positions: np.ndarray | None = None) -> str:
    """A sorting folder on the driver's disk, for viewers: arrays, cluster groups, parameters, template similarity.

    Spikes may carry ``amplitude`` and ``components`` (an array of equal length for each spike); both are written.
    """
    os.makedirs(folder, exist_ok=True)
    wanted = {"sample": (f"{folder}/spike_times.npy", "int64", ()), "unit_id": (f"{folder}/spike_clusters.npy", "int32", ())}
    if "amplitude" in spikes.columns:
        wanted["amplitude"] = f"{folder}/amplitudes.npy", "float64", ()
    rows = spikes.orderBy("sample", "unit_id")
    width = spikes.select(F.max(F.size("components"))).first()[0] if "components" in spikes.columns else None
    if width:
        wanted["components"] = f"{folder}/pc_features.npy", "float32", (width,)
    _column_files(rows.select(*wanted), wanted)
    if templates is not None:
        flat = templates.reshape(len(templates), -1)
        norm = np.linalg.norm(flat, axis=1)
        unit = flat / np.where(norm > 0, norm, 1)[:, None]
        np.save(f"{folder}/templates.npy", templates.astype("float32"))
        np.save(f"{folder}/similar_templates.npy", (unit @ unit.T).astype("float32"))
        channels = templates.shape[2] if templates.ndim == 3 else 1
        np.save(f"{folder}/channel_map.npy", np.arange(channels, dtype="int32"))
        np.save(f"{folder}/channel_positions.npy", positions if positions is not None else np.stack([np.zeros(channels), np.arange(channels)], 1))
    units.selectExpr("unit_id AS cluster_id", "group").orderBy("cluster_id").toPandas().to_csv(f"{folder}/cluster_group.tsv", sep="\t", index=False)
    with open(f"{folder}/params.py", "w") as f:
        f.write(f"sample_rate = {float(fs)}\nhp_filtered = False\n")
    return folder
