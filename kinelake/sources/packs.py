"""Sources outside the tables: packed arrays of runs with their notes, runs of third parties, registries and repertoires in YAML or JSON."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from kinelake.operators.curation import rescale
from kinelake.runtime import ship

NOTES = "struct<qc: struct<fps: double, n_frames: long, kept_frames: long, segments: array<array<long>>>, meta: struct<video_id: string, source_clip: string>>"
JOINT = "array<struct<x: double, y: double, conf: double>>"


#: Frames of one Arrow batch, and bytes of runs that one read task takes (a longer run is a task of its own).
BATCH_FRAMES, SPLIT_BYTES = 256, 64 << 20
PACK_SCHEMA = f"conductor string, run string, t int, joints {JOINT}"


@dataclass
class RunSplit(InputPartition):
    """Runs of one pack that a task reads: the pack's address, its conductor and the names of the runs."""

    path: str
    conductor: str
    runs: list[str]


@dataclass
class Written(WriterCommitMessage):
    """Packs of a task under their temporary names, and the names they get."""

    moves: list[tuple[str, str]]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The store of an address and the path in it; a bare path is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _frames(member, frames: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first, block) of an array (frames, joints, 3) in NumPy's file format, read a block of frames at a time."""
    version = np.lib.format.read_magic(member)
    shape, by_column, dtype = np.lib.format.read_array_header_1_0(member) if version == (1, 0) else np.lib.format.read_array_header_2_0(member)
    if dtype.hasobject or len(shape) != 3 or shape[2] != 3:
        raise ValueError(f"an array (frames, joints, 3) of numbers is expected, not {shape} of {dtype}")
    if by_column:
        whole = np.frombuffer(member.read(), dtype).reshape(shape, order="F")
        yield from ((a, whole[a : a + frames]) for a in range(0, shape[0], frames))
        return
    size = shape[1] * 3 * dtype.itemsize
    for a in range(0, shape[0], frames):
        many = min(frames, shape[0] - a)
        yield a, np.frombuffer(member.read(many * size), dtype).reshape(many, shape[1], 3)


def _batch(conductor: str, run: str, first: int, block: np.ndarray) -> pa.RecordBatch:
    n, joints = block.shape[:2]
    flat = block.reshape(-1, 3).astype(np.float64)
    point = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["x", "y", "conf"])
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * joints)
    return pa.RecordBatch.from_arrays(
        [pa.array([conductor] * n), pa.array([run] * n), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.ListArray.from_arrays(offsets, point)], names=["conductor", "run", "t", "joints"]
    )


class PackReader(DataSourceReader):
    """Reads packs run by run; filters on conductor and run leave whole packs and runs unread."""

    def __init__(self, path: str, split_bytes: int, frames: int):
        self.path, self.split_bytes, self.frames, self.keep = path, split_bytes, frames, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("conductor",), ("run",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keep[f.attribute[0]] = self.keep.get(f.attribute[0], wanted) & wanted
            else:
                yield f

    def _kept(self, column: str, value: str) -> bool:
        return column not in self.keep or value in self.keep[column]

    def partitions(self):
        store, root = _at(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        splits = []
        for f in sorted((f for f in found if f.is_file and f.path.endswith(".npz") and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            conductor = f.base_name.removesuffix(".npz").rsplit("_", 1)[0]
            if not self._kept("conductor", conductor):
                continue
            with store.open_input_file(f.path) as file, zipfile.ZipFile(file) as pack:
                runs, size = [], 0
                for m in pack.infolist():
                    name = m.filename.removesuffix(".npy")
                    if not self._kept("run", name):
                        continue
                    if runs and size + m.file_size > self.split_bytes:
                        splits.append(RunSplit(f.path, conductor, runs))
                        runs, size = [], 0
                    runs, size = [*runs, name], size + m.file_size
                if runs:
                    splits.append(RunSplit(f.path, conductor, runs))
        return splits or [RunSplit("", "", [])]

    def read(self, partition):
        if not partition.runs:
            return
        store, _ = _at(self.path)
        with store.open_input_file(partition.path) as file, zipfile.ZipFile(file) as pack:
            for run in partition.runs:
                with pack.open(f"{run}.npy") as member:
                    for first, block in _frames(member, self.frames):
                        yield _batch(partition.conductor, run, first, block)


class PackWriter(DataSourceWriter):
    """Writes rows that come run by run, frames in order; packs get their names when all tasks have ended."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.token = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator):
        store, root = _at(self.path)
        store.create_dir(root, recursive=True)
        task, moves, opened = TaskContext.get(), [], None
        runs = groupby(iterator, key=lambda r: (r["conductor"], r["run"]))
        for conductor, of_conductor in groupby(runs, key=lambda g: g[0][0]):
            name = f"{conductor}_{self.token}{task.partitionId()}.npz"
            opened = f"{root}/_{name}.{task.taskAttemptId()}"
            seen = set()
            with store.open_output_stream(opened) as file, zipfile.ZipFile(file, "w") as pack:
                for (_, run), rows in of_conductor:
                    frames = [(r["t"], [(j["x"], j["y"], j["conf"]) for j in r["joints"]]) for r in rows]
                    if run in seen or [t for t, _ in frames] != list(range(len(frames))):
                        raise ValueError(f"run {run} of {conductor}: its frames must come together, numbered from 0 in order (write_packs sees to that)")
                    seen.add(run)
                    with pack.open(f"{run}.npy", "w", force_zip64=True) as member:
                        np.lib.format.write_array(member, np.array([x for _, x in frames], dtype=np.float64))
            moves.append((opened, f"{root}/{name}"))
        return Written(moves)

    def commit(self, messages):
        store, root = _at(self.path)
        before = [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.path.endswith(".npz") and not f.base_name.startswith(("_", "."))]
        for m in messages:
            for old, new in m.moves if m else []:
                store.move(old, new)
        # what is replaced goes last, so that a commit that dies loses nothing
        for path in before if self.overwrite else []:
            store.delete_file(path)

    def abort(self, messages):
        store, _ = _at(self.path)
        for m in messages:
            for old, _ in m.moves if m else []:
                store.delete_file(old)


class PackSource(DataSource):
    """Format ``packs``: <conductor>_<number>.npz below a path, in each an array (frames, joints, 3) for every run.

    A task reads up to ``splitBytes`` of runs, ``batchFrames`` frames at a time, so neither a pack nor a long run must fit in
    memory; the driver reads names and sizes only. A run without frames has no rows.
    """

    @classmethod
    def name(cls):
        return "packs"

    def schema(self):
        return PACK_SCHEMA

    def reader(self, schema):
        return PackReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)), int(self.options.get("batchframes", BATCH_FRAMES)))

    def writer(self, schema, overwrite):
        return PackWriter(self.options["path"], overwrite)


def register_packs(spark: SparkSession) -> None:
    """Make the format known to a session, and filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackSource)


def read_packs(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(conductor, run, t, joints) of all packs below path; options as of ``PackSource``."""
    register_packs(spark)
    return spark.read.format("packs").options(**{k: str(x) for k, x in options.items()}).load(path)


def write_packs(frames: DataFrame, path: str, partitions: int, mode: str = "append") -> None:
    """frames(conductor, run, t, joints) as packs: a task holds one run at a time and writes a pack for each of its conductors. Frames of a run are numbered from 0 without gaps."""
    register_packs(frames.sparkSession)
    rows = frames.select(F.col("conductor").cast("string"), F.col("run").cast("string"), F.col("t").cast("int"), "joints")
    rows.repartition(partitions, "conductor", "run").sortWithinPartitions("conductor", "run", "t").write.format("packs").mode(mode).save(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(conductor, run, qc, meta) of all meta_<conductor>.json below path, each an object with a member for every run."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "meta_*.json").load(path)
    named = whole.select(F.regexp_extract("path", r"meta_([^/]*)\.json$", 1).alias("conductor"), F.from_json(F.decode("content", "utf-8"), f"map<string, {NOTES}>").alias("runs"))
    return named.select("conductor", F.explode("runs").alias("run", "n")).select("conductor", "run", "n.qc", "n.meta")


def unpacked(frames: DataFrame, notes: DataFrame) -> DataFrame:
    """frames(conductor, run, t, joints) with qc and meta; a run without notes is an error."""
    both = frames.join(notes.withColumn("_known", F.lit(True)), ["conductor", "run"], "left")
    known = F.when(F.col("_known"), F.col("run")).otherwise(F.raise_error(F.concat(F.lit("no notes of run "), F.col("run").cast("string"))).cast("string"))
    return both.withColumn("run", known).drop("_known")


def third_party(notes: DataFrame, conductor: str, min_frames: int, target: float = 25.0) -> DataFrame:
    """(conductor, video_id, run, fps, seg_idx, a, b): segments of a conductor's runs at the target rate that are long enough, without any verdict; runs without qc drop out."""
    mine = notes.where((F.col("conductor") == conductor) & F.col("qc").isNotNull())
    rows = mine.select("conductor", F.col("meta.video_id").alias("video_id"), "run", F.col("qc.fps").alias("fps"), F.posexplode("qc.segments").alias("seg_idx", "s"))
    at = rows.select("conductor", "video_id", "run", "fps", "seg_idx", rescale(F.get("s", F.lit(0)), F.col("fps"), target).alias("a"), rescale(F.get("s", F.lit(1)), F.col("fps"), target).alias("b"))
    return at.where(F.col("b") - F.col("a") >= min_frames)


def _parsed(text: str):
    """YAML where a parser is installed; JSON, which is YAML too, otherwise."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


REGISTRY = "name string, aliases array<string>, queries array<string>, exclude_terms array<string>, min_duration_s long, max_duration_s long, reference_faces string"


def read_registry(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """(name, aliases, queries, exclude_terms, min_duration_s, max_duration_s, reference_faces): a row per conductor of one registry file; a name that isn't in it is an error."""
    entries = _parsed(_text(spark, path))
    if not isinstance(entries, list):
        raise ValueError(f"{path}: a list of conductors is expected")
    rows = []
    for e in entries:
        name = e["name"]
        rows.append((name, e.get("aliases") or [name], e.get("queries") or [], e.get("exclude_terms") or [], e.get("min_duration_s", 120), e.get("max_duration_s", 4800), e.get("reference_faces") or f"data/reference_faces/{name}"))
    kept = [r for r in rows if only in (None, r[0])]
    if only is not None and not kept:
        raise ValueError(f"{path}: no conductor {only!r}")
    return spark.createDataFrame(kept, REGISTRY)


def read_repertoire(spark: SparkSession, path: str) -> DataFrame:
    """(conductor, video_id, piece, type) of one repertoire file."""
    nested = _parsed(_text(spark, path)) or {}
    rows = [(c, v, m["piece"], m["type"]) for c, videos in nested.items() for v, m in (videos or {}).items()]
    return spark.createDataFrame(rows, "conductor string, video_id string, piece string, type string")


def load_labels(decisions: DataFrame) -> DataFrame:
    """(video_id, stem, y, has_crops) of decisions(video_id, clip_num, verdict, crops) that are judged: y is 1 for a reject."""
    verdict = F.lower(F.trim("verdict"))
    stem = F.format_string("%s(%s)", F.trim("video_id"), F.lpad(F.trim(F.col("clip_num").cast("string")), 2, "0"))
    judged = decisions.where(verdict.isin("accept", "reject"))
    return judged.select(F.trim("video_id").alias("video_id"), stem.alias("stem"), (verdict == "reject").cast("int").alias("y"), (F.trim(F.coalesce("crops", F.lit(""))) != "").alias("has_crops"))


def save_faces(faces: DataFrame, path: str) -> str:
    """faces(conductor, emb array<double>, ...) as Parquet, a folder per conductor."""
    faces.write.mode("overwrite").partitionBy("conductor").parquet(path)
    return path


def load_faces(spark: SparkSession, path: str, conductor: str | None = None) -> DataFrame:
    """Saved faces; of one conductor only its folder is read."""
    faces = spark.read.parquet(path)
    return faces if conductor is None else faces.where(F.col("conductor") == conductor)
