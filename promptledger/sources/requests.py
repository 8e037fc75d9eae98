"""Readers that turn logs, files and plain texts into requests."""

from __future__ import annotations

import os
import posixpath
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from operator import or_
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.functions.bodies import chat_body
from promptledger.schemas import PROMPT_FILE, REQUEST
from promptledger.session import cut_lineage, has_shared_dir

DEFAULT_MODEL = "gpt-4o"
#: A task reads about so many local files, or bytes of them, and hands so many bytes on at once.
FILES_A_TASK, BYTES_A_TASK, BYTES_AT_ONCE = 5_000, 64 << 20, 4 << 20


def read_requests(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """A request log with the fixed schema."""
    return spark.read.schema(REQUEST).format(form).load(path)


def stream_requests(
    spark: SparkSession, path: str, form: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """The same log as a stream of files."""
    reader = spark.readStream.schema(REQUEST).format(form)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _plain_path(uri):
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:(//)?", "")


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()), named


def _missing(error: Py4JJavaError) -> bool:
    return "FileNotFoundException" in str(error.java_exception.getClass().getName())


def _default_is_local(spark: SparkSession) -> bool:
    return _file_system(spark, "/")[0].getUri().getScheme() == "file"


def _opened_here(path: str, default_is_local: bool) -> str | None:
    """The plain form of an absolute local path, which needs no call to the JVM (several
    per file take far longer than the file system does); None for any other path."""
    plain = re.sub("^file:(//)?(?=/[^/])", "", path)
    if plain[:1] != "/" or plain[:2] == "//" or plain != posixpath.normpath(plain):
        return None
    return plain if default_is_local or plain != path else None


def _listed_file(spark: SparkSession, path: str, default_is_local: bool) -> tuple[str, bool] | None:
    """(plain name, whether it is a file with content) of a listed path; None if it is missing."""
    plain = _opened_here(path, default_is_local)
    if plain is not None:
        try:
            return plain, os.path.isfile(plain) and os.stat(plain).st_size > 0
        except FileNotFoundError:
            return None
    fs, named = _file_system(spark, path)
    try:
        status = fs.getFileStatus(named)
    except Py4JJavaError as error:
        if not _missing(error):
            raise
        return None
    return re.sub("^file:(//)?", "", status.getPath().toString()), not status.isDirectory() and status.getLen() > 0


def _exact(path: str) -> str:
    """A path as a glob that means itself only."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _empty_below(folder: str, recursive: bool) -> Iterator[str]:
    """Files of no bytes in a local folder."""
    for at, folders, names in os.walk(folder, followlinks=True):
        folders[:] = [f for f in folders if recursive and f[0] not in "._"]
        for path in (os.path.join(at, name) for name in names if name[0] not in "._"):
            # A link to nothing is no file.
            if os.path.exists(path) and os.path.getsize(path) == 0:
                yield path


def _empty_files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> list[str]:
    """Names of the files of no bytes that a folder or glob holds, as Spark would read them."""
    fs, named = _file_system(spark, path)
    wanted = spark._jvm.org.apache.hadoop.fs.GlobFilter(pattern)
    found, open_folders = [], []
    for status in fs.globStatus(named) or ():
        (open_folders if status.isDirectory() else found).append(status)
    if fs.getUri().getScheme() == "file":
        empty = [s.getPath() for s in found if s.getLen() == 0]
        for folder in open_folders:
            below = _empty_below(re.sub("^file:(//)?", "", folder.getPath().toString()), recursive)
            empty += map(spark._jvm.org.apache.hadoop.fs.Path, (f"file:{name}" for name in below))
        return [e.toUri().toString() for e in empty if wanted.accept(e)]
    while open_folders:
        for status in fs.listStatus(open_folders.pop().getPath()):
            if status.getPath().getName()[0] in "._":
                continue
            if not status.isDirectory():
                found.append(status)
            elif recursive:
                open_folders.append(status)
    return [
        s.getPath().toUri().toString() for s in found if s.getLen() == 0 and wanted.accept(s.getPath())
    ]


def _local_files(spark: SparkSession, roots: Sequence[str], pattern: str) -> DataFrame:
    """(path, size) of the local files that Spark would read at and below ``roots``.

    Tasks list the folders, level by level, and the rows are stored, so neither files nor
    folders are on the driver. A path is bytes, as the file system has it.
    """
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern)
    wanted = re.compile(glob.compiled().pattern(), re.ASCII | re.DOTALL)

    def inside(at: bytes) -> Iterator[tuple[bytes, bool]]:
        if not os.path.isdir(at):
            os.stat(at)  # what the driver or another task has seen must be here too
            yield at, False
            return
        with os.scandir(at) as entries:
            for entry in entries:
                yield entry.path, entry.is_dir()

    def rows(at: bytes, kind: int) -> Iterator[tuple[bytes, int]]:
        for path, is_folder in inside(at):
            name = os.fsdecode(os.path.basename(path))
            hidden = name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")
            plain = kind == -1 and name[0] not in "._"
            if is_folder:
                if not hidden or name.startswith(("_metadata", "_common_metadata")):
                    yield path, -1 if plain else -2
            elif wanted.fullmatch(name) and os.path.exists(path):  # a link to nothing is no file
                size = os.path.getsize(path)
                # Files of no bytes are named by plain names, or by the caller.
                if not hidden if size else plain or path == at:
                    yield path, size

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, kind in zip(batch["path"], batch["size"]):
                found = rows(at, kind)
                while some := list(islice(found, 10_000)):
                    yield pd.DataFrame(some, columns=["path", "size"])

    levels, cores = [], spark.sparkContext.defaultParallelism
    # The size of a folder is -1, or -2 where a name above it is not plain.
    folders = spark.createDataFrame([(os.fsencode(root), -1) for root in roots], "path binary, size long")
    while not levels or not folders.isEmpty():
        found = cut_lineage(folders.mapInPandas(listed, "path binary, size long"))
        levels.append(found.where("size >= 0"))
        folders = found.where("size < 0").repartition(cores)
    files = reduce(DataFrame.union, levels)
    return files if len(roots) < 2 else files.dropDuplicates(["path"])


def _read_local_files(files: DataFrame, n_files: int, n_bytes: int) -> DataFrame:
    """(label, body) of local files, read by tasks; files of no bytes have a NULL body."""

    def content(path: bytes) -> bytes:
        data = Path(os.fsdecode(path)).read_bytes()
        folder, name = os.path.split(path)
        try:
            sums = Path(os.fsdecode(os.path.join(folder, b"." + name + b".crc"))).read_bytes()
        except FileNotFoundError:
            return data
        # Hadoop's checksums: a mark, the bytes that each is of, and the checksums.
        if sums[:4] == b"crc\0":
            step = int.from_bytes(sums[4:8])
            for i, at in enumerate(range(0, len(data), step)):
                if zlib.crc32(data[at : at + step]).to_bytes(4) != sums[8 + 4 * i : 12 + 4 * i]:
                    raise OSError(f"checksum error: {os.fsdecode(path)} at {at}")
        return data

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths, bodies, held = [], [], 0
            for path, size in zip(batch["path"], batch["size"]):
                paths.append(path)
                bodies.append(content(path) if size else None)
                held += len(bodies[-1] or b"")
                if held >= BYTES_AT_ONCE:
                    yield pd.DataFrame({"path": paths, "body": bodies}, dtype="object")
                    paths, bodies, held = [], [], 0
            yield pd.DataFrame({"path": paths, "body": bodies}, dtype="object")

    cores = files.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, n_files), -(-n_files // FILES_A_TASK), -(-n_bytes // BYTES_A_TASK))
    bodies = files.repartition(parts).mapInPandas(read, "path binary, body binary")
    return bodies.select(F.col("path").cast("string").alias("label"), F.col("body").cast("string").alias("body"))


def _packed(spark: SparkSession, name):
    """Whether a file of this name is compressed, as Spark sees it."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    endings = {hadoop.util.ReflectionUtils.newInstance(codec, conf).getDefaultExtension() for codec in codecs}
    return reduce(or_, (name.endswith(ending) for ending in sorted(endings)), F.lit(False))


def _found_by_tasks(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """(label, body) of the files below a local folder or glob, listed and read by tasks;
    None where only Spark's reader will do: other file systems, compressed files."""
    fs, named = _file_system(spark, path)
    if fs.getUri().getScheme() != "file" or not has_shared_dir(spark):
        return None
    roots = [re.sub("^file:(//)?", "", s.getPath().toString()) for s in fs.globStatus(named) or ()]
    if not roots:
        return spark.createDataFrame([], "label string, body string")
    files = _local_files(spark, roots, pattern)
    seen = files.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(_packed(spark, F.col("path").cast("string"))), F.lit(False)).alias("packed"),
    ).first()
    return None if seen["packed"] else _read_local_files(files, seen["n"], seen["bytes"])


def read_prompt_files(
    spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = True
) -> DataFrame:
    """One body per file under a folder or glob; nothing found gives no rows.

    All share position 0, so a report orders them by name. A file of no bytes has a
    NULL body, which is an input error. The files are those of the time of the call. Local
    ones are listed and read by tasks, so the driver holds nothing of each; other file
    systems, compressed files and a single level are left to Spark's reader, which lists
    on the driver.
    """
    local = _found_by_tasks(spark, path, pattern) if recursive else None
    if local is not None:
        return local.select("label", F.lit(0).cast("bigint").alias("position"), "body")
    try:
        files = (
            spark.read.option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", str(recursive).lower())
            .text(path, wholetext=True)
        )
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PROMPT_FILE)
    named = files.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("body"))
    # Spark leaves files of no bytes out of a scan.
    empty = _empty_files(spark, path, pattern, recursive)
    if empty:
        named = named.union(spark.createDataFrame([(uri, None) for uri in empty], "uri string, body string"))
    return named.select(_plain_path(F.col("uri")).alias("label"), F.lit(0).cast("bigint").alias("position"), "body")


def write_prompt_files(rows: DataFrame, folder: str, key: str, body: str = "body") -> DataFrame:
    """A file of its own for every key, in subfolders of ``folder``; (path) of the files.

    The file is named after the key and holds the body and a line feed; rows of one key that
    stand in one partition share a file. Local files are written by the tasks themselves:
    Spark's writer would make a folder, a checksum file and two processes for each. A
    task that is repeated writes the same files again.
    """
    spark = rows.sparkSession
    if _opened_here(folder, _default_is_local(spark)) is None:
        rows.select(key, body).write.partitionBy(key).text(folder)
        found = spark.read.option("pathGlobFilter", "*.txt").text(folder)
        return found.select(F.col("_metadata.file_path").alias("path")).distinct()
    root = _opened_here(folder, True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = Path(root) / str(TaskContext.get().partitionId())
        at.mkdir(parents=True, exist_ok=True)
        name, lines = None, []

        def close() -> list[str]:
            if name is None:
                return []
            path, part = at / f"{key}={name}.txt", at / f".{name}.{TaskContext.get().taskAttemptId()}"
            part.write_bytes("".join(f"{line}\n" for line in lines).encode("utf-8"))
            part.replace(path)
            return [str(path)]

        for batch in batches:
            done = []
            for next_name, line in zip(batch["name"], batch["body"]):
                if next_name != name:
                    done += close()
                    name, lines = next_name, []
                lines.append("" if line is None else line)
            yield pd.DataFrame({"path": done}, dtype="object")
        yield pd.DataFrame({"path": close()}, dtype="object")

    named = F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    sent = rows.select(named.alias("name"), F.col(body).alias("body")).sortWithinPartitions("name")
    return cut_lineage(sent.mapInPandas(write, "path string"))


def read_prompt_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Listed files, numbered in list order; an empty list gives no rows.

    The label is the path as the caller wrote it: relative, with a scheme, with
    blanks. A file that is missing, a folder or of no bytes keeps its row, with a
    NULL body, which is an input error.
    """
    rows, names, default_is_local = [], {}, _default_is_local(spark)
    for position, path in enumerate(paths):
        found = _listed_file(spark, path, default_is_local)
        name, has_content = found or (None, False)
        rows.append((path, position, name))
        if has_content:
            names[name] = _exact(name if default_is_local or name[0] != "/" else f"file:{name}")
    order = spark.createDataFrame(rows, "label string, position bigint, name string")
    if not names:
        return order.select("label", "position", F.lit(None).cast("string").alias("body"))
    files = spark.read.text(list(names.values()), wholetext=True).select(
        _plain_path(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("body")
    )
    return order.join(files, "name", "left").select("label", "position", "body")


def text_prompts(
    texts: DataFrame, text: str, seq: str, ts: str | None = None, model: str | None = None
) -> DataFrame:
    """Plain texts as chat requests: model column, or the default model."""
    named = F.col(model) if model else F.lit(DEFAULT_MODEL)
    when = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
    return texts.select(
        F.col(seq).cast("long").alias("arrival_seq"),
        when.alias("arrival_ts"),
        F.lit("/v1/chat/completions").alias("path"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        chat_body(named, F.col(text)).alias("body"),
    )


def text_decisions_input(texts: DataFrame, text: str, seq: str, model: str | None = None) -> DataFrame:
    """Plain texts as already normalised prompts, without a round trip through JSON."""
    return texts.select(
        F.col(seq).cast("long").alias("arrival_seq"),
        F.lit("openai").alias("provider"),
        F.lit("/v1/chat/completions").alias("path"),
        (F.col(model) if model else F.lit(DEFAULT_MODEL)).alias("model"),
        F.col(text).alias("content"),
        F.lit(None).cast("string").alias("error_code"),
    )
