"""Storage boundaries: JSON lines, exported history, plan documents, raw files."""

from __future__ import annotations

import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from changeloom import schemas
from changeloom.functions.text import is_blank
from changeloom.session import ship_package

CORRUPT = "_corrupt_record"
# Names of files leave a task in batches of so many, contents in batches of about so many bytes.
LISTED, READ_BYTES = 4096, 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables: in the shared checkpoint folder, or local in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return f"{tempfile.mkdtemp(prefix='changeloom-')}/{name}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines).  Blank lines are neither; a field of another type becomes NULL."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(~is_blank("value"))
    record = F.from_json("value", f"{schema}, {CORRUPT} string", options)
    parsed = lines.select("value", F.inline(F.array(record)))
    broken = F.col(CORRUPT).isNotNull() & F.try_parse_json("value").isNull()
    return parsed.where(~broken).drop("value", CORRUPT), parsed.where(broken).select(F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_history(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Exported history: commits, commit_files, range_diffs, tree_files as Parquet under one folder."""
    schemas_by_table = {
        "commits": "repo string, sha string, parents array<string>, subject string, branch_head string, topo_pos bigint",
        "commit_files": "repo string, sha string, path string, pos int",
        "range_diffs": "repo string, base_commit string, head_commit string, diff string, has_binary boolean",
        "tree_files": "repo string, sha string, path string, content string",
    }
    return {name: spark.read.schema(ddl).parquet(f"{root}/{name}") for name, ddl in schemas_by_table.items()}


def history_commits(commits: DataFrame) -> DataFrame:
    """Commits with first parent and merge flag, as the history operators expect them."""
    return commits.select("repo", "sha", F.get("parents", F.lit(0)).alias("parent1"),
                          (F.size("parents") > 1).alias("is_merge"), "subject", "topo_pos")


# Names of files that Spark's readers unpack.
PACKED = "\\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"


def _shown(entry: os.DirEntry) -> bool:
    """Whether Spark's readers see a file or folder."""
    name = entry.name
    if name.startswith(("_metadata", "_common_metadata")) and entry.is_dir():
        return True
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _entries(folder: str) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as found:
        yield from filter(_shown, found)


def _quoted(path: str) -> str:
    """A path as it stands in a URI of Java: characters that are not allowed there, and space and controls of all scripts."""
    def code(match):
        char = match[0]
        if ord(char) < 128 or unicodedata.category(char) in ("Cc", "Zs", "Zl", "Zp"):
            return "".join(f"%{byte:02X}" for byte in char.encode())
        return char

    return re.sub("[^A-Za-z0-9_!.~'()*,;:$&+=/@-]", code, path)


def _in_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the given folders, without those of folders below them."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            yield from _in_batches((entry.path, entry.is_dir()) for entry in _entries(folder))


def _in_batches(rows: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    for part in iter(lambda: list(islice(rows, LISTED)), []):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part), (pa.string(), pa.bool_()))], names=["path", "is_dir"])


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files as they are, and all files of the folders."""
    def walk(folder):
        for entry in _entries(folder):
            if entry.is_dir():
                yield from walk(entry.path)
            else:
                yield entry.path, False

    for batch in batches:
        yield from _in_batches((x for path, is_dir in zip(*(c.to_pylist() for c in batch.columns)) for x in (
            walk(path) if is_dir else [(path, False)])))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each file that isn't empty, in batches of about ``READ_BYTES``."""
    def out(paths, texts):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["file", "content"])

    for batch in batches:
        paths, texts, held = [], [], 0
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as file:
                text = file.read()
            if not text:
                continue
            paths.append(f"file:{_quoted(path)}")
            texts.append(text)
            held += len(text)
            if held >= READ_BYTES:
                yield out(paths, texts)
                paths, texts, held = [], [], 0
        if paths:
            yield out(paths, texts)


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, document) of every file in a folder, as Spark's text reader gives them.

    Spark's own reader lists files on the driver, which keeps an entry for each.  In a mounted file system tasks list folders and
    read their files.  Other stores, and folders with packed files, are left to Spark's reader.
    """
    folder = _local_folder(spark, path)
    if folder is not None and os.path.isdir(folder):
        ship_package(spark)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        root = spark.range(1, numPartitions=1).select(F.lit(folder.rstrip("/") or "/").alias("path"))
        top = root.mapInArrow(_in_root, "path string, is_dir boolean")
        files = top.repartition(n, "path").mapInArrow(_below, "path string, is_dir boolean").select("path")
        if files.where(F.col("path").rlike(PACKED)).isEmpty():
            read = files.repartition(n, "path").mapInArrow(_contents, "file string, content binary")
            return read.select("file", F.col("content").cast("string").alias("document"))
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(plans, broken): plan documents, one per file, indented or not, with the file's name as ``file``; files that are no
    JSON document are set apart as (file, document)."""
    files = _whole_texts(spark, path)
    record = F.from_json("document", f"{schemas.PLAN}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = files.select("file", "document", F.inline(F.array(record)))
    broken = F.col(CORRUPT).isNotNull()
    return parsed.where(~broken).drop("document", CORRUPT), parsed.where(broken).select("file", "document")


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as tasks open it, if it lies in a mounted file system; None for any other store."""
    scheme, _, rest = path.partition(":")
    if "/" not in scheme and rest:
        return re.sub("^/*", "/", rest) if scheme == "file" else None
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path if default.startswith("file:") and path.startswith("/") else None


def _written_by(folder: str):
    """Writes (file, value) rows sorted by file, one file for each run of a name; files appear when the task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{folder}/.attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        here, out, n = None, None, 0
        try:
            for batch in batches:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name != here:
                        if out:
                            out.close()
                        else:
                            os.makedirs(attempt)
                        here, out, n = name, open(f"{attempt}/file={name}.txt", "wb"), n + 1
                    out.write(value or b"")
                    out.write(b"\n")
        finally:
            if out:
                out.close()
        if out:
            try:
                os.rename(attempt, f"{folder}/task-{context.partitionId()}")
            except OSError:
                # Another attempt of this task was first.
                if not os.path.isdir(f"{folder}/task-{context.partitionId()}"):
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return run


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """One raw text file per row, under the row's name; the text is ended by a line break.

    Spark's own writer makes a folder for each name, and reaches local folders by several processes per file.  In a mounted
    file system tasks write the files themselves, each task into one folder, which appears when it is complete.  Other stores
    are left to Spark's writer.  ``stored_name`` reads the names of both.
    """
    rows = rows.select(F.col(name).cast("string").alias("file"), F.col(content).cast("string").alias("value"))
    folder = _local_folder(rows.sparkSession, path)
    if folder is None:
        rows.write.partitionBy("file").text(path)
        return
    if os.path.isdir(folder) and os.listdir(folder):
        raise FileExistsError(folder)
    os.makedirs(folder, exist_ok=True)
    # Names are escaped as Spark escapes values of partition columns.
    escaped = F.nullif(F.col("file"), F.lit(""))
    for char in "%" + "".join(map(chr, range(1, 32))) + "\x7f\"#'*/:=?\\{[]^":
        escaped = F.replace(escaped, F.lit(char), F.lit(f"%{ord(char):02X}"))
    named = rows.select(F.coalesce(escaped, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("file"), F.encode("value", "UTF-8").alias("value"))
    named.sortWithinPartitions("file").mapInArrow(_written_by(folder), "files bigint").agg(F.sum("files")).collect()


def stored_name(path):
    """Name under which ``write_files`` has stored a file, from its path."""
    return F.url_decode(F.regexp_extract(path, "/file=([^/]*?)(?:\\.txt|/[^/]*)$", 1))


def plan_document(commits: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """Plan records of (commits, gitignore) with the patches of all tracked hunks."""
    patches = hunks.where("NOT is_untracked").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("hunk_id", "patch"))).alias("hunk_patches"))
    return commits.join(patches, keys, "left")


def restore_hunks(plans: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Live hunks and those that only a saved plan still knows; their file is the id up to its last '::'."""
    saved = plans.select(*keys, F.explode("hunk_patches").alias("hunk_id", "patch"))
    lost = saved.join(live.select(*keys, "hunk_id"), [*keys, "hunk_id"], "left_anti")
    path = F.when(F.contains("hunk_id", F.lit("::")), F.regexp_extract("hunk_id", "(?s)^(.*)::", 1)).otherwise(
        F.col("hunk_id"))
    restored = lost.select(*keys, "hunk_id", path.alias("file_path"), "patch", F.lit(False).alias("is_untracked"),
                           F.lit(False).alias("is_binary"))
    return live.select(*restored.columns).unionByName(restored)


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, length, content) of raw files.

    The content of a file longer than ``max_bytes`` isn't read: the length is known from the listing, and is pushed down to
    the reader.  Such files have a NULL content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is None:
        return files.select("path", "length", "content")
    small = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def write_counted(rows: DataFrame, path: str, **counters) -> DataFrame:
    """Write ``rows`` as Parquet and return one row of counters (aggregates), measured in the pass that writes."""
    seen = Observation()
    rows.observe(seen, *[value.alias(name) for name, value in counters.items()]).write.mode("overwrite").parquet(path)
    values = seen.get
    return rows.sparkSession.createDataFrame([tuple(values[name] for name in counters)], ", ".join(f"{n} bigint" for n in counters))


def append_messages(messages: DataFrame, path: str, conv: str = "conv_id", buckets: int = 64) -> None:
    """Append log rows to a message store, filed by conversation bucket."""
    messages.withColumn("bucket", F.pmod(F.xxhash64(conv), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.STORED_MESSAGE}, msg_ix bigint, bucket int").parquet(path).drop("bucket")
