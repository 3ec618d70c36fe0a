"""Listing directories, reading and writing files, inside tasks.

Local paths go through the operating system and links are not followed; any
other URI goes through the matching Arrow file system.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1 << 20

# Characters that ``partitionBy`` does not leave as they are in names of folders.
UNSAFE = [chr(c) for c in range(1, 32)] + list("\"#%'*/:=?\\\x7f{[]^")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def entries(directory: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is_dir, size, mtime in microseconds); errors are not swallowed."""
    local = local_path(directory)
    if local is not None:
        import os

        with os.scandir(local) as found:
            for e in found:
                stat = e.stat(follow_symlinks=False)
                yield e.name, e.is_dir(follow_symlinks=False), stat.st_size, stat.st_mtime_ns // 1000
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(directory)
    for info in system.get_file_info(fs.FileSelector(path, recursive=False)):
        is_dir = info.type == fs.FileType.Directory
        yield info.base_name, is_dir, info.size or 0, (info.mtime_ns or 0) // 1000


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return None if "://" in uri else uri


def open_stream(path: str):
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def folder_name(value: Column) -> Column:
    """A text as the name of a folder, escaped as ``partitionBy`` does."""
    codes = F.create_map(*[F.lit(x) for c in UNSAFE for x in (c, f"%{ord(c):02X}")])
    chars = F.transform(F.split(value, ""), lambda c: F.coalesce(F.element_at(codes, c), c))
    unsafe = "[\\x01-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]"
    escaped = F.when(value.rlike(unsafe), F.array_join(chars, "")).otherwise(value)
    return F.when(value != "", escaped).otherwise(NO_VALUE)


def write_lines(batches: Iterator) -> Iterator:
    """Write rows of ``folder`` and ``text`` as lines, null ones empty; for ``mapInArrow``.

    Rows of a folder must follow each other. A task writes one file a folder, named after the
    task, so that a second attempt replaces what the first left behind.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    name = f"part-{context.partitionId():05d}.txt"
    stream = part = at = None
    n_files = 0

    def close() -> None:
        if stream is not None:
            stream.close()
            move(part, f"{at}/{name}")

    for batch in batches:
        for folder, text in zip(*(c.to_pylist() for c in batch.columns)):
            if folder != at:
                close()
                at, n_files = folder, n_files + 1
                part = f"{at}/.{name}.{context.taskAttemptId()}"
                stream = create_stream(part)
            stream.write((text or "").encode("utf-8", "surrogatepass") + b"\n")
    close()
    yield pa.RecordBatch.from_arrays([pa.array([n_files], pa.int64())], names=["n_files"])


def create_stream(path: str):
    """A new file, with the folders above it."""
    local = local_path(path)
    if local is not None:
        import os

        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def move(path: str, to: str) -> None:
    """Rename a file, over one that may be there."""
    local = local_path(path)
    if local is not None:
        import os

        os.replace(local, local_path(to))
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.move(inner, fs.FileSystem.from_uri(to)[1])


def hashes_of(path: str, prefix: int | None, whole: bool) -> tuple[str | None, str | None]:
    """SHA-256 of the first ``prefix`` bytes and of the whole file, in one pass of fixed-size chunks.

    Either is None if not asked for; without ``whole`` nothing after the prefix is read.
    """
    import hashlib

    digest, first, left = hashlib.sha256(), None, prefix
    with open_stream(path) as stream:
        while left is None or left > 0:
            chunk = stream.read(CHUNK if left is None else min(CHUNK, left))
            if not chunk:
                break
            digest.update(chunk)
            if left is not None:
                left -= len(chunk)
                if left == 0:
                    first = digest.hexdigest()
                    left = None if whole else 0
    if prefix is not None and first is None:  # the file ends before
        first = digest.hexdigest()
    return first, digest.hexdigest() if whole else None


def put_if_absent(spark, path: str) -> bool:
    """Create an empty file; False if it is there already. Of several callers one succeeds.

    Called on the driver. Local paths rely on the operating system, others on the Hadoop
    file system, whose ``create`` without overwriting is atomic on HDFS and on object stores
    with conditional writes.
    """
    local = local_path(path)
    if local is not None:
        import os

        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    from py4j.protocol import Py4JJavaError

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        system.create(target, False).close()
    except Py4JJavaError as err:
        if "AlreadyExists" not in err.java_exception.getClass().getName():
            raise
        return False
    return True


def subfolders(spark, path: str) -> list[str]:
    """Names of the folders directly in a folder, none if it is missing. Called on the driver."""
    local = local_path(path)
    if local is not None:
        import os

        return [e.name for e in os.scandir(local) if e.is_dir()] if os.path.isdir(local) else []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    return [e.getPath().getName() for e in system.listStatus(target) if e.isDirectory()]
