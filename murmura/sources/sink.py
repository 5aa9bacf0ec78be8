"""A sink that writes one file for each row: staged by the tasks, put in place by tasks once all have finished.

Rows are name (a relative path) and content (bytes). A task writes below a folder of its attempt inside <path>/_staged-<job>, and
its rows say what it wrote; a task that fails or runs twice leaves nothing in place. Names that occur twice are refused before any
file is moved; then tasks move the files, and the staging folder is removed. A failed job only removes it. Only the driver makes the
staging folder, so a task that outlives its job can't bring it back. Names stay in tables that tasks write and read, so the driver knows
none of them, however many files there are. Paths are anything that pyarrow opens (local or shared
folders, HDFS, object stores), the same for driver and executors.
"""

from __future__ import annotations

import posixpath
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.storage import kept

#: Files that a task moves at once.
MOVERS = 8
#: Bytes of files that are in memory together when they are read, or one file.
HELD = 1 << 24


def opened(path: str):
    """The file system of path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path.removeprefix("file:")))


def relative(name: str | None) -> str:
    clean = posixpath.normpath(name or "")
    if not name or clean.startswith(("/", "..")) or clean == "." or clean.startswith("_staged-"):
        raise ValueError(f"not a name of a file: {name!r}")
    return clean


def staged(path: str, stage: str):
    """Writes files of batches (name, content) below a folder of the task's own, and says where: names and the folder."""

    def run(batches):
        system, root = opened(path)
        own, made = f"{root}/{stage}/{uuid.uuid4().hex}", set()

        def below(folder: str) -> None:
            if folder not in made:
                if folder != own:
                    below(posixpath.dirname(folder))
                system.create_dir(folder, recursive=False)
                made.add(folder)

        for batch in batches:
            names = [relative(name) for name in batch.column("name").to_pylist()]
            for name, content in zip(names, batch.column("content"), strict=True):
                below(posixpath.dirname(f"{own}/{name}"))
                with system.open_output_stream(f"{own}/{name}") as f:
                    if content.is_valid:
                        f.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([own] * len(names), pa.string())], names=["name", "folder"])

    return run


def moved(path: str):
    """Puts staged files (name, folder) in their place; what a task that failed has moved already stays there."""

    def run(batches):
        from pyarrow import fs

        system, root = opened(path)
        made = set()

        def move(row) -> None:
            name, folder = row
            if system.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                system.move(f"{folder}/{name}", f"{root}/{name}")

        with ThreadPoolExecutor(MOVERS) as pool:  # a move waits for the store most of its time
            for batch in batches:
                names = batch.column("name").to_pylist()
                for folder in {posixpath.dirname(n) for n in names} - made:
                    system.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
                    made.add(folder)
                list(pool.map(move, zip(names, batch.column("folder").to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([len(names)])], names=["n"])

    return run


def write(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes rows (name, content) as files under path, and returns their names, as rows."""
    from pyarrow import fs

    system, root = opened(path)
    stage = f"_staged-{uuid.uuid4().hex}"
    system.create_dir(f"{root}/{stage}", recursive=True)
    try:
        names = kept(rows.select("name", "content").mapInArrow(staged(path, stage), "name string, folder string"))
        twice = [r["name"] for r in names.groupBy("name").count().where("count > 1").orderBy("name").limit(20).collect()]
        if twice:
            raise ValueError(f"names that occur twice: {twice}")
        if overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name != stage:
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        names.mapInArrow(moved(path), "n long").agg(F.sum("n")).collect()
    finally:
        system.delete_dir(f"{root}/{stage}")
    return names.select("name")


def read(names: DataFrame, path: str) -> DataFrame:
    """name and content of the files under path that names (name) tells; tasks open them, so no folder is listed."""

    def run(batches):
        system, root = opened(path)

        def batch_of(some):
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.string()), pa.array([c for _, c in some], pa.binary())], names=["name", "content"])

        some, held = [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with system.open_input_file(f"{root}/{name}") as f:
                    some.append((name, f.read()))
                held += len(some[-1][1])
                if held > HELD or len(some) == 1000:
                    yield batch_of(some)
                    some, held = [], 0
        if some:
            yield batch_of(some)

    return names.select("name").mapInArrow(run, "name string, content binary")
