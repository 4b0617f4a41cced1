"""Binary files written by the executors in two phases: a data source of rows (path, content).

Each task writes its files under a hidden folder of its own; the commit on the driver moves those of
the tasks that counted to their places and deletes the folder, so that a failed or repeated task leaves nothing.
Files are reached through pyarrow (local and shared folders, and the stores it knows).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        path = rest
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.held = root.rstrip("/"), f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, top = opened(self.root)
        own, files = f"{top}/{self.held}/{uuid.uuid4().hex}", []
        fs.create_dir(own, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = f"{own}/{len(files)}"
                with fs.open_output_stream(held) as out:
                    out.write(content.as_buffer())
                files.append((held, name))
        return Written(files)

    def commit(self, messages) -> None:
        fs, top = opened(self.root)
        found = sorted((name, held) for m in messages if m is not None for held, name in m.files)
        twice = {a for (a, _), (b, _) in zip(found, found[1:], strict=False) if a == b}
        try:
            if twice:
                raise ValueError(f"written twice: {min(twice)}")
            for name, held in found:
                target = f"{top}/{name}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                fs.move(held, target)
        finally:
            self._drop(fs, top)

    def abort(self, messages) -> None:
        self._drop(*opened(self.root))

    def _drop(self, fs: pafs.FileSystem, top: str) -> None:
        if fs.get_file_info(f"{top}/{self.held}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{top}/{self.held}")


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, root: str) -> None:
    """Rows (path below root, content) as files."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("path", "content").write.format("tessera_files").mode("append").save(root)
