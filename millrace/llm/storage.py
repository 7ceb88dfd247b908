"""Files in the shared folder, opened from executors wherever that folder is."""

from __future__ import annotations

from pyarrow import NativeFile
from pyarrow.fs import FileSystem


def filesystem(uri: str) -> tuple[FileSystem, str]:
    """The file system and path of a URI as Hadoop writes it (file:/x, file:///x, hdfs://..., s3a://...)."""
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[len("file:") :].lstrip("/")
    return FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def create(uri: str) -> NativeFile:
    """A new file, with the folders above it."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)
