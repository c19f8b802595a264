"""Files in the folder that executors share."""

from __future__ import annotations

import uuid


def store_of(uri: str):
    """The file system of a folder or file that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class NamedFile:
    """A file that gets its name when it is complete, so that a task that is lost or run twice leaves no half file under it."""

    def __init__(self, uri: str):
        self.store, self.path = store_of(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.part, compression=None)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)
