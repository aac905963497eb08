"""Binary files in the shared folder, written and read by tasks.

Any store that pyarrow can open will do. A file is written under a name of its attempt and then
moved, so that a task that runs again leaves one whole file.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path behind a URI as Spark writes it."""
    path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, path: str):
        self.system, self.path = opened(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex[:12]}.tmp"
        self.stream, self.size = self.system.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += memoryview(data).nbytes

    def done(self) -> None:
        self.stream.close()
        self.system.move(self.own, self.path)


def reader(path: str):
    system, plain = opened(path)
    return system.open_input_file(plain)
