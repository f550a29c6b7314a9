"""Files in the shared folder, written and read by tasks.

A file is written under a name of the task attempt's own and only its committed row names it, so that a lost or repeated
attempt leaves nothing that is read.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyarrow import fs


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the folder's path in it."""
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def new_name(folder: str, part: int, suffix: str) -> str:
    return f"{folder}/{part:06d}-{uuid.uuid4().hex[:12]}{suffix}"


class Reader:
    """Range reads; a few files stay open."""

    def __init__(self, folder: str, open_files: int = 16) -> None:
        self.fs, self.most = filesystem(folder)[0], open_files
        self.open: OrderedDict[str, object] = OrderedDict()

    def _file(self, path: str):
        if path in self.open:
            self.open.move_to_end(path)
        else:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[path] = self.fs.open_input_file(path)
        return self.open[path]

    def read(self, path: str, offset: int, size: int) -> bytes:
        return self._file(path).read_at(size, offset)

    def size(self, path: str) -> int:
        return self._file(path).size()
