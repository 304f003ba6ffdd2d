"""Small files in whatever store a path names, for tasks that Spark's readers and writers can't serve."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


class Store:
    """A folder by its path or URI."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(self.at(name)).type != fs.FileType.NotFound

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def read_json(self, name: str):
        with self.fs.open_input_stream(self.at(name)) as f:
            return json.loads(f.read())

    def publish_json(self, name: str, value) -> None:
        """Write under another name first, so that a reader sees all or nothing."""
        folder, _, last = self.at(name).rpartition("/")
        self.fs.create_dir(folder)
        waiting = f"{folder}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(waiting) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(waiting, f"{folder}/{last}")

    def delete(self, name: str) -> None:
        if self.exists(name):
            self.fs.delete_file(self.at(name))
