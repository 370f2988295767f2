"""Files in the shared scratch folder, written and read by executors through pyarrow."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class AtomicFile:
    """Appears under its name when closed without an error; a repeated task replaces it with the same content."""

    def __init__(self, uri: str):
        self.system, self.path = locate(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.system.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def tell(self) -> int:
        return self.stream.tell()

    def __enter__(self) -> AtomicFile:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        self.stream.close()
        if kind is None:
            self.system.move(self.temporary, self.path)
        else:
            self.system.delete_file(self.temporary)
