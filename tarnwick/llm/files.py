"""Binary files in the shared folder, written by tasks and read back by Spark.

A task writes under a temporary name and renames, so a retried or a speculative
attempt replaces a file by the same bytes and a half-written file is never seen.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(uri: str, data: bytes | memoryview) -> None:
    filesystem, path = fs.FileSystem.from_uri(uri)
    folder = path.rsplit("/", 1)[0]
    filesystem.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(part) as out:
        out.write(data)
    filesystem.move(part, path)


def get(uri: str) -> bytes:
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_stream(path) as stream:
        return stream.readall()
