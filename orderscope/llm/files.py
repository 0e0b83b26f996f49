"""Files that Python tasks write and read beside Spark's own formats.

Paths are URIs of the shared folder and are opened through pyarrow's file
systems, so they need not be local.  A writer's file name holds its task attempt:
a retried or speculative attempt never touches another's file, and only files
named in the manifest that Spark has committed count.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str, mode: str):
    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def own_name(kind: str, number: int, suffix: str) -> str:
    """A file name that no other task attempt uses."""
    task = TaskContext.get()
    part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
    return f"{kind}-{part:06d}-{number:05d}-{attempt}-{uuid.uuid4().hex[:8]}{suffix}"
