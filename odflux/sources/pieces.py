"""A folder of file pieces: what the writers of Python data sources share.

A task writes its pieces under names of its own in a hidden folder; the commit moves the pieces of the tasks that counted
into place and removes the rest, so that repeated, lost or speculative attempts leave nothing behind.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Pieces(WriterCommitMessage):
    names: list[str]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


class PieceWriter(DataSourceArrowWriter):
    """Writer into ``path``; ``suffixes`` are the files of one piece."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def pending(self) -> str:
        return f"{opened(self.path)[1]}/_pending-{self.job}"

    def save(self, contents: dict[str, bytes]) -> str:
        """Write one piece, its bytes by suffix, and return its name."""
        system, name = opened(self.path)[0], f"part-{uuid.uuid4().hex}"
        system.create_dir(self.pending, recursive=True)
        for suffix, data in contents.items():
            with system.open_output_stream(f"{self.pending}/{name}{suffix}") as out:
                out.write(data)
        return name

    def commit(self, messages: list[Pieces | None]) -> None:
        system, root = opened(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.is_file:
                    system.delete_file(old.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                for suffix in self.suffixes:
                    system.move(f"{self.pending}/{name}{suffix}", f"{root}/{name}{suffix}")
        self.abort(messages)

    def abort(self, messages: list[Pieces | None]) -> None:
        system = opened(self.path)[0]
        if system.get_file_info(self.pending).type == fs.FileType.Directory:
            system.delete_dir(self.pending)
