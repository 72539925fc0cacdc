"""Zip containers, read within limits."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator, Mapping
from urllib.parse import unquote

MAX_TOTAL = 1 << 30
MAX_ENTRY = 512 << 20
MAX_RATIO = 200
RATIO_FROM = 32 << 20


class Refused(Exception):
    """Content that a parser does not take; the text says why."""


class Box(Mapping):
    """A checked archive: path -> bytes in archive order, an entry being unpacked when it is asked for."""

    def __init__(self, content: bytes):
        try:
            self.file = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise Refused(f"bad zip: {e}") from e
        self.infos = {i.filename: i for i in self.file.infolist() if not i.is_dir()}
        infos = self.infos.values()
        if sum(i.file_size for i in infos) > MAX_TOTAL or any(i.file_size > MAX_ENTRY for i in infos):
            raise Refused("the archive expands past its limits")
        if any(i.file_size > RATIO_FROM and i.file_size > MAX_RATIO * max(1, i.compress_size) for i in infos):
            raise Refused("an entry expands past its ratio")
        if any(i.flag_bits & 1 for i in infos):
            raise Refused("an entry is encrypted")

    def __getitem__(self, path: str) -> bytes:
        info = self.infos[path]
        try:
            with self.file.open(info) as entry:
                data = entry.read(info.file_size + 1)  # whatever the directory promises, no more is unpacked
        except (zipfile.BadZipFile, NotImplementedError, EOFError) as e:
            raise Refused(f"bad entry: {e}") from e
        if len(data) > info.file_size:
            raise Refused("an entry expands past its size")
        return data

    def __iter__(self) -> Iterator[str]:
        return iter(self.infos)

    def __len__(self) -> int:
        return len(self.infos)


def entries(content: bytes) -> dict[str, bytes]:
    """Path -> bytes of all entries, in archive order, after checking what the directory promises."""
    return dict(Box(content))


def resolve(base: str, href: str) -> str:
    """href against the folder of base, decoded and normalised."""
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0])))
    return path.lstrip("/") if path != "." else ""


def find(box: Mapping[str, bytes], path: str) -> str | None:
    """The entry of that name, else the first one equal but for case."""
    if path in box:
        return path
    low = path.lower()
    return next((p for p in box if p.lower() == low), None)
