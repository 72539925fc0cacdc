"""EPUB metadata writer: the package document is rewritten, every other entry is kept as it is."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.sources.archive import Refused, find
from quire.sources.books import _local, xml_root
from quire.shipping import arrow_udf

DC = "http://purl.org/dc/elements/1.1/"
OPF = "http://www.idpf.org/2007/opf"


def updated_epub(content: bytes, title: str | None = None, authors: list[str] | None = None) -> bytes:
    ET.register_namespace("", OPF)
    ET.register_namespace("dc", DC)
    box = zipfile.ZipFile(io.BytesIO(content))
    data = {i.filename: box.read(i) for i in box.infolist()}
    container = find(data, "META-INF/container.xml")
    path = next((e.attrib.get("full-path", "") for e in xml_root(data[container]).iter() if _local(e.tag) == "rootfile"), "") if container else ""
    if path not in data:
        raise Refused("no package document")
    root = xml_root(data[path])
    meta = next(e for e in root.iter() if _local(e.tag) == "metadata")
    for name, values in (("title", [title] if title is not None else None), ("creator", authors)):
        if values is None:
            continue
        for e in [e for e in meta if _local(e.tag) == name]:
            meta.remove(e)
        for v in values:
            ET.SubElement(meta, f"{{{DC}}}{name}").text = v
    data[path] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in box.infolist():
            z.writestr(i, data[i.filename])
    return out.getvalue()


def with_title(content: Column, title: Column) -> Column:
    """The same book under another title; null where the content is no EPUB."""
    def run(contents: pa.Array, titles: pa.Array) -> pa.Array:
        out = []
        for c, t in zip(contents.to_pylist(), titles.to_pylist()):
            try:
                out.append(updated_epub(c, t))
            except (Refused, zipfile.BadZipFile, StopIteration, TypeError):
                out.append(None)
        return pa.array(out, pa.binary())

    return arrow_udf(run, "binary")(content, title)
