"""Ontology files as a data source: ``spark.read.format("obo").load(path)``.

A file is cut into byte ranges; a range holds the stanzas that begin in it, so
that each is read once whatever the cut.  Filters on the id's prefix and on
obsolete terms are applied while stanzas are read.  Paths may name any store
that the installed file systems of Arrow reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

SCHEMA = "id string, label string, synonyms array<string>, definition string, alt_ids array<string>, parents array<string>, is_obsolete boolean"
RANGE = 8 << 20
HEAD = b"[Term]"


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))


def _uri(path: str) -> str:
    bare = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return bare if "://" in bare else f"file://{bare}"


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    path = _uri(path)
    store, inside = _open(path)
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(inside)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted((f"{prefix}{f.path}", f.size) for f in found)


def _stanzas(part: Range, block: int = 1 << 20) -> Iterator[str]:
    """The [Term] blocks whose head begins in the range, each up to the next empty line or head of any kind."""
    store, inside = _open(part.path)
    with store.open_input_file(inside) as file:
        at = max(part.begin - 1, 0)  # a head at the very begin is told by the line end before it
        file.seek(at)
        rest, here = b"", at
        current: list[bytes] | None = None
        while True:
            data = file.read(block)
            lines = (rest + data).split(b"\n")
            rest = lines.pop() if data else b""
            for line in lines:
                begin, here = here, here + len(line) + 1
                whole = begin > at or at == 0  # the first line may be the end of one
                text = line.strip()
                if whole and text.startswith(b"["):
                    if current:
                        yield b"\n".join(current).decode()
                    current = None
                    if begin >= part.end:
                        return
                    if text == HEAD and begin >= part.begin:
                        current = []
                elif current is not None:
                    current.append(text)
                elif begin >= part.end:
                    return
            if not data:
                break
        if current:
            yield b"\n".join(current).decode()


def _unquoted(rest: str) -> str | None:
    found = re.match(r'"((?:[^"\\]|\\.)*)"', rest)
    return found[1] if found else None


def parsed(stanza: str) -> tuple:
    fields: dict[str, list[str]] = {}
    for line in stanza.split("\n"):
        key, _, value = line.partition(":")
        if value:
            fields.setdefault(key, []).append(value.strip())
    one = lambda key: fields.get(key, [""])[0]
    quoted = lambda key: [q for v in fields.get(key, []) if (q := _unquoted(v)) is not None]
    words = lambda key: [v.split()[0].split("!")[0] for v in fields.get(key, []) if v.split() and v.split()[0].split("!")[0]]
    return one("id"), one("name"), quoted("synonym"), (quoted("def") or [""])[0], words("alt_id"), words("is_a"), one("is_obsolete").startswith("true")


class OboReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.prefixes: list[str] = []
        self.obsolete: bool | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes prefixes of the id and whether a term is obsolete; Spark applies what is left."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("id",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("is_obsolete",):
                self.obsolete = f.value
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(path, begin, min(begin + self.size, size)) for path, size in _files(self.path) for begin in range(0, size, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for stanza in _stanzas(partition):
            term = parsed(stanza)
            if all(term[0].startswith(p) for p in self.prefixes) and self.obsolete in (None, term[6]):
                yield term


class OboSource(DataSource):
    """Options: ``path``, a file or folder; ``range_bytes``, how large a part of a file one task reads."""

    @classmethod
    def name(cls) -> str:
        return "obo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OboReader:
        if "path" not in self.options:
            raise ValueError("the obo source needs a path")
        return OboReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OboSource)
