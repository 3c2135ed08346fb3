"""Parsers as plug-ins: what reads a format, chosen by ending, predicate and priority."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUILT_IN = -10
#: From session and files (path, content) to transactions with `problem`.
Reader = Callable[[SparkSession, DataFrame], DataFrame]


@dataclass(frozen=True)
class Parser:
    name: str
    read: Reader
    extensions: tuple[str, ...]
    priority: int = 0
    institutions: tuple[str, ...] = ()
    handles: Callable[[str], bool] | None = None

    def can_handle(self, path: str, institution: str | None = None) -> bool:
        if institution and self.institutions and institution.lower() not in (i.lower() for i in self.institutions):
            return False
        return self.handles(path) if self.handles else path.lower().endswith(tuple(e.lower() for e in self.extensions))


@dataclass
class Registry:
    parsers: dict[str, Parser] = field(default_factory=dict)
    #: Files of the modules that registered parsers by name.
    origin: dict[str, str] = field(default_factory=dict)

    def register(self, parser: Parser) -> bool:
        """False if one of this name with the same or a higher priority is there already."""
        old = self.parsers.get(parser.name)
        if old and parser.priority <= old.priority:
            return False
        self.parsers[parser.name] = parser
        return True

    def choose(self, path: str, institution: str | None = None) -> Parser | None:
        """The parser of the highest priority that handles the path; the first registered of equals."""
        return max((p for p in self.parsers.values() if p.can_handle(path, institution)), key=lambda p: p.priority, default=None)

    def chosen(self, files: DataFrame, institution: Column) -> DataFrame:
        """files (path, ...) with `parser`, the name of what `choose` gives for their path and institution; null where nothing does."""
        names = F.udf(lambda path, inst: getattr(self.choose(path, inst), "name", None), "string")
        return files.withColumn("parser", names("path", institution))

    def for_ending(self, ending: str) -> list[Parser]:
        """Parsers of an ending, those that `choose` prefers first."""
        found = [p for p in self.parsers.values() if "." + ending.lower().lstrip(".") in (e.lower() for e in p.extensions)]
        return sorted(found, key=lambda p: -p.priority)

    def reload(self, folder: str) -> int:
        """Drop what modules of folder have registered and discover it again, so that changed, added and deleted modules take effect. Parsers that a dropped one
        had replaced come back with the module or call that registers them."""
        for name in [n for n, where in self.origin.items() if Path(where).parent == Path(folder)]:
            self.parsers.pop(name, None)
            del self.origin[name]
        return self.discover(folder)

    def formats(self) -> list[str]:
        return sorted({e for p in self.parsers.values() for e in p.extensions})

    def info(self) -> list[dict]:
        return [{"name": p.name, "extensions": p.extensions, "priority": p.priority, "institutions": p.institutions} for p in self.parsers.values()]

    def discover(self, folder: str) -> int:
        """Register what `PARSERS` of the modules in a folder lists; how many there were. Executors need the modules too (addPyFile)."""
        n = 0
        for path in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            for p in getattr(module, "PARSERS", []):
                if self.register(p):
                    n, self.origin[p.name] = n + 1, str(path)
        return n


def built_in(this_year: int, date_formats: list[str] | None = None, overrides: dict[str, str] | None = None) -> Registry:
    """The parsers of the library. date_formats and overrides (field to header) are for CSV files."""
    from .sources import csv_files, ofx, pdf_lines

    out = Registry()
    out.register(Parser("csv", lambda spark, files: csv_files.read(spark, files, date_formats or None, overrides), (".csv",), BUILT_IN))
    out.register(Parser("qfx", lambda spark, files: ofx.read(files), (".qfx", ".ofx"), BUILT_IN))
    out.register(Parser("pdf", lambda spark, files: pdf_lines.statements(files, this_year), (".pdf",), BUILT_IN))
    return out
