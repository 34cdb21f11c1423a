"""Extension points: what reads a source, changes parsed documents, or writes them out."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from .pipeline import Options, Tables, convert, to_graph, to_json, to_markdown


@runtime_checkable
class Builder(Protocol):
    """A source's rows to parsed documents."""

    def build(self, source: DataFrame, options: Options) -> Tables: ...


@runtime_checkable
class Pass(Protocol):
    """Documents to documents; passes are chained with `Tables.transform`."""

    def __call__(self, tables: Tables) -> Tables: ...


@runtime_checkable
class Emitter(Protocol):
    """Documents to rows of output, one a document."""

    def emit(self, tables: Tables) -> DataFrame: ...


class PageBuilder:
    """Pages (doc_id, html) through the default passes."""

    def build(self, source: DataFrame, options: Options = Options()) -> Tables:
        return convert(source, options=options)


class MarkdownEmitter:
    def emit(self, tables: Tables) -> DataFrame:
        return to_markdown(tables)


class JsonEmitter:
    def __init__(self, mode: str = "document") -> None:
        self.mode = mode

    def emit(self, tables: Tables) -> DataFrame:
        return to_json(tables, self.mode)


class NodeEmitter:
    """Nodes of the property graph."""

    def emit(self, tables: Tables) -> DataFrame:
        return to_graph(tables)[0]
