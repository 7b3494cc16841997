"""A paged source as a Spark data source: one task per partition value, pages by cursor, equality filters pushed to the pages.

``spark.dataSource.register(paged("issues", fetch, schema, "repository", ["a", "b"]))`` makes ``spark.read.format("issues").load()``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

#: (partition value, pushed equalities, cursor or None) -> (rows, next cursor or None)
Fetch = Callable[[str, Mapping[str, object], str | None], tuple[Iterable[tuple], str | None]]


def paged(name_: str, fetch: Fetch, schema_: str, partition: str, values: list[str], pushed: tuple[str, ...] = ()) -> type[DataSource]:
    """A data source class; columns in ``pushed`` (and the partition column) take equality filters."""

    class Reader(DataSourceReader):
        def __init__(self):
            self.equal: dict[str, object] = {}

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            for f in filters:
                if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in (*pushed, partition):
                    self.equal[f.attribute[0]] = f.value
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(v) for v in values if self.equal.get(partition, v) == v] or [InputPartition(None)]

        def read(self, part: InputPartition) -> Iterator[tuple]:
            cursor = None
            rest = {k: v for k, v in self.equal.items() if k != partition}
            while part.value is not None:
                rows, cursor = fetch(part.value, rest, cursor)
                yield from rows
                if cursor is None:
                    return

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source
