"""A user dataset as a Spark data source: records of Parquet row groups.

``spark.dataSource.register(RecordDataset)`` and then
``spark.read.format("record_dataset").option("path", dir).load()``. A partition
is one row group, read as Arrow batches on the executor.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RowGroup(InputPartition):
    def __init__(self, path: str, group: int):
        self.path = path
        self.group = group


class RecordReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path = path
        self.columns = columns

    def partitions(self):
        import pyarrow.dataset as ds

        groups = []
        for fragment in ds.dataset(self.path, format="parquet").get_fragments():
            # footers only
            groups += [RowGroup(fragment.path, g.id) for g in fragment.row_groups]
        return groups or [RowGroup("", -1)]

    def read(self, partition):
        import pyarrow.parquet as pq

        if partition.group < 0:
            return
        file = pq.ParquetFile(partition.path)
        yield from file.iter_batches(row_groups=[partition.group], columns=self.columns)


class RecordDataset(DataSource):
    @classmethod
    def name(cls):
        return "record_dataset"

    def schema(self):
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(ds.dataset(self.options["path"], format="parquet").schema)

    def reader(self, schema):
        return RecordReader(self.options["path"], schema.fieldNames())
