"""Statuses by pages: a stream source that remembers, for each server, the id up to which it has read.

The offset is ``{server: id}``, the high-water mark of every server. A batch takes the next page of each:
up to ``page`` statuses above the mark, nearest first (and all that share the last one's id). Both ends of a batch
are in the stream's log before it runs, so a batch that runs again reads the same ids, and a stream that starts
again goes on where the last one stood. A server with nothing new has no part in a batch, and without any there
is no batch (but for a stream's first, which is empty then): an empty page is no data. Statuses at or below a mark are never asked for again, nor
those without an id or a server.

What pages are made of is the client's matter: :class:`ParquetPages` reads a folder of Parquet files; a
subclass of :class:`PagedStatuses` may bring another client with the same four methods.
"""

from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from geopulse.schemas import STATUS
from geopulse.session import importable

# Statuses of a server in one batch, and in one task of it.
PAGE_ROWS = 100_000
TASK_ROWS = 25_000
LEAST = -(1 << 63)


def write_pages(statuses: DataFrame, path, file_rows=1_000_000, mode="append"):
    """Statuses as a folder for :class:`ParquetPages`: ids ascend over the files of a server, so a page is
    in few of them."""
    rows = statuses.repartitionByRange("server", "id").sortWithinPartitions("server", "id")
    rows.write.mode(mode).option("maxRecordsPerFile", file_rows).partitionBy("server").parquet(path)


class ParquetPages:
    """Pages from files below ``path/server=<name>``, in any order and size.

    Footers say which row groups may hold the ids asked for; they are read once, also those of files that
    arrive later. Row groups without statistics are read for every page.
    """

    def __init__(self, path: str):
        path = path.replace("s3a://", "s3://", 1)
        if "://" in path or path.startswith("file:"):
            self.files, self.root = fs.FileSystem.from_uri(path)
        else:
            self.files, self.root = fs.LocalFileSystem(), path
        self.footers = {}

    def servers(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        names = [i.base_name for i in found if i.type == fs.FileType.Directory and i.base_name.startswith("server=")]
        return sorted(unquote(n[len("server="):]) for n in names if n != "server=__HIVE_DEFAULT_PARTITION__")

    def _folder(self, server: str) -> str:
        for info in self.files.get_file_info(fs.FileSelector(self.root)):
            if info.base_name.startswith("server=") and unquote(info.base_name[len("server="):]) == server:
                return info.path
        raise FileNotFoundError(f"no folder of server {server} in {self.root}")

    def groups(self, server: str) -> list[tuple]:
        """``(first id, last id, file, row group)`` by first id."""
        out = []
        for info in self.files.get_file_info(fs.FileSelector(self._folder(server), recursive=True)):
            if info.type != fs.FileType.File or not info.base_name.endswith(".parquet"):
                continue
            if info.path not in self.footers:
                self.footers[info.path] = self._footer(info.path)
            out += self.footers[info.path]
        return sorted(out)

    def _footer(self, path: str) -> list[tuple]:
        with self.files.open_input_file(path) as source:
            meta = pq.ParquetFile(source).metadata
        at = [i for i in range(meta.num_columns) if meta.schema.column(i).path == "id"][0]
        out = []
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            known = stats is not None and stats.has_min_max
            if known or stats is None or stats.null_count != meta.row_group(g).num_rows:
                out.append((stats.min if known else LEAST, stats.max if known else -LEAST - 1, path, g))
        return out

    def _read(self, path: str, group: int, after: int, upto: int, columns=None) -> pa.Table:
        with self.files.open_input_file(path) as source:
            table = pq.ParquetFile(source).read_row_group(group, columns=columns)
        return table.filter(pc.and_(pc.greater(table["id"], after), pc.less_equal(table["id"], upto)))

    def ids(self, server: str, after: int, upto=-LEAST - 1, n=None) -> np.ndarray:
        """Sorted ids above ``after`` up to ``upto``; of these the ``n`` least and their equals."""
        out = np.zeros(0, np.int64)
        for first, last, path, group in self.groups(server):
            if first > upto or (n is not None and len(out) >= n and first > out[n - 1]):
                break
            if last > after:
                got = self._read(path, group, after, upto, ["id"])["id"].to_numpy()
                out = np.sort(np.concatenate([out, got]))
                if n is not None and len(out) > n:
                    out = out[: np.searchsorted(out, out[n - 1], "right")]
        return out

    def page_end(self, server: str, after: int, n: int):
        """The last id of the next page; None if nothing is new."""
        ids = self.ids(server, after, n=n)
        return int(ids[-1]) if len(ids) else None

    def parts(self, server: str, after: int, upto: int, n: int) -> list[tuple]:
        """A page cut into ranges ``(after, upto, pieces)`` of about ``n`` statuses."""
        ids = self.ids(server, after, upto)
        ends = sorted({int(ids[min(i + n, len(ids)) - 1]) for i in range(0, len(ids), n)})
        groups = self.groups(server)
        out = []
        for low, high in zip([after, *ends], ends):
            out.append((low, high, [(path, g) for first, last, path, g in groups if first <= high and last > low]))
        return out

    def read(self, server: str, after: int, upto: int, pieces) -> "iter[pa.Table]":
        """The statuses of a part."""
        for path, group in pieces:
            table = self._read(path, group, after, upto)
            yield table.append_column("server", pa.array([server] * len(table), pa.string()))


class Part(InputPartition):
    """A range of one server's ids, and where they are."""

    def __init__(self, server, after, upto, pieces):
        self.server, self.after, self.upto, self.pieces = server, after, upto, pieces


class PagedReader(DataSourceStreamReader):
    def __init__(self, client, page: int, task_rows: int, schema):
        self.client, self.page, self.task_rows = client, page, task_rows
        self.schema = to_arrow_schema(schema)
        self.position = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """One page beyond what was planned last. Keys are sorted: offsets are compared as text."""
        now = dict(self.position or {})
        for server in self.client.servers():
            end = self.client.page_end(server, now.get(server, LEAST), self.page)
            if end is not None:
                now[server] = end
        self.position = dict(sorted(now.items()))
        return self.position

    def partitions(self, start: dict, end: dict):
        if self.position is None:
            # A stream that starts again plans its last batch first; from there it goes on.
            self.position = dict(sorted(end.items()))
        out = []
        for server, upto in end.items():
            after = start.get(server, LEAST)
            if upto > after:
                out += [Part(server, *part) for part in self.client.parts(server, after, upto, self.task_rows)]
        return out

    def read(self, partition: Part):
        for table in self.client.read(partition.server, partition.after, partition.upto, partition.pieces):
            columns = [
                table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(len(table), f.type)
                for f in self.schema
            ]
            yield from pa.Table.from_arrays(columns, schema=self.schema).to_batches()

    def commit(self, end: dict):
        pass


class PagedStatuses(DataSource):
    """Format ``paged_statuses``: options ``path``, ``page`` (statuses of a server in a batch) and
    ``taskRows`` (statuses in a task)."""

    @classmethod
    def name(cls):
        return "paged_statuses"

    def schema(self):
        return STATUS

    def client(self):
        return ParquetPages(self.options["path"])

    def streamReader(self, schema):
        page = int(self.options.get("page", PAGE_ROWS))
        task_rows = int(self.options.get("taskRows", TASK_ROWS))
        if page < 1 or task_rows < 1:
            raise ValueError("page and taskRows must be 1 or more")
        return PagedReader(self.client(), page, task_rows, schema)


def paged_statuses(spark: SparkSession, path, page=PAGE_ROWS, task_rows=TASK_ROWS, source=PagedStatuses) -> DataFrame:
    """The stream of a paged source."""
    importable(spark)
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name())
    return reader.option("path", path).option("page", page).option("taskRows", task_rows).load()
