"""The tables of a graph on disk: explicit schemas, hash partitions, one manifest for all tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.schema import ENTITIES, EPISODES, FACTS, INDEX_BLOCKS, INDEX_PLACES

#: The last two are the lexical index of active facts.
TABLES = {"entities": ENTITIES, "facts": FACTS, "episodes": EPISODES, "blocks": INDEX_BLOCKS, "places": INDEX_PLACES}
#: Partitions of a table by the hash of the graph id.
PARTS = 64


def part_of(graph_id: Column) -> Column:
    """The partition that a graph is in."""
    return F.pmod(F.xxhash64(F.coalesce(graph_id, F.lit(""))), F.lit(PARTS)).cast("int")


@dataclass
class Store:
    """Parquet folders under ``root``, and manifests that name those of all tables at once.

    A manifest is written when everything it names is complete, and renamed into
    place. Readers see the newest one, so tables always fit together, and a
    writer that dies leaves nothing behind that is read.
    """

    spark: SparkSession
    root: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest; -1 if there is none."""
        path, fs = self._fs()
        top = path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=-1)

    def manifest(self) -> dict[str, dict[str, list[str]]]:
        """Table -> partition -> folders."""
        n = self.version()
        if n < 0:
            return {t: {} for t in TABLES}
        path, fs = self._fs()
        stream = fs.open(path(f"{self.root}/manifest/{n:09d}.json"))
        try:
            return {t: {} for t in TABLES} | json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict[str, dict[str, list[str]]]) -> int:
        """Make ``manifest`` the newest one; its number."""
        path, fs = self._fs()
        n = self.version() + 1
        draft, final = path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), path(f"{self.root}/manifest/{n:09d}.json")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has written version {n}")
        return n

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """The table, or some of its partitions, in its schema. Filters and columns reach the files."""
        own = self.manifest()[table]
        folders = [f"{self.root}/{f}" for p, fs in sorted(own.items()) if parts is None or int(p) in parts for f in fs]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*folders)

    def stage(self, table: str, df: DataFrame) -> dict[str, list[str]]:
        """Write rows without anyone seeing them yet: partition -> folders, for a manifest."""
        own = f"{table}/{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]], part_of(F.col("graph_id")).alias("part"))
        rows.write.partitionBy("part").parquet(f"{self.root}/{own}")
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/{own}"))]
        return {n.removeprefix("part="): [f"{own}/{n}"] for n in names if n.startswith("part=")}

    def write(self, table: str, df: DataFrame) -> int:
        """The table anew."""
        staged = self.stage(table, df)
        return self.commit(self.manifest() | {table: staged})

    def append(self, table: str, rows: DataFrame) -> int:
        """More rows; nothing that is there is written again."""
        staged = self.stage(table, self.spark.createDataFrame([], TABLES[table]).unionByName(rows, allowMissingColumns=True))
        now = self.manifest()
        return self.commit(now | {table: joined(now[table], staged)})

    def delete_all(self) -> None:
        """All tables empty."""
        self.commit({t: {} for t in TABLES})

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written to a working folder and read again, so that it is computed once; see :meth:`sweep`."""
        folder = f"{self.root}/working/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def sweep(self) -> None:
        """Delete the working folders."""
        path, fs = self._fs()
        fs.delete(path(f"{self.root}/working"), True)


def joined(old: dict[str, list[str]], new: dict[str, list[str]]) -> dict[str, list[str]]:
    """Folders of both, by partition."""
    return {p: [*old.get(p, []), *new.get(p, [])] for p in {*old, *new}}
