"""Versioned tables of parts: a manifest names the folder of each part, and a version is one manifest.

New data is written beside the old; then the manifest is put in place by one rename, which fails if
another run took that version. Readers see a whole version or the one before. Parts that a run does not
touch stay where they are, so a small change writes little.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..operators.durable import sized, stored
from ..operators.merge import keep_last, upsert

PLACE = ("_block", "_row")  #: where a passage stands in the index


class Store:
    """A table under ``path`` in ``parts`` parts by a hash of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def part(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The rows with their ``_part``, all of a part in one partition."""
        return rows.withColumn("_part", self.part()).repartition(self.parts, "_part")

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Part -> folder, of the newest or a given version; none: empty."""
        known = self.versions()
        if version is None and not known:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/v{known[-1] if version is None else version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (of some parts only); None if there are none."""
        folders = [f for p, f in self.manifest(version).items() if parts is None or int(p) in parts]
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def commit(self, rows: DataFrame, touched: list[int] | None = None, part: Column | None = None) -> int:
        """Writes ``rows`` as the whole new content of the ``touched`` parts (None: of all); returns the
        version. Fails, and leaves the table as it was, if another run wrote that version meanwhile."""
        run = f"data/{uuid.uuid4().hex}"
        if "_part" not in rows.columns:  # else the rows of a part are together already
            rows = self.dealt(rows) if part is None else rows.withColumn("_part", part)
        rows.write.partitionBy("_part").option("compression", "zstd").parquet(f"{self.path}/{run}")
        made = {n.removeprefix("_part="): f"{run}/{n}" for n in self._names(run) if n.startswith("_part=")}
        kept = {} if touched is None else {p: f for p, f in self.manifest().items() if int(p) not in touched}
        known = self.versions()
        version = known[-1] + 1 if known else 1
        self._put(f"manifests/v{version}.json", json.dumps(kept | made))
        return version

    def _put(self, name: str, text: str) -> None:
        draft, goal = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        self._fs.mkdirs(goal.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(goal) or not self._fs.rename(draft, goal):
            raise FileExistsError(f"{name}: written by another run")

    def upsert(self, new: DataFrame, seq: str | None = None) -> int:
        """Rows of both by key, the new one counting, of new ones the last in ``seq``. Only parts that have
        new rows are read and written."""
        return self.merge(new, seq)[0]

    def merge(self, new: DataFrame, seq: str | None = None, placed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[int, list[int] | None]:
        """``upsert``, with columns that ``placed`` adds to the rows of a part; also the parts that were written
        (None: all, in a new table, whose rows are worked out once)."""
        touched = None
        if self.versions():
            touched = [r[0] for r in new.select(self.part().alias("p")).distinct().collect()]  # at most `parts` numbers
        both = new.withColumn("_new", F.lit(1))
        old = self.read(parts=touched) if touched else None
        if old is not None:
            old = old.select(*(c for c in old.columns if c not in PLACE))
            both = old.withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
        order = ["_new"] + ([seq] if seq else [F.xxhash64(*(f"`{c}`" for c in new.columns))])
        # Rows are dealt over the parts once; equal keys meet there.
        rows = keep_last(self.dealt(both), [self.key, "_part"], order).drop("_new")
        return self.commit(rows if placed is None else placed(rows), touched), touched

    def prune(self, keep: int = 2) -> list[int]:
        """Deletes all versions but the newest ``keep``, and the data that none of these names."""
        known = self.versions()
        gone = known[: max(0, len(known) - keep)]
        for v in gone:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v}.json"), False)
        named = {f for v in known[len(gone) :] for f in self.manifest(v).values()}
        for run in self._names("data"):
            parts = self._names(f"data/{run}")
            if not any(f"data/{run}/{p}" in named for p in parts):
                self._fs.delete(self._path(f"{self.path}/data/{run}"), True)
                continue
            for p in parts:
                if p.startswith("_part=") and f"data/{run}/{p}" not in named:
                    self._fs.delete(self._path(f"{self.path}/data/{run}/{p}"), True)
        return gone


class SearchStore:
    """Passages and their inverted index, in the same parts, which are the index's blocks.

    An upsert rebuilds the blocks that have new passages, from the stored ones; frequencies are kept by block,
    so they follow. The passages are committed first: if a run ends in between, the next upsert of the
    same rows mends the index.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id", parts: int = 64):
        self.passages, self.index = Store(spark, f"{path}/passages", key, parts), Store(spark, f"{path}/index", "block", parts)

    def upsert(self, new: DataFrame, seq: str | None = None) -> int:
        _, touched = self.passages.merge(new, seq, lambda rows: index.with_places(rows, "_part", self.passages.key))
        rows = self.passages.read(parts=touched)
        if rows is None:
            return 0
        made = index.postings(rows.withColumnRenamed(self.passages.key, "point_id"))
        return self.index.commit(made, touched, F.shiftright("block", index.PART_BITS).cast("int"))

    def search(self, queries: DataFrame, limit: int, condition: Column | None = None, min_score: float | None = None) -> DataFrame:
        """Hits with the passages' columns; ``condition`` on these columns holds for all hits, and the score is
        cut after the limit."""
        rows = self.passages.read()
        allowed = None if condition is None else rows.filter(condition).select(*PLACE)
        hits, _ = index.search(self.index.read(), queries, limit, allowed)
        out = rows.drop(*PLACE).withColumnRenamed(self.passages.key, "point_id").join(sized(stored(hits, "found")), "point_id")
        return out if min_score is None else out.filter(F.col("score") >= min_score)


def index_run(store: Store, records: DataFrame, expected: DataFrame, now: str, dry: bool = False, recreate: bool = False) -> DataFrame:
    """Indexes corpus payloads (``source_id, point_id, ...``, a null point_id: not indexable) into a store.

    ``expected(source_id, required)`` are the sources that should be there. Returns per source: read,
    indexed, skipped, missing, warning. Rows get ``indexed_at``. ``dry``: counts only, nothing is written;
    ``recreate``: the store begins anew, its old versions stay readable.
    """
    read = records.groupBy("source_id").agg(F.count("*").alias("read"), F.count("point_id").alias("indexed"))
    stats = expected.join(read, "source_id", "left").na.fill(0, ["read", "indexed"])
    missing = F.col("read") == 0
    warning = F.when(missing, F.concat(F.when(F.col("required"), "required").otherwise("optional"), F.lit(" source has no records: "), "source_id"))
    stats = stats.select("source_id", "read", "indexed", (F.col("read") - F.col("indexed")).alias("skipped"), missing.alias("missing"), warning.alias("warning"))
    if not dry:
        rows = records.filter("point_id IS NOT NULL").withColumn("indexed_at", F.lit(now))
        if recreate:
            store.commit(upsert(rows.limit(0), rows, store.key))
        else:
            store.upsert(rows)
    return stats
