"""Stored search index of chunks: term postings by impact level, vectors in cells, and the chunks themselves.

All of it is Parquet below one folder, written once per snapshot of the chunks and read by the
searches of ``operators.stored``. A search reads the partitions of its terms and cells only and
never cuts a chunk's text into terms again.

- ``postings``: (part, term, level, block, places, weights), partitioned by ``part`` (a hash of the term). Chunks lie in
  ``blocks`` by a hash of their id, and a row lists the places of one block's chunks that hold the term, so neither
  ids nor payload are repeated by occurrence and a frequent term is many rows. A level holds the occurrences whose
  weight lies in one step of 1/``LEVELS_PER_UNIT``, so a term has a fixed number of levels and is not ranked anywhere.
- ``blocks``: (block, members): id and payload of each place of a block.
- ``levels``: (part, term, level, top, n, df): greatest weight and number of occurrences of each level.
- ``vectors``: (cell, chunk, vector, payload), partitioned by cell; ``cells``: centre, radius, count of each.
- ``chunks``: text and payload, clustered by payload if there is any, so that a filter reads few row groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import tokens
from dossier.operators.dense import _unit_rows
from dossier.operators.sparse import _counted, _document_weight

PARTS, LEVELS_PER_UNIT = 16, 16
# Chunks of a block, and blocks that one task turns into postings, with a file for each part.
BLOCK_ROWS, TASK_BLOCKS = 4096, 8
# Vectors are gathered around at most CELLS of their own number; their centres fit a task's memory.
CELLS, BATCH = 64, 4096
NO_DIRECTION = -1


def term_part(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class ChunkIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(f"{self.folder}/{name}")

    def _chunk_fields(self) -> str:
        """Id and payload with their types, as the tables of the index repeat them."""
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.chunks().schema if f.name != "text")

    def postings(self, parts: Sequence[int] | None = None) -> DataFrame:
        """Lists of occurrences; ``parts`` prunes the partitions read (at most ``PARTS`` numbers)."""
        rows = self._read("postings", "term string, level int, block int, places array<int>, weights array<double>, part int")
        return rows if parts is None else rows.where(F.col("part").isin(*parts))

    def blocks(self) -> DataFrame:
        return self._read("blocks")

    def levels(self) -> DataFrame:
        return self._read("levels", "term string, level int, top double, n long, df long, part int")

    def stats(self):
        return self._read("stats").first()

    def vectors(self) -> DataFrame:
        return self._read("vectors", f"{self._chunk_fields()}, vector array<double>, angle double, cell int")

    def cells(self) -> DataFrame:
        return self._read("cells", "cell int, centre array<double>, radius double, n long")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def write(
        self, chunks: DataFrame, *, payload: Sequence[str] = (), chunk_id: str = "chunk_id", text: str | None = "text", vector: str | None = "embedding",
        cells: int = CELLS, k1: float = K.BM25_K1, b: float = K.BM25_B,
    ) -> ChunkIndex:
        """Replaces the whole index by these chunks. Chunks without text or vector are found by the other list alone."""
        texts = F.col(text) if text else F.lit(None).cast("string")
        rows = chunks.select(F.col(chunk_id).alias("chunk_id"), texts.alias("text"), *payload)
        if payload:
            rows = rows.repartitionByRange(_ranges(rows), *payload, "chunk_id").sortWithinPartitions(*payload, "chunk_id")
        rows.write.mode("overwrite").parquet(f"{self.folder}/chunks")
        self._write_postings(self.chunks(), payload, k1, b)
        if vector:
            self._write_vectors(chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<double>").alias("vector"), *payload), cells)
        return self

    def _write_postings(self, chunks: DataFrame, payload: Sequence[str], k1: float, b: float) -> None:
        # The texts are cut into terms twice, which writes and shuffles less than their counts would.
        lengths = chunks.select(F.size(tokens("text")).alias("dl"))
        counts = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl")).first()
        blocks = max(1, -(-counts["n"] // BLOCK_ROWS))
        tasks = max(_ranges(chunks), -(-blocks // TASK_BLOCKS))
        # Rows of one id and payload have one place: their occurrences are added.
        place = F.dense_rank().over(Window.partitionBy("block").orderBy("chunk_id", *payload)) - 1
        dealt = chunks.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")).repartitionByRange(tasks, "block")
        placed = dealt.withColumn("place", place)

        member = F.struct("place", "chunk_id", *payload)
        placed.groupBy("block").agg(
            F.array_sort(F.collect_set(member)).alias("members"), F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(F.struct("chunk_id"))).cast("long").alias("ids"),
        ).write.mode("overwrite").parquet(f"{self.folder}/blocks")
        held = self.blocks().agg(F.sum("rows").alias("rows"), F.sum(F.size("members")).alias("places"), F.sum("ids").alias("ids")).first()
        stats = [(counts["n"], counts["avg_dl"], k1, b, held["rows"] != held["ids"])]
        self.spark.createDataFrame(stats, "n long, avg_dl double, k1 double, b double, repeated boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats")

        flat = _counted(placed, "place", "text", ["block"]).select("block", "place", "dl", F.inline("terms"))
        if held["rows"] != held["places"]:
            flat = flat.groupBy("block", "place", "dl", "term").agg(F.sum("tf").alias("tf"))
        weight = _document_weight(F.lit(counts["avg_dl"]).cast("double"), k1, b)
        rows = flat.select("block", "place", "term", weight.alias("weight")).withColumn("level", F.floor(F.col("weight") * LEVELS_PER_UNIT).cast("int"))
        # Both lists get the same occurrences in the same order; the tasks hold whole blocks, so neither occurrences nor lists are shuffled.
        lists = rows.groupBy("block", "term", "level").agg(F.collect_list("place").alias("places"), F.collect_list("weight").alias("weights"))
        lists = lists.withColumn("part", term_part("term")).sortWithinPartitions("part", "term", "level")
        lists.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/postings")
        steps = self.postings().groupBy("part", "term", "level").agg(F.max(F.array_max("weights")).alias("top"), F.sum(F.size("places")).alias("n"))
        steps = steps.withColumn("df", F.sum("n").over(Window.partitionBy("part", "term")))
        steps.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/levels")

    def _write_vectors(self, vectors: DataFrame, cells: int) -> None:
        """Vectors beside their nearest centre; a vector without direction lies in a cell that every search visits.

        Centres are ``cells`` of the vectors, chosen by a hash of the id. Vectors of another width
        than theirs, or with null components, have no cosine with a query and are not stored.
        """
        whole = vectors.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & (F.size("vector") > 0))
        chosen = whole.select("chunk_id", "vector", F.xxhash64("chunk_id").alias("h")).orderBy("h", "chunk_id").limit(cells).collect()
        width = len(chosen[0]["vector"]) if chosen else 0
        centres = _unit_rows(pa.array([r["vector"] for r in chosen if len(r["vector"]) == width], pa.list_(pa.float64()))) if chosen else np.zeros((0, 0))
        centres = np.unique(centres[np.linalg.norm(centres, axis=1) > 0], axis=0) if len(centres) else centres
        at = whole.columns.index("vector")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, BATCH):
                    part = batch.slice(low, BATCH)
                    unit = _unit_rows(part.column(at))
                    cosine = unit @ centres.T if len(centres) else np.zeros((len(unit), 1))
                    cell = cosine.argmax(axis=1).astype(np.int32)
                    angle = np.arccos(np.clip(cosine[np.arange(len(unit)), cell], -1, 1))
                    lost = ~unit.any(axis=1)
                    cell[lost], angle[lost] = NO_DIRECTION, np.pi
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(angle)], names=[*part.schema.names, "cell", "angle"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
        placed = whole.where(F.size("vector") == width).mapInArrow(assign, f"{schema}, cell int, angle double")
        keys = ["cell", "angle", "chunk_id"]
        placed.repartitionByRange(_ranges(placed), *keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/vectors")
        spread = self.vectors().groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
        known = self.spark.createDataFrame(
            [(i, c.tolist()) for i, c in enumerate(centres)] + [(NO_DIRECTION, [])], "cell int, centre array<double>",
        )
        known.join(spread, "cell").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells")
