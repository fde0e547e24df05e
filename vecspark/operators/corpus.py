"""A corpus of compressed vectors as immutable snapshots with an event log.

Every change returns a new corpus; the old one stays valid, which makes
batches atomic. Entries are rows in order of insert_seq.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.config import CodecConfig
from vecspark.errors import BatchFailure, ConfigMismatch, DimensionMismatch, UnknownVector
from vecspark.functions.exprs import normalized_metadata
from vecspark.operators.codebook import Codebook
from vecspark.operators.codec import COMPRESSED, POLICIES, Codec, compress, decompress

ENTRIES = f"vec_id string, compressed {COMPRESSED}, declared_dimension int, inserted_at_ns long, metadata map<string,variant>, insert_seq long"


def _in_order() -> Column:
    """The ids of rows (vec_id, insert_seq) in the order of the latter."""
    return F.transform(F.array_sort(F.collect_list(F.struct("insert_seq", "vec_id"))), lambda x: x["vec_id"])


@dataclass(frozen=True)
class Event:
    """One entry of the log. `type` is created, inserted, decompressed or violation; `ids` are the rows (vec_id, insert_seq) that an insertion added."""

    corpus_id: str
    type: str
    timestamp_ns: int
    ids: DataFrame | None = field(default=None, repr=False, compare=False)
    count: int = 0
    violation_type: str | None = None
    detail: str | None = None

    #: Fixed values of the JSON form.
    NAMES = {
        "created": "CorpusCreated",
        "inserted": "VectorsInserted",
        "decompressed": "CorpusDecompressed",
        "violation": "CompressionPolicyViolationDetected",
    }

    @property
    def vector_ids(self) -> tuple[str, ...]:
        """All ids in order, brought to the driver; `ids` has them as rows."""
        return () if self.ids is None else tuple(r["vec_id"] for r in self.ids.orderBy("insert_seq").toLocalIterator())

    def to_json(self, policy: str) -> str:
        fields: dict = {"type": self.NAMES[self.type], "corpusId": self.corpus_id}
        if self.type == "created":
            fields["compressionPolicy"] = policy
        elif self.type == "inserted":
            fields |= {"vectorIds": list(self.vector_ids), "count": self.count}
        elif self.type == "decompressed":
            fields["vectorCount"] = self.count
        else:
            fields |= {"violationType": self.violation_type, "detail": self.detail}
        return json.dumps(fields | {"timestampMillis": self.timestamp_ns // 1_000_000})


@dataclass(frozen=True)
class Corpus:
    corpus_id: str
    codec: Codec
    policy: str
    entries: DataFrame
    events: tuple[Event, ...] = ()
    clock: Callable[[], int] = time.time_ns

    @classmethod
    def create(
        cls, spark: SparkSession, corpus_id: str, config: CodecConfig, codebook: Codebook, policy: str = "compress", clock: Callable[[], int] = time.time_ns
    ) -> Corpus:
        if policy not in POLICIES:
            raise ValueError(f"policy {policy!r} is none of {POLICIES}")
        created = Event(corpus_id, "created", clock())
        return cls(corpus_id, Codec(config, codebook), policy, spark.createDataFrame([], ENTRIES), (created,), clock)

    @property
    def config(self) -> CodecConfig:
        return self.codec.config

    def _with_event(self, kind: str, entries: DataFrame, ids: DataFrame | None = None, count: int = 0, **more) -> Corpus:
        return replace(self, entries=entries, events=(*self.events, Event(self.corpus_id, kind, self.clock(), ids, count, **more)))

    def _faults(self, rows: DataFrame) -> DataFrame:
        """(ordinal, vec_id, error_class, detail) of rows that may not be inserted."""
        size = F.coalesce(F.size("vector"), F.lit(0))
        wrong = rows.where(size != self.config.dimension).select(
            "ordinal", "vec_id", F.lit("DimensionMismatch").alias("error_class"), F.concat(F.lit(f"{self.config.dimension} expected, got "), size.cast("string")).alias("detail")
        )
        known = F.lit("DuplicateVector").alias("error_class")
        stored = rows.join(self.entries.select("vec_id"), "vec_id", "left_semi").select("ordinal", "vec_id", known, F.lit("already stored").alias("detail"))
        first = rows.groupBy("vec_id").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = rows.join(first, "vec_id").where(F.col("ordinal") > F.col("first")).select("ordinal", "vec_id", known, F.lit("twice in the batch").alias("detail"))
        return wrong.unionAll(stored).unionAll(again)

    def insert_batch(self, rows: DataFrame) -> Corpus:
        """All of (vec_id, vector [, metadata JSON] [, ordinal]) or none; the first failing ordinal is reported. No event for no rows."""
        rows = self._numbered(rows)
        fault = self._faults(rows).orderBy("ordinal", "error_class").first()
        if fault:
            raise BatchFailure(fault["ordinal"], fault["error_class"], f"{fault['vec_id']}: {fault['detail']}")
        return self._appended(rows)

    def insert_permissive(self, rows: DataFrame) -> tuple[Corpus, DataFrame]:
        """Inserts the rows that can be and returns the others (vec_id, ordinal, error_class, detail), with a violation event."""
        rows = self._numbered(rows)
        faults = self._faults(rows).groupBy("ordinal", "vec_id").agg(F.min_by("error_class", "error_class").alias("error_class"), F.min("detail").alias("detail"))
        rejected = faults.count()
        corpus = self._appended(rows.join(faults.select("ordinal"), "ordinal", "left_anti"))
        if rejected:
            corpus = corpus._with_event("violation", corpus.entries, count=rejected, violation_type="rejected_rows", detail=f"{rejected} rows")
        return corpus, faults.select("vec_id", "ordinal", "error_class", "detail")

    def insert(self, vec_id: str, vector: list[float], metadata: str | None = None) -> Corpus:
        spark = self.entries.sparkSession
        return self.insert_batch(spark.createDataFrame([(vec_id, [float(x) for x in vector], metadata, 0)], "vec_id string, vector array<float>, metadata string, ordinal long"))

    def _numbered(self, rows: DataFrame) -> DataFrame:
        if "ordinal" not in rows.columns:
            rows = rows.withColumn("ordinal", F.monotonically_increasing_id())
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("string"))
        return rows.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("vector").cast("array<float>").alias("vector"), "metadata", "ordinal")

    def _appended(self, rows: DataFrame) -> Corpus:
        ids = rows.select("vec_id", F.col("ordinal").alias("insert_seq"))
        if not (count := ids.count()):
            return self
        after = F.coalesce(self.entries.select(F.max("insert_seq").alias("m")).scalar(), F.lit(-1)) + 1
        new = compress(rows, self.codec, "vector", "compressed", self.policy).select(
            "vec_id",
            "compressed",
            F.lit(self.config.dimension).alias("declared_dimension"),
            F.lit(self.clock()).cast("long").alias("inserted_at_ns"),
            normalized_metadata(F.col("metadata")).alias("metadata"),
            (after + F.col("ordinal")).alias("insert_seq"),
        )
        return self._with_event("inserted", self.entries.unionByName(new), ids, count)

    def append_compressed(self, rows: DataFrame) -> Corpus:
        """Takes entries compressed elsewhere (vec_id, compressed, insert_seq); another configuration refuses them all."""
        foreign = rows.where(~F.col("compressed.config_hash").eqNullSafe(self.config.config_hash)).select("vec_id").first()
        if foreign:
            raise ConfigMismatch(f"{foreign['vec_id']} was compressed with another configuration")
        new = rows.select(
            "vec_id",
            "compressed",
            F.lit(self.config.dimension).alias("declared_dimension"),
            F.lit(self.clock()).cast("long").alias("inserted_at_ns"),
            F.lit(None).cast("map<string,variant>").alias("metadata"),
            "insert_seq",
        )
        ids = rows.select("vec_id", "insert_seq")
        count = ids.count()
        return self._with_event("inserted", self.entries.unionByName(new), ids, count) if count else self

    def get(self, vec_id: str) -> DataFrame:
        found = self.entries.where(F.col("vec_id") == vec_id)
        if found.isEmpty():
            raise UnknownVector(vec_id)
        return found

    def contains(self, vec_id: str) -> bool:
        return not self.entries.where(F.col("vec_id") == vec_id).limit(1).isEmpty()

    def ids(self) -> DataFrame:
        """vec_id in insertion order."""
        return self.entries.orderBy("insert_seq").select("vec_id")

    def count(self) -> int:
        return self.entries.count()

    def decompress(self, vec_id: str) -> list[float]:
        return decompress(self.get(vec_id).select("vec_id", "compressed"), self.codec, policy=self.policy).first()["vector"]

    def restored(self) -> DataFrame:
        """(vec_id, vector) of all entries, without an event."""
        return decompress(self.entries.select("vec_id", "compressed"), self.codec, policy=self.policy).select("vec_id", "vector")

    def decompress_all(self) -> tuple[Corpus, DataFrame]:
        """All vectors in order of id; the event is added once they could be restored. An empty corpus has no event."""
        rows = self.restored().orderBy("vec_id").persist()
        n = rows.count()
        return (self._with_event("decompressed", self.entries, count=n) if n else self), rows

    def remove(self, vec_id: str) -> Corpus:
        if not self.contains(vec_id):
            raise UnknownVector(vec_id)
        return replace(self, entries=self.entries.where(F.col("vec_id") != vec_id))

    def remove_all(self, ids: DataFrame) -> Corpus:
        """Without the given vec_ids; unknown ones are passed over."""
        return replace(self, entries=self.entries.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"))

    def drain(self) -> tuple[Corpus, tuple[Event, ...]]:
        """The pending events, and the corpus without them."""
        return replace(self, events=()), self.events

    def events_frame(self) -> DataFrame:
        """The log as rows; an insertion's ids are one array."""
        spark = self.entries.sparkSession
        rows = [(i, e.corpus_id, e.type, e.count, e.violation_type, e.detail, e.timestamp_ns) for i, e in enumerate(self.events)]
        log = spark.createDataFrame(rows, "event int, corpus_id string, type string, count long, violation_type string, detail string, timestamp_ns long")
        listed = self.event_ids().groupBy("event").agg(_in_order().alias("vector_ids"))
        none = F.array().cast("array<string>")
        return log.join(listed, "event", "left").select("corpus_id", "type", F.coalesce("vector_ids", none).alias("vector_ids"), "count", "violation_type", "detail", "timestamp_ns")

    def event_ids(self) -> DataFrame:
        """(event, vec_id, insert_seq): all ids of all insertions in the log, a row each, by the event's place in it."""
        found = self.entries.sparkSession.createDataFrame([], "event int, vec_id string, insert_seq long")
        for i, event in enumerate(self.events):
            if event.ids is not None:
                found = found.unionAll(event.ids.select(F.lit(i).alias("event"), "vec_id", F.col("insert_seq").cast("long")))
        return found

    def save(self, folder: str) -> Corpus:
        """Writes a snapshot as Parquet and returns the corpus that reads it."""
        path = f"{folder.rstrip('/')}/{self.corpus_id}-{self.clock()}"
        self.entries.write.parquet(path)
        return replace(self, entries=self.entries.sparkSession.read.parquet(path))
