"""A full-text index kept in files: postings by term, batch after batch, with replaced and deleted documents, read by the terms of a query only.

A batch is a segment: ``postings`` (term, doc_id, tf, places, length) in BUCKETS folders by the term's first two characters and sorted by term, so that a query reads the
row groups of its terms (and of a prefix of two characters or more) alone; ``docs`` (doc_id, length, live); and ``gone``, the documents of older segments that the batch replaces or
deletes. A posting counts unless a later segment says that its document is gone. A segment counts as of one rename (``sources.commits``). ``merge`` makes one segment of all.

Terms are lower-case runs of letters and digits without marks, stemmed by Porter's algorithm; so are the words of a query. The number of documents and the sum of their
lengths are part of the committed state, so no query counts them.

Results for special input: a null text is an empty one; of a batch's rows with one doc_id one counts (the greatest text); a null doc_id is left out;
deleting an unknown document does nothing; a query without words, or on an empty index, finds nothing.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.stemming import index_term, known_terms
from ledgerloom.operators import search
from ledgerloom.sources.commits import Commits

BUCKETS = 128
#: Words of documents that are grouped at once.
AT_ONCE = 500_000


def _bucket(term: str) -> int:
    return zlib.crc32(term[:2].encode()) % BUCKETS


def _bucket_column():
    return F.pmod(F.crc32(F.substring("term", 1, 2).cast("binary")), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, places, length) of (doc_id, words): a document's own words make its postings, so nothing is shuffled or spilled for them."""
    for b in batches:
        ends, first = np.cumsum(b["words"].value_lengths().to_numpy(zero_copy_only=False)), 0
        while first < len(ends):
            to = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
            yield _of(b.slice(first, to - first))
            first = to


def _of(b: pa.RecordBatch) -> pa.RecordBatch:
    length = b["words"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    words = b["words"].flatten().dictionary_encode()
    terms = pa.array(known_terms(words.dictionary.to_pylist()), pa.string()).dictionary_encode()
    term = terms.indices.to_numpy()[words.indices.to_numpy()]
    order = np.lexsort((place, term, row))
    row, term, place = row[order], term[order], place[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])][: len(row)])
    ends = np.r_[starts, len(row)]
    of = row[starts]
    columns = {"term": terms.dictionary.take(pa.array(term[starts])), "doc_id": b["doc_id"].take(pa.array(of)), "tf": pa.array(np.diff(ends), pa.int64()), "places": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32())), "length": pa.array(length[of], pa.int32())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long"):
        self.spark, self.folder, self.commits = spark, folder.rstrip("/"), Commits(spark, folder)
        self.schemas = {
            "postings": f"term string, doc_id {id_type}, tf long, places array<int>, length int, part string, bucket int", "docs": f"doc_id {id_type}, length int, live boolean, part string", "gone": f"doc_id {id_type}, part string",
        }

    def _read(self, state: dict, table: str) -> DataFrame:
        parts = state.get("segments", [])
        rows = self.spark.read.schema(self.schemas[table])
        return rows.option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/part={p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schemas[table])

    @staticmethod
    def _name(state: dict) -> tuple[int, str]:
        number = state.get("number", 0) + 1
        return number, f"{number:09d}-{uuid.uuid4().hex[:12]}"

    def _now(self, state: dict, ids: DataFrame) -> DataFrame:
        """What is live of some documents: (doc_id, length)."""
        known = self._read(state, "docs").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return known.groupBy("doc_id").agg(F.max_by(F.struct("length", "live"), "part").alias("d")).where("d.live").select("doc_id", "d.length")

    def _write(self, part: str, table: str, rows: DataFrame) -> None:
        path = f"{self.folder}/{table}/part={part}"
        if table == "postings":
            rows.withColumn("bucket", _bucket_column()).repartition("bucket", F.substring("term", 1, 2)).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
        else:
            rows.write.parquet(path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """Index a batch; documents that are known already are replaced. Returns the committed state."""
        version, state = self.commits.latest()
        number, part = self._name(state)
        batch = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
        words = batch.select("doc_id", search.terms(F.col("text")).alias("words"))
        self._write(part, "postings", words.mapInArrow(_postings, f"term string, doc_id {words.schema['doc_id'].dataType.simpleString()}, tf long, places array<int>, length int"))
        self._write(part, "docs", words.select("doc_id", F.size("words").alias("length"), F.lit(True).alias("live")))
        own = self.spark.read.parquet(f"{self.folder}/docs/part={part}")
        return self._commit(version, state, number, part, own, own)

    def delete(self, ids: DataFrame) -> dict:
        """Forget documents (doc_id)."""
        version, state = self.commits.latest()
        number, part = self._name(state)
        known = self._now(state, ids)
        self._write(part, "postings", self.spark.createDataFrame([], "term string, doc_id long, tf long, places array<int>, length int").withColumn("doc_id", F.col("doc_id").cast(known.schema["doc_id"].dataType)))
        self._write(part, "docs", known.select("doc_id", F.lit(0).alias("length"), F.lit(False).alias("live")))
        return self._commit(version, state, number, part, None, self.spark.read.parquet(f"{self.folder}/docs/part={part}"))

    def _commit(self, version: int, state: dict, number: int, part: str, new: DataFrame | None, touched: DataFrame) -> dict:
        old = self._now(state, touched)
        self._write(part, "gone", old.select("doc_id"))
        size = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        (n0, t0), (n1, t1) = size(old), size(new) if new is not None else (0, 0)
        after = {"number": number, "segments": [*state.get("segments", []), part], "documents": state.get("documents", 0) + n1 - n0, "words": state.get("words", 0) + t1 - t0}
        self.commits.commit(version, after)
        return after

    def _valid(self, state: dict, found: DataFrame) -> DataFrame:
        gone = self._read(state, "gone").groupBy("doc_id").agg(F.max("part").alias("last"))
        return found.join(gone, "doc_id", "left").where("last is null or last <= part").drop("last")

    def postings(self, state: dict, words: list[str]) -> DataFrame:
        """The live postings of a query's words, each with its ``word``."""
        rows = self._read(state, "postings")

        def of(word: str) -> DataFrame:
            stem = word.rstrip("*")
            near = rows if word.endswith("*") and len(stem) < 2 else rows.where(F.col("bucket") == _bucket(stem))
            return search.matching(near, word)

        return self._valid(state, reduce(DataFrame.unionByName, map(of, words)))

    def search(self, query: str, limit: int = 25) -> DataFrame:
        """The best documents (doc_id, score), highest first."""
        state = self.commits.latest()[1]
        groups = [[tuple(index_term(w.rstrip("*")) + "*" * w.endswith("*") for w in p) for p in g] for g in search.parse(query)]
        words = search.words_of(groups)
        if not words or not state.get("documents"):
            return self._read({}, "docs").select("doc_id", F.lit(0.0).alias("score"))
        return search.rank(self.postings(state, words), groups, state["documents"], state["words"] / state["documents"], limit)

    def merge(self) -> dict:
        """One segment of all that is live; finds the same afterwards."""
        version, state = self.commits.latest()
        number, part = self._name(state)
        self._write(part, "postings", self._valid(state, self._read(state, "postings")).drop("part", "bucket"))
        last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("part")))
        self._write(part, "docs", self._read(state, "docs").withColumn("r", last).where("r = 1 and live").select("doc_id", "length", "live"))
        self._write(part, "gone", self._read({}, "gone").select("doc_id"))
        after = {**state, "number": number, "segments": [part]}
        self.commits.commit(version, after)
        return after

    def vacuum(self) -> int:
        return self.commits.vacuum(lambda state: [f"{t}/part={p}" for p in state.get("segments", []) for t in self.schemas])
