"""Substring search that opens only the files and blocks that can hold the query.

The index lists, for every three characters in a row of the lower-cased texts, the files and blocks
of BLOCK rows they are in. A query's lists are intersected, and what is left is read and verified by
the plain test. Rows and their lists are parts of one versioned table and become visible together.
Queries of under three characters, and those with more than FILES candidate files, read all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starlens.functions import text as tx
from starlens.session import map_arrow
from starlens.sources import versioned as V

BLOCK = 256
#: Folders of the lists; a query opens those of its own character triples.
BUCKETS = 64
FILES = 10_000
ROWS, LISTS = "search_rows", "search_lists"
LIST_SCHEMA = "gram string, file string, blocks array<bigint>, bucket int"
THREE = r"(?s)(?=(...))"


def grams(text: Column) -> Column:
    """The different runs of three characters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(THREE), F.lit(1)))


def listed_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, file, blocks) of batches of lower-cased texts with their places: a row per triple of a batch's
    file, not one per review that has it."""
    for batch in batches:
        text, file, block = batch.column("text").cast(pa.large_string()), batch.column("file"), batch.column("block").to_numpy()
        name = file.dictionary_encode()
        names = name.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(names) != 0)) + 1
        runs = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True)) if len(batch) else []
        for number in range(len(name.dictionary)):
            mine = [(a, b) for a, b in runs if names[a] == number]
            codes = [_codes(text.slice(a, b - a)) for a, b in mine]
            at = np.repeat(np.array([block[a] for a, _ in mine]), [len(c) for c in codes])
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            code, at = code[order], at[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            points = np.stack([code[first] >> 42, (code[first] >> 21) & 0x1FFFFF, code[first] & 0x1FFFFF], axis=1).astype("<u4")
            word = points.tobytes().decode("utf-32-le")
            gram = pa.array([word[i:i + 3] for i in range(0, len(word), 3)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(at, pa.int64()))
            yield pa.record_batch({"gram": gram, "file": pa.array([name.dictionary[number].as_py()] * len(gram), pa.string()), "blocks": lists})


def _codes(texts: pa.Array) -> np.ndarray:
    """The different triples of the texts of a block, 21 bits a code point."""
    # two more characters end each text; a triple that has one of them goes
    points = np.frombuffer("".join(t + "\0\0" for t in texts.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    ends = np.cumsum(pc.add(pc.utf8_length(texts), 2).to_numpy())
    mark = np.zeros(len(points), dtype=bool)
    mark[ends - 1] = mark[ends - 2] = True
    triples = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.unique(triples[~(mark[:-2] | mark[1:-1] | mark[2:])])


def grams_of(query: str) -> list[str]:
    return sorted({query[i:i + 3] for i in range(len(query) - 2)})


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _place() -> list[Column]:
    return [F.regexp_extract("_metadata.file_path", f"({V.PART}=[^/]+/.*)$", 1).alias("file"),
            F.floor(F.col("_metadata.row_index") / BLOCK).alias("block")]


def _opened(spark: SparkSession, folder: str, schema: StructType, paths: list[str]) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(V.PART, "string")).option("basePath", f"{folder}/data").parquet(*[f"{folder}/data/{p}" for p in paths])


def add(rows: DataFrame, folder: str, text_column: str = "Review_Text", writer: str = "search", batch: int | None = None) -> bool:
    """Store rows and their lists in one step; False, and nothing changes, if the batch is there already."""
    spark = rows.sparkSession
    state = V.manifest(spark, folder)
    if V.done(state, writer, batch):
        return False
    part = V.write_part(rows, folder, ROWS)
    stored = _opened(spark, folder, rows.schema, [f"{V.PART}={part['name']}"])
    found = map_arrow(stored.where(F.col(text_column).isNotNull()).select(F.lower(text_column).alias("text"), *_place()), listed_grams,
                      "gram string, file string, blocks array<bigint>")
    # a file's list of a triple has one entry per block, even of one that was cut between tasks
    lists = found.groupBy("gram", "file").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks")).withColumn("bucket", _bucket(F.col("gram")))
    listed = V.write_part(lists.repartition("bucket").sortWithinPartitions("bucket", "gram"), folder, LISTS, ["bucket"])
    V.add(spark, folder, state, [part, listed], writer, batch)
    return True


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(file, blocks) that hold all character triples of ``query``, which has one at least."""
    wanted = grams_of(query)
    chosen = spark.createDataFrame([(g,) for g in wanted], "gram string").select(F.collect_set(_bucket(F.col("gram")))).first()[0]
    lists = V.scan(spark, folder, LISTS, LIST_SCHEMA).where(F.col("bucket").isin(chosen) & F.col("gram").isin(wanted))
    both = F.collect_list("blocks")  # one list per triple
    met = F.aggregate(F.slice(both, 2, len(wanted)), F.get(both, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.groupBy("file").agg(F.count("*").alias("n"), met.alias("blocks")).where((F.col("n") == len(wanted)) & (F.size("blocks") > 0)).select("file", "blocks")


def search(spark: SparkSession, folder: str, schema: StructType, query: str, text_column: str = "Review_Text") -> DataFrame:
    """The stored rows whose text holds ``query``, as ``functions.text.matches`` has it; null texts never do."""
    wanted = query.strip().lower()
    everything = V.scan(spark, folder, ROWS, schema)
    verified = tx.matches(F.col(text_column), query)
    if len(wanted) < 3:
        return everything.where(verified)
    found = candidates(spark, folder, wanted).limit(FILES + 1).collect()  # names of files, FILES of them at most
    if len(found) > FILES:
        return everything.where(verified)
    if not found:
        return spark.createDataFrame([], schema)
    blocks = F.broadcast(spark.createDataFrame([(r["file"], r["blocks"]) for r in found], "_file string, _blocks array<bigint>"))
    placed = _opened(spark, folder, schema, [r["file"] for r in found]).select("*", *_place())
    near = placed.join(blocks, F.col("file") == F.col("_file")).where(F.array_contains("_blocks", F.col("block")) & verified)
    return near.select(*schema.fieldNames())
