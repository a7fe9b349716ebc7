"""References to records that do not exist.

Record keys are cut into fixed ranges of ids per type. The records of a range are kept as
sorted arrays, one row per range; references travel to their range and are probed there
batch by batch with a binary search. A range that draws far more references than the others
(a popular target) is split into salted cells, each with its own copy of the range's array,
so no task ever holds more than one array and one Arrow batch.

Defined results
---------------
* A null id is an unresolved link, not a reference: no row. 0 and negative ids are ids.
* Types compare without regard to case and surrounding blanks; a null or unknown type has no
  records, so each such reference is ``missing`` (or ``deleted`` if the log has it).
* A record counts from its earliest load time; records without any load time are never late,
  nor are references without a creation time.
* Repeated references give one row, repeated records count once, empty tables are allowed.
* Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import width

#: Ids per range: bounds the array of a range, whatever the table's size.
RANGE_WIDTH = 1 << 14
#: References a cell should hold at most, before a range is salted.
CELL_ROWS = 200_000
#: No more than this many ranges can exceed 1/HOT_RANGES of all references: the bound of the broadcast.
HOT_RANGES = 2048

NO_TYPE = "\x00"


@dataclass(frozen=True)
class Reference:
    """One referring column: where it stands and which columns make up the key."""

    table: str
    df: DataFrame
    id_col: str
    type_col: str
    key_col: str
    field: str
    created_col: str = "created_at"


def type_key(column) -> F.Column:
    return F.coalesce(F.lower(F.trim(F.col(column) if isinstance(column, str) else column)), F.lit(NO_TYPE))


def records(parts: list[tuple[DataFrame, str | None, str, str | None, str | None]]) -> DataFrame:
    """Stack record tables as (type, id, loaded): each part is (df, fixed type, id, type column, load column)."""
    out = None
    for df, fixed, key, type_col, loaded in parts:
        one = df.select(
            (F.lit(fixed) if fixed else type_key(type_col)).alias("type"),
            F.col(key).cast("long").alias("id"),
            (F.unix_micros(F.col(loaded).cast("timestamp")) if loaded else F.lit(None).cast("long")).alias("loaded"),
        ).where(F.col("id").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def _range(column: str = "id"):
    return F.shiftright(column, RANGE_WIDTH.bit_length() - 1)


def _stack(references: list[Reference]) -> DataFrame:
    """All references as rows; columns of one table come from a single scan of it."""
    by_table: dict[int, list[Reference]] = {}
    for r in references:
        by_table.setdefault(id(r.df), []).append(r)
    out = None
    for group in by_table.values():
        each = [
            F.struct(
                F.lit(r.table).alias("ref_table"), F.col(r.id_col).cast("long").alias("ref_id"), F.lit(r.field).alias("ref_field"),
                type_key(r.type_col).alias("type"), F.col(r.key_col).cast("long").alias("id"), F.col(r.created_col).cast("timestamp").alias("created_at"),
            )
            for r in group
        ]
        one = group[0].df.select(F.inline(F.array(*each))).where(F.col("id").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rng", _range())


#: States a probe returns.
PRESENT, MISSING, DELETED, LATE = 0, 1, 2, 3
STATES = {MISSING: "missing", DELETED: "deleted", LATE: "late"}


def probe(keys: np.ndarray, loaded: np.ndarray, removed: np.ndarray, live: np.ndarray, ids: np.ndarray, created: np.ndarray) -> np.ndarray:
    """States of ``ids`` against the sorted ``keys`` of their range, by binary search.

    ``live`` marks keys with a record, ``removed`` keys in the removal log; times are in
    microseconds, the lowest value standing for "unknown" of a record and the highest for
    "unknown" of a reference.
    """
    if not len(keys):
        return np.full(len(ids), MISSING, dtype=np.int8)
    at = np.searchsorted(keys, ids)
    at[at == len(keys)] = 0
    hit = keys[at] == ids
    state = np.full(len(ids), MISSING, dtype=np.int8)
    state[hit & removed[at]] = DELETED
    here = hit & live[at]
    state[here] = PRESENT
    state[here & (loaded[at] > created)] = LATE
    return state


_OUT = pa.schema([("ref_table", pa.string()), ("ref_id", pa.int64()), ("ref_field", pa.string()), ("state", pa.string()), ("month", pa.string())])
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _probe_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive ordered by cell, the cell's array first: keep one array, probe what follows."""
    current, empty = None, np.zeros(0, dtype=np.int64)
    none = (empty, empty, empty.astype(bool), empty.astype(bool))
    arrays = none
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        kinds = batch.column("type").dictionary_encode()
        codes = kinds.indices.to_numpy(zero_copy_only=False)
        rng = batch.column("rng").to_numpy(zero_copy_only=False)
        salt = batch.column("salt").to_numpy(zero_copy_only=False)
        is_array = batch.column("kind").to_numpy(zero_copy_only=False) == 0
        ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
        created = batch.column("created").fill_null(_HIGH).to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(codes) != 0) | (np.diff(rng) != 0) | (np.diff(salt) != 0)) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [n]])
        states = np.zeros(n, dtype=np.int8)
        for a, b in zip(starts.tolist(), ends.tolist()):
            cell = (kinds.dictionary[int(codes[a])].as_py(), int(rng[a]), int(salt[a]))
            if cell != current:
                current, arrays = cell, none
            while a < b and is_array[a]:
                part = batch.column("keys")[a].values
                keys = part.field("id").to_numpy(zero_copy_only=False)
                arrays = (keys, part.field("loaded").fill_null(_LOW).to_numpy(zero_copy_only=False), part.field("removed").to_numpy(zero_copy_only=False), part.field("live").to_numpy(zero_copy_only=False))
                a += 1
            if a < b:
                states[a:b] = probe(*arrays, ids[a:b], created[a:b])
        keep = np.flatnonzero(states)
        if len(keep):
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ref_table").take(take), batch.column("ref_id").take(take), batch.column("ref_field").take(take), pa.array([STATES[s] for s in states[keep].tolist()]), batch.column("month").take(take)],
                schema=_OUT,
            )


def orphan_references(references: list[Reference], present: DataFrame, removed: DataFrame) -> DataFrame:
    """References without a record: (ref_table, ref_id, ref_field, state, month).

    ``present`` holds (type, id, loaded in microseconds), ``removed`` (type, id) of the
    removal log; build both with :func:`records`.
    """
    refs = _stack(references)
    spark = refs.sparkSession
    known = present.select("type", "id", "loaded", F.lit(True).alias("live"), F.lit(False).alias("removed")).unionByName(
        removed.select("type", "id", F.lit(None).cast("long").alias("loaded"), F.lit(False).alias("live"), F.lit(True).alias("removed"))
    )
    keys = known.groupBy("type", "id").agg(F.min("loaded").alias("loaded"), F.max("live").alias("live"), F.max("removed").alias("removed"))
    arrays = (
        keys.withColumn("rng", _range())
        .groupBy("type", "rng")
        .agg(F.sort_array(F.collect_list(F.struct("id", "loaded", "live", "removed"))).alias("keys"))
    )

    # Popular ranges: counted over all references, at most HOT_RANGES rows by construction.
    counts = refs.groupBy("type", "rng").agg(F.count(F.lit(1)).alias("n"))
    bound = max(CELL_ROWS, sum(r.df.count() for r in references) // HOT_RANGES)
    hot = [(r["type"], r["rng"], -(-r["n"] // bound)) for r in counts.where(F.col("n") > bound).collect()]
    hot_df = spark.createDataFrame(hot, "type string, rng long, cells int")
    if hot:
        hot_df = F.broadcast(hot_df)  # at most HOT_RANGES rows, see bound
        refs = refs.join(hot_df, ["type", "rng"], "left").withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_id", "ref_field"), F.coalesce("cells", F.lit(1))).cast("int")).drop("cells")
        arrays = arrays.join(hot_df, ["type", "rng"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))).drop("cells")
    else:
        refs, arrays = refs.withColumn("salt", F.lit(0)), arrays.withColumn("salt", F.lit(0))

    stacked = refs.select(
        "type", "rng", "salt", F.lit(1).alias("kind"), "ref_table", "ref_id", "ref_field", "id",
        F.unix_micros("created_at").alias("created"), F.date_format("created_at", "yyyy-MM").alias("month"),
        F.lit(None).cast("array<struct<id:bigint,loaded:bigint,live:boolean,removed:boolean>>").alias("keys"),
    ).unionByName(arrays.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    cells = stacked.repartition(width(spark), "type", "rng", "salt").sortWithinPartitions("type", "rng", "salt", "kind")
    return cells.mapInArrow(_probe_cells, "ref_table string, ref_id long, ref_field string, state string, month string").dropDuplicates(["ref_table", "ref_id", "ref_field", "state"])


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Number of orphan references per table, field, state and month of creation."""
    return found.groupBy("ref_table", "ref_field", "state", "month").agg(F.count(F.lit(1)).alias("orphans"))
