"""The N best items of every group, read from group-clustered files with statistics-guided skipping.

Rows are first clustered: files hold ranges of groups, groups too large for one file
go to neighbouring ones, and each file is sorted by group and falling score in small row
groups, so that a large group fills row groups of its own. A reader knows from a row group's
statistics whether it holds one group only. Row groups where a group begins hold
its best items and are read; of a group's further row groups, in order of falling maximum score,
those strictly below its current N-th score are skipped. A group with fewer than N
items never blocks a skip of other groups' row groups.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import materialize, new_folder, remove_folder

#: Bytes of a clustered file at most, and row groups in a file: their sizes follow the input's.
FILE = 128 << 20
ROW_GROUPS = 64
LEAST_ROW_GROUP = 32 << 10


def layout(df: DataFrame) -> tuple[int, int]:
    """(files, bytes of a row group) for Spark's estimate of the size of ``df``; tables without one get the session's number of files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 55:  # no estimate
        return files, FILE // ROW_GROUPS
    files = max(files, -(-size // FILE))
    return files, max(LEAST_ROW_GROUP, size // files // ROW_GROUPS)


def cluster_by_group(df: DataFrame, group: str, score: str, rest: list[str], item: str, path: str, files: int, row_group: int) -> None:
    """Write ``df`` to ``path``, files clustered by group and sorted by group, falling score, ``rest`` and ``item``.

    Rows are range-partitioned by all but ``item``: a group of any size is split where it
    must be, and rows equal in all of these stay in one file, next to each other.
    """
    by: list[Column | str] = [F.col(group), F.col(score).desc(), *rest]
    rows = df.repartitionByRange(files, *by).sortWithinPartitions(*by, item)
    pages = min(row_group, 64 << 10)
    rows.write.option("parquet.block.size", row_group).option("parquet.page.size", pages).option("parquet.block.size.row.check.min", 50).parquet(path)


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """True where a row differs from the one before in any of the columns (none of which has nulls); the first is True."""
    out = np.zeros(rows.num_rows, dtype=bool)
    out[:1] = True
    if rows.num_rows > 1:
        for c in columns:
            col = rows.column(c).combine_chunks()
            out[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return out


def _best(rows: pa.Table, group: str, by: list[str], keys: list[str], item: str, n: int) -> pa.Table:
    """The ``n`` best distinct items of each group of rows in file order; of items equal in ``by`` those with the smallest ``item``."""
    new_group = _changes(rows, [group])
    new_tie = new_group | _changes(rows, by)
    rows = rows.append_column("_tie", pa.array(np.cumsum(new_tie)))
    distinct = new_tie | _changes(rows, keys)
    seen = np.cumsum(distinct)
    starts = np.flatnonzero(new_tie)
    before = seen[starts] - 1  # distinct items ahead of each tie
    first = before[np.searchsorted(starts, np.flatnonzero(new_group))]
    of_group = np.cumsum(new_group[starts]) - 1
    may = (before - first[of_group] < n)[np.cumsum(new_tie) - 1] & distinct
    rows = rows.filter(pa.array(may))
    ties = rows.column("_tie").to_numpy()
    if len(ties) and (ties[1:] == ties[:-1]).any():  # items alike in the order: the smallest come first
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("_tie", "ascending"), (item, "ascending")]))
    at = np.flatnonzero(_changes(rows, [group]))
    place = np.arange(rows.num_rows) - np.repeat(at, np.diff(np.append(at, rows.num_rows)))
    return rows.filter(pa.array(place < n)).drop_columns(["_tie"])


def read_top(path: str, group: str, score: str, by: list[str], keys: list[str], item: str, n: int) -> tuple[pa.Table | None, int, int]:
    """The best ``n`` distinct items of each group of one clustered file; row groups read, and all."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(inner) as source:
        file = pq.ParquetFile(source)
        meta = file.metadata
        at, named = (file.schema_arrow.get_field_index(c) for c in (score, group))
        begins, top, own = [], {}, defaultdict(list)
        last = None
        for g in range(meta.num_row_groups):
            names, scores = (meta.row_group(g).column(c).statistics for c in (named, at))
            known = names is not None and names.has_min_max and names.min == names.max
            top[g] = scores.max if scores is not None and scores.has_min_max else np.inf
            if known and names.min == last:
                own[last].append(g)
            else:  # a group begins here, or may
                begins.append(g)
            last = names.max if names is not None and names.has_min_max else None
        read = {}
        whole = file.read_row_groups(begins, use_threads=False) if begins else None
        row = 0
        for g in begins:
            read[g] = whole.slice(row, meta.row_group(g).num_rows)
            row += meta.row_group(g).num_rows
        for name, parts in own.items():
            before = read[max(g for g in begins if g < parts[0])]
            rows = before.filter(pc.equal(before.column(group), pa.scalar(name, before.schema.field(group).type)))
            for g in sorted(parts, key=lambda g: -top[g]):
                best = _best(rows, group, by, keys, item, n)
                if best.num_rows >= n and top[g] < best.column(score)[n - 1].as_py():
                    break  # and all behind it
                read[g] = file.read_row_group(g, use_threads=False)
                rows = pa.concat_tables([rows, read[g]])
        if not read:
            return None, 0, meta.num_row_groups
        rows = pa.concat_tables([read[g] for g in sorted(read)])
        return _best(rows, group, by, keys, item, n), len(read), meta.num_row_groups


def top_items(
    df: DataFrame,
    group: str,
    score: str,
    item: str,
    alike: list[str],
    order: list[tuple[str, bool]],
    n: int,
    into: str = "item_rank",
    files: int | None = None,
    row_group: int | None = None,
    watch: dict | None = None,
) -> DataFrame:
    """(group, rank, item) for the ``n`` best distinct items of every group.

    Items are rows with a group and a score that is neither null nor NaN; rows equal in
    group, score and ``alike`` (null equals null) are one item with the smallest ``item``.
    Order: score falling, then ``order`` as (column, ascending) with nulls last, then
    ``item`` ascending, so ties never depend on where rows lie. A group with fewer
    items gives them all. An empty table gives an empty result. Other columns are ignored.
    ``files`` and ``row_group`` (bytes) follow the input's size if not given; ``watch`` gets
    the numbers of row groups read and of all.
    """
    spark: SparkSession = df.sparkSession
    names = list(dict.fromkeys([*alike, *(c for c, _ in order)]))
    kinds = dict(df.dtypes)
    ordered = {c for c, _ in order}
    cols, keys = [], []
    for i, c in enumerate(names):
        floating = kinds[c] in ("double", "float")
        if c in ordered:  # null and NaN have a place in the order: a flag before the value
            missing = F.when(F.col(c).isNull(), 2).when(F.isnan(c), 1).otherwise(0) if floating else F.when(F.col(c).isNull(), 1).otherwise(0)
            blank = F.lit(0.0) if floating else F.lit("") if kinds[c] == "string" else F.lit(0)
            cols += [missing.cast("tinyint").alias(f"_m{i}"), F.when(missing == 0, F.col(c)).otherwise(blank.cast(kinds[c])).alias(f"_c{i}")]
            keys += [f"_m{i}", f"_c{i}"]
        else:
            cols += [F.col(c).isNull().alias(f"_m{i}"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_c{i}")]
            keys += [f"_m{i}", f"_c{i}"]
    by, ascending = ["_score"], [False]
    for c, up in order:
        i = names.index(c)
        by += [f"_m{i}", f"_c{i}"]
        ascending += [True, up]
    ok = F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    rows = df.where(ok).select(F.col(group).alias("_group"), F.col(score).cast("double").alias("_score"), *cols, F.col(item).alias("_item"))
    known = layout(rows)
    path = new_folder(spark, "clustered")
    sort_keys = list(dict.fromkeys([*by[1:], *keys]))
    cluster_by_group(rows, "_group", "_score", sort_keys, "_item", path, files or known[0], row_group or known[1])

    schema = T.StructType([*rows.schema.fields])
    columns = rows.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    sc = spark.sparkContext
    counted = sc.accumulator(0), sc.accumulator(0)
    noted = watch is not None

    def read(batches):
        for batch in batches:
            for file in batch.column("path").to_pylist():
                best, full, of = read_top(file, "_group", "_score", by, sort_keys, "_item", n)
                if noted:
                    counted[0].add(full)
                    counted[1].add(of)
                if best is not None:
                    yield from best.select(columns).cast(arrow).combine_chunks().to_batches()

    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jpath)
    files = [f.getPath().toString() for f in listed if f.getPath().getName().startswith("part-")]
    if files:
        todo = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files), "path")
        parts = todo.mapInArrow(read, schema)
    else:
        parts = spark.createDataFrame([], schema)
    last = W.partitionBy("_group").orderBy(*(F.col(b).asc() if up else F.col(b).desc() for b, up in zip(by, ascending, strict=True)), "_item")
    ranked = parts.withColumn(into, F.row_number().over(last)).where(F.col(into) <= n)
    out = materialize(ranked.select(F.col("_group").alias(group), into, F.col("_item").alias(item)))
    remove_folder(spark, path)
    if watch is not None:
        watch.update(read=counted[0].value, all=counted[1].value)
    return out
