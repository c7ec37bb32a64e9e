"""Readers of edge lists, vectors, walks, ratings and run records, and their writers.

All take a path or a DataFrame of lines (``value``), with schemas stated; ids stay strings until they are
numbered with ``number_nodes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgesmith.functions.lineage import row_numbers
from edgesmith.operators.graph import canonical

STATISTICS = "recall DOUBLE, precision DOUBLE, scan_rate DOUBLE, scans_per_found_edge DOUBLE, num_found_edges LONG, num_predicted_edges LONG, num_scanned_w_LP LONG, time DOUBLE"
RUN = f"date STRING, method STRING, dataset STRING, h INT, statistics STRUCT<{STATISTICS.replace(' DOUBLE', ': DOUBLE').replace(' LONG', ': LONG')}>, parameters MAP<STRING, STRING>"


def _lines(spark: SparkSession, source: str | DataFrame, comment: str = "#") -> DataFrame:
    lines = spark.read.text(source) if isinstance(source, str) else source
    return lines.select(F.trim("value").alias("value")).where(~F.col("value").startswith(comment) & (F.col("value") != ""))


def _fields(lines: DataFrame, separator: str = r"\s+") -> DataFrame:
    return lines.select(F.split("value", separator).alias("f"))


def edges(spark: SparkSession, source: str | DataFrame, separator: str = r"\s+", comment: str = "#", first: int = 0, second: int = 1) -> DataFrame:
    """Distinct canonical (u, v) from separated text; self loops go."""
    f = _fields(_lines(spark, source, comment), separator).where(F.size("f") > max(first, second))
    return canonical(f.select(F.col("f")[first].alias("u"), F.col("f")[second].alias("v")))


def two_sided_edges(spark: SparkSession, source: str | DataFrame, separator: str = r"\s+") -> DataFrame:
    """(src, dst, side_src, side_dst): the first column is side 0, the second side 1."""
    f = _fields(_lines(spark, source), separator).where(F.size("f") >= 2)
    return f.select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst")).distinct().withColumns({"side_src": F.lit(0), "side_dst": F.lit(1)})


def is_temporal(spark: SparkSession, source: str | DataFrame) -> bool | None:
    """Whether the first line has more than two fields; None for an empty file."""
    row = _fields(_lines(spark, source)).select(F.size("f").alias("n")).first()
    return None if row is None else row["n"] > 2


def temporal_edges(spark: SparkSession, source: str | DataFrame, separator: str = r"\s+", comment: str = "#", time: int = 2) -> DataFrame:
    """(rn, u, v, ts) with repeats, numbered by (ts, u, v): input of the file-order split."""
    f = _fields(_lines(spark, source, comment), separator).where(F.size("f") > time)
    rows = f.select(F.col("f")[0].alias("u"), F.col("f")[1].alias("v"), F.col("f")[time].cast("long").alias("ts")).where("u <> v")
    return row_numbers(rows, "ts", "u", "v").select("rn", "u", "v", "ts")


def quote_edges(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Tab separated u, v, ignored, time, with % comments."""
    return temporal_edges(spark, source, r"\t", "%", 3)


def weighted_edges(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    f = _fields(_lines(spark, source)).where(F.size("f") >= 3)
    return f.select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"), F.col("f")[2].cast("double").alias("weight"))


def split_arrays(arrays: DataFrame, both_ways: bool = False) -> DataFrame:
    """Canonical (split, u, v) from pre-split (split, src, dst) rows; with ``both_ways`` both orientations of each."""
    a = arrays.where("src <> dst").select("split", F.col("src").cast("string").alias("u"), F.col("dst").cast("string").alias("v"))
    if both_ways:
        return a.unionByName(a.select("split", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return a.select("split", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def split_folders(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "valid", "test"), source: str = "src", target: str = "dst", both_ways: bool = False) -> DataFrame:
    """(split, u, v) of a link-property set exported as one Parquet table a split, under any names of the two columns
    (``source_node`` and ``target_node`` with ``both_ways`` for citation sets)."""
    out = None
    for name in splits:
        part = spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("split"), F.col(f"`{source}`").alias("src"), F.col(f"`{target}`").alias("dst"))
        out = part if out is None else out.unionByName(part)
    return split_arrays(out, both_ways)


def csv_edges(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Canonical (u, v) of the first two columns of comma separated files, zipped (.gz) or not."""
    rows = spark.read.csv(path, header=header)
    u, v = (F.col(f"`{c}`").cast("string") for c in rows.columns[:2])
    return canonical(rows.select(F.trim(u).alias("u"), F.trim(v).alias("v")))


def train_and_test(spark: SparkSession, train: str | DataFrame, test: str | DataFrame, two_sided: bool = False) -> tuple[DataFrame, DataFrame]:
    """The edges of a pair of files; of two sides, as (src, dst, side_src, side_dst)."""
    read = two_sided_edges if two_sided else edges
    return read(spark, train), read(spark, test)


def from_matrix(spark: SparkSession, matrix) -> DataFrame:
    """Canonical (u, v) from an in-memory square matrix: a numpy array, or a sparse one that has ``tocoo``."""
    import numpy as np

    coo = matrix.tocoo() if hasattr(matrix, "tocoo") else None
    rows, columns = (coo.row, coo.col) if coo is not None else np.nonzero(np.asarray(matrix))
    return canonical(spark.createDataFrame([(int(a), int(b)) for a, b in zip(rows, columns, strict=True)], "u long, v long"))


def from_neighbours(spark: SparkSession, neighbours: dict) -> DataFrame:
    """Canonical (u, v) from an in-memory map of nodes to neighbours, or a graph object that has ``adjacency``."""
    pairs = neighbours.adjacency() if hasattr(neighbours, "adjacency") else neighbours.items()
    return canonical(spark.createDataFrame([(int(a), int(b)) for a, bs in pairs for b in bs], "u long, v long"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The vectors kept at ``path``, made and written first if there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def adjacency_lists(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Canonical (u, v) from lines ``v n1 n2 ...``."""
    f = _fields(_lines(spark, source)).where(F.size("f") > 1)
    pairs = f.select(F.col("f")[0].cast("long").alias("u"), F.explode(F.slice("f", 2, 1 << 30).cast("array<long>")).alias("v"))
    return canonical(pairs)


def clique(spark: SparkSession, size: int) -> DataFrame:
    """All pairs of 1..size: each row makes its own partners."""
    return spark.range(1, size).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(size).cast("long"))).alias("v"))


def vectors(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(id, vec) from ``node x1 ... xd`` lines; two-field lines (the header) are skipped."""
    f = _fields(_lines(spark, source)).where(F.size("f") > 2)
    return f.select(F.col("f")[0].alias("id"), F.slice("f", 2, 1 << 30).cast("array<double>").alias("vec"))


def walks(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(walk, pos, node): walks are told apart by their line's digest and text."""
    lines = _lines(spark, source).withColumn("walk", F.md5("value"))
    return lines.select("walk", F.posexplode(F.split("value", r"\s+")).alias("pos", "node"))


def ratings(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(user, item, rating), users as u-, items as i-."""
    f = _fields(_lines(spark, source), r"\t").where(F.size("f") >= 3)
    return f.select(F.concat(F.lit("u"), F.col("f")[0]).alias("user"), F.concat(F.lit("i"), F.col("f")[1]).alias("item"), F.col("f")[2].cast("double").alias("rating"))


def split_ratings(rows: DataFrame, share: float = 0.6, seed: int = 42) -> DataFrame:
    """Ratings with ``part``: of each user, the share drawn by digest is train."""
    from pyspark.sql import Window

    from edgesmith.functions.portable import digest

    w = Window.partitionBy("user")
    r = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(digest(seed, "user", "item"), "item")))
    return r.withColumn("part", F.when(F.col("_r") <= F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_n", "_r")


def runs(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Run records, one JSON object a line."""
    return _lines(spark, source).select(F.from_json("value", RUN).alias("r")).select("r.*")


def number_nodes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) with numbers from 0 in the order of the old ids, and the map (old_id, id)."""
    names = row_numbers(pairs.select(F.explode(F.array("u", "v")).alias("old_id")).distinct(), "old_id").select("old_id", (F.col("rn") - 1).alias("id"))
    a, b = (names.select(F.col("old_id").alias(c), F.col("id").alias(f"_{c}")) for c in ("u", "v"))
    return canonical(pairs.join(a, "u").join(b, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))), names


# --- writers -----------------------------------------------------------------------------------


def write_pairs(pairs: DataFrame, path: str, separator: str = ",") -> None:
    """u and v a line, without a header."""
    pairs.select("u", "v").write.mode("overwrite").csv(path, sep=separator, header=False)


def run_lines(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct("date", "method", "dataset", "h", "statistics", "parameters")).alias("value"))


def write_runs(records: DataFrame, path: str) -> None:
    run_lines(records).write.mode("append").text(path)


def write_migrated(records: DataFrame, path: str) -> None:
    """Records by dataset, method and h, one file, and a closing comment line; runs() skips the comment."""
    lines = records.select(F.to_json(F.struct("date", "method", "dataset", "h", "statistics", "parameters")).alias("value"), F.lit(0).alias("last"), "dataset", "method", "h")
    end = records.sparkSession.range(1).select(F.lit("#").alias("value"), F.lit(1).alias("last"), F.lit(None).cast("string").alias("dataset"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("h"))
    lines.unionByName(end).orderBy("last", "dataset", "method", "h").select("value").coalesce(1).write.mode("append").text(path)


def write_figures(figures: dict[str, float], spark: SparkSession, path: str) -> None:
    """One file a figure (num, R, P, frac, time), with one number each, at path_NAME."""
    for name, value in figures.items():
        write_lines(spark.createDataFrame([(str(value),)], "value string"), f"{path}_{name}")


def homogeneous(rows: DataFrame) -> DataFrame:
    """(row, column, value) of a two-sided (src, dst, weight) with sides numbered from 0: the second side's numbers
    begin after the first's, and each edge stands in both directions."""
    offset = rows.agg((F.max("src") + 1).alias("n"))
    e = rows.join(F.broadcast(offset)).select(F.col("src").alias("row"), (F.col("dst") + F.col("n")).alias("column"), F.col("weight").alias("value"))
    return e.unionByName(e.select(F.col("column").alias("row"), F.col("row").alias("column"), "value"))


def feature_lines(rows: DataFrame) -> DataFrame:
    """(value): both vectors and the label of pair_feature_rows, tab separated."""
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "\t")
    return rows.select(F.concat_ws("\t", numbers("vec_u"), numbers("vec_v"), F.col("y").cast("string")).alias("value"))


def write_ratings(rows: DataFrame, path: str) -> None:
    """user, item and rating, tab separated, under their prefixed names."""
    rows.select("user", "item", "rating").write.mode("overwrite").csv(path, sep="\t", header=False)


def vector_lines(emb: DataFrame) -> DataFrame:
    """``node x1 ... xd`` lines, without a header."""
    return emb.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))


def walk_lines(rows: DataFrame) -> DataFrame:
    """One line a walk, from (walk, pos, node)."""
    got = rows.groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("node").cast("string").alias("node")))).alias("r"))
    return got.select(F.array_join(F.transform("r", lambda x: x["node"]), " ").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_temporal(rows: DataFrame, path: str) -> None:
    """u v time, by time as a number; part files follow each other in order."""
    rows.orderBy("ts", "u", "v").select("u", "v", "ts").write.mode("overwrite").csv(path, sep=" ", header=False)


def write_matrix(rows: DataFrame, path: str) -> None:
    """row, column and value of a sparse matrix, tab separated."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=False)


def pair_feature_rows(pairs: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """Both vectors and the label of (u, v, y); a missing vector is all zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)
    x, y = (emb.select(F.col("id").alias(c), F.col("vec").alias(f"vec_{c}")) for c in ("u", "v"))
    return pairs.join(x, "u", "left").join(y, "v", "left").select("u", "v", F.coalesce("vec_u", zero).alias("vec_u"), F.coalesce("vec_v", zero).alias("vec_v"), "y")
