"""Standardising, reduction, clustering and classification of feature vectors.

UMAP and HDBSCAN have no counterpart here. Principal components and bisecting k-means stand in for them, are named as what they are, and give other results.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import keep, shared_folder
from ..sources.files import opened, written_groups


def standardise(df: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """Columns less their mean over their population deviation; a column without spread becomes 0. Rows with a null or NaN go."""
    df = df.withColumns({n: F.when(~F.isnan(n), F.col(n).cast("double")) for n in names}).dropna(subset=names)
    stats = df.groupBy(*by).agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = df.join(F.broadcast(stats), by) if by else df.join(F.broadcast(stats))
    return both.select(*[c for c in df.columns if c not in names], *[F.when(F.col(f"_s_{n}") > 0, (F.col(n) - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).otherwise(0.0).alias(n) for n in names])


def standardise_array(df: DataFrame, column: str) -> DataFrame:
    """An array column's components less their mean over their population deviation; one without spread becomes 0. Rows with another number of components than most, a null or NaN go."""
    d = df.withColumn("_x", F.col(column).cast("array<double>")).where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    n = d.groupBy(F.size("_x").alias("n")).count().agg(F.max_by("n", F.struct("count", "n"))).first()[0]
    d = d.where(F.size("_x") == (n or 0))
    # a row for each component, a single one in all
    parts = d.select(F.posexplode("_x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = parts.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_s"))
    z = F.transform("_x", lambda v, i: F.when(F.get("_s", i)["s"] > 0, (v - F.get("_s", i)["m"]) / F.get("_s", i)["s"]).otherwise(0.0))
    return d.join(F.broadcast(stats)).withColumn(column, z).drop("_x", "_s")


def principal_components(df: DataFrame, column: str, k: int = 2) -> DataFrame:
    """With pc array<double>, from an array column. The stand-in for UMAP."""
    v = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_pc").fit(v).transform(v).withColumn("pc", vector_to_array("_pc")).drop("_v", "_pc")


def cluster(df: DataFrame, column: str, k: int, seed: int = 42, least: int = 1) -> DataFrame:
    """With cluster int, -1 for clusters smaller than least. The stand-in for HDBSCAN."""
    v = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    out = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(v).transform(v)
    small = out.groupBy("_c").agg(F.count("*").alias("_n"))
    return out.join(F.broadcast(small), "_c").withColumn("cluster", F.when(F.col("_n") >= least, F.col("_c")).otherwise(-1)).drop("_v", "_c", "_n")


def stability(df: DataFrame, column: str, k: int, seeds: tuple[int, ...] = (0, 1, 2, 3, 42), least: int = 1) -> DataFrame:
    """(seed, n_clusters, noise_frac) of as many fits."""
    out = None
    for seed in seeds:
        one = cluster(df, column, k, seed, least).agg(F.lit(seed).alias("seed"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.avg((F.col("cluster") < 0).cast("int")).alias("noise_frac"))
        out = one if out is None else out.unionByName(one)
    return out


#: Rows of a file of vectors, and rows that meet them at a time.
FILE_ROWS, MEET = 8192, 256


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; of those so near that products cancel by differences."""
    a, b = (p * p).sum(axis=1)[:, None], (q * q).sum(axis=1)
    d = a + b - 2 * (p @ q.T)
    i, j = np.nonzero(d <= 1e-4 * (a + b))
    for at in range(0, len(i), 4096):
        x, y = i[at : at + 4096], j[at : at + 4096]
        d[x, y] = ((p[x] - q[y]) ** 2).sum(axis=1)
    return np.sqrt(d)


def silhouette(df: DataFrame, column: str, label: str, key: str, block: int = FILE_ROWS) -> DataFrame:
    """(key, silhouette) by exact Euclidean distances: rows are written once, in files of one label each, and each task's rows meet file after file.

    That is the definition's cost, the square of the rows; no pair and no copy of a row is shuffled, and a task holds one file and a few of its own rows.
    """
    spark = df.sparkSession
    rows = keep(df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("l"), F.col(column).cast("array<double>").alias("v")))
    n = rows.groupBy(F.col("l").alias("m")).agg(F.ceil(F.count("*") / block).alias("n"))
    salted = rows.join(n, F.col("l").eqNullSafe(F.col("m"))).select("l", "v", F.pmod(F.xxhash64("k"), "n").alias("s"))
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"

    def vectors(column) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def make(key: tuple, own: pa.Table) -> tuple[str, bytes]:
        out = io.BytesIO()
        np.save(out, vectors(own["v"]))
        # the label's bytes name the file
        return f"{'n' if key[0] is None else 'l' + key[0].encode().hex()}/{key[1]}.npy", out.getvalue()

    names = written_groups(salted, ["l", "s"], make, folder)
    labels = {m: None if m == "n" else bytes.fromhex(m[1:]).decode() for m in dict.fromkeys(x.split("/")[0] for x in names)}
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def sums(batches):
        for b in batches:
            p = vectors(b.column(2))
            total, count = {m: np.zeros(len(p)) for m in labels}, dict.fromkeys(labels, 0)
            for name in names if len(p) else ():
                with opened(f"{uri}/{name}") as f:
                    q = np.load(io.BytesIO(f.read()))
                m = name.split("/")[0]
                count[m] += len(q)
                for at in range(0, len(p), MEET):
                    total[m][at : at + MEET] += _distances(p[at : at + MEET], q).sum(axis=1)
            for m, l in labels.items() if len(p) else ():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([l] * len(p), pa.string()), pa.array(total[m]), pa.array([count[m]] * len(p), pa.int64())], names=["k", "own", "l", "d", "n"])

    # a batch is read beside all files: rows are dealt so that each task has work, and go in large batches
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = rows.select("k", "l", "v").repartition(tasks, "k").mapInArrow(sums, "k long, own string, l string, d double, n long")
    inner = F.max(F.when(F.col("l") == F.col("own"), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))))
    g = s.groupBy("k").agg(inner.alias("a"), F.min(F.when(F.col("l") != F.col("own"), F.col("d") / F.col("n"))).alias("b"))
    return g.select(F.col("k").alias(key), F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def split(df: DataFrame, key: str, shares: tuple[int, int] = (70, 15)) -> DataFrame:
    """With part: train, validation or test, by a hash of the key; not stratified."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(h < shares[0], "train").when(h < sum(shares), "validation").otherwise("test"))


def classify(train: DataFrame, test: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (16,), seed: int = 42) -> DataFrame:
    """test with prediction and confidence, by a small network on features: the stand-in for the hybrid classifier."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer

    put = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    net = MultilayerPerceptronClassifier(layers=[len(features), *hidden, max(2, len(index.labels))], featuresCol="_x", labelCol="_y", seed=seed, maxIter=60).fit(index.transform(put.transform(train)))
    out = net.transform(put.transform(test))
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(index.labels)).transform(out)
    return names.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("_x", "rawPrediction", "probability", "prediction")
