"""An inverted-file index of vectors: each vector lies in the list of its nearest centroid, and a search reads some lists."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import similarity as S
from verdigris.operators import nearest as N
from verdigris.operators.retrieval import top_k, vector_scores
from verdigris.sources.shared import new_folder

#: Angles are compared with so much room for rounding.
_ROOM = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """``entries``: table (list, part, id, vector, norm), bucketed by list and part. ``lists``: one row a list: list,
    centroid, n, parts, radius (the largest angle between the centroid and a vector of the list)."""

    spark: SparkSession
    table: str
    lists: DataFrame
    buckets: int

    @property
    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def build(items: DataFrame, lists: int | None = None, sample: int = 50_000, part_rows: int = 100_000, iterations: int = 10, seed: int = 7) -> VectorIndex:
    """items: (id, vector). The centroids are fitted by cosine k-means on ``sample`` vectors at most, those with the smallest
    hash of their id; every vector is then assigned. ``lists``: how many, by default about the square root of the number of
    items, up to 4096. A list of more than ``part_rows`` vectors is dealt out in parts, so that copies of one vector don't
    meet in one task.

    Null vectors, vectors without length, with a null element, or of another length than most aren't in the index. The
    tables lie in the shared folder; ``drop`` takes the entries out of the catalogue."""
    spark = items.sparkSession
    size = F.size("vector")
    known = items.where("vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)").select("id", F.col("vector").cast("array<double>").alias("vector")).withColumn("norm", S.norm(F.col("vector"))).where("norm > 0")
    facts = known.agg(F.mode(size).alias("size"), F.count("*").alias("n")).first()
    known = known.where(size == F.lit(facts["size"]))
    n = lists or max(1, min(4096, round(facts["n"] ** 0.5)))
    learnt = known.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("vector").alias("features"))
    if facts["n"]:
        model = KMeans(k=n, maxIter=iterations, seed=seed, distanceMeasure="cosine", initSteps=2).fit(learnt)
        centroids = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        assigned = model.transform(known.withColumn("features", array_to_vector("vector"))).select(F.col("prediction").alias("list"), "id", "vector", "norm")
    else:
        centroids, assigned = [], known.select(F.lit(0).alias("list"), "id", "vector", "norm")
    shape = spark.createDataFrame(centroids, "list int, centroid array<double>")  # at most ``lists`` rows
    folder = new_folder(spark, "vector-index")
    assigned.write.parquet(f"{folder}/assigned")
    assigned = spark.read.parquet(f"{folder}/assigned")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), S.cosine(F.col("vector"), F.col("centroid")))))
    about = assigned.join(F.broadcast(shape), "list").groupBy("list").agg(F.count("*").alias("n"), F.max(angle).alias("radius"))
    about = shape.join(about, "list").withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    about.write.parquet(f"{folder}/lists")
    described = spark.read.parquet(f"{folder}/lists")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = assigned.join(F.broadcast(described.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    name = f"vector_index_{uuid.uuid4().hex}"
    writer = dealt.select("list", "part", "id", "vector", "norm").repartition(buckets, "list", "part").write
    writer.bucketBy(buckets, "list", "part").sortBy("list").option("path", f"{folder}/entries").saveAsTable(name)
    return VectorIndex(spark, name, described, buckets)


def _angles(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(qid, list, angle, parts, radius) of every query with every centroid, of which there are few."""
    near = vector_scores(queries.select("qid", "vector"), index.lists.select(F.col("list").alias("id"), F.col("centroid").alias("vector")))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))
    return near.join(F.broadcast(index.lists.select(F.col("list").alias("id"), "parts", "radius")), "id").select("qid", F.col("id").alias("list"), angle.alias("angle"), "parts", "radius")


def _read(index: VectorIndex, queries: DataFrame, wanted: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(qid, id, score) of the vectors in the lists that each query wants, or those that ``k`` and ``least`` leave: one scan.
    Lists and their parts are dealt over cells; a query comes once to each cell that has a list of its own."""
    rows = index.lists.agg(F.sum("n")).first()[0] or 0
    cells = max(1, -(-rows // 16_384), min(-(-rows // 4096), 2 * index.spark.sparkContext.defaultParallelism))
    cell = F.pmod(F.xxhash64("list", "part"), F.lit(cells)).cast("int").alias("cell")
    asked = wanted.select("qid", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = asked.select("qid", "list", cell).groupBy("qid", "cell").agg(F.collect_set("list").alias("lists"))
    asked = asked.join(queries.select("qid", F.col("vector").cast("array<double>").alias("vector")), "qid")
    return N.scored(asked, index.entries.select("id", "vector", "list", cell), k, least)


def _reaches(least: Column) -> Column:
    """Whether a list may hold a vector of the score ``least`` or more."""
    return F.col("angle") - F.col("radius") <= F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least))) + _ROOM


def _asking(queries: DataFrame) -> DataFrame:
    return queries.select("qid", "vector").where("vector IS NOT NULL").where(S.norm(F.col("vector")) > 0)


def within(index: VectorIndex, queries: DataFrame, least: float, k: int | None = None) -> DataFrame:
    """(qid, id, score) of all vectors with a cosine of ``least`` or more, or of the ``k`` best of them. queries: (qid, vector), qid unique. Exact: only
    lists that can't reach the score aren't read. Null queries and those without length find nothing."""
    asking = _asking(queries)
    wanted = _angles(index, asking).where(_reaches(F.lit(least)))
    found = _read(index, asking, wanted, k, least)
    return found if k is None else top_k(found, "qid", "score", "id", k).drop("rank")


def nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
    """(qid, id, score, rank) of the k nearest vectors in the ``probes`` nearest lists of each query, ties by id. ``exact``:
    then also the lists that may hold a vector nearer than the k-th found so far (all others, where fewer were found)."""
    asking = _asking(queries)
    angles = _angles(index, asking).withColumn("close", -F.col("angle"))
    placed = top_k(angles, "qid", "close", "list", 1 << 30)
    first = top_k(_read(index, asking, placed.where(F.col("rank") <= probes), k), "qid", "score", "id", k)
    if not exact:
        return first
    folder = new_folder(index.spark, "nearest")
    first.drop("rank").write.parquet(folder)
    first = index.spark.read.parquet(folder)
    bound = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("least"))
    more = placed.where(F.col("rank") > probes).join(bound, "qid", "left").where(_reaches(F.coalesce("least", F.lit(-1.0))))
    return top_k(first.unionByName(_read(index, asking, more, k)), "qid", "score", "id", k)
