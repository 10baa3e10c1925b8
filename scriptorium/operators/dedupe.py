"""Exact copies, weak name hints, and the duplicate report over a document table.

Documents have: doc_id, source_path, filename, size, content_hash, text_hash (null for none), extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..storage import written
from .graph import components


def with_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content_hash and text_hash of a text table."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), T.collapsed(F.col(text)).alias("plain"))
    return plain.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.when(F.col("plain") != "", F.sha2("plain", 256)).alias("text_hash"))


def clusters(docs: DataFrame, keys: list[str], order: str = "doc_id") -> DataFrame:
    """doc_id, representative, members for documents that share a value of any key with another, links taken transitively.

    representative: the document of the cluster that is least by `order` (ties by doc_id).  Each key's values are tied to
    their least document, a star a value, so links are linear in the documents.
    """
    stars = None
    for k in keys:
        least = docs.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        star = docs.select("doc_id", k).join(least, k).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
        stars = star if stars is None else stars.union(star)
    labels = components(stars)
    marked = labels.withColumnRenamed("node", "doc_id").join(docs.select("doc_id", F.col(order).alias("__order")), "doc_id")
    heads = marked.groupBy("label").agg(F.min(F.struct("__order", "doc_id"))["doc_id"].alias("representative"), F.count("*").alias("members"))
    return marked.join(heads, "label").select("doc_id", "representative", "members")


def exact_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clusters of a text table by equal bytes or by equal text hash; texts are read once."""
    return clusters(written(with_hashes(docs, key, text), "hashes"), ["content_hash", "text_hash"])


def weak_hints(docs: DataFrame, members: DataFrame | None = None, most: int = 10) -> DataFrame:
    """doc_id and hints: source paths of documents with the same name key that aren't its exact copies, sorted, `most` at most.

    docs: doc_id, source_path, filename.  members: doc_id and representative of exact copies.  Names carried by a great many
    documents are not paired: each document takes from the first paths of its name only, as many as can be needed.
    """
    named = docs.select("doc_id", "source_path", T.hint_key(F.col("filename")).alias("name")).where("name <> ''")
    if members is not None:
        named = named.join(members.select("doc_id", "representative"), "doc_id", "left").withColumn("cluster", F.coalesce("representative", "doc_id")).drop("representative")
    else:
        named = named.withColumn("cluster", F.col("doc_id"))
    # Of one cluster `most` paths are enough, and of one name the first paths of its first most + 1 clusters.
    ranked = named.withColumn("in_cluster", F.row_number().over(W.Window.partitionBy("name", "cluster").orderBy("source_path"))).where(F.col("in_cluster") <= most)
    heads = ranked.groupBy("name", "cluster").agg(F.min("source_path").alias("head"))
    chosen = heads.withColumn("nth", F.row_number().over(W.Window.partitionBy("name").orderBy("head", "cluster"))).where(F.col("nth") <= most + 1).select("name", "cluster")
    offered = ranked.join(chosen, ["name", "cluster"]).select("name", F.col("cluster").alias("other"), F.col("source_path").alias("path"))
    paired = named.join(offered, "name").where("cluster <> other")
    return paired.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("path")), 1, most).alias("hints"))


#: The five groupings of the report and what each one groups by.
GROUPINGS = {
    "content_hash": "content_hash",
    "text_hash": "text_hash",
    "normalized_filename": "name_key",
    "normalized_filename_size": "name_size",
    "size": "size_text",
}


def _grouped(docs: DataFrame) -> DataFrame:
    """A row for each document and grouping that it has a value for: grouping, key."""
    named = docs.withColumn("name_key", T.name_key(F.col("filename"))).withColumn("size_text", F.col("size").cast("string"))
    named = named.withColumn("name_size", F.when(F.col("name_key") != "", F.concat_ws("|", "name_key", "size_text")))
    pairs = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(c).alias("key")) for g, c in GROUPINGS.items()])
    return named.select("doc_id", "source_path", "extension", "text_hash", F.explode(pairs).alias("g")).select("doc_id", "source_path", "extension", "text_hash", "g.grouping", "g.key").where("key is not null and key <> ''")


def report(docs: DataFrame) -> DataFrame:
    """grouping, cluster_count, file_count over clusters of two documents and more."""
    sizes = _grouped(docs).groupBy("grouping", "key").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.groupBy("grouping").agg(F.count("*").alias("cluster_count"), F.sum("n").alias("file_count"))


def _best(sizes: DataFrame, each: int) -> DataFrame:
    """grouping, rank, key of the `each` largest clusters of each grouping, ties by key; ranked in parts first, so that no task
    gets all the clusters of a grouping."""
    largest = lambda *by: W.Window.partitionBy(*by).orderBy(F.desc("n"), "key")
    part = F.pmod(F.xxhash64("key"), F.lit(1024))
    few = sizes.withColumn("part", part).withColumn("rank", F.row_number().over(largest("grouping", "part"))).where(F.col("rank") <= each).drop("part", "rank")
    return few.withColumn("rank", F.row_number().over(largest("grouping"))).where(F.col("rank") <= each).select("grouping", "rank", "key")


def samples(docs: DataFrame, each: int = 5) -> DataFrame:
    """grouping, rank, key, paths: the largest clusters of each grouping, ties by key, with the paths of their members.

    A sample lists all members of its cluster, so a row is as long as the largest cluster's list of paths.
    """
    rows = _grouped(docs)
    best = _best(rows.groupBy("grouping", "key").agg(F.count("*").alias("n")).where("n > 1"), each)
    return rows.join(best, ["grouping", "key"]).groupBy("grouping", F.col("rank").cast("long").alias("rank"), "key").agg(F.array_sort(F.collect_list("source_path")).alias("paths"))


def candidates_without_text(docs: DataFrame) -> DataFrame:
    """extension and file_count of documents without text that are in some cluster; no extension is (none)."""
    rows = _grouped(docs)
    repeated = rows.groupBy("grouping", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = rows.where("text_hash is null").join(repeated, ["grouping", "key"], "left_semi").select("doc_id", "extension").distinct()
    return found.groupBy(F.when(F.coalesce("extension", F.lit("")) == "", "(none)").otherwise(F.col("extension")).alias("extension")).agg(F.count("*").alias("file_count"))
