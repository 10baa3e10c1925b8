"""A Merkle manifest of a dataset: one hash tree for each language, and one over their roots.

Leaves are numbered within their language by ranges of doc_id, so no task sees a whole language: rows are dealt by range,
numbered inside their range, and shifted by the counts of the ranges before.  Each level is a DataFrame: a node's run is its
number divided by the fanout, the run's sorted children are hashed into the parent, and the parents are the next level.
Proofs are joined from the top down, level by level: a run gets what its parent has, with the parent's siblings before it.
So what is shuffled is one path for each run, not one for each leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, written

FANOUT = 8


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Binary SHA-256 of the values: each `-` if null, else its length in UTF-8, a colon and the value."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(leaves: DataFrame) -> DataFrame:
    """leaves (tree, doc_id, leaf, ...) with `at`, their number in the tree from 0, and `nodes`, how many there are."""
    # The number of the range is stored with the row, so that all later reads agree on it.
    dealt = written(leaves.repartitionByRange("doc_id", "leaf").withColumn("part", F.spark_partition_id()), "leaves")
    parts = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")
    shifts = written(parts.select("tree", "part", before.alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("nodes")), "shifts")
    inside = F.row_number().over(Window.partitionBy("part", "tree").orderBy(F.asc_nulls_first("doc_id"), "leaf"))
    return dealt.withColumn("inside", inside).join(shifts, ["part", "tree"]).withColumn("at", F.col("shift") + F.col("inside") - 1).drop("part", "inside", "shift")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, run, nodes, members: sorted array of what else a node has) of nodes (tree, at, nodes, digest, ...)."""
    member = F.struct("at", *[c for c in nodes.columns if c not in ("tree", "at", "nodes")])
    run = F.expr(f"at div {fanout}").alias("run")
    return nodes.groupBy("tree", run).agg(F.max("nodes").alias("nodes"), F.sort_array(F.collect_list(member)).alias("members"))


def _levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The written runs of every level, lowest first, and (tree, digest) of the roots, written."""
    runs = [written(_runs(nodes, fanout), "runs")]
    (most,) = runs[0].agg(F.max("nodes")).first()
    roots = [runs[0].where("nodes = 1").select("tree", F.col("members")[0]["digest"].alias("digest"))]
    while most is not None and most > 1:
        whole = F.concat_ws("", F.transform("members", lambda m: _hex(m["digest"])))
        parents = runs[-1].where("nodes > 1").select("tree", F.col("run").alias("at"), F.expr(f"(nodes + {fanout - 1}) div {fanout}").alias("nodes"), F.unhex(F.sha2(whole, 256)).alias("digest"))
        runs.append(written(_runs(parents, fanout), "runs"))
        roots.append(runs[-1].where("nodes = 1").select("tree", F.col("members")[0]["digest"].alias("digest")))
        most = -(-most // fanout)
    return runs, written(reduce(DataFrame.unionByName, roots), "roots")


def _exploded(runs: DataFrame) -> DataFrame:
    """Each member of runs that have their paths: (tree, member, root, path from the member up)."""
    digests = F.transform("members", lambda m: m["digest"])
    binary = lambda part: F.aggregate(part, F.lit(b""), lambda out, x: F.concat(out, x))
    each = runs.select("tree", "nodes", "root", "path", digests.alias("digests"), F.posexplode("members").alias("k", "member"))
    size, k = F.size("digests"), F.col("k")
    own = F.struct(binary(F.slice("digests", F.lit(1), k)).alias("before"), binary(F.slice("digests", k + 2, size)).alias("after"))
    return each.select("tree", "member", "root", F.when(F.col("nodes") > 1, F.concat(F.array(own), "path")).otherwise(F.col("path")).alias("path"))


def _with_paths(runs: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The lowest runs with root and path (that of the run's own parent), from tops (tree, root, path of the tree's root)."""
    above = None
    for k in reversed(range(len(runs))):
        # A tree comes in where its own root is the parent; one of a single leaf at the lowest level.
        ending = runs[k].where((F.col("nodes") <= fanout) & ((F.col("nodes") > 1) | F.lit(k == 0))).select("tree", "run")
        parents = ending.join(tops, "tree").select("tree", "run", "root", "path")
        if above is not None:
            parents = parents.unionByName(_exploded(above).select("tree", F.col("member")["at"].alias("run"), "root", "path"))
        following = written(runs[k].join(parents, ["tree", "run"]), "paths")
        dropped(runs[k], *([] if above is None else [above]))
        above = following
    return above


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """tree, doc_id, leaf, subroot, root (binary), path and any further columns of leaves (tree string, doc_id, leaf binary, ...).

    A tree's leaves ascend by doc_id, null first, then by leaf; while several nodes remain, each `fanout` consecutive ones
    (the last run: fewer, even one) become the SHA-256 of their digests in lowercase hex.  Roots of the trees, in the
    order of their names' bytes, give the root likewise; a lone node is its own root.  path: an array from the leaf up to
    the root of (before, after), the digests beside it in each run.  Equal leaves of one doc_id take neighbouring places;
    an empty table gives no rows.  doc_id, leaf and tree are never repeated as further columns.
    """
    further = [c for c in leaves.columns if c not in ("tree", "doc_id", "leaf")]
    nodes = _numbered(leaves).select("tree", "at", "nodes", F.col("leaf").alias("digest"), "doc_id", F.struct(F.lit(0).alias("none"), *further).alias("rest"))
    runs, subroots = _levels(nodes, fanout)
    # The trees themselves are the leaves of one more tree, in the order of their names.
    over = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("doc_id"), F.col("digest").alias("leaf")))
    upper, top = _levels(over.select("tree", "at", "nodes", F.col("leaf").alias("digest"), F.col("doc_id").alias("name")), fanout)
    no_path = F.array().cast("array<struct<before: binary, after: binary>>")
    paths = _exploded(_with_paths(upper, top.select("tree", F.col("digest").alias("root"), no_path.alias("path")), fanout))
    tops = written(paths.select(F.col("member")["name"].alias("tree"), F.struct(F.col("member")["digest"].alias("subroot"), "root").alias("root"), "path"), "tops")
    out = _exploded(_with_paths(runs, tops, fanout))
    return out.select("tree", F.col("member")["doc_id"].alias("doc_id"), F.col("member")["digest"].alias("leaf"), F.col("root")["subroot"].alias("subroot"), F.col("root")["root"].alias("root"), "path", *[F.col("member")["rest"][c].alias(c) for c in further])


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of all digests of a path, as lowercase hex, from the leaf up and left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"])))), 256)


def folded(own: Column, path: Column) -> Column:
    """The root (hex) that a leaf (binary) and its path give."""
    return F.aggregate(path, _hex(own), lambda digest, p: F.sha2(F.concat(_hex(p["before"]), digest, _hex(p["after"])), 256))


def tree_name(lang: Column) -> Column:
    """A name for each language that sorts as they do, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def report(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (hex), verified for each row of docs.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored.  For the test of the proofs, the texts of a
    third of the documents (three divides the CRC-32 of the doc_id's digits) are tampered with: their A-Z are
    lower-cased, and folded_root is computed from that leaf.  Nulls count as values of their own, empty texts as such;
    rows without a doc_id come first in their language and aren't tampered with; equal rows stay rows of their own;
    an empty table gives no rows.
    """
    names = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    meant = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    plain = [F.col(c) for c in names]
    leaves = docs.select(tree_name(F.col("lang")).alias("tree"), "doc_id", leaf(*plain, F.col("text")).alias("leaf"), F.when(meant, leaf(*plain, lowered)).alias("tampered"))
    made = manifest(leaves, fanout).withColumn("folded", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return made.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == _hex(F.col("root"))).alias("verified"))
