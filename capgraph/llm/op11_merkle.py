"""Merkle manifest of a dataset: a persistent tree with path copying.

The rows of a group (a language) are leaves in the order of their ids; every
``FAN`` neighbours become a node, up to the group's root; the groups' roots, in
the order of the groups, are the leaves of one more tree.

1. *Leaves* are hashed in the JVM, the tampered row beside the untouched one;
   texts never move.
2. One range shuffle of the digests gives each leaf its place (``ranks``), so
   a group that holds a third of all rows, or all, is spread over all tasks.
3. *Aligned blocks* of ``FAN ** DEPTH`` leaves are trees that a task builds
   whole.  Their roots are the leaves of the next level's blocks, and so on:
   levels grow with the logarithm of the rows, and each holds 1/4096 of the one
   below.  A level leaves, for every node below it, the *path* to the block's
   root: its place among its run, and the others of the run.
4. *Versions.*  A tampered leaf makes a version of the tree: it copies the
   leaf's ancestors and shares every other node with the tree it came from.
   Inside a block the task that holds the block copies them; the version goes
   on along the block's path through the levels above, which is one small row
   for a block, so no level has to see all versions together.

A leaf's proof is the digest of the others of its runs from the leaf to the
root; its version's last copied node is the root that the tampered dataset
would have.

Defined cases: null fields are hashed as ``-``; a null group is a group of its
own and comes first; null ids come first and are never tampered with; rows
with equal ids are ordered by their leaves; equal rows may trade places; a
group's only leaf is its root; a lone leaf of a lone group has no others, so its
proof is the digest of nothing; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Levels of a block; it has FAN ** DEPTH = 4096 leaves at most.
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(nodes) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


class Tree:
    """An aligned block: ``levels`` from its leaves up.  ``lone``: the block is
    all of its group on this level, so it ends at the first single node;
    otherwise it has ``depth`` levels above the leaves."""

    def __init__(self, leaves: list[bytes], lone: bool, depth: int):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if lone else len(self.levels) <= depth:
            below = self.levels[-1]
            self.levels.append([digest(below[i:i + FAN]) for i in range(0, len(below), FAN)])

    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, leaf: int) -> list[tuple[int, bytes]]:
        """From the leaf up: its place in its run, and the others of the run."""
        out = []
        for nodes in self.levels[:-1]:
            place = leaf % FAN
            run = nodes[leaf - place:leaf - place + FAN]
            out.append((place, b"".join(run[:place] + run[place + 1:])))
            leaf //= FAN
        return out


def copied(node: bytes, path: list[tuple[int, bytes]]) -> list[bytes]:
    """A version's own nodes: a changed node and its ancestors along ``path``.
    All others are the tree's."""
    out = [node]
    for place, others in path:
        at = place * len(node)
        out.append(digest((others[:at], out[-1], others[at:])))
    return out


def field(x: Column) -> Column:
    """A field as it goes into a leaf."""
    text = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def leaves(docs: DataFrame, fields=FIELDS, group_col: str = "lang", id_col: str = "doc_id",
           when: Column | None = None, tampered: dict[str, Column] | None = None) -> DataFrame:
    """group, id, leaf, and for the rows ``when`` holds the leaf of the row
    whose fields are ``tampered`` (else null)."""
    changed = F.when(F.coalesce(when, F.lit(False)), leaf([(tampered or {}).get(c, F.col(c)) for c in fields])) \
        if when is not None else F.lit(None).cast("string")
    group = F.col(group_col).cast("string")
    return docs.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("group"),
        F.col(id_col).cast("bigint").alias("id"), leaf([F.col(c) for c in fields]).alias("leaf"),
        changed.alias("changed"), F.monotonically_increasing_id().alias("row"))


STEP = "array<struct<place:int,others:binary>>"
_STEP = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))
LIFTED = f"group string, index bigint, path {STEP}, above bigint, node binary"


def _steps(path) -> list[dict]:
    return [{"place": p, "others": o} for p, o in path]


def lifted(nodes: DataFrame, depth: int) -> DataFrame:
    """A level's blocks: each node of ``nodes`` (group, index, size, node) with
    its path to the root of its block, and that root on the block's first row."""

    def run(key, table):
        table = table.sort_by("index")
        group, above = (k.as_py() for k in key)
        tree = Tree(table.column("node").to_pylist(), table.column("size")[0].as_py() <= FAN ** depth, depth)
        n = table.num_rows
        return pa.table({
            "group": pa.array([group] * n, pa.string()), "index": table.column("index"),
            "path": pa.array([_steps(tree.path(i)) for i in range(n)], _STEP),
            "above": pa.array([above] * n, pa.int64()), "node": pa.array([tree.root()] + [None] * (n - 1), pa.binary())})

    return (nodes.withColumn("above", F.floor(F.col("index") / FAN ** depth).cast("bigint")).groupBy("group", "above")
            .applyInArrow(run, LIFTED))


def to_roots(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (group, index, size, node), written: the groups' roots (group,
    root), and for every node its path to its group's root (group, index, path)."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    rounds = []
    while most > 1:
        rounds.append(common.written(lifted(nodes, depth)))
        n = F.ceil(F.col("size") / FAN ** depth).cast("bigint")
        sizes = nodes.where("index = 0").select("group", n.alias("size"))
        nodes = common.written(rounds[-1].where("node IS NOT NULL").select("group", F.col("above").alias("index"), "node")
                               .join(sizes, "group"))
        most = -(-most // FAN ** depth)
    roots = nodes.select("group", F.col("node").alias("root"))
    if not rounds:
        return roots, nodes.select("group", "index", F.array().cast(STEP).alias("path"))
    paths = rounds.pop()
    while rounds:  # a node's path goes on with its block's
        upper = paths.select("group", F.col("index").alias("above"), F.col("path").alias("further"))
        paths = rounds.pop().join(upper, ["group", "above"]).withColumn("path", F.concat("path", "further"))
    return roots, paths.select("group", "index", "path")


RESULT = ("group string, id bigint, leaf string, proof_sha256 string, copied array<string>, folded_root string")


def manifest(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """For every row of ``leaves`` (see there): group, id, leaf, subroot, root,
    proof_sha256, ``copied`` (the nodes of its version from leaf to root; null
    where it isn't tampered with), folded_root and verified."""
    size = FAN ** depth
    leaves = common.written(leaves)
    rows = (ranked(leaves, "group", ["id", "leaf", "row"], ["changed"]).withColumnRenamed("in_group", "size")
            .withColumn("block", F.floor(F.col("rank") / size).cast("bigint")))

    def build(key, table):
        nodes = table.sort_by("rank").column("leaf").to_pylist()
        n = table.column("size")[0].as_py()
        root = Tree([x.encode() for x in nodes], n <= size, depth).root()
        return pa.table({"group": pa.array([key[0].as_py()], pa.string()), "index": pa.array([key[1].as_py()], pa.int64()),
                         "size": pa.array([-(-n // size)], pa.int64()), "node": pa.array([root], pa.binary())})

    node = "group string, index bigint, size bigint, node binary"
    blocks = common.written(rows.select("group", "block", "rank", "leaf", "size").groupBy("group", "block").applyInArrow(build, node))
    subroots, inside = to_roots(blocks, depth)
    subroots = common.written(subroots.select(F.lit("").alias("all"), "group", F.col("root").alias("node")))
    tops = common.written(ranked(subroots, "all", ["group"]).select(F.col("all").alias("group"), F.col("rank").alias("index"),
                                                                      F.col("in_group").alias("size"), "node", F.col("group").alias("name")))
    roots, over = to_roots(tops.select("group", "index", "size", "node"), depth)
    last = (tops.select("index", F.col("name").alias("group"), F.col("node").alias("subroot"))
            .join(over.select("index", F.col("path").alias("further")), "index").drop("index"))
    top = roots.select("root").first()
    paths = common.written(inside.join(last, "group").select(
        "group", F.col("index").alias("block"), F.concat("path", "further").alias("path"), "subroot"))

    def finish(key, table, path):
        table = table.sort_by("rank")
        found = [x.encode() for x in table.column("leaf").to_pylist()]
        tree = Tree(found, table.column("size")[0].as_py() <= size, depth)
        upper = [(s["place"], s["others"]) for s in path.column("path")[0].as_py()]
        proofs, versions, folded = [], [], []
        for i, (own, changed) in enumerate(zip(found, table.column("changed").to_pylist())):
            way = tree.path(i) + upper
            proofs.append(digest(others for _, others in way).decode())
            nodes = copied(own if changed is None else changed.encode(), way)
            versions.append(None if changed is None else [x.decode() for x in nodes])
            folded.append(nodes[-1].decode())
        return pa.table({"group": table.column("group"), "id": table.column("id"), "leaf": table.column("leaf"),
                         "proof_sha256": pa.array(proofs, pa.string()), "copied": pa.array(versions, pa.list_(pa.string())),
                         "folded_root": pa.array(folded, pa.string()),
                         "subroot": pa.array([path.column("subroot")[0].as_py().decode()] * len(found), pa.string())})

    done = (rows.groupBy("group", "block").cogroup(paths.groupBy("group", "block"))
            .applyInArrow(finish, f"{RESULT}, subroot string"))
    root = F.lit(top.root.decode() if top else None).cast("string")
    return done.withColumn("root", root).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(leaves(docs, when=third, tampered={"text": F.translate("text", UPPER, LOWER)}))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
