"""Parent links to full hierarchies by leaf peeling.

Nodes without children are peeled off in rounds; each sends its subtree size to its parent. In the same round a node of a
thin stretch (one child, one parent) is spliced out where its hash is larger than its child's and its parent's, and
the child hangs on the parent above, so that a chain shrinks by a third a round instead of by one node: the rounds grow
with the logarithm of the nodes, not with the depth. In reverse order of the rounds every node takes root,
depth and path from the node it hung on, which left later. What can't be peeled shrinks to a node that is its
own parent, which is a circle; nodes peeled towards one lead into it. Descendant lists go up by the same rounds, cut
into parts of a bounded length, so that a hub of a third of all nodes is no single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skein.session import fresh_path, materialize

#: Entries of one part of a descendant list, about.
PART = 4096


def bare_id(col: Column) -> Column:
    """An id without case, padding, directory and .jsonl ending; null when nothing is left."""
    s = F.lower(F.btrim(col, F.lit(" \t\r\n")))
    s = F.regexp_replace(F.regexp_extract(s, r"([^/\\]*)$", 1), r"\.jsonl$", "")
    return F.nullif(F.btrim(s, F.lit(" \t\r\n")), F.lit(""))


def one_parent(links: DataFrame) -> DataFrame:
    """links(tree, node, parent, at) with one row per node: the parent last observed, of equals the largest id; a node
    without any has a null parent. Every parent is a node too."""
    named = links.where(F.col("node").isNotNull())
    rank = F.when(F.col("parent").isNotNull(), F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("parent")))
    children = named.groupBy("tree", "node").agg(F.max(rank).alias("best"))
    children = children.select("tree", "node", F.col("best.parent").alias("parent"))
    above = named.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    return children.unionByName(above).groupBy("tree", "node").agg(F.max("parent").alias("parent"))


class Peeling:
    """The rounds of nodes(tree, node, parent), one row per node and each parent a node too.

    `paths` keeps the ids of spliced nodes with the child that hangs over them: as long as the paths themselves, so only
    where paths or descendants are asked for.
    """

    def __init__(self, nodes: DataFrame, paths: bool = True):
        self.spark, self.paths = nodes.sparkSession, paths
        self.rounds: list[DataFrame] = []
        self._told: list[str] = []
        kids = nodes.where("parent <> node").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
        zero = F.lit(0).cast("bigint")
        start = nodes.select("tree", "node", "parent").join(kids, ["tree", "node"], "left")
        start = start.select("tree", "node", "parent", F.col("parent").alias("above"), F.coalesce("kids", zero).alias("kids"), F.lit(1).cast("bigint").alias("size"), zero.alias("extra"), zero.alias("gap"), F.lit(None).cast("string").alias("low"), F.array().cast("array<string>").alias("between"))
        alive = start if paths else start.drop("between")
        while True:
            told = Observation()
            counts = [F.count_if(F.col("mode") == m).alias(m) for m in ("leaf", "splice", "stay")]
            flagged = materialize(self._flag(alive).observe(told, *counts), "peel")
            if not any(told.get.values()):
                break
            self.rounds.append(flagged.where("mode <> 'stay'"))
            if not told.get["stay"]:
                break
            alive = self._next(flagged)

    def _flag(self, alive: DataFrame) -> DataFrame:
        """Each node with what its children send and its mode in this round: leaf, splice or stay."""
        leaf = F.col("kids") == 0
        sent = alive.where("parent <> node").groupBy("tree", F.col("parent").alias("node")).agg(F.count_if(leaf).alias("_gone"), F.sum(F.when(leaf, F.col("size") + F.col("extra"))).alias("_add"), F.min(F.when(~leaf, F.struct("node", "extra"))).alias("_kid"))

        def rank(node: Column) -> Column:
            return F.struct(F.xxhash64(node, F.lit(len(self.rounds))), node)

        thin = (F.col("kids") == 1) & F.col("_gone").isNotNull() & (F.col("_gone") == 0) & (F.col("parent") != F.col("node"))
        peak = (rank(F.col("node")) > rank(F.col("_kid.node"))) & (rank(F.col("node")) > rank(F.col("parent")))
        mode = F.when(leaf, "leaf").when(thin & peak, "splice").otherwise("stay")
        rows = alive.join(sent, ["tree", "node"], "left").withColumn("mode", mode)
        # A spliced node's subtree is its own, what hangs between its child and itself, and the child's.
        below = F.when(F.col("mode") == "splice", F.col("size") + F.col("_kid.extra"))
        rows = rows.withColumns({"kid": F.when(F.col("mode") == "splice", F.col("_kid.node")), "below": below})
        rows = rows.withColumn("kids", F.col("kids") - F.coalesce("_gone", F.lit(0)))
        return rows.withColumn("size", F.col("size") + F.coalesce("_add", F.lit(0))).drop("_gone", "_add", "_kid")

    def _next(self, flagged: DataFrame) -> DataFrame:
        kept = ["tree", "node", "parent", "above", "kids", "size", "extra", "gap", "low", *(["between"] if self.paths else [])]
        taken = [F.col(c).alias(f"_{c}") for c in ("gap", "low", *(["between"] if self.paths else []))]
        over = flagged.where("mode = 'splice'").select("tree", F.col("kid").alias("node"), F.col("parent").alias("_up"), F.col("node").alias("_via"), (F.col("size") + F.col("extra")).alias("_extra"), *taken)
        rows = flagged.where("mode = 'stay'").select(*kept).join(over, ["tree", "node"], "left")
        moved = F.col("_via").isNotNull()
        new = {
            "parent": F.when(moved, F.col("_up")).otherwise(F.col("parent")),
            "extra": F.col("extra") + F.coalesce("_extra", F.lit(0)),
            # A circle that shrank to one node has itself for a child no more.
            "kids": F.col("kids") - F.when(moved & (F.col("_up") == F.col("node")), 1).otherwise(0),
            "gap": F.col("gap") + F.when(moved, F.col("_gap") + 1).otherwise(0),
            "low": F.least("low", "_low", "_via"),
        }
        if self.paths:
            new["between"] = F.when(moved, F.concat("_between", F.array("_via"), "between")).otherwise(F.col("between"))
        return rows.withColumns(new).select(*kept)

    def rows(self) -> DataFrame:
        """(tree, node, parent, root, depth, path, n_descendants, cycle_id) of every node; no path without `paths`."""
        return self._read().select("tree", "node", F.col("above").alias("parent"), "root", "depth", *(["path"] if self.paths else []), "n_descendants", "cycle_id")

    def _read(self) -> DataFrame:
        if not self._told:
            for k in range(len(self.rounds) - 1, -1, -1):
                told = self._tell(k)
                path = fresh_path(self.spark, "paths")
                told.write.parquet(path)
                self._told.append(path)
        if not self._told:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*self._told)

    def _schema(self) -> str:
        extra = ", path array<string>, between array<string>" if self.paths else ""
        return f"tree string, node string, parent string, above string, root string, depth bigint, n_descendants bigint, cycle_id string, gap bigint, left_in int, due int, subtree bigint{extra}"

    def _tell(self, k: int) -> DataFrame:
        """Round k's nodes, told by those of the rounds after it."""
        gone = self.rounds[k]
        ring = F.col("parent") == F.col("node")
        if not self._told:
            known = self.spark.createDataFrame([], self._schema())
        else:
            known = self.spark.read.schema(self._schema()).parquet(*self._told)
        path = ["path"] if self.paths else []
        over = known.select("tree", F.col("node").alias("parent"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("cycle_id").alias("_cycle"), F.col("left_in").alias("due"), *[F.col(c).alias(f"_{c}") for c in path])
        under = known.select("tree", F.col("node").alias("kid"), F.col("subtree").alias("_subtree"))
        rows = gone.join(over, ["tree", "parent"], "left").join(under, ["tree", "kid"], "left")
        top = F.col("parent").isNull()
        depth = F.when(top, F.lit(0)).when(~ring, F.col("_depth") + F.col("gap") + 1).cast("bigint")
        size = F.when(F.col("mode") == "leaf", F.col("size")).otherwise(F.col("below") + F.col("_subtree"))
        new = {
            "root": F.when(top, F.col("node")).when(~ring, F.col("_root")),
            "depth": depth,
            "cycle_id": F.when(ring, F.least("node", "low")).otherwise(F.col("_cycle")),
            "subtree": size,
            "left_in": F.lit(k).cast("int"),
        }
        if self.paths:
            own = F.array("node")
            new["path"] = F.when(top, own).when(~ring, F.concat("_path", F.col("between"), own))
        rows = rows.withColumns(new).withColumn("n_descendants", F.when(F.col("depth").isNotNull(), F.col("subtree") - 1))
        return rows.select(*[c.split()[0] for c in self._schema().split(", ")])

    def descendants(self, part: int = PART) -> DataFrame:
        """(tree, node, descendant, distance) of every node and each node below it, none for nodes that have no root.

        A leaving node sends its list, itself at the head, to the node it hangs on and to those spliced out between.
        Lists travel in parts of about `part` entries, written by the round in which their receiver leaves, so
        that each part is read once.
        """
        if not self.paths:
            raise ValueError("descendants need the paths")
        placed = self._read().where("depth IS NOT NULL")
        entry = "array<struct<node:string,depth:bigint>>"
        schema = f"tree string, owner string, owner_depth bigint, entries {entry}, due int"
        base = fresh_path(self.spark, "below")
        for k in range(len(self.rounds)):
            here = placed.where(F.col("left_in") == k)
            own = here.select("tree", "node", F.array(F.struct("node", "depth")).alias("entries"))
            if k:
                got = self.spark.read.schema(schema).parquet(base).where(F.col("due") == k)
                own = own.unionByName(got.select("tree", F.col("owner").alias("node"), "entries"))
            senders = here.where("above IS NOT NULL").select("tree", "node", "parent", "depth", "gap", "between", "due", "subtree")
            lists = own.join(senders, ["tree", "node"])
            # One part holds about `part` entries, whatever the size of the list.
            mark = F.pmod(F.xxhash64(F.col("entries")[0]["node"]), F.greatest(F.lit(1), F.ceil(F.col("subtree") / part))).alias("_part")
            lists = lists.groupBy("tree", "node", mark).agg(F.flatten(F.collect_list("entries")).alias("entries"), *[F.first(c).alias(c) for c in ("parent", "depth", "gap", "between", "due")])
            none = F.lit(-1)
            first = F.struct(F.col("parent").alias("owner"), (F.col("depth") - F.col("gap") - 1).alias("owner_depth"), F.col("due"))
            rest = F.transform("between", lambda b, i: F.struct(b.alias("owner"), (F.col("depth") - F.col("gap") + i).alias("owner_depth"), none.alias("due")))
            out = lists.select("tree", "entries", F.explode(F.concat(F.array(first), rest)).alias("to")).select("tree", "to.owner", "to.owner_depth", "entries", "to.due")
            out.write.mode("append").partitionBy("due").parquet(base)
        if not self.rounds:
            return self.spark.createDataFrame([], "tree string, node string, descendant string, distance bigint")
        every = self.spark.read.schema(schema).parquet(base)
        rows = every.select("tree", F.col("owner").alias("node"), "owner_depth", F.explode("entries").alias("e"))
        return rows.select("tree", "node", F.col("e.node").alias("descendant"), (F.col("e.depth") - F.col("owner_depth")).alias("distance"))


def hierarchy(nodes: DataFrame, paths: bool = True) -> DataFrame:
    """nodes(tree, node, parent), one row per node and each parent a node too (as `one_parent` gives them), with root,
    depth, path, n_descendants and cycle_id.

    A node on a circle, or below one, has the circle's smallest id as cycle_id and null root, depth, path and
    n_descendants. Without `paths` no path is made, which is all that grows with the depth.
    The joins meet one row per node on one side, so a hub's children are split by adaptive skew handling.
    """
    return Peeling(nodes, paths).rows()


def descendants(nodes: DataFrame) -> DataFrame:
    """(tree, node, descendant, distance): one row for each node and each node below it; nothing for nodes of circles."""
    return Peeling(nodes).descendants()
