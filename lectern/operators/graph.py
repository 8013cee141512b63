"""Graphs as edge tables: breadth-first order, decomposition without cycles, workflow edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators._store import stored


def breadth_first(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", child_no: str = "child_no", node: str = "node", max_depth: int = 1_000) -> DataFrame:
    """(node, depth, parent) of all nodes that the roots reach, each at its least depth; of the parents
    there, the least one that first lists it. Frontiers grow level by level; each level is a join with the
    edges and an anti-join with what has been seen. A graph of over ``max_depth`` levels is an error."""
    kind = dict(edges.dtypes)[child]
    seen = stored(roots.select(F.col(node).cast(kind).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")).dropDuplicates(["node"]))
    front = seen
    for depth in range(1, max_depth + 1):
        step = edges.select(F.col(parent).alias("__p"), F.col(child).alias("__c"), F.col(child_no).alias("__n")).join(front.select(F.col("node").alias("__p")), "__p")
        best = step.groupBy("__c").agg(F.min(F.struct("__n", "__p")).alias("m")).select(F.col("__c").alias("node"), F.lit(depth).alias("depth"), F.col("m.__p").alias("parent"))
        front = stored(best.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise ValueError(f"the graph is deeper than {max_depth} levels")
    return seen


def hierarchy(spark: SparkSession, view: str, parent: str, child: str, root: str, max_depth: int = 100) -> DataFrame:
    """The same for a tree, as one recursive query over a registered view: (node, depth)."""
    return spark.sql(
        f"""WITH RECURSIVE walk(node, depth) MAX RECURSION LEVEL {max_depth} AS (
              SELECT {child}, 0 FROM {view} WHERE {root}
              UNION ALL
              SELECT e.{child}, w.depth + 1 FROM {view} e JOIN walk w ON e.{parent} = w.node
            ) SELECT node, depth FROM walk"""
    )


def acyclic_paths(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", node: str = "node", max_depth: int = 50) -> DataFrame:
    """(root, parent, child, depth, dashed): edges on the way down from each root. An edge back to an
    ancestor is dashed and not followed; an edge that is met again is listed once. Paths of over ``max_depth`` edges are an error."""
    front = stored(roots.select(F.col(node).alias("root"), F.col(node).alias("at"), F.array(node).alias("path")))
    found = None
    for depth in range(1, max_depth + 1):
        step = front.join(edges.select(F.col(parent).alias("at"), F.col(child).alias("child")), "at")
        step = stored(step.where("child <> at").select("root", F.col("at").alias("parent"), "child", F.lit(depth).alias("depth"), F.array_contains("path", F.col("child")).alias("dashed"), "path"))
        if step.isEmpty():
            break
        new = step if found is None else step.join(found.select("root", "parent", "child"), ["root", "parent", "child"], "left_anti")
        new = new.dropDuplicates(["root", "parent", "child"])
        rows = stored(new.select("root", "parent", "child", "depth", "dashed", "path"))
        found = rows.drop("path") if found is None else found.unionByName(rows.drop("path"))
        front = rows.where("not dashed").select("root", F.col("child").alias("at"), F.concat("path", F.array("child")).alias("path"))
        if front.isEmpty():
            break
    else:
        if not front.join(edges.select(F.col(parent).alias("at")), "at", "left_semi").isEmpty():
            raise ValueError(f"paths are longer than {max_depth} edges")
    return found if found is not None else roots.limit(0).select(F.col(node).alias("root"), F.col(node).alias("parent"), F.col(node).alias("child"), F.lit(0).alias("depth"), F.lit(False).alias("dashed"))


def linked(volumes: DataFrame, moniker: str = "moniker", links: str = "linkedVolumes") -> DataFrame:
    """(moniker, link_no, linked): each volume's linked volumes that exist, in the order of its list."""
    named = volumes.select(F.col(moniker).alias("linked"))
    return volumes.select(F.col(moniker).alias("moniker"), F.posexplode(links).alias("link_no", "linked")).join(named, "linked", "left_semi").select("moniker", "link_no", "linked")


def renamed(edges: DataFrame, root: str = "root", child: str = "child") -> DataFrame:
    """Edges whose child has the name of its own root under another name: so the two are different nodes."""
    return edges.withColumn(child, F.when(F.col(root) == F.col(child), F.concat(F.col(child).cast("string"), F.lit("'"))).otherwise(F.col(child).cast("string")))


def workflow_edges(operations: DataFrame, name: str = "name", inputs: str = "inputs", outputs: str = "outputs") -> DataFrame:
    """(source, target): inputs to their operation, operations to their outputs."""
    into = operations.select(F.explode(inputs).alias("source"), F.col(name).alias("target"))
    return into.unionAll(operations.select(F.col(name).alias("source"), F.explode(outputs).alias("target")))


def mermaid(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """A row (line_no, line) of flow-chart text for each edge, sorted."""
    quoted = lambda c: F.concat(F.regexp_replace(F.col(c), r"\W+", "_"), F.lit('["'), F.replace(F.col(c), F.lit('"'), F.lit("#quot;")), F.lit('"]'))
    return edges.select(F.concat(F.lit("    "), quoted(source), F.lit(" --> "), quoted(target)).alias("line"))


def graphviz(edges: DataFrame, source: str = "parent", target: str = "child", dashed: str | None = "dashed") -> DataFrame:
    """A row (line) of graph text for each edge."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    style = F.when(F.col(dashed), ' [style="dashed"]').otherwise("") if dashed else F.lit("")
    return edges.select(F.concat(F.lit("  "), quote(source), F.lit(" -> "), quote(target), style, F.lit(";")).alias("line"))
