"""Problem 5: one group identifier for all records linked directly or indirectly.

The graph is reduced before it is solved. Each round takes the degree and the two extreme neighbours of every vertex
from ONE partially aggregated pass over the arcs, then

* strips vertices of degree one (a star of any size goes in a single round, its hub keeps no list of its leaves),
* compresses paths of degree-two vertices by list ranking: pointer doubling over arcs keyed by (vertex, next vertex),
  so a path of length L takes log2(L) steps and no key is as hot as a hub,
* and where neither is left, hooks every vertex of the reduced core to its smallest neighbour and contracts the trees
  so formed, after which stripping starts again.

Removed vertices keep one pointer each; labels are restored in reverse order of removal. Nothing is collected except
counts, and every step works on rows keyed by a vertex or an edge, so no group is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.runtime import Scratch


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("a")).select("a.x", "a.y")


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected edges u < v without loops and nulls."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _strip(around: DataFrame) -> DataFrame:
    """(node, parent, u, v) for every vertex of degree one; of an isolated pair only the larger goes."""
    leaf = around.where("degree = 1").select("x", F.col("first").alias("y"))
    pairs = leaf.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.count("*").alias("ends"), F.max("x").alias("leaf"))
    node = F.when(F.col("ends") == 2, F.col("v")).otherwise(F.col("leaf"))
    return pairs.select(node.alias("node"), (F.col("u") + F.col("v") - node).alias("parent"), "u", "v")


def _double(state: DataFrame) -> DataFrame:
    """Every open arc takes over the pointer of the arc that it points to."""
    ahead = state.select(F.col("x").alias("jx"), F.col("to").alias("jto"), F.col("nx").alias("jnx"), F.col("nto").alias("jnto"), F.col("end").alias("jend"), F.col("lo").alias("jlo"))
    return state.join(ahead, (F.col("nx") == F.col("jx")) & (F.col("nto") == F.col("jto")), "left").select(
        "x", "to", F.col("jnx").alias("nx"), F.col("jnto").alias("nto"), F.coalesce("end", "jend").alias("end"), F.least("lo", F.coalesce("jlo", "lo")).alias("lo"), (F.coalesce("jlo", "lo") < F.col("lo")).alias("fell"), F.col("fell").alias("fell_before")
    )


def _rank_chains(scratch: Scratch, around: DataFrame) -> DataFrame:
    """(x, a, b, lo): the two ends of the path of degree-two vertices that holds x; on a closed ring a and b are null and lo is its smallest vertex."""
    middle = around.where("degree = 2")
    arcs = middle.select(F.explode(F.array(F.struct("x", F.col("first").alias("came"), F.col("last").alias("to")), F.struct("x", F.col("last").alias("came"), F.col("first").alias("to")))).alias("a")).select("a.*")
    nxt = arcs.select(F.col("x").alias("nx"), F.col("came").alias("nc"), F.col("to").alias("nto"))
    state = arcs.join(nxt, (F.col("to") == F.col("nx")) & (F.col("x") == F.col("nc")), "left").select(
        "x", "to", "nx", "nto", F.when(F.col("nx").isNull(), F.col("to")).alias("end"), F.least("x", F.coalesce("nx", "x")).alias("lo"), F.lit(False).alias("fell")
    )
    state = scratch.cut(state)
    before = -1
    while True:
        n = state.agg(F.count("nx").alias("open"), F.count_if(F.col("fell")).alias("fell")).first()
        # every step closes the last arcs of each open path; when none closes and no minimum falls, only solved rings are left
        if not n["open"] or (n["open"] == before and not n["fell"]):
            break
        before = n["open"]
        once = _double(state)
        new = scratch.cut(_double(once).withColumn("fell", F.col("fell") | F.col("fell_before")).drop("fell_before"))
        scratch.drop(state)
        state = new
    ends = scratch.cut(state.groupBy("x").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.min("lo").alias("lo")))
    scratch.drop(state)
    return ends


def _contract(scratch: Scratch, around: DataFrame) -> DataFrame:
    """(node, parent) of the core: every vertex hooks to its smallest neighbour if that is smaller; pointers are doubled until they name roots."""
    up = scratch.cut(around.select(F.col("x").alias("node"), F.least("x", "first").alias("parent")))
    while True:
        over = up.select(F.col("node").alias("mid"), F.col("parent").alias("top"))
        new = scratch.cut(up.join(over, F.col("parent") == F.col("mid")).select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")))
        scratch.drop(up)
        up = new
        if not up.where("moved").limit(1).count():
            return up.where("node <> parent").select("node", "parent")


def group_linked(edges: DataFrame, left: str = "left", right: str = "right", *, scratch: Scratch | None = None) -> DataFrame:
    """Group identifiers of all records that take part in a link.

    edges: any DataFrame with two id columns of type bigint; other columns are ignored. Rows with a null end and links
    of a record to itself link nothing; repeated and turned-round links count once. Returns (row_id, group_id), one row
    per record linked to at least one other, group_id being the smallest id of its group. An empty input gives an
    empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    live = scratch.cut(_ordered(edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")), "a", "b"))
    removed: list[DataFrame] = []
    stripped = False
    while True:
        around = scratch.cut(_arcs(live).groupBy("x").agg(F.count("*").alias("degree"), F.min("y").alias("first"), F.max("y").alias("last")))
        n = around.agg(F.count("*").alias("all"), F.count_if(F.col("degree") == 1).alias("one"), F.count_if(F.col("degree") == 2).alias("two")).first()
        if not n["all"]:
            break
        # strips and compressions take turns: a compressed tail of any length is one leaf for the next strip
        if n["one"] and not (stripped and n["two"]):
            stripped = True
            gone = _strip(around)  # cheap to derive again from the written arcs, which are kept for it
            removed.append(gone.select("node", "parent"))
            rest = scratch.cut(live.join(gone.select("u", "v"), ["u", "v"], "left_anti"))
        elif n["two"]:
            stripped = False
            ends = _rank_chains(scratch, around)
            removed.append(ends.select(F.col("x").alias("node"), F.coalesce("a", "lo").alias("parent")).where("node <> parent"))
            inner = around.where("degree = 2").select(F.explode(F.array(F.struct(F.least("x", "first").alias("u"), F.greatest("x", "first").alias("v")), F.struct(F.least("x", "last").alias("u"), F.greatest("x", "last").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
            outer = live.join(inner, ["u", "v"], "left_anti")
            rest = scratch.cut(outer.unionByName(_ordered(ends.where("a IS NOT NULL"), "a", "b")).distinct())
        else:
            stripped = False
            up = _contract(scratch, around)
            removed.append(up)
            moved = live.join(up.select(F.col("node").alias("u"), F.col("parent").alias("pu")), "u", "left").join(up.select(F.col("node").alias("v"), F.col("parent").alias("pv")), "v", "left")
            rest = scratch.cut(_ordered(moved.select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b")), "a", "b"))
        scratch.drop(live)
        live = rest
    scratch.drop(live, around)
    if not removed:
        return edges.sparkSession.createDataFrame([], "row_id long, group_id long")
    # restore: the label of a removed vertex is that of its pointer, which outlived it
    label: DataFrame | None = None
    for i, gone in enumerate(reversed(removed), start=1):
        if label is None:
            below = gone.select("node", F.col("parent").alias("root"))
        else:
            known = label.select(F.col("node").alias("parent"), "root")
            below = gone.join(known, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        label = below if label is None else label.unionByName(below)
        if i % 3 == 0 or i == len(removed):
            label = scratch.cut(label)
    lowest = label.groupBy("root").agg(F.min("node").alias("least")).select("root", F.least("root", "least").alias("group_id"))
    members = label.join(lowest, "root").select(F.col("node").alias("row_id"), "group_id")
    return members.unionByName(lowest.select(F.col("root").alias("row_id"), "group_id"))
