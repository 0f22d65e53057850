"""In-batch near-duplicate reuse (J6) as a graph job.

Row order semantics: a row is compared (token-sort ratio, case-sensitive) to
the earlier rows that were *not* themselves reused ("leaders"); with a best
score ≥ T it copies that leader's category, otherwise it becomes a leader.

Set form.  Names with equal sorted tokens are one node, placed at the first of
them.  Nodes are decided in rounds, each one exact:

* A node that is the first open node in all of its blocking lists has no
  earlier open candidate: it is a leader.  Open nodes similar to a new leader
  are followers and leave.  That needs one row per list entry and the pairs of
  new leaders only, so a dense cluster of k names costs k pairs, not k².
* When the open nodes have no more than ``PAIRS_PER_NODE`` candidate pairs each
  (or ``FEW_PAIRS`` in all), or such a round no longer thins them out, the
  remaining pairs are verified once, and the rest is decided on those edges: an
  open node with an earlier leader neighbour is a follower, one without an
  earlier open neighbour is a leader.  This choice changes only the plan.

Each round decides at least the lowest open node, and rounds go on until none
is open, so every name comes out.  The result equals the row-by-row loop.
Every round is checkpointed to the shared checkpoint folder, so lineage stays
short and a lost executor only repeats one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sort_tokens
from ..session import cut_lineage
from .fuzzy import prefix_items, score_pairs

PAIRS_PER_NODE, FEW_PAIRS = 64, 2_000_000
THINNED = 0.9  # a round is worth repeating when it leaves at most this share open


def _candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (lid, rid) sharing a blocking item, the right one earlier."""
    a, b = left.withColumnRenamed("sid", "lid"), right.withColumnRenamed("sid", "rid")
    return a.join(b, ["gram", "occ"]).where(F.col("rid") < F.col("lid")).select("lid", "rid").distinct()


def _decide_on_edges(open_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders among ``open_nodes`` (sid), given all similar pairs (lid later, rid earlier)."""
    status = cut_lineage(open_nodes.select("sid", F.lit("open").alias("st")))
    while status.where(F.col("st") == "open").limit(1).count():
        earlier = (edges.join(status.select(F.col("sid").alias("rid"), "st"), "rid").groupBy("lid").agg(
            F.max((F.col("st") == "leader").cast("int")).alias("has_leader"),
            F.max((F.col("st") == "open").cast("int")).alias("has_open")))
        status = cut_lineage(
            status.join(earlier.withColumnRenamed("lid", "sid"), "sid", "left").select(
                "sid", F.when(F.col("st") != "open", F.col("st"))
                .when(F.coalesce("has_leader", F.lit(0)) == 1, "follower")
                .when(F.coalesce("has_open", F.lit(0)) == 0, "leader")
                .otherwise("open").alias("st")))
    return status.where(F.col("st") == "leader").select("sid")


def leaders(names: DataFrame, threshold: float = 92.0, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """``names``: ``(name, ord)`` with one row per distinct name (first
    appearance).  Returns ``(name, ord, leader_name, leader_ord, score)`` where
    the leader columns are null for leaders."""
    rows = cut_lineage(names.select("name", "ord", sort_tokens("name").alias("s")))
    nodes = cut_lineage(rows.groupBy("s").agg(F.min("ord").alias("sid")))
    items = cut_lineage(prefix_items(nodes, threshold))
    found = nodes.select("sid").limit(0)
    open_items = items
    open_nodes = nodes.select("sid")
    before = None
    while True:
        lists = open_items.groupBy("gram", "occ").agg(F.min("sid").alias("low"), F.count(F.lit(1)).alias("n"))
        lists = cut_lineage(lists)
        pairs = lists.agg(F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
        n_open = open_nodes.count()
        stalled = before is not None and n_open > THINNED * before
        before = n_open
        if stalled or pairs <= max(few_pairs, PAIRS_PER_NODE * n_open):
            edges = cut_lineage(score_pairs(_candidates(open_items, open_items), nodes, nodes, threshold))
            found = found.unionByName(_decide_on_edges(open_nodes, edges))
            break
        first = (open_items.join(lists, ["gram", "occ"]).groupBy("sid")
                 .agg(F.min((F.col("low") == F.col("sid")).cast("int")).alias("first"))
                 .where("first = 1").select("sid"))
        first = cut_lineage(first)
        near = score_pairs(_candidates(open_items, open_items.join(first, "sid", "left_semi")), nodes, nodes, threshold)
        gone = cut_lineage(near.select(F.col("lid").alias("sid")).unionByName(first).distinct())
        found = cut_lineage(found.unionByName(first))
        open_nodes = cut_lineage(open_nodes.join(gone, "sid", "left_anti"))
        open_items = cut_lineage(open_items.join(gone, "sid", "left_anti"))
    lead = cut_lineage(found)
    # every other row takes its best leader among those before the row itself
    own = rows.join(nodes, "s").join(lead.withColumn("leads", F.lit(True)), "sid", "left")
    is_leader = F.coalesce("leads", F.lit(False)) & (F.col("ord") == F.col("sid"))
    later = own.where(~is_leader)
    asked = later.select("sid").distinct()
    a = items.join(asked, "sid", "left_semi").withColumnRenamed("sid", "lid")
    b = items.join(lead, "sid", "left_semi").withColumnRenamed("sid", "rid")
    near = score_pairs(a.join(b, ["gram", "occ"]).select("lid", "rid").distinct(), nodes, nodes, threshold)
    best = (later.join(near, later.sid == near.lid).where(F.col("rid") < F.col("ord"))
            .groupBy("name", "ord").agg(F.min_by(F.struct("rid", "score"), F.struct(-F.col("score"), F.col("rid"))).alias("b"))
            .select("name", "ord", F.col("b.rid").alias("leader_ord"), F.col("b.score").alias("score")))
    best = best.join(rows.select(F.col("ord").alias("leader_ord"), F.col("name").alias("leader_name")), "leader_ord")
    return best.select("name", "ord", "leader_name", "leader_ord", "score").unionByName(
        own.where(is_leader).select("name", "ord", F.lit(None).cast("string").alias("leader_name"),
                                    F.lit(None).cast("long").alias("leader_ord"), F.lit(None).cast("double").alias("score")))
