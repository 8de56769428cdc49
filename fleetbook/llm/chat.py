"""Reply trees formatted as conversations, with DataFrame and SQL functions only.

``link_turns`` turns rows ordered by turn into reply-tree nodes (parent = the row before).
``reply_paths`` enumerates root-to-leaf paths of any reply forest by iterative self-joins
(pointer doubling: each round doubles the distance of the ancestor pointer, so a chain of n
messages takes log2 n rounds), ranks the leaves of each tree by the score summed along their
path and keeps the best ``branches``.  ``format_paths`` writes each kept path as one text with
marked turns and a loss mask; ``read_back`` parses that text into its turns again.

Defined cases: null text or role is the empty string; rows repeating a (conv, turn) are
separate turns, ordered by role, then text; null turns come first; a parent that is not in its
conversation makes the message a root; a message on a cycle has no root and is reported by no
path; ties in the ranking go to the smallest node id; empty tables give empty results; columns
other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetbook.llm.common import stored

#: Template: "### <role>: <text></turn>\n" per turn.  Inside roles and texts a backslash
#: protects the character after it; both marks are broken up by one, so neither occurs.
OPEN, CLOSE, SEP = "### ", "</turn>\n", ": "


def escape(col):
    """Break up the marks reversibly: every added backslash protects the next character."""
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    col = F.replace(col, F.lit("##"), F.lit("#\\#"))
    return F.replace(col, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(col):
    return F.replace(escape(col), F.lit(":"), F.lit("\\:"))


def unescape(col):
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def link_turns(rows: DataFrame) -> DataFrame:
    """Nodes (conv_id, node_id, parent_id, score, role, text) of conversations given by turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(order).cast("long")
    return (rows.withColumn("node_id", nth)
            .withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))
            .withColumn("score", F.lit(0.0))
            .select("conv_id", "node_id", "parent_id", "score", "role", "text"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows (conv_id, path_id, position, role, text): the kept root-to-leaf paths.

    ``path_id`` is the node id of the path's leaf.  Node ids are unique in a conversation; of
    repeated ids the row with the smallest (role, text) counts.
    """
    one = nodes.groupBy("conv_id", "node_id").agg(
        F.min(F.struct("role", "text", "parent_id", "score")).alias("v"))
    base = stored(one.select("conv_id", "node_id", "v.parent_id",
                             F.coalesce("v.score", F.lit(0.0)).alias("score"), "v.role", "v.text"),
                  "chat-nodes")
    slim = base.select("conv_id", "node_id", "parent_id", "score")
    known = slim.select("conv_id", F.col("node_id").alias("up"))
    # jump tables: node -> ancestor 2**k above (null above the root), score summed on the way
    step = stored(
        slim.join(known.withColumnRenamed("conv_id", "c2"),
                  (F.col("conv_id").eqNullSafe(F.col("c2"))) & (F.col("parent_id") == F.col("up")), "left")
        .select("conv_id", "node_id", "up", F.col("score").alias("gain"), F.lit(1).cast("long").alias("steps")),
        "chat-step")
    # only nodes that are still below their root take part in a round
    done, active, jumps = [step.filter(F.col("up").isNull())], step.filter(F.col("up").isNotNull()), []
    longest = base.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest and not active.isEmpty():
        jumps.append(active)
        far = reduce(DataFrame.unionByName, done, active).select(
            F.col("conv_id").alias("c2"), F.col("node_id").alias("n2"), F.col("up").alias("up2"),
            F.col("gain").alias("gain2"), F.col("steps").alias("steps2"))
        step = stored(
            active.join(far, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("n2")))
            .select("conv_id", "node_id", F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain"),
                    (F.col("steps") + F.col("steps2")).alias("steps")), "chat-step")
        done.append(step.filter(F.col("up").isNull()))
        active = step.filter(F.col("up").isNotNull())
        reach *= 2
    # what is still active lies on a cycle
    whole = reduce(DataFrame.unionByName, done).select("conv_id", "node_id", "gain", "steps")
    inner = (jumps[0] if jumps else active).select("conv_id", F.col("up").alias("node_id")).distinct()
    leaves = _anti(whole, inner)
    roots = _roots(leaves, jumps)
    best = Window.partitionBy("conv_id", "root").orderBy(F.desc("gain"), "node_id")
    chosen = (roots.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= branches)
              .select("conv_id", F.col("node_id").alias("path_id"), "node_id"))
    # mark the ancestors of the chosen leaves, jumping 2**k, 2**(k-1), .., 1
    on_path = stored(chosen, "chat-path")
    for jump in reversed(jumps):
        hop = jump.select(F.col("conv_id").alias("c2"), F.col("node_id").alias("n2"), "up")
        above = on_path.join(hop, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("node_id") == F.col("n2"))) \
            .select("conv_id", "path_id", F.col("up").alias("node_id"))
        on_path = stored(on_path.unionByName(above), "chat-path")
    place = whole.select(F.col("conv_id").alias("c2"), F.col("node_id").alias("n2"), F.col("steps").alias("position"))
    told = base.select(F.col("conv_id").alias("c3"), F.col("node_id").alias("n3"), "role", "text")
    return (on_path
            .join(place, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("node_id") == F.col("n2")))
            .join(told, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("node_id") == F.col("n3")))
            .select("conv_id", "path_id", "position", "role", "text"))


def _anti(left: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col("conv_id").alias("c2"), F.col("node_id").alias("n2"))
    return left.join(k, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("node_id") == F.col("n2")), "left_anti")


def _roots(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """Leaves with the root of their tree: take every jump, longest first, that stays inside."""
    at = leaves.withColumn("root", F.col("node_id"))
    for jump in reversed(jumps):
        hop = jump.select(F.col("conv_id").alias("c2"), F.col("node_id").alias("n2"), "up")
        at = at.join(hop, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("root") == F.col("n2")), "left") \
            .select("conv_id", "node_id", "gain", F.coalesce("up", "root").alias("root"))
    return at.select("conv_id", "node_id", "gain", "root")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: conv_id, path_id, ``segments`` (text, loss) whose texts put together
    are ``formatted``; a segment is under the loss mask if it is an assistant's (escaped) text."""
    turns = paths.groupBy("conv_id", "path_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    seg = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))))
    out = turns.select("conv_id", "path_id", seg.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted):
    """Column: array of (role, text) parsed from a formatted conversation."""
    pieces = F.slice(F.split(formatted, CLOSE), 1, F.size(F.split(formatted, CLOSE)) - 1)
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, head, 1)).alias("role"),
        unescape(F.regexp_extract(p, head, 2)).alias("text")))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per formatted path the digests of its turns and of its loss-masked text, read back."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss_text", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                    F.char_length("loss_text").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))
