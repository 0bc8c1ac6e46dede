"""Delta-encoded piece lists: choosing nodes, resolving chains, marking what is reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelume.functions import expr

#: Deltas between keyframes, and nodes that a walk may pass.
INTERVAL, WALK = 32, 64
#: Calls whose chains are walked level by level.
FEW = 64


def choose_nodes(lists: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """``kind`` (reuse, delta, keyframe) and ``depth`` of each list of a session, in order of ``pos``.

    ``lists(session_id, pos, entries array)``. A list that equals the one before reuses its
    node; one that extends it is a delta, unless its chain has ``interval`` deltas already.
    """
    return _chosen(lists, interval).drop("_prev")


def _chosen(lists: DataFrame, interval: int) -> DataFrame:
    """The same with the list before as ``_prev``; all windows have one order, so a session is sorted once."""
    by = Window.partitionBy("session_id").orderBy("pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    out = lists.withColumn("_prev", F.lag("entries").over(by))
    grows = F.coalesce(expr.is_prefix(F.col("_prev"), F.col("entries")), F.lit(False))
    out = out.withColumns({"_grows": grows, "_same": grows & (F.size("_prev") == F.size("entries"))})
    out = out.withColumn("_sum", F.sum((~F.col("_same")).cast("long")).over(so_far))
    # lists since the last one that did not grow: sums never fall, so that one has the largest of those
    out = out.withColumn("_n", F.col("_sum") - F.max(F.when(~F.col("_grows"), F.col("_sum"))).over(so_far))
    depth = F.col("_n") % (interval + 1)
    kind = F.when(F.col("_same"), "reuse").when(depth == 0, "keyframe").otherwise("delta")
    return out.withColumns({"kind": kind, "depth": depth}).drop("_grows", "_same", "_sum", "_n")


def build_nodes(lists: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """``lists`` with ``kind``, ``depth``, and the node that each resolves from: ``hash``, ``parent``, ``own``, and its JSON ``body``.

    Entries are ``k:hash`` with k of s, t, m. A node's bytes hold its parent's hash, and its own is theirs, so hashes follow from each
    other from a keyframe on: a fold over the nodes of one chain, of which there are ``interval`` + 1 at most. It is made in the keyframe's
    row, and the chain's other rows take their node from there, so lists that lie by session are neither shuffled nor joined.
    """
    so_far = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = _chosen(lists, interval).withColumn("_chain", F.sum((F.col("kind") == "keyframe").cast("long")).over(so_far))
    rest = F.slice("entries", F.size("_prev") + 1, F.greatest(F.size("entries") - F.size("_prev"), F.lit(0)))
    out = out.withColumn("own", F.when(F.col("kind") == "delta", rest).otherwise(F.col("entries"))).drop("_prev")
    chain = Window.partitionBy("session_id", "_chain").orderBy("pos")
    steps = F.collect_list(F.when(F.col("kind") != "reuse", F.struct("own"))).over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("_steps", F.when(F.col("kind") == "keyframe", steps))
    typed = lambda own: F.transform(own, lambda x: F.struct(F.substring(x, 1, 1).alias("k"), F.substring(x, 3, 64).alias("h")))
    start = F.array().cast("array<struct<hash:string,parent:string,body:string>>")

    def add(done, step):
        parent = F.element_at(done, -1)["hash"]
        return F.concat(done, F.transform(F.array(encode(typed(step["own"]), parent)), lambda body: F.struct(expr.content_hash(body).alias("hash"), parent.alias("parent"), body.alias("body"))))

    root = lambda step: F.transform(F.array(encode(typed(step["own"]), F.lit(None).cast("string"))), lambda body: F.struct(expr.content_hash(body).alias("hash"), F.lit(None).cast("string").alias("parent"), body.alias("body")))
    folded = F.aggregate("_steps", start, lambda done, step: F.when(F.size(done) == 0, root(step)).otherwise(add(done, step)))
    out = out.withColumn("_made", F.when(F.col("_steps").isNotNull(), folded)).drop("_steps")
    out = out.withColumn("_made", F.first("_made").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    node = F.get("_made", F.col("depth").cast("int"))
    return out.withColumns({c: node[c] for c in ("hash", "parent", "body")}).drop("_made", "_chain")


def stored_nodes(built: DataFrame) -> DataFrame:
    """``hash, body`` of what :func:`build_nodes` made, each once: content-addressed like any piece."""
    return built.where("kind <> 'reuse'").groupBy("hash").agg(F.any_value("body").alias("body"))


def read_nodes(stored: DataFrame) -> DataFrame:
    """``hash, parent, entries`` of the stored pieces that are nodes and hash to their key."""
    sound = stored.where(expr.content_hash(F.col("body").cast("string")) == F.col("hash")).select("hash", decode(F.col("body").cast("string")).alias("n"))
    return sound.where("n is not null").select("hash", F.col("n.p").alias("parent"), F.transform("n.e", lambda x: F.concat(x["k"], F.lit(":"), x["h"])).alias("entries"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share: plans do not grow, and a lost executor costs its tasks only."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or "/tmp/checkpoints")
    return df.checkpoint()


def _links(nodes: DataFrame) -> DataFrame:
    """``hash, up``: nodes and their parents, each node once."""
    return nodes.groupBy("hash").agg(F.any_value(F.struct("parent")).alias("n")).select("hash", F.col("n.parent").alias("up"))


def _walked(roots: DataFrame, nodes: DataFrame, walk: int) -> DataFrame:
    """``call, node, at`` of the chains of few roots, level by level: a level names its hashes, so that it reads only files and row groups that have them."""
    front = {(r.call, r.hash): r.hash for r in roots.collect()}
    rows = [(call, h, 0) for (call, h) in front]
    for at in range(1, walk + 1):
        wanted = sorted({h for h in front.values() if h is not None})
        if not wanted:
            break
        up = {r.hash: r.up for r in _links(nodes.where(F.col("hash").isin(wanted))).collect()}
        front = {key: up.get(h) for key, h in front.items() if h is not None}
        rows += [(call, h, at) for (call, _), h in front.items() if h is not None]
    return roots.sparkSession.createDataFrame(rows, roots.select("call", F.col("hash").alias("node"), F.lit(0).alias("at")).schema)


def _doubled(roots: DataFrame, nodes: DataFrame, walk: int) -> DataFrame:
    """The same of many roots: pointers of all nodes double, hashes only, and after k rounds a chain has 2^k nodes."""
    jump, seen = checkpointed(_links(nodes).where("up is not null")), roots.select("call", F.col("hash").alias("node"), F.lit(0).alias("at"))
    step = 1
    while step <= walk:
        far = seen.join(jump, seen.node == jump.hash).select("call", F.col("up").alias("node"), (F.col("at") + step).alias("at"))
        seen = checkpointed(seen.union(far).where(F.col("at") <= walk))
        if 2 * step <= walk:
            ahead = jump.select(F.col("hash").alias("up"), F.col("up").alias("next"))
            jump = checkpointed(jump.join(ahead, "up").select("hash", F.col("next").alias("up")))
        step *= 2
    return seen


def resolve(roots: DataFrame, nodes: DataFrame, walk: int = WALK, few: int = FEW) -> DataFrame:
    """``call, entries``: the concatenation, root first, of each call's chain.

    ``roots(call, hash)``, ``nodes(hash, parent, entries)``. All or nothing: a missing node, a cycle, or more than ``walk`` nodes gives
    null. First the chains are found, over hashes and parents alone; entries are joined once at the end. Up to ``few`` roots are
    walked level by level, and nothing but their chains is read; beyond that pointers double, in as many rounds as ``walk`` has bits.
    """
    asked = roots.select("call", "hash")
    at_once = len(asked.limit(few + 1).collect()) <= few
    chain = _walked(asked.where("hash is not null"), nodes, walk) if at_once else _doubled(asked.where("hash is not null"), nodes, walk)
    if at_once:
        # few roots, so at most few * (walk + 1) hashes
        nodes = nodes.where(F.col("hash").isin(sorted({r.node for r in chain.select("node").collect()})))
    content = nodes.groupBy("hash").agg(F.any_value(F.struct("parent", "entries")).alias("n"))
    found = chain.join(content, chain.node == content.hash, "left").groupBy("call", F.col("node").alias("_"), "at").agg(F.any_value("n").alias("n"))
    parts = found.groupBy("call").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("at"), F.col("n.entries").alias("e")))).alias("p"), F.max(F.struct("at", F.col("n").isNotNull().alias("there"), F.col("n.parent").isNull().alias("top"))).alias("end"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    good = parts.where(F.col("whole") & F.col("end.top") & (F.col("end.at") < walk))
    done = good.select("call", F.flatten(F.transform("p", lambda x: x["e"])).alias("entries"))
    return asked.join(done, asked.call.eqNullSafe(done.call), "left").select(asked.call, "entries")


def reachable(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hash`` of every node that ``roots(hash)`` reach over parents, cycles included.

    Pointers double, over hashes alone: a round adds to what is reached what lies as far again, so
    rounds are logarithmic in the longest chain. Each is written to the session's checkpoint folder, so plans do not grow.
    """
    jump, seen = checkpointed(_links(nodes).where("up is not null")), checkpointed(roots.select("hash").where("hash is not null").distinct())
    known = seen.count()
    while True:
        far = seen.join(jump, "hash").select(F.col("up").alias("hash"))
        seen = checkpointed(seen.union(far).distinct())
        # what lies twice as far is reached from the new ones, so nothing new means nothing further
        if (now := seen.count()) == known:
            return seen
        known = now
        ahead = jump.select(F.col("hash").alias("up"), F.col("up").alias("next"))
        jump = checkpointed(jump.join(ahead, "up").select("hash", F.col("next").alias("up")))


def missing(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hash`` of what is reached but not there: while there is any, marks are incomplete and nothing may be swept."""
    return live.select("hash").join(nodes.select("hash"), "hash", "left_anti")


def encode(entries, parent):
    """Canonical JSON of a node."""
    return F.to_json(F.struct(F.lit(3).alias("t"), parent.alias("p"), entries.alias("e")))


def decode(text):
    """A node from its JSON; null if a kind or a hash is malformed."""
    node = F.from_json(text, "t int, p string, e array<struct<k:string,h:string>>")
    hexed = "^[0-9a-f]{64}$"
    sound = (node["t"] == 3) & (node["p"].isNull() | node["p"].rlike(hexed)) & node["e"].isNotNull()
    sound = sound & F.forall(node["e"], lambda x: x["k"].isin("s", "t", "m") & x["h"].rlike(hexed))
    return F.when(F.coalesce(sound, F.lit(False)), node)
