"""Parent-child links to full hierarchies.

Rows (id, parent) form trees of unknown depth, with cycles and dangling parents among them.
Ids are cut into blocks; inside a block every chain of parents is contracted to its fragment's
top, the highest node whose parent lies elsewhere. The tops, far fewer than the nodes, form a
smaller forest of the same kind, which is solved by the same step with blocks eight times as
wide, until nothing leads out of a block. The answers then expand back level by level. Tops
that won't shrink (ids unrelated to the tree) are finished by pointer doubling in joins, so no
task ever needs more than one block of ids.

States, depths, roots and subtree sizes travel as numbers: a chain of n nodes costs n rows on each
level. Paths are written out only where they are asked for, a bounded piece at a time.

Defined results
---------------
* state ``ok``: the chain ends at a node with null parent; ``broken``: it ends at a parent that
  doesn't exist; ``loop``: the node lies on a cycle (a node that is its own parent does);
  ``under_loop``: its chain runs into a cycle.
* ``path`` lists the ids from the topmost node that exists down to the node, ``depth`` is the
  number of links in it; both, and ``root_id``, are null under and on cycles, ``root_id`` also
  for ``broken``. ``n_descendants`` is null under and on cycles, too.
* Rows with null id are no nodes. Of several rows with one id the largest parent counts, a null
  parent last; exact copies therefore count once.
* Empty tables give empty results. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut, width

#: Ids per block at the first level, bits more per level, and the rows a later block may hold.
BLOCK_BITS = 15
GROW_BITS = 3
BLOCK_ROWS = 400_000
#: Ids in a batch of paths.
PATH_IDS = 1_000_000

OK, BROKEN, LOOP, UNDER, OPEN = "ok", "broken", "loop", "under_loop", "open"

_FRAGMENTS = "id long, parent long, top long, exit long, dist long, link long, state string"


def contract(ids: np.ndarray, parents: np.ndarray, null: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contract the chains among ``ids`` (sorted, distinct) by doubling of their pointers.

    Returns for each node the index of its fragment's top (-1 on or under a local cycle), whether
    it lies on a local cycle, the index of its local parent (-1: none), and the weight of the links
    on its way to the top; a node's weight is that of the link to its parent.
    """
    n = len(ids)
    up = _local_parents(ids, parents, null)
    jump = np.where(up < 0, np.arange(n), up)
    dist = np.where(up >= 0, 1 if weights is None else weights, 0).astype(np.int64)
    for _ in range(int(n).bit_length()):  # 2^rounds >= n: a pointer still open then stands on a cycle
        dist = dist + dist[jump]
        jump = jump[jump]
    ends = up[jump] < 0
    on = np.zeros(n, dtype=bool)
    on[jump[~ends]] = True  # a jump permutes each cycle, so its image is the whole cycle
    return np.where(ends, jump, -1), on, up, dist


def _local_parents(ids: np.ndarray, parents: np.ndarray, null: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ids, parents)
    at[at == len(ids)] = 0
    return np.where(~null & (ids[at] == parents), at, -1)


def _links(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("id", ignore_index=True)
    return pdf, pdf["id"].to_numpy(dtype=np.int64), pdf["parent"].fillna(0).to_numpy(dtype=np.int64), pdf["parent"].isna().to_numpy()


def _contract_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, ids, parents, null = _links(pdf)
    weights = pdf["w"].to_numpy(dtype=np.int64)
    top, on, _, dist = contract(ids, parents, null, weights)
    cyclic = top < 0
    t = np.where(cyclic, 0, top)
    closed = cyclic | null[t]
    return pd.DataFrame(
        {
            "id": ids,
            "parent": pdf["parent"],
            "top": pd.Series(ids[t], dtype="Int64").mask(cyclic),
            "exit": pd.Series(parents[t], dtype="Int64").mask(closed),
            "dist": dist,
            "link": np.where(closed, 0, weights[t]),
            "state": np.where(cyclic, np.where(on, LOOP, UNDER), OPEN),
        }
    )


def _mark_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ids on the local ways up from the marked ones."""
    pdf, ids, parents, null = _links(pdf)
    up = _local_parents(ids, parents, null)
    jump, mark = np.where(up < 0, np.arange(len(ids)), up), pdf["mark"].to_numpy(dtype=bool).copy()
    for _ in range(int(len(ids)).bit_length()):
        mark[jump[mark]] = True
        jump = jump[jump]
    return pd.DataFrame({"id": ids[mark]})


def _sum_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of ``value`` over each node's local subtree."""
    pdf, ids, parents, null = _links(pdf)
    up = _local_parents(ids, parents, null)
    n = len(ids)
    jump, total = np.append(np.where(up < 0, n, up), n), np.append(pdf["value"].to_numpy(dtype=np.int64), 0)
    for _ in range(int(n).bit_length()):
        more = np.zeros_like(total)
        np.add.at(more, jump, total)
        more[n] = 0
        total, jump = total + more, jump[jump]
    return pd.DataFrame({"id": ids, "total": total[:n]})


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks from rows that are sorted by block."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        edges = [0, *(np.flatnonzero(np.diff(pdf["block"].to_numpy())) + 1).tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:]):
            part = pdf.iloc[a:b]
            if held and len(part) and held[0]["block"].iloc[0] != part["block"].iloc[0]:
                yield pd.concat(held)
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pd.concat(held)


def _written(wanted_only: bool):
    """Ways from the tops, exclusive (or full paths, where tops have a ``front``), down to the nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            pdf, ids, parents, null = _links(block)
            up = _local_parents(ids, parents, null).tolist()
            own = pdf["way"].tolist()
            front = pdf["front"].tolist() if not wanted_only else None
            wanted = np.flatnonzero(pdf["wanted"].to_numpy(dtype=bool)).tolist() if wanted_only else range(len(ids))
            out_ids, out, size = [], [], 0
            for i in wanted:
                parts, at = [], i
                while up[at] >= 0:
                    parts.append(own[at])
                    at = up[at]
                if front is not None:
                    parts.append(front[at])
                path = np.concatenate(parts[::-1]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
                out_ids.append(ids[i])
                out.append(path)
                size += len(path)
                if size >= PATH_IDS:
                    yield pd.DataFrame({"id": out_ids, "way": out})
                    out_ids, out, size = [], [], 0
            if out:
                yield pd.DataFrame({"id": out_ids, "way": out})

    return run


def _block(bits: int):
    return F.shiftright("id", bits) if bits < 63 else F.lit(0).cast("long")


def _by_block(df: DataFrame, bits: int, wanted_only: bool) -> DataFrame:
    rows = df.withColumn("block", _block(bits)).repartition(width(df.sparkSession), "block").sortWithinPartitions("block")
    return rows.mapInPandas(_written(wanted_only), "id long, way array<long>")


class _Level:
    """Links (id, parent, w), contracted; ``deeper`` holds the links between its fragments.

    ``answers`` is (id, top, exit, dist, link, state) over all the level's links: the highest node
    of the level on the id's chain, where its parent points (null: nowhere), the weight of the links
    to the top and of the top's own link, and ``open``, ``loop`` or ``under_loop``.
    """

    def __init__(self, nodes: DataFrame, bits: int, blocks: bool = True):
        self.bits, self.deeper, self.blocks = bits, None, blocks
        if not blocks:
            self.frag, self.answers = nodes, _double(nodes)
            return
        self.frag = cut(nodes.groupBy(_block(bits)).applyInPandas(lambda pdf: _contract_block(pdf), _FRAGMENTS))
        plain = self.frag.select("id", "top", "exit", "dist", "link", "state")
        tops = plain.where("id = top and exit is not null").select("id", "exit", "link")
        met = tops.join(plain.select(F.col("id").alias("exit"), F.col("top").alias("to"), F.col("dist").alias("ahead"), F.col("state").alias("met")), "exit")
        self.links = cut(met.select("id", F.when(F.col("met") == OPEN, F.col("to")).alias("parent"), (F.col("link") + F.col("ahead")).alias("w"), "exit"))
        onward = self.links.where("parent is not null").select("id", "parent", "w")
        under = self.links.where("parent is null").select(F.col("id").alias("top"), F.lit(UNDER).alias("end"))
        n = onward.count()
        if n:
            self.deeper = _Level(onward, *_wider(onward, n, bits))
            self.answers = self._expanded(plain, under)
        else:
            self.answers = plain.join(under, "top", "left").select("id", "top", "exit", "dist", "link", F.coalesce("end", "state").alias("state"))

    def _expanded(self, plain: DataFrame, under: DataFrame) -> DataFrame:
        q = self.deeper.answers.select(F.col("id").alias("top"), F.col("exit").alias("goal"), (F.col("dist") + F.col("link")).alias("far"), F.col("state").alias("q_state"))
        # the deeper chains end at fragments that lead nowhere further inside this level
        last = plain.where("id = top").join(under, "top", "left").select(F.col("top").alias("goal"), F.col("exit").alias("last"), F.col("link").alias("last_link"), F.coalesce("end", "state").alias("goal_state"))
        far = q.join(last, "goal", "left").select("top", "goal", "last", "far", "last_link", F.when(F.col("q_state") != OPEN, F.col("q_state")).otherwise(F.col("goal_state")).alias("end"))
        none = _null_long()
        ends = cut(far.unionByName(under.select("top", none.alias("goal"), none.alias("last"), none.alias("far"), none.alias("last_link"), "end")))
        out = plain.join(ends, "top", "left")
        state = F.coalesce("end", "state")
        loops = ends.where(F.col("end") == LOOP).select("top")
        if not loops.isEmpty():  # of a fragment whose top is on a cycle, only the nodes on the way through are
            entries = self.links.join(loops.withColumnRenamed("top", "id"), "id", "left_semi").select(F.col("exit").alias("id"), F.lit(True).alias("mark")).distinct()
            rows = self.frag.join(loops, "top", "left_semi").join(entries, "id", "left").select("id", "parent", F.coalesce("mark", F.lit(False)).alias("mark"))
            on = rows.groupBy(_block(self.bits)).applyInPandas(lambda pdf: _mark_block(pdf), "id long").withColumn("hit", F.lit(True))
            out = out.join(on, "id", "left")
            state = F.when((F.col("end") == LOOP) & F.col("hit").isNull(), F.lit(UNDER)).otherwise(state)
        pick = lambda a, b: F.when(F.col("end").isNull(), F.col(a)).otherwise(F.col(b))
        return out.select("id", pick("top", "goal").alias("top"), pick("exit", "last").alias("exit"), (F.col("dist") + F.coalesce("far", F.lit(0))).alias("dist"), pick("link", "last_link").alias("link"), state.alias("state"))

    # sizes ---------------------------------------------------------------------
    def sums(self, values: DataFrame) -> DataFrame:
        """(id, total): sums of ``value`` over subtrees; ``values`` (id, value) leaves cycles out."""
        if not self.blocks:
            return _double_sums(self.frag.join(values, "id"))
        rows = self.frag.select("id", "parent", "top").join(values, "id")
        if self.deeper is not None:
            rows = cut(rows)
            inside = self.links.where("parent is not null").select(F.col("id").alias("top"))
            whole = rows.groupBy("top").agg(F.sum("value").alias("value")).join(inside, "top", "left_semi").withColumnRenamed("top", "id")
            below = self.deeper.sums(whole)
            more = self.links.join(below, "id").groupBy(F.col("exit").alias("id")).agg(F.sum("total").alias("more"))
            rows = rows.join(more, "id", "left").select("id", "parent", (F.col("value") + F.coalesce("more", F.lit(0))).alias("value"))
        return rows.groupBy(_block(self.bits)).applyInPandas(lambda pdf: _sum_block(pdf), "id long, total long")

    # paths ---------------------------------------------------------------------
    def paths(self, ways: DataFrame) -> DataFrame:
        """(id, way) from the topmost node of the level, inclusive; ``ways`` (id, way) leaves cycles out."""
        if not self.blocks:
            return _double_paths(self.frag.join(ways, "id"))
        rows = self.frag.select("id", "parent", "top").join(ways, "id")
        front = F.when(F.col("id") == F.col("top"), F.col("way"))
        if self.deeper is not None:
            rows = cut(rows)
            links = self.links.where("parent is not null").join(ways.select("id", F.col("way").alias("own")), "id")
            wanted = links.select(F.col("exit").alias("id")).distinct().withColumn("wanted", F.lit(True))
            leads = _by_block(rows.join(wanted, "id", "left").select("id", "parent", "way", F.coalesce("wanted", F.lit(False)).alias("wanted")), self.bits, True)
            # a link's way begins behind the top of the fragment it leads into
            steps = links.join(leads.select(F.col("id").alias("exit"), F.col("way").alias("lead")), "exit").select("id", "parent", F.concat("lead", "own").alias("way"))
            steps = cut(steps)
            tails = self.deeper.paths(steps.select("id", "way"))
            # a chain of links ends at the fragment that the highest link leads into
            goals = self.deeper.answers.select("id", F.col("exit").alias("goal"))
            base = rows.select(F.col("id").alias("goal"), F.col("way").alias("head")).join(goals.select("goal").distinct(), "goal", "left_semi")
            fronts = tails.withColumnRenamed("way", "tail").join(goals, "id").join(base, "goal").select("id", F.concat("head", "tail").alias("far"))
            rows = rows.join(fronts, "id", "left")
            front = F.when(F.col("id") == F.col("top"), F.coalesce("far", "way"))
        return _by_block(rows.select("id", "parent", "way", front.alias("front")), self.bits, False)


def _null_long():
    return F.lit(None).cast("long")


def _wider(links: DataFrame, n: int, bits: int) -> tuple[int, bool]:
    """Widen the blocks as far as their rows allow; where even wider ones hold too many, double pointers."""
    if n <= BLOCK_ROWS:
        return 63, True
    bits += GROW_BITS
    most = links.groupBy(F.shiftright("id", bits)).count().agg(F.max("count")).first()[0]
    return bits, most <= BLOCK_ROWS


def _inside(nodes: DataFrame) -> DataFrame:
    """Links with ``there``: the parent is a node of the level."""
    return nodes.join(nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def _double(nodes: DataFrame) -> DataFrame:
    """Pointer doubling in joins, for links that no block layout contracts. Answers as of a level."""
    start = _inside(nodes).select("id", F.when(F.col("there"), F.col("parent")).otherwise(F.col("id")).alias("at"), F.when(F.col("there"), F.col("w")).otherwise(0).alias("dist"), F.col("there").alias("open"))
    now = cut(start)
    done, left = now.where("not open"), now.where("open").count()
    going = now.where("open")
    for _ in range(max(2, now.count()).bit_length()):  # 2^rounds >= n: what is still open then is cyclic
        if not left:
            break
        step = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("dist").alias("more"), F.col("open").alias("on"))
        going = going.join(step, "at").select("id", F.col("next").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), F.col("on").alias("open"))
        now = cut(done.unionByName(going))
        done, going = now.where("not open"), now.where("open")
        left = going.count()
    exits = nodes.select(F.col("id").alias("at"), F.col("parent").alias("exit"), "w")
    closed = done.join(exits, "at").select("id", F.col("at").alias("top"), "exit", "dist", F.when(F.col("exit").isNotNull(), F.col("w")).otherwise(0).alias("link"), F.lit(OPEN).alias("state"))
    if not left:
        return closed
    on = going.select(F.col("at").alias("id")).distinct().withColumn("hit", F.lit(True))
    loops = going.join(on, "id", "left").select("id", _null_long().alias("top"), _null_long().alias("exit"), "dist", F.lit(0).cast("long").alias("link"), F.when(F.col("hit"), F.lit(LOOP)).otherwise(F.lit(UNDER)).alias("state"))
    return closed.unionByName(loops)


def _double_sums(rows: DataFrame) -> DataFrame:
    """Subtree sums of (id, parent, value) by doubling: after k rounds, of all less than 2^k links below."""
    now = cut(_inside(rows).select("id", F.when(F.col("there"), F.col("parent")).alias("at"), F.col("value").alias("total")))
    while not now.where("at is not null").isEmpty():
        more = now.where("at is not null").groupBy(F.col("at").alias("id")).agg(F.sum("total").alias("more"))
        step = now.select(F.col("id").alias("at"), F.col("at").alias("next"))
        now = cut(now.join(more, "id", "left").join(step, "at", "left").select("id", F.col("next").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
    return now.select("id", "total")


def _double_paths(rows: DataFrame) -> DataFrame:
    """Ways of (id, parent, way) from the topmost node of the level; a way never exceeds the true path."""
    now = cut(_inside(rows).select("id", F.when(F.col("there"), F.col("parent")).alias("at"), "way"))
    while not now.where("at is not null").isEmpty():
        step = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("way").alias("front"))
        now = cut(now.join(step, "at", "left").select("id", F.col("next").alias("at"), F.when(F.col("front").isNotNull(), F.concat("front", "way")).otherwise(F.col("way")).alias("way")))
    return now.select("id", "way")


class Hierarchy:
    """The solved forest."""

    def __init__(self, level: _Level):
        self.level = level
        self._solved = None

    def states(self) -> DataFrame:
        """(id, state)."""
        return self.level.answers.select("id", self._state().alias("state"))

    @staticmethod
    def _state():
        return F.when(F.col("state") != OPEN, F.col("state")).when(F.col("exit").isNull(), F.lit(OK)).otherwise(F.lit(BROKEN))

    def nodes(self) -> DataFrame:
        """(id, state, depth, root_id); written once, as paths and sizes go on from it."""
        if self._solved is None:
            a = self.level.answers.select("id", self._state().alias("state"), "top", "dist")
            sound = F.col("state").isin(OK, BROKEN)
            self._solved = cut(a.select("id", "state", F.when(sound, F.col("dist")).cast("int").alias("depth"), F.when(F.col("state") == OK, F.col("top")).alias("root_id")))
        return self._solved

    def _sound(self) -> DataFrame:
        return self.nodes().where("depth is not null").select("id")

    def summary(self) -> DataFrame:
        """(id, state, depth, root_id, n_descendants), without any path."""
        sizes = self.level.sums(self._sound().withColumn("value", F.lit(1).cast("long")))
        return self.nodes().join(sizes.select("id", (F.col("total") - 1).alias("n_descendants")), "id", "left")

    def ways(self) -> DataFrame:
        """(id, path) of the nodes off the cycles."""
        return self.level.paths(self._sound().withColumn("way", F.array("id"))).withColumnRenamed("way", "path")

    def paths(self) -> DataFrame:
        """(id, state, path, depth, root_id, n_descendants)."""
        return self.summary().join(self.ways(), "id", "left").select("id", "state", "path", "depth", "root_id", "n_descendants")

    def descendants(self) -> DataFrame:
        """(id, descendant_id, distance): every node below each node, off the cycles."""
        size = F.size("path")
        return self.ways().where(size > 1).select(
            F.col("id").alias("descendant_id"), (size - 1).alias("_n"), F.posexplode(F.slice("path", 1, size - 1)).alias("_pos", "id")
        ).select("id", "descendant_id", (F.col("_n") - F.col("_pos")).alias("distance"))


def resolve(df: DataFrame, id_col: str, parent_col: str, block_bits: int = BLOCK_BITS) -> Hierarchy:
    """Solve the forest of ``df``; see the module's docstring for the defined results."""
    nodes = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("parent").alias("parent"))
        .withColumn("w", F.lit(1).cast("long"))
    )
    return Hierarchy(_Level(nodes, block_bits))
