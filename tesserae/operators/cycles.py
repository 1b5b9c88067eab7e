"""Strongly connected components and cycle entropy.

Large graphs are contracted first: the edges are dealt to parts, a task finds its part's components, and what is left are the edges between
these. Edges that parts don't bring together are searched forwards and backwards from all nodes at once, in joins. Each phase gives the nodes random names; a node learns
the least name among those that reach it and among those it reaches. Besides the edges, what is learnt so far is a path, too: from the
least name found to the node, and from the node to the other. These shortcuts double the paths that a round covers, so a phase
takes some rounds for each doubling of a component's depth, where a walk takes as many rounds as it is deep. Where both names are the same
the node and its namesake reach each other: that is a component. All other components have their edges between nodes
with the same two names; edges between others are dropped, which parts a long chain of components at random places, and the next
phase takes what is left. Small graphs, many at once, go through one task each instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.governance import PrefixIndex, Subsystems, constants
from tesserae.operators.metrics import CYCLE_RELATIONS, graphs, ratio
from tesserae.schema import KEY
from tesserae.storage import Steps, stored

#: A graph of more edges than this is never collected into one task.
GROUPED_EDGES = 100_000
#: Edges of a part that one task contracts.
PART_EDGES = 1_000_000
#: So many nodes, 8 bytes each, may be sent to every task; edges are shuffled to more.
SENT_NODES = 2_000_000
#: Rounds of trimming before a phase, which only save it work.
TRIMMED = 3
_PAIR = [*KEY, "a", "b"]


def _pairs(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """(key, a, b) of the relations with both ends resolved."""
    rows = edges.where(F.col("relation").isin(*relations) & F.col("src_resolved") & F.col("dst_resolved"))
    return rows.select(*KEY, F.col("src_id").alias("a"), F.col("dst_id").alias("b"))


def adjacency(edges: DataFrame, relations: Sequence[str] = CYCLE_RELATIONS) -> DataFrame:
    """Distinct (key, a, b) of the relations with both ends resolved."""
    return _pairs(edges, relations).distinct()


def tarjan(pairs: list[tuple]) -> dict:
    """The least id of each node's component. Recursion is a stack of its own, so chains may be of any length."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    label: dict = {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group.append(x)
                        if x == v:
                            break
                    least = min(group)
                    label.update(dict.fromkeys(group, least))
            elif w not in index:
                index[w] = low[w] = len(index)
                stack.append(w)
                on.add(w)
                work.append((w, iter(out[w])))
            elif w in on:
                low[v] = min(low[v], index[w])
    return label


def _reached(step: np.ndarray, at: np.ndarray, start: int, n: int) -> np.ndarray:
    """Which of n nodes a walk from start comes to; step holds the successors of node i at at[i] to at[i + 1]."""
    seen = np.zeros(n, bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        count = at[front + 1] - at[front]
        place = np.arange(count.sum()) + np.repeat(at[front] - (np.cumsum(count) - count), count)
        front = np.unique(step[place])
        front = front[~seen[front]]
        seen[front] = True
    return seen


def labels(a: np.ndarray, b: np.ndarray, n: int, pivots: int = 4) -> np.ndarray:
    """The least node of each node's component, of edges between nodes 0 to n - 1.

    Nodes without an edge in or out are trimmed and the components of the busiest nodes found by walks, all in arrays;
    what is left goes through tarjan().
    """
    out = np.arange(n)
    for _ in range(pivots):
        for _ in range(64):
            live = np.zeros(n, bool)
            live[a] = True
            into = np.zeros(n, bool)
            into[b] = True
            live &= into
            keep = live[a] & live[b]
            if keep.all():
                break
            a, b = a[keep], b[keep]
        if not len(a):
            return out
        start = int(np.argmax(np.bincount(a, minlength=n) * np.bincount(b, minlength=n)))
        both = np.ones(n, bool)
        for x, y in ((a, b), (b, a)):
            order = np.argsort(x, kind="stable")
            both &= _reached(y[order], np.searchsorted(x[order], np.arange(n + 1)), start, n)
        out[both] = np.flatnonzero(both)[0]
        keep = ~both[a] & ~both[b]
        a, b = a[keep], b[keep]
    for node, least in tarjan(list(zip(a.tolist(), b.tolist()))).items():
        out[node] = least
    return out


def grouped_components(pairs: DataFrame) -> DataFrame:
    """(key, id, scc) of graphs that fit one task each."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([g["a"], g["b"]], ignore_index=True), sort=True)
        least = labels(codes[: len(g)], codes[len(g) :], len(names))
        return pd.DataFrame({"subject_id": g["subject_id"].iloc[0], "scan_id": g["scan_id"].iloc[0], "id": names, "scc": names[least]})

    return pairs.groupBy(*KEY).applyInPandas(run, "subject_id string, scan_id string, id string, scc string")


def _trimmed(steps: Steps, pairs: DataFrame, rounds: list[str]) -> DataFrame:
    """pairs without most of the nodes that lack an edge in or out."""
    n = pairs.count()
    for _ in range(TRIMMED):
        both = pairs.select(F.col("b").alias("v")).intersect(pairs.select(F.col("a").alias("v")))
        pairs = steps.keep("pairs", pairs.join(both.withColumnRenamed("v", "a"), "a", "left_semi").join(both.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b"))
        rounds.append("trim")
        n, before = pairs.count(), n
        if n == before:
            break
    return pairs


def _least_names(steps: Steps, named: DataFrame, rounds: list[str]) -> DataFrame:
    """(n, up, down): the least name that reaches each node, and the least that it reaches, itself included."""
    ends = named.select(F.col("a").alias("n")).union(named.select(F.col("b").alias("n"))).distinct()
    state = steps.keep("state", ends.select("n", F.col("n").alias("up"), F.col("n").alias("down"), F.lit(True).alias("moved")))
    while True:
        shortcuts = state.where("up < n").select(F.col("up").alias("a"), F.col("n").alias("b")).union(state.where("down < n").select(F.col("n").alias("a"), F.col("down").alias("b")))
        links = named.select("a", "b").union(shortcuts)
        none = F.lit(None).cast("long")
        ahead = links.join(state.select(F.col("n").alias("a"), "up"), "a").select(F.col("b").alias("n"), "up", none.alias("down"), none.alias("was_up"), none.alias("was_down"))
        back = links.join(state.select(F.col("n").alias("b"), "down"), "b").select(F.col("a").alias("n"), none.alias("up"), "down", none.alias("was_up"), none.alias("was_down"))
        own = state.select("n", "up", "down", F.col("up").alias("was_up"), F.col("down").alias("was_down"))
        met = ahead.union(back).union(own).groupBy("n").agg(*[F.min(c).alias(c) for c in ("up", "down", "was_up", "was_down")])
        state = steps.keep("state", met.select("n", "up", "down", ((F.col("up") < F.col("was_up")) | (F.col("down") < F.col("was_down"))).alias("moved")))
        rounds.append("names")
        if state.where("moved").isEmpty():
            return state.drop("moved")


def distributed_components(pairs: DataFrame, grouped_edges: int = 0, rounds: list[str] | None = None, max_phases: int = 1000) -> DataFrame:
    """(key, id, scc) of the nodes that lie on cycles, for graphs of any size; others are left out.

    What is left at the end of a phase goes through one task when it has at most grouped_edges edges. rounds, if given, gets
    an entry for each round.
    """
    spark, rounds = pairs.sparkSession, [] if rounds is None else rounds
    steps, done = Steps(spark, "scc"), []
    loose = pairs.where("a <> b")
    ids = stored(loose.select(*KEY, F.col("a").alias("id")).union(loose.select(*KEY, F.col("b").alias("id"))).distinct().withColumn("v", F.monotonically_increasing_id()), "scc")
    end = lambda x: ids.select(*KEY, F.col("id").alias(x), F.col("v").alias(f"v{x}"))
    left = steps.keep("pairs", loose.join(end("a"), [*KEY, "a"]).join(end("b"), [*KEY, "b"]).select(F.col("va").alias("a"), F.col("vb").alias("b")))
    for phase in range(max_phases):
        left = _trimmed(steps, left, rounds)
        if left.count() <= grouped_edges:
            break
        # names are a hash that takes no two longs to one, another for each phase
        name = lambda c: F.xxhash64(F.lit(phase), c)  # noqa: B023, E731
        state = _least_names(steps, left.select(name("a").alias("a"), name("b").alias("b")), rounds)
        done.append(stored(state.where("up = down").join(ids.withColumn("n", name("v")), "n").select(*KEY, "id", "up"), "scc"))
        open_ = state.where("up <> down")
        side = lambda x: open_.select(F.col("n").alias(f"n{x}"), F.col("up").alias(f"up{x}"), F.col("down").alias(f"down{x}"))  # noqa: B023, E731
        inner = left.withColumns({"na": name("a"), "nb": name("b")}).join(side("a"), "na").join(side("b"), "nb").where("upa = upb and downa = downb")
        left = steps.keep("pairs", inner.select("a", "b"))
        rounds.append("cut")
    else:
        raise RuntimeError("components did not settle")
    out = spark.createDataFrame([], "subject_id string, scan_id string, id string, scc string")
    for d in done:
        least = d.groupBy("up").agg(F.min("id").alias("scc"))
        out = out.unionByName(d.join(least, "up").select(*KEY, "id", "scc"))
    if grouped_edges and not left.isEmpty():
        back = lambda x: ids.select(*KEY, F.col("id").alias(f"id{x}"), F.col("v").alias(x))
        rest = left.join(back("a"), "a").join(back("b").drop(*KEY), "b").select(*KEY, F.col("ida").alias("a"), F.col("idb").alias("b"))
        out = out.unionByName(stored(grouped_components(rest), "scc"))
    steps.drop("pairs", "state")
    return out


def _contracted(a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, least of its component) of nodes on cycles of these edges, and the other edges between leasts, each once.

    whole says of an edge that all edges into its a are here: without one a lies on no cycle, and its edges go.
    """
    while whole.any():
        dead = whole & ~np.isin(a, b)
        if not dead.any():
            break
        a, b, whole = a[~dead], b[~dead], whole[~dead]
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = codes[: len(a)], codes[len(a) :]
    least = labels(ca, cb, len(names))
    on = np.bincount(least, minlength=len(names))[least] > 1
    x, y = least[ca], least[cb]
    rest = np.unique(np.stack([x, y])[:, x != y], axis=1)
    return names[on], names[least[on]], names[rest[0]], names[rest[1]]


def _contraction(steps: Steps, pairs: DataFrame, degrees: DataFrame, n: int, least_parts: int) -> tuple[DataFrame, DataFrame]:
    """((v, rep) of nodes that lie on a cycle of one part's edges, the edges between representatives).

    An edge's home is its target, or its source where the target is busy, so that all edges of a quiet node meet in one part; those
    between busy nodes go anywhere, so no part follows a busy node. A part's components are found by one task. A node's representative is the least of its names in all
    parts, tied to its other names by edges both ways, so nothing that is connected comes apart.
    """
    most = 4.0 * degrees.agg((F.sum("into") + F.sum("out_of")) / F.count("*")).first()[0]
    busy, last, first = F.col("into") + F.col("out_of") > most, F.col("out_of") == 0, F.col("into") == 0
    sizes = degrees.agg(F.count_if(busy), F.count_if(last), F.count_if(first)).first()

    def listed(which: int, of: Column, name: str, *more: Column) -> DataFrame:
        """Nodes for a join: they are few beside the edges, so while their number is bounded the edges stay where they are."""
        found = degrees.where(of).select(F.col("v").alias(name), *more)
        return F.broadcast(found) if sizes[which] <= SENT_NODES else found

    # no cycle goes through a node that nothing leaves or nothing enters
    ends = pairs.join(listed(1, last, "b"), "b", "left_anti").join(listed(2, first, "a"), "a", "left_anti")
    for x in ("a", "b"):
        ends = ends.join(listed(0, busy, x, F.lit(True).alias(f"busy_{x}")), x, "left")
    # 0: at home at its target, 1: at its source, 2: anywhere
    homed = ends.select("a", "b", F.when(F.col("busy_b").isNull(), 0).when(F.col("busy_a").isNull(), 1).otherwise(2).cast("byte").alias("at"))
    home = F.when(F.col("at") == 0, F.col("b")).when(F.col("at") == 1, F.col("a")).otherwise(F.xxhash64("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*[[c.to_numpy(zero_copy_only=False) for c in x.columns] for x in batches]))
        if columns:
            node, least, x, y = _contracted(*[np.concatenate(c) for c in columns])
            kind = np.repeat([True, False], [len(node), len(x)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([node, x])), pa.array(np.concatenate([least, y]))], ["named", "x", "y"])

    parts = max(least_parts, -(-n // PART_EDGES))
    found = steps.keep("found", homed.repartition(parts, home).select("a", "b", (F.col("at") == 1).alias("whole")).mapInArrow(run, "named boolean, x long, y long"))
    names = found.where("named").groupBy("x").agg(F.min("y").alias("rep"), F.collect_set("y").alias("all"))
    names = steps.keep("names", names.select(F.col("x").alias("v"), "rep", F.filter("all", lambda y: y != F.col("rep")).alias("others")))
    reps = stored(names.select("v", "rep"), "scc")
    rep = lambda x: reps.select(F.col("v").alias(x), F.col("rep").alias(f"r{x}"))
    tied = names.select("rep", F.explode("others").alias("b"))
    rest = found.where("not named").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = rest.join(rep("a"), "a", "left").join(rep("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    # ties stay between names themselves: a name that lies in several parts has a representative of its own, to which its own tie leads
    both = tied.select(F.col("rep").alias("a"), "b").unionByName(tied.select(F.col("b").alias("a"), F.col("rep").alias("b")))
    return reps, steps.keep("pairs", moved.unionByName(both).distinct())


def _degrees(pairs: DataFrame) -> DataFrame:
    """(v, out_of, into): edges that leave and enter each node."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.v").agg(F.sum("e.o").alias("out_of"), F.sum("e.i").alias("into"))


def _ends(pairs: DataFrame) -> DataFrame:
    """(key, id, out_of, into, loops): a node's edges to others, from others and to itself."""
    other = F.col("a") != F.col("b")
    end = lambda x, o, i, n: F.struct(*KEY, F.col(x).alias("id"), o.alias("o"), i.alias("i"), n.alias("n"))
    no, yes = F.lit(0), other.cast("int")
    rows = pairs.where("a is not null and b is not null").select(F.explode(F.array(end("a", yes, no, 1 - yes), end("b", no, yes, no))).alias("e")).select("e.*")
    return rows.groupBy(*KEY, "id").agg(F.sum("o").alias("out_of"), F.sum("i").alias("into"), F.sum("n").alias("loops"))


def contracted_components(pairs: DataFrame, grouped_edges: int = GROUPED_EDGES, rounds: list[str] | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(key, id, scc) of the nodes that lie on cycles, by contracting what is connected within parts of the edges; repeated pairs do no harm.

    Ids go by 64-bit hashes, so that no text is shuffled with the edges; a seed under which no two ids share a hash is sought.
    ends is _ends(pairs), where it is stored already: pairs are read once besides. Each round leaves the edges between parts' components. Rounds end when few edges are left, which go through one task,
    or none, or when a round no longer halves them: distributed_components() takes those.
    """
    spark, rounds = pairs.sparkSession, [] if rounds is None else rounds
    steps = Steps(spark, "scc")
    loose = pairs.where("a <> b")
    counted = (steps.keep("ids", _ends(pairs)) if ends is None else ends).where("out_of + into > 0")
    seed = next(k for k in range(1000) if counted.groupBy(F.xxhash64(F.lit(k), *KEY, "id")).count().where("count > 1").isEmpty())
    v = lambda x: F.xxhash64(F.lit(seed), *KEY, F.col(x))
    ids = counted.withColumn("v", v("id"))
    left, degrees = loose.select(v("a").alias("a"), v("b").alias("b")), ids.select("v", "out_of", "into")
    found, n = [], counted.agg(F.sum("out_of")).first()[0] or 0
    while n > grouped_edges:
        reps, left = _contraction(steps, left, degrees, n, 2 if not grouped_edges else 1)
        rounds.append("contracted")
        found.append(reps)
        before, n = n, left.count()
        if 2 * n > before:
            break
        degrees = steps.keep("degrees", _degrees(left)) if n > grouped_edges else None
    if n:
        plain = left.select(F.lit("").alias("subject_id"), F.lit("").alias("scan_id"), F.lpad(F.hex("a"), 16, "0").alias("a"), F.lpad(F.hex("b"), 16, "0").alias("b"))
        rest = grouped_components(plain) if n <= grouped_edges else distributed_components(plain, grouped_edges, rounds)
        number = lambda x: F.conv(F.col(x), 16, -10).cast("long")
        found.append(stored(rest.select(number("id").alias("v"), number("scc").alias("rep")), "scc"))
    # the last representative of each node, from the last round back to the first
    out = None
    for reps in reversed(found):
        if out is not None:
            later = out.select(F.col("v").alias("rep"), F.col("rep").alias("last"))
            reps = reps.join(later, "rep", "left").select("v", F.coalesce("last", "rep").alias("rep")).unionByName(out.join(reps.select("v"), "v", "left_anti"))
        out = reps
    if out is None:
        return spark.createDataFrame([], "subject_id string, scan_id string, id string, scc string")
    named = stored(out.join(ids.select(*KEY, "id", "v"), "v").select(*KEY, "id", "rep"), "scc")
    steps.drop(*list(steps.held))
    least = named.groupBy("rep").agg(F.min("id").alias("scc"))
    return named.join(least, "rep").select(*KEY, "id", "scc")


def components(nodes: DataFrame, edges: DataFrame, relations: Sequence[str] = CYCLE_RELATIONS, grouped_edges: int = GROUPED_EDGES) -> DataFrame:
    """(key, id, scc, size, self_loop) of every node: scc is the least id of its component, singletons included.

    Graphs of up to grouped_edges edges take one task each; larger ones are contracted part by part.
    """
    pairs = _pairs(edges, relations)
    ends = stored(_ends(pairs), "scc")
    sizes = stored(ends.groupBy(*KEY).agg((F.sum("out_of") + F.sum("loops")).alias("n")), "scc")
    large, small = sizes.where(F.col("n") > grouped_edges).select(*KEY), sizes.where(F.col("n") <= grouped_edges).select(*KEY)
    found = ends.select(*KEY, "id", F.col("id").alias("scc")).limit(0)
    # what no graph asks for is left out, so the edges aren't read for it
    if not small.isEmpty():
        found = grouped_components(pairs.join(large, KEY, "left_anti").distinct())
    if not large.isEmpty():
        mine = lambda rows: rows.join(F.broadcast(large), KEY, "left_semi")
        found = found.unionByName(contracted_components(mine(pairs), grouped_edges, ends=mine(ends)))
    loops = ends.where("loops > 0").select(*KEY, "id", F.lit(True).alias("loop"))
    all_ = nodes.select(*KEY, "id").join(found, [*KEY, "id"], "left").join(loops, [*KEY, "id"], "left")
    all_ = stored(all_.select(*KEY, "id", F.coalesce("scc", "id").alias("scc"), F.coalesce("loop", F.lit(False)).alias("self_loop")), "scc")
    count = all_.groupBy(*KEY, "scc").agg(F.count("*").alias("size"))
    return all_.join(count, [*KEY, "scc"])


def self_loops(edges: DataFrame, relations: Sequence[str] = CYCLE_RELATIONS) -> DataFrame:
    """(key, id) of nodes with an edge to themselves."""
    return adjacency(edges, relations).where("a = b").select(*KEY, F.col("a").alias("id"))


def participates(include_self: bool):
    return (F.col("size") > 1) | (F.lit(include_self) & F.col("self_loop"))


def cycle_entropy(comps: DataFrame, include_self: bool = False) -> DataFrame:
    """(key, nodes, participating, cycles, value) from components()."""
    on = participates(include_self)
    out = comps.groupBy(*KEY).agg(F.count("*").alias("nodes"), F.count_if(on).alias("participating"), F.count_distinct(F.when(on, F.col("scc"))).alias("cycles"))
    return out.withColumn("value", ratio(F.col("participating"), F.col("nodes")))


def cycle_groups(comps: DataFrame, include_self: bool = False) -> DataFrame:
    """(key, scc, size): one row for each relevant component, without its members."""
    return comps.where(participates(include_self)).groupBy(*KEY, "scc").agg(F.count("*").alias("size"))


def cycle_findings(comps: DataFrame, include_self: bool = False) -> DataFrame:
    """(key, scc, size, ids sorted): one row for each relevant component, whose members must fit a row; components() has them row by row."""
    return comps.where(participates(include_self)).groupBy(*KEY, "scc").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("ids"))


def cycle_by_subsystem(comps: DataFrame, subsystems: Subsystems, include_self: bool = False) -> DataFrame:
    """(key, ord, subsystem, claimed, participating, value): both counts within the subsystem, NULL where it claims nothing."""
    index = PrefixIndex([(s.id_prefix, str(i)) for i, s in enumerate(subsystems.declared)])
    mine = comps.select(*KEY, index.name(F.col("id")).cast("int").alias("ord"), participates(include_self).alias("on")).where("ord is not null")
    counts = mine.groupBy(*KEY, "ord").agg(F.count("*").alias("claimed"), F.count_if("on").alias("participating"))
    # a row for each subsystem of each graph, whether it claims something or not
    every = graphs(comps).select(*KEY, F.posexplode(constants([s.name for s in subsystems.declared])).alias("ord", "subsystem"))
    out = every.join(counts, [*KEY, "ord"], "left").na.fill(0, ["claimed", "participating"]).select(*KEY, "ord", "subsystem", "claimed", "participating")
    return out.withColumn("value", ratio(F.col("participating"), F.col("claimed")))
