"""Closures over edges, commit graphs, and hierarchies."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import SMALL, Rounds, discard, stored


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node, depth): all nodes reachable from seeds(root, node) by edges(src, dst), cycles or not.

    Semi-naive: each round joins only the nodes that the last one found, less those seen, until none
    is new. Edges are written once, and each round is added to one table. What a round found is sent to
    the edges while it is small, else both are shuffled by node.
    """
    edges = stored(edges.select("src", "dst").distinct())
    first = seeds.select("root", "node", F.lit(0).alias("depth")).distinct()
    seen = Rounds(edges.sparkSession, first.schema)
    new = seen.add(first)
    for depth in count(1):
        n = new.count()
        if not n:
            return seen.all()
        step = (F.broadcast(new) if n <= SMALL else new).join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = seen.add(step.join(seen.all(), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth")))


def subtypes(bases: DataFrame, targets: DataFrame, kinds: DataFrame | None = None, classes_only: bool = False) -> DataFrame:
    """Transitive subtypes of targets(name) by bases(type, base); classes_only follows class to class."""
    edges = bases
    if classes_only and kinds is not None:
        c = kinds.where("kind = 'class'").select("name")
        edges = edges.join(c.withColumnRenamed("name", "type"), "type", "left_semi").join(c.withColumnRenamed("name", "base"), "base", "left_semi")
    edges = edges.select(F.col("base").alias("src"), F.col("type").alias("dst"))
    return closure(edges, targets.select(F.col("name").alias("root"), F.col("name").alias("node"))).where("depth > 0").select("root", F.col("node").alias("name"), "depth")


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node, depth) upward: edges(src, dst) are followed from dst to src."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)


def removal_cascade(parents: DataFrame, removed: DataFrame) -> DataFrame:
    """Objects of parents(id, parent) that die with removed(id): themselves and all below."""
    edges = parents.select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return closure(edges, removed.select(F.lit(0).alias("root"), F.col("id").alias("node"))).select(F.col("node").alias("id")).distinct()


#: Primes below 2**31 that counts of paths are taken by; a cut is one by both.
PRIMES = (2_147_483_629, 2_147_483_587)


def _jumped(step: DataFrame) -> DataFrame:
    """(id, end, hops, last) of step(id, to): where pointers lead that go on while they meet an id; last is the id before the end.

    Pointers are doubled, so a run of n takes log n rounds. One that met no id is at its end, and is written once.
    """
    now = one = stored(step.select("id", F.col("to").alias("end"), F.lit(1).cast("long").alias("hops"), F.col("id").alias("last")))
    done, all_ = None, now
    for _ in range(now.count().bit_length() + 2):
        on = all_.select(F.col("id").alias("mid"), F.col("end").alias("further"), F.col("hops").alias("more"), F.col("last").alias("late"))
        both = stored(now.join(on, F.col("end") == F.col("mid"), "left").select("id", F.coalesce("further", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("late", "last").alias("last"), F.col("mid").isNotNull().alias("moved")))
        ended, now = both.where("not moved").drop("moved"), both.where("moved").drop("moved")
        done = ended if done is None else done.unionByName(ended)
        discard(one)
        if now.isEmpty():
            return done
        all_ = done.unionByName(now)
    raise ValueError("The commit graph has a cycle.")


class Commits:
    """A commit graph as tables, with its unbranched runs contracted.

    parents(id, pos, parent); an end has no row or one of null parent. tips: some ids, or a table of any
    number (root), each of which is walked from. Commits that have one parent and
    one child, and are no tip, stand in a run; what branches, merges, begins or ends is a knot. Knots
    and their edges are what walks go over; runs are folded and unfolded by joins.
    """

    def __init__(self, parents: DataFrame, tips: list[str] | DataFrame):
        self.spark = parents.sparkSession
        self.roots = tips.select("root").distinct() if isinstance(tips, DataFrame) else self.spark.createDataFrame([(t,) for t in dict.fromkeys(tips)], "root string")
        self.roots = stored(self.roots)
        self.edges = stored(parents.where("parent is not null and id is not null").groupBy("id", "parent").agg(F.min("pos").alias("pos")))
        # of each node how many edges lead up and down, and the one above if it is alone
        up = self.edges.select("id", F.lit(1).alias("up"), F.lit(0).alias("down"), F.col("parent").alias("to"))
        down = self.edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("down")).select("id", F.lit(0).alias("up"), "down", F.lit(None).cast("string").alias("to"))
        tip = self.roots.select(F.col("root").alias("id"), F.lit(0).alias("up"), F.lit(2).alias("down"), F.lit(None).cast("string").alias("to"))
        degrees = up.unionByName(down).unionByName(tip).groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.max("to").alias("to"))
        inner = stored(degrees.where("up = 1 and down = 1").select("id", "to"))
        self.above = _jumped(inner)  # towards the root
        knots = self.edges.join(inner, "id", "left_anti")
        ends = self.above.select(F.col("id").alias("parent"), "end", "hops", "last")
        self.knots = stored(knots.join(ends, "parent", "left").select(F.col("id").alias("src"), "pos", F.col("parent").alias("first"), F.coalesce("end", "parent").alias("dst"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"), "last"))
        discard(inner)

    @property
    def below(self) -> DataFrame:
        """(id, end, hops, last) away from the root: a run hangs by its first commit from one knot, and is known by its last one."""
        runs = self.knots.where("last is not null").select("last", F.col("src").alias("end"), F.col("hops").alias("n"), F.col("first").alias("late"))
        return self.above.select("id", "hops", "last").join(runs, "last").select("id", "end", (F.col("n") - F.col("hops")).alias("hops"), F.col("late").alias("last"))

    def nodes(self) -> DataFrame:
        return self.edges.select("id").unionByName(self.edges.select(F.col("parent").alias("id"))).unionByName(self.roots.select(F.col("root").alias("id"))).distinct()

    def _weighted(self, counts: bool) -> DataFrame:
        return self.knots.groupBy("src", "dst").agg(F.max("hops").alias("far"), *(F.count("*").alias(f"c{k}") for k in range(len(PRIMES)) if counts))

    @staticmethod
    def _sums(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max("far").alias("far"), *((F.sum(f"c{k}") % p).alias(f"c{k}") for k, p in enumerate(PRIMES) if f"c{k}" in rows.columns))

    @staticmethod
    def _times(a: str, b: str, counts: bool) -> list:
        return [(F.col(f"{a}.far") + F.col(f"{b}.far")).alias("far"), *((F.col(f"{a}.c{k}") * F.col(f"{b}.c{k}") % p).alias(f"c{k}") for k, p in enumerate(PRIMES) if counts)]

    def walk(self, ends: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(root, id, far) of all that each tip reaches; with `ends` also the number of ways, c0 and c1, and (id, c0, c1) of how many lead on to an end.

        far is the greatest number of steps, c0 and c1 are modulo PRIMES. With A the edges
        between knots, powers A^1, A^2, A^4, ... are squared, and what is reached within 2^k steps, times A^(2^k),
        is reached within 2^(k+1): rounds grow with the logarithm of depth. A power holds the pairs so many
        knots apart, which grows with the width of the graph.
        """
        counts = [f"c{k}" for k in range(len(PRIMES)) if ends]
        one = [F.lit(1).cast("long").alias(x) for x in counts]
        f = self.roots.select("root", F.col("root").alias("id"), F.lit(0).cast("long").alias("far"), *one)
        power = stored(self._weighted(ends))
        g = None
        if ends:
            last = self.nodes().join(self.edges.select("id"), "id", "left_anti")
            g = stored(last.select("id", F.lit(0).cast("long").alias("far"), *one))
        for _ in range(power.count().bit_length() + 2):  # no way passes more knots than there are
            if power.isEmpty():
                break
            on = f.alias("f").join(power.alias("a"), F.col("f.id") == F.col("a.src")).select("f.root", F.col("a.dst").alias("id"), *self._times("f", "a", ends))
            f, gone = stored(self._sums(f.unionByName(on), "root", "id")), [f, power]
            if g is not None:
                back = power.alias("a").join(g.alias("g"), F.col("a.dst") == F.col("g.id")).select(F.col("a.src").alias("id"), *self._times("a", "g", ends))
                gone.append(g)
                g = stored(self._sums(g.unionByName(back), "id"))
            power = stored(self._sums(power.alias("a").join(power.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", *self._times("a", "b", ends)), "src", "dst"))
            discard(*gone)
        else:
            raise ValueError("The commit graph has a cycle.")
        runs = self.below.select("id", F.col("end").alias("knot"), "hops").join(f.withColumnRenamed("id", "knot"), "knot")
        f = f.unionByName(runs.select("root", "id", (F.col("far") + F.col("hops")).alias("far"), *counts))
        if g is not None:
            runs = self.above.select("id", F.col("end").alias("knot")).join(g.withColumnRenamed("id", "knot"), "knot")
            g = g.unionByName(runs.select("id", "far", *(f"c{k}" for k in range(len(PRIMES)))))
        return f, g

    def ancestors(self) -> DataFrame:
        """(root, id, far): what each tip reaches, itself included; ordered by far, children come before parents."""
        return self.walk()[0].select("root", "id", "far")

    def bases(self, groups: DataFrame | None = None) -> DataFrame:
        """(group, id): common ancestors of the tips of each of groups(group, root) that no other one descends from; without groups, of all tips, in group 0."""
        groups = groups.select("group", "root").distinct() if groups is not None else self.roots.select(F.lit(0).alias("group"), "root")
        size = groups.groupBy("group").agg(F.count("*").alias("size"))
        common = self.ancestors().join(groups, "root").groupBy("group", "id").agg(F.count("*").alias("n")).join(size, "group").where("n = size")
        common = stored(common.select("group", "id"))
        under = common.join(self.edges, "id").select("group", F.col("parent").alias("id"))  # all between two common ancestors are common
        return common.join(under, ["group", "id"], "left_anti")

    def cut(self, together: bool = True) -> DataFrame:
        """(root, id): the nearest commit that every way from a tip to an end passes, but the tip itself; none where there is none.

        together: of the ways from all tips, with a null root; a tip may then be the cut if there are others.
        """
        f, g = self.walk(ends=True)
        counts = [f"c{k}" for k in range(len(PRIMES))]
        if together:
            alone = self.roots.count() == 1
            f = self._sums(f.withColumn("own", (F.col("root") == F.col("id")) & F.lit(alone)).withColumn("root", F.lit("")), "root", "id", "own")
        else:
            f = f.withColumn("own", F.col("root") == F.col("id"))
        final = f.join(self.edges.select("id"), "id", "left_anti").groupBy("root").agg(*((F.sum(x) % p).alias(f"all_{x}") for x, p in zip(counts, PRIMES, strict=True)))
        on = f.join(g.select("id", *(F.col(x).alias(f"to_{x}") for x in counts)), "id").join(final, "root").where("not own")
        for x, p in zip(counts, PRIMES, strict=True):
            on = on.where(F.col(x) * F.col(f"to_{x}") % p == F.col(f"all_{x}"))
        return on.groupBy("root").agg(F.min_by("id", "far").alias("id")).select(F.when(F.lit(not together), F.col("root")).alias("root"), "id")

    def order(self) -> DataFrame:
        """(position, id) below the one tip: children before parents; among the ready ones, as a walk along first parents first would meet them.

        Such a walk is one step after another. It is made on the driver, over knots and runs only; a run
        stands together in it, so its commits get their places by a join.
        """
        first = self.below.select("id", F.col("last").alias("run"), "hops")
        length = first.groupBy("run").agg(F.max("hops").alias("n"))
        runs = length.join(self.above.select(F.col("id").alias("run"), "end"), "run")
        steps = self.knots.select("src", "pos", "first").unionByName(runs.select(F.col("run").alias("src"), F.lit(0).alias("pos"), F.col("end").alias("first")))
        graph = History.of(steps.toDF("id", "pos", "parent"))
        sizes = {r[0]: r[1] for r in length.where("n > 1").toLocalIterator()}
        places, at = [], 0
        for unit in graph.order(self.roots.first()[0]):
            places.append((unit, at))
            at += sizes.get(unit, 1)
        units = self.spark.createDataFrame(places, "unit string, base long")
        members = self.nodes().join(first, "id", "left").select("id", F.coalesce("run", "id").alias("unit"), F.coalesce(F.col("hops") - 1, F.lit(0)).alias("within"))
        return members.join(units, "unit").select((F.col("base") + F.col("within")).alias("position"), "id")


class History:
    """A commit graph on the driver, for the one thing that goes step by step: the order of a log. Commits hands it knots and runs only. Times play no part."""

    def __init__(self, parents: dict[str, list[str]]):
        self.parents = parents
        self.children: dict[str, list[str]] = defaultdict(list)
        for c, ps in parents.items():
            for p in ps:
                self.children[p].append(c)

    @staticmethod
    def of(commit_parents: DataFrame) -> History:
        """From (id, pos, parent); a root has one row of null parent."""
        rows = commit_parents.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "parent"))).alias("p")).toLocalIterator()
        return History({r[0]: [x[1] for x in r[1] if x[1] is not None] for r in rows})

    def ancestors(self, tip: str) -> set[str]:
        seen, todo = set(), [tip]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += self.parents.get(c, [])
        return seen

    def order(self, tip: str) -> list[str]:
        """Children before parents; among the ready ones, as a walk along first parents first would meet them."""
        rank, stack, done = [], [(tip, iter(self.parents.get(tip, [])))], {tip}
        while stack:  # reverse post-order of a depth-first walk
            c, rest = stack[-1]
            nxt = next((p for p in rest if p not in done), None)
            if nxt is None:
                rank.append(c)
                stack.pop()
            else:
                done.add(nxt)
                stack.append((nxt, iter(self.parents.get(nxt, []))))
        return rank[::-1]

    def bases(self, a: str, b: str) -> list[str]:
        """Common ancestors that no other common ancestor descends from."""
        both = self.ancestors(a) & self.ancestors(b)
        return sorted(c for c in both if both.isdisjoint(self.children[c]))  # all between two common ancestors are common

    def cut(self, tip: str) -> str | None:
        """The nearest commit below the tip through which every path to a root leads."""
        inside = self.ancestors(tip)
        order = self.order(tip)
        place = {c: k for k, c in enumerate(order)}
        reach = 0
        for k, c in enumerate(order):
            if k and reach <= k:
                return c
            ps = [p for p in self.parents.get(c, []) if p in inside]
            if not ps:
                return None
            reach = max(reach, *(place[p] for p in ps))
        return None
