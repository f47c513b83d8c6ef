"""Merkle dataset manifest with octopus multiproofs (operator 13).

Every row is a leaf, a digest of its fields.  Leaves of a source ascend by id in a tree
whose runs of three consecutive nodes become their digest until one is left, the subroot;
the subroots in source order form the top tree in the same way, whose last node is the
root.  Rows are numbered without one large sort group: ranges of (source, id, leaf) are
written with the number of their partition, and the partitions' sizes give the offsets.

Leaf partitions are blocks of ``LEAVES`` = 3^8 leaves of a source, or several whole small
sources.  A first pass reduces each to the nodes that others can need; the few upper nodes
are reduced in further passes of eight levels.  Then each leaf partition works out the
octopus proof of all its leaves together, the smallest set of nodes that it cannot derive
itself, fetches that set once (a join on coordinates), derives the interior nodes that its
leaves share and expands the single proofs from them.

Defined results: nulls sort first among sources and ids; rows that share source and id
ascend by their leaf digest (equal ones in any order, each with its own proof); a null key
is not tampered with; a single leaf is its subroot and a single subroot the root; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

ARITY = 3
LEVELS = 8
#: Leaves of a leaf partition; aligned to whole subtrees of ``LEVELS`` levels.
LEAVES = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree number of the tree over the subroots.
TOP = -1


def join(digests: Iterable[str]) -> str:
    """Digest of digests, concatenated as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields: ``-`` for null, else byte count, colon, value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", tampered: Column | None = None,
           text: str = "text") -> DataFrame:
    """``key, source, leaf, other``: the digests of each row as it is and as tampered with
    (its ``text`` replaced by the column ``tampered``)."""
    col = lambda n: F.col(f"`{n}`")
    other = [tampered if n == text and tampered is not None else col(n) for n in fields]
    return docs.select(col(key).cast("long").alias("key"), col(source).cast("string").alias("source"),
                       leaf_digest(*map(col, fields)).alias("leaf"), leaf_digest(*other).alias("other"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its dense number from 0 in the given order.  Only one row per range of
    the order is numbered in one task."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


# -- trees --------------------------------------------------------------------------------

def sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of ``n`` leaves, up to the last single one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def missing(at: list[int], n: int, level: int = 0) -> list[tuple[int, int]]:
    """The octopus proof's coordinates ``(level, index)`` for the nodes ``at`` (ascending)
    of ``level`` in a tree of ``n`` leaves: siblings that the nodes themselves and what
    they derive do not give."""
    out = []
    for step, m in enumerate(sizes(n)[level:-1], level):
        own = set(at)
        for run in sorted({i // ARITY for i in at}):
            out += [(step, i) for i in range(run * ARITY, min(run * ARITY + ARITY, m)) if i not in own]
        at = sorted({i // ARITY for i in at})
    return out


class Tree:
    """The part of a tree that a leaf partition knows: nodes by (level, index)."""

    def __init__(self, n: int):
        self.sizes = sizes(n)
        self.nodes: dict[tuple[int, int], str] = {}

    def run(self, level: int, index: int) -> range:
        first = index - index % ARITY
        return range(first, min(first + ARITY, self.sizes[level]))

    def derive(self, at: Iterable[int], level: int, until: int | None = None) -> list[int]:
        """Nodes above ``at``, level by level; indexes of the last level reached."""
        top = len(self.sizes) - 1 if until is None else min(until, len(self.sizes) - 1)
        at = sorted(set(at))
        for step in range(level, top):
            up = sorted({i // ARITY for i in at})
            for i in up:
                self.nodes[step + 1, i] = join(self.nodes[step, j] for j in self.run(step, i * ARITY))
            at = up
        return at

    def siblings(self, level: int, index: int) -> list[str]:
        return [self.nodes[level, j] for j in self.run(level, index) if j != index]

    def path(self, level: int, index: int) -> list[list[str]]:
        """Siblings level by level, from the given node to the root of the tree."""
        out = []
        for step in range(level, len(self.sizes) - 1):
            out.append(self.siblings(step, index))
            index //= ARITY
        return out

    def fold(self, digest: str, level: int, index: int) -> str:
        """The root that follows from a node's digest and the known siblings."""
        for step in range(level, len(self.sizes) - 1):
            digest = join(digest if j == index else self.nodes[step, j] for j in self.run(step, index))
            index //= ARITY
        return digest

    @property
    def root(self) -> str:
        return self.nodes[len(self.sizes) - 1, 0]


# -- passes -------------------------------------------------------------------------------

def _grouped(batches, keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    yield from groupby(rows(), lambda r: r[:keys])


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


NODE = [("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]
NODE_SQL = "tree long, n long, level int, index long, digest string"


def climb(nodes: DataFrame) -> DataFrame:
    """Nodes of the next ``LEVELS`` levels (as far as the trees go) above ``nodes``
    (``tree, n, level, index, digest``; complete levels, one per tree)."""
    def run(batches):
        for (tree, n, level, _), rows in _grouped(batches, 4):
            t = Tree(n)
            own = []
            for r in rows:
                own.append(r[4])
                t.nodes[level, r[4]] = r[5]
            t.derive(own, level, level + LEVELS)
            yield _table([(tree, n, lv, i, d) for (lv, i), d in t.nodes.items() if lv > level], NODE)

    part = F.expr(f"index div {LEAVES}").alias("part")
    rows = nodes.select("tree", "n", "level", part, "index", "digest").repartition("tree", "part").sortWithinPartitions("tree", "n", "level", "part", "index")
    return rows.mapInArrow(run, NODE_SQL)


def _upper(first: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """All nodes above the complete level ``level`` of the trees that have it, and the last
    node of every tree."""
    every = now = first
    roots = first.where(F.col("level") == _height(F.col("n")))
    while True:
        below = now.where((F.col("level") == level) & (F.col("level") < _height(F.col("n"))))
        if below.isEmpty():
            return every, roots
        now, level = stored(climb(below)), level + LEVELS
        every = every.unionByName(now)
        roots = roots.unionByName(now.where(F.col("level") == _height(F.col("n"))))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: smallest h with 3^h >= n."""
    powers = F.array(*[F.lit(ARITY ** k) for k in range(1, 39)])
    return F.when(n <= 1, 0).otherwise(F.size(F.filter(powers, lambda p: p < n)) + 1)


def _reduce(placed: DataFrame) -> DataFrame:
    """First pass: what leaf partitions give to others, ``big, part, tree, n, level,
    index, digest``: the node over a block of a large source, the subroot of a small one."""
    def run(batches):
        out = []
        for (big, part, tree, n), rows in _grouped(batches, 4):
            t, own = Tree(n), []
            for r in rows:
                own.append(r[4])
                t.nodes[0, r[4]] = r[5]
            level = min(LEVELS, len(t.sizes) - 1)
            index = t.derive(own, 0, level)[0]
            out.append((big, part, tree, n, level, index, t.nodes[level, index]))
            if len(out) >= 4096:
                yield _table(out, fields)
                out = []
        yield _table(out, fields)

    fields = [("big", pa.bool_()), ("part", pa.int64()), *NODE]
    return placed.select("big", "part", "tree", "n", "index", "leaf").mapInArrow(run, "big boolean, part long, " + NODE_SQL)


def _requests(given: DataFrame, sources: int) -> DataFrame:
    """``big, owner, part, tree, level, index``: the coordinates each leaf partition must
    fetch, from its rows of the first pass."""
    fields = [("big", pa.bool_()), ("owner", pa.int64()), ("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64())]

    def run(batches):
        for (big, owner, part), rows in _grouped(batches, 3):
            trees, want = [], []
            for _, _, _, tree, n, level, index in rows:
                trees.append(tree)
                if big:
                    want += [(tree, *c) for c in missing([index], n, level)]
            want += [(TOP, *c) for c in missing(trees, sources)]
            yield _table([(big, owner, part, *w) for w in want], fields)

    rows = given.select("big", _owner(), "part", "tree", "n", "level", "index")
    rows = rows.repartition("big", "owner", "part").sortWithinPartitions("big", "owner", "part", "tree")
    return rows.mapInArrow(run, "big boolean, owner long, part long, tree long, level int, index long")


def _owner() -> Column:
    """The source of a block; small sources share partitions."""
    return F.when(F.col("big"), F.col("tree")).otherwise(-1).alias("owner")


PROOF = [("tree", pa.int64()), ("key", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
         ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("proof", pa.list_(pa.list_(pa.string())))]


def _expand(rows: DataFrame, sources: int, with_proof: bool) -> DataFrame:
    """Single proofs from leaf rows and the fetched nodes of each leaf partition."""
    fields = PROOF if with_proof else PROOF[:-1]

    def partition(rows):
        top, trees, leaves_ = Tree(sources), {}, {}
        for _, _, _, tree, fetched, n, level, index, digest, other, key in rows:
            if fetched:
                if tree == TOP:
                    top.nodes[level, index] = digest
                else:
                    trees.setdefault(tree, {})[level, index] = digest
            else:
                leaves_.setdefault((tree, n), []).append((index, digest, other, key))
        own = {}
        for (tree, n), found in leaves_.items():
            t = own[tree] = Tree(n)
            t.nodes.update(trees.get(tree, {}))
            t.nodes.update({(0, index): digest for index, digest, _, _ in found})
            t.derive([f[0] for f in found], 0)
            top.nodes[0, tree] = t.root
        top.derive(own, 0)
        for (tree, n), found in leaves_.items():
            t = own[tree]
            above = top.path(0, tree)
            shared: dict[int, list[list[str]]] = {}
            for index, digest, other, key in found:
                if len(t.sizes) > 1:
                    up = index // ARITY
                    if up not in shared:
                        shared = {up: t.path(1, up) + above}
                    path = [t.siblings(0, index), *shared[up]]
                else:
                    path = above
                folded = top.fold(t.fold(other, 0, index), 0, tree)
                out = (tree, key, digest, t.root, top.root, join(d for level in path for d in level), folded)
                yield (*out, path) if with_proof else out

    def run(batches):
        out = []
        for _, part in _grouped(batches, 3):
            for r in partition(part):
                out.append(r)
                if len(out) >= 2048:
                    yield _table(out, fields)
                    out = []
        yield _table(out, fields)

    schema = "tree long, key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return rows.mapInArrow(run, schema + (", proof array<array<string>>" if with_proof else ""))


def manifest(rows: DataFrame, with_proof: bool = False) -> DataFrame:
    """``key, source, leaf, subroot, root, proof_sha256, folded_root, verified`` (and
    ``proof``: siblings of each level) of rows ``key, source, leaf, other``."""
    held = stored(rows.select("key", "source", "leaf", "other", F.monotonically_increasing_id().alias("_uid")))
    if held.isEmpty():
        return held.select("key", "source", "leaf", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")],
                           F.lit(None).cast("boolean").alias("verified"), *([F.lit(None).cast("array<array<string>>").alias("proof")] if with_proof else []))
    first = F.col("source").asc_nulls_first()
    all_rows = numbered(held, [first, F.col("key").asc_nulls_first(), F.col("leaf"), F.col("_uid")], "_g")
    groups = all_rows.groupBy("source").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("n"))
    sources = stored(numbered(groups, [first], "tree"))
    trees = sources.count()
    big = F.col("n") > LEAVES
    named = sources.select(F.col("source").alias("_source"), "_first", "n", "tree")
    placed = all_rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("index", F.col("_g") - F.col("_first"))
    part = F.when(big, F.expr(f"index div {LEAVES}")).otherwise(F.expr(f"_first div {LEAVES}"))
    placed = placed.select(big.alias("big"), part.alias("part"), "tree", "n", "index", "leaf", "other", "key")
    placed = stored(placed.withColumn("owner", _owner()))

    dealt = placed.repartition("big", "owner", "part").sortWithinPartitions("big", "part", "tree", "n", "index")
    given = stored(_reduce(dealt))
    inner, subroots = _upper(given.select(*[n for n, _ in NODE]), LEVELS)
    bottom = stored(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.lit(0).alias("level"), F.col("tree").alias("index"), "digest"))
    over, last = _upper(bottom, 0)
    root = last.first()["digest"]

    nodes = inner.unionByName(over).select("tree", "level", "index", "digest")
    fetched = _requests(given, trees).join(nodes, ["tree", "level", "index"])
    union = fetched.select("big", "owner", "part", "tree", F.lit(True).alias("fetched"), F.lit(0).cast("long").alias("n"), "level", "index", "digest",
                           F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("key"))
    union = union.unionByName(placed.select("big", "owner", "part", "tree", F.lit(False).alias("fetched"), "n", F.lit(0).alias("level"), "index", F.col("leaf").alias("digest"), "other", "key"))
    union = union.repartition("big", "owner", "part").sortWithinPartitions("big", "owner", "part", F.col("fetched").desc(), "tree", "index")
    out = _expand(union, trees, with_proof)
    back = out.join(named.select("tree", F.col("_source").alias("source")), "tree")
    names = ["key", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return back.select(*names, (F.col("folded_root") == F.lit(root)).alias("verified"), *(["proof"] if with_proof else []))


def verify(leaf: str, proof: list[list[str]], places: list[int]) -> str:
    """The root that follows from a leaf, the siblings of each level and the leaf's place
    in each run."""
    for siblings, place in zip(proof, places):
        leaf = join([*siblings[:place], leaf, *siblings[place:]])
    return leaf
