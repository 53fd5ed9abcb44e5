"""Merkle manifest of a table: a root that fixes every row, and a proof for each row.

A row's leaf is the hash of its fields.  The leaves of a tree (rows of one
group, in the order of their key) are hashed in runs of ``WIDTH``, the results
again, until one hash is left; these, in the order of the groups, make a tree
of their own, whose top is the root.

Proofs come from pointer jumping.  A node holds the siblings on its way to an
ancestor and that ancestor's name.  Joining the nodes with themselves appends
what the ancestor holds, so the distance doubles in every round, until all
reach the root.  The leaves, seven eighths of all nodes, wait for that: the
rounds move inner nodes alone, and a leaf takes the whole way from its parent
in one last join.

Leaves are numbered by a global sort that is written with its partition
numbers; counts of the partitions give the offsets.  A group of any size is
spread over all tasks.

Defined results: a null field is ``-``; a null group and a null key come first;
rows of one group and key are ordered by their leaf, rows that agree in that
as well are interchangeable; a claim about a null value is null; an empty
table gives an empty one and no root.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, log2

from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm.tables import stored

WIDTH = 8
DIGEST = 32  # fixed value: bytes of a SHA-256 digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The tree over the groups; groups are numbered from 0.
_TOP = "-1L"
_SEGMENT = "struct<before: binary, after: binary>"
_NO_WAY = f"CAST(array() AS array<{_SEGMENT}>)"


def leaf_of(values: Sequence[str]) -> str:
    """SQL of a leaf: the digest of values, each with its length in bytes; a null one is a dash."""
    parts = (f"coalesce(concat(octet_length(CAST({v} AS STRING)), ':', CAST({v} AS STRING)), '-')" for v in values)
    return f"unhex(sha2(concat({', '.join(parts)}), 256))"


def leaves(
    docs: DataFrame, fields: Sequence[str], group: str, key: str, claims: Mapping[str, str] | None = None
) -> DataFrame:
    """``key``, ``group``, ``leaf`` and ``claimed``: the leaf if the fields in ``claims`` had the values (SQL) given there."""
    claims = claims or {}
    claimed = [f"({claims[f]})" if f in claims else f"`{f}`" for f in fields]
    columns = [f"`{key}` AS key", f"`{group}` AS group", f"{leaf_of([f'`{f}`' for f in fields])} AS leaf"]
    return docs.selectExpr(*columns, f"{leaf_of(claimed)} AS claimed" if claims else "CAST(NULL AS BINARY) AS claimed")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``number``, their place in the order from 0.  No task sees more than a range of them."""
    placed = stored(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    # One row for each partition of the sort, so one task sums them and a broadcast takes them.
    parts = placed.groupBy(F.expr("at >> 33 AS part")).agg(F.expr("count(*) AS n"))
    before = parts.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before")
    within = F.expr(f"before + (at & {(1 << 33) - 1}L)")
    return placed.withColumn("part", F.expr("at >> 33")).join(F.broadcast(before), "part").withColumn("number", within).drop("part", "at", "before")


def placed(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Leaves with their ``tree``, ``place`` in it and its ``nodes``; the number of trees and the largest one's nodes."""
    ordered = numbered(rows, F.asc_nulls_first("group"), F.asc_nulls_first("key"), "leaf")
    groups = ordered.groupBy("group").agg(F.min("number").alias("first"), F.expr("count(*) AS nodes"))
    trees = stored(numbered(stored(groups, "groups"), F.asc_nulls_first("group")), "trees").selectExpr(
        "group AS tree_group", "number AS tree", "first", "nodes"
    )
    count, largest = trees.selectExpr("count(*)", "coalesce(max(nodes), 0)").first()
    own = ordered.join(trees, ordered["group"].eqNullSafe(trees["tree_group"]))
    return own.withColumn("place", F.expr("number - first")).drop("tree_group", "first", "number"), count, largest


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes ``tree, level, place, nodes, digest`` in runs: the members' digests in a row, and the digest of all.

    The one node of a finished tree is a run whose digest is its own.
    """
    members = "aggregate(array_sort(collect_list(struct(place, digest))), X'', (all, m) -> concat(all, m.digest))"
    return (
        nodes.groupBy("tree", "level", "nodes", F.expr(f"place div {WIDTH} AS run"))
        .agg(F.expr(f"{members} AS members"))
        .selectExpr("*", "IF(nodes = 1, members, unhex(sha2(lower(hex(members)), 256))) AS digest")
    )


def _climb(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, leaves first, and the tops ``tree, digest`` of all trees."""
    runs = [stored(_runs(nodes), "runs")]
    tops = [runs[0].where("nodes = 1")]
    while largest > 1:
        largest = -(-largest // WIDTH)
        parents = runs[-1].where("nodes > 1").selectExpr(
            "tree", "level + 1 AS level", "run AS place", f"(nodes + {WIDTH - 1}) div {WIDTH} AS nodes", "digest"
        )
        runs.append(stored(_runs(parents), "runs"))
        tops.append(runs[-1].where("nodes = 1"))
    top = tops[0]
    for other in tops[1:]:
        top = top.union(other)
    return runs, top.select("tree", "digest")


# Names of nodes.  The top of a group's tree is a leaf of the tree over the groups.
_PARENT = f"IF(tree >= 0 AND nodes <= {WIDTH}, struct({_TOP} AS tree, 0 AS level, tree AS place), struct(tree, level + 1 AS level, run AS place))"


def _segment(members: str, i: str) -> str:
    """SQL of the siblings of member ``i`` of a run."""
    return (
        f"named_struct('before', substring({members}, 1, CAST({i} AS INT) * {DIGEST}),"
        f" 'after', substring({members}, (CAST({i} AS INT) + 1) * {DIGEST} + 1))"
    )


def _pointers(runs: DataFrame) -> DataFrame:
    """``id``, ``up`` and ``path`` of every member: its name, its parent's, and its siblings."""
    every = f"explode(sequence(0, CAST(octet_length(members) div {DIGEST} AS INT) - 1)) AS i"
    return runs.where("nodes > 1").selectExpr("*", every).selectExpr(
        f"struct(tree, level, run * {WIDTH} + i AS place) AS id", f"{_PARENT} AS up", f"array({_segment('members', 'i')}) AS path"
    )


def _jump(pointers: DataFrame, height: int) -> DataFrame:
    """Pointers that all reach the root, over trees of ``height`` levels in all."""
    for r in range(ceil(log2(height)) if height > 1 else 0):
        # After r rounds an ancestor is 2 ** r levels up, or in the tree over the groups.
        far = pointers.where(f"id.tree = {_TOP} OR id.level > {2**r}").selectExpr("id AS at", "up AS further", "path AS more")
        pointers = stored(
            pointers.join(far, pointers["up"] == far["at"], "left").selectExpr(
                "id", "coalesce(further, up) AS up", f"concat(path, coalesce(more, {_NO_WAY})) AS path"
            ),
            "pointers",
        )
    return pointers


def manifest(rows: DataFrame) -> DataFrame:
    """Of rows from :func:`leaves`: ``key, group, leaf, claimed, subroot, root, path``; digests are binary.

    ``path`` has the siblings before and after the row's node for every level up to the root.
    """
    own, trees, largest = placed(stored(rows, "leaves"))
    runs, subroots = _climb(own.selectExpr("tree", "0 AS level", "place", "nodes", "leaf AS digest"), largest)
    subroots = stored(subroots, "subroots")
    over, tops = _climb(subroots.selectExpr(f"{_TOP} AS tree", "0 AS level", "tree AS place", f"{trees}L AS nodes", "digest"), trees)
    top = tops.first()
    root = F.lit(bytes(top["digest"]) if top else None).cast("binary")

    inner = [_pointers(r) for r in runs[1:] + over]
    pointers = inner[0]
    for more in inner[1:]:
        pointers = pointers.union(more)
    whole = _jump(stored(pointers, "pointers"), max(0, len(runs) - 2) + len(over) - 1)

    # A lone leaf is the top of its tree: no level of that tree is on its way.
    parents = runs[0].selectExpr("tree", "run", "members", f"IF(nodes = 1, struct({_TOP} AS tree, 0 AS level, tree AS place), {_PARENT}) AS up")
    ways = (
        parents.join(whole.selectExpr("id", "path AS way"), F.expr("up = id"), "left")
        .join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        .select("tree", "run", "members", "subroot", "way")
    )
    siblings = f"IF(nodes = 1, {_NO_WAY}, array({_segment('members', f'place % {WIDTH}')}))"
    return (
        own.withColumn("run", F.expr(f"place div {WIDTH}"))
        .join(ways, ["tree", "run"])
        .selectExpr("key", "group", "leaf", "claimed", "subroot", f"concat({siblings}, coalesce(way, {_NO_WAY})) AS path")
        .withColumn("root", root)
    )


def folded(leaf: str, path: str) -> str:
    """SQL of the root, in hexadecimal, that a leaf and the siblings on its way give."""
    return (
        f"aggregate({path}, lower(hex({leaf})),"
        f" (h, s) -> sha2(concat(lower(hex(s.before)), h, lower(hex(s.after))), 256))"
    )


def siblings_of(path: str) -> str:
    """SQL of all siblings on a way, in hexadecimal, from the leaf's level to the root and from left to right."""
    return f"lower(hex(aggregate({path}, X'', (all, s) -> concat(all, s.before, s.after))))"
