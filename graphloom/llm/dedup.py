"""Records that are the same apart from formatting, found by bottom-up hashing.

A record is described as a tree. Each leaf is normalised and hashed; an inner
node is the hash of its children's digests, which are sorted first where their
order does not matter. Records with the same root digest form a group. The full normalised forms are compared
once, when a group's smallest id is found, which needs one form for each distinct record; ids then find
their group by two digests, and by the form again only where these say the same of different forms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import fold
from graphloom.tables import materialise, small


@dataclass(frozen=True)
class Leaf:
    """The name of a string column, or of a list of strings (kept in order)."""

    column: str
    normalise: Callable[[Column], Column] = fold
    is_list: bool = False


@dataclass(frozen=True)
class Node:
    """Children in a fixed order, or in any order."""

    children: tuple
    ordered: bool = True


def leaves(tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for c in tree.children for x in leaves(c)]


def _text(leaf: Leaf) -> Column:
    return F.transform(leaf.column, leaf.normalise) if leaf.is_list else leaf.normalise(F.col(leaf.column))


def digest(tree) -> Column:
    """The digest of a tree, built bottom-up."""
    if isinstance(tree, Leaf):
        return F.xxhash64(_text(tree))
    parts = F.array(*(digest(c) for c in tree.children))
    return F.xxhash64(F.lit(len(tree.children)), parts if tree.ordered else F.sort_array(parts))


def form(tree) -> Column:
    """The normalised record as one string; equal exactly for records that say the same."""
    framed = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    if isinstance(tree, Leaf):
        text = _text(tree)
        text = F.array_join(F.transform(text, lambda x: F.coalesce(framed(x), F.lit("-"))), "") if tree.is_list else text
        return F.coalesce(framed(text), F.lit("-"))
    parts = F.array(*(form(c) for c in tree.children))
    return framed(F.array_join(parts if tree.ordered else F.sort_array(parts), ""))


def second_digest(text: Column) -> Column:
    return F.xxhash64(F.lit(29), text)


def records(df: DataFrame, record_id: str, scope: Sequence[str], tree, require_leaves: bool = True) -> DataFrame:
    """``(scope..., root, check, form, id)`` of each row: digest, a second digest, full normalised form.

    Rows with a null in ``scope`` or a null id do not count; with ``require_leaves``
    neither do rows with a leaf that is null or normalises to nothing. Other columns
    of ``df`` are ignored, whatever their names.
    """
    keep = F.col(record_id).isNotNull()
    for c in scope:
        keep &= F.col(c).isNotNull()
    names = [f"s{i}" for i in range(len(scope))]
    own = [F.col(c).alias(n) for c, n in zip(scope, names, strict=True)]
    fields = F.struct(*(_text(x).alias(f"l{i}") for i, x in enumerate(leaves(tree))))
    # exploding a single struct keeps the filter from being evaluated apart, which would normalise twice
    rows = df.filter(keep).select(*own, F.col(record_id).alias("id"), F.explode(F.array(fields)).alias("l")).select(*names, "id", "l.*")
    if require_leaves:
        for i, leaf in enumerate(leaves(tree)):
            rows = rows.filter((F.size(f"l{i}") if leaf.is_list else F.length(f"l{i}")) > 0)
    plain = _plain(tree, iter(range(len(leaves(tree)))))
    rows = rows.select(*names, "id", digest(plain).alias("root"), form(plain).alias("form"))
    return rows.select(*names, "root", second_digest(F.col("form")).alias("check"), "form", "id")


def _plain(tree, at):
    """The tree over the columns l0, l1, ..., whose leaves are normalised already."""
    if isinstance(tree, Leaf):
        return Leaf(f"l{next(at)}", lambda x: x, tree.is_list)
    return Node(tuple(_plain(c, at) for c in tree.children), tree.ordered)


def collapse(df: DataFrame, record_id: str, scope: Sequence[str], tree, require_leaves: bool = True) -> DataFrame:
    """Every distinct record once: ``scope`` columns, ``first_id`` and ``n_copies`` (distinct ids).

    An empty table gives an empty result; a record without copies has ``n_copies`` 1. Rows are counted where
    they lie before anything is sent, so that a group with a large part of all rows is no burden to one task.
    """
    rows = records(df, record_id, scope, tree, require_leaves)
    keys = [c for c in rows.columns if c not in ("id", "check")]
    found = rows.select(*keys, "id").distinct().groupBy(*keys).agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
    return found.select(*(F.col(f"s{i}").alias(c) for i, c in enumerate(scope)), "first_id", "n_copies")


def copies(df: DataFrame, record_id: str, scope: Sequence[str], tree, require_leaves: bool = True) -> DataFrame:
    """``(first_id, copy_id)`` for every record that repeats one with a smaller id."""
    rows = records(df, record_id, scope, tree, require_leaves)
    names = [f"s{i}" for i in range(len(scope))]
    short = [*names, "root", "check"]
    heads = rows.groupBy(*short, "form").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("last_id > first_id")
    heads = materialise(heads.select(*short, "form", "first_id"), "copied-records")
    doubtful = materialise(heads.groupBy(*short).agg(F.count("*").alias("n")).filter("n > 1").select(*short), "doubtful-digests")
    clear, members = heads.join(small(doubtful), short, "left_anti"), rows.select(*short, "id")
    pairs = members.join(clear.select(*short, "first_id"), short).filter("id > first_id").select("first_id", F.col("id").alias("copy_id"))
    if not doubtful.isEmpty():  # two digests of 64 bits are the same for different forms
        exact = rows.join(heads.join(doubtful, short, "left_semi"), [*short, "form"]).filter("id > first_id")
        pairs = pairs.unionByName(exact.select("first_id", F.col("id").alias("copy_id")))
    return pairs.distinct()
