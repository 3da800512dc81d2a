"""Components of confirmed pairs out of posting lists, without all pairs of a list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmaq.llm.components import components
from tarmaq.llm.store import written


@dataclass
class Linked:
    """links (a, b) that hold; label (id, component) of linked ids; open (key, id, c): members of the lists that lie in several
    components c, without a list's centre; centres (key, o); tried (a, b): the pairs that were confirmed or not."""

    links: DataFrame | None
    label: DataFrame | None
    open: DataFrame
    centres: DataFrame
    tried: DataFrame


def labelled(member: DataFrame, label: DataFrame | None) -> DataFrame:
    """Adds c, the component of each id; an id without links is its own."""
    if label is None:
        return member.withColumn("c", F.col("id"))
    return member.join(label, "id", "left").select(*member.columns, F.coalesce("component", "id").alias("c"))


def several(member: DataFrame, key: list[str]) -> DataFrame:
    """The rows of those keys whose members (key, id, c) lie in several components."""
    lists = member.groupBy(*key).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*key)
    return member.join(lists, key, "left_semi")


def _across(left: DataFrame, tried: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows of left(id, o, best) that were not tried, either way round, and whose ends lie in two components."""
    left = left.join(tried.select(F.col("a").alias("id"), F.col("b").alias("o")), ["id", "o"], "left_anti").join(tried.select(F.col("b").alias("id"), F.col("a").alias("o")), ["id", "o"], "left_anti")
    own = labelled(left, label)
    return labelled(own.select(F.col("id").alias("m"), F.col("o").alias("id"), "best", F.col("c").alias("mc")), label).where("mc <> c").select(F.col("m").alias("id"), F.col("id").alias("o"), "best")


def in_turns(post: DataFrame, confirm: Callable[[DataFrame], DataFrame], first: int) -> Linked:
    """centred with the lists of one in ``first`` keys, then with those others whose members still lie in several components.

    Members of a large group of copies share many lists. A part of them links most of the group, and a list within one component has
    no pair left to try, so most lists never meet their centres; no pair across components is left out.
    """
    head = F.pmod(F.xxhash64("key"), F.lit(first)) == 0
    one = centred(post.where(head), confirm)
    left = written(several(labelled(post.where(~head), one.label), ["key"]).drop("c"))
    two = centred(left, confirm, known=one)
    still = several(labelled(one.open.drop("c"), two.label), ["key"])
    return Linked(two.links, two.label, still.unionByName(two.open), one.centres.unionByName(two.centres), two.tried)


def centred(post: DataFrame, confirm: Callable[[DataFrame], DataFrame], most: int = 4, known: Linked | None = None) -> Linked:
    """post(key, id, score), distinct in (key, id): candidates are each list's members with its centre.

    confirm takes candidate pairs (a, b), a < b, and returns those that hold. The centre of a list is its member of
    the greatest score, the least id on ties. This is linear in the lists. Members of a large group of copies share many
    lists with many centres, most of which say the same, so they are tried best centre first: one for each member, and as long as the
    pairs left are more than ``most`` times their members, twice as many each round; then the rest. Between rounds only pairs
    across components are left, so every pair of a member and a centre has been tried or lies in one component, and the
    components are those of all of them. A pair of two members, none of them the centre, is left to the caller: ``open`` has the
    lists with such pairs across components. ``known``: what other lists have linked and tried, which the result has too.
    """
    centres = written(post.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("least"))).alias("x")).select("key", (-F.col("x")["least"]).alias("o"), F.col("x")["score"].alias("best")))
    left = post.select("key", "id").join(centres, "key").where("id <> o").groupBy("id", "o").agg(F.max("best").alias("best"))
    links, label, tried = (known.links, known.label, known.tried) if known else (None, None, None)
    left = written(_across(left, tried, label) if known else left)
    take = 1
    while True:
        rows, members = left.agg(F.count("*"), F.count_distinct("id")).first()
        if not rows:
            break
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("best").desc(), "o"))  # at most an id's lists
        now = left if rows <= most * members else left.withColumn("place", place).where(F.col("place") <= take)
        pairs = written(now.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct())
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = written(confirm(pairs))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)
        left = written(_across(left, pairs, label))
        take *= 2
    if tried is None:
        tried = left.select(F.col("id").alias("a"), F.col("o").alias("b"))
    centres = centres.select("key", "o")
    rest = labelled(post.select("key", "id"), label).join(centres, "key").where("id <> o").select("key", "id", "c")
    return Linked(links, label, written(several(rest, ["key"])), centres, tried)


def settled(post: DataFrame, confirm: Callable[[DataFrame], DataFrame], first: Linked, most: int = 4) -> DataFrame | None:
    """The label after all pairs across components of one list have been tried, where nothing but a key tells which can hold.

    As long as these pairs are more than ``most`` times the rows of the open lists, another round takes a further centre of
    each list, which it leaves, so lists get shorter and components larger; what is left then is joined in full.
    """
    member = post.join(first.open.select("key", "id"), ["key", "id"], "left_semi")
    links, label, tried = first.links, first.label, first.tried
    while True:
        member = written(several(labelled(member.select("key", "id", "score"), label), ["key"]))
        per = member.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
        rows, across = per.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not rows:
            return label
        short = across <= most * rows
        if short:
            pairs = member.join(member.select("key", F.col("id").alias("o"), F.col("c").alias("oc")), "key").where("c <> oc AND id < o")
        else:
            top = F.max_by(F.struct("id", "c"), F.struct("score", -F.col("id"))).alias("x")
            centres = written(member.groupBy("key").agg(top).select("key", F.col("x.id").alias("o"), F.col("x.c").alias("oc")))
            pairs = member.join(centres, "key").where("c <> oc")
            member = member.join(centres, "key").where("id <> o")
        pairs = pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        found = written(confirm(pairs))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)
        if short:
            return label
