"""From hash buckets to connected components: verified links without all pairs of a bucket.

Buckets can hold very many near copies of one text. In each round the few members of a bucket that
share most with others (its hubs) are compared with all members, so a round costs a multiple of the
rows, and a group of n copies of one text costs n comparisons. A hub is then done with its bucket;
buckets whose other members lie in one component are done as well. Most buckets are small and end
after a round or two. Members of those that stay open meet by an exact prefix filter on their rarest
items, so copies that all differ from each other aren't paired n * n times, and no link between
members of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, possibly

HUBS = 4  # of a bucket in one round
ROUNDS = 3
EXTENSION = 16  # more items of a prefix that are compared before a pair is formed


def union_find(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, root) of all ids in edges (a, b): root is the smallest id that can be reached.

    Distributed union-find: every root with a smaller neighbour is hooked to its smallest one, hooks
    are compressed by pointer jumping, and edges are contracted to roots until none is left. Roots
    with a smaller neighbour vanish each round, so rounds are logarithmic. Nothing is collected.
    """
    links = scratch.save(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), f"{tag}-links0")
    ids = links.select(F.explode(F.array("hi", "lo")).alias("id")).distinct()
    roots = scratch.save(ids.withColumn("root", F.col("id")), f"{tag}-roots0")
    n = 0
    while not links.isEmpty():
        n += 1
        hooks = scratch.save(links.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("to")), f"{tag}-hooks{n}-0")
        jump = 0
        while True:  # pointer jumping: afterwards every hook leads to a root that isn't hooked
            up = hooks.select(F.col("id").alias("to"), F.col("to").alias("further"))
            jump += 1
            longer = scratch.save(hooks.join(up, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"{tag}-hooks{n}-{jump}")
            scratch.drop(f"{tag}-hooks{n}-{jump - 1}")
            hooks = longer.select("id", "to")
            if longer.where("moved").isEmpty():
                break
        at = hooks.select(F.col("id").alias("root"), F.col("to").alias("top"))
        roots = scratch.save(roots.join(at, "root", "left").select("id", F.coalesce("top", "root").alias("root")), f"{tag}-roots{n}")
        for end in ("hi", "lo"):
            links = links.join(hooks.select(F.col("id").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = links.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
        links = scratch.save(links, f"{tag}-links{n}")
        scratch.drop(*(f"{tag}-{name}" for name in (f"links{n - 1}", f"roots{n - 1}", f"hooks{n}-{jump}")))
    scratch.release()
    return roots


def set_overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with common and union, the sizes for their sets (id, items)."""
    left = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    right = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    both = pairs.join(left, "b").join(right, "a")
    common = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    return both.select(*pairs.columns, common.alias("common"), (F.size("items_a") + F.size("items_b")).cast("long").alias("sizes")).select(
        *pairs.columns, "common", (F.col("sizes") - F.col("common")).alias("union")
    )


def prefix_tokens(sets: DataFrame, num: int, den: int, extension: int = EXTENSION) -> DataFrame:
    """One row per item of the prefixes of sets (id, items, root): id, root, size, alone, k (its place), item, and `order` if there is an extension."""
    sized = sets.select("id", "root", F.size("items").alias("size"), F.explode("items").alias("item"))
    rarity = sized.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # items of one set only can't be shared: they take places in the prefix, but need no rows
    own = sized.join(rarity, "item").groupBy("id", "root", "size").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("known"))
    alone = F.col("size") - F.size("known")
    room = F.col("size") - F.expr(f"cast((size * {num} + {den - 1}) div {den} as int)") + 1 - alone
    first = own.where(room > 0).withColumns({"alone": alone, "order": F.transform(F.slice("known", F.lit(1), (room + extension).cast("int")), lambda x: x["item"])})
    carried = ["id", "root", "size", "alone", *["order"] * bool(extension)]
    return first.select(*carried, F.posexplode(F.slice("order", F.lit(1), room.cast("int"))).alias("k", "item"))


def prefix_pairs(tokens: DataFrame, num: int, den: int, extension: int = EXTENSION) -> DataFrame:
    """Pairs (a, b) of the sets of prefix_tokens with different roots that can have den * common >= num * union.

    Prefix filter: with items in order of rarity, such sets share an item among their first ones, whose
    number follows from both sizes, and n + 1 items among the first ones and n more (n: extension, whose
    items each row of a prefix carries; 0 for long prefixes). So none is missed, and sets that differ in
    more rare items than that never meet. An item's rows of the root that holds most of them aren't
    paired with each other. tokens should be a stored table: it is read three times.
    """
    most = tokens.groupBy("item", "root").agg(F.count("*").alias("n")).groupBy("item").agg(F.max(F.struct("n", "root")).getField("root").alias("major"), F.count("*").alias("roots")).where("roots > 1")
    few = tokens.join(most.drop("roots"), "item").where("root <> major").alias("x")
    all_ = tokens.alias("y")
    need = F.expr(f"cast(((x.size + y.size) * {num} + {num + den - 1}) div {num + den} as int)")
    more = F.least(F.lit(extension), need - 1)
    left = lambda t: F.col(f"{t}.size") - need - F.col(f"{t}.alone") + 1  # noqa: E731  places of the shorter prefix that can match
    fits = (F.col("x.root") != F.col("y.root")) & (F.col("x.k") < left("x")) & (F.col("y.k") < left("y"))
    if extension:  # one row per pair, at its rarest common item
        begin = lambda t: F.slice(f"{t}.order", F.lit(1), F.greatest(left(t) + more, F.lit(0)).cast("int"))
        shared = F.array_intersect(begin("x"), begin("y"))
        fits = fits & (F.size(shared) > more) & (F.get(shared, F.lit(0)) == F.col("x.item"))
    met = few.join(all_, (F.col("x.item") == F.col("y.item")) & fits)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def link(members: DataFrame, overlap: Callable[[DataFrame], DataFrame], items: Callable[[DataFrame], DataFrame], num: int, den: int, scratch: Scratch, extension: int = EXTENSION) -> DataFrame:
    """(id, root) of ids with at least one link: den * common >= num * union, exactly, between members of a bucket.

    members (bucket, id, n) without repeats, n the number of an id's items; overlap adds common and union,
    the sizes for the items of the ids a and b, to a table of pairs; items gives (id, items) of a table of
    ids, items without repeats. Sets whose sizes alone rule a link out are never compared.
    """
    linked = F.col("common") * den >= F.col("union") * num
    crowd = members.groupBy("bucket").agg(F.count("*").alias("crowd"))
    # who shares most buckets with most others: the text that a group was copied from
    weight = members.join(crowd, "bucket").groupBy("id").agg(F.sum("crowd").alias("w"))
    rest = scratch.save(members.join(weight, "id").withColumn("root", F.col("id")), "rest0")
    edges = roots = None
    for n in range(ROUNDS):
        # the window keeps a few rows of a bucket per task before it shuffles; whole buckets end, so places stay
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("w"), "id"))
        hubs = rest.withColumn("place", place).where(F.col("place") <= HUBS * (n + 1))
        hubs = scratch.save(hubs.select("bucket", "place", *[F.col(c).alias(f"hub_{c}") for c in ("id", "n", "root")]), f"hubs{n}")
        sizes = (F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num) & (F.col("root") != F.col("hub_root"))
        tries = rest.drop("w").join(hubs.where(F.col("place") > HUBS * n), "bucket").where(sizes).select(F.col("hub_id").alias("a"), F.col("id").alias("b"))
        tries = tries.groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b")
        found = scratch.save(overlap(tries).where(linked).select("a", "b"), f"stars{n}")
        edges = found if edges is None else edges.unionByName(found)
        if not found.isEmpty():
            roots = union_find(edges, scratch, f"all{n}")
        at = lambda rows, id_: rows.withColumn("root", F.col(id_)) if roots is None else rows.drop("root").join(roots.withColumnRenamed("id", id_), id_, "left").withColumn("root", F.coalesce("root", id_))  # noqa: B023, E731
        named = scratch.save(at(rest, "id"), f"named{n}")
        # open: what is left without the hubs has several roots
        each = named.select("bucket", "root", F.lit(1).alias("one")).unionByName(at(hubs.select("bucket", "hub_id"), "hub_id").select("bucket", "root", F.lit(-1).alias("one")))
        open_ = each.groupBy("bucket", "root").agg(F.sum("one").alias("left")).where("left > 0").groupBy("bucket").agg(F.count("*").alias("roots")).where("roots > 1").select("bucket")
        rest = scratch.save(named.join(open_, "bucket", "left_semi"), f"rest{n + 1}")
        scratch.drop(f"rest{n}", f"hubs{n}", f"named{n}")
        if rest.isEmpty():
            break
    else:
        open_ = scratch.save(rest.select("id", "root").distinct(), "open")
        tokens = scratch.save(prefix_tokens(items(open_.select("id")).join(open_, "id"), num, den, extension), "tokens")
        pairs = scratch.save(prefix_pairs(tokens, num, den, extension), "pairs")
        more = scratch.save(overlap(pairs).where(linked).select("a", "b"), "more")
        scratch.drop("tokens", "pairs", "open")
        if roots is None or not more.isEmpty():
            roots = union_find(edges.unionByName(more), scratch, "last")
    return roots if roots is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)


def in_buckets(keys: DataFrame) -> DataFrame:
    """keys (bucket, id, ...) that another id shares. The count is a partial aggregate and AQE can split the join, so hot buckets are cheap."""
    shared = keys.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("bucket")
    return keys.join(shared, "bucket", "left_semi")


def crowded(keys: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """keys (bucket, id, ...) whose bucket has several rows. Only counts of buckets are shuffled for most of them. The table `name` must outlive the result."""
    shared = scratch.save(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("id")), name)
    return possibly(shared, keys, "bucket").join(shared.withColumnRenamed("id", "bucket"), "bucket")
