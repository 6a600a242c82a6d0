"""Merkle manifest of a table, with proofs made by pointer jumping.

Each row is a leaf: the hash of its fields, each with its length. The leaves of
a group stand in the order of their ids, every ``FAN`` consecutive nodes hash to
their parent, level by level, up to the group's subroot; the subroots, in the
order of the groups, make one more tree up to the root.

A proof is the row of siblings that a leaf meets on its way up. Every inner node
holds the segment of siblings from itself to an ancestor, at first its parent. A
round joins the nodes with themselves: a node appends its ancestor's segment to
its own and points to the ancestor's ancestor, so distances double and a tree of
any height takes as many rounds as its height has bits. The last join puts each
leaf below its parent. Nodes near the root are few and pointed to by many: they
are broadcast where Spark measures them small, else AQE splits their partitions.

Leaves get their places without a window over a group: they are sorted in
ranges, numbered within each, and what the earlier ranges of the group hold is
added. Rows that are equal throughout are spread over ranges too.

Defined results: a null field is hashed as such and differs from an empty one;
null groups are a group that comes first, null ids come first in theirs; rows
that share an id stand in the order of their leaves, so any order of input gives
one root; a lone leaf is its subroot, a lone subroot the root, and its proof is
empty; an empty table gives no rows; further columns are left alone.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import settled

FAN, DIGEST, TOP = 3, 32, -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "array<struct<left:binary,right:binary>>"


def _shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of fields: `-` for a null, else UTF-8 length, a colon and the value."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return _hash(F.concat(*map(part, fields)))


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Each row's ``place`` in its group, from 0, and the ``size`` of the group."""
    # The salt spreads rows that are equal in all that counts; they may change places.
    dealt = rows.withColumn("salt", F.rand(7)).repartitionByRange(group, *order, "salt").sortWithinPartitions(group, *order)
    at = settled(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), name)
    # The high bits of that number are the range's.
    at = at.withColumn("range", F.shiftright("at", 33))
    spans = at.groupBy(group, "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        F.col(group).alias("own"), F.col("range").alias("r"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")
    )
    offsets = settled(offsets, f"{name}-ranges")
    joined = at.join(offsets, F.col(group).eqNullSafe(F.col("own")) & (F.col("range") == F.col("r")))
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "size")


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """(tree, place, digest, size) to the levels above: (tree, place, kids, digest, size)."""
    out = []
    while most > 1:
        runs = nodes.where("size > 1").groupBy("tree", F.floor(F.col("place") / FAN).alias("place")).agg(
            F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"), F.max("size").alias("size")
        )
        kids = F.aggregate("run", F.lit(b""), lambda acc, k: F.concat(acc, k["digest"]))
        above = runs.select("tree", "place", kids.alias("kids"), F.ceil(F.col("size") / FAN).alias("size"))
        above = above.select("tree", "place", "kids", _hash(_shown(F.col("kids"))).alias("digest"), "size")
        nodes = settled(above, f"level{len(out) + 1}")
        out.append(nodes)
        most = -(-most // FAN)
    return out


def _entry(kids: Column, place: Column) -> Column:
    """What stands left and right of a node in its run."""
    k = (place % FAN).cast("int") * DIGEST
    left = F.substring(kids, F.lit(1), k)
    right = F.substring(kids, k + DIGEST + 1, F.lit(FAN * DIGEST))
    return F.array(F.struct(left.alias("left"), right.alias("right")))


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (the given columns, tree, place, size, leaf), ``subroots`` (tree,
    group, subroot), ``levels`` of all inner nodes, the root's digest and its key."""

    leaves: DataFrame
    subroots: DataFrame
    levels: list[tuple[int, DataFrame]]
    root: bytes | None
    end: tuple[int, int]


def manifest(rows: DataFrame, carry: Sequence[str] = ()) -> Manifest:
    """The trees of rows (id, grp, leaf, and the columns to carry along)."""
    leaves = placed(rows.select("id", "grp", "leaf", *carry), "grp", ["id", "leaf"], "leaves")
    sizes = settled(leaves.groupBy("grp").agg(F.max("size").alias("size")), "groups")
    groups = placed(sizes.withColumn("all", F.lit(0)).withColumnRenamed("size", "leaves"), "all", ["grp"], "order")
    groups = settled(groups.select(F.col("grp").alias("own"), F.col("place").alias("tree"), "leaves"), "trees")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("leaves")).first()
    leaves = leaves.join(groups.drop("leaves"), F.col("grp").eqNullSafe(F.col("own"))).drop("own", "grp")
    leaves = settled(leaves, "placed")
    if not n_groups:
        return Manifest(leaves, leaves.selectExpr("tree", "leaf AS subroot"), [], None, (TOP, 0))

    inner = _levels(leaves.select("tree", "place", F.col("leaf").alias("digest"), "size"), most)
    tops = leaves.where("size = 1").select("tree", F.col("leaf").alias("subroot"), F.lit(0).alias("height"))
    for level, nodes in enumerate(inner, 1):
        tops = tops.unionByName(nodes.where("size = 1").select("tree", F.col("digest").alias("subroot"), F.lit(level).alias("height")))
    tops = settled(tops, "subroots")
    upper = _levels(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("digest"), F.lit(n_groups).cast("long").alias("size")), n_groups)
    last = upper[-1].select("digest") if upper else tops.select("subroot")
    end = (TOP, len(upper)) if upper else (0, len(inner))
    return Manifest(leaves, tops, [*enumerate(inner, 1), *enumerate(upper, 1)], bytes(last.first()[0]), end)


def _segments(m: Manifest) -> DataFrame:
    """Every inner node that leaves hang from (tree, place, kids) with the segment up to the root."""
    nodes = None
    for level, frame in m.levels:
        some = frame.select("tree", F.lit(level).alias("level"), "place", "kids", F.col("size") == 1)
        nodes = some if nodes is None else nodes.unionByName(some)
    nodes = nodes.toDF("tree", "level", "place", "kids", "top")
    # Where a node hangs: a subroot from the tree of subroots, at the place its tree has.
    climbs = F.col("top") & (F.col("tree") != TOP)
    at = F.when(climbs, F.col("tree")).otherwise(F.col("place"))
    up = F.struct(
        F.when(climbs, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("tree"),
        F.when(climbs, F.lit(1)).otherwise(F.col("level") + 1).alias("level"),
        F.floor(at / FAN).alias("place"),
    )
    nodes = settled(nodes.select(F.struct("tree", "level", "place").alias("node"), at.alias("at"), up.alias("up"), "kids"), "nodes")
    root = F.struct(F.lit(m.end[0]).cast("long").alias("tree"), F.lit(m.end[1]).alias("level"), F.lit(0).cast("long").alias("place"))
    hung = nodes["node"].getField("level") == 1
    parents = nodes.select(F.col("node").alias("up"), F.col("kids").alias("run"))
    held = nodes.withColumn("kids", F.when(hung, F.col("kids")))
    first = held.where(F.col("node") != root).join(parents, "up").select("node", "up", "kids", _entry(F.col("run"), F.col("at")).alias("segment"))
    top = held.where(F.col("node") == root).select("node", F.col("node").alias("up"), "kids", F.array().cast(SEGMENT).alias("segment"))
    frame = settled(first.unionByName(top), "segments")
    arrived, reach = F.col("up") == root, 1
    while not frame.where(~arrived).isEmpty():
        further = frame.select(F.col("node").alias("up"), F.col("up").alias("beyond"), F.col("segment").alias("more"))
        # Whom nobody at this distance points to is left out.
        further = further.where((F.col("up.level") > reach) | (F.col("up.tree") == TOP))
        jumped = frame.where(~arrived).join(further, "up").select("node", F.col("beyond").alias("up"), "kids", F.concat("segment", "more").alias("segment"))
        reach *= 2
        needed = (F.col("node.level") > reach) | (F.col("node.level") == 1) | (F.col("node.tree") == TOP)
        frame = settled(jumped.unionByName(frame.where(arrived)).where(needed), f"reach{reach}")
    return frame.where("node.level = 1").select("node.tree", "node.place", "kids", "segment")


def proofs(m: Manifest) -> DataFrame:
    """The leaves with ``segment``, the siblings from leaf to root, and ``subroot``."""
    if not m.levels:
        with_segment = m.leaves.withColumn("segment", F.array().cast(SEGMENT))
    else:
        alone = F.col("size") == 1
        at = F.when(alone, F.col("tree")).otherwise(F.col("place"))
        leaves = m.leaves.withColumn("at", at).withColumn("hang", F.when(alone, F.lit(TOP)).otherwise(F.col("tree")).cast("long"))
        ends = _segments(m).select(F.col("tree").alias("hang"), F.col("place").alias("up"), "kids", F.col("segment").alias("rest"))
        joined = leaves.withColumn("up", F.floor(F.col("at") / FAN)).join(ends, ["hang", "up"], "left")
        own = F.concat(_entry(F.col("kids"), F.col("at")), F.col("rest"))
        # Without a parent a leaf is the root.
        segment = F.when(F.col("kids").isNull(), F.array().cast(SEGMENT)).otherwise(own)
        with_segment = joined.withColumn("segment", segment).drop("at", "hang", "up", "kids", "rest")
    return with_segment.join(m.subroots.select("tree", "subroot"), "tree")


def folded(leaf: Column, segment: Column) -> Column:
    """The root that a leaf and its siblings come to, as hex."""
    return F.aggregate(segment, _shown(leaf), lambda acc, e: F.sha2(F.concat(_shown(e["left"]), acc, _shown(e["right"])).cast("binary"), 256))


def siblings_digest(segment: Column) -> Column:
    shown = F.transform(segment, lambda e: F.concat(_shown(e["left"]), _shown(e["right"])))
    return F.sha2(F.array_join(shown, "").cast("binary"), 256)


def audited(
    docs: DataFrame,
    tampered: Callable[[], dict[str, Column]] | None = None,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, and folded_root and
    verified of the row as ``tampered`` (columns by name) changes it, if at all."""
    own = {c: F.col(f"`{c}`") for c in fields}
    changed = own | tampered() if tampered else own
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"),
        leaf_of(list(own.values())).alias("leaf"), leaf_of([changed[c] for c in fields]).alias("bent"),
    )
    # What is as it was needs no second digest.
    rows = rows.withColumn("bent", F.when(F.col("bent") != F.col("leaf"), F.col("bent")))
    m = manifest(rows, ["bent"])
    root = F.lit(None if m.root is None else m.root.hex()).cast("string")
    out = proofs(m).withColumn("folded_root", folded(F.coalesce("bent", "leaf"), F.col("segment")))
    return out.select(
        F.col("id").alias(id_col), _shown(F.col("leaf")).alias("leaf"), _shown(F.col("subroot")).alias("subroot"), root.alias("root"),
        siblings_digest(F.col("segment")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )
