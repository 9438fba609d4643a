"""A Merkle manifest of a dataset, kept by content, and proofs read off it.

Rows are leaves. Leaves of one group ascend by id, every ``FAN`` consecutive ones
hash to a node, and so on until one node of the group is left; the groups' nodes
form a tree of their own in the same way. The tree is stored as records from a
digest to its children. A proof descends from the root by the digits of the leaf's
rank, collects at each step the children that were not chosen, and is read
backwards. Leaves below one node share the descent: a step handles one row per
node that any request passes, an eighth of the step after it.

A digest is the SHA-256 of all inputs joined, in lower-case hexadecimal; digests
are inputs as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from .scratch import settled

FAN = 8
_BITS = FAN.bit_length() - 1
_STEP = "struct<left:string,right:string>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A field as a leaf's input: ``-`` for null, else its UTF-8 bytes' count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row."""
    return digest(*[encoded(f) for f in fields])


@dataclass(frozen=True)
class Manifest:
    """``records`` and ``above``: per height from 1, a table ``digest, children`` of the
    inner nodes of that height, once each; ``above`` are those over the groups.
    ``leaves``: the leaves in runs of up to ``FAN``: ``tree, run, items``, the items
    being structs of the leaf's position and the columns given to ``build``.
    ``trees``: ``group, tree`` (its rank among the groups), ``height, subroot``.
    ``root`` is None and ``height`` 0 if there are no rows."""

    records: list[DataFrame]
    above: list[DataFrame]
    leaves: DataFrame
    trees: DataFrame
    root: str | None

    def stored(self) -> DataFrame:
        """All records, ``digest, children``."""
        tables = [*self.records, *self.above]
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table)
        return out.dropDuplicates(["digest"])


def _recorded(nodes: DataFrame) -> DataFrame:
    """Records by content: equal digests have equal children and are kept once."""
    return settled(nodes.select("digest", "children").dropDuplicates(["digest"]), "merkle-records")


def _raised(nodes: DataFrame, records: list[DataFrame]) -> DataFrame:
    """Runs of ``nodes`` (``tree, height, at, digest``) hashed; their records are put down."""
    runs = nodes.groupBy("tree", "height", F.shiftright("at", _BITS).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("_run"))
    children = F.transform("_run", lambda n: n["digest"])
    up = settled(runs.select("tree", "height", "at", F.sha2(F.array_join(children, ""), 256).alias("digest"), children.alias("children")), "merkle-level")
    records.append(_recorded(up))
    return up.drop("children")


def _height(count: Column) -> Column:
    """How often ``count`` nodes are put into runs until one is left."""
    return F.when(count > 1, F.ceil(F.length(F.bin(count - 1)) / _BITS)).otherwise(0).cast("int")


def build(rows: DataFrame, group: str, id: str, keep: tuple[str, ...] = ()) -> Manifest:
    """The manifest of ``rows``, which hold a ``leaf`` digest.

    Groups and ids may be null; a null group is the first group and a null id the
    first of its group. Rows of one id follow each other by digest; rows that
    repeat are leaves of their own. Any number of rows, also of one group, spreads
    over tasks: ranks come from running counts. ``keep`` names columns that stay
    with the leaves besides the id. No rows give a manifest without a root.
    """
    plain = rows.select(F.col(group).alias("group"), F.col(id).alias("id"), F.col("leaf").alias("digest"), F.struct(id, *keep).alias("kept"))
    # Hashed once: cutting the order reads its input twice.
    placed = with_position(settled(plain, "merkle-leaves"), ["group"], "id", ["digest"], name="at")
    placed = settled(placed.select("group", "at", "digest", "kept"), "merkle-placed")
    # One row per group; groups are ranked by running counts as well.
    sizes = settled(with_position(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(0)), ["_one"], "group", name="tree").drop("_one"), "merkle-groups")
    groups = sizes.agg(F.count(F.lit(1)).alias("n"), F.max(_height(F.col("n"))).alias("most")).first()
    records: list[DataFrame] = []
    joined = placed.join(sizes.withColumnRenamed("group", "_group").withColumn("height", _height(F.col("n"))), F.col("group").eqNullSafe(F.col("_group")))
    runs = joined.groupBy("tree", F.shiftright("at", _BITS).alias("run")).agg(
        F.max("height").alias("height"), F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("_run"), F.collect_list(F.struct("at", "digest", "kept")).alias("items")
    )
    children = F.transform("_run", lambda n: n["digest"])
    # A leaf alone in its group is its node as it is.
    node = F.when(F.col("height") == 0, children[0]).otherwise(F.sha2(F.array_join(children, ""), 256))
    low = settled(runs.select("tree", "run", "height", "items", node.alias("digest"), children.alias("children")), "merkle-leaves")
    records.append(_recorded(low.filter("height > 0")))
    level = low.select("tree", "height", F.col("run").alias("at"), "digest")
    tops = [level.filter("height <= 1").select("tree", "digest")]
    for done in range(1, groups["most"] or 0):
        level = _raised(level.filter(F.col("height") > done), records)
        tops.append(level.filter(F.col("height") == done + 1).select("tree", "digest"))
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    trees = settled(
        sizes.join(top, "tree").select("group", "tree", _height(F.col("n")).alias("height"), F.col("digest").alias("subroot")), "merkle-trees"
    )
    above: list[DataFrame] = []
    level, left = trees.select(F.lit(0).alias("height"), F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("digest")), groups["n"]
    while left > 1:
        level, left = _raised(level, above), -(-left // FAN)
    root = level.first()["digest"] if left else None
    return Manifest(records, above, low.select("tree", "run", "items"), trees, root)


def _chosen(at: Column, children: Column) -> Column:
    """The child at ``at`` and the ones before and after it."""
    side = lambda start, n: F.array_join(F.slice(children, start, n), "")
    return F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.size(children) - at - 1).alias("right"))


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """A proof for every requested leaf: ``tree, at, leaf, kept, subroot, path``.

    ``requests`` has ``tree`` and ``at`` (a leaf's rank in its group); without it all
    leaves are asked for. Ranks that no leaf has give no row. ``path`` lists the
    siblings level by level from the leaf to the root, as the text ``left`` and
    ``right`` of the chosen node.
    """
    trees, leaves = manifest.trees, manifest.leaves
    spark = trees.sparkSession
    if requests is not None:
        asked = requests.select("tree", "at").distinct()
        leaves = leaves.select("tree", "run", F.explode("items").alias("_i")).join(
            asked, [leaves["tree"] == asked["tree"], F.col("_i.at") == asked["at"]], "left_semi"
        ).groupBy("tree", "run").agg(F.collect_list("_i").alias("items"))
        leaves = settled(leaves, "merkle-asked")
    wanted = leaves.select("tree").distinct().join(trees, "tree")
    # Down the tree of groups: one row per node, by the digits of the groups' ranks.
    start = spark.createDataFrame([(0, manifest.root)] if manifest.root else [], "at long, digest string")
    paths = start.withColumn("path", F.array().cast(f"array<{_STEP}>"))
    one = F.lit(0).cast("long").alias("tree")
    for left in range(len(manifest.above) - 1, -1, -1):
        ranks = wanted.select(one, F.shiftright("tree", _BITS * left).alias("at")).distinct()
        paths = _descended(manifest.above[left], paths.select(one, "at", "digest", "path"), ranks)
    at_groups = paths.select(F.col("at").alias("tree"), "digest", "path").join(wanted.select("tree", "height", "subroot"), "tree")
    frontier = settled(at_groups.select("tree", F.lit(0).cast("long").alias("at"), "digest", "path", "height", "subroot"), "merkle-frontier")
    # Down the trees of the groups, to the nodes just above leaves.
    heights = sorted(r["height"] for r in frontier.select("height").distinct().collect())
    ready, now = [frontier.filter("height <= 1")], frontier.filter("height > 1")
    for left in range(max(heights, default=0) - 1, 0, -1):
        stay = now.filter(F.col("height") <= left)
        go = now.filter(F.col("height") == left + 1)
        asked = leaves.select("tree", F.shiftright("run", _BITS * (left - 1)).alias("at")).distinct()
        carried = go.select("tree", "at", "digest", "path", F.struct("height", "subroot").alias("_of"))
        down = _descended(manifest.records[left], carried, asked).select("tree", "at", "digest", "path", F.lit(left).alias("height"), "_of.subroot")
        now = settled(stay.unionByName(down), "merkle-frontier")
        if left == 1:
            ready.append(now)
    above = ready[0]
    for more in ready[1:]:
        above = above.unionByName(more)
    found = above.join(manifest.records[0], "digest", "left").withColumnRenamed("at", "run").join(leaves, ["tree", "run"])
    each = found.select("tree", "subroot", "path", "children", "height", F.explode("items").alias("_i"))
    here = _chosen((F.col("_i.at") % FAN).cast("int"), F.col("children"))
    whole = F.when(F.col("height") > 0, F.concat("path", F.array(here))).otherwise(F.col("path"))
    return each.select("tree", F.col("_i.at").alias("at"), F.col("_i.digest").alias("leaf"), F.col("_i.kept").alias("kept"), "subroot", F.reverse(whole).alias("path"))


def _descended(records: DataFrame, frontier: DataFrame, asked: DataFrame) -> DataFrame:
    """One step down: ``frontier`` (``tree, at, digest, path`` and more) to the children
    that ``asked`` (``tree, at``) names by the ranks' digits so far.

    Both sides of the join on digests are read as written, so one that very many
    equal subtrees share is split by the adaptive skew join.
    """
    held = settled(frontier.join(records, "digest"), "merkle-held")
    low = F.col("_at").bitwiseAND(F.lit(FAN - 1)).cast("int")
    down = held.join(asked.select("tree", F.col("at").alias("_at"), F.shiftright("at", _BITS).alias("at")), ["tree", "at"])
    rest = [c for c in frontier.columns if c not in ("tree", "at", "digest", "path")]
    return settled(
        down.select("tree", F.col("_at").alias("at"), F.col("children")[low].alias("digest"), F.concat("path", F.array(_chosen(low, F.col("children")))).alias("path"), *rest),
        "merkle-frontier",
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda now, step: digest(step["left"], now, step["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified(docs: DataFrame, group: str = "lang", id: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """Every row's leaf, proof and root, and the root that its proof leads to now.

    The tree is built from ``docs``. Rows are then read again with the columns in
    ``tampered`` in place of their own, and each is checked against the root by the
    siblings of its proof. Returns ``id, leaf, subroot, root, proof_sha256,
    folded_root, verified``. Null fields count as null, empty texts as empty; a
    text of any length is hashed in the JVM as it is; other columns of ``docs`` do
    not matter. An empty table gives an empty result.
    """
    now = tampered or {}
    rows = docs.select(
        F.col(f"`{group}`").alias("group"), F.col(f"`{id}`").alias("id"),
        leaf([F.col(f"`{f}`") for f in fields]).alias("leaf"), leaf([now.get(f, F.col(f"`{f}`")) for f in fields]).alias("now"),
    )
    manifest = build(rows, "group", "id", keep=("now",))
    root = F.lit(manifest.root).cast("string")
    back = folded(F.col("kept.now"), F.col("path"))
    return prove(manifest).select(
        F.col("kept.id").alias("id"), "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The check of ``op13_merkle`` for at most 8^7 documents of a language and 8^3 languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    lower = f"CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    raised = lambda new, old: (
        f", {new} AS (SELECT lang, pos // 8 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, any_value((n + 7) // 8) AS n FROM {old} WHERE n > 1 GROUP BY lang, pos // 8 UNION ALL SELECT * FROM {old} WHERE n = 1)"
    )
    sides = lambda new, old: (
        f", {new} AS (SELECT lang, pos, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
        f"coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {old} WHERE n > 1 WINDOW run AS (PARTITION BY lang, pos // 8 ORDER BY pos))"
    )
    low, high = 7, 3
    steps = [f"w{k}" for k in range(low)] + [f"v{k}" for k in range(high)]
    join = [f"LEFT JOIN w{k} ON w{k}.lang IS NOT DISTINCT FROM d.lang AND w{k}.pos = d.pos // {FAN**k}" for k in range(low)]
    join += [f"LEFT JOIN v{k} ON v{k}.pos = t.pos // {FAN**k}" for k in range(high)]
    fold = [f"CASE WHEN {w}.l IS NULL THEN f{i} ELSE sha256({w}.l || f{i} || {w}.r) END AS f{i + 1}" for i, w in enumerate(steps)]
    return f"""
WITH d AS (SELECT doc_id, lang, {row("text")} AS leaf, {row("now")} AS now FROM (SELECT *, {lower} AS now FROM documents))
, p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)
, s0 AS (SELECT lang, pos, leaf AS digest, n FROM p){"".join(raised(f"s{k + 1}", f"s{k}") + sides(f"w{k}", f"s{k}") for k in range(low))}
, t AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s{low})
, g0 AS (SELECT NULL AS lang, pos, subroot AS digest, n FROM t){"".join(raised(f"g{k + 1}", f"g{k}") + sides(f"v{k}", f"g{k}") for k in range(high))}
, f AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM g{high}) AS root, sha256({" || ".join(f"coalesce({w}.l || {w}.r, '')" for w in steps)}) AS proof_sha256, now AS f0, {", ".join(fold)}
FROM p AS d JOIN t ON t.lang IS NOT DISTINCT FROM d.lang {" ".join(join)})
SELECT doc_id, leaf, subroot, root, proof_sha256, f{low + high} AS folded_root, f{low + high} = root AS verified FROM f
"""


SQL = _sql()
