"""Merkle manifest of a table: levels of digests as parent-linked node rows, climbed by a recursive query.

A row is a leaf. Per group the leaves, in order, and then what each level makes of them, are hashed in runs of FAN_OUT until
one digest is left; the groups' digests are hashed likewise into the root. A proof is the digests beside the way up.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_counted
from .storage import Scratch

FAN_OUT = 8
#: Nodes above more than a HOT_NODES-th of all leaves are broadcast to those that climb; of one level, fewer than HOT_NODES can be.
HOT_NODES = 50_000
NODE = "struct<tree:bigint,level:int,no:bigint>"
#: The tree over the groups' digests; groups are numbered from 0.
TOP = -1
#: A recursive query takes any number of rows, and keeps all its steps in as many partitions as its first: as many as a shuffle
#: has, not the fewer that would do for the first alone.
_RECURSION = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def digest(column: Column) -> Column:
    """The SHA-256 of a string, as 32 bytes."""
    return F.unhex(F.sha2(column.cast("binary"), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field_text(column: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows with no, their place in their group from 0, in the order of the columns; and (group, tree, n), where tree counts the
    groups in their order from 0 and n is a group's size.

    Rows are dealt by ranges of group and order. A row's place in its range is the low half of its increasing id there. Where
    a group starts in a range, how much of it lies in earlier ranges, and how many groups start in those, comes from the
    counts of each range: only these meet over all ranges, rows never do.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    dealt = scratch.write(dealt, "order").withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = scratch.write(dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_start")), "counts")
    earlier = counts.selectExpr(f"{group} AS _group", "_range", "_start", f"coalesce(sum(_n) OVER (PARTITION BY {group} ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    found = dealt.join(earlier, (dealt[group].eqNullSafe(earlier["_group"])) & (dealt["_range"] == earlier["_range"])).withColumn("no", F.col("_at") - F.col("_start") + F.col("_before"))
    groups = counts.groupBy(group).agg(F.sum("_n").alias("n"), F.min("_range").alias("_range"))
    starts = groups.groupBy("_range").agg(F.count("*").alias("_new")).selectExpr("_range", "coalesce(sum(_new) OVER (ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _new")
    ranked = groups.selectExpr("*", f"row_number() OVER (PARTITION BY _range ORDER BY {group}) - 1 AS _own")
    return found.select(*rows.columns, "no"), ranked.join(starts, "_range").select(group, (F.col("_own") + F.col("_new")).alias("tree"), "n")


def _runs(level: DataFrame, at: int, scratch: Scratch, name: str, kept: list[str]) -> DataFrame:
    """The next level of (tree, no, digest, n, size): n nodes of the tree at this level, size leaves below. Trees that have
    one node only are at their end. kept: columns that are gathered in members, beside place and digest."""
    own = F.struct((F.col("no") % FAN_OUT).cast("int").alias("place"), "digest", *kept)
    found = level.where("n > 1").groupBy("tree", F.floor(F.col("no") / FAN_OUT).alias("no")).agg(F.sort_array(F.collect_list(own)).alias("members"), F.first("n").alias("n"), F.sum("size").alias("size"))
    children = F.aggregate("members", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    found = found.withColumn("children", children).withColumn("digest", digest(as_hex(F.col("children")))).withColumn("n", F.ceil(F.col("n") / FAN_OUT))
    return scratch.write(found if kept else found.drop("members"), f"{name}-{at}")


@dataclass(frozen=True)
class Tree:
    """nodes: (node, children, parent, place, size) of all runs, children the digests of a run, parent null at the root. leaves:
    the leaves by runs, as they start to climb. subroots: (tree, subroot, n). root: the root's digest, None without rows."""

    nodes: DataFrame
    leaves: DataFrame
    subroots: DataFrame
    root: bytes | None
    total: int


def build(leaves: DataFrame, group: str, order: list[str], kept: list[str], scratch: Scratch) -> Tree:
    """The tree over leaves (group, *order, digest, *kept). Equal digests in one place of the order are alike, so any of them
    comes first. Each level is written once and an eighth of the one below; no task holds more than a run."""
    rows = leaves.withColumn("_tie", F.monotonically_increasing_id())
    numbered, trees = _numbered(scratch.write(rows, "leaves"), group, [*order, "digest", "_tie"], scratch)
    trees = scratch.write(trees, "trees")
    count, total, most = trees.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # Groups may hold most of the rows and nothing is looked up in them, so they are joined by their counts.
    keyed = trees.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("-")).alias("_key"), "tree", "n")
    with_key = numbered.withColumn("_key", F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("-")))
    level = join_counted(with_key, keyed, ["_key"], total).select("tree", "no", "digest", "n", F.lit(1).cast("long").alias("size"), *kept)
    level = lowest = scratch.write(level, "level-0")
    ends, parts, at, first = [level.where("n = 1").select("tree", "digest", "size")], [], 0, None
    while most > 1:
        at, most = at + 1, -(-most // FAN_OUT)
        level = _runs(level, at, scratch, "level", kept if at == 1 else [])
        first = level if at == 1 else first
        parts.append(level.select(*_node("tree", at, count), "children", "size"))
        ends.append(level.where("n = 1").select("tree", "digest", "size"))
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    subroots = scratch.write(subroots, "subroots")
    top, root, most, at = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("no"), "digest", F.lit(count).cast("long").alias("n"), "size"), None, count, 0
    while most > 1:
        at, most = at + 1, -(-most // FAN_OUT)
        top = _runs(top, at, scratch, "top", [])
        parts.append(top.select(*_node("tree", at, count), "children", "size"))
    if count:
        root = bytes(top.where("n = 1").first().digest)
    nodes = parts[0] if parts else None
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    spark = leaves.sparkSession
    nodes = scratch.write(nodes, "nodes") if parts else spark.createDataFrame([], f"node {NODE}, parent {NODE}, place int, children binary, size long")
    lone = lowest.where("n = 1").select("tree", *_above("tree", count), F.array(F.struct("digest", *kept)).alias("members"), F.lit(b"").alias("children"))
    if first is not None:
        own = first.select("tree", *_node("tree", 1, count), F.transform("members", lambda x: F.struct(x["digest"].alias("digest"), *(x[c].alias(c) for c in kept))).alias("members"), "children").drop("node")
        lone = lone.unionByName(own)
    return Tree(nodes, lone, subroots.select("tree", F.col("digest").alias("subroot"), F.col("size").alias("n")), root, total)


def _id(tree: Column, level: Column | int, no: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), no.cast("long").alias("no"))


def _above(tree: str, count: int) -> tuple[Column, Column]:
    """Parent and place of a group's last digest among the groups' digests."""
    t = F.col(tree)
    parent = _id(F.lit(TOP), 1, F.floor(t / FAN_OUT)) if count > 1 else F.lit(None).cast(NODE)
    return parent.alias("parent"), (t % FAN_OUT).cast("int").alias("place")


def _node(tree: str, at: int, count: int) -> tuple[Column, Column, Column]:
    """node, parent and place of a run of the level `at`. A group's last run stands among the groups' digests, the last of
    those has no parent."""
    t, no, last = F.col(tree), F.col("no"), F.col("n") == 1
    over, beside = _above(tree, count)
    parent = F.when(~last, _id(t, at + 1, F.floor(no / FAN_OUT))).when(t == TOP, F.lit(None).cast(NODE)).otherwise(over)
    place = F.when(last & (t != TOP), beside).otherwise((no % FAN_OUT).cast("int"))
    return _id(t, at, no).alias("node"), parent.alias("parent"), place.alias("place")


#: The digests of a run beside the one at a place, and the digest of the run with another one there.
_BESIDE = "concat(substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33))"
_FOLDED = "unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.place), f, substring(n.children, 32 * c.place + 33)))), 256))"

_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, members, children, folded, siblings, node, place FROM {start}
  UNION ALL
  SELECT HINT c.tree, c.members, c.children, transform(c.folded, f -> FOLDED), concat(c.siblings, BESIDE), n.parent, n.place
  FROM climb c JOIN {nodes} n ON c.node = n.node
) SELECT * FROM climb WHERE ENDED"""


def climb(tree: Tree, start: DataFrame, scratch: Scratch) -> DataFrame:
    """start, (tree, members, children, folded, siblings, node, place), with folded and siblings at the root.

    The leaves of a run share all siblings above it, so they climb as one row: each step of the recursive query appends the
    siblings once, and folds each leaf's own digest. First come steps over nodes with few leaves, joined by shuffle, then
    those over the others, which are broadcast: at the root all rows meet one node.
    """
    spark = start.sparkSession
    nodes = tree.nodes.where(f"node.level > 1 OR node.tree = {TOP}")
    often = F.col("size") > tree.total / HOT_NODES
    before = {k: spark.conf.get(k) for k in _RECURSION}
    try:
        for k, v in _RECURSION.items():
            spark.conf.set(k, v)
        # A node isn't above fewer leaves than those below it, so no climb comes back to the first kind.
        if nodes.where(~often).limit(1).count():
            cold = nodes.where(~often).select("node", "children", "parent", "place")
            sql = _CLIMB.replace("HINT", "").replace("FOLDED", _FOLDED).replace("BESIDE", _BESIDE).replace("WHERE ENDED", "LEFT ANTI JOIN {nodes} n ON climb.node = n.node")
            start = scratch.write(spark.sql(sql, start=start, nodes=cold), "climb-1")
        sql = _CLIMB.replace("HINT", "/*+ BROADCAST(n) */").replace("FOLDED", _FOLDED).replace("BESIDE", _BESIDE).replace("ENDED", "node IS NULL")
        return scratch.write(spark.sql(sql, start=start, nodes=nodes.where(often).select("node", "children", "parent", "place")), "climb-2")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def verify(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, with digests as lowercase hex.

    Leaves are rows' fields; each group's leaves are in the order of id_col. Where 3 divides the CRC-32 of the decimal id, the
    leaf that climbs is that of the text with A-Z lower-cased, so the root is missed unless the text has none of these. Null
    ids come first and are never tampered with; null groups are a group, the first. Repeated rows are a leaf each, which of
    them comes first makes no difference. One leaf alone is its group's digest, one group alone the root; without siblings
    the proof is the hash of nothing. An empty table gives no rows. Columns beside the fields are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "merkle")
    leaf = lambda text: digest(F.concat(*(field_text(text if c == text_col else F.col(c)) for c in fields)))
    changed = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    altered = F.when(changed, leaf(F.translate(text_col, UPPER, LOWER)))
    leaves = docs.select(F.col(group_col).alias("_by"), F.col(id_col).alias("id"), leaf(F.col(text_col)).alias("digest"), altered.alias("altered"))
    tree = build(leaves, "_by", ["id"], ["id", "altered"], scratch)
    if tree.root is None:
        return spark.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    replaced = lambda c, i, f: F.concat(c.substr(F.lit(1), 32 * i), f, c.substr(32 * i + 33, F.octet_length(c)))
    own = lambda x: F.coalesce(x["altered"], x["digest"])
    many = F.octet_length("children") > 0
    folded = F.transform("members", lambda x, i: F.when(many, digest(as_hex(replaced(F.col("children"), i, own(x))))).otherwise(own(x)))
    start = tree.leaves.select("tree", F.transform("members", lambda x: F.struct(x["id"].alias("id"), x["digest"].alias("digest"))).alias("members"), "children", folded.alias("folded"), F.lit(b"").alias("siblings"), F.col("parent").alias("node"), "place")
    up = climb(tree, start, scratch)
    up = join_counted(up, tree.subroots, ["tree"], tree.total)
    each = up.select("children", "siblings", "subroot", F.posexplode(F.arrays_zip("members", "folded")).alias("at", "x"))
    beside = F.when(F.octet_length("children") > 0, replaced(F.col("children"), F.col("at"), F.lit(b""))).otherwise(F.lit(b""))
    root = F.lit(tree.root.hex())
    found = each.select(
        F.col("x.members.id").alias(id_col),
        as_hex(F.col("x.members.digest")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(F.concat(as_hex(beside), as_hex(F.col("siblings"))).cast("binary"), 256).alias("proof_sha256"),
        as_hex(F.col("x.folded")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def verify_sql(levels: int, table: str = "documents") -> str:
    """The same rows in DuckDB, for groups of at most FAN_OUT ** levels rows and as many groups."""
    text = lambda t: " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in [*FIELDS[:-1], t])
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
    steps, by = [], f"i // {FAN_OUT}"
    for tree, first in (("l", "SELECT g, i, leaf AS h FROM leaves"), ("t", "SELECT 0 AS g, g AS i, h FROM subroots")):
        steps.append(f"{tree}0 AS ({first})")
        for k in range(1, levels + 1):
            # A group of one node stays as it is, so higher levels only carry it on.
            steps.append(f"{tree}{k} AS (SELECT g, {by} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {tree}{k - 1}) GROUP BY g, {by})")
        if tree == "l":
            steps.append(f"subroots AS (SELECT g, h FROM l{levels})")
    ways, state = [], "SELECT r, doc_id, leaf, g, i, '' AS s, coalesce(changed, leaf) AS f FROM leaves"
    for tree in "lt":
        for k in range(levels):
            run = f"(SELECT g, {by} AS p, list(h ORDER BY i) AS c FROM {tree}{k} GROUP BY g, {by})"
            g = "w.g" if tree == "l" else "0"
            ways.append(f"{tree}w{k} AS (SELECT w.r, w.doc_id, w.leaf, w.g, w.{by} AS i, w.s || CASE WHEN len(c) = 1 AND single THEN '' ELSE array_to_string(list_concat(c[:w.i % {FAN_OUT}], c[w.i % {FAN_OUT} + 2:]), '') END AS s, CASE WHEN len(c) = 1 AND single THEN w.f ELSE sha256(array_to_string(list_concat(c[:w.i % {FAN_OUT}], [w.f], c[w.i % {FAN_OUT} + 2:]), '')) END AS f FROM ({state}) w JOIN {run} x ON x.g = {g} AND x.p = w.{by} JOIN (SELECT g AS o, count(*) = 1 AS single FROM {tree}{k} GROUP BY g) ON o = {g})")
            state = f"SELECT * FROM {tree}w{k}"
        state = f"SELECT * REPLACE (g AS i) FROM lw{levels - 1}" if tree == "l" else state
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256({text("text")}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({text(lower)}) END AS changed FROM {table}),
leaves AS (SELECT r, doc_id, leaf, changed, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{", ".join(steps)}, {", ".join(ways)}
SELECT w.doc_id, w.leaf, s.h AS subroot, t.h AS root, sha256(w.s) AS proof_sha256, w.f AS folded_root, w.f = t.h AS verified
FROM ({state}) w JOIN subroots s ON s.g = w.g CROSS JOIN t{levels} t"""
