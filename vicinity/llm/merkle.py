"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 of its columns, each written as ``-`` if null,
else as its UTF-8 byte count, ``:`` and its value. The leaves of a group (a
language, say) stand in the order of their ids. While a level has more than
one node, every eight consecutive ones (the last run may have fewer, even
one) become the SHA-256 of their hex digests, end to end. The node that
remains is the group's subroot, and the subroots, in the order of their
groups, give the root by the same rule.

How: an aligned block holds ``8 ** LEVELS`` = 512 nodes, and each of its levels is
one string of hex digests, end to end. The parents of a level are hashes of
its fixed-width substrings; a node's siblings are the substrings that flank it
within its run of eight. The tops of the blocks are the nodes of the next
round, and so on up to the subroots, which recurse once more to the root.
Then the way back: a block takes its own path to the root, and hands each of
its nodes that path with the node's flanks in front. The level strings are
kept as ASCII bytes, so that a substring is a copy of its bytes and no search.

Scale: texts are hashed where they are scanned, and only ids and digests move
from then on (one sort by group and id, one grouping into blocks). A block has
512 rows at most, whatever share of the rows one group holds, and paths are
laid out inside blocks, so their 450 bytes a level are never shuffled per row.
The rounds are counted from the size of the largest group (10 billion rows
need four).

Edge cases: null and empty texts have leaves of their own; a null group comes
first, then groups by UTF-8 bytes; rows of one id follow the order of their
leaves; rows that repeat are leaves that repeat; an empty table gives no rows; a
table of one row has its leaf as subroot and root, with an empty proof. Extra
columns are not hashed unless named.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.llm.common import quoted, small_or_shuffled
from vicinity.session import materialize
from vicinity.sources.points import read_table

FANOUT = 8
#: Levels within a block, and the nodes that its lowest level holds at most.
LEVELS = 3
SPAN = FANOUT**LEVELS
HEX = 64
RUN = FANOUT * HEX

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    parts = []
    for value in values:
        s = value.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Tree:
    """Rounds of blocks from the nodes up, and the top of every group."""

    rounds: list[DataFrame]
    tops: DataFrame


def place(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place in their group ``g`` by ``order``, and ``n``, the group's nodes.

    The rows are range-sorted over all tasks and written, so a group of any
    share of the rows is spread; a running sum over the (group, file) counts
    gives each run of rows its start.
    """
    ordered = materialize(
        nodes.orderBy("g", *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")),
        "merkle-order",
    )
    runs = ordered.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_group = Window.partitionBy("g")
    before = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "g", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(by_group).alias("n")
    )
    starts = materialize(starts, "merkle-runs")
    return ordered.join(small_or_shuffled(starts, 100), ["g", "_part"]).withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")


def _depth(n: Column) -> Column:
    """Levels that a block of a group of ``n`` nodes climbs."""
    out = F.when(n <= 1, 0)
    for j in range(1, LEVELS):
        out = out.when(n <= FANOUT**j, j)
    return out.otherwise(LEVELS)


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``(g, block, n, members, l0 .. top, depth)``: every aligned block with each of its levels as one hex string."""
    members = F.array_sort(F.collect_list(F.struct("pos", "node", *carry)))
    out = nodes.groupBy("g", F.floor(F.col("pos") / SPAN).alias("block")).agg(F.first("n").alias("n"), members.alias("members"))
    out = out.withColumn("depth", _depth(F.col("n"))).withColumn("l0", F.expr("CAST(array_join(transform(members, m -> m.node), '') AS BINARY)"))
    for j in range(LEVELS):
        up = f"CAST(array_join(transform(sequence(0, (length(l{j}) - 1) div {RUN}), i -> sha2(substring(l{j}, CAST(i * {RUN} + 1 AS INT), {RUN}), 256)), '') AS BINARY)"
        out = out.withColumn(f"l{j + 1}", F.expr(f"CASE WHEN depth > {j} THEN {up} END"))
    top = F.expr("CAST(coalesce(" + ", ".join(f"l{j}" for j in range(LEVELS, -1, -1)) + ") AS STRING)")
    return out.withColumn("top", top).drop(f"l{LEVELS}")


def climb(nodes: DataFrame, carry: Sequence[str]) -> Tree:
    """Rounds of blocks over ``nodes`` (``g``, ``pos``, ``node``, ``n`` and the columns ``carry``)."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds, tops = [], []
    while True:
        blocks = materialize(_blocks(nodes, carry), "merkle-blocks")
        rounds.append(blocks)
        tops.append(blocks.where(F.col("n") <= SPAN).select("g", "top"))
        if largest <= SPAN:
            break
        largest = -(-largest // SPAN)
        nodes = blocks.where(F.col("n") > SPAN).select("g", F.col("block").alias("pos"), F.col("top").alias("node"), F.ceil(F.col("n") / SPAN).alias("n"))
        carry = []
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Tree(rounds, out)


def _children(blocks: DataFrame, known: Sequence[str]) -> DataFrame:
    """Every node of ``blocks`` (with ``path``, their own way up) as ``(g, member, path, known ...)``."""
    steps = []
    for j in range(LEVELS):
        own, run = f"(i div {FANOUT**j}) * {HEX}", f"(i div {FANOUT ** (j + 1)}) * {RUN}"
        steps.append(
            f"named_struct('left', CAST(substring(l{j}, CAST({run} + 1 AS INT), CAST({own} - {run} AS INT)) AS STRING), "
            f"'right', CAST(substring(l{j}, CAST({own} + {HEX + 1} AS INT), CAST({run} + {RUN - HEX} - {own} AS INT)) AS STRING))"
        )
    flanks = f"slice(array({', '.join(steps)}), 1, depth)"
    # The levels above the block's own depth are null and cut off.
    each = F.expr(f"explode(transform(members, (m, i) -> named_struct('member', m, 'path', concat({flanks}, path))))")
    return blocks.select("g", *known, each.alias("_c")).select("g", *known, "_c.member", "_c.path")


def descend(tree: Tree, tops: DataFrame, known: Sequence[str]) -> DataFrame:
    """All nodes of the lowest round with their paths, from ``tops`` (``g``, ``path``, ``known`` per group)."""
    above, tops = None, small_or_shuffled(tops, 16 << 10)
    for r in range(len(tree.rounds) - 1, -1, -1):
        blocks = tree.rounds[r]
        with_path = blocks.where(F.col("n") <= SPAN).join(tops, "g")
        if above is not None:
            with_path = with_path.unionByName(blocks.where(F.col("n") > SPAN).join(above, ["g", "block"]))
        nodes = _children(with_path, known)
        if r:
            up = nodes.select("g", *known, F.col("member.pos").alias("block"), "path")
            above = small_or_shuffled(materialize(up, "merkle-paths"), 8 << 10)
    return nodes


def manifest(
    df: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Every row of ``df`` as ``(id, group, <carry>, leaf, subroot, root, path)``.

    ``path`` is an array of ``(left, right)`` from the leaf's run up to the
    root: the hex digests of the siblings on either side, end to end.
    ``carry`` names further columns, computed from a row where it is scanned.
    """
    col = {c: F.col(quoted([c])[0]) for c in {*columns, group_col, id_col}}
    carry = carry or {}
    group = F.when(col[group_col].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col[group_col].cast("string")))
    rows = df.select(
        group.alias("g"), col[id_col].alias("id"), col[group_col].alias("group"), leaf([col[c] for c in columns]).alias("node"),
        F.struct(F.lit(0).alias("_none"), *[c.alias(name) for name, c in carry.items()]).alias("more"),
    )
    # Leaves are written before they are sorted: texts are read and hashed once.
    leaves = place(materialize(rows, "merkle-leaves"), ["id", "node"])
    groups = climb(leaves, ["id", "group", "more"])
    top = place(groups.tops.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("top").alias("node")), ["of"])
    over = climb(top, ["of"])
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)")
    roots = descend(over, over.tops.select("g", F.col("top").alias("root"), empty.alias("path")), ["root"])
    tops = roots.select(F.col("member.of").alias("g"), "root", F.col("member.node").alias("subroot"), "path")
    out = descend(groups, materialize(tops, "merkle-tops"), ["root", "subroot"])
    return out.select(
        F.col("member.id").alias("id"), F.col("member.group").alias("group"), *[F.col(f"member.more.{quoted([c])[0]}").alias(c) for c in carry],
        F.col("member.node").alias("leaf"), "subroot", "root", "path",
    )


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what the proof says of a tampered one."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    values = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    m = manifest(docs, carry={"seen": F.when(tampered, leaf(values))})
    m = m.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("path")))
    return m.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: Levels that the SQL climbs in a group and over the groups (8 ** 9 rows, more than DuckDB would be asked to).
_SQL_LEVELS = 9


def _sql() -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"

    def levels(name: str, width: int) -> list[str]:
        """CTEs ``name0 .. nameN`` of ``(g, pos, n, node)``: a level of more than one node becomes its parents."""
        out = []
        for j in range(width):
            out.append(
                f"{name}{j + 1} as materialized (select g, pos // 8 as pos, (n + 7) // 8 as n, sha256(string_agg(node, '' order by pos)) as node "
                f"from {name}{j} where n > 1 group by all)"
            )
        return out

    def flanks(name: str, width: int) -> list[str]:
        """CTEs of ``(g, pos, lft, rgt)``: the siblings on either side of each node of a level that is hashed."""
        run = "partition by g, pos // 8 order by pos rows between"
        return [
            f"{name}f{j} as (select g, pos, coalesce(string_agg(node, '') over ({run} unbounded preceding and 1 preceding), '') as lft, "
            f"coalesce(string_agg(node, '') over ({run} 1 following and unbounded following), '') as rgt from {name}{j} where n > 1)"
            for j in range(width)
        ]

    def walk(name: str, width: int, source: str, tag: str) -> list[str]:
        """CTEs that fold every row of ``source`` (``g``, ``pos``, ``cur``, ``proof``) up the levels of ``name``."""
        out, last = [], source
        for j in range(width):
            out.append(
                f"{tag}{j} as materialized (select x.* replace (x.pos // 8 as pos, case when f.lft is null then x.cur else sha256(f.lft || x.cur || f.rgt) end as cur, "
                f"x.proof || coalesce(f.lft || f.rgt, '') as proof) from {last} x left join {name}f{j} f on f.g = x.g and f.pos = x.pos)"
            )
            last = f"{tag}{j}"
        return out

    upper = f"translate(text, '{_UPPER}', '{_LOWER}')"
    plain = " || ".join(field(c) for c in COLUMNS)
    spoilt = " || ".join(field(upper if c == "text" else c) for c in COLUMNS)
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"
    )
    width = _SQL_LEVELS
    tops = " union all ".join(f"select g, node from s{j} where n = 1" for j in range(width + 1))
    roots = " union all ".join(f"select node from r{j} where n = 1" for j in range(width + 1))
    parts = [
        f"d as (select doc_id, coalesce('=' || lang, '') as g, sha256({plain}) as leaf, case when {crc} % 3 = 0 then sha256({spoilt}) end as seen from documents)",
        "p as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from d)",
        "s0 as (select g, pos, n, leaf as node from p)",
        *levels("s", width), *flanks("s", width),
        f"tops as materialized (select g as of, node, row_number() over (order by g) - 1 as pos, count(*) over () as n, '' as g from ({tops}))",
        "r0 as (select g, pos, n, node from tops)",
        *levels("r", width), *flanks("r", width),
        "w as (select doc_id, leaf, g, pos, coalesce(seen, leaf) as cur, '' as proof from p)",
        *walk("s", width, "w", "w"),
        f"v as (select x.doc_id, x.leaf, t.node as subroot, t.g, t.pos, x.cur, x.proof from w{width - 1} x join tops t on t.of = x.g)",
        *walk("r", width, "v", "v"),
        f"root as (select node as root from ({roots}))",
    ]
    return (
        "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, cur as folded_root, cur = root as verified from v{width - 1}, root"
    )


SQL = _sql()
