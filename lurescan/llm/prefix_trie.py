"""Prefix trie of conversations: a broadcast splitter skeleton, sorted shards, and a reduction.

A conversation is the path of its turns' digests. Distinct paths are cut into ranges by splitter paths.
Every prefix of a splitter is a skeleton node; any other node has all its members between two splitters,
so the shard of that range finishes it alone while it streams its sorted paths. For skeleton nodes a
shard gives partial sums, which are added up over all shards. Texts never leave the first step: a turn
travels as 16 bytes of digest and the length of its text.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.llm.text import stored

#: Bytes of a turn in a path: digest of role and text, then the bytes of the text.
DIGEST, TURN = 16, 24

#: Distinct paths that a shard should have, paths sampled per shard to place the splitters, and the turns
#: of a splitter that count: the skeleton has at most ``shards * SPLITTER_TURNS`` nodes.
SHARD, SAMPLED, SPLITTER_TURNS = 100_000, 20, 64

#: Conversation ids whose quotient by this is equal are joined to one string before they are hashed.
ID_CHUNK = 1024

#: Shared opening turns are looked up among so many first turns at most.
LONGEST_HEAD = 8


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path``: each conversation with the opening of the one that starts its group of five.

    Conversation c takes the first h turns of conversation ``c - c % 5``, h = crc32(c) % 9, and its own
    turns after its first h. Turns are ordered by ``turn`` (NULL first), equal ones by their digest, so
    repeated rows are repeated turns. NULL role or text is empty. Rows without conv_id belong to no
    conversation. A path is one binary of :data:`TURN` bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.concat(_digest(role, text), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0"))).alias("t"),
        ).alias("turn"),
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn"))["t"].alias("ts"))
    own = ordered.select(
        "conv_id", "ts", (F.col("conv_id") - F.col("conv_id") % 5).alias("lead"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int").alias("h"))
    leads = ordered.filter(F.col("conv_id") % 5 == 0).select(
        F.col("conv_id").alias("lead"), F.slice("ts", 1, LONGEST_HEAD).alias("head"))
    joined = own.join(leads, "lead", "left")
    empty = F.array().cast("array<binary>")
    head = F.coalesce(F.expr("slice(head, 1, h)"), empty)
    rest = F.expr("slice(ts, h + 1, greatest(size(ts), 1))")
    path = F.aggregate(F.concat(head, rest), F.lit(b""), lambda a, t: F.concat(a, t))
    return joined.select("conv_id", path.alias("path"))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.left(F.sha2(F.concat_ws("\0", F.octet_length(role).cast("string"), role, text), 256), F.lit(2 * DIGEST)))


def trie(paths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the paths, the root included; no paths give no rows.

    ``conv_id`` is the smallest member; ``depth``; ``parent_conv_id`` the parent's conv_id (root: NULL);
    ``n_convs`` members; ``n_children``; ``n_leaves`` childless nodes of the subtree; ``saved_tokens`` sums
    (members - 1) x bytes of the last text over the subtree; ``ends_sha256`` hashes the ids of the members
    that end there. A subtree includes its top. Equal ids with different paths are different members.
    """
    spark = paths.sparkSession
    ends = stored(_distinct(paths))
    cuts, skeleton = _splitters(ends)
    bounds = spark.sparkContext.broadcast((cuts, skeleton))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = bounds.value[0]
        for batch in batches:
            shard = [bisect.bisect_right(splits, _digests(p)) for p in batch.column(0).to_pylist()]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    dealt = ends.mapInArrow(place, "path binary, n bigint, least bigint, ends string, shard int")
    dealt = dealt.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_shards(batches, bounds.value[1]))

    made = stored(dealt.mapInArrow(build, _NODES))
    tops = _skeleton_rows(made, skeleton)
    whole = made.filter(F.col("part") == "whole")
    under = whole.filter(F.col("top") >= 0).drop("parent_conv_id")
    # at most shards * SPLITTER_TURNS rows
    top_rows = spark.createDataFrame(
        tops, "node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    parents = F.broadcast(top_rows.select(F.col("node").alias("top"), F.col("conv_id").alias("parent_conv_id")))
    return whole.filter(F.col("top") < 0).select(*_RESULT).unionByName(
        under.join(parents, "top").select(*_RESULT)).unionByName(top_rows.select(*_RESULT))


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_FIELDS = [
    ("part", pa.string()), ("top", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()),
]
_NODES = (
    "part string, top int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _distinct(paths: DataFrame) -> DataFrame:
    """``path, n, least, ends``: each distinct path, its conversations, and the hash of their ids in order.

    Ids are joined to strings by range before the shuffle to one place, where a path's ids are hashed as
    a stream, so a path of a third of all conversations costs one row per :data:`ID_CHUNK` of ids.
    """
    chunk = F.floor(F.col("conv_id") / ID_CHUNK)
    ids = F.array_sort(F.collect_list("conv_id"))
    chunks = paths.groupBy("path", chunk.alias("chunk")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    joined = chunks.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    dealt = joined.repartition("path").sortWithinPartitions("path", "chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_streamed(batches), [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["path", "n", "least", "ends"])

    return dealt.select("path", "n", "least", "ids").mapInArrow(hashed, "path binary, n bigint, least bigint, ends string")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    path = state = None
    n = least = 0
    for batch in batches:
        for p, count, low, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if p != path:
                if path is not None:
                    yield path, n, least, state.hexdigest()
                path, n, least, state = p, 0, low, hashlib.sha256()
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n, least = n + count, min(least, low)
    if path is not None:
        yield path, n, least, state.hexdigest()


def _batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size: int = 4096) -> Iterator[pa.RecordBatch]:
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names=names)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names=names)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    return _batched(rows, [t for _, t in _FIELDS], [n for n, _ in _FIELDS])


def _digests(path: bytes) -> tuple[bytes, ...]:
    """The first turns of a path, for comparison with splitters."""
    return tuple(path[i : i + TURN] for i in range(0, min(len(path), SPLITTER_TURNS * TURN), TURN))


def _splitters(paths: DataFrame) -> tuple[list[tuple], dict[tuple, int]]:
    """Splitter paths from a bounded sample, and the number of each of their prefixes.

    The sample places the ranges; it has no influence on the result. The root is node 0.
    """
    shards = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-paths.count() // SHARD))
    skeleton: dict[tuple, int] = {(): 0}
    sample = paths.select(F.xxhash64("path").alias("o"), F.substring("path", 1, SPLITTER_TURNS * TURN).alias("p"))
    picked = sorted(_digests(bytes(r["p"])) for r in sample.orderBy("o", "p").limit(SAMPLED * shards).collect())
    cuts = sorted({picked[len(picked) * i // shards] for i in range(1, shards)} - {()}) if picked else []
    for cut in cuts:
        for d in range(1, len(cut) + 1):
            skeleton.setdefault(cut[:d], len(skeleton))
    return cuts, skeleton


class _Node:
    __slots__ = ("top", "turn", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, top: int, turn: bytes):
        self.top, self.turn = top, turn
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.waiting = None, None, []

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def _bytes(turn: bytes) -> int:
    return struct.unpack(">q", turn[DIGEST:])[0] if turn else 0


def _shards(batches: Iterator[pa.RecordBatch], skeleton: dict[tuple, int]) -> Iterator[tuple]:
    """Nodes of sorted paths. ``whole`` rows are finished nodes, ``top`` the skeleton node above them, if
    their parent is one; ``sum`` rows are what this shard adds to a skeleton node."""
    stack: list[_Node] = []
    shard = None
    for batch in batches:
        for path, n, least, ends, where in zip(*(c.to_pylist() for c in batch.columns)):
            if where != shard:
                while stack:
                    yield from _close(stack)
                shard, stack = where, [_Node(0, b"")]
            turns = [path[i : i + TURN] for i in range(0, len(path), TURN)]
            common = 0
            while common < len(turns) and common + 1 < len(stack) and stack[common + 1].turn == turns[common]:
                common += 1
            while len(stack) > common + 1:
                yield from _close(stack)
            for d in range(common, len(turns)):
                above = stack[-1].top
                top = skeleton.get(tuple(turns[: d + 1]), -1) if above >= 0 and d < SPLITTER_TURNS else -1
                stack.append(_Node(top, turns[d]))
            stack[-1].add(n, least)
            stack[-1].ends = ends
    while stack:
        yield from _close(stack)


def _close(stack: list[_Node]) -> Iterator[tuple]:
    """Finish the deepest open node; its children go out now, as its smallest member is known."""
    node = stack.pop()
    depth = len(stack)
    if stack:
        stack[-1].add(node.n, node.least)
    if node.top >= 0:  # what this shard has of a node that others may share
        yield "sum", node.top, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.ends
        return
    for row in node.waiting:
        yield "whole", -1, *row[:2], node.least, *row[2:]
    leaves = node.leaves if node.children else 1
    saved = node.saved + (node.n - 1) * _bytes(node.turn)
    above = stack[-1]
    above.children += 1
    above.leaves += leaves
    above.saved += saved
    row = node.least, depth, node.n, node.children, leaves, saved, node.ends or NO_ENDS
    if above.top >= 0:
        yield "whole", above.top, *row[:2], None, *row[2:]
    else:
        above.waiting.append(row)


def _skeleton_rows(made: DataFrame, skeleton: dict[tuple, int]) -> list[tuple]:
    """The skeleton nodes: the shards' sums added up, then carried from the tips to the root."""
    sums = made.filter(F.col("part") == "sum").groupBy("top").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"))
    found = {r["top"]: r for r in sums.collect()}  # at most shards * SPLITTER_TURNS rows
    if not found:
        return []
    children, leaves, saved = ({k: r[c] for k, r in found.items()} for c in ("children", "leaves", "saved"))
    rows = []
    for key in sorted(skeleton, key=len, reverse=True):
        node = skeleton[key]
        r = found[node]
        parent = skeleton[key[:-1]] if key else None
        leaves[node] = leaves[node] if children[node] else 1
        saved[node] += (r["n"] - 1) * _bytes(key[-1] if key else b"")
        if key:
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        least = found[parent]["least"] if key else None
        rows.append((node, r["least"], len(key), least, r["n"], children[node], leaves[node], saved[node], r["ends"] or NO_ENDS))
    return rows


def oracle_sql() -> str:
    """The result of the query in SQL."""
    step = "xor(c >> 1, 3988292384 * (c & 1))"  # CRC-32, one bit
    byte = f"list_reduce(list_transform(range(8), lambda i: CAST(i AS BIGINT)), lambda c, i: {step}, xor(a, x))"
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    keyed AS (
        SELECT conv_id, turn, strlen(text) AS b, sha256(CAST(strlen(role) AS VARCHAR) || chr(0) || role || chr(0) || text) AS d
        FROM turns),
    own AS (
        SELECT conv_id AS c, list({{'d': d, 'b': b}} ORDER BY turn NULLS FIRST, d) AS ts FROM keyed GROUP BY conv_id),
    opened AS (
        SELECT c, ts, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                                      lambda a, x: {byte}, 4294967295), 4294967295) % 9 AS h
        FROM own),
    paths AS (
        SELECT o.c, list_concat(coalesce(l.ts[1 : o.h], []), o.ts[o.h + 1 :]) AS p
        FROM opened o LEFT JOIN own l ON l.c = o.c - o.c % 5),
    places AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths),
    members AS (
        SELECT c, d, len(p) = d AS last, CASE WHEN d = 0 THEN 0 ELSE p[d].b END AS b,
               sha256(array_to_string(list_transform(p[1 : d], lambda t: t.d), ',')) AS k,
               sha256(array_to_string(list_transform(p[1 : greatest(d - 1, 0)], lambda t: t.d), ',')) AS up
        FROM places),
    nodes AS (
        SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(b) AS b,
               sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
        FROM members GROUP BY d, k),
    kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, up),
    whole AS (SELECT n.*, coalesce(x.n, 0) AS kids FROM nodes n LEFT JOIN kids x ON n.d = x.d AND n.k = x.k),
    below AS (
        SELECT m.d, m.k, count(*) FILTER (w.kids = 0) AS leaves, sum((w.n - 1) * w.b) AS saved
        FROM whole w JOIN members m ON m.c = w.c AND m.d <= w.d GROUP BY m.d, m.k)
    SELECT w.c AS conv_id, w.d AS depth, u.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children,
           x.leaves AS n_leaves, CAST(x.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
    FROM whole w JOIN below x ON x.d = w.d AND x.k = w.k LEFT JOIN nodes u ON u.d = w.d - 1 AND u.k = w.up"""
