"""The prefix trie of many conversations: shared beginnings, counted in adaptive radix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from ebbtide.llm.blocks import parts_of
from ebbtide.session import pin

#: Bytes of a turn's id: 16 of a digest of role and text, 4 of its number of words.
TURN, WORDS = 20, 4
#: Sequences in one tree, neighbouring trees that are joined at once, and the bits of member numbers in one list.
TREE, FAN, LIST_BITS = 1 << 16, 64, 16
#: Bits of a tree's number inside its range.
CHUNK_BITS = 20
NOBODY = hashlib.sha256(b"").hexdigest()


class Few:
    """Up to 4 or 16 children: their bytes in ascending order and as many nodes."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int = 4) -> None:
        self.bytes, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Few | Indexed:
        """The layout that holds the child: this one, or the next larger one when it is full."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            larger = Few(16) if self.room == 4 else Indexed()
            for b, n in self.items():
                larger = larger.put(b, n)
            return larger.put(byte, node)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children: a place for every byte, 255 for none, and the nodes in order of arrival."""

    __slots__ = ("places", "nodes")

    def __init__(self) -> None:
        self.places, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, byte: int) -> Node | None:
        at = self.places[byte]
        return self.nodes[at] if at != 255 else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        at = self.places[byte]
        if at != 255:
            self.nodes[at] = node
            return self
        if len(self.nodes) == 48:
            larger = Full()
            for b, n in self.items():
                larger.put(b, n)
            return larger.put(byte, node)
        self.places[byte] = len(self.nodes)
        self.nodes.append(node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[at]) for b, at in enumerate(self.places) if at != 255)


class Full:
    """A node or none for each of the 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """A compressed path, a key that runs through it, the payload of the key that ends here, and the children."""

    __slots__ = ("path", "key", "payload", "children", "size", "low", "tops", "leaves", "saved")

    def __init__(self, path: bytes, key: bytes, payload: tuple | None = None) -> None:
        self.path, self.key, self.payload, self.children = path, key, payload, Few()


def common(a: bytes, b: bytes) -> int:
    """How many bytes two texts share at their beginning."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


class RadixTree:
    """An adaptive radix tree over byte strings; a key may begin another one."""

    def __init__(self) -> None:
        self.root = Node(b"", b"")

    def insert(self, key: bytes, payload: tuple) -> None:
        node, at = self.root, 0
        while True:
            if not key.startswith(node.path, at):
                shared = common(node.path, key[at:at + len(node.path)])
                lower = Node(node.path[shared + 1:], node.key, node.payload)
                lower.children = node.children
                byte, node.path, node.payload, node.children = node.path[shared], node.path[:shared], None, Few()
                node.children = node.children.put(byte, lower)
            at += len(node.path)
            if at == len(key):
                node.payload = payload
                return
            below = node.children.get(key[at])
            if below is None:
                node.children = node.children.put(key[at], Node(key[at + 1:], key, payload))
                return
            node, at = below, at + 1


def words_of(key: bytes, depth: int) -> int:
    """Words of the turn that leads to ``depth``."""
    return int.from_bytes(key[depth * TURN - WORDS:depth * TURN], "big")


def measure(tree: RadixTree) -> list[tuple[Node, int, int]]:
    """Fill in every node's numbers, children first; returns (node, begin, end) of their byte spans, parents first.

    ``size`` and ``low`` count the members and name the smallest. ``tops``, ``leaves`` and ``saved`` are those of the turn nodes
    in its span and below: the number of uppermost ones, of childless ones, and the words saved.
    """
    order = [(tree.root, 0, len(tree.root.path))]
    for node, _, end in order:
        order += [(child, end, end + 1 + len(child.path)) for _, child in node.children.items()]
    for node, begin, end in reversed(order):
        children = [child for _, child in node.children.items()]
        count, low = (node.payload[0], node.payload[1]) if node.payload else (0, None)
        node.size = count + sum(c.size for c in children)
        node.low = min([*([low] if node.payload else []), *(c.low for c in children)], default=None)
        node.tops, node.leaves, node.saved = (sum(getattr(c, n) for c in children) for n in ("tops", "leaves", "saved"))
        first, last = begin // TURN + 1, end // TURN
        if last >= first:
            node.tops, node.leaves = 1, node.leaves or 1
            node.saved += (node.size - 1) * sum(words_of(node.key, d) for d in range(first, last + 1))
    return order


NODE = StructType([
    StructField("conv_id", LongType()), StructField("depth", LongType()), StructField("parent_conv_id", LongType()),
    StructField("n_convs", LongType()), StructField("n_children", LongType()), StructField("n_leaves", LongType()),
    StructField("saved_tokens", LongType()), StructField("ends_sha256", StringType()),
])
#: Nodes on the first or last path of a tree may go on in the trees beside it. They are written open, with their own and their
#: parent's mark and what they hold themselves: children, leaves and saved words exclude their children on these paths.
PARTIAL = StructType([
    *NODE, StructField("tree", LongType()), StructField("mark", BinaryType()), StructField("parent", BinaryType()),
    StructField("words", LongType()), StructField("first", BooleanType()), StructField("last", BooleanType()),
    StructField("open", BooleanType()),
])


@dataclass
class Edge:
    """A node on a path at the edge of a tree, as far as its trees are joined."""

    depth: int
    mark: bytes
    parent: bytes | None
    words: int
    low: int = 1 << 63
    size: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    first: bool = False
    last: bool = False

    def row(self, tree: int, open_: bool) -> tuple:
        return (
            self.low, self.depth, None, self.size, self.children, self.leaves, self.saved, self.ends or NOBODY, tree,
            self.mark, self.parent, self.words, self.first, self.last, open_,
        )


def tree_rows(items: list[tuple[bytes, int, int, str]], number: int) -> Iterator[tuple]:
    """All turn nodes of sorted (key, members, smallest, ends), those at the edges open."""
    tree = RadixTree()
    for key, *payload in items:
        tree.insert(key, tuple(payload))
    first, last = items[0][0], items[-1][0]
    root = Edge(0, b"", None, 0, first=True, last=True)
    edges = {b"": root}
    # the lowest turn node above each inner node: its edge, or only its smallest member
    above: dict[int, tuple[Edge | None, int | None]] = {id(tree.root): (root, None)}
    for node, begin, end in measure(tree):
        edge, low = above[id(node)]
        if node is tree.root:
            root.size, root.low, root.ends = node.size, node.low, node.payload and node.payload[2]
        tops, leaves, saved = (sum(getattr(c, n) for _, c in node.children.items()) for n in ("tops", "leaves", "saved"))
        depths = range(begin // TURN + 1, end // TURN + 1)
        words = [words_of(node.key, d) for d in depths]
        under = sum(words) * (node.size - 1)
        for depth, own in zip(depths, words):
            under -= own * (node.size - 1)
            lowest = depth == depths[-1]
            kids, tips, rest = (tops, leaves or 1, saved + under) if lowest else (1, leaves or 1, saved + under)
            ends = node.payload[2] if node.payload and depth * TURN == end else None
            span = slice(depth * TURN - TURN, depth * TURN)
            on_first = edge is not None and edge.first and first[span] == node.key[span]
            on_last = edge is not None and edge.last and last[span] == node.key[span]
            if on_first or on_last:
                mark = hashlib.md5(edge.mark + node.key[span]).digest()
                edge = edges[mark] = Edge(depth, mark, edge.mark, own, node.low, node.size, ends=ends, first=on_first, last=on_last)
            else:
                total = rest + own * (node.size - 1)
                if edge is not None:
                    edge.children, edge.leaves, edge.saved = edge.children + 1, edge.leaves + tips, edge.saved + total
                yield (
                    node.low, depth, low, node.size, kids, tips, total, ends or NOBODY, number,
                    None, None if edge is None else edge.mark, None, None, None, False,
                )
                edge = None
            low = node.low
        for _, child in node.children.items():
            above[id(child)] = edge, low
    for e in edges.values():
        yield e.row(number, True)


def join_edges(rows: list[dict], end: bool) -> Iterator[tuple]:
    """Edges of neighbouring trees as one: those inside are complete, those on its first and last path stay open."""
    lowest, highest = min(r["tree"] for r in rows), max(r["tree"] for r in rows)
    held: dict[bytes, Edge] = {}
    for r in rows:
        e = held.setdefault(r["mark"], Edge(r["depth"], r["mark"], r["parent"], r["words"]))
        e.low, e.size, e.children = min(e.low, r["conv_id"]), e.size + r["n_convs"], e.children + r["n_children"]
        e.leaves, e.saved = e.leaves + r["n_leaves"], e.saved + r["saved_tokens"]
        e.ends = r["ends_sha256"] if r["ends_sha256"] != NOBODY else e.ends
        e.first |= r["first"] and r["tree"] == lowest
        e.last |= r["last"] and r["tree"] == highest
    for e in sorted(held.values(), key=lambda e: -e.depth):
        open_ = not end and (e.first or e.last)
        if not open_:
            e.leaves = e.leaves or 1
            e.saved += (e.size - 1) * e.words
        yield e.row(lowest, open_)
        if not open_ and e.parent is not None:
            parent = held[e.parent]
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + e.leaves, parent.saved + e.saved


MEMBERS = StructType([
    StructField("key", BinaryType()), StructField("n", LongType()), StructField("low", LongType()), StructField("ends", StringType()),
])


def _batches(rows: Iterator[tuple], schema: StructType, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


def turn_lists(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each an id of fixed width.

    Null orders come first, equal ones in the order of their ids; null roles and texts are empty. Repeated rows are turns
    of their own. Rows without a conversation take no part. Texts stay where they are read: an id is a digest and a word count.
    """
    said, told = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, told).cast("binary"))
    words = F.size(F.regexp_extract_all(told, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    turn = F.unhex(F.concat(digest, F.lpad(F.hex(words.cast("bigint")), 8, "0")))
    own = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.struct(F.col(order).alias("o"), turn.alias("id")).alias("_turn")
    )
    ordered = F.sort_array(F.collect_list("_turn"))
    return own.groupBy("conv_id").agg(ordered.alias("_turns")).select("conv_id", F.col("_turns.id").alias("turns"))


def shared_beginnings(lists: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of their group's first one.

    Conversation c takes the first h turns of conversation c - c % group (all if it has fewer, none if there is none), then its own
    turns after its first h; h is the checksum of c modulo ``most``.
    """
    heads = lists.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_lead"), F.slice("turns", 1, most - 1).alias("_head")
    )
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    joined = lists.withColumns({"_of": F.col("conv_id") - F.col("conv_id") % group, "_taken": taken}).join(
        heads, F.col("_of") == F.col("_lead"), "left"
    )
    empty = F.array().cast("array<binary>")
    head = F.slice(F.coalesce("_head", empty), F.lit(1), F.col("_taken"))
    rest = F.slice("turns", F.col("_taken") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _sequences(lists: DataFrame, parts: int) -> DataFrame:
    """Distinct keys with the number of their conversations, the smallest, and the digest of all, ascending.

    Conversations of a key are listed in pieces of neighbouring numbers, at most 2**LIST_BITS of them, and the pieces digested one
    after the other: one key may hold most conversations.
    """
    key = F.coalesce(F.unhex(F.array_join(F.transform("turns", F.hex), "")), F.lit(b""))
    keyed = lists.select("conv_id", key.alias("key"))
    numbers = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = keyed.groupBy(F.md5("key").alias("mark"), F.shiftright("conv_id", LIST_BITS).alias("piece")).agg(
        F.first("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), numbers.alias("numbers")
    )

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        mark, row, digest = None, None, None
        for batch in batches:
            for m, key, n, low, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if m != mark:
                    if row:
                        yield *row, digest.hexdigest()
                    mark, row, digest = m, (key, 0, low), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(numbers.encode())
                row = (key, row[1] + n, row[2])
        if row:
            yield *row, digest.hexdigest()

    sorted_ = pieces.repartition(parts, "mark").sortWithinPartitions("mark", "piece")
    return sorted_.select("mark", "key", "n", "low", "numbers").mapInArrow(
        lambda batches: _batches(digested(batches), MEMBERS), MEMBERS
    )


def _joiner(end: bool) -> Callable[[pa.Table], pa.Table]:
    def joined(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_batches(join_edges(table.to_pylist(), end), PARTIAL), to_arrow_schema(PARTIAL))

    return joined


def prefix_trie(lists: DataFrame, tree_rows_limit: int = TREE) -> DataFrame:
    """One row per distinct beginning of the conversations (conv_id, turns): the columns of ``NODE``.

    A node of depth d is a sequence of d turns that begins some conversation; its members are the conversations it begins.
    conv_id is the smallest member and parent_conv_id that of the parent (null at the root, depth 0); n_convs counts members,
    n_children children, n_leaves childless nodes in the subtree; saved_tokens sums (n_convs - 1) times the words of the last
    turn over the subtree; ends_sha256 digests the numbers of the members that end here. Empty conversations are members of the
    root only. No conversations give no rows. ``conv_id`` must be distinct.

    Distinct sequences are sorted into ranges of their turn ids, so a subtree lies in neighbouring ranges, also one that a
    popular first turn makes large. Every range builds radix trees of bounded size. Only nodes on the first and last
    path of a tree can go on in its neighbours: these are joined, ``FAN`` ranges at a time, until all are whole. A conversation is
    one key of 20 bytes a turn.
    """
    parts = parts_of(lists)
    sequences = pin(_sequences(lists, parts))
    ranges = sequences.repartitionByRange(parts, "key").sortWithinPartitions("key")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << CHUNK_BITS
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        while held := list(islice(rows, tree_rows_limit)):
            yield from _batches(tree_rows(held, number), PARTIAL)
            number += 1

    nodes = pin(ranges.mapInArrow(build, PARTIAL))
    open_, done, shift, end = nodes.where("open"), [], CHUNK_BITS, False
    while not end:
        shift += (FAN - 1).bit_length()
        end = (parts - 1) << CHUNK_BITS >> shift == 0

        joined = pin(open_.groupBy(F.shiftright("tree", shift)).applyInArrow(_joiner(end), PARTIAL))
        done.append(joined.where("not open"))
        open_ = joined.where("open")
    edges = reduce(DataFrame.unionByName, done)
    names, inside = NODE.names, nodes.where("not open")
    of_edge = inside.where("parent is not null").unionByName(edges.where("depth > 0")).drop("parent_conv_id", "mark")
    parents = edges.select("mark", F.col("conv_id").alias("parent_conv_id"))
    found = of_edge.join(parents, F.col("parent") == F.col("mark")).select(*names)
    return inside.where("parent is null").select(*names).unionByName(found).unionByName(edges.where("depth = 0").select(*names))
