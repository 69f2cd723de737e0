"""The prefix trie against brute force: adaptive trees alone, joined edges, odd rows and the whole query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ebbtide.llm import registry
from ebbtide.llm.prefix_trie import Few, Full, Indexed, Node, RadixTree, common, prefix_trie, shared_beginnings, turn_lists

SMALL = "/root/testdata/sf0.001"
TURNS = StructType([
    StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
    StructField("text", StringType()), StructField("turns", StringType()), StructField("key", LongType()),
])


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    cut = lambda c: zlib.crc32(str(c).encode()) % 4
    lead = lambda c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
    return {c: own.get(lead(c), [])[:cut(c)] + v[cut(c):] for c, v in own.items()}


def plain_trie(lists):
    """Every node by its sequence, from the definition."""
    members = defaultdict(list)
    for conv, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    words = lambda key: len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    out, leaves, saved = [], {}, {}
    for key in sorted(members, key=lambda k: -len(k)):
        own = kids[key]
        leaves[key] = sum(leaves[k] for k in own) or 1
        saved[key] = sum(saved[k] for k in own) + (len(members[key]) - 1) * words(key)
        ends = sorted(c for c in members[key] if len(lists[c]) == len(key))
        out.append((
            min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(own), leaves[key],
            saved[key], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(map(repr, out))


def found_rows(frame):
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(repr(tuple(r)) for r in frame.collect())


@pytest.fixture(scope="module")
def odd_turns(spark):
    pick = random.Random(4)
    rows = []
    for conv in [*range(-25, 90), 10**15, 10**15 + 7]:
        for turn in range(pick.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((conv, turn, pick.choice(["user", "assistant"]), f"hi {pick.randrange(3)}" if turn < 5 else "same\x0btext"))
    rows += [(200 + k, t, "user", f"copy  of {t}") for k in range(40) for t in range(5)]
    rows += [(300, t, "u", f"x{t} y") for t in range(700)] + [(301, t, "u", f"x{t} y") for t in range(0, 700)]
    rows += [(310, None, "user", "null turn"), (310, 1, None, None), (310, 2, "", ""), (311, 0, "u", "a"), (311, 0, "u", "a")]
    rows += [(None, 1, "user", "nobody"), (320, 0, "us", "er"), (340, 0, "u", "ser"), (341, 0, "u", "ser " * 20000)]
    pick.shuffle(rows)
    return rows, spark.createDataFrame([(*r, "x", 5) for r in rows], TURNS)


@pytest.mark.parametrize("limit", [1 << 16, 3, 1])
def test_odd_rows(odd_turns, limit):
    rows, frame = odd_turns
    assert found_rows(prefix_trie(shared_beginnings(turn_lists(frame)), limit)) == plain_trie(rebuilt(rows))


def test_many_ranges_join_in_rounds(spark, odd_turns):
    rows, frame = odd_turns
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        found = found_rows(prefix_trie(turn_lists(frame), 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert found == plain_trie({c: [x[2:] for x in sorted(v)] for c, v in own.items()})


def test_no_rows(odd_turns):
    assert prefix_trie(shared_beginnings(turn_lists(odd_turns[1].limit(0)))).count() == 0
    assert prefix_trie(turn_lists(odd_turns[1].where("conv_id is null"))).count() == 0


def test_query_on_its_table(spark):
    rows = [tuple(r) for r in registry.table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found_rows(registry.op12_prefix_trie(spark, SMALL)) == plain_trie(rebuilt(rows))


def test_layouts_grow():
    layout, kinds, held = Few(), [], {}
    for byte in random.Random(1).sample(range(256), 256):
        held[byte] = Node(b"", b"")
        layout = layout.put(byte, held[byte])
        kinds.append((type(layout), getattr(layout, "room", None)))
        assert list(layout.items()) == sorted(held.items()) and all(layout.get(b) is n for b, n in held.items())
    assert [kinds[k] for k in (3, 4, 15, 16, 47, 48, 255)] == [
        (Few, 4), (Few, 16), (Few, 16), (Indexed, None), (Indexed, None), (Full, None), (Full, None)]


def test_tree_holds_its_keys():
    pick = random.Random(2)
    keys = {bytes(pick.choice(b"ab\xff") for _ in range(pick.randrange(9))) for _ in range(300)}
    tree = RadixTree()
    for key in keys:
        tree.insert(key, (key,))
    held, todo = {}, [(tree.root, b"")]
    for node, path in todo:
        path += node.path
        if node.payload:
            held[path] = node.payload[0]
        children = list(node.children.items())
        assert node is tree.root or node.payload or len(children) > 1
        todo += [(child, path + bytes([b])) for b, child in children]
    assert held == {k: k for k in keys}
    assert [common(a, b) for a, b in [(b"", b"x"), (b"ab", b"ab"), (b"abc", b"abd"), (b"\x00a", b"\x00b"), (b"x", b"y")]] == [0, 2, 2, 1, 0]
