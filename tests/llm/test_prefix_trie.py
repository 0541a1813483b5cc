"""The prefix trie against brute force, with stretches, segments and counters of any size."""

import hashlib
import random
import zlib

import pytest

from flowprofile.llm import prefix_trie


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        stack, out = [node], []
        while stack:
            out.append(stack.pop())
            stack += children.get(out[-1], [])
        return out

    found = []
    for node, cs in members.items():
        tree = below(node)
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        found.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), sum(x not in children for x in tree),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in tree if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(str, found))


def conversations():
    rng = random.Random(5)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 1, "user", "é" * 5), (7, 1, "user", "a"), (7, 1, "user", "a"), (-3, 0, "user", "x"), (-103, 0, "user", "x"), (-100, 0, "user", "y"), (99_901, 3, "", "")]
    texts = ["", "a", "bb", "a longer text", "ß ü"]
    for c in [*range(0, 12), *range(100, 130), *range(205, 230)]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, ["user", "assistant"][turn % 2], rng.choice(texts[: 2 if turn < 3 else 5])))
    for c in (300, 301, 302, 399):  # long, and alike for most of their length
        rows += [(c, t, "user", f"t{t % 7}" + ("end" if c == 302 and t > 55 else "")) for t in range(60 + c % 3)]
    rows += [(c, 0, "user", "the same first turn") for c in range(1000, 1090)]
    return rows


@pytest.mark.parametrize(("segment", "cells", "partitions", "hot"), [(4096, None, 8, 10_000), (6, 1 << 14, 40, 3), (9, 1 << 14, 3, 1)])
def test_nodes_match_brute_force(spark, monkeypatch, segment, cells, partitions, hot):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "HOT_NODES", hot)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversations()
        table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
        got = prefix_trie.prefix_trie(table, max_cells=cells or prefix_trie.MAX_CELLS).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_sketch_without_room_changes_nothing(spark, monkeypatch):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefix_trie, "sketch_cells", lambda a, b, row, cells: (a * 0))
    assert sorted(str(tuple(r)) for r in prefix_trie.prefix_trie(table).collect()) == brute(rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
