import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateframe.llm import merkle, queries, sha256


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def path(nodes, at):
    """Top of a tree over ``nodes`` and, per level from leaf ``at`` up, its run and the place in it."""
    steps = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        steps.append((runs[at // 3], at % 3))
        nodes, at = [h(run) for run in runs], at // 3
    return nodes[0], steps


def brute_force(rows):
    """Result rows of the query for (doc_id, source, lang, n_chars, text) rows."""
    first = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((first(row[0]), leaf(row), row))
    names = sorted(groups, key=first)
    subroots = []
    for name in names:
        groups[name].sort(key=lambda r: r[:2])
        subroots.append(path([r[1] for r in groups[name]], 0)[0])
    result = []
    for g, name in enumerate(names):
        for at, (_, digest, row) in enumerate(groups[name]):
            subroot, low = path([r[1] for r in groups[name]], at)
            root, high = path(subroots, g)
            folded = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                folded = leaf((*row[:4], None if row[4] is None else row[4].replace("\n", "")))
            siblings = []
            for run, slot in low + high:
                siblings += run[:slot] + run[slot + 1 :]
                folded = h(run[:slot] + [folded] + run[slot + 1 :])
            result.append((row[0], digest, subroot, root, h(siblings), folded, folded == root))
    return result


def test_states_match_hashlib():
    draw = np.random.default_rng(3)
    digests = draw.integers(0, 1 << 32, (8, 50), dtype="uint32")
    state = sha256.start(50)
    assert sha256.bytes_of(sha256.finish(state, np.zeros(50)))[0].tobytes().hex() == h([])
    for _ in range(3):
        state = sha256.compress(state, sha256.hex_block(digests))
    found = sha256.bytes_of(sha256.finish(state, np.full(50, 3)))
    raw = sha256.bytes_of(digests)
    assert [f.tobytes().hex() for f in found] == [h([d.tobytes().hex()] * 3) for d in raw]
    assert (sha256.words_of(raw) == digests).all()


def documents(n, seed=5):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["a", "b", None, "é", "z"]), draw.choice(["en", None]), i % 9, f"line {i}\nrest\n" * (i % 3)) for i in range(n)]
    rows += [(None, "a", None, None, "no id\n"), (None, None, None, None, None), (5000, "single", "en", 3, None)]
    rows += [(n + i, "hot", "en", 1, "x\ny") for i in range(3 * n)] + [(7, "hot", "en", 1, "same\ntext")] * 40 + [(8, "Z", "", 0, "")] * 2
    return rows


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_equals_brute_force(spark, monkeypatch, tmp_path, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "CHUNK", 3**depth)
    rows = documents(130 if depth < 6 else 300)
    frame = spark.createDataFrame([(*r, "own", 1, b"x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, position int, digest binary")
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_force(rows)))


def test_one_leaf_and_none(spark):
    frame = spark.createDataFrame([(1, "a", "t")], "doc_id long, source string, text string")
    own = merkle.leaf_digest(F.col("text"))
    (row,) = merkle.fold(merkle.manifest(frame, own)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf(["t"]) and row.proof_sha256 == h([]) and row.verified
    empty = merkle.manifest(frame.limit(0), own)
    assert empty.root is None and merkle.fold(empty).count() == 0


def test_nodes_keep_a_state_per_child(spark):
    frame = spark.createDataFrame([(i, "a", str(i)) for i in range(8)], "doc_id long, source string, text string")
    made = merkle.manifest(frame, merkle.leaf_digest(F.col("text")))
    nodes = made.nodes.collect()
    assert sorted((n.level, n.position, len(n.children) // 32) for n in nodes) == [(1, 0, 3), (1, 1, 3), (1, 2, 2), (2, 0, 3)]
    assert all(len(n.states) == len(n.children) and n.states[:32] == sha256.bytes_of(sha256.start(1))[0].tobytes() for n in nodes)
