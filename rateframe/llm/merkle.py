"""A Merkle manifest of a dataset: one tree of SHA-256 digests per group of rows, and one over the groups.

A parent digests the hex text of three consecutive children (the last parent of a level: of those left). It keeps
a copy of the hash state from before each child. Folding a changed leaf resumes the copy of its own
slot with the new digest and the right siblings only; left siblings are never hashed again.

Leaves get their place in the group by a range shuffle and prefix sums over its partitions, so a group of any
size is spread over many tasks. Trees grow by storeys: 729 consecutive nodes and the six levels above
them are one chunk, worked on together; only chunk tops go on to the next storey. To fold, a chunk gets
the nodes between its top and the root, a few dozen rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateframe.llm import sha256
from rateframe.llm.textops import map_batches
from rateframe.session import materialize

FAN = 3
DEPTH = 6
CHUNK = FAN**DEPTH
POWERS = [FAN**i for i in range(40)]
NODES = "grp string, level int, position long, states binary, children binary, digest binary, levels int"
FOLDED = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (id, digest, any further binary columns, grp, position, levels), ``groups`` (grp, rank, levels,
    subroot), ``nodes`` of the groups' trees and of the tree over them (``top``), and the root as hex, which is
    None for an empty dataset."""

    leaves: DataFrame
    groups: DataFrame
    nodes: DataFrame
    top: DataFrame
    top_levels: int
    root: str | None


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 over the columns one after another: UTF-8 length, a colon and the value; a dash for null."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*fields), 256))


# --- numpy on columns of chunks ---------------------------------------------------

def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole chunks from batches in which a chunk's rows are consecutive."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        last = pc.and_(pc.equal(table["grp"], table["grp"][-1]), pc.equal(table["chunk"], table["chunk"][-1]))
        cut = pc.index(last, True).as_py()
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _chunk_numbers(table: pa.Table) -> np.ndarray:
    """0, 0, 1, ...: which chunk of the table a row is in."""
    grp, chunk = pc.dictionary_encode(table["grp"].combine_chunks()).indices.to_numpy(), table["chunk"].to_numpy()
    return np.concatenate([[0], np.cumsum((grp[1:] != grp[:-1]) | (chunk[1:] != chunk[:-1]))]).astype("int64")


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    """32-byte values as words (8, n)."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="uint8")
    return sha256.words_of(raw.reshape(-1, 32)) if len(raw) else np.zeros((8, 0), dtype="uint32")


def _binary(parts: np.ndarray, count: np.ndarray) -> pa.Array:
    """(n, 3, 32) bytes as values of the first ``count`` parts."""
    data = parts[np.arange(FAN)[None] < count[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(count * 32)]).astype("int32")
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _parts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of one to three digests or states as words (3, 8, n), and how many each has."""
    count = pc.binary_length(column).to_numpy().astype("int64") // 32
    parts = np.zeros((len(count), FAN, 32), dtype="uint8")
    parts[np.arange(FAN)[None] < count[:, None]] = np.frombuffer(b"".join(column.to_pylist()), dtype="uint8").reshape(-1, 32)
    return np.stack([sha256.words_of(parts[:, i]) for i in range(FAN)]), count


def _hex(digests: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in sha256.bytes_of(digests)], pa.string())


def _grow(below: int):
    """Nodes of the levels above nodes of level ``below``, chunk by chunk."""

    def grow(batches):
        for table in _whole_chunks(batches):
            number, position = _chunk_numbers(table), table["position"].to_numpy()
            levels, digest = table["levels"].to_numpy(), _digests(table["digest"])
            row = np.arange(table.num_rows)
            for level in range(below + 1, below + DEPTH + 1):
                alive = levels >= level
                if not alive.any():
                    break
                number, position, levels, row, digest = number[alive], position[alive] // FAN, levels[alive], row[alive], digest[:, alive]
                first = np.ones(len(row), dtype=bool)
                first[1:] = (number[1:] != number[:-1]) | (position[1:] != position[:-1])
                at = np.nonzero(first)[0]
                count = np.diff(np.append(at, len(row)))
                states, children = np.zeros((len(at), FAN, 32), "uint8"), np.zeros((len(at), FAN, 32), "uint8")
                state = sha256.start(len(at))
                for slot in range(FAN):
                    has = np.nonzero(count > slot)[0]
                    child = digest[:, at[has] + slot]
                    states[has, slot], children[has, slot] = sha256.bytes_of(state[:, has]), sha256.bytes_of(child)
                    state[:, has] = sha256.compress(state[:, has], sha256.hex_block(child))
                number, position, levels, row, digest = number[at], position[at], levels[at], row[at], sha256.finish(state, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        table["grp"].take(pa.array(row)).combine_chunks(), pa.array(np.full(len(at), level, "int32")), pa.array(position),
                        _binary(states, count), _binary(children, count),
                        pa.array([d.tobytes() for d in sha256.bytes_of(digest)], pa.binary()), pa.array(levels.astype("int32")),
                    ],
                    names=["grp", "level", "position", "states", "children", "digest", "levels"],
                )

    return grow


def _fold(batches):
    """Folds the leaves of whole chunks. Kind 0 is the subroot and root, 1 a node, 2 a leaf."""
    for table in _whole_chunks(batches):
        number, kind = _chunk_numbers(table), table["kind"].to_numpy()
        head, node, leaf = (np.nonzero(kind == k)[0] for k in range(3))
        heads, nodes, leaves = (table.take(pa.array(i)) for i in (head, node, leaf))
        roots, _ = _parts(heads["children"])
        mine = np.searchsorted(number[head], number[leaf])
        subroot, root = roots[0][:, mine], roots[1][:, mine]
        states, _ = _parts(nodes["states"])
        children, counts = _parts(nodes["children"])
        node_slot, node_position = nodes["slot"].to_numpy(), nodes["position"].to_numpy()
        node_level = nodes["level"].to_numpy()
        known, begin = np.unique(number[node] * 256 + node_level, return_index=True)
        position, n = leaves["position"].to_numpy(), len(leaf)
        folded, proof, blocks = _digests(leaves["replacement"]), sha256.start(n), np.zeros(n, dtype="int64")
        for level in range(1, int(node_level.max(initial=0)) + 1):
            wanted = number[leaf] * 256 + level
            found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            rows = np.nonzero(known[found] == wanted)[0]
            at = begin[found[rows]]
            above = node_slot[at] >= 0  # one node between the chunk's top and the root
            low = min(level, DEPTH)
            at = at + np.where(above, 0, position[rows] // FAN**low - node_position[at])
            slot = np.where(above, node_slot[at], position[rows] // FAN ** (low - 1) % FAN)
            count = counts[at]
            state = sha256.compress(states[slot, :, at].T, sha256.hex_block(folded[:, rows]))
            for sibling in range(FAN):
                blocks_of = sha256.hex_block(children[sibling][:, at])
                right = (sibling > slot) & (sibling < count)
                state[:, right] = sha256.compress(state[:, right], blocks_of[:, right])
                other = (sibling != slot) & (sibling < count)
                proof[:, rows[other]] = sha256.compress(proof[:, rows[other]], blocks_of[:, other])
                blocks[rows[other]] += 1
            folded[:, rows] = sha256.finish(state, count)
        yield pa.RecordBatch.from_arrays(
            [
                leaves["id"].combine_chunks(), _hex(_digests(leaves["digest"])), _hex(subroot), _hex(root),
                _hex(sha256.finish(proof, blocks)), _hex(folded), pa.array((folded == root).all(axis=0)),
            ],
            names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


# --- tables -----------------------------------------------------------------------

def _power(exponent: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, POWERS)), exponent + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``position``, from 0 in their grp by the order, and ``levels`` of the grp's tree.

    Equal rows are told apart by where they were read, so that they spread over partitions as well.
    """
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), label)
    dealt = rows.repartitionByRange("grp", *order, "row").sortWithinPartitions("grp", *order, "row").drop("row")
    dealt = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), f"{label}-sorted")
    dealt = dealt.withColumn("part", F.shiftright("place", 33))
    runs = dealt.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("n").over(Window.partitionBy("grp"))
    levels = F.size(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.col("size")))
    runs = runs.select("grp", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), size.alias("size"))
    runs = materialize(runs.withColumn("levels", levels).drop("size"), f"{label}-runs")
    placed = dealt.join(runs, ["grp", "part"]).withColumn("position", F.col("base") + F.col("place") - F.col("first"))
    return placed.drop("place", "part", "first", "base")


def _tree(leaves: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
    """All nodes above (grp, position, levels, digest) leaves, the (grp, digest) of each tree's top, and
    how many levels the highest tree has."""
    most = leaves.agg(F.max("levels")).first()[0]
    if most is None:
        return leaves.sparkSession.createDataFrame([], NODES), leaves.select("grp", "digest"), 0
    nodes, below = None, leaves.select("grp", "position", "levels", "digest")
    tops = below.filter("levels = 0").select("grp", "digest")
    for level in range(0, max(most, 1), DEPTH):
        chunks = below.filter(F.col("levels") > level).withColumn("chunk", _div(F.col("position"), F.lit(CHUNK)))
        chunks = chunks.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "position")
        grown = materialize(map_batches(chunks, _grow(level), NODES), label)
        nodes = grown if nodes is None else nodes.union(grown)
        below = grown.filter(F.col("level") == level + DEPTH).select("grp", "position", "levels", "digest")
        tops = tops.union(grown.filter("level = levels").select("grp", "digest"))
    return nodes, tops, most


def manifest(
    rows: DataFrame, digest: Column, group: str = "source", key: str = "doc_id", replacement: Column | None = None
) -> Manifest:
    """The trees over the ``digest`` (32 bytes) of every row, and the copies of hash states in their nodes.

    In a group rows ascend by key, null first; of one key by digest. A null group is a group of its own, before
    all others. Equal rows are leaves of their own. ``replacement`` is a digest that ``fold`` puts in a
    row's place (null: its own). Other columns are not read. An empty table has no root.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    other = digest if replacement is None else F.coalesce(replacement, digest)
    leaves = rows.select(grp.alias("grp"), F.col(key).cast("long").alias("id"), digest.alias("digest"), other.alias("replacement"))
    leaves = materialize(_numbered(leaves, ["id", "digest"], "leaves"), "placed-leaves")
    nodes, tops, _ = _tree(leaves, "nodes")
    levels = nodes.filter("level = levels").select("grp", "levels").union(leaves.filter("levels = 0").select("grp", "levels"))
    subroots = tops.join(levels, "grp").select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.col("levels").alias("own"))
    ranked = materialize(_numbered(subroots, ["name"], "subroots"), "groups")
    top, root, top_levels = _tree(ranked, "top")
    groups = ranked.select(F.col("name").alias("grp"), F.col("position").alias("rank"), F.col("own").alias("levels"), F.col("digest").alias("subroot"))
    found = root.first()
    return Manifest(leaves, groups, nodes, top, top_levels, None if found is None else found.digest.hex())


def fold(of: Manifest) -> DataFrame:
    """Per leaf: id, its digest, subroot, root, the digest of its proof (all siblings up to the root), the root that
    follows from its replacement, and whether that is the root. Digests are hex."""
    if of.root is None:
        return of.leaves.sparkSession.createDataFrame([], FOLDED)
    chunk = _div(F.col("position"), F.lit(CHUNK)).alias("chunk")
    none = F.lit(None)
    blank = {
        "level": F.lit(0), "position": F.lit(0).cast("long"), "slot": F.lit(-1), "id": none.cast("long"), "digest": none.cast("binary"),
        "replacement": none.cast("binary"), "states": none.cast("binary"), "children": none.cast("binary"),
    }

    def rows(df: DataFrame, kind: int, **given: str) -> DataFrame:
        columns = [F.col(given[c]).alias(c) if c in given else value.alias(c) for c, value in blank.items()]
        return df.select("grp", "chunk", F.lit(kind).alias("kind"), *columns)

    leaves = of.leaves.withColumn("chunk", chunk)
    chunks = materialize(leaves.select("grp", "chunk").distinct().join(of.groups, "grp"), "chunks")
    inside = of.nodes.filter(F.col("level") <= DEPTH).withColumn("chunk", _div(F.col("position"), _power(DEPTH - F.col("level"))))
    # Nodes between a chunk's top and the root: first those of its group, then those over the groups.
    high = chunks.filter(F.col("levels") > DEPTH).withColumn("level", F.explode(F.sequence(F.lit(DEPTH + 1), "levels")))
    high = high.select(
        "grp", "chunk", "level", _div(F.col("chunk"), _power(F.col("level") - DEPTH)).alias("position"),
        (_div(F.col("chunk"), _power(F.col("level") - DEPTH - 1)) % FAN).cast("int").alias("slot"),
    )
    upper = of.nodes.filter(F.col("level") > DEPTH).select("grp", "level", "position", "states", "children")
    above = high.join(upper, ["grp", "level", "position"])
    header = chunks.withColumn("children", F.concat("subroot", F.unhex(F.lit(of.root))))
    parts = rows(leaves, 2, position="position", id="id", digest="digest", replacement="replacement")
    parts = parts.union(rows(header, 0, children="children"))
    parts = parts.union(rows(inside, 1, level="level", position="position", states="states", children="children"))
    parts = parts.union(rows(above, 1, level="level", position="position", slot="slot", states="states", children="children"))
    if of.top_levels:
        steps = of.groups.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(of.top_levels)))).select(
            "grp", F.col("step").alias("level"), _div(F.col("rank"), _power(F.col("step"))).alias("position"),
            (_div(F.col("rank"), _power(F.col("step") - 1)) % FAN).cast("int").alias("slot"),
        )
        steps = steps.join(of.top.select("level", "position", "states", "children"), ["level", "position"])
        over = chunks.select("grp", "chunk", "levels").join(steps, "grp").withColumn("level", F.col("level") + F.col("levels"))
        parts = parts.union(rows(over, 1, level="level", position="position", slot="slot", states="states", children="children"))
    parts = parts.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "kind", "level", "position")
    return map_batches(parts, _fold, FOLDED)
