"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints are told apart by bits. A node of the index is a masked bit pattern: all
its members agree on the bits of the mask. The top level cuts the 64 bits into one
block more than bits may differ, so that every linked pair meets under a node of some
block; Spark shuffles by node. A node with many members is cut again over the bits
that are still free, until each is small, whatever share of the table it held. Inside
a small node the members are sorted by Gray rank, which puts neighbours in bits close
together; runs of eight form a leaf block, eight blocks the next node, and so on. A
search carries the differences counted so far down this tree and leaves a whole group
as soon as they exceed the limit.

A node returns a spanning forest of its links, not all pairs, so the output stays
linear in its members. Components are joined from these.

* NULL and empty text, or white space only: fingerprint zero, linked like any other.
* Fewer words than a shingle has: the whole sequence is one shingle.
* Repeated rows and rows that share a doc_id: each is returned with its component by
  ``near_duplicates``. ``keep_one_of_each`` tells rows by id and text, so that other texts
  under an id stay, and keeps one of equal rows.
* NULL doc_id: counts as no id when the smallest is taken; a component of NULL ids
  only has NULL. ``keep_one_of_each`` takes it last and keeps one row of such a component.
* Other columns are ignored by ``near_duplicates`` and kept by ``keep_one_of_each``.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import connected_components, fresh, row_key
from themeloom.operators.storage import written

ONES = (1 << 64) - 1
FAN_OUT = 8
FRONTIER = 1 << 20
HASHES = 1 << 15
TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class SimHashRules:
    shingle_words: int = 3
    max_bits: int = 2
    seed: int = 42
    # members of a node that one task searches; larger nodes are cut further
    node_members: int = 1024


# --- fingerprints ------------------------------------------------------------


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit; eight bits are added up per machine word."""
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a lane holds up to 255
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, HASHES):
        part = words[at : at + HASHES + shingle - 1] if n > 1 else words
        grams = zip(*(part[i:] for i in range(shingle))) if n > 1 else [part]
        ones += bit_counts(np.array([digest(join(g), seed) for g in grams], dtype="<u8"))
    return int((2 * ones > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """doc_id, h (hash of the text) and fp (the 64 bits as a long) of every row; texts never leave their task."""
    shingle, seed = rules.shingle_words, rules.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)]
            bits = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits], names=["doc_id", "h", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h long, fp long")


# --- the index ---------------------------------------------------------------


def gray_rank(bits: Column) -> Column:
    """Position of a 64-bit pattern in Gray order, ordered as a signed long."""
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def child_masks(mask: int, blocks: int) -> list[int]:
    """``mask`` with one of ``blocks`` blocks of the free bits added, for each block."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [len(free) * i // blocks for i in range(blocks + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:]) if b > a]


def small_nodes(distinct: DataFrame, rules: SimHashRules) -> Iterator[DataFrame]:
    """Rows (mask, value, fp) of nodes with at least two and not too many members.

    Each level has three masks per mask of the level before, a fixed table. Distinct
    members under a mask are at most two to the number of its free bits, so the levels
    come to an end.
    """
    spark = distinct.sparkSession
    blocks, masks = rules.max_bits + 1, [0]
    rows = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        family = [(signed(m), signed(c)) for m in masks for c in child_masks(m, blocks)]
        table = F.broadcast(spark.createDataFrame(family, "mask long, child long"))
        rows = rows.join(table, "mask").select(
            F.col("child").alias("mask"), F.col("child").bitwiseAND(F.col("fp")).alias("value"), "fp"
        )
        sizes = written(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"))
        met = rows.join(sizes, ["mask", "value"])
        yield met.where(F.col("n") <= rules.node_members).select("mask", "value", "fp")
        if sizes.where(F.col("n") > rules.node_members).isEmpty():
            return
        rows = written(met.where(F.col("n") > rules.node_members).select("mask", "fp"))
        masks = sorted({c & ONES for _, c in family})


def gray_index(bits: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the top: first child, end, shared mask, shared pattern of each node.

    ``bits`` are sorted by group and Gray rank. A node covers ``FAN_OUT`` neighbours of
    the level below and never crosses a group; the top level has one node per group.
    """
    low, high, owner = bits, bits, group
    levels: list[tuple[np.ndarray, ...]] = []
    while True:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lengths = np.diff(np.r_[starts, len(owner)])
        pieces = -(-lengths // FAN_OUT)
        base = np.repeat(starts, pieces)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = base + step * FAN_OUT
        end = np.minimum(first + FAN_OUT, np.repeat(starts + lengths, pieces))
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        owner = owner[first]
        levels.append((first, end, ~(low ^ high), low))
        if len(pieces) == len(owner):
            return levels[::-1]


def links_of(bits: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that differ in at most ``most`` bits, per group."""
    levels = gray_index(bits, group)
    root = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    label = np.arange(len(bits))
    # the frontier of a chunk of queries grows by the fan-out a level, less what is pruned
    chunk = max(1, FRONTIER // FAN_OUT**2)
    for at in range(0, len(bits), chunk):
        query = np.arange(at, min(at + chunk, len(bits)))
        node = root[query]
        for first, end, mask, pattern in levels:
            # all differences on the bits that the group shares, ancestors' bits included
            near = np.bitwise_count((bits[query] ^ pattern[node]) & mask[node]) <= most
            # only earlier members are looked for, each pair is met once
            query, node = query[near], node[near]
            number = end[node] - first[node]
            query = np.repeat(query, number)
            node = np.repeat(first[node], number) + np.arange(number.sum()) - np.repeat(
                np.cumsum(number) - number, number
            )
        linked = (node < query) & (np.bitwise_count(bits[query] ^ bits[node]) <= most)
        label = joined(label, query[linked], node[linked])
    moved = np.flatnonzero(label != np.arange(len(bits)))
    return moved, label[moved]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member per component after the links a-b are added."""
    while True:
        low = np.minimum(label[a], label[b])
        if np.array_equal(label[a], label[b]):
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jump := label[label], label):
            label = jump


def node_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of whole nodes; rows come sorted by node, the last node of a batch waits."""

    def found(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
        bits = rows[2].view(np.uint64)
        a, b = links_of(bits, group, most)
        return pa.RecordBatch.from_arrays([pa.array(rows[2][a]), pa.array(rows[2][b])], names=["a", "b"])

    waiting = np.zeros((3, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([waiting, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        changed = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
        cut = changed[-1] + 1 if len(changed) else 0
        if cut:
            yield found(rows[:, :cut])
        waiting = rows[:, cut:]
    if waiting.shape[1]:
        yield found(waiting)


def fingerprint_links(distinct: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """Links (a, b) that join all fingerprints of a component; ``distinct`` has fp."""
    most, links = rules.max_bits, None
    for nodes in small_nodes(distinct, rules):
        ordered = (
            nodes.repartition("mask", "value")
            .sortWithinPartitions("mask", "value", gray_rank(F.col("fp")))
            .select("mask", "value", "fp")
        )
        found = ordered.mapInArrow(lambda batches: node_links(batches, most), "a long, b long")
        links = found if links is None else links.unionByName(found)
    return links


# --- documents ---------------------------------------------------------------


def component_members(own: DataFrame, value: Column, rules: SimHashRules) -> DataFrame:
    """component_id, the smallest ``value`` in the component, of every fingerprint."""
    classes = written(own.groupBy("fp").agg(F.min(value).alias("least")))
    roots = written(connected_components(fingerprint_links(classes.select("fp"), rules)))
    linked = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
    smallest = written(linked.groupBy("root").agg(F.min("least").alias("component")))
    moved = written(linked.join(smallest, "root").select("fp", "component"))
    return written(
        classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    )


def near_duplicates(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    own = written(fingerprints(docs, rules).drop("h"))
    table = component_members(own, F.col("doc_id"), rules)
    # a fingerprint may hold a large share of all rows: the join is left to be split
    return own.join(table, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest doc_id.

    Of several texts under that id in one component, the one with the smallest hash.
    """
    mark = fresh(docs, "_row")
    own = written(fingerprints(docs, rules))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    table = component_members(own, order, rules)
    told = own.join(table, "fp").select(
        F.struct(F.col("doc_id").alias("id"), "h").alias(mark), (order == F.col("component_id")).alias("kept")
    )
    told = written(told.groupBy(mark).agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    gone = told.where("not kept").select(mark)
    rows = docs.withColumn(mark, row_key("doc_id", "text")).join(gone, mark, "left_anti")
    again = told.where("kept").select(mark)
    if again.isEmpty():
        return rows.drop(mark)
    rest = rows.join(again, mark, "left_anti")
    return rest.unionByName(rows.join(again, mark, "left_semi").dropDuplicates([mark])).drop(mark)
