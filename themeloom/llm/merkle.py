"""Merkle manifest of a table, with proofs expanded by octopus multiproofs.

Leaves are hashes of rows. Within each group (a language) leaves ascend by an order
column; every run of eight consecutive nodes is hashed into one node of the next level
until one node, the group's subroot, is left. Subroots, ordered by group, give the root
in the same way. A row's proof is the list of its run's other members, level by level.

Proofs are not gathered per row. Rows are range-partitioned in tree order, so each
partition holds a contiguous stretch of leaves. Per partition (Ramabaja and Avdullahu's
octopus multiproof):

1. the minimal union of node coordinates it is missing is computed: siblings of its
   paths that its own leaves cannot produce;
2. those nodes are fetched once, by a join of the coordinates with the node table;
3. interiors shared by its leaves are derived locally, level by level;
4. each row's proof is expanded locally, and its root recomputed from that proof.

The tree levels are Spark aggregations of at most eight rows a group; a large group
(one language with a third of the rows) is a long run of small groups, not one task.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from themeloom.llm.common import bounded_broadcast
from themeloom.operators.storage import written

# Fixed values of the contract: fan-out, NULL marker, tampered letters.
FAN = 8
NULL = "-"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASK = (1 << 33) - 1


def H(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit(NULL)).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(value: Column) -> Column:
    """Non-NULL key that sorts NULL first, then by the value's UTF-8 bytes."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), value.cast("string")))


def _depths(n: int) -> list[int]:
    counts = [n]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // FAN))
    return counts


def consecutive(df: DataFrame, order: list[Column], group: str) -> DataFrame:
    """``df`` with _pid (its range partition), _pos (place within ``group`` in ``order``)
    and _n (rows of the group), written once.

    Places come from a range partitioning and per-partition offsets, not from a window
    over the group, which would put a large group in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mono = F.monotonically_increasing_id()
    placed = written(ranged.withColumn("_m", mono).select(
        "*", F.shiftright("_m", 33).alias("_pid"), F.col("_m").bitwiseAND(F.lit(MASK)).alias("_local")
    ).drop("_m"))
    # offsets of partitions: one row per partition (not per row), summed in order
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        placed.groupBy("_pid").agg(F.count("*").alias("_c"))
        .select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    ranked = placed.join(bounded_broadcast(offsets), "_pid").withColumn("_g", F.col("_off") + F.col("_local"))
    starts = written(ranked.groupBy(group).agg(F.min("_g").alias("_start"), F.count("*").alias("_n")))
    return written(
        ranked.join(bounded_broadcast(starts), group)
        .withColumn("_pos", F.col("_g") - F.col("_start"))
        .drop("_off", "_local", "_g", "_start")
    )


def levels(nodes: DataFrame, tree: int) -> DataFrame:
    """All levels of the trees of ``nodes`` (_k group, _pos, _h with _n per group):
    rows tree, _k, level, idx, h, level 0 included."""
    level = nodes.select(F.lit(tree).alias("tree"), "_k", F.lit(0).alias("level"), F.col("_pos").alias("idx"), F.col("_h").alias("h"), F.col("_n").alias("count"))
    out = [level]
    depth = 0
    while True:
        active = level.where("count > 1")
        if active.isEmpty():
            break
        depth += 1
        level = written(
            active.groupBy("tree", "_k", F.floor(F.col("idx") / FAN).alias("idx"))
            .agg(
                F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda s: s["h"]), ""), 256).alias("h"),
                F.first("count").alias("parent"),
            )
            .select("tree", "_k", F.lit(depth).alias("level"), "idx", "h", F.ceil(F.col("parent") / FAN).alias("count"))
        )
        out.append(level)
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


def _needed_stretch(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """(level, idx) that a stretch lo..hi of n leaves misses in its group's tree:
    members of its paths' runs that its own leaves cannot produce and that some path
    needs as a sibling; then the top node (subroot or root)."""
    out = []
    counts = _depths(n)
    span = 1
    for level, count in enumerate(counts[:-1]):
        first, last = lo // span, hi // span
        covered_lo = -(-lo // span)
        covered_hi = (hi + 1) // span - 1 if hi + 1 < n else last
        for start in range(first - first % FAN, last + 1, FAN):
            run = range(start, min(start + FAN, count))
            touched = [k for k in run if first <= k <= last]
            for k in run:
                if covered_lo <= k <= covered_hi:
                    continue  # derived from own leaves
                if k in touched and len(touched) == 1:
                    continue  # on every own path here, never a sibling
                out.append((level, k))
        span *= FAN
    out.append((len(counts) - 1, 0))
    return out


def _top_path(j: int, m: int) -> list[tuple[int, int]]:
    """(level, idx) of the top tree needed for subroot j of m: itself, siblings, root."""
    return _needed_stretch(j, j, m) + [(0, j)]


def _fold(start: str, idx: int, proof: list[list[str]]) -> str:
    """The top of a tree recomputed from one node at ``idx`` and the others of its runs."""
    for others in proof:
        at = idx % FAN
        start = H([*others[:at], start, *others[at:]])
        idx //= FAN
    return start


def _expand(group: pd.DataFrame, known: dict, tops: int) -> pd.DataFrame:
    rows = []
    for key, part in group.groupby("_k", sort=False):
        n = int(part["_n"].iloc[0])
        counts = _depths(n)
        nodes = {(0, 0, key, int(i)): h for i, h in zip(part["_pos"], part["_h"])}
        get = lambda t, k, level, idx: nodes.get((t, level, k, idx)) or known.get((t, level, k, idx))
        # shared interiors: every parent whose children are all at hand
        for level, count in enumerate(counts[:-1]):
            lo, hi = int(part["_pos"].min()) // FAN ** (level + 1), int(part["_pos"].max()) // FAN ** (level + 1)
            for parent in range(lo, hi + 1):
                children = [get(0, key, level, c) for c in range(parent * FAN, min(parent * FAN + FAN, count))]
                if all(children) and (0, level + 1, key, parent) not in nodes:
                    nodes[(0, level + 1, key, parent)] = H(children)
        subroot = get(0, key, len(counts) - 1, 0)
        j = int(part["_j"].iloc[0])
        top_counts = _depths(tops)
        root = known[(1, len(top_counts) - 1, "", 0)]

        def siblings(tree, k, counts_, idx):
            proof = []
            for level, count in enumerate(counts_[:-1]):
                first = idx - idx % FAN
                proof.append([get(tree, k, level, m) for m in range(first, min(first + FAN, count)) if m != idx])
                idx //= FAN
            return proof

        upper = siblings(1, "", top_counts, j)
        for pos, leaf, changed, row in zip(part["_pos"], part["_h"], part["_t"], part["_row"]):
            lower = siblings(0, key, counts, int(pos))
            # from the proof alone, for every row: what it proves must follow from it
            folded = _fold(_fold(changed, int(pos), lower), j, upper)
            rows.append((int(row), leaf, subroot, root, [h for run in lower + upper for h in run], folded))
    return pd.DataFrame(rows, columns=["_row", "leaf", "subroot", "root", "proof", "folded_root"])


def manifest(
    docs: DataFrame,
    fields: list[str],
    group: str,
    order: str,
    changed: dict[str, Column] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with leaf, subroot, root, proof (array of sibling hashes, level by level,
    left to right), folded_root (the root recomputed from the leaf of the row with the
    ``changed`` columns and the original siblings) and verified (folded_root = root).

    Leaves hash ``fields`` (``-`` for NULL, else byte count, ``:``, value). Within a
    group, leaves ascend by ``order`` (NULL first), ties by leaf; groups ascend by value
    (NULL first, UTF-8 bytes). A group of one leaf has that leaf as subroot, a table of
    one group its subroot as root. Repeated rows are separate leaves. An empty table gives
    no rows. The result carries the ``keep`` columns of ``docs`` (all by default); those
    named like the outputs are replaced.
    """
    outputs = ["leaf", "subroot", "root", "proof", "folded_root", "verified"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    values = [F.col(f"`{f}`") for f in fields]
    swapped = [changed.get(f, F.col(f"`{f}`")) if changed else F.col(f"`{f}`") for f in fields]
    # texts are read once and hashed here; only the hashes move from now on
    leaves = written(docs.select(
        F.monotonically_increasing_id().alias("_row"),
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)],
        group_key(F.col(f"`{group}`")).alias("_k"),
        F.col(f"`{order}`").alias("_o"),
        leaf_hash(values).alias("_h"),
        leaf_hash(swapped).alias("_t"),
    ))
    kept = leaves.select("_row", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)])
    if leaves.isEmpty():
        return kept.select(
            *keep, *[F.lit(None).cast("string").alias(c) for c in outputs[:3]],
            F.lit(None).cast("array<string>").alias("proof"),
            F.lit(None).cast("string").alias("folded_root"), F.lit(None).cast("boolean").alias("verified"),
        )
    placed = consecutive(leaves.select("_row", "_k", "_o", "_h", "_t"), [F.col("_k"), F.col("_o").asc_nulls_first(), F.col("_h")], "_k")
    # the tree of subroots, one leaf per group
    lower = written(levels(placed, 0))
    subroots = written(lower.where(F.col("count") == 1).select("_k", F.col("h").alias("_h")))
    tops = subroots.count()
    ordered = consecutive(subroots.withColumn("_one", F.lit("")), [F.col("_k")], "_one")
    upper = written(levels(ordered.select(F.col("_one").alias("_k"), "_pos", "_h", "_n"), 1))
    lang_place = ordered.select("_k", F.col("_pos").alias("_j"))
    placed = placed.join(bounded_broadcast(lang_place), "_k")
    # 1. the minimal union of missing coordinates of every partition
    stretches = placed.groupBy("_pid", "_k", "_n", "_j").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"))
    need = written(
        stretches.select(
            "_pid",
            "_k",
            F.udf(lambda lo, hi, n: _needed_stretch(lo, hi, n), "array<struct<level:int,idx:long>>")("lo", "hi", "_n").alias("a"),
            F.udf(lambda j: _top_path(j, tops), "array<struct<level:int,idx:long>>")("_j").alias("b"),
        )
        .select("_pid", F.inline(F.array(
            *[F.struct(F.lit(0).alias("tree"), F.col("_k").alias("_k"), F.col("a").alias("c")),
              F.struct(F.lit(1).alias("tree"), F.lit("").alias("_k"), F.col("b").alias("c"))]
        )))
        .select("_pid", "tree", "_k", F.inline("c"))
        .distinct()
    )
    # 2. fetched once per partition
    fetched = bounded_broadcast(need).join(lower.unionByName(upper).drop("count"), ["tree", "_k", "level", "idx"])

    # 3, 4. interiors derived and proofs expanded where the partition's rows are
    def expand(key, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        known = {(int(t), int(lv), k, int(i)): h for t, k, lv, i, h in zip(got["tree"], got["_k"], got["level"], got["idx"], got["h"])}
        return _expand(own, known, tops)

    expanded = (
        placed.select("_pid", "_row", "_k", "_pos", "_n", "_j", "_h", "_t").groupBy("_pid")
        .cogroup(fetched.select("_pid", "tree", "_k", "level", "idx", "h").groupBy("_pid"))
        .applyInPandas(expand, "_row long, leaf string, subroot string, root string, proof array<string>, folded_root string")
    )
    out = kept.join(expanded, "_row").withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *outputs)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Text with A-Z lower-cased where 3 divides crc32 of the decimal id; NULL stays."""
    hit = (F.crc32(doc_id.cast("string")) % 3) == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def manifest_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    done = manifest(
        docs, fields, "lang", "doc_id",
        changed={"text": tampered_text(F.col("doc_id"), F.col("text"))}, keep=["doc_id"],
    )
    return done.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root", "verified",
    )
