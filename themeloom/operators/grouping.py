"""Similar topics inside one article: pairs above a threshold and leader groups.

Topics are numbered inside their article, so ``topic_no div block_rows`` cuts an
article into blocks of bounded size without ranking it. Ordinary articles are
one block. An article of any size is worked block against block, never as a
whole in one task, and never by writing out all its pairs.

Similarities are compared after rounding to nine decimals, so that a sum taken
in another order does not move a pair across the threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom.operators.arrays import exploded
from themeloom.operators.storage import written

PAIR = "array<struct<a: int, b: int, sim: double>>"
MEMBER = "array<struct<topic_no: int, leader_no: int, sim: double>>"
SALTS = 64


def _matrix(lengths, slots, weights, width: int) -> np.ndarray:
    """Dense rows from the flattened entries of one block."""
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), slots] = weights
    return out


def _greedy(numbers, vectors: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Each open topic leads and takes every later open topic above the threshold."""
    leader = np.full(len(numbers), -1)
    similarity = np.ones(len(numbers))
    for i in range(len(numbers)):
        if leader[i] >= 0:
            continue
        leader[i] = i
        sims = np.round(vectors[i + 1 :] @ vectors[i], 9)
        taken = np.flatnonzero((sims > threshold) & (leader[i + 1 :] < 0)) + i + 1
        leader[taken] = i
        similarity[taken] = sims[taken - i - 1]
    return list(zip(numbers.tolist(), numbers[leader].tolist(), similarity.tolist()))


def _greedy_blocks(threshold: float, keep_small: bool):
    @F.pandas_udf(MEMBER)
    def run(numbers: pd.Series, lengths: pd.Series, slots: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for no, ln, sl, we in zip(numbers, lengths, slots, w):
            if keep_small and len(no) <= 2:
                out.append([(int(x), int(x), 1.0) for x in no])
                continue
            width = int(sl.max()) + 1 if len(sl) else 1
            out.append(_greedy(no, _matrix(ln, sl, we, width), threshold))
        return pd.Series(out)

    return run


def _absorbed(threshold: float):
    """For each topic of a block: its first leader above the threshold, or none."""

    @F.pandas_udf(MEMBER)
    def run(
        numbers: pd.Series,
        lengths: pd.Series,
        slots: pd.Series,
        w: pd.Series,
        l_numbers: pd.Series,
        l_lengths: pd.Series,
        l_slots: pd.Series,
        l_w: pd.Series,
    ) -> pd.Series:
        out = []
        for no, ln, sl, we, lno, lln, lsl, lwe in zip(
            numbers, lengths, slots, w, l_numbers, l_lengths, l_slots, l_w
        ):
            width = int(max(sl.max(initial=0), lsl.max(initial=0))) + 1
            sims = np.round(_matrix(ln, sl, we, width) @ _matrix(lln, lsl, lwe, width).T, 9)
            above = sims > threshold
            first = above.argmax(axis=1)
            out.append(
                [
                    (int(no[r]), int(lno[first[r]]), float(sims[r, first[r]]))
                    if above[r, first[r]]
                    else (int(no[r]), None, None)
                    for r in range(len(no))
                ]
            )
        return pd.Series(out)

    return run


def _pairs_above(threshold: float):
    @F.pandas_udf(PAIR)
    def run(
        numbers: pd.Series,
        lengths: pd.Series,
        slots: pd.Series,
        w: pd.Series,
        r_numbers: pd.Series,
        r_lengths: pd.Series,
        r_slots: pd.Series,
        r_w: pd.Series,
    ) -> pd.Series:
        out = []
        for no, ln, sl, we, rno, rln, rsl, rwe in zip(
            numbers, lengths, slots, w, r_numbers, r_lengths, r_slots, r_w
        ):
            width = int(max(sl.max(initial=0), rsl.max(initial=0))) + 1
            sims = np.round(_matrix(ln, sl, we, width) @ _matrix(rln, rsl, rwe, width).T, 9)
            hits = np.argwhere((sims > threshold) & (no[:, None] < rno[None, :]))
            out.append([(int(a), int(b), float(sims[a, b])) for a, b in hits])
        return pd.Series(out)

    return run


def _split(vectors: DataFrame, keys: list[str], number: str) -> DataFrame:
    return vectors.select(
        *keys,
        F.col(number).cast("int").alias("_no"),
        F.transform("vector", lambda x: x["slot"]).alias("_slots"),
        F.transform("vector", lambda x: x["w"]).alias("_w"),
    )


def _packed(rows: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """One row per ``keys``: numbers, entry counts, flattened slots and weights."""
    cols = ["_no", "_slots", "_w", *carried]
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_rows"))
    return packed.select(
        *keys,
        F.col("_rows._no").alias("_no"),
        F.transform("_rows", lambda r: F.array_size(r["_slots"])).alias("_len"),
        F.flatten("_rows._slots").alias("_slots"),
        F.flatten("_rows._w").alias("_w"),
        *[F.col(f"_rows.{c}").alias(c) for c in carried],
    )


_BLOCK = ["_no", "_len", "_slots", "_w"]


def has_later_blocks(rows: DataFrame, number: str, block_rows: int) -> bool:
    """Whether any group reaches past its first block.

    Ask the stored topics and not a derived table: the filter is pushed to the
    scan, where statistics of the number column usually answer it.
    """
    return not rows.where(F.col(number) >= block_rows).select(number).isEmpty()


def similar_pairs(
    vectors: DataFrame,
    within: list[str],
    number: str,
    threshold: float,
    later: bool,
    block_rows: int = 1000,
) -> DataFrame:
    """``within, i, j, sim, copies_i, copies_j`` for i < j above the threshold.

    Topics of one article with equal vectors are first folded into their lowest
    number, with the count of copies kept, so a hot group of copies is one point.
    ``later`` is ``has_later_blocks`` of the topics.
    """
    points = (
        _split(vectors, within, number)
        .groupBy(*within, "_slots", "_w")
        .agg(F.min("_no").alias("_no"), F.count("*").alias("_copies"))
        .where(F.array_size("_slots") > 0)
    )
    block = F.expr(f"_no div {block_rows}") if later else F.lit(0)
    points = points.withColumn("_block", block.cast("int"))
    if later:
        blocks = written(_packed(points, [*within, "_block"], "_copies"))
        last = blocks.groupBy(*within).agg(F.max("_block").alias("_last"))
        left = blocks.join(last, within).withColumn(
            "_other", F.explode(F.sequence("_block", "_last"))
        )
        right = blocks.select(
            *within,
            F.col("_block").alias("_other"),
            *[F.col(c).alias(f"{c}_r") for c in [*_BLOCK, "_copies"]],
        )
        both = left.join(right, [*within, "_other"])
    else:
        blocks = _packed(points, within, "_copies")
        both = blocks.select("*", *[F.col(c).alias(f"{c}_r") for c in [*_BLOCK, "_copies"]])
    found = _pairs_above(threshold)(*_BLOCK, *[f"{c}_r" for c in _BLOCK])
    # look the topics up before the explode, so that no row carries the block
    named = F.transform(
        "_pairs",
        lambda p: F.struct(
            F.get("_no", p["a"]).alias("i"),
            F.get("_no_r", p["b"]).alias("j"),
            p["sim"].alias("sim"),
            F.get("_copies", p["a"]).alias("copies_i"),
            F.get("_copies_r", p["b"]).alias("copies_j"),
        ),
    )
    pairs = exploded(both.withColumn("_pairs", found), within, named, "p")
    return pairs.select(*within, "p.*")


ORDER_SLOTS = 200_000  # slots whose frequency order is sent to every task, at most
SLACK = 1e-9  # similarities are compared at nine decimals


def _points(vectors: DataFrame, within: list[str], number: str) -> DataFrame:
    """Equal vectors of a group folded into their lowest number, with their copies."""
    return (
        _split(vectors, within, number)
        .groupBy(*within, "_slots", "_w")
        .agg(F.min("_no").alias("_no"), F.count("*").alias("_copies"))
        .where(F.array_size("_slots") > 0)
    )


def prefix_pairs(vectors: DataFrame, within: list[str], number: str, threshold: float) -> DataFrame:
    """``within, i, j, sim, copies_i, copies_j`` for i < j with sim above ``threshold``:
    a prefix-filtered self join (Bayardo et al., 2007), exact.

    Slots are put in one global order, rarest first. A vector's prefix is its entries up
    to the last from which the remaining mass (norm of the rest, times the largest norm
    of any vector) can still reach the threshold. Two vectors above the threshold share
    their first common slot in both prefixes, so only prefix slots are joined, and each
    candidate is scored exactly. Equal vectors are one point (see ``copies``), so a group
    of copies adds no pairs. If more than ORDER_SLOTS slots occur, the order is a hash of
    the slot instead: still exact, with longer prefixes.
    """
    points = written(_points(vectors, within, number))
    top = points.agg(F.max(F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, w: a + w * w)))).first()[0] or 0.0
    frequency = points.select(F.explode("_slots").alias("slot")).groupBy("slot").count()
    if frequency.count() <= ORDER_SLOTS:
        ordered = frequency.orderBy("count", "slot").collect()
        rank = F.create_map(*[F.lit(x) for r in ordered for x in (int(r["slot"]), int(r["count"]))]) if ordered else None
        key = (lambda slot: F.element_at(rank, slot)) if rank is not None else (lambda slot: F.lit(0))
    else:
        key = lambda slot: F.xxhash64(slot)
    entries = F.array_sort(F.arrays_zip(F.transform("_slots", key).alias("k"), F.col("_slots").alias("s"), F.col("_w").alias("w")))
    reach = threshold - SLACK
    with_entries = points.withColumn("_e", entries)
    rest = lambda i: F.sqrt(F.aggregate(F.slice("_e", i + 1, F.array_size("_e")), F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
    prefix = F.filter(F.transform("_e", lambda e, i: F.when(rest(i) * F.lit(top) >= F.lit(reach), e["s"])), lambda s: s.isNotNull())
    names = [f"_g{n}" for n in range(len(within))]
    posted = with_entries.select(*[F.col(c).alias(g) for c, g in zip(within, names)], "_no", F.explode(prefix).alias("_slot"))
    a = posted.select(*[F.col(g).alias(f"a{g}") for g in names], F.col("_slot").alias("_sa"), F.col("_no").alias("i"))
    b = posted.select(*[F.col(g).alias(f"b{g}") for g in names], F.col("_slot").alias("_sb"), F.col("_no").alias("j"))
    same = lambda x, y: [F.col(f"{x}{g}").eqNullSafe(F.col(f"{y}{g}")) for g in names]
    candidates = (
        a.join(b, same("a", "b") + [F.col("_sa") == F.col("_sb"), F.col("i") < F.col("j")])
        .select(*[F.col(f"a{g}").alias(g) for g in names], "i", "j")
        .distinct()
    )
    vec = points.select(*[F.col(c).alias(g) for c, g in zip(within, names)], "_no", F.map_from_arrays("_slots", "_w").alias("_m"), "_copies")
    left = vec.select(*[F.col(g).alias(f"l{g}") for g in names], F.col("_no").alias("_li"), F.col("_m").alias("_mi"), F.col("_copies").alias("copies_i"))
    right = vec.select(*[F.col(g).alias(f"r{g}") for g in names], F.col("_no").alias("_rj"), F.col("_m").alias("_mj"), F.col("_copies").alias("copies_j"))
    joined = candidates.join(left, same("", "l") + [F.col("i") == F.col("_li")])
    joined = joined.join(right, same("", "r") + [F.col("j") == F.col("_rj")])
    sim = F.round(F.aggregate(F.map_entries("_mi"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.element_at("_mj", e["key"]), F.lit(0.0))), 9)
    return joined.select(*[F.col(g).alias(c) for c, g in zip(within, names)], "i", "j", sim.alias("sim"), "copies_i", "copies_j").where(F.col("sim") > threshold)


def copies(vectors: DataFrame, within: list[str], number: str) -> DataFrame:
    """``within, topic_no, representative, copies``: every numbered vector with the lowest
    number of its equal vectors in the group (empty vectors are equal to each other),
    and how many they are."""
    split = _split(vectors, within, number).withColumn("_h", F.xxhash64(*within, "_slots", "_w"))
    # aggregated before the shuffle, so a large group of copies is one row here
    firsts = split.groupBy("_h", *within, "_slots", "_w").agg(
        F.min("_no").alias("representative"), F.count("*").alias("copies")
    )
    names = [f"_f{n}" for n in range(len(within))]
    firsts = firsts.select("_h", *[F.col(c).alias(g) for c, g in zip(within, names)],
                           F.col("_slots").alias("_fs"), F.col("_w").alias("_fw"), "representative", "copies")
    on = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(within, names)] + [F.col("_slots") == F.col("_fs"), F.col("_w") == F.col("_fw")]
    return split.join(firsts.withColumnRenamed("_h", "_fh"), [F.col("_h") == F.col("_fh"), *on]).select(
        *within, F.col("_no").alias("topic_no"), "representative", "copies"
    )


def topic_leaders(
    vectors: DataFrame,
    within: list[str],
    number: str,
    threshold: float,
    later: bool,
    block_rows: int = 1000,
) -> DataFrame:
    """``within, number, leader_no, sim``: the group each topic belongs to.

    In topic order, a topic not yet taken leads a group and takes every later
    untaken topic more similar than the threshold; it is not transitive. Groups
    of at most two topics stay as they are. ``later`` is ``has_later_blocks`` of
    the topics.
    """
    rows = _split(vectors, within, number)
    if not later:
        members = _greedy_blocks(threshold, True)(*_BLOCK)
        found = _packed(rows, within).select(*within, F.explode(members).alias("m"))
    else:
        found = _leaders_in_rounds(rows, within, threshold, block_rows)
    return found.select(
        *within, F.col("m.topic_no").alias(number), "m.leader_no", "m.sim"
    )


def _leaders_in_rounds(
    rows: DataFrame, within: list[str], threshold: float, block_rows: int
) -> DataFrame:
    """Exact leader grouping of articles larger than one block.

    Each round settles the first open topics of every article, at most
    ``block_rows``, then lets the new leaders take what they can from the rest,
    which is spread over blocks and salts. The first leader to reach a topic in
    this order is also its lowest, so the result equals the one-pass rule.
    Every round is written, which bounds lineage and survives lost executors.
    """
    settled: list[DataFrame] = []
    open_rows = written(rows)
    first_round = True
    while not open_rows.isEmpty():
        rank = F.row_number().over(W.partitionBy(*within).orderBy("_no"))
        heads = open_rows.withColumn("_rank", rank).where(F.col("_rank") <= block_rows)
        heads = written(heads.drop("_rank"))
        cut = heads.groupBy(*within).agg(F.max("_no").alias("_cut"))
        members = _greedy_blocks(threshold, first_round)(*_BLOCK)
        taken = written(_packed(heads, within).select(*within, F.explode(members).alias("m")))
        settled.append(taken)
        rest = open_rows.join(cut, within).where(F.col("_no") > F.col("_cut")).drop("_cut")
        leads = taken.where(F.col("m.topic_no") == F.col("m.leader_no")).select(
            *within, F.col("m.topic_no").alias("_no")
        )
        leader_blocks = _packed(heads.join(leads, [*within, "_no"]), within).select(
            *within,
            *[F.col(c).alias(f"{c}_l") for c in _BLOCK],
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
        )
        rest_blocks = _packed(
            rest.withColumn("_block", F.expr(f"_no div {block_rows}")), [*within, "_block"]
        ).withColumn("_salt", F.pmod(F.xxhash64("_block"), F.lit(SALTS)).cast("int"))
        reach = _absorbed(threshold)(*_BLOCK, *[f"{c}_l" for c in _BLOCK])
        reached = written(
            rest_blocks.join(leader_blocks, [*within, "_salt"]).select(
                *within, F.explode(reach).alias("m")
            )
        )
        settled.append(reached.where(F.col("m.leader_no").isNotNull()))
        still = reached.where(F.col("m.leader_no").isNull()).select(
            *within, F.col("m.topic_no").alias("_no")
        )
        open_rows = written(rest.join(still, [*within, "_no"]))
        first_round = False
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out
