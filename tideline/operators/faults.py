"""Implausible readings, judged against the usual behaviour of their own source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.blocks import before, hot_blocks
from tideline.operators import phase
from tideline.operators.grid import micros
from tideline.session import cut, partitions

USUAL = 97  # percentile of a source's runs that counts as usual

_FLAGS = "us bigint, spike boolean, wick boolean, stuck boolean, impossible boolean"
_SHAPE = "struct<k:int,u:double,du:double,ddu:double,r:double,move:double,n:bigint>"


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Complete groups out of sorted batches: a table for each run of rows with equal keys; at most one group is held."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        last = t.slice(t.num_rows - 1, 1).select(keys)
        if held and held[0].slice(0, 1).select(keys).equals(last):
            held.append(t)
            continue
        t = pa.concat_tables([*held, t]).combine_chunks()
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k)
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy().astype(bool)
        starts = np.r_[0, np.flatnonzero(change)]
        for a, b in zip(starts[:-1], starts[1:]):
            yield t.slice(a, b - a)
        held = [t.slice(starts[-1])]
    if held:
        yield pa.concat_tables(held)


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """us, close (nan where null), wick (nan where null) and impossible of one group, repeated times dropped."""
    us = t.column("us").to_numpy()
    first = np.r_[True, us[1:] != us[:-1]]
    return us[first], *[t.column(k).to_numpy().astype(float)[first] for k in ("c", "wick")], t.column("impossible").to_numpy().astype(bool)[first]


def _usable(c: np.ndarray) -> np.ndarray:
    return (c > 0) & (c < np.inf)


def _too_long(repeats: np.ndarray, usual: float, least: int, over: float) -> np.ndarray:
    return (repeats >= least) & (repeats >= least + over * max(usual - 1, 0.0))


def _flat(names: list[str], source, us, spike, wick, stuck, impossible) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_arrays([source, *map(pa.array, (us, spike, wick, stuck, impossible))], names=names)


def _whole(batches: Iterator[pa.RecordBatch], *, far: float, wick_far: float, least: int, over: float) -> Iterator[pa.RecordBatch]:
    """Flags of sources that come whole, one after another."""
    names = ["source", "us", "spike", "wick", "stuck", "impossible"]
    for t in _groups(batches, ["s"]):
        us, c, wick, impossible = _columns(t)
        ok = _usable(c)
        spike, stuck = np.zeros(len(us), bool), np.zeros(len(us), bool)
        limit = np.inf
        if ok.any():
            spike[ok], shape = phase.spikes(np.log(c[ok]), far)
            limit = wick_far * shape.universal * shape.move
            moved, run = phase.runs_of(c[ok], None)
            repeats = np.bincount(run)[1:] - 1
            stuck[ok] = ~moved & _too_long(repeats, np.percentile(repeats, USUAL), least, over)[run - 1]
        yield _flat(names, pa.repeat(t.column("s")[0], len(us)), us, spike, wick > limit, stuck, impossible)


def _as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of a hot source: its rows as arrays, and the closes at its ends."""
    for t in _groups(batches, ["s", "b"]):
        us, c, wick, impossible = _columns(t)
        good = c[_usable(c)]
        ends = np.unique(np.r_[np.arange(min(phase.HALO, len(good))), np.arange(max(0, len(good) - phase.HALO), len(good))])
        yield pa.RecordBatch.from_arrays(
            [t.column("s").slice(0, 1).combine_chunks(), t.column("b").slice(0, 1).combine_chunks(), *[pa.array([v]) for v in (us, c, wick, impossible)], pa.array([good[ends]], pa.list_(pa.float64())), pa.array([len(good)])],
            names=["s", "b", "us", "c", "wick", "impossible", "ends", "n"],
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after another; arrays of numbers and flags come as NumPy views, so that a batch is never turned into Python objects as a whole."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                v = column[i]
                flat = pa.types.is_list(column.type) and not pa.types.is_nested(column.type.value_type)
                row[name] = v.values.to_numpy(zero_copy_only=False) if flat and v.is_valid else v.as_py()
            yield row


def _array(v) -> np.ndarray:  # noqa: ANN001
    return np.empty(0) if v is None else np.asarray(v, float)


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, slice]:
    """The closes of a block between those on either side, its own usable rows, and its place among them."""
    c, left, right = (_array(row[k]) for k in ("c", "left", "right"))
    ok = _usable(c)
    return np.concatenate([left, c[ok], right]), ok, slice(len(left), len(left) + int(ok.sum()))


def _shapes(row: dict) -> list[phase.Shape]:
    return [phase.Shape(x["u"], x["du"], x["ddu"], x["r"], x["move"], x["n"]) for x in row["shapes"] or []]


def _measure(batches: Iterator[pa.RecordBatch], far: float) -> Iterator[pa.RecordBatch]:
    """(s, what, bin, n): the histograms and sums of one block after the rounds so far."""
    for row in _rows(batches):
        c, _, part = _block(row)
        y = np.log(c)
        flags, new = phase.flagged_by(y, _shapes(row), far)
        histograms, (total, count) = phase.measured(y, phase.coordinates(y, flags), flags, part)
        out = [(k, int(b), int(n)) for k in phase.COORDINATES for b, n in zip(*histograms[k])]
        out += [("total", 0, total), ("count", 0, count), ("new", 0, int(new[part].sum())), ("n", 0, part.stop - part.start)]
        what, bins, n = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array([row["s"]] * len(out)), pa.array(what), pa.array(bins, pa.int64()), pa.array(n, pa.int64())], names=["s", "what", "bin", "n"])


def _shape(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's ellipsoid from its summed histograms, whose number of bins is bounded by the range of a double."""
    pdf = pdf.sort_values(["what", "bin"])
    h = {k: (g["bin"].to_numpy(), g["n"].to_numpy()) for k, g in pdf.groupby("what")}
    one = {k: int(h[k][1].sum()) for k in ("total", "count", "new", "n")}
    none = (np.array([], int), np.array([], int))
    s = phase.shape_of({k: h.get(k, none) for k in phase.COORDINATES}, (one["total"], one["count"]), one["n"])
    return pd.DataFrame({"s": [pdf["s"].iloc[0]], "u": s.u, "du": s.du, "ddu": s.ddu, "r": s.r, "move": s.move, "n": s.n, "new": one["new"]})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, b, moves, runs): how often the close of a block moves, and the repeats of each run in it that has any; run 0 goes on from the block before."""
    for row in _rows(batches):
        c, _, part = _block(row)
        moved, run = phase.runs_of(c[part], c[part.start - 1] if part.start else None)
        at, n = np.unique(run[~moved], return_counts=True)
        runs = [{"run": int(a), "repeats": int(k)} for a, k in zip(at, n)]
        kind = pa.list_(pa.struct([("run", pa.int64()), ("repeats", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array([row["s"]]), pa.array([row["b"]]), pa.array([int(moved.sum())]), pa.array([runs], kind)], names=["s", "b", "moves", "runs"])


def _judge(batches: Iterator[pa.RecordBatch], far: float, wick_far: float) -> Iterator[pa.RecordBatch]:
    """Flags of the rows of each block, given its source's ellipsoids and the runs of the block that are too long."""
    names = ["source", "us", "spike", "wick", "stuck", "impossible"]
    for row in _rows(batches):
        c, ok, part = _block(row)
        shapes = _shapes(row)
        spike, stuck = np.zeros(len(ok), bool), np.zeros(len(ok), bool)
        spike[ok] = phase.flagged_by(np.log(c), shapes, far)[0][part]
        moved, run = phase.runs_of(c[part], c[part.start - 1] if part.start else None)
        stuck[ok] = ~moved & np.isin(run, _array(row["long"]))
        limit = wick_far * shapes[-1].universal * shapes[-1].move if shapes else np.inf
        yield _flat(names, pa.array([row["s"]] * len(ok)), np.asarray(row["us"], np.int64), spike, _array(row["wick"]) > limit, stuck, np.asarray(row["impossible"], bool))


def _neighbours(blocks: DataFrame) -> DataFrame:
    """blocks with `left` and `right`: the HALO usable closes before and after each block, however many blocks they lie in.

    Only the closes at the ends of blocks are ordered, two halos a block.
    """
    ends = blocks.select("s", "b", F.posexplode("ends").alias("i", "v"))
    w = Window.partitionBy("s").orderBy("b", "i")
    first, last = F.col("i") == 0, F.col("i") == F.max("i").over(Window.partitionBy("s", "b"))
    seen = ends.select("s", "b", F.when(first, F.collect_list("v").over(w.rowsBetween(-phase.HALO, -1))).alias("l"), F.when(last, F.collect_list("v").over(w.rowsBetween(1, phase.HALO))).alias("r"))
    beside = seen.groupBy("s", "b").agg(F.first("l", ignorenulls=True).alias("left"), F.first("r", ignorenulls=True).alias("right"))
    return blocks.join(beside, ["s", "b"], "left")


def _in_blocks(rows: DataFrame, in_order: list, map_: Callable, *, far: float, wick_far: float, least: int, over: float) -> DataFrame:
    """Flags of sources that lie in several blocks: the same steps, with histograms and runs summed over a source's blocks."""
    kind = rows.schema["s"].dataType.simpleString()
    ordered = rows.repartition(partitions(rows.sparkSession), "s", "b").sortWithinPartitions("s", "b", *in_order).select("s", "b", "us", "c", "wick", "impossible")
    blocks = cut(map_(ordered, _as_blocks, f"s {kind}, b bigint, us array<bigint>, c array<double>, wick array<double>, impossible array<boolean>, ends array<double>, n bigint"))
    blocks = cut(_neighbours(blocks).drop("ends", "n"))
    known = blocks.select("s").distinct().withColumn("shapes", F.lit(None).cast(f"array<{_SHAPE}>"))
    for k in range(phase.ROUNDS + 1):
        counts = map_(blocks.join(known, "s").select("s", "c", "left", "right", "shapes"), partial(_measure, far=far), f"s {kind}, what string, bin bigint, n bigint")
        summed = counts.groupBy("s", "what", "bin").agg(F.sum("n").alias("n"))
        shape = cut(summed.groupBy("s").applyInPandas(_shape, f"s {kind}, u double, du double, ddu double, r double, move double, n bigint, new bigint"))
        if k == phase.ROUNDS or (k and not shape.agg(F.sum("new")).first()[0]):
            break
        this = F.array(F.struct(F.lit(k).alias("k"), "u", "du", "ddu", "r", "move", "n").cast(_SHAPE))
        known = cut(known.join(shape, "s").select("s", F.concat(F.coalesce("shapes", F.array().cast(f"array<{_SHAPE}>")), this).alias("shapes")))

    local = cut(map_(blocks.select("s", "b", "c", "left", "right"), _runs, f"s {kind}, b bigint, moves bigint, runs array<struct<run:bigint,repeats:bigint>>"))
    base = cut(before(local.select("s", "b", "moves"), "s", "b", F.sum, "moves", "base").select("s", "b", F.coalesce("base", F.lit(0)).alias("base")))
    pieces = cut(local.join(base, ["s", "b"]).select("s", "b", "base", F.inline("runs")).select("s", "b", F.col("run").alias("local"), (F.col("run") + F.col("base")).alias("run"), "repeats"))
    repeats = cut(pieces.groupBy("s", "run").agg(F.sum("repeats").alias("repeats")))
    lengths = repeats.groupBy("s", "repeats").agg(F.count("*").alias("k"))
    total = local.groupBy("s").agg(F.sum("moves").alias("runs")).join(repeats.groupBy("s").agg(F.count("*").alias("some")), "s", "left")
    none = total.select("s", F.lit(0).cast("bigint").alias("repeats"), (F.col("runs") - F.coalesce("some", F.lit(0))).alias("k"))
    usual = lengths.unionByName(none.where("k > 0")).groupBy("s").agg(F.percentile("repeats", F.lit(USUAL / 100), F.col("k")).alias("usual"))
    long = repeats.where(F.col("repeats") >= least).join(usual, "s").where(F.col("repeats") >= least + over * F.greatest(F.col("usual") - 1, F.lit(0.0)))
    in_block = pieces.join(long.select("s", "run"), ["s", "run"]).groupBy("s", "b").agg(F.collect_list("local").alias("long"))
    full = blocks.join(known, "s").join(in_block, ["s", "b"], "left").drop("b")
    return map_(full, partial(_judge, far=far, wick_far=wick_far), f"source {kind}, {_FLAGS}")


def flag_faults(
    candles: DataFrame,
    *,
    source: str = "secid",
    time: str = "dt_msk",
    open: str = "open",  # noqa: A002
    high: str = "high",
    low: str = "low",
    close: str = "close",
    latest: str = "fetched_at",
    far: float = 4.5,
    wick_far: float = 3.0,
    least_repeats: int = 5,
    repeats_over_usual: float = 2.3,
    per_block: int = 50_000,
) -> DataFrame:
    """One row (source, us, spike, wick, stuck, impossible) per source and time, the four faults as booleans; us is the wall time in microseconds.

    spike: phase-space thresholding of log closes. A candle is a point (u, du, ddu): its deviation from the nearer of the
    levels before and after it (medians of five closes) and the first and second difference of that. It is flagged if it
    lies outside the ellipsoid whose half axes are `far` times the universal threshold sqrt(2 ln n) in units of robust
    scales (median absolute deviations), turned by the robust correlation of u and ddu, and if the excursion is its own:
    |u| is at least half as large as either neighbour's, since a spike throws its neighbours out of the ellipsoid too.
    Flagged points are replaced by their level, the ellipsoid is measured anew from the rest, and so on until a round flags
    nothing new, at most eight rounds. A lasting change of level has small u on both sides and is none.
    wick: high or low lies wick_far universal thresholds, in scales of the source's moves, beyond both open and close.
    stuck: the close repeats the preceding one in a run of at least least_repeats repeats, and repeats_over_usual more
    for every repeat over one that the 97th percentile of the source's runs has (single prices count as runs of
    none); every row of it but the first.
    impossible: close, high or low not above zero or not finite, high below low, or close outside them.

    Copies of a row collapse before anything is moved. A source of up to per_block rows is then judged in one piece, after
    one exchange. A larger one is cut into blocks in order of time: each sees the 48 closes on either side, on which the
    rounds depend, and the histograms behind the scales, the signs behind the correlation and the runs are summed over the
    blocks between rounds, so that no task holds such a source; both ways give the same flags.

    Defined cases: of rows with the same source and time the one with the greatest `latest` holds (then the greatest
    prices); rows with null source or time are left out; null prices cannot be faulty and are skipped in the order;
    sources with few rows or only equal prices have no spikes; empty tables work; other columns are ignored.
    """
    num = lambda c, a: F.col(c).cast("double").alias(a)
    raw = candles.where(F.col(source).isNotNull() & F.col(time).isNotNull()).select(F.col(source).alias("s"), micros(F.col(time)).alias("us"), F.col(latest).alias("at"), num(close, "c"), num(high, "h"), num(low, "l"), num(open, "o"))
    # What high and low say is settled per row, so that only one number and one flag travel on.
    fine = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    holds = lambda cond: F.coalesce(cond, F.lit(False))
    bad = lambda c: holds(F.col(c).isNotNull() & ~fine(c))
    trio = holds(F.col("h") < F.col("l")) | holds(F.col("c") > F.col("h")) | holds(F.col("c") < F.col("l"))
    good = lambda c: F.when(fine(c), F.log(c))
    beyond = F.greatest(good("h") - F.greatest(good("o"), good("c")), F.least(good("o"), good("c")) - good("l"))
    each = raw.select("s", "us", "at", "c", beyond.alias("wick"), (bad("c") | bad("h") | bad("l") | trio).alias("impossible"))
    one = each.groupBy("s", "us", "c", "wick", "impossible").agg(F.max("at").alias("at"))
    rows, some_hot = hot_blocks(one, "s", "us", per_block, raw.select("s"))
    in_order = [F.col("us"), *[F.col(c).desc_nulls_last() for c in ("at", "c", "wick", "impossible")]]
    kind = rows.schema["s"].dataType.simpleString()
    rules = {"far": far, "wick_far": wick_far, "least": least_repeats, "over": repeats_over_usual}
    map_ = lambda df, f, schema: df.mapInArrow(f, schema)
    cold = rows.where("b = -1").repartition(partitions(rows.sparkSession), "s").sortWithinPartitions("s", *in_order).select("s", "us", "c", "wick", "impossible")
    flags = map_(cold, partial(_whole, **rules), f"source {kind}, {_FLAGS}")
    return flags.unionByName(_in_blocks(rows.where("b >= 0"), in_order, map_, **rules)) if some_hot else flags
