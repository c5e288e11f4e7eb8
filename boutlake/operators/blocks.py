"""Rounds of ratings by opponents in blocks of a group's teams.

A block is a bounded number of pairs (team, opponent), those of a share of a group's teams. Each round a
block sends every other block the ratings which that one asked for, once each, so what is shuffled is ratings and never
games: blocks are dealt once. Spark deals and shuffles; a task does the arithmetic of a block by numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlake.tables import pinned

NOBODY = -(2**62)  # in place of a null opponent: no team has it
OWN = -1  # the sender of a block's row about itself
PACKED = "gid int, b int, asker int, ids array<long>, team array<long>, t array<int>, pos array<int>, " + ", ".join(f"{c} array<double>, n_{c} array<double>, {c}0 array<double>" for c in ("oe", "de", "poss"))
SENT = "gid int, b int, src int, oe array<double>, de array<double>, x_oe array<double>, x_de array<double>, s_oe double, c_oe double, s_de double, c_de double, change double"


def _cell(values, missing=None) -> pa.ListArray:
    flat = pa.array(values, mask=missing)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _rows(rows: list[dict], like: str) -> pa.Table:
    """A table of rows with the columns of the DDL string ``like``; cells are numbers or one-row list arrays."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    out = {}
    for name, kind in (c.split() for c in like.split(", ")):
        inner = kinds[kind.removeprefix("array<").removesuffix(">")]
        cells = [r.get(name) for r in rows]
        if kind.startswith("array"):
            out[name] = pa.concat_arrays([pa.nulls(1, pa.list_(inner)) if c is None else c.cast(pa.list_(inner)) for c in cells] or [pa.nulls(0, pa.list_(inner))])
        else:
            out[name] = pa.array(cells, inner)
    return pa.table(out)


def _list(table: pa.Table, name: str, row: int = 0) -> pa.Array:
    """The values of a cell; of a null one, none."""
    cell = table[name][row].values
    return pa.array([], table.schema.field(name).type.value_type) if cell is None else cell


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return values.fill_null(0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)


def _pack(pairs: pa.Table) -> pa.Table:
    """A block's pairs as one row of arrays, and a row for each block that is asked for ratings: whose, in the order in which they are used."""
    col = {c: pairs[c].to_numpy() for c in pairs.column_names}
    gid, b = int(col["gid"][0]), int(col["b"][0])
    team, t = np.unique(col["t"], return_inverse=True)
    whom, at, where = np.unique(col["o"], return_index=True, return_inverse=True)
    block = col["ob"][at]
    order = np.lexsort((whom, block))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    row = {"gid": gid, "b": b, "team": _cell(team), "t": _cell(t.astype(np.int32)), "pos": _cell(place[where])}
    for c in ("oe", "de", "poss"):
        n, total = (np.bincount(t, col[k], len(team)) for k in (f"n_{c}", c))
        row |= {c: _cell(col[c]), f"n_{c}": _cell(n), f"{c}0": _cell(total / np.maximum(n, 1), n == 0)}
    whom, block = whom[order], block[order]
    ends = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    return _rows([row, *[{"gid": gid, "b": int(block[i]), "asker": b, "ids": _cell(whom[i:j])} for i, j in zip(ends, ends[1:])]], PACKED)


def _route(asks: pa.Table, own: pa.Table) -> pa.Table:
    """Where the teams that a block is asked for stand in it, asker by asker; -1 for one that it hasn't."""
    if not asks.num_rows:
        return _rows([], "gid int, b int, to array<int>, size array<int>, need array<int>")
    team = _list(own, "team").to_numpy() if own.num_rows else np.array([], np.int64)
    ids = [_list(asks, "ids", i).to_numpy() for i in range(asks.num_rows)]
    whom = np.concatenate(ids)
    at = np.searchsorted(team, whom)
    known = np.append(team, NOBODY)[at] == whom if len(team) else np.zeros(len(whom), bool)
    known &= whom != NOBODY
    row = {"gid": asks["gid"][0].as_py(), "b": asks["b"][0].as_py(), "to": _cell(asks["asker"].to_numpy()), "size": _cell(np.array([len(x) for x in ids], np.int32)), "need": _cell(np.where(known, at, -1).astype(np.int32))}
    return _rows([row], "gid int, b int, to array<int>, size array<int>, need array<int>")


def _send(block: pa.Table, row: int, new: dict[str, tuple[np.ndarray, np.ndarray]], about: dict) -> list[dict]:
    """A block's row about itself and what it sends to those that asked."""
    gid, b = block["gid"][row].as_py(), block["b"][row].as_py()
    out = [{"gid": gid, "b": b, "src": OWN, **{c: _cell(*new[c]) for c in new}, **about}]
    need = _list(block, "need", row).to_numpy()
    asked = {c: (np.append(v, 0.0)[need], np.append(gone, True)[need]) for c, (v, gone) in new.items()}
    start = 0
    for to, size in zip(_list(block, "to", row).to_pylist(), _list(block, "size", row).to_pylist()):
        part = slice(start, start := start + size)
        out.append({"gid": gid, "b": to, "src": b, **{c: _cell(v[part], gone[part]) for c, (v, gone) in asked.items()}})
    return out


def _first(batches):
    """What blocks send before the first round: averages."""
    for batch in batches:
        block = pa.Table.from_batches([batch])
        for i in range(block.num_rows):
            new = {c: _numbers(_list(block, f"{c}0", i)) for c in ("oe", "de")}
            yield from _rows(_send(block, i, new, {"x_oe": _cell(*new["oe"]), "x_de": _cell(*new["de"])}), SENT).to_batches()


def _round(sent: pa.Table, block: pa.Table, of: dict[int, tuple[float, float, float]]) -> pa.Table:
    """One round of a block: its games against the opponents' ratings. The row about itself has the ratings it began with (x_), the new ones before they are scaled, their sums and counts, and how far x_ moved in the round before."""
    if not sent.num_rows or not block.num_rows:
        return _rows([], SENT)
    sent = sent.sort_by("src").combine_chunks()
    (lg, *by), t, pos = of[block["gid"][0].as_py()], _list(block, "t").to_numpy(), _list(block, "pos").to_numpy()
    new, about, moved = {}, {}, []
    for c, other, by_own, by_other in (("oe", "de", *by), ("de", "oe", *by[::-1])):
        x, gone = _numbers(_list(sent, c))
        x = x * by_own
        before, _ = _numbers(_list(sent, f"x_{c}"))
        moved.append(np.abs(x - before)[~gone])
        theirs = sent[other].slice(1).combine_chunks()
        met, unknown = _numbers(theirs.flatten() if len(theirs) else pa.array([], pa.float64()))
        met = np.maximum(np.where(unknown, lg, met * by_other), 1.0)
        n, _ = _numbers(_list(block, f"n_{c}"))
        new[c] = np.bincount(t, _numbers(_list(block, c))[0] / met[pos], len(n)) * lg / np.maximum(n, 1), n == 0
        about |= {f"x_{c}": _cell(x, gone), f"s_{c}": float(new[c][0][n > 0].sum()), f"c_{c}": float((n > 0).sum())}
    moved = np.concatenate(moved)
    return _rows(_send(block, 0, new, about | {"change": float(moved.max()) if len(moved) else None}), SENT)


def pack(games: DataFrame, keys: list[str], size: int) -> tuple[DataFrame, DataFrame, int]:
    """The games of each group in blocks of about ``size`` pairs: (blocks, the teams of each with the group's keys, number of groups). The driver sees a row per group."""
    spark = games.sparkSession
    sizes = games.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    rows, first = [], 0
    for r in sizes:
        if None not in (key := tuple(r[k] for k in keys)):
            rows.append((*key, len(rows), first, -(-r.n // size)))
            first += rows[-1][-1]
    types = {f.name: f.dataType.simpleString() for f in games.schema}
    names = spark.createDataFrame(rows, ", ".join(f"{k} {types[k]}" for k in keys) + ", gid int, first int, blocks int")
    dealt = games.where(F.col("t").isNotNull()).join(F.broadcast(names), keys)  # a row per group
    dealt = dealt.withColumns({"t": F.col("t").cast("long"), "o": F.coalesce(F.col("o").cast("long"), F.lit(NOBODY))})
    block = lambda c: (F.col("first") + F.pmod(F.hash(c), "blocks")).alias
    sums = [x for c in ("oe", "de", "poss") for x in (F.coalesce(F.sum(c), F.lit(0.0)).alias(c), F.count(c).cast("double").alias(f"n_{c}"))]
    # dealt by block first: the sums and the packing then need no other shuffle, and it carries each game once
    dealt = dealt.select("gid", block("t")("b"), block("o")("ob"), "t", "o", "oe", "de", "poss").repartition("b")
    pairs = dealt.groupBy("gid", "b", "ob", "t", "o").agg(*sums)
    packed = pinned(pairs.groupBy("b").applyInArrow(_pack, PACKED))
    own, asks = packed.where("asker IS NULL"), packed.where("asker IS NOT NULL")
    routes = asks.select("gid", "b", "asker", "ids").groupBy("b").cogroup(own.select("b", "team").groupBy("b")).applyInArrow(_route, "gid int, b int, to array<int>, size array<int>, need array<int>")
    both = own.drop("asker", "ids").join(routes.withColumnRenamed("gid", "gid_asked"), "b", "full")
    return both.withColumn("gid", F.coalesce("gid", "gid_asked")).drop("gid_asked"), own.select("gid", "b", "team").join(F.broadcast(names), "gid").select(*keys, "b", "team"), len(rows)


def means(packed: DataFrame) -> dict[int, tuple[float, float]]:
    """Per group, the means over teams of the first ratings and of the tempo; NaN where no team has any."""
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.aggregate(known(c), F.lit(0.0), lambda a, x: a + x)), F.sum(F.size(known(c)))), F.lit(float("nan"))).alias(c)
    return {r.gid: (r.oe0, r.poss0) for r in packed.where("team IS NOT NULL").groupBy("gid").agg(mean("oe0"), mean("poss0")).collect()}


BLOCK = ["gid", "b", "t", "pos", "oe", "de", "n_oe", "n_de", "to", "size", "need"]


def sent_first(blocks: DataFrame) -> DataFrame:
    return blocks.select("gid", "b", "oe0", "de0", "to", "size", "need").mapInArrow(_first, SENT)


def sent_next(blocks: DataFrame, sent: DataFrame, by: dict[int, tuple[float, float, float]]) -> DataFrame:
    """A round of the groups in ``by``: their mean and what new ratings are to be multiplied with, first and second. Other groups are left out."""
    mine = F.col("gid").isin(list(by))
    return sent.where(mine).groupBy("b").cogroup(blocks.select(*BLOCK).where(mine).groupBy("b")).applyInArrow(lambda a, b: _round(a, b, by), SENT)
