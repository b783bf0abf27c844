"""Ordered computations over groups of any size: rows are dealt into ranges of their order, ranges are computed on their own, and what one
range hands to the next is carried over their summaries, one small row a range.

``parts`` deals rows into ranges of about equal size, whatever the sizes of groups, so one giant group runs in balanced tasks and many small ones share
ranges. ``numbered`` and ``running`` need windows only; ``fold`` runs a sequential state machine whose state is one integer or none.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import drop, written

#: Rows of a range, about.
ROWS = 200_000
_PLACE = (1 << 33) - 1


def parts(df: DataFrame, by: list[str], order: list, rows: int = ROWS) -> DataFrame:
    """``df`` in the order of ``by`` and ``order``, stored, with __part (the range) and __pos (place in it).

    Rows that agree in all of ``by`` and ``order`` share a range, so ``order`` should be total. Nulls come first.
    """
    n = max(1, math.ceil(df.count() / rows))
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(dealt.withColumns({"__part": F.spark_partition_id(), "__pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}))


def _totals(parted: DataFrame) -> DataFrame:
    """(__part, __before): rows of all earlier ranges; one row a range."""
    n = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    return n.select("__part", "__n", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: list, name: str = "row", rows: int = ROWS) -> DataFrame:
    """Adds the place of each row in the whole table, from 1, without bringing the table into one task."""
    p = parts(df, [], order, rows)
    return p.join(_totals(p).drop("__n"), "__part").withColumn(name, F.col("__before") + F.col("__pos") + 1).drop("__part", "__pos", "__before")


def running(parted: DataFrame, by: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each row sums, and last values that are not null, over the rows of its group strictly before it.

    Windows run within a range; per range and group one row of totals is carried on.
    """
    sums, lasts = sums or {}, lasts or {}
    made = parted.withColumns({f"__v_{k}": c for k, c in {**sums, **lasts}.items()})
    before = Window.partitionBy("__part", *by).orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    local = {f"__l_{k}": F.coalesce(F.sum(f"__v_{k}").over(before), F.lit(0)) for k in sums} | {f"__l_{k}": F.last(f"__v_{k}", ignorenulls=True).over(before) for k in lasts}
    total = [F.coalesce(F.sum(f"__v_{k}"), F.lit(0)).alias(f"__c_{k}") for k in sums]
    total += [F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), F.col("__pos"))).alias(f"__c_{k}") for k in lasts]
    ends = made.groupBy("__part", *by).agg(F.count("*").alias("__n"), *total)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(f"__c_{k}").over(earlier), F.lit(0)).alias(f"__c_{k}") for k in sums], *[F.last(f"__c_{k}", ignorenulls=True).over(earlier).alias(f"__c_{k}") for k in lasts])
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    both = made.withColumns(local).join(carried, same)
    out = {k: F.col(f"__l_{k}") + F.col(f"__c_{k}") for k in sums} | {k: F.coalesce(f"__l_{k}", f"__c_{k}") for k in lasts}
    return both.withColumns(out).select(*parted.columns, *out)


def ahead(parted: DataFrame, reach: int) -> DataFrame:
    """The rows of ``parted``, and with each range the first ``reach`` rows behind it (__ahead true, __pos going on), so that a range sees over its end."""
    ends = _totals(parted)
    first = parted.where(F.col("__pos") < reach).join(ends.drop("__n"), "__part").withColumn("__row", F.col("__before") + F.col("__pos"))
    first = first.drop("__part", "__pos", "__before").withColumn("__d", F.explode(F.array(*[F.lit(i).cast("long") for i in range(reach)]))).withColumn("__end", F.col("__row") - F.col("__d"))
    to = ends.select("__part", (F.col("__before") + F.col("__n")).alias("__end"), "__n")
    seen = first.join(to, "__end").withColumn("__pos", F.col("__n") + F.col("__d"))
    return parted.withColumn("__ahead", F.lit(False)).unionByName(seen.withColumn("__ahead", F.lit(True)).select(*parted.columns, "__ahead"))


class Steps:
    """A function of an integer by pieces: from each of ``lows`` on it is the argument times ``slope`` plus an offset, with slope 0 or 1."""

    def __init__(self, lows: list[int], offsets: list[int], slope: int, none: int | None):
        self.lows, self.offsets, self.slope, self.none = lows, offsets, slope, none

    def __call__(self, x: int | None) -> int | None:
        if x is None:
            return self.none
        return self.slope * x + self.offsets[max(0, bisect_right(self.lows, x) - 1)]

    def dump(self) -> str:
        return json.dumps([self.lows, self.offsets, self.slope, self.none])


class Machine:
    """A sequential computation over the rows of a group; its state is an integer or None, which is where a group starts.

    ``run(rows, state)`` gives outputs and the state behind them. ``open(rows)`` gives how many leading rows depend on the state before,
    the outputs of the others, and the state behind all rows as ``Steps`` of the state before. Rows are frames of one group in order.
    """

    def run(self, rows: pd.DataFrame, state: int | None) -> tuple[list, int | None]:
        raise NotImplementedError

    def open(self, rows: pd.DataFrame) -> tuple[int, list, Steps]:
        raise NotImplementedError


def _segments(rows: pd.DataFrame, by: list[str]) -> Iterable[tuple[str, int, int]]:
    """(key, first, end) of the groups of a range."""
    keys = [json.dumps([None if pd.isna(x) else str(x) for x in t]) for t in rows[by].itertuples(index=False)] if by else [""] * len(rows)
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield keys[first], first, i
            first = i


def fold(parted: DataFrame, by: list[str], machine: Callable[[pd.DataFrame], Machine], output: str, kind: T.DataType, side: DataFrame | None = None, reach: int = 0) -> DataFrame:
    """The rows of ``parted`` (without those that ``ahead`` adds) with the machine's output for each.

    ``machine`` is made for each range from its rows of ``side`` (the range is their __of), if there is one, else from its own rows, of which no step needs more than the ``reach`` next
    ones. Only a range's first group can go on from the range before; its leading rows that depend on that are computed once the carried states are known, all others at once.
    """
    plain = [c for c in parted.columns if c != "__ahead"]
    given = [f for f in parted.schema.fields if f.name != "__ahead"]
    schema = T.StructType([*given, T.StructField(output, kind), T.StructField("__open", T.BooleanType()), T.StructField("__sum", T.StringType())])

    def make(rows: pd.DataFrame, extra: pd.DataFrame | None) -> tuple[pd.DataFrame, Machine]:
        rows = rows.sort_values("__pos", kind="stable").reset_index(drop=True)
        m = machine(rows if extra is None else extra)
        if "__ahead" in rows:
            rows = rows[~rows["__ahead"].astype(bool)].drop(columns="__ahead").reset_index(drop=True)
        return rows, m

    def first(rows: pd.DataFrame, extra: pd.DataFrame | None = None) -> pd.DataFrame:
        rows, m = make(rows, extra)
        if rows.empty:
            return rows.assign(**{output: None, "__open": False, "__sum": None})
        out: list = [None] * len(rows)
        told, opened, end, steps = None, 0, None, None
        for key, a, b in _segments(rows, by):
            if a == 0 and rows["__part"].iloc[0] > 0:
                opened, known, steps = m.open(rows.iloc[a:b])
                out[opened:b], told = known, [key, key, steps.dump(), None]
            else:
                out[a:b], end = m.run(rows.iloc[a:b], None)
                told = [told[0] if told else key, key, None if a or steps is None else steps.dump(), end]
        # [first key, last key, steps of the first group if it is also the last, else null, the end's state otherwise]
        sums = [json.dumps(told)] + [None] * (len(rows) - 1)
        return rows.assign(**{output: pd.Series(out, dtype=object), "__open": [i < opened for i in range(len(rows))], "__sum": sums})

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        last, state, out = None, None, []
        for p, s in rows.sort_values("__part")[["__part", "__sum"]].itertuples(index=False):
            head, tail, steps, end = json.loads(s)
            start = state if head == last else None
            out.append((p, start))
            state = Steps(*json.loads(steps))(start) if steps else end
            last = tail
        return pd.DataFrame(out, columns=["__part", "__start"]).astype({"__start": "Int64"})

    def again(rows: pd.DataFrame, extra: pd.DataFrame | None = None) -> pd.DataFrame:
        start = rows["__start"].iloc[0] if len(rows) else None
        start = None if start is None or pd.isna(start) else int(start)
        rows, m = make(rows, extra)
        if rows.empty:
            return rows[plain].assign(**{output: None})
        return rows[plain].assign(**{output: pd.Series(m.run(rows, start)[0], dtype=object)})

    deal = lambda df, f, s: df.groupBy("__part").applyInPandas(lambda x: f(x), s) if side is None else df.groupBy("__part").cogroup(side.groupBy("__of")).applyInPandas(f, s)
    done = written(deal(parted, first, schema))
    starts = done.where("__sum is not null").select("__part", "__sum", F.lit(0).alias("__all")).groupBy("__all").applyInPandas(carried, "__part int, __start long")  # one row a range
    closed = done.where("not __open").select(*plain, output)
    opened = done.where("__open").groupBy("__part").agg((F.max("__pos") + 1).alias("__n")).join(starts, "__part")
    late = parted.join(opened, "__part").where(F.col("__pos") < F.col("__n") + reach).withColumn("__ahead", F.col("__pos") >= F.col("__n")).drop("__n")
    return closed.union(deal(late, again, T.StructType([*given, T.StructField(output, kind)])))


class Repair(Machine):
    """Numbers that are null, 0, negative or above ``highest`` are repaired from the repaired previous number and the next usable one among the ``reach`` rows behind."""

    def __init__(self, rows: pd.DataFrame, by: list[str], number: str, highest: int, next_highest: int, reach: int):
        self.number, self.highest = number, highest
        self.next: dict[int, int] = {}
        for _, a, b in _segments(rows, by):
            value = rows[number].iloc[a:b].fillna(0).astype("int64").tolist()
            place = rows["__pos"].iloc[a:b].tolist()
            usable, at = None, None  # the nearest usable number behind, and its place
            for i in range(b - a - 1, -1, -1):
                if at is not None and at - i <= reach:
                    self.next[place[i]] = usable
                if 0 < value[i] <= next_highest:
                    usable, at = value[i], i

    def _values(self, rows: pd.DataFrame) -> list[tuple[int, int | None]]:
        return [(v, self.next.get(p)) for v, p in zip(rows[self.number].fillna(0).astype("int64").tolist(), rows["__pos"].tolist(), strict=True)]

    def _good(self, v: int) -> bool:
        return 0 < v <= self.highest

    def run(self, rows: pd.DataFrame, state: int | None) -> tuple[list, int | None]:
        out = []
        for v, behind in self._values(rows):
            if not self._good(v):
                if state is not None:
                    v = state if behind == state + 1 else state + 1
                elif behind is not None:
                    v = max(1, behind - 1)
            out.append(v)
            state = v
        return out, state

    def open(self, rows: pd.DataFrame) -> tuple[int, list, Steps]:
        values = self._values(rows)
        k = next((i for i, (v, _) in enumerate(values) if self._good(v)), len(values))
        rest, end = self.run(rows.iloc[k:], None)
        if k < len(values):
            return k, rest, Steps([0], [end], 0, end)
        # All rows are open: each adds one, but where the next number is just behind.
        lows, offsets = [-(1 << 62)], [0]
        for _, behind in values:
            new_lows, new_offsets = [], []
            for i, (low, off) in enumerate(zip(lows, offsets, strict=True)):
                top = lows[i + 1] if i + 1 < len(lows) else 1 << 62
                stop = None if behind is None else behind - 1 - off
                pieces = [(low, off + 1)]
                if stop is not None and low <= stop < top:
                    pieces = [(low, off + 1)] * (stop > low) + [(stop, off)] + [(stop + 1, off + 1)] * (stop + 1 < top)
                for x, o in pieces:
                    if not new_offsets or new_offsets[-1] != o:
                        new_lows.append(x)
                        new_offsets.append(o)
            lows, offsets = new_lows, new_offsets
        return k, [], Steps(lows, offsets, 1, self.run(rows, None)[1])


# The greatest number of an entry, and the greatest that a number behind may have.
HIGHEST, NEXT_HIGHEST, REACH = 15617, 16500, 9


def repair_numbers(df: DataFrame, by: list[str], order: list[str], number: str, highest: int = HIGHEST, next_highest: int = NEXT_HIGHEST, reach: int = REACH, rows: int = ROWS) -> DataFrame:
    """Repairs 0 and too large numbers from the repaired previous and the next usable one (W5), each repair feeding the next, over groups of any size.

    With both neighbours it is previous + 1, or previous itself where the next is just that; with one neighbour it is one step from it.
    """
    p = ahead(parts(df, by, order, rows), reach)
    return fold(p, by, lambda x: Repair(x, by, number, highest, next_highest, reach), "repaired", T.LongType(), reach=reach).drop("__part", "__pos")


class Forward(Machine):
    """Each wanted key takes the first place of its key behind the last match, else the first at all; a key without places leaves the state."""

    def __init__(self, places: pd.DataFrame, by: list[str], key: str, place: str):
        self.by, self.key = by, key
        self.at: dict[tuple, list[int]] = {}
        for *k, p in places[[*by, key, place]].itertuples(index=False):
            self.at.setdefault(tuple(k), []).append(int(p))
        for v in self.at.values():
            v.sort()

    def _lists(self, rows: pd.DataFrame) -> list[list[int]]:
        return [self.at.get(tuple(k), []) for k in rows[[*self.by, self.key]].itertuples(index=False)]

    @staticmethod
    def _after(found: list[int], state: int | None) -> int:
        i = 0 if state is None else bisect_right(found, state)
        return found[i] if i < len(found) else found[0]

    def run(self, rows: pd.DataFrame, state: int | None) -> tuple[list, int | None]:
        out = []
        for found in self._lists(rows):
            state = self._after(found, state) if found else state
            out.append(state if found else None)
        return out, state

    def open(self, rows: pd.DataFrame) -> tuple[int, list, Steps]:
        lists = self._lists(rows)
        low = -(1 << 62)
        steps: Steps | None = None  # of all rows so far; None while the state is untouched
        for i, found in enumerate(lists):
            if not found:
                continue
            if steps is None:
                steps = Steps([low, *found], [self._after(found, x) for x in [low, *found]], 0, found[0])
            else:
                steps.offsets, steps.none = [self._after(found, x) for x in steps.offsets], self._after(found, steps.none)
            kept = [j for j in range(len(steps.lows)) if not j or steps.offsets[j] != steps.offsets[j - 1]]
            steps.lows, steps.offsets = [steps.lows[j] for j in kept], [steps.offsets[j] for j in kept]
            if len(kept) == 1 and steps.none == steps.offsets[0]:  # whatever came before
                rest, end = self.run(rows.iloc[i + 1 :], steps.none)
                return i + 1, rest, Steps([low], [end], 0, end)
        return len(lists), [], steps or Steps([low], [0], 1, None)


def monotone_match(wanted: DataFrame, headers: DataFrame, by: str, order: str, key: str, place: str, rows: int = ROWS) -> DataFrame:
    """(by, order, place): each wanted key takes the first header of its key behind the last match of its group, else the first at all (X25), over groups of any size.

    With a range go the places of the keys that it wants; ``place`` is an integer.
    """
    p = parts(wanted.select(by, order, key), [by], [order], rows)
    heads = headers.select(F.col(by).alias("__by"), F.col(key).alias("__key"), place)
    side = p.select("__part", by, key).distinct().join(heads, F.col(by).eqNullSafe(F.col("__by")) & (F.col(key) == F.col("__key"))).select("__part", "__by", "__key", place).toDF("__of", by, key, place)
    found = fold(p, [by], lambda x: Forward(x, [by], key, place), place, T.LongType(), side)
    out = found.where(F.col(place).isNotNull())
    return out.select(by, order, F.col(place).cast(headers.schema[place].dataType).alias(place))


def assemble(lines: DataFrame, file: str, line_no: str, text: str, header: Column, stop: Column | None = None, rows: int = ROWS) -> DataFrame:
    """Entries of line streams (X4): a header starts one, following lines belong to it, a stop line ends it. (file, entry, n_lines, text).

    Files may be of any length: header counts and whether a stop came last are carried over ranges of lines; only the lines of one entry come together.
    """
    flags = {"__h": F.coalesce(header, F.lit(False)), "__s": F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(False)}
    p = parts(lines.withColumns(flags).select(file, line_no, text, "__h", "__s"), [file], [line_no], rows)
    # A header without stop opens, a stop closes, other lines leave things as they are.
    event = F.when(F.col("__s"), 0).when(F.col("__h"), 1)
    state = running(p, [file], {"__heads": F.col("__h").cast("long")}, {"__was": event})
    entry = F.col("__heads") + F.col("__h").cast("long")
    live = state.withColumn("entry", entry).where(F.col("entry") > 0).where(F.coalesce(event, F.col("__was")) == 1)
    texts = F.array_sort(F.collect_list(F.struct(line_no, text)))
    return live.groupBy(file, "entry").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(texts, lambda x: x[text]), "\n").alias("text"))
