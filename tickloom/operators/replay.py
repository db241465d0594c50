"""Replaying traces through tracker and sampling kernels.

The recurrences are not associative: an outlier decision depends on all earlier
ones, so one series is sequential. Parallelism comes from series and blocks of
configurations. A series too long for one task is cut into pieces; the state at
each cut is first sought in parallel:

1. every piece runs from a fresh start and reports its end state;
2. every piece whose assumed start differs from the end state of the piece before
   runs again from that state, ``ROUNDS`` times at most;
3. where pieces have not met by then, they run from all phases of the sampler at once
   (``starts.py``). The few states that are left at the end of a piece are the candidate
   starts of the next one, which runs from all of them: a map from start to end state. The
   maps compose, so a parallel prefix tells every piece its start, and it runs from there;
4. what has not met even so is handed on from piece to piece in one ordered pass, which
   holds one piece at a time, from the first unsettled piece of a series on.

The result is exactly the sequential one: a piece counts as settled only if its start is
the end of the piece before, to the last bit. Averages and resets forget a wrong start
within a piece, the phase is found by the maps, and what a series keeps for good (its
reference deviation, its calibrated limit) is taken from the last settled state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import kernels as K
from tickloom.operators.masks import n_of_m, n_of_m_interval
from tickloom.operators.policies import POLICIES, piece_multiple, policy_config
from tickloom.operators.starts import TAIL, ends, guesses, written_state
from tickloom.session import chunk_ticks, cut, is_small, task_count

CONFIGS_PER_TASK = 8
BATCH_ROWS = 8192  # rows of short series that leave a task together
ROUNDS = 1
MAP_ROUNDS = 3  # rounds of start maps; each goes on from the first piece whose start was among no candidates
PREFIX = 256  # pieces whose maps are composed in one group
_OUT = [
    T.StructField("config_id", T.IntegerType()),
    T.StructField("tick", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("sampled", T.BooleanType()),
    T.StructField("interval", T.IntegerType()),
    T.StructField("urgency", T.DoubleType()),
    T.StructField("__status", T.IntegerType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("alpha", T.DoubleType()),
]
Step = Callable[[list, pa.Table, object], tuple[pa.Table, object]]


class Fan:
    """How a piece runs from many starts: ``guess(key, base, settled, values before) -> {part: [state]}`` gives states
    in all phases, ``run(key, ordered rows, {part: [start]}) -> {part: {start: end}}`` the ends from written states."""

    def __init__(self, guess: Callable, run: Callable):
        self.guess, self.run = guess, run



def sequential(rows: DataFrame, by: Sequence[str], position: str, step: Step, schema: T.StructType,
               small: bool, multiple: int = 1, fan: Fan | None = None) -> DataFrame:
    """Run ``step(key, ordered rows, state) -> (result, state)`` along every key.

    ``position`` is the integer order column. Small inputs run one key per task; larger
    ones are cut into pieces of bounded length as described in the module text. ``fan`` runs a
    piece from many starts; without it there are no start maps.
    """
    by = list(by)
    if small:
        names = [f.name for f in schema]

        def whole(batches):
            # many series may have a few ticks each, so their results travel together
            results, held = [], 0
            for piece in pieces(batches, by):
                result, _ = step(list(piece.select(by).slice(0, 1).to_pylist()[0].values()), piece.sort_by(position), None)
                results, held = [*results, result.select(names)], held + result.num_rows
                if held >= BATCH_ROWS:
                    yield from pa.concat_tables(results).combine_chunks().to_batches()
                    results, held = [], 0
            if results:
                yield from pa.concat_tables(results).combine_chunks().to_batches()

        return rows.repartition(task_count(rows), *by).sortWithinPartitions(*by).mapInArrow(whole, schema)

    size = -(-chunk_ticks(rows.sparkSession) // multiple) * multiple
    keys = by + ["__piece"]
    rows = cut(rows.withColumn("__piece", F.floor(F.col(position) / F.lit(size))))
    state_schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField(n, T.StringType()) for n in ("start", "end", "tail")])

    def begin(right):
        start = right.column("start")[0].as_py() if right.num_rows else None
        return start, None if start is None else json.loads(start)

    def states(key, left, right):
        """End state of one piece, from the start state in ``right`` (none = fresh)."""
        start, state = begin(right)
        left = left.sort_by(position)
        _, end = step([k.as_py() for k in key][:-1], left, state)
        kinds = [(k, left.schema.field(k).type) for k in keys]
        data = {k: [v.as_py()] for k, v in zip(keys, key)}
        data["start"], data["end"] = [start], [json.dumps(end, sort_keys=True)]
        data["tail"] = [json.dumps(left.column("value").slice(max(0, left.num_rows - TAIL)).to_pylist()) if fan else None]
        return pa.table(data, schema=pa.schema(kinds + [(n, pa.string()) for n in ("start", "end", "tail")]))

    def emit(key, left, right):
        return step([k.as_py() for k in key][:-1], left.sort_by(position), begin(right)[1])[0]

    grouped = lambda df: df.groupBy(*keys)
    empty = rows.sparkSession.createDataFrame([], T.StructType(
        [rows.schema[k] for k in keys] + [T.StructField("start", T.StringType())]))
    known = cut(grouped(rows).cogroup(grouped(empty)).applyInArrow(states, state_schema))

    def unsettled(known: DataFrame) -> DataFrame:
        """Pieces that did not start from the end of the piece before (the nearest earlier one; a key need
        not have rows in every piece), with that end as ``start``."""
        order = Window.partitionBy(*by).orderBy("__piece")
        return cut(
            known.withColumn("held", F.col("start")).withColumn("start", F.lag("end").over(order))
            .where(~F.col("start").eqNullSafe(F.col("held"))).select(*keys, "start"))

    def rerun(known: DataFrame, starts: DataFrame) -> DataFrame:
        """``known`` after the pieces of ``starts`` ran from there."""
        again = rows.join(starts.select(*keys), keys, "left_semi")
        fresh = grouped(again).cogroup(grouped(starts)).applyInArrow(states, state_schema)
        return cut(known.join(starts.select(*keys), keys, "left_anti").unionByName(fresh))

    stale = unsettled(known)
    for _ in range(ROUNDS):
        if not stale.isEmpty():
            known = rerun(known, stale)
            stale = unsettled(known)
    for _ in range(MAP_ROUNDS if fan else 0):
        if not stale.isEmpty():
            known = rerun(known, mapped_starts(rows, known, stale, by, position, fan))
            stale = unsettled(known)
    # Series whose pieces did not meet are handed on from piece to piece in one ordered pass, from the first
    # stale piece on (its start is known: every piece before it is settled).
    name = lambda frame: frame.select(*[F.col(k).alias(f"__f{i}") for i, k in enumerate(by)], *[
        c for c in frame.columns if c.startswith("__from")])
    first = name(stale.groupBy(*by).agg(F.min("__piece").alias("__from_piece"), F.min_by("start", "__piece").alias("__from_start")))
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__f{i}"))
    marks = [f"__f{i}" for i in range(len(by))] + ["__from_piece", "__from_start"]
    late = F.col("__from_piece").isNotNull() & (F.col("__piece") >= F.col("__from_piece"))
    settled = rows.join(first, same, "left").where(~late).drop(*marks)
    rest = rows.join(first, same).where(late).drop("__from_piece", *[f"__f{i}" for i in range(len(by))])
    ordered = rest.repartition(*by).sortWithinPartitions(*by, "__piece", position)

    def hand_on(batches):
        series, state = None, None
        for piece in pieces(batches, keys):
            row = piece.slice(0, 1).to_pylist()[0]
            here = [row[k] for k in by]
            if here != series:
                series, state = here, None if row["__from_start"] is None else json.loads(row["__from_start"])
            result, state = step(here, piece.drop_columns(["__from_start"]), state)
            yield from result.to_batches()

    early = grouped(settled).cogroup(grouped(known.select(*keys, "start"))).applyInArrow(emit, schema)
    if stale.isEmpty():
        return early
    return early.unionByName(ordered.mapInArrow(hand_on, schema))


def mapped_starts(rows: DataFrame, known: DataFrame, stale: DataFrame, by: list[str], position: str, fan: Fan) -> DataFrame:
    """(keys, start) of the pieces from the first unsettled one of every series on, as far as start maps tell them."""
    keys, series = by + ["__piece"], [*by, "part"]
    order = Window.partitionBy(*by).orderBy("__piece")
    first = stale.groupBy(*by).agg(F.min("__piece").alias("__from"), F.min_by("start", "__piece").alias("settled"))
    bases = (known.withColumn("base", F.lag("end").over(order)).withColumn("before", F.lag("tail").over(order))
             .withColumn("following", F.lead("__piece").over(order)).join(first, by).where(F.col("__piece") >= F.col("__from"))
             .withColumn("base", F.when(F.col("__piece") == F.col("__from"), F.col("settled")).otherwise(F.col("base")))
             .select(*keys, "__from", "settled", "base", "before", "following"))
    bases = cut(bases)
    typed = lambda names, *texts: T.StructType(
        [rows.schema[k] for k in names] + [T.StructField(n, T.StringType()) for n in texts])
    wanted = rows.join(bases.select(*keys), keys, "left_semi")

    def table_of(left, key, names, found):
        columns = {k: pa.array([v] * len(found), left.schema.field(k).type) for k, v in zip(keys, key)}
        return pa.table(columns | {n: pa.array([f[i] for f in found], pa.string()) for i, n in enumerate(names)})

    def candidates(key, left, right):
        """The states at the end of a piece that its phases lead to."""
        held = [v.as_py() for v in key]
        base, settled, before = (json.loads(right.column(c)[0].as_py()) for c in ("base", "settled", "before"))
        starts = {part: list(map(written_state, states)) for part, states in fan.guess(held[:-1], base, settled, before).items()}
        found = fan.run(held[:-1], left.sort_by(position), starts)
        return table_of(left, held, ("part", "start"), sorted({(part, end) for part, m in found.items() for end in m.values()}))

    likely = cut(wanted.groupBy(*keys).cogroup(bases.groupBy(*keys)).applyInArrow(candidates, typed(keys, "part", "start")))
    parts = likely.select(*series).distinct()

    def own(column):
        """The part's state in a written state of all parts."""
        def pick(batches):
            for whole, part in batches:
                yield pd.Series([written_state(json.loads(w)[p]) for w, p in zip(whole, part)], dtype=object)

        pick.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(pick, "string")(column, F.col("part"))

    begin = cut(parts.join(first, by).select(*series, F.col("__from"), own(F.col("settled")).alias("state")))
    next_piece = bases.select(*keys, "following").where("following is not null")
    starts = (likely.join(next_piece, keys).select(*by, F.col("following").alias("__piece"), "part", "start")
              .unionByName(begin.select(*by, F.col("__from").alias("__piece"), "part", F.col("state").alias("start"))))

    def run(key, left, right):
        held = [v.as_py() for v in key]
        given: dict[str, list[str]] = {}
        for part, start in zip(right.column("part").to_pylist(), right.column("start").to_pylist()):
            given.setdefault(part, []).append(start)
        found = fan.run(held[:-1], left.sort_by(position), given)
        return table_of(left, held, ("part", "start", "end"), [(p, a, b) for p, m in found.items() for a, b in m.items()])

    name = lambda state: F.md5(state)  # noqa: E731  (a wrong one would be found when the piece runs)
    maps = cut(wanted.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(run, typed(keys, "part", "start", "end"))
               .select(*keys, "part", name(F.col("start")).alias("enter"), name(F.col("end")).alias("next"), "end"))

    # One small map a piece. Groups of PREFIX pieces are composed in parallel, a scan over the groups of a series
    # gives every group its start, and the groups hand it on to their pieces.
    arrow = maps.groupBy(*keys, "part").agg(F.map_from_entries(F.collect_list(F.struct("enter", "next"))).alias("arrow"))
    arrow = cut(arrow.withColumn("group", F.floor(F.col("__piece") / PREFIX)))
    group = arrow.schema["group"]

    def steps_of(table):
        table = table.sort_by("__piece")
        return [dict(m) for m in table.column("arrow").to_pylist()], table

    def compose(table):
        steps, table = steps_of(table)
        whole = {p: p for p in steps[0]}
        for step in steps:
            whole = {p: step.get(q) for p, q in whole.items()}
        kind = pa.map_(pa.string(), pa.string())
        return table.slice(0, 1).select([*series, "group"]).append_column("whole", pa.array([list(whole.items())], kind))

    text = T.StringType()
    wholes = arrow.groupBy(*series, "group").applyInArrow(
        compose, typed(by, "part").add(group).add("whole", T.MapType(text, text)))

    def hand(left, right):
        """The start of every group of a series: one small row a group."""
        left, at = left.sort_by("group"), right.column("at")[0].as_py()
        out = []
        for whole in left.column("whole").to_pylist():
            out.append(at)
            at = dict(whole).get(at)
        return left.select([*series, "group"]).append_column("at", pa.array(out, pa.string()))

    enters = cut(wholes.groupBy(*series).cogroup(begin.select(*series, name(F.col("state")).alias("at")).groupBy(*series))
                 .applyInArrow(hand, typed(by, "part").add(group).add("at", text)))

    def walk(left, right):
        steps, left = steps_of(left)
        at, out = right.column("at")[0].as_py(), []
        for step in steps:
            out.append(at)
            at = step.get(at)
        return left.select([*keys, "part"]).append_column("enter", pa.array(out, pa.string()))

    entered = arrow.groupBy(*series, "group").cogroup(enters.groupBy(*series, "group")).applyInArrow(
        walk, typed(keys, "part", "enter"))
    found = (maps.join(entered, [*keys, "part", "enter"]).groupBy(*keys)
             .agg(F.collect_list("part").alias("parts"), F.collect_list("end").alias("ends")))

    def whole_state(parts, states):
        def build(batches):
            for names, ends_ in batches:
                yield pd.Series([written_state({p: json.loads(e) for p, e in zip(a, b)}) for a, b in zip(names, ends_)], dtype=object)

        build.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(build, "string")(parts, states)

    many = parts.groupBy(*by).agg(F.count("*").alias("many"))
    told = bases.join(found.join(many, by).where(F.size("parts") == F.col("many"))
                      .select(*keys, whole_state(F.col("parts"), F.col("ends")).alias("end")), keys, "left")
    start = F.when(F.col("__piece") == F.col("__from"), F.col("settled")).otherwise(F.lag("end").over(order))
    return cut(told.withColumn("start", start).where("start is not null").select(*keys, "start"))


def pieces(batches, keys: list[str]):
    """Tables of whole pieces from record batches sorted by ``keys``; at most one piece is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.zeros(batch.num_rows, bool)
        for k in keys:  # NULL keys are one series, as in a grouping
            column = batch.column(batch.schema.get_field_index(k))
            here, last = column.slice(1), column.slice(0, batch.num_rows - 1)
            odd = pc.coalesce(pc.not_equal(here, last), pc.xor(pc.is_null(here), pc.is_null(last)))
            marks[1:] |= odd.to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(marks).tolist(), batch.num_rows]
        ends = lambda b, i: [b.column(b.schema.get_field_index(k))[i].as_py() for k in keys]
        for a, b in zip(cuts, cuts[1:]):
            if held and (a or ends(held[-1], held[-1].num_rows - 1) != ends(batch, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _columns(key_names, key_values, config_id: int, table: pa.Table, out: K.Columns) -> pa.Table:
    n = table.num_rows
    arrays = {k: pa.array([v] * n, type=table.schema.field(k).type)
              for k, v in zip(key_names, key_values)}
    status = np.asarray(out.status, dtype=np.int32)
    number = lambda xs: pa.array(np.asarray(xs, dtype=np.float64), from_pandas=True)
    arrays.update({
        "config_id": pa.array(np.full(n, config_id, dtype=np.int32)),
        "tick": table.column("tick").combine_chunks(),
        "value": table.column("value").combine_chunks(),
        "sampled": pa.array(out.sampled, type=pa.bool_()),
        "interval": pa.array(out.interval, type=pa.int32()),
        "urgency": pa.array(out.urgency, type=pa.float64()),
        "__status": pa.array(status, mask=status < 0),
        "mean": number(out.mean),
        "std": number(out.std),
        "z_score": number(out.z),
        "alpha": number(out.alpha),
    })
    return pa.table(arrays)


def replay(
    trace: DataFrame,
    configs: Sequence[Mapping[str, object]],
    policy: str = "urgency_adaptive",
    by: Sequence[str] = ("series_id",),
    aux: Sequence[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """Replay ``trace(by…, tick, value, aux…)`` through ``policy`` for every configuration.

    Returns by…, config_id, tick, value, sampled, interval, urgency, status, mean,
    std, z_score, alpha; the last five are NULL on ticks that were not read.
    """
    by = list(by)
    configs = [policy_config(policy, dict(c)) for c in configs]
    rows = trace.select(*by, F.col("tick").cast("long"), F.col("value").cast("double"), *aux)
    blocks = [list(range(i, min(i + CONFIGS_PER_TASK, len(configs))))
              for i in range(0, len(configs), CONFIGS_PER_TASK)]
    if len(blocks) > 1:
        rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))
    else:
        rows = rows.withColumn("__block", F.lit(0))
    kernel = POLICIES[policy]

    def step(key, table, state):
        values = table.column("value").to_pylist()
        side = {a: table.column(a).to_pylist() for a in aux}
        parts, after = [], {}
        for c in blocks[key[-1]]:
            out = K.Columns()
            after[str(c)] = kernel(values, side, configs[c], (state or {}).get(str(c)), out)
            parts.append(_columns(by, key[:-1], c, table, out))
        return pa.concat_tables(parts), after

    def guess(key, base, settled, before):
        return {str(c): guesses(policy, configs[c], base[str(c)], settled[str(c)], before) for c in blocks[key[-1]]}

    def run(key, table, starts):
        values = table.column("value").to_pylist()
        side = {a: table.column(a).to_pylist() for a in aux}
        return {c: ends(kernel, values, side, configs[int(c)], given, multiple > 1) for c, given in starts.items()}

    multiple = piece_multiple(policy, configs)
    noted = trace.schema["tick"].metadata
    out = [T.StructField(f.name, f.dataType, True, noted) if f.name == "tick" else f for f in _OUT]
    schema = T.StructType([trace.schema[k] for k in by] + out)
    played = sequential(rows, [*by, "__block"], "tick", step, schema,
                        is_small(trace, by) if small is None else small,
                        multiple, Fan(guess, run))
    status = F.element_at(F.array(*[F.lit(s) for s in K.STATUS_NAMES]), F.col("__status") + 1)
    return played.select(
        *by, "config_id", "tick", "value", "sampled", "interval", "urgency",
        F.when(F.col("__status").isNotNull(), status).alias("status"),
        "mean", "std", "z_score", "alpha")


def masked_replay(trace: DataFrame, config: Mapping[str, object], mask: str = "sampled",
                  interval: str = "interval", urgency: str | None = None,
                  by: Sequence[str] = ("series_id",), small: bool | None = None) -> DataFrame:
    """Feed the tracker only the ticks of a mask column.

    Unread ticks (mask false or NULL) change no state, so they stay out of the replay and its shuffle; they are added to
    its rows with the columns that the tracker would fill as NULL.
    """
    side = [F.col(mask).alias("mask"), F.col(interval).cast("int").alias("interval")]
    if urgency is not None:
        side.append(F.col(urgency).cast("double").alias("urgency"))
    tick = F.col("tick").cast("long").alias("tick", metadata=trace.schema["tick"].metadata)
    rows = trace.select(*by, tick, F.col("value").cast("double"), *side)
    aux = ("mask", "interval", "urgency")[: len(side)]
    read = F.coalesce(F.col("mask").cast("boolean"), F.lit(False))
    played = replay(rows.where(read), [config], "masked", by, aux, small)
    unread = rows.where(~read).select(
        *by, F.lit(0).alias("config_id"), "tick", "value", F.lit(False).alias("sampled"), "interval",
        (F.lit(1.0) / F.col("interval") if urgency is None else F.col("urgency")).alias("urgency"))
    return played.unionByName(unread, allowMissingColumns=True)


def n_of_m_replay(trace: DataFrame, config: Mapping[str, object], n: int, m: int, phase: int = 0,
                  by: Sequence[str] = ("series_id",), small: bool | None = None) -> DataFrame:
    """Balanced n-of-m sampling followed by the tracker; urgency is n / m."""
    if not (1 <= n <= m and 0 <= phase < m):
        raise ValueError(f"need 1 <= n <= m and 0 <= phase < m, got {n}, {m}, {phase}")
    rows = trace.withColumn("sampled", n_of_m(F.col("tick"), n, m, phase)).withColumn(
        "interval", F.lit(n_of_m_interval(n, m))).withColumn("urgency", F.lit(n / m))
    return masked_replay(rows, config, urgency="urgency", by=by, small=small)
