"""The guarded fold for keys with more events than one task may hold.

What a run of events leaves behind seldom depends on where it began: the first accepted event
fixes the row's times, whatever came before. So the runs of a key are folded in parallel, each
from a guess of the state it is entered with, and the guesses are then held against the states
that the runs before leave:

1. cut the events, without their values, into runs of consecutive events (range partitioning)
   and collect each run as an array;
2. fold the last ``TAIL`` events of every run, from no row: what they leave is the guess that
   the next run is entered with (the key's first run is entered with the stored row);
3. fold every run from its guess, in an array expression that keeps, of the values, only the
   number of the last event that set each column;
4. a key whose every guess is what the run before leaves is done. Otherwise its runs are walked,
   one row a run: a run entered with its guess leaves what it left; one that accepts nothing
   from the state it is entered with (its thresholds tell) passes it on; any other is folded
   again, and so on until no guess is wrong;
5. fetch the values of the few events that set a column last.

The first wrong guess of a key is right after the next round, so rounds end. More than two need
runs that neither pass a state on nor forget it.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fold import BARE_CREATE, COUNTERS, CREATE, DELETE, UPDATE
from tidemark.session import cut_lineage, small_side

#: Events at the end of a run that its guess comes from.
TAIL = 512
RUN = "_run"
_STATE = "struct<present:boolean,lm:bigint,ev:bigint>"


def _state(present: Column, lm: Column, ev: Column) -> Column:
    return F.struct(present.alias("present"), lm.cast("bigint").alias("lm"), ev.cast("bigint").alias("ev"))


def _absent() -> Column:
    return _state(F.lit(False), F.lit(None), F.lit(None))


def _step(s: Column, e: Column) -> Column:
    """(state, action) after one event; an action is a place in ``COUNTERS``."""
    k, absent = e["kind"], _absent()
    inserted, updated, deleted, stale, ignored = (F.lit(i) for i in range(len(COUNTERS)))
    fresh = e["lm"].isNull() | s["lm"].isNull() | (s["lm"] <= e["lm"])
    own = _state(F.lit(True), e["lm"], e["ev"])
    raised = _state(F.lit(True), s["lm"], F.greatest(F.coalesce(s["ev"], F.lit(0)), F.coalesce(e["ev"], F.lit(0))))

    def out(state: Column, action: Column) -> Column:
        return F.struct(state.alias("state"), action.alias("action"))

    return (
        F.when(s["present"] & (k == DELETE) & (s["ev"].isNull() | (s["ev"] <= e["ev"])), out(absent, deleted))
        .when(s["present"] & k.isin(UPDATE, CREATE) & fresh, out(own, updated))
        .when(s["present"] & (k == CREATE), out(raised, stale))
        .when(~s["present"] & (k == CREATE), out(own, inserted))
        .when(~s["present"] & (k == BARE_CREATE), out(_state(F.lit(True), F.lit(None), F.lit(None)), inserted))
        .otherwise(out(s, ignored))
    )


def _folded(events: Column, entry: Column, columns: int) -> Column:
    """What a run leaves: ``state``, the counters, ``since`` (last insert or delete), ``q0..`` (last setters)."""
    none = F.lit(None).cast("bigint")
    start = F.struct(
        entry.alias("state"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS], none.alias("since"), *[none.alias(f"q{i}") for i in range(columns)]
    )

    def step(s: Column, e: Column) -> Column:
        def merged(x: Column) -> Column:
            a = x["action"]
            wrote = a.isin(0, 1)
            return F.struct(
                x["state"].alias("state"),
                *[(s[c] + F.when(a == i, 1).otherwise(0)).alias(c) for i, c in enumerate(COUNTERS)],
                F.when(a.isin(0, 2), e["seq"]).otherwise(s["since"]).alias("since"),
                *[F.when(wrote & F.get(e["touched"], F.lit(i)), e["seq"]).otherwise(s[f"q{i}"]).alias(f"q{i}") for i in range(columns)],
            )

        # One element, so that the step is computed once and then read by every field.
        return F.element_at(F.transform(F.array(_step(s["state"], e)), merged), 1)

    return F.aggregate(events, start, step)


def _left(events: Column) -> Column:
    """The state that events leave which begin without a row."""
    return F.aggregate(events, _absent(), lambda s, e: _step(s, e)["state"])


def runs_of(events: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, run, events, figures): consecutive events of a key, with what decides on a state they pass on."""
    names = events.schema["set"].dataType.names
    control = events.select(
        F.col(key).alias("key"), "seq", "kind", F.unix_micros("lm").alias("lm"), F.unix_micros("ev").alias("ev"),
        F.array(*[F.col("set")[n].isNotNull() for n in names]).alias("touched"),
    )
    parts = max(1, math.ceil(events.count() / rows))
    # Written with the number of its run, which comes from sampled bounds.
    cut = cut_lineage(control.repartitionByRange(parts, "key", "seq").withColumn(RUN, F.spark_partition_id()))
    kind, writes = F.col("kind"), F.col("kind").isin(UPDATE, CREATE)
    runs = cut.groupBy("key", RUN).agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "lm", "ev", "touched"))).alias("events"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(kind == CREATE).alias("creates"),
        F.count_if(kind.isin(CREATE, BARE_CREATE)).alias("inserts"),
        F.max(F.when(writes, F.coalesce("lm", F.lit((1 << 63) - 1)))).alias("top_lm"),
        F.max(F.when(kind == DELETE, F.coalesce("ev", F.lit(-(1 << 63))))).alias("top_delete"),
        F.max(F.when(kind == CREATE, F.coalesce("ev", F.lit(0)))).alias("top_create"),
    )
    tail = F.when(F.size("events") > TAIL, F.slice("events", -TAIL, TAIL)).otherwise(F.col("events"))
    return cut_lineage(runs.withColumn("guess", _left(tail)))


def _beyond(time: int | None, top: int | None) -> bool:
    """Whether no event up to ``top`` (None: there is none) is accepted by a row of this time."""
    return top is None or (time is not None and time > top)


def _walk(table: pa.Table) -> pa.Table:
    """Per run of one key the state it is entered with and how it was dealt with."""
    rows = sorted(table.to_pylist(), key=lambda r: r[RUN])
    state, out = rows[0]["start"], []
    for r in rows:
        entry = state
        if entry == r["entry"]:
            how, state = "folded", r["state"]
        elif not entry["present"] and not r["inserts"]:
            how = "passed"
        elif entry["present"] and _beyond(entry["lm"], r["top_lm"]) and _beyond(entry["ev"], r["top_delete"]):
            how = "passed"
            if r["creates"]:
                state = {**entry, "ev": max(entry["ev"] or 0, r["top_create"])}
        else:
            how, state = "again", r["state"]
        out.append((r["key"], r[RUN], entry, how, state))
    kind = pa.struct([("present", pa.bool_()), ("lm", pa.int64()), ("ev", pa.int64())])
    types = [table.schema.field("key").type, pa.int32(), kind, pa.string(), kind]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("key", RUN, "entry", "how", "left"), zip(*out, strict=True), types, strict=True)})


def folded_runs(runs: DataFrame, stored: DataFrame | None, key: str, columns: int) -> DataFrame:
    """Per run what it did to the row it is entered with (``state``, counters, ``since``, ``q0..``)."""
    in_key = Window.partitionBy("key").orderBy(RUN)
    heads = runs.select("key", RUN, "guess")
    if stored is None:
        heads = heads.withColumn("start", _absent())
    else:
        start = _state(F.lit(True), F.unix_micros("_lm"), F.unix_micros("_ev"))
        first = small_side(stored.select(F.col(key).alias("key"), start.alias("start")), stored.count())
        heads = heads.join(first, "key", "left").withColumn("start", F.coalesce("start", _absent()))
    todo = heads.select("key", RUN, "start", F.coalesce(F.lag("guess").over(in_key), F.col("start")).alias("entry"))
    done = None
    while True:
        found = runs.drop("guess").join(todo, ["key", RUN]).withColumn("x", _folded(F.col("events"), F.col("entry"), columns))
        new = cut_lineage(found.drop("events").select("*", "x.*").drop("x"))
        done = new if done is None else cut_lineage(done.join(new, ["key", RUN], "left_anti").unionByName(new))
        met = F.coalesce(F.lag("state").over(in_key), F.col("start"))
        wrong = done.select("key", met.alias("met"), "entry").where(~F.col("met").eqNullSafe(F.col("entry"))).select("key").distinct()
        if wrong.isEmpty():
            return done
        key_type = done.schema["key"].dataType.simpleString()
        narrow = done.join(wrong, "key", "left_semi").select("key", RUN, "start", "entry", "state", "inserts", "creates", "top_lm", "top_delete", "top_create")
        walked = cut_lineage(narrow.groupBy("key").applyInArrow(_walk, f"key {key_type}, {RUN} int, entry {_STATE}, how string, left {_STATE}"))
        again = walked.where("how = 'again'")
        if again.isEmpty():
            return _with_passed(done, walked, columns)
        # A key's later guesses follow the walk; they are held against the outcome in the next round.
        todo = again.select("key", RUN, "entry").join(done.select("key", RUN, "start"), ["key", RUN])


def _with_passed(done: DataFrame, walked: DataFrame, columns: int) -> DataFrame:
    """The runs of walked keys that passed a state on, in place of what they did to their guess."""
    passed = walked.where("how = 'passed'").select("key", RUN, F.col("entry").alias("_entry"), F.col("left").alias("_left"))
    both = done.join(passed, ["key", RUN], "left")
    on = F.col("_entry").isNotNull()
    stale = F.when(F.col("_entry.present"), F.col("creates")).otherwise(0)
    as_passed = {c: F.lit(0).cast("bigint") for c in COUNTERS} | {"stale": stale.cast("bigint"), "ignored": (F.col("n") - stale).cast("bigint")}
    as_passed |= {c: F.lit(None).cast("bigint") for c in ("since", *[f"q{i}" for i in range(columns)])} | {"state": F.col("_left")}
    return both.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in as_passed.items()}).drop("_entry", "_left")


def fold_segments(
    events: DataFrame, stored: DataFrame | None, key: str, fields, segment_rows: int
) -> DataFrame:
    """(key, s): the same state column as the array fold gives for smaller keys."""
    events = cut_lineage(events)
    done = folded_runs(runs_of(events, key, segment_rows), stored, key, len(fields))
    setters = [f"q{i}" for i in range(len(fields))]
    per_key = cut_lineage(
        done.groupBy("key").agg(
            F.max_by("state", RUN).alias("state"), F.max("since").alias("since"),
            *[F.sum(c).cast("bigint").alias(c) for c in COUNTERS], *[F.max(q).alias(q) for q in setters],
        )
    )
    # A column set only before the last insert or delete counts as untouched.
    written = [F.when(F.col("since").isNull() | (F.col(q) >= F.col("since")), F.col(q)).alias(q) for q in setters]
    wanted = per_key.select("key", *written)
    rows = events.select(F.col(key).alias("key"), "seq", "set").join(small_side(wanted, per_key.count()), "key")
    rows = rows.where(F.array_contains(F.array(*setters), F.col("seq")))
    last = rows.groupBy("key").agg(
        *[F.max_by(F.col("set")[f.name], F.when(F.col("seq") == F.col(q), F.col("seq"))).alias(f"_v{i}") for i, (f, q) in enumerate(zip(fields, setters, strict=True))]
    )
    # One row per hot key, read by two branches of the plan: worth keeping.
    return cut_lineage(per_key.join(last, "key", "left").select(
        F.col("key").alias(key),
        F.struct(
            F.col("state.present").alias("present"),
            F.timestamp_micros("state.lm").alias("lm"),
            F.timestamp_micros("state.ev").alias("ev"),
            F.col("since").isNotNull().alias("reset"),
            F.struct(*[F.col(f"_v{i}").alias(f.name) for i, f in enumerate(fields)]).alias("vals"),
            *COUNTERS,
        ).alias("s"),
    ))
