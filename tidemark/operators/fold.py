"""Guarded apply of ordered mutations to a keyed table.

Per key, in ``seq`` order, against the row held for the key (``lm``, ``ev`` are its
last-modified and last-event times):

* DELETE removes the row if its ``ev`` is null or not after the event's;
* a mutation with target fields replaces those fields and both times when the row's
  ``lm`` or the event's is null, or the row's is not after the event's;
* otherwise CREATE/UNDELETE inserts an absent key, and on a newer row only raises
  ``lm``/``ev`` to the later of both sides (null counts as 1970);
* CREATE/UNDELETE without target fields inserts a bare key, if absent;
* everything else changes nothing.

Keys with a bounded number of events are folded inside one array expression, so the
events are shuffled once; where a batch neither deletes nor misses a time, by a running maximum
instead (``tidemark.operators.plain_fold``). The events of larger keys are cut into runs and
folded in parallel (``tidemark.operators.hot_fold``). All give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import CREATE_LIKE, KEY, LAST_EVENT, LAST_MODIFIED, pinned
from tidemark.operators.plain_fold import fold_plain, is_plain
from tidemark.operators.skew import GROUP_LIMIT, SEGMENT_ROWS, on_keys, split_and_test
from tidemark.session import cut_lineage

#: What the control fold needs to know about a mutation.
DELETE, UPDATE, CREATE, BARE_CREATE, NOTHING = range(5)

COUNTERS = ("inserted", "updated", "deleted", "stale", "ignored")

#: Columns of a mutation beside the key; ``vals`` is a struct with one field per column.
MUTATION_COLUMNS = ("seq", "change_type", "lm", "ev", "target_fields", "vals")


def value_columns(mutations: DataFrame) -> list[T.StructField]:
    return list(mutations.schema["vals"].dataType.fields)


def kind(change_type: Column, target_fields: Column) -> Column:
    targeted = F.coalesce(F.size(target_fields), F.lit(0)) > 0
    create = change_type.isin(*CREATE_LIKE)
    return (
        F.when(change_type == "DELETE", DELETE)
        .when(create & targeted, CREATE)
        .when(create, BARE_CREATE)
        .when(targeted, UPDATE)
        .otherwise(NOTHING)
    )


def _touched(fields: list[T.StructField]) -> Column:
    """One ``struct<v>`` per column, null when the mutation does not target it.

    The wrapper keeps "set to null" apart from "not touched".
    """
    return F.struct(
        *[
            F.when(
                F.array_contains("target_fields", f.name), F.struct(F.col("vals")[f.name].alias("v"))
            ).alias(f.name)
            for f in fields
        ]
    )


def _wrapped_type(fields: list[T.StructField]) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, T.StructType([T.StructField("v", f.dataType)])) for f in fields]
    )


def prepare(mutations: DataFrame, key: str) -> DataFrame:
    """Mutations in the narrow form both folds read: key, seq, kind, lm, ev, set."""
    fields = value_columns(mutations)
    return mutations.select(
        key,
        "seq",
        kind(F.col("change_type"), F.col("target_fields")).alias("kind"),
        F.col("lm").cast("timestamp").alias("lm"),
        F.col("ev").cast("timestamp").alias("ev"),
        _touched(fields).alias("set"),
    )


def _fold_array(events: Column, present: Column, lm: Column, ev: Column, fields) -> Column:
    untouched = F.lit(None).cast(_wrapped_type(fields))
    # A null struct would hide "no field touched": start from a struct of null wrappers.
    untouched = F.struct(*[untouched[f.name].alias(f.name) for f in fields])
    epoch = F.timestamp_micros(F.lit(0))
    no_time = F.lit(None).cast("timestamp")

    def state(s, present, lm, ev, reset, vals, counted):
        return F.struct(
            present.alias("present"),
            lm.alias("lm"),
            ev.alias("ev"),
            reset.alias("reset"),
            vals.alias("vals"),
            *[(s[c] + 1 if c == counted else s[c]).alias(c) for c in COUNTERS],
        )

    def merged(s, e):
        return F.struct(
            *[
                F.coalesce(e["set"][f.name], s["vals"][f.name]).alias(f.name)
                for f in fields
            ]
        )

    def step(s: Column, e: Column) -> Column:
        k, true, false = e["kind"], F.lit(True), F.lit(False)
        fresh = e["lm"].isNull() | s["lm"].isNull() | (s["lm"] <= e["lm"])
        deletable = s["present"] & (s["ev"].isNull() | (s["ev"] <= e["ev"]))
        later = F.greatest(F.coalesce(s["ev"], epoch), F.coalesce(e["ev"], epoch))
        kept = state(s, s["present"], s["lm"], s["ev"], s["reset"], s["vals"], "ignored")
        return (
            F.when(
                (k == DELETE) & deletable,
                state(s, false, no_time, no_time, true, untouched, "deleted"),
            )
            .when(k.isin(DELETE, NOTHING), kept)
            .when(
                (k == BARE_CREATE) & ~s["present"],
                state(s, true, no_time, no_time, true, untouched, "inserted"),
            )
            .when(
                k.isin(UPDATE, CREATE) & s["present"] & fresh,
                state(s, true, e["lm"], e["ev"], s["reset"], merged(s, e), "updated"),
            )
            .when(
                (k == CREATE) & ~s["present"],
                state(s, true, e["lm"], e["ev"], true, e["set"], "inserted"),
            )
            .when(
                k == CREATE,
                state(s, true, s["lm"], later, s["reset"], s["vals"], "stale"),
            )
            .otherwise(kept)
        )

    start = F.struct(
        present.alias("present"),
        lm.alias("lm"),
        ev.alias("ev"),
        F.lit(False).alias("reset"),
        untouched.alias("vals"),
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS],
    )
    return F.aggregate(events, start, step)


def empty_target(mutations: DataFrame, key: str) -> DataFrame:
    """A target without rows that has the columns the mutations write."""
    schema = T.StructType(
        [
            T.StructField(key, mutations.schema[key].dataType),
            *[T.StructField(f.name, f.dataType) for f in value_columns(mutations)],
            T.StructField(LAST_MODIFIED, T.TimestampType()),
            T.StructField(LAST_EVENT, T.TimestampType()),
        ]
    )
    return mutations.sparkSession.createDataFrame([], schema)


def fold(
    mutations: DataFrame,
    target: DataFrame | None = None,
    key: str = KEY,
    limit: int = GROUP_LIMIT,
    segment_rows: int = SEGMENT_ROWS,
    plain: bool | None = None,
) -> DataFrame:
    """Outcome per key that has a mutation or a stored row.

    Columns: the key, ``present``, the value columns, the two time columns and the five
    counters. ``present`` is false for a key that ends up without a row.

    ``seq`` is unique within a key. The mutations are read twice: a pass over the keys that
    counts their events, and the fold; a caller whose mutations are costly to compute
    persists them or writes them out first. ``plain`` says whether all of them set columns at
    known times, and only then may be true; by default the first pass finds out.
    """
    fields = value_columns(mutations)
    names = [f.name for f in fields]
    events = prepare(mutations.where(F.col(key).isNotNull()), key)
    fine = is_plain(F.col("kind"), F.col("lm"), UPDATE, CREATE)
    cold, hot, hot_keys, all_fine = split_and_test(events, [key], limit, fine)
    plain = all_fine if plain is None else plain
    stored = target.select(
        key,
        F.col(LAST_MODIFIED).cast("timestamp").alias("_lm"),
        F.col(LAST_EVENT).cast("timestamp").alias("_ev"),
        *[F.col(n).alias(f"_s_{n}") for n in names],
        F.lit(True).alias("_stored"),
    ) if target is not None else None

    stored_hot = None
    if stored is not None and hot is not None:
        # one row per hot key; the rest never meets the hot path
        stored_hot = cut_lineage(on_keys(stored, hot_keys, [key], "left_semi"))
        stored = on_keys(stored, hot_keys, [key], "left_anti")

    if plain:
        outcome = fold_plain(cold, stored, key, fields, CREATE)
        if hot is None:
            return outcome
        return outcome.unionByName(_finish(_hot(hot, stored_hot, key, fields, segment_rows), key, names, stored is not None))
    per_key = cold.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "lm", "ev", "set"))).alias("_events")
    )
    if stored is None:
        missing = F.lit(False), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")
        state = _fold_array(F.col("_events"), *missing, fields)
        folded = pinned(per_key.select(key, state.alias("s")))
    else:
        per_key = per_key.join(stored, key, "full_outer")
        no_events = F.array().cast(cold_type(per_key))
        state = _fold_array(
            F.coalesce("_events", no_events),
            F.coalesce("_stored", F.lit(False)),
            F.col("_lm"),
            F.col("_ev"),
            fields,
        )
        folded = pinned(per_key.select(key, state.alias("s"), *[f"_s_{n}" for n in names]))
    if hot is None:
        return _finish(folded, key, names, stored is not None)

    return _finish(folded.unionByName(_hot(hot, stored_hot, key, fields, segment_rows)), key, names, stored is not None)


def _hot(hot: DataFrame, stored_hot: DataFrame | None, key: str, fields: list[T.StructField], segment_rows: int) -> DataFrame:
    from tidemark.operators.hot_fold import fold_segments

    folded = fold_segments(hot, stored_hot, key, fields, segment_rows)
    return folded if stored_hot is None else folded.join(stored_hot.drop("_lm", "_ev", "_stored"), key, "left")


def cold_type(per_key: DataFrame) -> T.ArrayType:
    return per_key.schema["_events"].dataType


def _finish(folded: DataFrame, key: str, names: list[str], has_stored: bool) -> DataFrame:
    s = F.col("s")

    def value(n: str) -> Column:
        kept = F.when(~s["reset"], F.col(f"_s_{n}")) if has_stored else None
        touched = F.when(s["vals"][n].isNotNull(), s["vals"][n]["v"])
        return (touched.otherwise(kept) if has_stored else touched).alias(n)

    return folded.select(
        key,
        s["present"].alias("present"),
        *[value(n) for n in names],
        s["lm"].alias(LAST_MODIFIED),
        s["ev"].alias(LAST_EVENT),
        *[s[c].alias(c) for c in COUNTERS],
    )


def apply_mutations(
    mutations: DataFrame,
    target: DataFrame | None = None,
    key: str = KEY,
    limit: int = GROUP_LIMIT,
    segment_rows: int = SEGMENT_ROWS,
    plain: bool | None = None,
) -> DataFrame:
    """The target's rows after the mutations."""
    out = fold(mutations, target, key, limit, segment_rows, plain)
    return out.where("present").drop("present", *COUNTERS)


def mutation_counts(folded: DataFrame) -> DataFrame:
    """One row: how many mutations inserted, updated, deleted, were stale or ignored."""
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]
    received = F.coalesce(F.sum(sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))), F.lit(0))
    return folded.agg(*total, received.cast("bigint").alias("received"))
