"""Interval and event operators over many logs at once.

Raw events: log_id, channel, key, velocity, tick, ordinal (arrival order), on.
Pairs: log_id, pos (file order), start, duration, key, velocity, release (NULL
when it follows the attack). Headers: log_id, ticks_per_second, loop_ticks and
measure_ticks (both may be NULL). Ticks are BIGINT.

Everything ordered goes through ``plans.scans``, so one log may hold a large
share of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cols import whole_div
from tensorloom.functions.draws import digest, uniform
from tensorloom.plans.scans import first_rows, last_known, lay_out, neighbours, row_numbers, running_total

# Key range, velocity range, tempo default and fallback grid.
FIRST_KEY, LAST_KEY = 21, 108
MAX_VELOCITY = 127
DEFAULT_MICROS = 500_000
FALLBACK_GRID = 1_000_000
LOG_GRID = 1920
# Decay of the random key and bounds of the random duration.
KEY_DECAY = 15.0
MIN_SECONDS, MAX_SECONDS = 0.1, 5.0
# Names of the twelve pitch classes.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")

# Cycles unfolded per intermediate row.
RUN = 4096

LOG = ["log_id"]
CANONICAL = ["start", "key", "velocity", "pos"]


# -- reading events ----------------------------------------------------------


def note_events(df: DataFrame, channel: int | None = None) -> DataFrame:
    """Events of the wanted channel; "on" with velocity 0 counts as "off"."""
    kept = df if channel is None else df.filter(F.col("channel") == channel)
    return kept.withColumn("on", F.col("on") & (F.col("velocity") != 0))


def pair_events(events: DataFrame, ends: DataFrame) -> DataFrame:
    """On/off pairs per (log, channel, key).

    Each "on" lasts until the next event of its key: an "off" gives the release
    velocity, another "on" closes it with release 0, and with none it stays open
    to the end of the log. An "off" with nothing open is ignored. ``ends`` has
    log_id and end_tick.
    """
    following = neighbours(
        events,
        ["log_id", "channel", "key"],
        ["tick", "ordinal"],
        {"_tick": "tick", "_on": "on", "_velocity": "velocity"},
        1,
    ).filter("on")
    return following.join(ends, "log_id").select(
        "log_id",
        "channel",
        "key",
        F.col("tick").alias("on_tick"),
        F.coalesce("_tick", "end_tick").alias("off_tick"),
        F.col("velocity").alias("on_velocity"),
        F.when(F.col("_on") | F.col("_on").isNull(), 0).otherwise(F.col("_velocity")).alias("off_velocity"),
        "ordinal",
    )


def rate_map(changes: DataFrame, division: int) -> DataFrame:
    """Segments (log_id, start, seconds, micros) from rate changes.

    ``changes``: log_id, tick, ordinal, micros. Of several changes at one tick
    the last counts; before the first one the default rate holds.
    """
    base = changes.select("log_id").distinct().select(
        "log_id",
        F.lit(0).cast("bigint").alias("tick"),
        F.lit(-1).cast("bigint").alias("ordinal"),
        F.lit(DEFAULT_MICROS).cast("bigint").alias("micros"),
    )
    points = (
        changes.select("log_id", "tick", "ordinal", "micros")
        .unionByName(base)
        .groupBy("log_id", "tick")
        .agg(F.max_by("micros", "ordinal").alias("micros"))
    )
    laid = lay_out(points, LOG, ["tick"])
    before = laid.settle(neighbours(laid.df, LOG, ["tick"], {"_tick": "tick", "_micros": "micros"}, -1, laid))
    span = (F.col("tick") - F.col("_tick")) * F.col("_micros") / F.lit(1e6) / F.lit(float(division))
    return running_total(
        before, LOG, ["tick"], {"seconds": F.coalesce(span, F.lit(0.0))}, laid
    ).select("log_id", F.col("tick").alias("start"), "seconds", "micros")


def seconds_at(
    rows: DataFrame, tick: str, segments: DataFrame, division: int, out: str
) -> DataFrame:
    """Seconds of a tick by the segment in force; logs without segments run at the default."""
    marks = segments.select(
        "log_id",
        F.col("start").alias("_t"),
        F.lit(0).alias("_kind"),
        F.struct("seconds", "start", "micros").alias("_seg"),
    )
    queries = rows.withColumns({"_t": F.col(tick), "_kind": F.lit(1)})
    both = queries.unionByName(marks, allowMissingColumns=True)
    found = last_known(both, LOG, ["_t", "_kind"], {"_at": "_seg"}).filter("_kind = 1")
    seconds = F.coalesce("_at.seconds", F.lit(0.0)) + (
        F.col(tick) - F.coalesce("_at.start", F.lit(0))
    ) * F.coalesce("_at.micros", F.lit(DEFAULT_MICROS)) / F.lit(1e6) / F.lit(float(division))
    return found.withColumn(out, seconds).select(*rows.columns, out)


def choose_grid(logs: DataFrame, changes: DataFrame, division: int) -> DataFrame:
    """Ticks per second per log: exact when one rate holds and divides, else per microsecond."""
    rates = changes.groupBy("log_id").agg(
        F.max_by("micros", F.when(F.col("tick") == 0, F.col("ordinal"))).alias("_at0"),
        F.count(F.when(F.col("tick") == 0, 1)).alias("_n0"),
        F.count(F.when(F.col("tick") > 0, 1)).alias("_later"),
    )
    micros = F.when(F.coalesce("_n0", F.lit(0)) > 0, F.col("_at0")).otherwise(F.lit(DEFAULT_MICROS))
    whole = division * 1_000_000
    exact = (F.coalesce("_later", F.lit(0)) == 0) & (F.lit(whole) % micros == 0)
    return logs.join(rates, "log_id", "left").select(
        *logs.columns,
        F.when(exact, F.floor(F.lit(whole) / micros)).otherwise(FALLBACK_GRID).cast("bigint").alias("ticks_per_second"),
    )


def in_range(key: Column) -> Column:
    return key.between(FIRST_KEY, LAST_KEY)


def range_report(pairs: DataFrame) -> DataFrame:
    """Kept and skipped rows per log; a log with nothing left is an error."""
    report = pairs.groupBy("log_id").agg(
        F.count(F.when(in_range(F.col("key")), 1)).alias("kept"),
        F.count(F.when(~in_range(F.col("key")), 1)).alias("skipped"),
    )
    return report.withColumn("error", F.when(F.col("kept") == 0, "no notes in range"))


def quantise(seconds: Column, grid: Column) -> Column:
    return F.round(seconds * grid).cast("bigint")


def quantised_pair(start: Column, end: Column, grid: Column) -> tuple[Column, Column]:
    """Start tick and duration on the grid; at least one tick long."""
    first = quantise(start, grid)
    return first, F.greatest(quantise(end, grid), first + 1) - first


def measure_ticks(division: int, numerator: Column, denominator: Column) -> Column:
    """Measure length of a signature; NULL when it has a zero."""
    valid = (numerator != 0) & (denominator != 0)
    return F.when(valid, F.floor(F.lit(division) * numerator * 4 / denominator))


def measure(start: Column, length: Column) -> Column:
    return F.floor(start / length) + 1


def anchors(pairs: DataFrame, headers: DataFrame) -> DataFrame:
    """First tick of every measure in which a pair starts."""
    with_length = pairs.join(headers.select("log_id", "measure_ticks"), "log_id").filter("measure_ticks IS NOT NULL")
    return (
        with_length.select("log_id", measure(F.col("start"), F.col("measure_ticks")).alias("measure"), "measure_ticks")
        .distinct()
        .select("log_id", "measure", ((F.col("measure") - 1) * F.col("measure_ticks")).alias("tick"))
    )


# -- editing pairs -----------------------------------------------------------


def transpose(key: Column, semitones: int) -> Column:
    return F.least(F.greatest(key + semitones, F.lit(FIRST_KEY)), F.lit(LAST_KEY))


def last_release(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("log_id").agg(F.max(F.col("start") + F.col("duration")).alias("last_release"))


def effective_loop(headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Loop length: the header's, else the last release."""
    return headers.join(last_release(pairs), "log_id", "left").withColumn(
        "effective_loop", F.coalesce("loop_ticks", "last_release")
    )


def shift_ticks(
    pairs: DataFrame, headers: DataFrame, delta: Column, saturate: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Move pairs and loop by ``delta`` (an expression over the header).

    Pairs that would start before 0 are dropped; a log left empty is an error and
    keeps its header. ``saturate`` stops the loop at 0.
    """
    moved = headers.withColumn("_delta", delta)
    joined = pairs.join(moved.select("log_id", "_delta"), "log_id").withColumn("start", F.col("start") + F.col("_delta"))
    kept = joined.filter((F.col("start") >= 0) | (F.col("_delta") == 0)).drop("_delta")
    left = kept.select("log_id").distinct().withColumn("_left", F.lit(True))
    loop = F.col("loop_ticks") + F.col("_delta")
    out = moved.join(left, "log_id", "left").withColumn(
        "error", F.when(F.col("_left").isNull() & (F.col("_delta") < 0), "no notes left")
    )
    return kept, out.withColumn(
        "loop_ticks",
        F.when(F.col("error").isNotNull() | loop.isNull(), F.col("loop_ticks")).otherwise(
            F.greatest(loop, F.lit(0)) if saturate else loop
        ),
    ).drop("_delta", "_left")


def skip_seconds(pairs: DataFrame, headers: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Drop the first seconds and move the rest to tick 0."""
    return shift_ticks(pairs, headers, -F.lit(seconds) * F.col("ticks_per_second"), saturate=True)


def shift_seconds(pairs: DataFrame, headers: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    if not math.isfinite(seconds):
        raise ValueError("seconds have to be finite")
    delta = F.round(F.lit(float(seconds)) * F.col("ticks_per_second")).cast("bigint")
    return shift_ticks(pairs, headers, delta)


def rescale_ticks(ticks: Column, old: Column, new: Column) -> Column:
    """ticks * new / old rounded half up, in integers wide enough for any product."""
    product = ticks.cast("decimal(19,0)") * new.cast("decimal(19,0)")
    half = whole_div(old.cast("bigint"), 2).cast("decimal(19,0)")
    return whole_div(product + half, old.cast("decimal(19,0)"))


def exact_div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative values."""
    return whole_div(a.cast("bigint"), b.cast("bigint"))


def rescale_to_duration(
    pairs: DataFrame, headers: DataFrame, seconds: float
) -> tuple[DataFrame, DataFrame]:
    """Stretch every log to a new length; a tail past the end becomes a one-tick note there."""
    if not math.isfinite(seconds) or seconds <= 0:
        raise ValueError("seconds have to be finite and above zero")
    new = F.round(F.lit(float(seconds)) * F.col("ticks_per_second")).cast("bigint")
    loops = effective_loop(headers, pairs).withColumn("_new", new)
    sound = loops.withColumn("error", F.when(F.col("_new") < 1, "duration rounds to no tick"))
    joined = pairs.join(
        sound.filter("error IS NULL").select("log_id", F.col("effective_loop").alias("_old"), "_new"), "log_id"
    )
    start = rescale_ticks(F.col("start"), F.col("_old"), F.col("_new"))
    duration = F.greatest(rescale_ticks(F.col("duration"), F.col("_old"), F.col("_new")), F.lit(1))
    scaled = joined.withColumns({"_s": start, "_d": duration})
    over = F.col("_s") + F.col("_d") > F.col("_new")
    out = scaled.withColumns(
        {
            "start": F.when(over, F.col("_new") - 1).otherwise(F.col("_s")),
            "duration": F.when(over, 1).otherwise(F.col("_d")),
        }
    ).select(*pairs.columns)
    grid = F.greatest(rescale_ticks(F.col("measure_ticks"), F.col("effective_loop"), F.col("_new")), F.lit(1))
    new_headers = sound.withColumns(
        {
            "measure_ticks": F.when(F.col("error").isNull(), F.when(F.col("measure_ticks").isNotNull(), grid)).otherwise(
                F.col("measure_ticks")
            ),
            "loop_ticks": F.when(F.col("error").isNull(), F.col("_new")).otherwise(F.col("loop_ticks")),
        }
    )
    return out, new_headers.select(*headers.columns, "error")


def merge_logs(
    pairs: DataFrame, headers: DataFrame, other_pairs: DataFrame, other_headers: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Other log's pairs on this log's grid, after its own; the longer loop wins.

    Logs correspond by log_id; the first side decides which logs there are.
    """
    grids = headers.select("log_id", F.col("ticks_per_second").alias("_to")).join(
        other_headers.select("log_id", F.col("ticks_per_second").alias("_from")), "log_id"
    )

    def to_grid(ticks: str) -> Column:
        return rescale_ticks(F.col(ticks), F.col("_from"), F.col("_to"))

    ends = pairs.groupBy("log_id").agg(F.max("pos").alias("_end"))
    moved = (
        other_pairs.join(grids, "log_id").join(ends, "log_id", "left")
        .withColumns(
            {
                "start": to_grid("start"),
                "duration": F.greatest(to_grid("duration"), F.lit(1)),
                "pos": F.col("pos") + F.coalesce(F.col("_end") + 1, F.lit(0)),
            }
        )
        .select(*pairs.columns)
    )
    other = (
        effective_loop(other_headers, other_pairs).join(grids, "log_id")
        .select("log_id", to_grid("effective_loop").alias("_other"))
    )
    loops = effective_loop(headers, pairs).join(other, "log_id", "left").withColumn(
        "loop_ticks", F.greatest("effective_loop", "_other")
    )
    return pairs.unionByName(moved), loops.select(*headers.columns)


def truncate(pairs: DataFrame, headers: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """First ``length`` pairs of every log in file order; the loop becomes implicit."""
    return first_rows(pairs, LOG, ["pos"], length), headers.withColumn("loop_ticks", F.lit(None).cast("bigint"))


# -- performing --------------------------------------------------------------


def canonical_rank(pairs: DataFrame, name: str) -> DataFrame:
    """Position in (start, key, velocity) order, ties in file order."""
    return row_numbers(pairs, LOG, CANONICAL, name)


def to_events(pairs: DataFrame, headers: DataFrame) -> DataFrame:
    """Attack and release events in playing order with voice ids and sequence numbers.

    Voices follow the canonical order; at one tick attacks come first. A log whose
    loop ends before its last release is one error row.
    """
    loops = effective_loop(headers, pairs)
    short = F.col("loop_ticks") < F.col("last_release")
    good = loops.filter(~F.coalesce(short, F.lit(False))).select("log_id", "ticks_per_second")
    voiced = canonical_rank(pairs, "voice").join(good, "log_id")
    release = F.coalesce("release", "velocity")

    def event(rank: int, action: str, tick: Column, velocity: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(action).alias("action"), tick.alias("tick"), velocity.alias("velocity")
        )

    spread = voiced.select(
        "log_id", "voice", "key", "duration", "ticks_per_second",
        F.explode(
            F.array(
                event(0, "attack", F.col("start"), F.col("velocity")),
                event(1, "release", F.col("start") + F.col("duration"), release),
            )
        ).alias("_e"),
    ).select("log_id", "voice", "key", "duration", "ticks_per_second", "_e.*")
    # Timestamps are whole nanoseconds, so different ticks may share one.
    timed = spread.withColumn("nanos", total_nanos(F.col("tick"), F.col("ticks_per_second")))
    numbered = row_numbers(timed, LOG, ["nanos", "rank", "key", "voice"], "sequence")
    events = numbered.select(
        "log_id", "sequence", "voice", "key", "action", "tick", "nanos",
        (F.col("velocity") / F.lit(float(MAX_VELOCITY))).alias("velocity"),
        F.when(F.col("action") == "release", total_nanos(F.col("duration"), F.col("ticks_per_second"))).alias("held_nanos"),
        F.lit(None).cast("string").alias("error"),
    )
    bad = loops.filter(short).select("log_id", F.lit("loop precedes the last release").alias("error"))
    return events.unionByName(bad, allowMissingColumns=True)


def diagnostics(pairs: DataFrame, headers: DataFrame, file_anchors: DataFrame) -> DataFrame:
    """Findings (log_id, level, finding, amount) of every log."""
    def finding(df: DataFrame, level: str, text: str) -> DataFrame:
        return df.select("log_id", F.lit(level).alias("level"), F.lit(text).alias("finding"), F.col("amount").cast("bigint"))

    value = ["start", "duration", "key", "velocity", "release"]
    before = neighbours(pairs, LOG, CANONICAL, {f"_{c}": c for c in value}, -1)
    same = F.col("_start").isNotNull()
    for c in value:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    copies = before.groupBy("log_id").agg(F.count(F.when(same, 1)).alias("amount")).filter("amount > 0")
    # The file is sorted exactly when no pair sorts before the one it follows.
    order = ["start", "key", "velocity"]
    filed = neighbours(pairs, LOG, ["pos"], {f"_{c}": c for c in order}, -1)
    back = F.struct(*[F.col(f"_{c}") for c in order]) > F.struct(*order)
    unsorted = filed.groupBy("log_id").agg(
        F.count(F.when(F.col("_start").isNotNull() & back, 1)).alias("amount")
    ).filter("amount > 0")
    expected = anchors(pairs, headers).withColumn("_e", F.lit(True))
    known = headers.filter("measure_ticks IS NOT NULL").select("log_id")
    stale = (
        file_anchors.join(known, "log_id", "left_semi").withColumn("_f", F.lit(True))
        .join(expected, ["log_id", "measure", "tick"], "full_outer")
        .groupBy("log_id").agg(F.count(F.when(F.col("_f").isNull() | F.col("_e").isNull(), 1)).alias("amount"))
        .filter("amount > 0")
    )
    short = (
        effective_loop(headers, pairs).filter("loop_ticks < last_release")
        .withColumn("amount", F.col("last_release") - F.col("loop_ticks"))
    )
    return (
        finding(copies, "warning", "duplicate pair")
        .unionByName(finding(unsorted, "warning", "pairs not sorted"))
        .unionByName(finding(stale, "warning", "stale anchors"))
        .unionByName(finding(short, "error", "loop precedes the last release"))
    )


def due_events(events: DataFrame, elapsed: Column) -> DataFrame:
    """Events due by ``elapsed`` over the repeats of the loop.

    ``events`` has timestamp and loop in one unit, loop > 0; adds cycle and due.
    """
    # Cycles are unfolded in runs, so no row builds an array longer than RUN.
    last = exact_div(elapsed - F.col("timestamp"), F.col("loop"))
    zero, run = F.lit(0).cast("bigint"), F.lit(RUN).cast("bigint")
    spread = (
        events.filter(F.col("timestamp") <= elapsed)
        .withColumn("_last", last)
        .withColumn("_run", F.explode(F.sequence(zero, exact_div(F.col("_last"), run))))
        .withColumn(
            "cycle",
            F.explode(F.sequence(F.col("_run") * run, F.least(F.col("_last"), F.col("_run") * run + run - 1))),
        )
        .drop("_last", "_run")
    )
    return spread.withColumn("due", F.col("cycle") * F.col("loop") + F.col("timestamp"))


def key_name(key: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.concat(F.element_at(names, (key % 12 + 1).cast("int")), (F.floor(key / 12) - 1).cast("string"))


def exact_time(ticks: Column, grid: Column) -> tuple[Column, Column]:
    """Whole seconds and nanoseconds of a tick count."""
    rest = (ticks % grid).cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)")
    wide = grid.cast("decimal(19,0)")
    return exact_div(ticks, grid), whole_div(rest, wide)


def total_nanos(ticks: Column, grid: Column) -> Column:
    seconds, nanos = exact_time(ticks, grid)
    return seconds * F.lit(10**9).cast("bigint") + nanos


def log_lines(events: DataFrame, skip_nanos: int = 0) -> DataFrame:
    """One text line per release that follows an attack of its voice.

    ``events``: log_id, voice, seq, action, nanos, velocity (0..1), key.
    """
    before = neighbours(
        events, ["log_id", "voice"], ["seq"], {"_action": "action", "_nanos": "nanos", "_velocity": "velocity"}, -1
    )
    closed = before.filter("action = 'release' AND _action = 'attack'")

    def grid(nanos: Column) -> Column:
        second = F.lit(10**9).cast("bigint")
        return exact_div(nanos, second) * LOG_GRID + exact_div(nanos % second * LOG_GRID, second)

    def level(velocity: Column) -> Column:
        return F.round(F.least(F.greatest(velocity, F.lit(0.0)), F.lit(1.0)) * MAX_VELOCITY).cast("int")

    length = F.greatest(F.col("nanos") - F.col("_nanos"), F.lit(0))
    line = F.concat_ws(
        " ",
        grid(F.col("_nanos") + F.lit(skip_nanos)).cast("string"),
        F.greatest(grid(length), F.lit(1)).cast("string"),
        key_name(F.col("key")),
        level(F.col("_velocity")).cast("string"),
        level(F.col("velocity")).cast("string"),
    )
    return closed.select("log_id", "voice", "seq", line.alias("line"))


# -- random edits ------------------------------------------------------------


def random_key(u: Column) -> Column:
    """Key whose odds fall off exponentially from the middle of the range."""
    middle = (FIRST_KEY + LAST_KEY) / 2
    weights = [math.exp(-abs(k - middle) / KEY_DECAY) for k in range(FIRST_KEY, LAST_KEY + 1)]
    steps, acc = [], 0.0
    for w in weights:
        acc += w
        steps.append(acc / sum(weights))
    passed = F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s < u))
    return F.least(passed + FIRST_KEY, F.lit(LAST_KEY)).cast("bigint")


def random_duration(u: Column, grid: Column) -> Column:
    """Duration uniform in the logarithm of its seconds, at least one tick."""
    seconds = F.lit(MIN_SECONDS) * F.exp(u * F.lit(math.log(MAX_SECONDS / MIN_SECONDS)))
    return F.greatest(F.round(seconds * grid), F.lit(1)).cast("bigint")


def mutate(pairs: DataFrame, headers: DataFrame, noise: float, seed: int) -> DataFrame:
    """Delete, substitute or insert after exactly ``floor(n * noise)`` pairs of each log.

    Pairs are chosen by a digest of (log, pos), so the draws do not depend on each
    other or on the partitioning. Adds ``edit``; file order stays in (pos, inserted).
    """
    noise = min(max(noise, 0.0), 1.0)
    loops = effective_loop(headers, pairs).select("log_id", "ticks_per_second", "effective_loop")
    sizes = pairs.groupBy("log_id").agg(F.floor(F.count(F.lit(1)) * F.lit(noise)).alias("_m"))
    order = F.conv(F.substring(digest(f"{seed}:pick", "log_id", "pos"), 1, 12), 16, 10).cast("bigint")
    ranked = row_numbers(pairs.withColumn("_o", order), LOG, ["_o", "pos"], "_rn")
    following = neighbours(ranked, LOG, ["pos"], {"_next": "start"}, 1)
    drawn = following.join(sizes, "log_id").join(loops, "log_id")

    def draw(part: str) -> Column:
        return uniform(f"{seed}:{part}", "log_id", "pos")

    kind = F.floor(draw("kind") * 3)
    edit = F.when(
        F.col("_rn") <= F.col("_m"),
        F.when(kind == 0, "delete").when(kind == 1, "substitute").otherwise("insert"),
    ).otherwise("keep")
    fresh = {
        "_key": random_key(draw("key")),
        "_duration": random_duration(draw("duration"), F.col("ticks_per_second")),
        "_velocity": F.floor(draw("velocity") * (MAX_VELOCITY + 1)),
    }
    end = F.greatest(F.coalesce("_next", "effective_loop"), F.col("start"))
    place = F.col("start") + F.floor(draw("start") * (end - F.col("start") + 1))
    marked = drawn.withColumn("edit", edit).withColumns(fresh).withColumn("_start", place)

    def row(inserted: int, **values: Column) -> Column:
        return F.struct(
            F.lit(inserted).alias("inserted"),
            *[values.get(c, F.col(c)).cast("bigint").alias(c) for c in ("start", "duration", "key", "velocity", "release")],
        )

    changed = row(0, duration=F.col("_duration"), key=F.col("_key"), velocity=F.col("_velocity"))
    added = row(
        1, start=F.col("_start"), duration=F.col("_duration"), key=F.col("_key"), velocity=F.col("_velocity"),
        release=F.lit(None),
    )
    rows = (
        F.when(F.col("edit") == "substitute", F.array(changed))
        .when(F.col("edit") == "insert", F.array(row(0), added))
        .otherwise(F.array(row(0)))
    )
    return marked.filter("edit <> 'delete'").select("log_id", "pos", "edit", F.explode(rows).alias("_r")).select(
        "log_id", "pos", "edit", "_r.*"
    )
