"""Registered interval queries: events as key logs per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions.cols import epoch_ms
from tensorloom.operators import intervals as oi
from tensorloom.plans.catalog import register, table

EPOCH = 1704067200000  # 2024-01-01, the first day of the log
DIVISION = 480
GRID = 960

EV = f"""ev AS (SELECT event_id, user_id AS log_id, event_id % 3 AS channel, 15 + regexp_extract(props, '([0-9]+)', 1)::BIGINT AS key,
  floor(value)::BIGINT % 128 AS velocity, epoch_us(ts) // 1000 - {EPOCH} AS tick, event_type, value FROM events),
  nt AS (SELECT log_id, channel, key, velocity, tick, event_id AS ordinal, event_type IN ('click', 'view', 'signup') AND velocity <> 0 AS "on" FROM ev)"""


def events(spark, sf_dir):
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("log_id"),
        (F.col("event_id") % 3).alias("channel"),
        (number + 15).alias("key"),
        (F.floor("value") % 128).alias("velocity"),
        (epoch_ms("ts") - EPOCH).alias("tick"),
        F.col("event_id").alias("ordinal"),
        F.col("event_type").isin("click", "view", "signup").alias("on"),
        "event_type",
        "value",
    )


def notes(spark, sf_dir):
    return oi.note_events(events(spark, sf_dir)).drop("event_type", "value")


def ends(spark, sf_dir):
    return notes(spark, sf_dir).groupBy("log_id").agg(F.max("tick").alias("end_tick"))


@register(
    "note_channel_filter",
    f'WITH {EV} SELECT log_id, key, velocity, tick, ordinal, "on" FROM nt WHERE channel = 1',
)
def note_channel_filter(spark, sf_dir):
    return oi.note_events(events(spark, sf_dir), 1).select("log_id", "key", "velocity", "tick", "ordinal", "on")


PAIRED = f"""{EV}, x AS (SELECT *, lead(tick) OVER k AS t2, lead("on") OVER k AS o2, lead(velocity) OVER k AS v2, max(tick) OVER (PARTITION BY log_id) AS e
  FROM nt WINDOW k AS (PARTITION BY log_id, channel, key ORDER BY tick, ordinal)),
  pd AS (SELECT log_id, channel, key, tick AS on_tick, coalesce(t2, e) AS off_tick, velocity AS on_velocity,
    CASE WHEN o2 IS NULL OR o2 THEN 0 ELSE v2 END AS off_velocity, ordinal FROM x WHERE "on")"""


@register("pair_on_off_events", f"WITH {PAIRED} SELECT * FROM pd")
def pair_on_off_events(spark, sf_dir):
    return oi.pair_events(notes(spark, sf_dir), ends(spark, sf_dir))


CHANGES = f"""{EV}, ch AS (SELECT log_id, CASE WHEN log_id % 4 = 0 THEN 0 ELSE tick END AS tick, event_id AS ordinal,
  CASE WHEN log_id % 4 = 0 THEN 1000 * (1 + event_id % 9) ELSE 200000 + 1000 * floor(value)::BIGINT END AS micros FROM ev WHERE event_type = 'error'),
  pts AS (SELECT log_id, tick, arg_max(micros, ordinal) AS micros FROM (SELECT * FROM ch UNION ALL SELECT DISTINCT log_id, 0, -1, 500000 FROM ch) GROUP BY ALL),
  sg AS (SELECT log_id, tick AS start, micros, coalesce(sum((tick - pt) * pm / 1e6::DOUBLE / 480.0::DOUBLE) OVER (PARTITION BY log_id ORDER BY tick), 0) AS seconds
    FROM (SELECT *, lag(tick) OVER (PARTITION BY log_id ORDER BY tick) AS pt, lag(micros) OVER (PARTITION BY log_id ORDER BY tick) AS pm FROM pts))"""


def changes(spark, sf_dir):
    """Rate changes at the errors; every fourth log has them all at tick 0."""
    rows = events(spark, sf_dir).filter("event_type = 'error'")
    start = F.col("log_id") % 4 == 0
    micros = F.when(start, (F.col("ordinal") % 9 + 1) * 1000).otherwise(F.floor("value") * 1000 + 200000)
    return rows.select("log_id", F.when(start, 0).otherwise(F.col("tick")).cast("bigint").alias("tick"), "ordinal", micros.alias("micros"))


@register("rate_map_segments", f"WITH {CHANGES} SELECT log_id, start, micros, round(seconds + 3e-9::DOUBLE, 4) AS seconds FROM sg")
def rate_map_segments(spark, sf_dir):
    return oi.rate_map(changes(spark, sf_dir), DIVISION).withColumn("seconds", F.round(F.col("seconds") + 3e-9, 4))


@register(
    "rate_map_as_of",
    f"""WITH {CHANGES} SELECT nt.log_id, nt.ordinal, nt.tick, round(3e-9::DOUBLE + coalesce(sg.seconds, 0) + (nt.tick - coalesce(sg.start, 0)) * coalesce(sg.micros, 500000) / 1e6::DOUBLE / 480.0::DOUBLE, 4) AS seconds
    FROM nt ASOF LEFT JOIN sg ON nt.log_id = sg.log_id AND nt.tick >= sg.start""",
)
def rate_map_as_of(spark, sf_dir):
    segments = oi.rate_map(changes(spark, sf_dir), DIVISION)
    rows = notes(spark, sf_dir).select("log_id", "ordinal", "tick")
    return oi.seconds_at(rows, "tick", segments, DIVISION, "seconds").withColumn(
        "seconds", F.round(F.col("seconds") + 3e-9, 4)  # keeps exact decimal ties off the rounding edge
    )


@register(
    "choose_tick_grid",
    f"""WITH {CHANGES}, g AS (SELECT log_id, arg_max(micros, ordinal) FILTER (tick = 0) AS m0, count(*) FILTER (tick > 0) AS later FROM ch GROUP BY log_id)
    SELECT l.log_id, CASE WHEN coalesce(later, 0) = 0 AND 480000000 % coalesce(m0, 500000) = 0 THEN 480000000 // coalesce(m0, 500000) ELSE 1000000 END AS ticks_per_second
    FROM (SELECT DISTINCT log_id FROM ev) l LEFT JOIN g USING (log_id)""",
)
def choose_tick_grid(spark, sf_dir):
    logs = events(spark, sf_dir).select("log_id").distinct()
    return oi.choose_grid(logs, changes(spark, sf_dir), DIVISION)


@register(
    "key_range_filter",
    f"""WITH {EV} SELECT log_id, count(*) FILTER (key BETWEEN 21 AND 108) AS kept, count(*) FILTER (key NOT BETWEEN 21 AND 108) AS skipped,
    CASE WHEN count(*) FILTER (key BETWEEN 21 AND 108) = 0 THEN 'no notes in range' END AS error FROM nt GROUP BY log_id""",
)
def key_range_filter(spark, sf_dir):
    return oi.range_report(notes(spark, sf_dir))


@register(
    "quantise_pairs",
    f"""WITH {PAIRED} SELECT log_id, ordinal, round(on_tick / 1000.0::DOUBLE * 7)::BIGINT AS start,
    greatest(round(off_tick / 1000.0::DOUBLE * 7)::BIGINT, round(on_tick / 1000.0::DOUBLE * 7)::BIGINT + 1) - round(on_tick / 1000.0::DOUBLE * 7)::BIGINT AS duration FROM pd""",
)
def quantise_pairs(spark, sf_dir):
    rows = oi.pair_events(notes(spark, sf_dir), ends(spark, sf_dir))
    start, duration = oi.quantised_pair(F.col("on_tick") / 1000.0, F.col("off_tick") / 1000.0, F.lit(7))
    return rows.select("log_id", "ordinal", start.alias("start"), duration.alias("duration"))


# Score pairs: every event is one, in arrival order; some repeat the one before.
PAIRS = f"""{EV}, pr AS (SELECT log_id, event_id AS pos, tick // 60000 * 960 AS start, 1 + velocity * 100 AS duration, 40 + key % 8 AS key, velocity // 16 AS velocity,
    CASE WHEN velocity % 3 <> 0 THEN velocity END AS release FROM ev),
  lr AS (SELECT log_id, max(start + duration) AS last FROM pr GROUP BY log_id),
  hd AS (SELECT log_id, 960 AS tps, CASE log_id % 3 WHEN 1 THEN last + 500 WHEN 2 THEN last - 7 END AS loop, CASE WHEN log_id % 5 <> 0 THEN 3840 * 60 END AS mt, last,
    coalesce(CASE log_id % 3 WHEN 1 THEN last + 500 WHEN 2 THEN last - 7 END, last) AS eff FROM lr)"""


def pairs(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select(
        "log_id",
        F.col("ordinal").alias("pos"),
        (F.floor(F.col("tick") / 60000) * GRID).alias("start"),
        (F.col("velocity") * 100 + 1).alias("duration"),
        (F.col("key") % 8 + 40).alias("key"),
        F.floor(F.col("velocity") / 16).alias("velocity"),
        F.when(F.col("velocity") % 3 != 0, F.col("velocity")).alias("release"),
    )


def headers(spark, sf_dir):
    k = F.col("log_id") % 3
    return oi.last_release(pairs(spark, sf_dir)).select(
        "log_id",
        F.lit(GRID).cast("bigint").alias("ticks_per_second"),
        F.when(k == 1, F.col("last_release") + 500).when(k == 2, F.col("last_release") - 7).alias("loop_ticks"),
        F.when(F.col("log_id") % 5 != 0, F.lit(3840 * 60).cast("bigint")).alias("measure_ticks"),
    )


def both(spark, sf_dir):
    return pairs(spark, sf_dir), headers(spark, sf_dir)


OUT = "log_id, pos, start, duration, key, velocity, release"


@register(
    "measure_buckets",
    f"WITH {PAIRS}, m AS (SELECT DISTINCT log_id, start // mt + 1 AS measure, mt FROM pr JOIN hd USING (log_id) WHERE mt IS NOT NULL) SELECT log_id, measure, (measure - 1) * mt AS tick FROM m",
)
def measure_buckets(spark, sf_dir):
    return oi.anchors(*both(spark, sf_dir))


@register(
    "measure_length",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 AND l_suppkey % 5 <> 0 THEN 480 * l_linenumber * 4 // (l_suppkey % 5) END AS ticks FROM lineitem",
)
def measure_length(spark, sf_dir):
    top = F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", oi.measure_ticks(DIVISION, top, F.col("l_suppkey") % 5).alias("ticks")
    )


@register("transpose_clamped", f"WITH {EV} SELECT log_id, ordinal, least(greatest(key + 7, 21), 108) AS key FROM nt")
def transpose_clamped(spark, sf_dir):
    return notes(spark, sf_dir).select("log_id", "ordinal", oi.transpose(F.col("key"), 7).alias("key"))


@register(
    "skip_first_seconds",
    f"WITH {PAIRS} SELECT log_id, pos, start - 6000 * 960 AS start, duration, key, velocity, release FROM pr WHERE start >= 6000 * 960",
)
def skip_first_seconds(spark, sf_dir):
    return oi.skip_seconds(*both(spark, sf_dir), 6000)[0].select(*OUT.split(", "))


@register(
    "skip_first_seconds_headers",
    f"""WITH {PAIRS}, s AS (SELECT log_id, max(start) >= 41000 * 960 AS rest FROM pr GROUP BY log_id)
    SELECT log_id, CASE WHEN rest THEN greatest(loop - 41000 * 960, CASE WHEN loop IS NOT NULL THEN 0 END) ELSE loop END AS loop_ticks,
    CASE WHEN NOT rest THEN 'no notes left' END AS error FROM hd JOIN s USING (log_id)""",
)
def skip_first_seconds_headers(spark, sf_dir):
    out = oi.skip_seconds(*both(spark, sf_dir), 41000)[1]
    return out.select("log_id", "loop_ticks", "error")


@register(
    "rescale_to_duration",
    f"""WITH {PAIRS}, r AS (SELECT pr.*, 90 * 960 AS nw, ((start::HUGEINT * 86400 + eff // 2) // eff)::BIGINT AS s,
      greatest(((duration::HUGEINT * 86400 + eff // 2) // eff)::BIGINT, 1) AS d FROM pr JOIN hd USING (log_id))
    SELECT log_id, pos, CASE WHEN s + d > nw THEN nw - 1 ELSE s END AS start, CASE WHEN s + d > nw THEN 1 ELSE d END AS duration, key, velocity, release FROM r""",
)
def rescale_to_duration(spark, sf_dir):
    return oi.rescale_to_duration(*both(spark, sf_dir), 90.0)[0].select(*OUT.split(", "))


@register(
    "rescale_headers",
    f"""WITH {PAIRS} SELECT log_id, 86400::BIGINT AS loop_ticks, CASE WHEN mt IS NOT NULL THEN greatest((mt::HUGEINT * 86400 + eff // 2) // eff, 1)::BIGINT END AS measure_ticks,
    NULL::VARCHAR AS error FROM hd""",
)
def rescale_headers(spark, sf_dir):
    return oi.rescale_to_duration(*both(spark, sf_dir), 90.0)[1].drop("ticks_per_second")


VOICES = f"""{PAIRS}, vc AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY start, key, velocity, pos) AS voice FROM pr),
  ea AS (SELECT log_id, voice, key, 0 AS rank, 'attack' AS action, start AS tick, velocity AS vel, NULL::BIGINT AS held FROM vc
    UNION ALL SELECT log_id, voice, key, 1, 'release', start + duration, coalesce(release, velocity), duration FROM vc),
  es AS (SELECT ea.*, ea.tick // 960 * 1000000000 + (ea.tick % 960) * 1000000000 // 960 AS nanos, held // 960 * 1000000000 + (held % 960) * 1000000000 // 960 AS held_nanos
    FROM ea JOIN hd USING (log_id) WHERE loop IS NULL OR loop >= last)"""


@register(
    "pairs_to_events",
    f"""WITH {VOICES} SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY nanos, rank, key, voice) AS sequence, voice, key, action, tick, nanos,
    round(vel / 127.0::DOUBLE, 6) AS velocity, held_nanos, NULL::VARCHAR AS error FROM es
    UNION ALL SELECT log_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'loop precedes the last release' FROM hd WHERE loop < last""",
)
def pairs_to_events(spark, sf_dir):
    return oi.to_events(*both(spark, sf_dir)).withColumn("velocity", F.round("velocity", 6))


@register("canonical_pair_order", f"WITH {VOICES} SELECT log_id, pos, voice AS place FROM vc")
def canonical_pair_order(spark, sf_dir):
    return oi.canonical_rank(pairs(spark, sf_dir), "place").select("log_id", "pos", "place")


@register(
    "score_diagnostics",
    f"""WITH {PAIRS}, ca AS (SELECT *, lag((start, duration, key, velocity, release)) OVER (PARTITION BY log_id ORDER BY start, key, velocity, pos) AS prev FROM pr),
    fl AS (SELECT *, lag((start, key, velocity)) OVER (PARTITION BY log_id ORDER BY pos) AS prev FROM pr),
    xa AS (SELECT DISTINCT log_id, start // mt + 1 AS measure, start // mt * mt AS tick FROM pr JOIN hd USING (log_id) WHERE mt IS NOT NULL),
    fa AS (SELECT log_id, measure, tick + CASE WHEN log_id % 7 = 0 AND measure % 2 = 0 THEN 1 ELSE 0 END AS tick FROM xa),
    st AS (SELECT log_id, count(*) FILTER (xa.tick IS NULL OR fa.tick IS NULL) AS amount FROM xa FULL JOIN fa USING (log_id, measure, tick) GROUP BY log_id)
    SELECT log_id, 'warning' AS level, 'duplicate pair' AS finding, count(*) AS amount FROM ca WHERE prev = (start, duration, key, velocity, release) OR
      (prev[1] = start AND prev[2] = duration AND prev[3] = key AND prev[4] = velocity AND prev[5] IS NULL AND release IS NULL) GROUP BY log_id
    UNION ALL SELECT log_id, 'warning', 'pairs not sorted', count(*) FROM fl WHERE prev > (start, key, velocity) GROUP BY log_id
    UNION ALL SELECT log_id, 'warning', 'stale anchors', sum(amount)::BIGINT FROM (SELECT log_id, 1 AS amount FROM xa WHERE log_id % 7 = 0 AND measure % 2 = 0 UNION ALL
      SELECT log_id, 1 FROM fa WHERE log_id % 7 = 0 AND measure % 2 = 0) GROUP BY log_id
    UNION ALL SELECT log_id, 'error', 'loop precedes the last release', last - loop FROM hd WHERE loop < last""",
)
def score_diagnostics(spark, sf_dir):
    rows, heads = both(spark, sf_dir)
    stale = (F.col("log_id") % 7 == 0) & (F.col("measure") % 2 == 0)
    filed = oi.anchors(rows, heads).withColumn("tick", F.col("tick") + F.when(stale, 1).otherwise(0))
    return oi.diagnostics(rows, heads, filed)


@register(
    "shift_by_seconds",
    f"WITH {PAIRS} SELECT log_id, pos, start - 960960 AS start, duration, key, velocity, release FROM pr WHERE start >= 960960",
)
def shift_by_seconds(spark, sf_dir):
    return oi.shift_seconds(*both(spark, sf_dir), -1001.0)[0].select(*OUT.split(", "))


@register("shift_headers", f"WITH {PAIRS} SELECT log_id, loop + 12345 AS loop_ticks, NULL::VARCHAR AS error FROM hd")
def shift_headers(spark, sf_dir):
    return oi.shift_ticks(*both(spark, sf_dir), F.lit(12345).cast("bigint"))[1].select("log_id", "loop_ticks", "error")


MERGED = f"""{PAIRS}, op AS (SELECT log_id - 1 AS log_id, pos, start, duration, key, velocity, release FROM pr),
  oh AS (SELECT log_id - 1 AS log_id, 700 AS tps, eff FROM hd), en AS (SELECT log_id, max(pos) AS e FROM pr GROUP BY log_id)"""


def other(spark, sf_dir):
    """Every log's neighbour on another grid."""
    rows, heads = both(spark, sf_dir)
    back = F.col("log_id") - 1
    return rows.withColumn("log_id", back), heads.withColumn("log_id", back).withColumn("ticks_per_second", F.lit(700).cast("bigint"))


@register(
    "merge_two_logs",
    f"""WITH {MERGED} SELECT {OUT} FROM pr UNION ALL SELECT op.log_id, op.pos + e + 1, (start * 960 + 350) // 700, greatest((duration * 960 + 350) // 700, 1), key, velocity, release
    FROM op JOIN en USING (log_id)""",
)
def merge_two_logs(spark, sf_dir):
    return oi.merge_logs(*both(spark, sf_dir), *other(spark, sf_dir))[0].select(*OUT.split(", "))


@register(
    "merge_two_logs_loop",
    f"WITH {MERGED} SELECT hd.log_id, greatest(hd.eff, coalesce((oh.eff * 960 + 350) // 700, 0)) AS loop_ticks FROM hd LEFT JOIN oh USING (log_id)",
)
def merge_two_logs_loop(spark, sf_dir):
    return oi.merge_logs(*both(spark, sf_dir), *other(spark, sf_dir))[1].select("log_id", "loop_ticks")


@register("mutate_pairs")
def mutate_pairs(spark, sf_dir):
    return oi.mutate(*both(spark, sf_dir), noise=0.3, seed=4)


@register(
    "truncate_pairs",
    f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY pos) AS rn FROM pr) SELECT {OUT} FROM n WHERE rn <= 10",
)
def truncate_pairs(spark, sf_dir):
    return oi.truncate(*both(spark, sf_dir), 10)[0].select(*OUT.split(", "))


@register(
    "loop_expansion",
    f"""WITH {PAIRS}, t AS (SELECT log_id, pos, start AS timestamp, eff AS loop FROM pr JOIN hd USING (log_id))
    SELECT log_id, pos, cycle, cycle * loop + timestamp AS due FROM t, range(0, 40) c(cycle) WHERE cycle * loop + timestamp <= 90000000""",
)
def loop_expansion(spark, sf_dir):
    rows, heads = both(spark, sf_dir)
    loops = oi.effective_loop(heads, rows).select("log_id", F.col("effective_loop").alias("loop"))
    timed = rows.join(loops, "log_id").select("log_id", "pos", F.col("start").alias("timestamp"), "loop")
    return oi.due_events(timed, F.lit(90000000).cast("bigint")).select("log_id", "pos", "cycle", "due")


@register("effective_loop_length", f"WITH {PAIRS} SELECT log_id, eff AS effective_loop FROM hd")
def effective_loop_length(spark, sf_dir):
    rows, heads = both(spark, sf_dir)
    return oi.effective_loop(heads, rows).select("log_id", "effective_loop")


@register(
    "key_names",
    f"""WITH {EV} SELECT log_id, ordinal, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][key % 12 + 1] || (key // 12 - 1) AS name FROM nt""",
)
def key_names(spark, sf_dir):
    return notes(spark, sf_dir).select("log_id", "ordinal", oi.key_name(F.col("key")).alias("name"))


@register(
    "ticks_to_time",
    f"WITH {EV} SELECT log_id, ordinal, tick // 700 AS seconds, (tick % 700) * 1000000000 // 700 AS nanos FROM nt",
)
def ticks_to_time(spark, sf_dir):
    seconds, nanos = oi.exact_time(F.col("tick"), F.lit(700).cast("bigint"))
    return notes(spark, sf_dir).select("log_id", "ordinal", seconds.alias("seconds"), nanos.alias("nanos"))


@register(
    "release_log_lines",
    f"""WITH {EV}, a AS (SELECT log_id, channel AS voice, ordinal AS seq, CASE WHEN "on" THEN 'attack' ELSE 'release' END AS action, tick * 1000 AS nanos,
      velocity / 100.0::DOUBLE AS velocity, key FROM nt),
    b AS (SELECT *, lag(action) OVER k AS pa, lag(nanos) OVER k AS pn, lag(velocity) OVER k AS pv FROM a WINDOW k AS (PARTITION BY log_id, voice ORDER BY seq))
    SELECT log_id, voice, seq, ((pn + 5000000000) * 1920 // 1000000000) || ' ' || greatest(greatest(nanos - pn, 0) * 1920 // 1000000000, 1) || ' ' ||
      ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][key % 12 + 1] || (key // 12 - 1) || ' ' || round(least(pv, 1) * 127)::INTEGER || ' ' ||
      round(least(velocity, 1) * 127)::INTEGER AS line FROM b WHERE action = 'release' AND pa = 'attack'""",
)
def release_log_lines(spark, sf_dir):
    rows = notes(spark, sf_dir).select(
        "log_id",
        F.col("channel").alias("voice"),
        F.col("ordinal").alias("seq"),
        F.when(F.col("on"), "attack").otherwise("release").alias("action"),
        (F.col("tick") * 1000).alias("nanos"),
        (F.col("velocity") / 100.0).alias("velocity"),
        "key",
    )
    return oi.log_lines(rows, skip_nanos=5 * 10**9)
