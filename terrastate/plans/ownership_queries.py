"""Registered queries: click log, ownership state and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastate.operators import leaderboard as lb
from terrastate.operators import ownership as ow
from terrastate.plans.registry import register
from terrastate.plans.sql import CLICKS_A, CLICKS_B, classified, own, with_
from terrastate.sinks import writers
from terrastate.sources import derived as d
from terrastate.sources.clicks import read_clicks

# Fixed parameters of the registered queries (from the fixture description).
RANGE_START, RANGE_END = 50, 150
FIXTURE_PAGE = 50
SNAPSHOT_CUT_NS = 883_612_800_000_000_000  # 1998-01-01T00:00:00Z: snapshot before, log from there on
RETENTION_NS = 8 * 3_600_000_000_000
CHANGE_BATCH_NS = 3_600_000_000_000


@register("click_log", "S1", with_(CLICKS_A) + "SELECT * FROM clicks_a")
def q_click_log(spark, sf):
    return read_clicks(d.clicks_a(spark, sf))


@register("ownership_lww", "O1", with_(CLICKS_A, own("clicks_a", "own_a")) + "SELECT * FROM own_a")
def q_ownership_lww(spark, sf):
    return ow.current_ownership(d.clicks_a(spark, sf))


@register("classify_clicks", "O3", with_(CLICKS_A, classified("clicks_a", "cls")) + "SELECT * FROM cls")
def q_classify_clicks(spark, sf):
    return ow.classify_clicks(d.clicks_a(spark, sf))


@register("classify_clicks_b", "O3", with_(CLICKS_B, classified("clicks_b", "cls")) + "SELECT * FROM cls")
def q_classify_clicks_b(spark, sf):
    return ow.classify_clicks(d.clicks_b(spark, sf))


_CHANGES_SQL = with_(CLICKS_A, classified("clicks_a", "cls")) + """
SELECT tile_id, country_id, previous_country AS previous_country_id, click_id, timestamp_ns, arrival_ns FROM cls
WHERE previous_country IS NOT NULL AND previous_country <> country_id"""


@register("ownership_changes", "O4", _CHANGES_SQL + " AND applied")
def q_ownership_changes(spark, sf):
    return ow.ownership_changes(ow.classify_clicks(d.clicks_a(spark, sf)))


@register("ownership_changes_parity", "O4", _CHANGES_SQL)
def q_ownership_changes_parity(spark, sf):
    return ow.ownership_changes(ow.classify_clicks(d.clicks_a(spark, sf)), parity=True)


@register("dedup_clicks", "O5", with_(CLICKS_A) + "SELECT * FROM clicks_a")
def q_dedup_clicks(spark, sf):
    c = d.clicks_a(spark, sf)
    redelivered = c.withColumn("arrival_ns", F.col("arrival_ns") + F.lit(1_000_000_000))
    return ow.dedup_clicks(c.unionByName(redelivered))


@register("bootstrap_ownership", "O6", with_(CLICKS_B, own("clicks_b", "own_b")) + "SELECT * FROM own_b")
def q_bootstrap_ownership(spark, sf):
    c = d.clicks_b(spark, sf)
    snapshot = ow.current_ownership(c.filter(F.col("timestamp_ns") < F.lit(SNAPSHOT_CUT_NS)))
    log = c.filter(F.col("timestamp_ns") >= F.lit(SNAPSHOT_CUT_NS))
    return ow.bootstrap_ownership(snapshot, log)


@register("get_tile", "O7", with_(CLICKS_B, own("clicks_b", "own_b")) + """
SELECT ids.tile_id, o.country_id, o.timestamp_ns
FROM (SELECT p_partkey * 2 AS tile_id FROM part) ids LEFT JOIN own_b o ON ids.tile_id = o.tile_id""")
def q_get_tile(spark, sf):
    ids = d.table(spark, sf, "part").select((F.col("p_partkey") * 2).alias("tile_id"))
    return ow.get_tiles(ow.current_ownership(d.clicks_b(spark, sf)), ids)


@register("get_ownerships", "O8", with_(CLICKS_B, own("clicks_b", "own_b")) + "SELECT * FROM own_b")
def q_get_ownerships(spark, sf):
    return ow.current_ownership(d.clicks_b(spark, sf))


@register("ownerships_by_range", "O9", with_(CLICKS_B, own("clicks_b", "own_b"))
          + f"SELECT * FROM own_b WHERE tile_id BETWEEN {RANGE_START} AND {RANGE_END}")
def q_ownerships_by_range(spark, sf):
    return ow.ownerships_by_range(ow.current_ownership(d.clicks_b(spark, sf)), RANGE_START, RANGE_END)


@register("ownership_pages", "O10", with_(CLICKS_B, own("clicks_b", "own_b"))
          + f"SELECT *, CAST(floor(tile_id / {FIXTURE_PAGE}) AS BIGINT) AS page_no FROM own_b")
def q_ownership_pages(spark, sf):
    return ow.ownership_pages(ow.current_ownership(d.clicks_b(spark, sf)), page_size=FIXTURE_PAGE)


@register("ownership_pages_parity", "O10", with_(CLICKS_B, own("clicks_b", "own_b"), """pages AS (
  SELECT k AS page_no, 1 + k * {p} AS lo, least(1 + (k + 1) * {p}, (SELECT count(*) FROM part) - 1) AS hi
  FROM range(0, CAST(floor(((SELECT count(*) FROM part) - 2) / {p}) AS BIGINT) + 1) t(k))""".format(p=FIXTURE_PAGE))
          + "SELECT o.*, p.page_no FROM own_b o JOIN pages p ON o.tile_id BETWEEN p.lo AND p.hi")
def q_ownership_pages_parity(spark, sf):
    n = d.table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    return ow.ownership_pages(ow.current_ownership(d.clicks_b(spark, sf)), tile_count=n,
                              page_size=FIXTURE_PAGE, parity=True)


# --- leaderboards ---------------------------------------------------------------

@register("leaderboard", "L2", with_(CLICKS_A, own("clicks_a", "own_a"))
          + "SELECT country_id, count(*) AS score FROM own_a GROUP BY country_id")
def q_leaderboard(spark, sf):
    return lb.leaderboard(ow.current_ownership(d.clicks_a(spark, sf)))


_RANKED_B = with_(CLICKS_B, own("clicks_b", "own_b")) + """
SELECT country_id, count(*) AS score FROM own_b GROUP BY country_id ORDER BY score DESC, country_id"""


@register("leaderboard_ranked", "L3", _RANKED_B)
def q_leaderboard_ranked(spark, sf):
    return lb.leaderboard_ranked(ow.current_ownership(d.clicks_b(spark, sf)))


@register("leaderboard_top3", "L3", _RANKED_B + " LIMIT 3")
def q_leaderboard_top3(spark, sf):
    return lb.leaderboard_ranked(ow.current_ownership(d.clicks_b(spark, sf)), k=3)


@register("country_score", "L1", with_(CLICKS_A, own("clicks_a", "own_a")) + """
SELECT c.country_id, CAST(coalesce(s.score, 0) AS BIGINT) AS score
FROM (SELECT DISTINCT lower(n_name) AS country_id FROM nation
      UNION SELECT DISTINCT event_type FROM events) c
LEFT JOIN (SELECT country_id, count(*) AS score FROM own_a GROUP BY country_id) s USING (country_id)""")
def q_country_score(spark, sf):
    nat = d.table(spark, sf, "nation").select(F.lower("n_name").alias("code"))
    kinds = d.table(spark, sf, "events").select(F.col("event_type").alias("code"))
    return lb.country_scores(ow.current_ownership(d.clicks_a(spark, sf)), nat.unionByName(kinds))


@register("leaderboard_incremental", "L4", with_(CLICKS_A, own("clicks_a", "own_a"))
          + "SELECT country_id, count(*) AS score FROM own_a GROUP BY country_id")
def q_leaderboard_incremental(spark, sf):
    return lb.leaderboard_incremental(ow.classify_clicks(d.clicks_a(spark, sf)))


@register("leaderboard_display", "L5", with_(CLICKS_B, own("clicks_b", "own_b")) + """,
board AS (SELECT country_id, count(*) AS score FROM own_b GROUP BY country_id)
SELECT CAST(row_number() OVER (ORDER BY score DESC, country_id) AS BIGINT) AS rank, country_id,
       CASE WHEN length(coalesce(n_name, country_id)) > 18 THEN trim(substring(coalesce(n_name, country_id), 1, 18))
            ELSE coalesce(n_name, country_id) END AS display_name,
       score AS tiles, round(CAST(score AS DOUBLE) / (SELECT count(*) FROM part) * 100.0, 2) AS percent
FROM board LEFT JOIN nation ON lower(n_name) = country_id""")
def q_leaderboard_display(spark, sf):
    countries = d.table(spark, sf, "nation").select(F.lower("n_name").alias("code"), F.col("n_name").alias("name"))
    total = d.table(spark, sf, "part").agg(F.count(F.lit(1)).cast("double")).scalar()
    return lb.leaderboard_display(ow.current_ownership(d.clicks_b(spark, sf)), countries, total=total)


# --- time: retention, late data, batches ------------------------------------------

@register("retained_clicks", "T1", with_(CLICKS_A) + f"""
SELECT * FROM clicks_a WHERE arrival_ns > (SELECT max(arrival_ns) FROM clicks_a) - {RETENTION_NS}""")
def q_retained_clicks(spark, sf):
    from terrastate.operators.ownership import retained_clicks

    return retained_clicks(d.clicks_a(spark, sf), RETENTION_NS)


@register("late_clicks", "T2", with_(CLICKS_A, classified("clicks_a", "cls")) + "SELECT * FROM cls WHERE NOT applied")
def q_late_clicks(spark, sf):
    from terrastate.operators.ownership import late_clicks

    return late_clicks(ow.classify_clicks(d.clicks_a(spark, sf)))


@register("change_batches", "T3", with_(CLICKS_A, classified("clicks_a", "cls")) + f"""
SELECT CAST(floor(arrival_ns / {CHANGE_BATCH_NS}) AS BIGINT) AS batch_id, count(*) AS changes,
       count(DISTINCT tile_id) AS tiles
FROM cls WHERE applied AND previous_country IS NOT NULL AND previous_country <> country_id GROUP BY 1""")
def q_change_batches(spark, sf):
    from terrastate.operators.ownership import change_batches

    changes = ow.ownership_changes(ow.classify_clicks(d.clicks_a(spark, sf)))
    return change_batches(changes, CHANGE_BATCH_NS)


# --- sinks (content that is written) ------------------------------------------------

@register("snapshot_upsert", "K1", with_(CLICKS_B, own("clicks_b", "own_b")) + "SELECT * FROM own_b")
def q_snapshot_upsert(spark, sf):
    c = d.clicks_b(spark, sf)
    old = ow.current_ownership(c.filter(F.col("timestamp_ns") < F.lit(SNAPSHOT_CUT_NS)))
    new = ow.current_ownership(c.filter(F.col("timestamp_ns") >= F.lit(SNAPSHOT_CUT_NS)))
    return writers.merge_snapshot(old, new)


@register("notification_sink", "K2", _CHANGES_SQL + " AND applied")
def q_notification_sink(spark, sf):
    return writers.notification_records(ow.ownership_changes(ow.classify_clicks(d.clicks_a(spark, sf))))


@register("ownership_pages_export", "K6", with_(CLICKS_B, own("clicks_b", "own_b")) + f"""
SELECT CAST(floor(tile_id / {FIXTURE_PAGE}) AS BIGINT) AS page_no, count(*) AS n_tiles,
       string_agg(tile_id || ':' || country_id || ':' || timestamp_ns, ',' ORDER BY tile_id) AS ownerships
FROM own_b GROUP BY 1""")
def q_ownership_pages_export(spark, sf):
    pages = ow.ownership_pages(ow.current_ownership(d.clicks_b(spark, sf)), page_size=FIXTURE_PAGE)
    return writers.page_records(pages)


def _varint_sql(expr: str) -> str:
    """DuckDB: hex of the base-128 varint of a non-negative bigint expression."""
    groups = (f"list_filter(list_transform(range(10), lambda i: {{'i': i, 'g': (({expr}) >> (7 * i))}}), "
              f"lambda s: s.i = 0 OR s.g <> 0)")
    return (f"array_to_string(list_transform({groups}, lambda s, k: printf('%02X', (s.g & 127) | "
            f"CASE WHEN k < len({groups}) THEN 128 ELSE 0 END)), '')")


def _len_field_sql(tag: str, text: str) -> str:
    return f"CASE WHEN {text} = '' THEN '' ELSE '{tag}' || {_varint_sql(f'octet_length(encode({text}))')} || hex({text}) END"


def _varint_field_sql(tag: str, value: str) -> str:
    return f"CASE WHEN {value} = 0 THEN '' ELSE '{tag}' || {_varint_sql(value)} END"


def _embedded_sql(msg: str) -> str:
    return f"'0A' || {_varint_sql(f'CAST(length({msg}) / 2 AS BIGINT)')} || {msg}"


_ENTRY_SQL = _embedded_sql(f"({_len_field_sql('0A', 'country_id')} || {_varint_field_sql('10', 'score')})")
_OWN_SQL = _embedded_sql(f"({_varint_field_sql('08', 'tile_id')} || {_len_field_sql('12', 'country_id')} || "
                         f"{_varint_field_sql('18', 'timestamp_ns')})")


@register("leaderboard_reply", "L3", with_(CLICKS_B, own("clicks_b", "own_b")) + f""",
board AS (SELECT country_id, count(*) AS score FROM own_b GROUP BY country_id),
enc AS (SELECT country_id, score, {_ENTRY_SQL} AS hex FROM board)
SELECT count(*) AS entries, CAST(octet_length(unhex(string_agg(hex, '' ORDER BY score DESC, country_id))) AS BIGINT) AS bytes,
       to_base64(unhex(string_agg(hex, '' ORDER BY score DESC, country_id))) AS data FROM enc""")
def q_leaderboard_reply(spark, sf):
    return lb.leaderboard_reply(lb.leaderboard(ow.current_ownership(d.clicks_b(spark, sf))))


@register("ownership_pages_payload", "K6", with_(CLICKS_B, own("clicks_b", "own_b")) + f""",
enc AS (SELECT CAST(floor(tile_id / {FIXTURE_PAGE}) AS BIGINT) AS page_no, tile_id, {_OWN_SQL} AS hex FROM own_b)
SELECT page_no, count(*) AS n_tiles, to_base64(unhex(string_agg(hex, '' ORDER BY tile_id))) AS data FROM enc GROUP BY 1""")
def q_ownership_pages_payload(spark, sf):
    pages = ow.ownership_pages(ow.current_ownership(d.clicks_b(spark, sf)), page_size=FIXTURE_PAGE)
    return writers.page_payloads(pages)


@register("classify_clicks_split", "O3", with_(CLICKS_A, classified("clicks_a", "cls")) + "SELECT * FROM cls")
def q_classify_clicks_split(spark, sf):
    """O3 cut into many parts: most tiles cross several cuts."""
    return ow.classify_clicks(d.clicks_a(spark, sf), buckets=64)


# Ties: click times cut to two days; one instant: every click of a few hot tiles arrives at the same time.
TIE_NS = 2 * 86_400_000_000_000

_TIES = with_(CLICKS_B, f"""ties AS (SELECT tile_id, country_id, (timestamp_ns // {TIE_NS}) * {TIE_NS} AS timestamp_ns, click_id, arrival_ns FROM clicks_b)""")
_BURST = with_(CLICKS_A, "burst AS (SELECT tile_id % 3 AS tile_id, country_id, timestamp_ns, click_id, CAST(0 AS BIGINT) AS arrival_ns FROM clicks_a)")


def ties(spark, sf):
    c = d.clicks_b(spark, sf)
    return c.withColumn("timestamp_ns", F.expr(f"(timestamp_ns div {TIE_NS}) * {TIE_NS}"))


def burst(spark, sf):
    c = d.clicks_a(spark, sf)
    return c.withColumn("tile_id", F.col("tile_id") % 3).withColumn("arrival_ns", F.lit(0).cast("bigint"))


@register("ownership_lww_ties", "O1", _TIES + ", " + own("ties", "own_t") + " SELECT * FROM own_t")
def q_ownership_lww_ties(spark, sf):
    return ow.current_ownership(ties(spark, sf))


@register("classify_clicks_ties", "O3", _TIES + ", " + classified("ties", "cls") + " SELECT * FROM cls")
def q_classify_clicks_ties(spark, sf):
    return ow.classify_clicks(ties(spark, sf))


@register("classify_clicks_burst", "O3", _BURST + ", " + classified("burst", "cls") + " SELECT * FROM cls")
def q_classify_clicks_burst(spark, sf):
    """Three hot tiles whose clicks all arrive in one instant, cut by click_id."""
    return ow.classify_clicks(burst(spark, sf), buckets=32)
