from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import risk

T0 = datetime(2026, 1, 1)


def orders_of(spark, n):
    """One account has a third of the orders and is met in several batches."""
    rows = [(i, 0 if i % 3 == 0 else i % 7 + 1, T0 + timedelta(minutes=i), Decimal(i % 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, account_id long, ts timestamp, notional decimal(20,8)")


def test_no_account_is_one_group(spark):
    """The state goes on from batch to batch, and the plan has no operator that collects an account."""
    rows, o = orders_of(spark, 3000)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        anchored, volume = risk.anchored_limit(o, 20, 3600 * 5), risk.volume_limit(o, 300)
        got = {r.event_id: (r.window_start, r.n_in_window, r.over) for r in anchored.collect()}
        accepted = {r.event_id: r.accepted for r in volume.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    windows, sums, want, want_accepted = {}, {}, {}, {}
    for i, a, t, x in rows:
        start, n = windows.get(a, (t, 0))
        if t >= start + timedelta(hours=5):
            start, n = t, 0
        windows[a] = start, n + 1
        want[i] = start, n + 1, n + 1 > 20
        total, until, blocked = sums.get(a, (0, None, None))
        if blocked and t < blocked:
            want_accepted[i] = False
            continue
        total = 0 if until is None or t >= until else total
        want_accepted[i] = total + x <= 300
        sums[a] = (total + x, t + timedelta(days=1), blocked) if want_accepted[i] else (total, until, t + timedelta(days=1))
    assert got == want and accepted == want_accepted and not all(accepted.values())
    plan = volume._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    plan = anchored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "hashpartitioning(_who" in plan and "_start" in plan  # an account is dealt by its windows
    assert anchored.columns == [*o.columns, "window_start", "n_in_window", "over"] and volume.columns == [*o.columns, "accepted"]
    assert risk.anchored_limit(o.where(F.lit(False))).count() == 0


def test_daily_limit_blocks_for_a_day(spark):
    hours = [0, 1, 2, 3, 25, 27, 30, 60, 61, 62, 83, 85, 86, 200]
    rows = [(i, 1, T0 + timedelta(hours=h)) for i, h in enumerate(hours)] + [(100 + i, 2, T0 + timedelta(days=9 * i)) for i in range(6)]
    got = {r.event_id: (r.accepted, r.n_in_window) for r in risk.daily_order_limit(spark.createDataFrame(rows, "event_id long, account_id long, ts timestamp"), 2).collect()}
    # the third order is refused at hour 2, so orders to hour 26 are; a window opens at 27, and again at 60
    want = [(True, 1), (True, 2), (False, 3), (False, 3), (False, 3), (True, 1), (True, 2), (True, 1), (True, 2), (False, 3), (False, 3), (False, 3), (True, 1), (True, 1)]
    assert got == dict(enumerate(want)) | {100 + i: (True, 1) for i in range(6)}  # six orders over weeks are no excess
    assert risk.DAILY_LIMIT in risk.daily_order_limit.__defaults__


def test_windows_by_pointers_equal_the_counter_in_turn(spark):
    """Gaps, equal times, times before 1970, at the bounds of windows, null times, a null account, an account without times."""
    import random

    rnd, rows = random.Random(2), []
    for i in range(1500):
        who = rnd.choice([0, 0, 0, 1, 2, None, 4])
        at = {1: rnd.randrange(0, 40) * 60, 2: rnd.randrange(0, 9) * 1000 - 5000, 4: None}.get(who, rnd.randrange(-3000, 9000))
        rows.append((i, who, None if at is None or rnd.random() < 0.03 else datetime(1970, 1, 1) + timedelta(seconds=at)))
    windows, want = {}, {}
    for i, a, t in sorted(rows, key=lambda x: (x[2] is None, x[2] or T0, x[0])):
        start, n = windows.get(a, (t, 0))
        if t is not None and start is not None and t >= start + timedelta(seconds=60):
            start, n = t, 0
        windows[a] = start, n + 1
        want[i] = start, n + 1, n + 1 > 3
    o = spark.createDataFrame(rows, "event_id long, account_id long, ts timestamp")
    assert {r.event_id: (r.window_start, r.n_in_window, r.over) for r in risk.anchored_limit(o, 3, 60).collect()} == want
    times = spark.range(0, 5000).selectExpr("struct(1L AS user) AS who", "id * 7 AS at")  # one long chain without a gap
    assert sorted(r.at for r in risk.window_starts(times, 10).collect()) == [14 * k for k in range(2500)]
