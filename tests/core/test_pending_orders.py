from tallyforge.plans import trading_plans
from tallyforge.sources.views import TRADING_ORDERS, view


def test_pending_orders_of_all_users(spark, sf):
    want = {r.order_id: r.user_id for r in view(spark, sf, TRADING_ORDERS).where("status = 'NEW'").collect()}
    got = trading_plans.QUERIES["pending_orders_all"](spark, sf).collect()
    assert {r.order_id: r.user_id for r in got} == want and len(got) == len(want)
    assert any(not 30 <= u <= 60 for u in want.values())
