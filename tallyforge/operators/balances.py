"""Balances projected from the ledger, running balances and risk states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.sums import running

BALANCE = "decimal(20,8)"
#: Ledger ids in a run, of which a task sees a hot account's rows at once; rows that make a key hot.
RUN = 1 << 18


def project_balances(entries: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(account_id, asset, available, locked): posted amounts summed and added to the previous balances, 0 where there are none."""
    moved = entries.groupBy("account_id", F.upper("asset").alias("asset")).agg(F.sum("amount").alias("moved"))
    if previous is None:
        return moved.select("account_id", "asset", F.coalesce("moved", F.lit(0)).cast(BALANCE).alias("available"), F.lit(0).cast(BALANCE).alias("locked"))
    before = previous.select("account_id", F.upper("asset").alias("asset"), "available", "locked")
    both = before.join(moved, ["account_id", "asset"], "full_outer")
    zero = F.lit(0)
    return both.select("account_id", "asset", (F.coalesce("available", zero) + F.coalesce("moved", zero)).cast(BALANCE).alias("available"), F.coalesce("locked", zero).cast(BALANCE).alias("locked"))


def balances_view(balances: DataFrame) -> DataFrame:
    """With total and whether the available balance is negative."""
    return balances.select("account_id", "asset", "available", "locked", (F.col("available") + F.col("locked")).cast(BALANCE).alias("total"), (F.col("available") < 0).alias("negative"))


def running_balance(ledger: DataFrame) -> DataFrame:
    """Each ledger row with its account's balance in the asset after it."""
    found = _balances(ledger.withColumn("_asset", F.upper("asset")), ["account_id", "_asset"])
    return found.select(*ledger.columns, "balance")


def _balances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with balance: the sum of a key's amounts up to the row's id.

    A key of more than RUN rows is summed in two levels, runs of ids and ids within a run, so that the history of a hot account is not one
    task; there is at most one such key for RUN rows. The others move once.
    """
    hot = F.broadcast(rows.groupBy(*keys).count().where(F.col("count") > RUN).select(*[F.col(k).alias(f"_{k}_hot") for k in keys]))
    same = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}_hot"))
    for k in keys[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_hot"))
    amount = F.coalesce("amount", F.lit(0))
    so_far = Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    few = rows.join(hot, same, "left_anti").withColumn("balance", F.sum(amount).over(so_far).cast("decimal(38,8)"))
    many = running(rows.join(hot, same, "left_semi").withColumn("_run", F.floor(F.col("id") / RUN)), keys, "_run", ["id"], F.col("amount"), "_before")
    return few.unionByName(many.select(*rows.columns, (F.col("_before") + amount).cast("decimal(38,8)").alias("balance")))


def first_breach(ledger: DataFrame) -> DataFrame:
    """(account_id, asset, id, balance): the first posting after which the balance is negative."""
    keys = ["account_id", "asset"]
    below = _balances(ledger.select("id", "account_id", F.upper("asset").alias("asset"), "amount"), keys).where(F.col("balance") < 0)
    return below.groupBy(*keys).agg(F.min("id").alias("id"), F.min_by("balance", "id").alias("balance"))


def accounts_by_status(states: DataFrame, status: str = "BLOCKED") -> DataFrame:
    """The states of blocked, or of normal, accounts."""
    return states.where(F.col("status") == status)


def risk_state(balances: DataFrame, previous: DataFrame | None = None, escalations: DataFrame | None = None) -> DataFrame:
    """(account_id, status, block_reason): BLOCKED if any available balance is negative, with the first such asset by name as the
    reason, or if order floods (rows of risk.flood_escalation() with an action) blocked the account, with the first of them as the reason;
    a negative balance stands before floods, and an account that was blocked before keeps its reason."""
    bad = F.col("available") < 0
    reason = F.concat(F.lit("Negative balance: "), F.upper("asset"), F.lit(" = "), F.col("available").cast("string"))
    now = balances.groupBy("account_id").agg(F.min_by(F.when(bad, reason), F.when(bad, F.upper("asset"))).alias("reason"))
    if escalations is not None:
        flood = F.concat(F.lit("Order flood: "), F.col("n_recent").cast("string"), F.lit(" times"))
        floods = escalations.where(F.col("action").isNotNull()).groupBy("account_id").agg(F.min_by(flood, F.struct("detected_at", "n_recent")).alias("flood"))
        now = now.join(floods, "account_id", "full_outer").select("account_id", F.coalesce("reason", "flood").alias("reason"))
    if previous is not None:
        old = previous.select("account_id", F.when(F.col("status") == "BLOCKED", F.coalesce("block_reason", F.lit(""))).alias("kept"))
        now = now.join(old, "account_id", "full_outer").select("account_id", F.coalesce("kept", "reason").alias("reason"))
    return now.select("account_id", F.when(F.col("reason").isNull(), "NORMAL").otherwise("BLOCKED").alias("status"), F.col("reason").alias("block_reason"))


def risk_commands(old: DataFrame, new: DataFrame) -> DataFrame:
    """(account_id, command_type, reason): one command for each account whose status changed."""
    before = old.select("account_id", F.col("status").alias("was"))
    both = new.join(before, "account_id", "left").where(F.coalesce("was", F.lit("NORMAL")) != F.col("status"))
    return both.select("account_id", F.when(F.col("status") == "BLOCKED", "BLOCK_ACCOUNT").otherwise("UNBLOCK_ACCOUNT").alias("command_type"),
        F.when(F.col("status") == "BLOCKED", F.col("block_reason")).alias("reason"))
