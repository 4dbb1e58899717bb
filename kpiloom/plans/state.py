"""First events kept from day to day.

Table1 counts members and buyers by the day of their first event, so a plain
run reads the whole login and order history each day. ``FirstEvents`` keeps the
first event of every member and of every (city, buyer) and merges a day's new
and changed rows into it. A changed order can only harm a key whose stored
first order it is: these keys alone are replayed from the history. Each state
is committed as a whole (``kpiloom.sources.bundles``) with the rules that it
was made by; other rules (geography, accounts, user rules) mean a full rebuild.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.relational import keep_matching
from kpiloom.plans.facts import ARRIVAL, KeyedFrames, Model
from kpiloom.sources import ingest
from kpiloom.sources.bundles import Bundle, committed

BUYERS, LOGINS = "first_purchase", "first_app_login"
KEYS = ["city", "username"]


def first_purchases(events: DataFrame) -> DataFrame:
    """(city, username, day, number, order_id, paid_date) of the first event of each key in order of arrival."""
    day, number, order_id = map(F.expr, ARRIVAL)
    first = F.min(F.struct(day.alias("day"), number.alias("number"), order_id.alias("order_id"), "paid_date"))
    return events.groupBy(*KEYS).agg(first.alias("first")).select(*KEYS, "first.*")


def _merge_purchases(state: DataFrame) -> DataFrame:
    first = F.min(F.struct("day", "number", "order_id", "paid_date"))
    return state.groupBy(*KEYS).agg(first.alias("first")).select(*KEYS, "first.*")


class FirstEvents:
    """Stored first events under ``base``; ``advance`` brings them to a day, ``use`` gives them to a model."""

    def __init__(self, base: str):
        self.base = base

    @staticmethod
    def rules(k: KeyedFrames) -> str:
        """Fingerprint of the parameters that decide which events count."""
        p = k.p
        told = (p.provinces, p.cities, p.excluded_districts, p.municipalities, p.test_accounts, p.x_area_ids, p.dropped_area_ids,
                p.x_user_pattern, p.app_login_method, p.app_success_prefix, k.accounts.frame is not None)
        return hashlib.sha1(repr(told).encode()).hexdigest()

    def days(self, spark) -> dict[str, dict]:
        return committed(spark, self.base, BUYERS)

    def read(self, spark, name: str, day: dt.date) -> DataFrame:
        return spark.read.parquet(committed(spark, self.base, name)[day.isoformat()]["path"])

    def rebuild(self, m: Model, day: dt.date) -> None:
        """The state as of ``day`` from the whole history."""
        self._store(m.keyed, day, first_purchases(m.keyed.buyer_events(m.keyed.orders)), m.keyed.app_first)

    def advance(self, m: Model, day: dt.date, changed_orders: DataFrame, new_app_rows: DataFrame) -> str:
        """Merge the rows since the last state: "advanced", or "rebuilt" without a state of the same rules.

        ``changed_orders`` (raw order rows as they are now) holds every order
        that is new or differs from what the last state saw, whatever its
        status; a deleted order is given with a status that does not count.
        ``new_app_rows`` holds the app log since then (the log only grows).
        The model's order table is the history as it is now.
        """
        k, spark = m.keyed, changed_orders.sparkSession
        before = {d: r for d, r in self.days(spark).items() if d <= day.isoformat()}
        last = max(before, default=None)
        if last is None or before[last]["note"] != self.rules(k):
            self.rebuild(m, day)
            return "rebuilt"
        state = self.read(spark, BUYERS, dt.date.fromisoformat(last))
        changed = KeyedFrames(_With(k.raw, order=changed_orders, app_log=new_app_rows), k.p, k.accounts.frame is not None, snapshot=False)
        changed.__dict__["area"] = k.area
        touched = changed_orders.select(ingest.key(changed_orders, "id", "order_id"))
        broken = keep_matching(state, touched, "order_id").select(*KEYS)
        kept = state.join(touched.select(F.col("order_id").alias("t")), F.col("order_id") == F.col("t"), "left_anti")
        parts = kept.unionByName(first_purchases(changed.buyer_events(changed.orders)))
        if broken.take(1):
            again = broken.select(F.col("city").alias("c"), F.col("username").alias("u"))
            events = k.buyer_events(k.orders).join(again, (F.col("city") == F.col("c")) & (F.col("username") == F.col("u")), "left_semi")
            parts = parts.unionByName(first_purchases(events))
        logins = self.read(spark, LOGINS, dt.date.fromisoformat(last)).unionByName(changed.app_first) \
            .groupBy("member_id").agg(F.min("first_login_date").alias("first_login_date"))
        self._store(k, day, _merge_purchases(parts), logins)
        return "advanced"

    def _store(self, k: KeyedFrames, day: dt.date, buyers: DataFrame, logins: DataFrame) -> None:
        b = Bundle(buyers.sparkSession, self.base)
        b.stage(BUYERS, buyers, day)
        b.stage(LOGINS, logins, day)
        b.commit(self.rules(k))

    def use(self, m: Model) -> None:
        """Let the model's table1 read the state of its report date; an error if there is none by its rules."""
        spark, day = m.raw.order.sparkSession, m.p.report_date
        found = self.days(spark).get(day.isoformat())
        if found is None or found["note"] != self.rules(m.keyed):
            raise ValueError(f"{self.base}: no first events as of {day} by these rules; advance them first")
        m.keyed.__dict__["buyer_first"] = self.read(spark, BUYERS, day).select(*KEYS, "paid_date")
        m.keyed.__dict__["app_first"] = self.read(spark, LOGINS, day)


class _With:
    """Raw tables with some replaced."""

    def __init__(self, raw, **over):
        self.__dict__.update(over)
        self.__dict__["_raw"] = raw

    def __getattr__(self, name: str):
        return getattr(self.__dict__["_raw"], name)
