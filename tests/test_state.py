"""First events kept from day to day equal the recomputation from the whole history."""

import datetime as dt
import random
from dataclasses import replace

import pytest

from helpers import rows
from kpiloom.plans import reports as R
from kpiloom.plans.facts import Model
from kpiloom.plans.state import BUYERS, KEYS, LOGINS, FirstEvents
from kpiloom.sources.raw import RAW_SCHEMAS
from rawfixture import PARAMS, raw_tables

START = dt.date(2024, 3, 1)
APP = "app_log"


def simulated(days=10, seed=4):
    """Per day: the order history as it is then, the orders that are new or changed, and the day's app log."""
    rng = random.Random(seed)
    history, out = {}, []
    for d in range(days):
        at = dt.datetime.combine(START + dt.timedelta(d), dt.time(9))
        changed = set()
        for _ in range(12):
            i = 1000 + len(history)
            area = rng.choice((1, 2, 3, 5, 6, 7, 970, None))
            history[i] = [i, f"S{i}", at, rng.choice((at, at, None)), None, rng.choice((1, 2, 2, 3, 4)), 10, rng.choice([f"u{k}" for k in range(9)] + ["uX", None]),
                          area, 1.0, None, None, 1, 0]
            changed.add(i)
        for i in rng.sample(sorted(history), min(len(history), 6)) if d else ():   # late changes, also of first orders
            o = history[i]
            what = rng.choice(("status", "status", "area", "paid", "user"))
            if what == "status":
                o[5] = rng.choice((1, 3, 3))
            elif what == "area":
                o[8] = rng.choice((1, 3, 7))
            elif what == "paid":
                o[3] = at
            else:
                o[7] = rng.choice(("u1", "u2", "test1"))
            changed.add(i)
        if d == 5:   # the first order of every buyer of a city is cancelled
            first = {}
            for i in sorted(history):
                first.setdefault((history[i][8], history[i][7]), i)
            for i in list(first.values())[:8]:
                history[i][5] = 3
                changed.add(i)
        app = [(at, rng.choice((10, 12, 14, 15)), "app", rng.choice(("userLogin", "other")), rng.choice(('{"code":1,"x"}', '{"code":0,'))) for _ in range(3)]
        out.append((START + dt.timedelta(d), [tuple(o) for o in history.values()], [tuple(history[i]) for i in sorted(changed)], app))
    return out


def test_ten_days_equal_the_full_recomputation(spark, tmp_path):
    state, log, told, replayed = FirstEvents(str(tmp_path / "state")), [], [], 0
    for day, history, changed, app in simulated():
        log += app
        m = Model(raw_tables(spark, order=history, app_log=log), replace(PARAMS, report_date=day), snapshot=False)
        given = (spark.createDataFrame(changed, RAW_SCHEMAS["order"]), spark.createDataFrame(app, RAW_SCHEMAS[APP]))
        told.append(state.advance(m, day, *given))
        buyers, logins = state.read(spark, BUYERS, day), state.read(spark, LOGINS, day)
        assert rows(buyers.select(*KEYS, "paid_date")) == rows(m.keyed.buyer_first), day
        assert rows(logins) == rows(m.keyed.app_first), day
    assert told == ["rebuilt"] + ["advanced"] * 9
    full = rows(R.report_new_users(m))
    state.use(m)
    assert m.keyed.buyer_first.inputFiles() and rows(R.report_new_users(m)) == full
    # the same day again changes nothing
    assert state.advance(m, day, *given) == "advanced"
    assert rows(state.read(spark, BUYERS, day).select(*KEYS, "paid_date")) == rows(Model(m.raw, m.p, snapshot=False).keyed.buyer_first)
    # other rules: a full rebuild, and no use without one
    other = Model(m.raw, replace(m.p, cities=("C1",)), snapshot=False)
    with pytest.raises(ValueError, match="no first events"):
        state.use(other)
    assert state.advance(other, day, *given) == "rebuilt"
    assert {r.city for r in state.read(spark, BUYERS, day).collect()} == {"C1"}


def test_daily_run_with_state_writes_the_same_table1(spark, tmp_path):
    from kpiloom.plans.daily import run_daily
    from kpiloom.sources.bundles import read_bundle

    raw = raw_tables(spark)
    state = FirstEvents(str(tmp_path / "state"))
    with pytest.raises(ValueError, match="no first events"):
        run_daily(raw, PARAMS, str(tmp_path / "a"), state=state)
    state.rebuild(Model(raw, PARAMS, snapshot=False), PARAMS.report_date)
    run_daily(raw, PARAMS, str(tmp_path / "a"), state=state, materialize=False)
    got = rows(read_bundle(spark, str(tmp_path / "a"), "table1_new_users").drop("report_date"))
    assert got == rows(R.report_new_users(Model(raw, PARAMS, snapshot=False)))
