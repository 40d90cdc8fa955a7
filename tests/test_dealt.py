"""The general operators against brute force and for their defined cases."""

import datetime as dt
import math
import random
import re
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tideline.operators.asof import asof_join
from tideline.operators.faults import flag_faults
from tideline.operators.grid import micros, regular_grid
from tideline.operators.stamps import normalise_feeds
from tideline.operators.trailing import trailing_totals
from tideline.operators.versions import as_known

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 1, 12)


def us(t):
    return int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


# -- irregular readings onto a grid


def test_grid_against_brute_force(spark):
    r = random.Random(1)
    ses = [(T0.date() + dt.timedelta(d), T0 + dt.timedelta(days=d, hours=10), T0 + dt.timedelta(days=d, hours=11, minutes=r.choice([0, 5, 30])), "x") for d in range(4)] + [(T0.date() + dt.timedelta(5), None, None, "x"), (T0.date() + dt.timedelta(6), T0 + dt.timedelta(days=6, hours=23, minutes=30), T0 + dt.timedelta(days=7, minutes=40), "late")]
    src = [("hot", "2026-01-13"), ("b", "2020-01-01"), ("none", None), ("bad", "soon"), ("after", "2030-01-01"), (None, "2020-01-01")]
    read = []
    for _ in range(800):
        t = T0 + dt.timedelta(days=r.choice([0, 1, 1, 2, 3, 6, 7]), hours=r.choice([9, 10, 10, 10, 11, 23, 0]), seconds=r.randrange(3600))
        read.append((r.choice(["hot"] * 6 + ["b", "none", None]), r.choice([t, t, t, None]), r.choice([1.0, 2.0, 5.0, 0.0, -1.0, None, float("nan"), float("inf")]), "extra"))
    read += read[:100]
    readings = spark.createDataFrame(read, "secid string, timestamp timestamp_ntz, close double, slot string")
    sources = spark.createDataFrame(src, "secid string, since string")
    sessions = spark.createDataFrame(ses, "session_date date, open_at timestamp_ntz, close_at timestamp_ntz, session_note string")
    got = {(x["source"], x["slot_us"]): x for x in regular_grid(readings, sources, sessions).collect()}
    ok = sorted({(s, us(t), v) for s, t, v, _ in read if s and t and v and 0 < v < math.inf}, key=lambda x: x[1:])
    step, want = 600_000_000, {}
    for s, since in (("hot", dt.date(2026, 1, 13)), ("b", dt.date(2020, 1, 1))):
        for day, a, b, _ in ses:
            if a is None or day < since:
                continue
            end = us(a) + -(-(us(b) - us(a)) // step) * step
            mine = [(t, v) for k, t, v in ok if k == s and us(a) <= t < end]
            for at in range(us(a), us(b), step):
                inside = [(t, v) for t, v in mine if at <= t < at + step]
                p, n = [x for x in mine if x[0] < at], [x for x in mine if x[0] >= at]
                value = inside[0][1] if inside else None
                if n and n[0][0] == at:
                    value = n[0][1]
                elif p and n and n[0][0] - p[-1][0] <= 1800e6:
                    value = p[-1][1] + (n[0][1] - p[-1][1]) * (at - p[-1][0]) / (n[0][0] - p[-1][0])
                want[s, at] = (value, "observed" if inside else "missing" if value is None else "filled")
    assert set(got) == set(want)
    for k, (value, mark) in want.items():
        assert got[k]["mark"] == mark, k
        assert (got[k]["value"] is None) == (value is None) and (value is None or abs(got[k]["value"] - value) < 1e-9), k
    for a, b, c_ in ((readings.limit(0), sources, sessions), (readings, sources.limit(0), sessions), (readings, sources, sessions.limit(0))):
        assert regular_grid(a, b, c_).where("mark <> 'missing'").count() == 0


# -- time texts

MONTH = {m: i // 2 + 1 for i, m in enumerate("jan января feb февраля mar марта apr апреля may мая jun июня jul июля aug августа sep сентября oct октября nov ноября dec декабря".split())}


def by_hand(text, zone, order):
    """A second reading of the same formats, written step by step in Python."""
    if text is None:
        return None
    t = re.sub(r"\s+", " ", "".join(str(int(ch)) if ch.isdigit() else ch for ch in text).replace("−", "-")).strip()
    tz, off = zone, None
    m = re.fullmatch(r"(\d{10})\.(\d+)", t)
    if m:
        return int(m[1]) * 10**6 + int((m[2] + "000000")[:6])
    if re.fullmatch(r"\d+", t) and len(t) in (10, 13, 16, 19):
        return int(t) * 10**6 // 10 ** (len(t) - 10)
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d)?)?", t)
    if m:
        y, mo, d, h, i, s = (int(x or 0) for x in m.groups())
        frac = 0
    else:
        t = re.sub(r"\[.*\]$", "", t) if re.search(r"[+-]\d\d(:?\d\d)?\[", t) else t
        t = re.sub(r"^\w{3}, ", "", t)
        m = re.match(r"(\d{4})[-/](\d\d)[-/](\d\d)", t)
        if m:
            y, mo, d = map(int, m.groups())
        elif m := re.match(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d\d)(?!\d)", t):
            a, b, y = map(int, m.groups())
            y += 2000 if y < 100 else 0
            d, mo = (b, a) if order == "mdy" else (a, b)
        elif m := re.match(r"(\d{1,2}) (\w+) (\d{4})( г\.)?", t):
            d, mo, y = int(m[1]), MONTH.get(m[2].lower()[:3] if m[2].isascii() else m[2].lower()), int(m[3])
        elif m := re.match(r"([A-Za-z]+) (\d{1,2}), (\d{4})", t):
            d, mo, y = int(m[2]), MONTH.get(m[1].lower()[:3]), int(m[3])
        else:
            return None
        rest = t[m.end() :]
        h = i = s = frac = 0
        if rest:
            m = re.fullmatch(r"(?:T| |, )(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ([ap])\.?m(?![a-z])\.?)?(?: ?(.+))?", rest, re.I)
            if not m:
                return None
            h, i, s = int(m[1]), int(m[2]), int(m[3] or 0)
            frac = int(((m[4] or "") + "000000")[:6])
            if m[5]:
                h = h % 12 + 12 * (m[5].lower() == "p")
            if z := m[6]:
                fixed = {"Z": 0, "z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240}
                if z in fixed:
                    off = fixed[z]
                elif n := re.fullmatch(r"([+-])(\d\d):?(\d\d)?", z):
                    off = (-1 if n[1] == "-" else 1) * (int(n[2]) * 60 + int(n[3] or 0))
                else:
                    tz = {"MSK": "Europe/Moscow"}.get(z, z.strip("[]"))
    try:
        wall = dt.datetime(y, mo, d, h, i, s, frac)
    except (ValueError, TypeError):
        return None
    if off is not None:
        return us(wall) - off * 60_000_000
    try:
        local = wall.replace(tzinfo=ZoneInfo(tz), fold=int(text.rstrip().endswith("MSK")))
    except Exception:
        return None
    back = local.astimezone(UTC).astimezone(ZoneInfo(tz)).replace(tzinfo=None)
    return us(local.astimezone(UTC).replace(tzinfo=None)) if back == wall else None


def test_stamps_against_a_second_reader(spark):
    sf = "/root/testdata/sf0.01"
    got = normalise_feeds(spark.read.parquet(f"{sf}/raw_stamps.parquet"), spark.read.parquet(f"{sf}/feed_registry.parquet")).toPandas()
    reg = {x["feed"]: x for x in spark.read.parquet(f"{sf}/feed_registry.parquet").collect()}
    assert len(got) == 2000
    for x in got.itertuples():
        want = by_hand(x.stamp_text, reg[x.feed]["zone_id"], reg[x.feed]["date_order"])
        have = None if x.utc_micros != x.utc_micros else int(x.utc_micros)
        assert have == want, (x.stamp_text, x.feed, x.stamp_status, have, want)


@pytest.mark.parametrize(
    ("text", "feed", "want", "status"),
    [
        ("2021-03-28 02:30", "berlin", None, "never_shown"),
        ("2021-10-31 02:30", "berlin", "2021-10-31 00:30:00", "ok"),
        ("2021-10-31T02:30:00+01:00[Europe/Berlin]", "berlin", "2021-10-31 01:30:00", "ok"),
        ("03/04/05", "york", "2005-03-04 05:00:00", "ok"),
        ("03/04/05", "berlin", "2005-04-02 22:00:00", "ok"),
        ("2013-07-01 12:00 MSK", "york", "2013-07-01 08:00:00", "ok"),
        ("2014-10-26 01:30 MSK", "york", "2014-10-25 22:30:00", "ok"),
        ("2014-10-26 01:30 Europe/Moscow", "york", "2014-10-25 21:30:00", "ok"),
        ("2014-10-26 00:30 MSK", "york", "2014-10-25 20:30:00", "ok"),
        ("2014-10-26 02:30 MSK", "york", "2014-10-25 23:30:00", "ok"),
        ("12:30", "berlin", None, "unreadable"),
        ("2021-02-29", "berlin", None, "impossible"),
        ("2020-02-29", "berlin", "2020-02-28 23:00:00", "ok"),
        ("2020-02-29 13:00 pm", "berlin", None, "impossible"),
        ("2020-02-29 12:00 a.m.", "berlin", "2020-02-28 23:00:00", "ok"),
        ("  ", "berlin", None, "no_text"),
        ("5 мая 2020 г., 7:05", "berlin", "2020-05-05 05:05:00", "ok"),
        ("2020-05-05 07:05 Mars/Base", "berlin", None, "unreadable"),
        ("x" * 100_000, "berlin", None, "unreadable"),
        ("2020-05-05", "nowhere", None, "no_text"),
    ],
)
def test_stamp_cases(spark, text, feed, want, status):
    reg = spark.createDataFrame([("berlin", "dt_msk", "Europe/Berlin", "dmy"), ("york", "dt_msk", "America/New_York", "mdy"), ("york", "dt_msk", "America/New_York", "dmy")], "feed string, field_name string, zone_id string, date_order string")
    df = spark.createDataFrame([(1, feed, None, text, None, "z")], "record_id long, feed string, trade_date string, dt_msk string, observed_at string, zone string")
    (x,) = normalise_feeds(df, reg).collect()
    assert x["stamp_status"] == status and x["zone"] == "z"
    assert x["utc_micros"] == (None if want is None else us(dt.datetime.fromisoformat(want)))
    assert normalise_feeds(df.limit(0), reg).count() == 0


# -- implausible readings


def candles(r, name, n, sigma, flat=0.0, start=T0):
    p, rows = 100.0, []
    for i in range(n):
        o = p
        if r.random() >= flat:
            p = p * math.exp(r.gauss(0, sigma))
        hi, lo = max(o, p) * (1 + abs(r.gauss(0, sigma)) / 2), min(o, p) * (1 - abs(r.gauss(0, sigma)) / 2)
        rows.append([name, start + dt.timedelta(hours=i), o, hi, lo, p, None])
    return rows


def test_faults_are_found_and_nothing_else(spark):
    r = random.Random(4)
    calm, lazy, jump = candles(r, "calm", 9000, 0.001), candles(r, "lazy", 900, 0.002, 0.5), candles(r, "jump", 800, 0.003)
    for x in jump[400:]:
        x[2:6] = [v * 1.5 for v in x[2:6]]
    bad = set()

    def spike(rows, i, k, n=1):
        for j in range(i, i + n):
            rows[j][5] *= k
            rows[j][3], rows[j][4] = max(rows[j][3], rows[j][5]), min(rows[j][4], rows[j][5])
            bad.add((rows[j][0], j, "spike"))

    spike(calm, 50, 1.05), spike(calm, 4095, 0.94), spike(calm, 4096 + 4000, 10.0, 3), spike(jump, 100, 0.9, 2), spike(lazy, 300, 1.1)
    calm[700][3] *= 1.04
    bad.add(("calm", 700, "wick"))
    for j in range(1001, 1012):
        calm[j][5] = calm[1000][5]
        calm[j][3], calm[j][4] = max(calm[j][3], calm[j][5]), min(calm[j][4], calm[j][5])
        bad.add(("calm", j, "stuck"))
    lazy[10][5], lazy[20][3], lazy[20][4], lazy[30][4] = -1.0, lazy[20][4], lazy[20][3], 0.0
    bad |= {("lazy", 10, "impossible"), ("lazy", 20, "impossible"), ("lazy", 30, "impossible")}
    lazy[40][5] = None
    rows = calm + lazy + jump
    late = [[*x[:6], T0 + dt.timedelta(days=900)] for x in calm[:30]]
    df = spark.createDataFrame(rows + rows[:50] + late + [[None, T0, 1.0, 1.0, 1.0, 1.0, None], ["calm", None, 1.0, 1.0, 1.0, 1.0, None]], "secid string, dt_msk timestamp_ntz, open double, high double, low double, close double, fetched_at timestamp_ntz").withColumn("us", F.lit("clash"))
    got = flag_faults(df, per_block=1000).toPandas()
    assert len(got) == len(rows)
    order = lambda x: x.sort_values(["source", "us"]).reset_index(drop=True)
    assert order(got).equals(order(flag_faults(df).toPandas()))  # blocks change nothing
    found = {(x.source, (x.us - us(T0)) // 3_600_000_000, k) for x in got.itertuples() for k in ("spike", "wick", "stuck", "impossible") if getattr(x, k)}
    assert bad <= found, bad - found
    extra = {x for x in found - bad if x[2] != "impossible" and not (x[0], x[1]) in {(b[0], b[1]) for b in bad}}
    assert not extra, extra
    assert flag_faults(df.limit(0)).count() == 0
    few = flag_faults(df.where("secid = 'calm'").limit(2))
    assert few.where("spike or stuck").count() == 0


# -- attributes as known


def test_versions_against_brute_force(spark):
    r = random.Random(5)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    rel = [(i, r.choice(["hot"] * 5 + ["b", None]), r.choice([day(r.randrange(20))] * 6 + [None]), r.choice([at(r.randrange(480))] * 6 + [None]), r.choice([1.0, None])) for i in range(300)]
    rel += rel[:60]
    ev = [(i, r.choice(["hot"] * 5 + ["b", "c", None]), r.choice([at(r.randrange(600))] * 6 + [None]), "e") for i in range(500)]
    ev += ev[:50]
    releases = spark.createDataFrame(rel, "release_id long, provider string, observation_date date, known_at timestamp_ntz, policy_rate_pct double")
    events = spark.createDataFrame(ev, "quote_id long, provider string, available_at timestamp_ntz, release_id string")
    eligible = F.when(F.col("known_at").isNotNull() & F.col("observation_date").isNotNull(), F.greatest(micros(F.col("known_at")), micros(F.col("observation_date"))))

    def run(e, x):
        return as_known(e, x, entity="provider", event_us=micros(F.col("available_at")), eligible_us=eligible, rank=["observation_date", "known_at", "release_id"], attributes=["release_id", "policy_rate_pct"], per_block=40)

    got = sorted((x["quote_id"], x["known_release_id"] if x["known_release_id"] is not None else -1, x["release_id"]) for x in run(events, releases).collect())
    want = []
    for q, p, t, e in ev:
        ok = [(o, k, i) for i, p2, o, k, _ in rel if p and p2 == p and o and k and t and k <= t and o <= t.date()]
        want.append((q, max(ok)[2] if ok else -1, e))
    assert got == sorted(want)
    assert run(events.limit(0), releases).count() == 0
    assert run(events, releases.limit(0)).where("known_release_id is not null").count() == 0 and run(events, releases.limit(0)).count() == len(ev)


@pytest.mark.parametrize(("strict", "forward", "tolerance"), [(False, False, None), (True, False, 7200), (False, True, None), (True, True, 3600)])
def test_asof_against_brute_force(spark, strict, forward, tolerance):
    r = random.Random(6)
    at = lambda: r.choice([T0 + dt.timedelta(minutes=30 * r.randrange(100))] * 8 + [None])
    left = [(i, r.choice(["a"] * 6 + ["b", None]), at()) for i in range(300)]
    right = [(r.choice(["a"] * 3 + ["b", "c", None]), at(), i) for i in range(80)]
    ldf, rdf = spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, t timestamp_ntz, v int")
    got = {x["id"]: x["asof_v"] for x in asof_join(ldf, rdf, by="k", left_on="t", right_on="t", columns=["v"], strict=strict, forward=forward, tolerance_s=tolerance, per_block=20).collect()}
    sign = -1 if forward else 1
    want = {}
    for i, k, t in left:
        ok = [(sign * us(u), v) for k2, u, v in right if k and k2 == k and t and u and (sign * us(u) < sign * us(t) or (u == t and not strict))]
        best = max(ok) if ok else None
        want[i] = None if best is None or (tolerance is not None and abs(best[0] * sign - us(t)) > tolerance * 1e6) else best[1]
    assert got == want


# -- trailing periods


def test_trailing_totals_against_brute_force(spark):
    r = random.Random(7)
    d0 = dt.date(2025, 1, 1)
    rows = {}
    for e in ("a", "b"):
        for _ in range(60):
            d = d0 + dt.timedelta(r.randrange(120))
            rows[e, d] = (e, d, r.choice([1.5, 2.0, 0.0, None, float("nan")]), r.choice([1.25, -2.0, None]), None)
    rows["one", d0] = ("one", d0, 1.0, 1.0, None)
    data = list(rows.values())
    df = spark.createDataFrame(data + data[:40] + [(None, d0, 1.0, 1.0, None), ("a", None, 1.0, 1.0, None)], "entity string, day date, close double, regret double, fetched_at timestamp_ntz")
    got = trailing_totals(df, entity="entity", day="day", values={"close": "close <> 0", "regret": "true"}, periods=(7, 30), latest="fetched_at").collect()
    seen = {}
    for x in got:
        seen[x["entity"], x["day"]] = x
    assert len(seen) == len(got)
    for e in ("a", "b", "one"):
        days = [d for k, d in rows if k == e]
        assert {d for k, d in seen if k == e} == {min(days) + dt.timedelta(i) for i in range((max(days) - min(days)).days + 1)}
    for (e, d), x in seen.items():
        for n in (7, 30):
            win = [rows[e, d - dt.timedelta(i)] for i in range(n) if (e, d - dt.timedelta(i)) in rows]
            close = [w[2] for w in win if w[2] and not math.isnan(w[2])]
            regret = [w[3] for w in win if w[3] is not None]
            assert x[f"close_n_{n}"] == len(close) and abs(x[f"close_sum_{n}"] - sum(close)) < 1e-9 and abs(x[f"regret_sum_{n}"] - sum(regret)) < 1e-9
            assert (x[f"close_mean_{n}"] is None) == (not close) and (not close or abs(x[f"close_mean_{n}"] - sum(close) / len(close)) < 1e-9)
    assert trailing_totals(df.limit(0), entity="entity", day="day", values={"close": "true"}).count() == 0
