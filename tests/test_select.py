import random
from datetime import date, timedelta

from lumenfold.operators import score, select

DAY = date(2026, 6, 19)


def rows_of(seed, n=400):
    r = random.Random(seed)
    lanes = ["club:day", "club:afters", "club:mainstream", "film", "stage", "live-music", "art"]
    out = []
    for i in range(n):
        s, a, tier = r.randrange(-2, 9), r.choice([None, -2, 0, 3]), r.choice([None, "must-see", "great", "solid", "skip"])
        bonus = {"must-see": 3, "great": 2, "solid": 1, "skip": -5}.get(tier, 0)
        out.append((DAY + timedelta(days=r.randrange(4)), f"k{r.randrange(n):04d}", s, a, s + (a or 0) + bonus, r.choice(lanes), tier, r.choice([None, None, f"s{r.randrange(40)}"])))
    return list({x[1]: x for x in out}.values())


DDL = "day date, key string, score int, adjust int, rank_score int, lane string, tier string, series string"
NAMES = [f.split()[0] for f in DDL.split(", ")]


def merit(row):
    return row["rank_score"], row["key"]


def may_be_picked(row, picked, gone):
    """Whether a row can still be taken beside ``picked``, ``gone`` being the better rows that were passed or taken."""
    if any(g["key"] == row["key"] for g in gone) or row["tier"] == "skip":
        return False
    if row["series"] and any(g["series"] == row["series"] and g["tier"] != "skip" and not any(h["key"] == g["key"] and merit(h) > merit(g) for h in gone) for g in gone):
        return False
    lanes = [p["lane"] for p in picked]
    return lanes.count(row["lane"]) < 2 and [x.split(":")[0] for x in lanes].count(row["lane"].split(":")[0]) < 3


def slowly_picked(rows, n):
    picked, gone = [], []
    while rows and len(picked) < n:
        best = max(rows, key=merit)
        if may_be_picked(best, picked, gone):
            picked.append(best)
        gone.append(best)
        rows = [r for r in rows if r is not best]
    return [p["key"] for p in picked]


def slowly_filled(rows, size, gap, guarantee, caps=None, least=2):
    """A slate built by looking for one row after the other."""
    caps, plain = caps or {}, lambda r: (r["score"] or 0) + (r["adjust"] or 0)
    slate, left = [], sorted(rows, key=merit)
    while left and len(slate) < size:
        row = left.pop()
        if slate and gap is not None and plain(slate[-1]) - plain(row) > gap:
            break
        if sum(s["lane"] == row["lane"] for s in slate) < caps.get(row["lane"], len(rows)):
            slate.append(row)
    for lane in guarantee:
        able = [r for r in rows if r["lane"] == lane and (r["score"] or 0) >= least]
        if able and lane not in {s["lane"] for s in slate}:
            movable = [s for s in slate if sum(t["lane"] == s["lane"] for t in slate) > 1]
            if len(slate) == size and movable:
                slate.remove(min(movable, key=merit))
            if len(slate) < size:
                slate.append(max(able, key=merit))
    return [r["key"] for r in sorted(slate, key=merit, reverse=True)]


def by_day(rows):
    return {day: [dict(zip(NAMES, x, strict=True)) for x in rows if x[0] == day] for day in {x[0] for x in rows}}


def in_order(frame):
    out = {}
    for r in sorted(frame.collect()):
        out.setdefault(r.day, []).append(r.key)
    return out


def test_top_picks_equal_a_slow_search(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        if seed == 2:  # keys that repeat, better or worse, and skipped
            rows += [(x[0], x[1], x[2], x[3], x[4] + 1, "film", "skip" if i % 2 else None, x[7]) for i, x in enumerate(rows[:80])]
        got = in_order(select.top_picks(spark.createDataFrame(rows, DDL).repartition(5), "day").orderBy("day", "place").select("day", "place", "key"))
        assert got == {day: slowly_picked(mine, 6) for day, mine in by_day(rows).items()}


def test_slates_equal_a_slow_search(spark):
    guarantee = ("club:afters", "film", "art", "stage")
    for seed, caps in ((1, None), (2, None), (3, {"film": 1, "club:day": 2}), (4, {"film": 0, "art": 1})):
        rows = rows_of(seed)
        got = in_order(select.slates(spark.createDataFrame(rows, DDL).repartition(3), 5, 7, 3, guarantee, ("club:mainstream",), caps).select("day", "place", "key"))
        mine = {day: [r for r in rs if r["lane"] != "club:mainstream"] for day, rs in by_day(rows).items()}
        assert got == {day: slowly_filled(rs, 7 if day.weekday() in (4, 5) else 5, 3, guarantee, caps) for day, rs in mine.items()}


def test_slate_rules(spark):
    def fill(rows, size, guarantee=()):
        rows = [(DAY, key, s, None, s, lane, None, None) for key, s, lane in rows]
        return in_order(select.slates(spark.createDataFrame(rows, DDL), size, size, 3, guarantee).select("day", "place", "key"))[DAY]

    assert fill([("a", 9, "x"), ("b", 5, "x")], 5) == ["a"]  # a drop of more than 3 ends the run
    assert fill([("a", 9, "x"), ("b", 8, "x"), ("c", 3, "film")], 2, ("film",)) == ["a", "c"]  # in place of the weakest
    assert fill([("a", 9, "x"), ("c", 1, "film")], 3, ("film",)) == ["a"]  # too weak to be guaranteed
    assert fill([("a", 4, "x"), ("b", 4, "x")], 2) == ["b", "a"]  # the larger key leads


def test_blocked_programme_is_consumed(spark):
    rows = [("a", 9, "x", None), ("b", 8, "x", None), ("c", 7, "x", "p"), ("d", 6, "y", "p"), ("e", 5, "y", None)]
    df = spark.createDataFrame([(DAY, k, s, None, s, lane, None, series) for k, s, lane, series in rows], DDL)
    assert in_order(select.top_picks(df, "day").select("day", "place", "key"))[DAY] == ["a", "b", "e"]


def test_settings_are_clamped():
    s = select.Selection.of({"min": "9", "perday": "x", "horizon": "-4", "days": "6,1,9", "types": "film,nope", "keys": ""}, ("film", "club"), ())
    assert s == select.Selection(5, 3, 1, (1, 6), ("film",))


def test_global_rank(spark):
    rows = [(f"{i * 7919 % 4096:03x}", i % 5) for i in range(500)]
    got = {r.key: r.final_rank for r in score.global_rank(spark.createDataFrame(rows, "key string, s int"), "s", "key").collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0]), reverse=True))}


def test_batches_are_even(spark):
    for n, k in ((10, 3), (7, 7), (3, 2), (1, 1)):
        got = sorted((r.id, r.batch) for r in select.batches(spark.range(n), k, select.F.asc("id")).collect())
        assert got == [(x, i + 1) for i in range(k) for x in range(i * n // k, (i + 1) * n // k)]


def test_lane_order(spark):
    base = {"type": "club", "vibe": ["afterhours"], "setting": ["warehouse"], "scale": None, "start": "22:00", "price": None, "afters_billed": False, "venue": "x"}
    cases = [({}, "club:underground"), ({"afters_billed": True}, "club:afters"), ({"start": "02:00"}, "club:afters"), ({"vibe": ["sunset"], "setting": []}, "club:day"), ({"vibe": [], "setting": [], "price": "$80"}, "club:mainstream"), ({"type": "live-music", "scale": "hall"}, "live-music:big"), ({"type": "film"}, "film")]
    ddl = "type string, vibe array<string>, setting array<string>, scale string, start string, price string, afters_billed boolean, venue string"
    df = spark.createDataFrame([tuple((base | c)[f.split()[0]] for f in ddl.split(", ")) for c, _ in cases], ddl)
    assert [r[0] for r in df.select(score.lane(df)).collect()] == [w for _, w in cases]
