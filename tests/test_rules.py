"""The rules that results hang on, on a few literal rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from saleglass.functions import stats
from saleglass.functions import text as x
from saleglass.operators import catalogue as cat
from saleglass.operators import exports, learned, merges, partitions, readings, roster
from saleglass.operators import titles as tt
from saleglass.operators.titles import STANDARD, Vocabulary, parse_titles
from saleglass.plans import joins, pages, rollups
from saleglass.plans import titles as said


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("values", "p90", "floor", "middle"), [([1, 2, 10, 20], 20, 2, 6.0), ([5], 5, 5, 5.0), ([3, 1, 2], 3, 2, 2.0), (list(range(1, 12)), 10, 6, 6.0), ([], None, None, None)])
def test_ranks(spark, values, p90, floor, middle):
    a = F.array_sort(F.array(*map(F.lit, values)).cast("array<long>"))
    assert spark.range(1).select(stats.nearest_rank(a, 0.9), stats.floor_rank(a, 0.5), stats.middle(a)).first()[:] == (p90, floor, middle)


def test_nearest_rank_rounds_halves_to_even(spark):
    assert one(spark, stats.nearest_rank(F.array(*map(F.lit, range(6))), 0.5)) == 2


@pytest.mark.parametrize(("values", "want"), [([100, 100, 200], None), ([100, 100, 200, 200], 100.0), ([100, 100, 150, 200, 200], 100.0), ([0, 0, 5, 5], None)])
def test_trend(spark, values, want):
    assert one(spark, stats.trend(F.array(*map(F.lit, values)))) == want


def sale(i, key="k", cents=1000, grader="PSA", grade=9.0, day=1, **more):
    base = {"item_id": f"{i:03d}", "card_key": key, "card_name": "A", "player": "p", "team": "t", "set_name": "s", "parallel": None, "year": 2020, "card_number": "1", "sport": None, "image_url": "", "is_auto": 0, "is_rookie": 0, "is_relic": 0, "price_cents": cents, "currency": "USD", "grader": grader, "grade": grade, "sold_date": dt.date(2020, 1, day), "best_offer": 0, "offer_status": None}
    return base | more


SCHEMA = "item_id string, card_key string, card_name string, player string, team string, set_name string, parallel string, year int, card_number string, sport string, image_url string, is_auto int, is_rookie int, is_relic int, price_cents long, currency string, grader string, grade double, sold_date date, best_offer int, offer_status string"


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_day_rollup_counts_all_and_prices_dollars_only(spark):
    rows = [sale(1, cents=1000), sale(2, cents=2000), sale(3, cents=3000), sale(4, cents=99900, best_offer=1), sale(5, cents=88800, currency="CAD"), sale(6, cents=5000, day=2)]
    day = rollups.day_rollup(frame(spark, rows)).where("sold_date = date '2020-01-01'").first()
    assert (day["n"], day["priced"], day["median"], day["p90"], day["total"]) == (5, 4, 25.0, 999.0, 1059.0)


def test_name_ties_go_to_the_shortest_then_the_first(spark):
    rows = [sale(1, card_name="Bb"), sale(2, card_name="Aa"), sale(3, card_name="Longer"), sale(4, card_name=None)]
    assert cat.group_name(frame(spark, rows), "card_key", "card_name").first()["card_name"] == "Aa"


def test_cohort_leaves_junk_out_and_breaks_ties_by_first_sale(spark):
    rows = [sale(i, cents=c, grade=9.0, day=2) for i, c in enumerate([100, 110, 120, 130])]
    rows += [sale(10 + i, cents=c, grade=10.0, day=3) for i, c in enumerate([500, 510, 520, 530])] + [sale(20, cents=10, grade=10.0, day=1)]
    assert cat.cohorts(cat.usable(frame(spark, rows))).first()["prices"] == [500, 510, 520, 530]
    assert cat.cohorts(cat.usable(frame(spark, rows[:3]))).count() == 0


def test_catalogue_of_nothing_and_of_one_card(spark):
    assert cat.catalogue(frame(spark, [])).count() == 0
    rows = [sale(i, cents=c, card_number=None, image_url=u) for i, (c, u) in enumerate([(9000, ""), (9501, "b"), (8800, "c"), (9100, None), (2000000, "d")])]
    got = cat.catalogue(frame(spark, rows)).first()
    assert (got["sales"], got["median_cents"], got["image_url"], got["quality"], got["spread"], got["numberless"]) == (5, 9100, "b", "bucket", 227.27, True)


@pytest.mark.parametrize(("grader", "grade", "want"), [("PSA", 10.0, "PSA 10"), ("BGS", 9.5, "BGS 9.5"), ("SGC", None, "SGC"), (None, None, "Raw")])
def test_grade_labels(spark, grader, grade, want):
    df = spark.createDataFrame([(grader, grade)], "grader string, grade double")
    assert df.select(stats.grade_label()).first()[0] == want


@pytest.mark.parametrize(("a", "b"), [("Ja'Marr Chase", "JaMarr Chase"), ("Ja Marr Chase", "JA'MARR CHASE"), ("Odell Beckham Jr.", "Odell Beckham"), ("José Ramírez", "Jose Ramirez")])
def test_spellings_of_one_name(spark, a, b):
    got = spark.range(1).select(x.folded_person(F.lit(a)), x.folded_person(F.lit(b))).first()
    assert got[0] == got[1] != ""


@pytest.mark.parametrize(("a", "b", "want"), [("justinjefferson", "justinjeferson", True), ("patrickmahomes", "patrickmahoems", True), ("calebwilliams", "calebwillaims", True), ("jalenhurts", "jalenhurd", False), ("short", "shorx", False), ("travishunter", "travishunxxr", False)])
def test_one_typo(spark, a, b, want):
    assert one(spark, x.one_typo(F.lit(a), F.lit(b))) is want


def test_title_with_traps(spark):
    titles = ["2023 Prizm C.J. Stroud #339-B Silver 12/99 RC PSA GEM MINT 10", "Prizm JOE BURROW /25 Auto BGS 9.5 2020", "lot of 5 2020 Prizm cards", None, "", "Joe Doe 2021 Prizm #1 overall pick"]
    p = parse_titles(spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string"), Vocabulary(sets=("Prizm",), parallels=("Silver",))).orderBy("i").collect()
    a, b, lot, none, empty, pick = p
    assert (a["grader"], a["grade"], a["serial"], a["print_run"], a["year"], a["set_name"], a["parallel"], a["is_rookie"]) == ("PSA", 10.0, 12, 99, 2023, "Prizm", "Silver", 1)
    assert (b["player"], b["print_run"], b["serial"], b["is_auto"], b["grade"]) == ("Joe Burrow", 25, None, 1, 9.5)
    assert lot["is_lot"] == 1 and lot["player"] is None and lot["confidence"] <= 0.3
    assert none["year"] is None and empty["confidence"] == 0.0 and pick["card_number"] is None


def test_numbers_without_digits_or_hash(spark):
    titles = ["2024 Prizm Joe Doe TRC-15", "2024 Prizm Joe Doe #ror-fm", "2024 Prizm Joe Doe #FMEN", "2024 Prizm Joe Doe #PSA", "2024 Prizm Joe Doe #NFL-AB", "2024 Prizm Joe Doe #12 TRC-15"]
    p = parse_titles(spark.createDataFrame(list(enumerate(titles)), "i int, title string"), Vocabulary(sets=("Prizm",))).orderBy("i").collect()
    assert [r["card_number"] for r in p] == ["TRC-15", "ROR-FM", "FMEN", None, None, "12"]


def test_parallels_stack_in_one_order(spark):
    titles = ["2024 Prizm Joe Doe Orange Lazer", "2024 Prizm Joe Doe lazer ORANGE Lazer", "2024 Prizm Joe Doe"]
    p = parse_titles(spark.createDataFrame(list(enumerate(titles)), "i int, title string"), Vocabulary(sets=("Prizm",), parallels=("Orange", "Lazer"))).orderBy("i").collect()
    assert [(r["parallel"], r["player"], r["unparsed"]) for r in p] == [("Lazer Orange", "Joe Doe", None)] * 2 + [(None, "Joe Doe", None)]


#: Titles and what they say beside nulls and zeros; the roster knows the players of ``KNOWN``.
KNOWN = ["Tom Brady", "cj stroud", "CAM WARD", "Bo Nix", "courtland sutton", "Ja'Marr Chase", "Jamarr Chase", "# none", "Joe Burrow", "Josh Allen"]
TOLD = [
    ("2024 Contenders Lot of (25) cards Mahomes", {"set_name": "Contenders", "is_lot": 1, "confidence": 0.3, "player": None, "card_number": None}),
    ("7 Card Rookie Lot Prizm Football #12", {"is_lot": 1, "player": None, "card_number": None, "set_name": "Prizm"}),
    ("Sunset of Glory 2021 Prizm Bo Nix", {"is_lot": 0, "player": "Bo Nix", "confidence": 0.85}),
    ("2020 Prizm Joe Burrow Game-Worn #7", {"is_relic": 1, "player": "Joe Burrow", "confidence": 0.95}),
    ("2026 Topps Flagship #25gh-lb Luther Burden", {"card_number": "25GH-LB", "set_name": "Topps", "player": "Luther Burden", "confidence": 0.85}),
    ("2025 Prizm Cam Ward #1 Overall Pick RY", {"card_number": None, "is_rookie": 1, "player": "Cam Ward", "confidence": 0.85}),
    ("2024 Prizm #25 Draft Picks Caleb Williams", {"card_number": "25", "player": "Caleb Williams", "set_name": "Prizm Draft Picks", "variety": None}),
    ("2025 Prizm #1-330 Base Arch Manning", {"card_number": None, "player": "Arch Manning"}),
    ("2024 Legacy Wyvernhide TOM BRADY Silver #12", {"player": "Tom Brady", "unparsed": "Wyvernhide", "parallel": "Silver", "confidence": 0.95}),
    ("Aidan Hutchinson Dragonhide 2022 Mosaic", {"player": "Aidan Hutchinson Dragonhide", "unparsed": "Dragonhide", "confidence": 0.75}),
    ("Oversized Patrick Mahomes II 2020 PRIZM", {"parallel": "Oversized", "player": "Patrick Mahomes II", "set_name": "Prizm", "unparsed": None}),
    ("2023 Select Brock Purdy On-Card Auto RPA", {"player": "Brock Purdy", "is_auto": 1, "is_relic": 1}),
    ("C.J. Stroud Cam Ward 2025 Mosaic #12", {"player": "Cam Ward / Cj Stroud", "unparsed": None, "confidence": 0.95}),
    ("Courtland Sutton & BO NIX 2025 Mosaic", {"player": "Courtland Sutton", "unparsed": "NIX"}),
    ("Ja’Marr Chase Joe Burrow 2022 Mosaic", {"player": "Ja'Marr Chase / Joe Burrow"}),
    ("2025 Phoenix GENIES Bo Nix Denver Broncos #8", {"subset": "Genies", "team": "Denver Broncos", "player": "Bo Nix", "brand": "Panini"}),
    ("2022 National Treasures Brock Purdy Rookie Patch Auto /99", {"subset": "Rookie Patch", "is_rookie": 1, "is_relic": 1, "is_auto": 1, "print_run": 99}),
    ("2024 Donruss Optic Caleb Williams Rated Rookie #201 Aqua", {"variety": "Rated Rookie", "subset": None, "is_rookie": 1, "player": "Caleb Williams"}),
    ("1975 Topps #416 Joe Theismann (EX-EXMINT)", {"set_name": "Topps", "year": 1975, "player": "Joe Theismann", "unparsed": None}),
    ("2019 Prizm Josh Allen Jaguars #310", {"player": "Josh Hines-Allen", "team": "Jacksonville Jaguars"}),
    ("HOT INVEST Card Rare SSP Mint Free Shipping", {"player": None, "confidence": 0.0, "unparsed": None}),
    ("2021 Score Ja'Marr Chase Touchdown", {"set_name": "Score", "brand": "Panini", "unparsed": "Touchdown"}),
]


@pytest.mark.parametrize("in_row", [roster.IN_ROW, 3])
def test_what_titles_tell(spark, monkeypatch, in_row):
    """The roster stands in the plan or, beyond a size, meets the windows by joins: the same results."""
    monkeypatch.setattr(tt.with_known, "__defaults__", (in_row,))
    rows = spark.createDataFrame(list(enumerate(t for t, _ in TOLD)), "i int, title string")
    names = spark.createDataFrame([(n,) for n in KNOWN], "name string")
    got = parse_titles(rows, STANDARD, roster=names).orderBy("i").collect()
    assert [(title, {k: r[k] for k in want}) for (title, want), r in zip(TOLD, got, strict=True)] == TOLD


def test_a_filter_on_a_parsed_column_leaves_the_claims_alone(spark):
    rows = spark.createDataFrame([("2020 Prizm Joe Doe",), (None,)], "title string")
    plan = parse_titles(rows, STANDARD).where("player like '%Doe'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 60


def test_titles_that_differ_in_numbers_are_read_once(spark, monkeypatch):
    seen, read = [], tt.words_read
    monkeypatch.setattr(tt, "words_read", lambda works, *more: seen.append(sorted(r["work"] for r in works.collect())) or read(works, *more))
    titles = [f"PSA {i % 10 + 1} {1990 + i}  Prizm #{i} Joe Doe {i}/{i + 50}" for i in range(1, 30)] + ["2020 Prizm Josh Allen Jaguars", "1999 Prizm  Josh Allen \t\t Jaguars #4", "Game 12/99 Worn"]
    got = parse_titles(spark.createDataFrame(list(enumerate(titles)), "i int, title string"), STANDARD).orderBy("i").collect()
    assert seen == [["Game  Worn", "Prizm  Joe Doe", "Prizm  Josh Allen  Jaguars", "Prizm Josh Allen Jaguars"]]
    assert [(r["card_number"], r["year"], r["player"], r["serial"]) for r in got[:29]] == [(str(i), 1990 + i, "Joe Doe", i) for i in range(1, 30)]
    assert [r["player"] for r in got[29:31]] == ["Josh Hines-Allen"] * 2 and got[31]["is_relic"] == 1


def test_numbers_are_taken_out_once_a_shape(spark, monkeypatch):
    """Titles that differ only in a certain number are one shape, and every title reads as it does by itself."""
    seen, once = [], tt.numbers_of
    monkeypatch.setattr(tt, "numbers_of", lambda rows: seen.append(sorted(r["_shape"] for r in rows.select("_shape").distinct().collect())) or once(rows))
    alike = [f"2020 Prizm Joe Doe {text}" for n in (1, 12, 1999, 2020) for text in (f"#{n} PSA 10", f"#{n}gh-lb", f"TRC-{n} RC", f"card #NFS-{n} 7/99")]
    odd = [
        "2020 Prizm #12 overall pick Joe Doe", "2020 Prizm #12 PSA10 #13", "2020 Prizm #PSA-9 Joe Doe", "2020 Prizm Joe Doe #12-PSA", "Joe Doe #12345 2020", "#49ers Josh Allen Prizm #4",
        "Josh Allen #49ers", "Prizm #2021/99", "PSA # 10 Prizm", "TRC-12 AB-13 2020", "PSA-10 Prizm 2020", "#10 card lot Prizm", "lot of #12", "TRC-4 cards lot", "Prizm -2020 TRC-12", "#12\tPrizm", None, "#1-330 Prizm", "#12abcd-e",
    ]
    df = spark.createDataFrame(list(enumerate(alike + odd)), "i int, title string")
    got = parse_titles(df, STANDARD).orderBy("i").collect()
    assert len([x for x in seen[0] if x.startswith("2020 Prizm Joe Doe ")]) == 5  # four shapes, and one that is odd
    whole = df.withColumns({"_shape": F.coalesce("title", F.lit("")), "_number": F.lit(None).cast("string")})
    assert got == tt.with_read(whole, tt.worded(once(whole), STANDARD)).orderBy("i").collect()


def test_titles_are_not_written_beside_their_shapes(spark, monkeypatch):
    """What is written of the rows are the columns kept, the shape and the number; words that no number changes are added once a shape."""
    wrote, seen, settled = {}, [], tt.settled
    monkeypatch.setattr(tt, "settled", lambda df, name: settled(wrote.setdefault(name, df), name))
    rows = spark.createDataFrame([(i, f"2020 Prizm Joe Doe #{i % 9} Silver", "more") for i in range(40)] + [(40, None, "more"), (41, "2020 Prizm Joe Doe /99", "more")], "i int, title string, more string")
    each = lambda read: seen.append(read.count()) or said._football(read).withColumn("_ends", x.key_ends())
    got = parse_titles(rows, STANDARD, keep=("i",), each=each)
    assert wrote["shaped"].columns == ["i", "_shape", "_number"] and "title" not in got.columns and "more" not in got.columns and seen == [3]
    keys = {r["i"]: r["k"] for r in got.select("i", x.keyed("_ends", "card_number").alias("k")).collect()}
    assert keys == {i: f"2020-prizm-n{i % 9}-silver" for i in range(40)} | {40: None, 41: "2020-prizm-joedoe-r99"}
    assert keys == {r["i"]: r["card_key"] for r in said.identified(parse_titles(rows, STANDARD)).collect()}


def test_titles_meet_their_shapes_in_the_only_shuffle_of_whole_rows(spark, sf_dir):
    assert _plan(said.titles(spark, sf_dir)).count("RepartitionByExpression [l_orderkey") == 1
    assert "RepartitionByExpression [item_id" not in _plan(said.titles(spark, sf_dir))


def test_settled_tables_leave_no_shuffle_behind(spark, tmp_path, monkeypatch):
    seen, path = [], partitions.new_path
    monkeypatch.setattr(partitions, "new_path", lambda *a: seen.append(path(*a)) or seen[-1])
    held = spark.conf.get(partitions.SWEEP, "false")
    df = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    with partitions.swept(spark):
        assert spark.conf.get(partitions.SWEEP) == "true"
    assert partitions.settled(df, "x").count() == 7 and spark.conf.get(partitions.SWEEP) == held == "false"
    with pytest.raises(ValueError), partitions.swept(spark):
        raise ValueError
    assert spark.conf.get(partitions.SWEEP) == "false" and spark.read.format("binaryFile").load(seen[0]).where("path like '%.zstd.parquet'").count() > 0


def test_known_names_of_nothing(spark):
    names = spark.createDataFrame([], "name string")
    df = spark.createDataFrame([(["a b"], ["abcdefgh"]), (None, None), ([], [])], "w array<string>, f array<string>")
    for most in (0, -1):
        out = roster.with_known(df, names, "w", "f", "hit", "also", most).collect()
        assert [r["hit"] for r in out] == [None] * 3 and all(not r["also"] for r in out)


def test_learned_words_are_replaced_and_keep_known_meanings(spark, tmp_path):
    def publish(version, rows):
        learned.publish(spark.createDataFrame(rows, "kind string, name string"), str(tmp_path), version)

    publish(1, [("insert", "Widget Kings"), ("set", "Panini Donruss"), ("set", "Vault Nine"), ("insert", " ")])
    publish(2, [("insert", "Rated Rookie"), ("designation", "Silver"), ("designation", "Retail"), ("designation", "Pink Scales"), ("insert", "Joker")])
    publish(2, [("designation", "Pink Scales"), ("designation", "Retail"), ("insert", "Rated Rookie"), ("insert", "New One"), ("other", "x")])
    words = learned.table_of(spark, str(tmp_path))
    one, two = learned.read(words, 1), learned.read(words)
    assert set(one.inserts) - set(STANDARD.inserts) == {"Widget Kings"} and one.set_names["panini donruss"] == "Donruss" and "vault nine" in one.sets
    assert set(two.inserts) - set(STANDARD.inserts) == {"New One"} and two.printings == ("Pink Scales",)
    assert set(two.designations) - set(STANDARD.designations) == {"Retail"} and two.sets == STANDARD.sets
    assert learned.read(words.limit(0)) == STANDARD and learned.read(words, 9) == STANDARD


@pytest.mark.parametrize(("day", "want"), [("2023-01-01", "2023-W00"), ("2024-01-01", "2024-W01"), ("2023-01-02", "2023-W01")])
def test_week_labels(spark, day, want):
    from saleglass.plans.coverage import week

    assert spark.createDataFrame([(dt.date.fromisoformat(day),)], "d date").select(week("d")).first()[0] == want


def test_upsert_keeps_found_prices_and_is_idempotent(spark):
    schema = "item_id string, price_cents long, best_offer int, offer_status string, ask_cents long, query_id string, sport string"
    old = spark.createDataFrame([("a", 10, 1, "found", 20, "q1", None), ("b", 10, 0, None, None, "q1", None)], schema)
    batch = spark.createDataFrame([("a", 99, 0, None, None, "q2", "x", 1), ("b", 1, 0, None, None, "q2", "x", 1), ("b", 55, 0, None, None, "q2", "x", 2), ("c", 7, 0, None, None, "q2", None, 1)], schema + ", seq int")
    once = merges.upsert_sales(old, batch)
    got = {r["item_id"]: (r["price_cents"], r["query_id"], r["offer_status"]) for r in once.collect()}
    assert got == {"a": (10, "q1", "found"), "b": (55, "q1", None), "c": (7, "q2", None)}
    assert sorted(map(str, merges.upsert_sales(once, batch).collect())) == sorted(map(str, once.collect()))


def test_verify_has_three_answers(spark):
    check = spark.createDataFrame([(2020, "S", "1", "P", "x", None, 9, "k1")], "year int, set_name string, card_number string, player string, parallel string, subset string, print_run int, card_key string")
    p = spark.createDataFrame([("a", 2020, "S", "P", "x", "1"), ("b", 2020, "S", "P", "x", "2"), ("c", 1999, "S", "P", "x", "1"), ("d", 2020, "S", "P", "y", None)], "item_id string, year int, set_name string, player string, parallel string, card_number string")
    assert {r["item_id"]: r["printed"] for r in joins.verified(p, check).collect()} == {"a": True, "b": False, "c": None, "d": None}


def test_rows_keep_their_anchor(spark):
    d = spark.createDataFrame([(1, 0.10, "a", 0.9), (1, 0.115, "b", 0.8), (1, 0.13, "c", 0.7)], "item_id int, top double, text string, confidence double")
    assert [(r["text"], r["confidence"]) for r in pages.group_rows(d).orderBy("top").collect()] == [("a b", 0.8), ("c", 0.7)]


def test_sums_agree(spark, sf_dir):
    from saleglass.sources.bindings import flat

    f = flat(spark, sf_dir)
    assert cat.catalogue(f).agg(F.sum("sales")).first()[0] == cat.card_grades(f).agg(F.sum("sales")).first()[0]
    assert rollups.day_rollup(f).agg(F.sum("n")).first()[0] == f.count()


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranks_of_groups_equal_sorted_lists(spark):
    import random

    from saleglass.operators import ranks

    rng = random.Random(3)
    rows = [(k, rng.choice([None, -5, 0, 7, rng.randrange(200_000)])) for k in ["a"] * 400 + ["b"] * 7 + [None] * 30]
    rows += [("c", None), ("d", 9)]
    df = spark.createDataFrame(rows, "k string, v long")
    picks = {"lower": ranks.LOWER_MIDDLE, "upper": ranks.UPPER_MIDDLE, "p90": ranks.nearest(0.9), "p10": ranks.floored(0.1)}
    got = {r.k: r for r in ranks.profile(df, ["k"], "v", picks).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, r in got.items():
        held = sorted(v for g, v in rows if g == k and v is not None)
        n = len(held)
        assert (r.rows, r.valued, r.total) == (sum(g == k for g, _ in rows), n, sum(held) if n else None)
        want = [held[i] for i in ((n - 1) // 2, n // 2, round((n - 1) * 0.9), int((n - 1) * 0.1))] if n else [None] * 4
        assert [r.lower, r.upper, r.p90, r.p10] == want
    assert ranks.profile(df.where("false"), ["k"], "v", picks).count() == 0
    nothing = ranks.profile(df.where("false"), [], "v", picks).collect()
    assert len(nothing) == 1 and nothing[0].lower is None


def test_runs_of_words(spark):
    from saleglass.operators.readings import word_windows

    rows = spark.createDataFrame([("Joe A. Doe jr",), ("one",), ("",), (None,)], "t string")
    got = [sorted(r[0]) if r[0] is not None else None for r in rows.select(word_windows(rows.t, (2, 3))).collect()]
    assert got == [["a doe", "a doe jr", "doe jr", "joe a", "joe a doe"], [], [], None]


def test_reconcile_follows_both_confidence_rules(spark):
    from saleglass.operators.readings import reconcile

    schema = "item_id int, year int, set_name string, player string, card_number string, grader string, grade double, confidence double"
    titles = spark.createDataFrame([(1, 2020, "Prizm", "Downtown Joe Doe", None, "PSA", 10.0, 0.9), (2, 2020, "Prizm", "Joe Doe", "7", None, None, 0.2), (3, 2020, "Prizm", "Joe Doe", "7", None, None, 0.5)], schema)
    photos = spark.createDataFrame([(1, 2021, "PRIZM", "Joe Doe", "9", "psa", 10.0, 0.8), (2, 2021, "", "Al Roe", "#7", None, None, 0.8), (3, 1999, "x", "y", "z", "w", 1.0, 0.0)], schema)
    a, b, c = reconcile(titles, photos).orderBy("item_id").collect()
    assert (a.agreed, a.filled, a.conflicts, a.card_number, a.year) == (["set_name", "player", "grader", "grade"], ["card_number"], ["year"], "9", 2020)
    assert (a.player, a.confidence) == ("Downtown Joe Doe", 0.85)
    assert (b.agreed, b.conflicts, b.player, b.confidence) == (["card_number"], ["year", "player"], "Al Roe", 0.1)
    assert (c.outcome, c.confidence, c.year) == ("no label", 0.5, 2020)


def test_open_bands_split_at_a_hundred_times_their_floor():
    from saleglass.plans.joins import halves

    assert halves(300.0, None) == ((300.0, 3000.0), (3000.0, None))
    assert halves(0.0, 100.0) == ((0.0, 9.95), (9.95, 100.0))
    assert halves(1.0, 1.01) == ((1.0, 1.0), (1.0, 1.01))


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_upsert_replaces_only_touched_partitions(spark, tmp_path):
    at, part = f"{tmp_path}/t", "id string, v int, p int"
    assert partitions.upsert(at, spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3)], part), ["id"], "p") == 3
    before = files(tmp_path)
    assert partitions.upsert(at, spark.createDataFrame([], part), ["id"], "p") == 0 and files(tmp_path) == before
    partitions.upsert(at, spark.createDataFrame([("a", 2, 1), ("d", 2, 1)], part), ["id"], "p")
    after = files(tmp_path)
    assert {k for k in before if "p=1" not in k} == {k for k in after if "p=1" not in k} and all(after[k] == before[k] for k in before if "p=1" not in k)
    partitions.upsert(at, spark.createDataFrame([("b", 3, 3)], part), ["id"], "p", moves=True)
    partitions.upsert(at, spark.createDataFrame([], part), ["id"], "p", gone=spark.createDataFrame([("d", 1)], "id string, p int"))
    assert sorted(map(tuple, spark.read.schema(part).parquet(at).collect())) == [("a", 2, 1), ("b", 3, 3), ("c", 1, 3)]
    assert not (tmp_path / "t" / "p=2").exists()


def test_export_of_no_change_writes_nothing(spark, tmp_path):
    def rows(*changes):
        base = [{"item_id": f"i{i}", "card_key": f"k{i % 5}" if i % 7 else None, "price_cents": 1000 + i, "day": i % 3 + 1} for i in range(40)]
        for i, c in changes:
            base[i] |= c
        out = [{"updated_at": dt.datetime(2024, 1, 1), "parsed_at": dt.datetime(2024, 1, 2) if r["card_key"] else None, **r} for r in base]
        df = spark.createDataFrame(out, "item_id string, card_key string, price_cents long, day int, updated_at timestamp, parsed_at timestamp")
        fixed = {"currency": "USD", "best_offer": 0, "is_rookie": 0, "is_auto": 0, "is_relic": 0, "confidence": 1.0, "year": 2020, "bids": 1, "grade": None, "shipping_cents": 0, "ask_cents": None}
        texts = [c for c in (*exports.SALE_COLUMNS, "offer_status") if c not in (*fixed, *df.columns, "sold_date", "offer_known")]
        kinds = {"grade": "double", "confidence": "double", "shipping_cents": "long", "ask_cents": "long", "currency": "string"}
        df = df.withColumns({c: F.lit(x).cast(kinds.get(c, "int")) for c, x in fixed.items()} | {c: F.lit(None).cast("string") for c in texts})
        return df.withColumn("sold_date", F.expr("make_date(2024, 1, day)"))

    at = tmp_path / "out"
    assert exports.export(rows(), str(at)) == {"cards": 5, "card_grades": 5, "daily": 3, "sales": 40}
    before = files(at)
    assert exports.export(rows(), str(at)) == {"cards": 0, "card_grades": 0, "daily": 0, "sales": 0} and files(at) == before
    late = {"updated_at": dt.datetime(2024, 2, 1)}
    parsed = {"card_key": "k9", "parsed_at": dt.datetime(2024, 2, 2)}
    assert exports.export(rows((1, {"price_cents": 5, **late}), (2, parsed)), str(at)) == {"cards": 3, "card_grades": 3, "daily": 1, "sales": 2}
    got = {r["card_key"]: (r["sales"], r["low_cents"]) for r in spark.read.parquet(f"{at}/cards").collect()}
    assert got["k1"][1] == 5 and got["k9"] == (1, 1002) and sum(n for n, _ in got.values()) == 34
    only = [{"card_key": None, "parsed_at": dt.datetime(2024, 3, 1)} if f"k{i % 5}" == "k4" or i == 2 else {} for i in range(40)]
    exports.export(rows((1, {"price_cents": 5, **late}), *enumerate(only)), str(at))
    assert {"k4", "k9"}.isdisjoint(r["card_key"] for r in spark.read.parquet(f"{at}/cards").collect())


def test_an_export_writes_whole_rows_only_once(spark, sf_dir, tmp_path, monkeypatch):
    """Beside the sales table, what an export of everything writes has no column that only whole sales have."""
    from saleglass.plans import merges as plans

    rows, wide, settled = plans._dated(spark, sf_dir).cache(), [], partitions.settled
    monkeypatch.setattr(partitions, "settled", lambda df, name: wide.append(name) if "title" in df.columns and df.count() > 2000 else None or settled(df, name))
    assert exports.export(rows, str(tmp_path / "x"))["sales"] == rows.count() and not wide


def test_rows_that_stay_are_told_by_their_place(spark, tmp_path):
    """An upsert finds the rows it replaces by key, file and place, and moves no whole row of the table by a shuffle."""
    at, schema, n = f"{tmp_path}/t", "id string, wide string, p int", 100_000
    rows = spark.range(n).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("w").alias("wide"), (F.col("id") % 2).cast("int").alias("p"))
    rows.coalesce(1).write.partitionBy("p").parquet(at)
    rows.where("false").write.mode("append").partitionBy("p").parquet(at)
    late = spark.range(0, n, 3).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("late").alias("wide"), F.lit(2).alias("p"))
    held = spark.read.schema(schema).parquet(at)
    spots = partitions.found(at, held.schema, late.select("id"), "p")
    kept = partitions.without(held, spots)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and kept.columns == held.columns
    many = partitions.without(held, spots, most=0)
    assert all({int(r["id"][1:]) for r in k.collect()} == {i for i in range(n) if i % 3} for k in (kept, many)) and "wide" not in spots.columns
    assert partitions.without(held, spots.where("false")).count() == n
    assert partitions.upsert(at, late, ["id"], "p", moves=True, staged=True) == late.count()
    got = spark.read.schema(schema).parquet(at).groupBy("p", "wide").count().collect()
    assert sorted(map(tuple, got)) == [(0, "w", sum(i % 3 > 0 for i in range(0, n, 2))), (1, "w", sum(i % 3 > 0 for i in range(1, n, 2))), (2, "late", late.count())]


def test_cards_and_grades_of_an_export_come_from_one_deal(spark, sf_dir, tmp_path, monkeypatch):
    from saleglass.plans import merges as plans

    rows, made, settled = plans._dated(spark, sf_dir).cache(), [], partitions.settled
    assert "RepartitionByExpression [item_id" not in _plan(plans._dated(spark, sf_dir))  # lines are dealt, not whole sales
    monkeypatch.setattr(partitions, "settled", lambda df, name: made.append((name, df)) or settled(df, name))
    exports.export(rows, str(tmp_path / "x"))
    assert not {"changed", "touched-sales", "card_grades", "upsert"} & {name for name, _ in made}
    assert sum(_plan(df).count("RepartitionByExpression [card_key") for _, df in made) == 1
    for kind, want in (("cards", cat.catalogue(rows)), ("card_grades", cat.card_grades(rows))):
        got = spark.read.parquet(str(tmp_path / "x" / kind)).select(*want.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_streams_settle_once_a_run(spark, tmp_path):
    """Batches are noted only; keys are computed once a run, over all rows so far, and a later row of an item takes its place."""
    from saleglass.streaming import jobs

    calls = []

    def total(rows):
        calls.append(rows.count())
        return rows.groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))

    def land(rows):
        for r in rows:
            spark.createDataFrame([r], "i string, k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        each = jobs.per_key(jobs.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "keys"), "i", "k", total)
        last = jobs.last_of_each(jobs.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "last"), "i", "v")
        return sorted(tuple(r) for r in each.select("k", "v", "n").collect()), sorted(tuple(r) for r in last.collect())

    land([("a", "x", 1), ("b", "x", 2), ("c", "y", 4), ("a", "x", 8)])
    assert run() == ([("x", 10, 2), ("y", 4, 1)], [("a", "x", 8), ("b", "x", 2), ("c", "y", 4)]) and calls == [3]
    land([("b", "x", 16), ("d", "z", 32)])
    assert run() == ([("x", 24, 2), ("y", 4, 1), ("z", 32, 1)], [("a", "x", 8), ("b", "x", 16), ("c", "y", 4), ("d", "z", 32)]) and calls == [3, 3]
    assert run()[0] == [("x", 24, 2), ("y", 4, 1), ("z", 32, 1)] and calls == [3, 3]


def test_candidates_agree_with_every_pair_looked_at(spark):
    some = lambda i, *values: values[i % len(values)]
    parses = [(f"i{i}", some(i, 2000, 2001, None), "S", some(i // 2, "1", "x-2", "", None), some(i // 3, "Ann Lee", "", None), some(i // 5, "gold", "red", None)) for i in range(180)]
    cards = [(some(i, 2000, 2000, 2001, None), "S", some(i // 3, "1", "X2", None, "9"), some(i // 2, "ann lee", "Bo", None, ""), some(i // 7, "gold", None, "red"), some(i, "Inserts", None), i, f"k{i}") for i in range(90)]
    p = spark.createDataFrame(parses, "item_id string, year int, set_name string, card_number string, player string, parallel string")
    check = spark.createDataFrame(cards, "year int, set_name string, card_number string, player string, parallel string, subset string, print_run int, card_key string")

    def fold(c, name=False):
        x = None if c is None else re.sub("[^a-z0-9]", "", c.lower())
        return x if name or x else None

    def meet(a, b):
        if a[1] is None or a[1] != b[0]:
            return False
        ours = fold(a[3]) == fold(b[2]) if fold(a[3]) else a[5] is None or a[5] == b[4]
        return ours and (a[4] is None or fold(a[4], True) == fold(b[3], True))

    want = sorted((a[0], b[7]) for a in parses for b in cards if meet(a, b))
    assert want and sorted((r["item_id"], r["printed"]) for r in joins.candidates(p, check).collect()) == want
    ends = {r["item_id"]: (r["low_printed"], r["high_printed"]) for r in joins.summaries(p, check, "printed").collect()}
    assert ends == {i: (min(k for j, k in want if j == i), max(k for j, k in want if j == i)) for i in {i for i, _ in want}}


def test_candidates_meet_by_all_that_a_parse_says(spark):
    p = spark.createDataFrame([("a", 2000, "S", None, "Ann", "gold")], "item_id string, year int, set_name string, card_number string, player string, parallel string")
    check = spark.createDataFrame([(2000, "S", "1", "Ann", "gold", None, 1, "k1")], "year int, set_name string, card_number string, player string, parallel string, subset string, print_run int, card_key string")
    for df in (joins.candidates(p, check), joins.verified(p, check)):
        join = next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_r_" in line)
        assert all(f"<=> _r_{c}" in join for c in ("year", "set_name", "number", "who", "print"))  # not only by year and set


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_offers_are_read_within_the_row_of_their_page(spark, sf_dir):
    assert _plan(pages.g_read_offer(spark, sf_dir)).count("l_shipdate") and "Generate" not in _plan(pages.g_read_offer(spark, sf_dir))
    rows = [("a", "Was $9.00. Best offer accepted: $5.00 now", 900, False), ("b", "Best offer accepted: $5.00", 900, True), ("c", "Best offer accepted: $5.00. Best offer accepted: $6.00", 900, False), ("d", "Was $5.00", 900, False),
            ("e", "Best offer accepted: $1.00", 900, False), ("f", None, 900, False), ("g", "BEST OFFER ACCEPTED: C $5.00 and best offer accepted: $4.00 shipping", 900, False), ("h", "best offer accepted $5.00", None, False)]
    got = pages.read_offers(spark.createDataFrame(rows, "id string, text string, ask_cents long, gone boolean"), "id").collect()
    assert {r["id"]: (r["state"], r["cents"]) for r in got} == {
        "a": ("found", 500), "b": ("gone", None), "c": ("ambiguous", None), "d": ("not_shown", None), "e": ("not_shown", None), "f": ("not_shown", None), "g": ("not_shown", None), "h": ("not_shown", None),
    }


def test_amounts_are_cut_once_a_page(spark, sf_dir):
    """No filter made of the texts stands below the joins, where each of them would be made and cut another time."""
    plan = _plan(pages.g_money_candidates(spark, sf_dir))
    assert plan.count("regexp_extract_all(") == plan.count("split(") == 1 and plan.count("format_number(") == 3
    rows = [("a", "Was $1,234.50, Tax: $2 C $3.00 Best Offer ACCEPTED: $4 then $5.55 Shipping"), ("b", None), ("c", "no amount"), ("d", "was a thing, $7"), ("e", "list price $8 taxi $9"), ("f", "$10 TAX")]
    got = pages.money_candidates(spark.createDataFrame(rows, "id string, text string"), "id", F.col("text")).collect()
    assert sorted(map(tuple, got)) == [
        ("a", 0, 123450, "shipping"), ("a", 1, 200, "shipping"), ("a", 2, 300, "foreign"), ("a", 3, 400, "accepted"), ("a", 4, 555, "shipping"),
        ("d", 0, 700, "struck"), ("e", 0, 800, "struck"), ("e", 1, 900, "other"), ("f", 0, 1000, "shipping"),
    ]


def test_second_players_are_looked_up_within_the_row_or_by_joins(spark):
    titles = spark.createDataFrame([("a", "Ann Example", "Ann Example & Bob O'Tester rookie"), ("a", "Ann Example", "Ann Example, Carl Another"), ("b", "Bob Tester Sr", "Bob Tester and nobody"), ("c", None, "Ann Example"), ("d", "Zed Zedder", "Ann Éxample, ann example, carl another")], "id string, player string, title string")
    names = spark.createDataFrame([("ann example",), ("bob tester",), ("bob o'tester",), ("carl another",), ("al bo",), ("carl another jr",)], "name string")
    small, large = readings.second_players(titles, names, "id"), readings.second_players(titles, names, "id", in_row=2)
    assert "Generate" not in _plan(small) and "Generate" in _plan(large)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == [("a", "ann example / bob o'tester / carl another jr"), ("d", "ann example / carl another jr / zed zedder")]


def test_reconciled_names_are_folded_once(spark, sf_dir):
    assert _plan(joins.j_reconcile_readings(spark, sf_dir)).count("translate(") == 2


def test_the_catalogue_reads_and_deals_sales_once(spark, sf_dir):
    plan = _plan(rollups.w_movers(spark, sf_dir))
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    assert plan.count("RepartitionByExpression") == 1


def test_the_catalogue_takes_names_and_medians_over_all_grades(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", f"i{i}", day, 100 * (i + 1), "USD", "PSA" if i % 2 else None, 9.0 if i % 2 else None, None if i == 4 else "Long name" if i in (0, 1) else "Short" if i in (2, 3) else None, "P" if i == 0 else None, None, None) for i in range(5)] + [("b", "j", day, 10, "USD", None, None, None, None, "7", ""), ("b", "k", day, None, "USD", None, None, "x", None, None, None)]
    flat = spark.createDataFrame(rows, "card_key string, item_id string, sold_date date, price_cents long, currency string, grader string, grade double, card_name string, player string, card_number string, image_url string")
    none = {c: F.lit(None).cast("string") for c in ("team", "set_name", "parallel", "sport")} | {"year": F.lit(2000)} | {c: F.lit(0) for c in ("is_auto", "is_rookie", "is_relic")}
    a, b = cat.catalogue(flat.withColumns(none)).orderBy("card_key").collect()
    assert (a["name"], a["player"], a["sales"], a["median_cents"], a["raw_sales"], a["raw_median_cents"], a["trend_sales"], a["quality"], a["low_cents"], a["high_cents"]) == ("Short", "P", 5, 300, 3, 300, 0, "bucket", 100, 500)
    assert (b["name"], b["sales"], b["median_cents"], b["card_number"], b["image_url"], b["spread"], b["quality"]) == ("b", 1, 10, "7", None, None, "unproven")
