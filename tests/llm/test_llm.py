"""The training-data operators against brute force, round trips and defined cases."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm.mixing import mix, plain_source
from tideline.llm.packing import fill_report, pack, sum_of_squares
from tideline.llm.quality import REASONS, judge, line_statistics, text_quality
from tideline.llm.tokens import count_tokens, encoder, tokenizer_path
from tideline.llm.topn import top_n


def test_top_n_against_sorting(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        g = r.choice(["hot"] * 20 + ["a", "b", None])
        score = r.choice([None, float("nan"), float("inf"), *[x / 4 for x in range(9)]])
        rows.append((i, g, score, r.randrange(4), r.choice(["x", None])))
    rows += rows[:200]
    df = spark.createDataFrame(rows, "id int, g string, score double, t int, rank string")
    got = top_n(df, by=["g"], score="score", ties=["t", "id"], n=5).collect()
    want = collections.defaultdict(list)
    for i, g, s, t, _ in sorted({x for x in rows if x[2] is not None and not math.isnan(x[2])}, key=lambda x: (-x[2], x[3], x[0])):
        want[g].append(i)
    assert {(x["g"], x["rank"], x["id"]) for x in got} == {(g, k + 1, i) for g, v in want.items() for k, i in enumerate(v[:5])}
    assert len(got) == sum(min(5, len(v)) for v in want.values())
    assert top_n(df.limit(0), by=["g"], score="score", ties=["id"], n=5).count() == 0


def test_top_n_plan_prunes_before_and_after_the_shuffle(spark, sf):
    plan = top_n(spark.read.parquet(f"{sf}/score_frame.parquet"), by=["variant", "corridor", "horizon"], score="score", ties=["timestamp", "score_id"], n=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def plainly(sizes, capacity):
    """The sum-of-squares rule written out: every possible place is tried."""
    gaps, out = [], []
    for s in sizes:
        def value(after):
            c = collections.Counter(g for g in after if 0 < g < capacity)
            return sum(v * v for v in c.values())

        best = None
        for k, g in [*enumerate(gaps), (len(gaps), capacity)]:
            if g < s:
                continue
            after = [*gaps[:k], g - s, *gaps[k + 1 :]]
            key = (value(after), g == capacity and k == len(gaps), g)
            if best is None or key < best[0]:
                best = (key, k, after)
        out.append(best[1])
        gaps = best[2]
    return out, gaps


@pytest.mark.parametrize("capacity", [2, 7, 16])
def test_sum_of_squares_reaches_the_least_sum_at_every_step(capacity):
    r = random.Random(capacity)
    sizes = [r.randint(1, capacity) for _ in range(80)]
    bins = sum_of_squares(np.array(sizes), capacity)
    fill = collections.Counter()
    for b, s in zip(bins, sizes):
        fill[b] += s
    assert max(fill.values()) <= capacity
    _, gaps = plainly(sizes, capacity)
    assert sorted(capacity - g for g in gaps) == sorted(fill.values())


def test_packing_is_whole_and_full(spark):
    r = random.Random(1)
    items = [(i, r.choice([r.randint(1, 30), r.randint(1, 400)])) for i in range(3000)] + [(9001, 0), (9002, None), (9003, 6400), (5, 12), (5, 12)]
    df = spark.createDataFrame(items, "doc_id long, tokens int").withColumn("pack_name", F.lit("clash")).withColumn("capacity", F.lit(1))
    packs = spark.createDataFrame([("s", 64), ("l", 512), ("none", None), ("bad", 0), ("l", 100)], "pack_name string, capacity_tokens int")
    got = pack(df, packs, per_group=400).toPandas()
    assert set(got.pack_name) == {"s", "l"}
    for name, cap in (("s", 64), ("l", 512)):
        g = got[got.pack_name == name]
        placed = g[g["size"] > 0]
        assert placed.groupby("container")["size"].sum().max() <= cap
        assert (placed.groupby("container")["size"].transform("sum") == placed["filled"]).all()
        want = collections.Counter()
        for i, s in items:
            want[i] += s or 0
        assert g.groupby("doc")["size"].sum().to_dict() == dict(want)
        sizes = collections.defaultdict(list)
        for i, s in items:
            sizes[i].append(s or 0)
        for d, p in placed.groupby("doc"):
            if len(sizes[d]) == 1:
                s = sizes[d][0]
                assert len(p) == (1 if s <= cap else -(-s // cap))
                assert sorted(p["start"]) == [k * cap for k in range(len(p))]
        assert g[g["size"] == 0].container.isna().all() and set(g[g["size"] == 0].doc) == {9001, 9002}
    fill = {x["pack_name"]: x["fill"] for x in fill_report(pack(df, packs, per_group=400), packs).collect()}
    assert fill["s"] > 0.97 and fill["l"] > 0.97
    assert pack(df.limit(0), packs).count() == 0 and pack(df, packs.limit(0)).count() == 0


def test_mixing_reaches_targets_or_says_what_it_reached(spark):
    r = random.Random(2)
    items = [(i, r.choice([" Big", "BIG", "big"]) if r.random() < 0.8 else "Small-Set", r.randint(1, 50)) for i in range(5000)]
    items += [(10**6, None, 5), (10**6 + 1, "unknown", 5), (10**6 + 2, "big", None), (None, "big", 5)]
    df = spark.createDataFrame(items, "doc_id long, source string, tokens int").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small_set", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1), ("zero", 0.0, 5)], "source string, target_share double, max_repeats int")
    selection, shares = mix(df, targets, total=200_000.0)
    got = {x["source"]: x for x in shares.collect()}
    assert set(got) == {"big", "small_set", "absent"} and got["absent"]["reached_share"] == 0
    assert abs(got["big"]["drawn"] - 100_000) < 50 and got["small_set"]["drawn"] == 3 * got["small_set"]["available"] < 80_000
    assert abs(sum(x["reached_share"] for x in got.values()) - 1) < 1e-9
    rows = selection.toPandas()
    assert (rows.loc[rows.source == "big", "copies"] <= 2).all() and (rows.loc[rows.source == "small_set", "copies"] == 3).all()
    assert rows.doc.is_unique and 10**6 not in set(rows.doc)
    size = dict((i, s) for i, _, s in items)
    assert sum(size[d] * c for d, c in zip(rows.doc, rows.copies)) == sum(x["drawn"] for x in got.values())
    # thresholds are nested: a smaller budget draws a subset
    a, b = ({x["doc"]: x["copies"] for x in mix(df, targets, total=t)[0].collect()} for t in (3000.0, 9000.0))
    assert all(b.get(d, 0) >= c for d, c in a.items())
    one = {x["source"]: x for x in mix(df, targets, total=1e9)[1].collect()}
    assert one["big"]["drawn"] == 2 * one["big"]["available"] and one["small_set"]["drawn"] == 3 * one["small_set"]["available"]
    empty, none = mix(df.limit(0), targets)
    assert empty.count() == 0 and {x["drawn"] for x in none.collect()} == {0}
    assert [x[0] for x in spark.createDataFrame([(" A-b ",), ("A  B",), ("",), (None,)], "s string").select(plain_source(F.col("s"))).collect()] == ["a_b", "a_b", None, None]


def test_a_scarce_source_falls_short_alone(spark):
    """Three documents in one source leave the draws of the others as they were, and thousands of sources are a table like any other."""
    items = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5000).alias("source"), (1 + F.col("id") % 7).alias("tokens"))
    scarce = spark.createDataFrame([(10**6 + i, "tiny", 4) for i in range(3)], "doc_id long, source string, tokens long")
    shares = spark.range(5000).select(F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(0.9 / 5000).alias("target_share"), F.lit(2).alias("max_repeats"))
    tiny = spark.createDataFrame([("tiny", 0.1, 5)], "source string, target_share double, max_repeats int")
    a, _ = mix(items, shares, total=100_000.0)
    b, report = mix(items.unionByName(scarce), shares.unionByName(tiny), total=100_000.0)
    assert a.where("copies > 2").count() == 0 and a.select("source").distinct().count() > 4900
    others = b.where("source <> 'tiny'")
    assert others.count() == a.count() and others.exceptAll(a).count() == 0
    x = report.where("source = 'tiny'").first()
    assert x["drawn"] == 60 and x["budget"] == 60 and x["reached_share"] < 0.001


def test_mixing_draws_the_prefix_of_the_hash_order(spark):
    df = spark.createDataFrame([(i, "s", 1 + i % 9) for i in range(20000)], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = {x["doc"] for x in mix(df, targets, total=12345.0)[0].collect()}
    order = [(x["h"] % 2**64, x["doc_id"], x["tokens"]) for x in df.withColumn("h", F.xxhash64("doc_id", F.lit(17))).collect()]
    total, want = 0, set()
    for _, d, s in sorted(order):
        if total + s > 12345:
            if total + s - 12345 < 12345 - total:
                want.add(d)
            break
        total += s
        want.add(d)
    assert got == want


def test_token_counts(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "привет " * 5000)]
    got = {x["doc_id"]: x["tokens"] for x in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    enc = encoder(tokenizer_path())
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in rows}


PROSE = [
    "We checked the holdout quarter after the session, and the effect is smaller than the fee.",
    "> «Of the 72 days that we ignored, only a few had the hourly candle right», said the analyst to the team.",
    "# Heading\n\nWhat the reader wanted to know was whether the price\nhad recovered by the end of the week, as it often\ndid when nobody was looking at the market.",
    "почему курс просел пока непонятно однако с этим можно жить и ждать уже не стоит",
    "Если часовой бар выровнялся, то ждать уже не стоит (165.06, 96.35 / 1242 CUR1860; +1.7%). Мы не нашли ни одного дня, когда это было не так (1.5; 2%).",
    "Pulni kechqurun yuborgan odam komissiya miqdori haqida o‘ylamaydi, chunki tarif yangilanmagan edi.",
    "— It tokk the taem 10 days to see that the fee had gone up, and nobody had wriitten about it before.",
]
OTHER = [
    "- apples\n- pears and plums\n- the green tea (4 boxes)",
    "1) часовой бар\n2) аналитик (3 дней)\n3) MTL123",
    "a;b;c;d\n1;2;3;4\n5;6;7;8",
    "| lag | fee |\n|---|---|\n| 1 | 2 |",
    '{"a": 1,\n"b": null,\n"c": "x"}',
    "2026-01-01 10:00:00,123 INFO [a.b] x=1 y=2\n2026-01-01 10:00:01,123 DEBUG [a.b] x=2 y=4",
    "$$$ ### *** !!! ===\n<><> %% ^^",
    "FUT1234, oil factor, CUR1, the bank quote, MTL77, the weekly cap, IDX4, the news feature, SHR55",
    "Home Menu Sign in Share Accept all Cookies Subscribe Home Rates Next > Load more FAQ Menu",
    "zyQwjoJEMXnBC1xYyBpO+iFaeoI7x+EgnHGlCgxMp3eD72eUzbQDraj+0s3ifl7blxhkU2K7JNWfj4coCkzKzHCXHC",
]


def test_quality_verdicts_and_statistics(spark):
    texts = PROSE + OTHER + [None, "", " \n\t ", "word " * 60, "It is long. " * 20000, "It was a longer story. " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("reasons", F.lit("clash"))
    got = {x["doc_id"]: x for x in text_quality(df).collect()}
    assert [got[i]["is_prose"] for i in range(len(PROSE))] == [True] * len(PROSE)
    assert [got[i]["is_prose"] for i in range(len(PROSE), len(PROSE) + len(OTHER))] == [False] * len(OTHER)
    for i in range(len(PROSE + OTHER), len(PROSE + OTHER) + 3):
        assert got[i]["is_prose"] and got[i]["word_count"] == 0 and got[i]["reasons"] == []
    assert all(x["is_prose"] == (x["reasons"] == []) for x in got.values())
    first = got[0]
    assert first["word_count"] == 16 and first["punctuated_line_share"] == 1.0
    assert abs(first["mean_word_length"] - sum(len(w.strip(".,")) for w in PROSE[0].split()) / 16) < 1e-9
    assert got[len(PROSE)]["bullet_line_share"] == 1.0 and "bullets" in got[len(PROSE)]["reasons"]
    # by the published threshold a mean word length of 8/3 is none of prose
    assert got[len(texts) - 2]["word_count"] == 60000 and got[len(texts) - 2]["reasons"] == ["word_length"]
    assert got[len(texts) - 1]["word_count"] == 100000 and got[len(texts) - 1]["is_prose"] is True
    assert text_quality(df.limit(0)).count() == 0


def test_quality_counts_bracketed_figures_and_codes(spark):
    prose = "The bar had recovered by the end of the week (162.62, 210.86 / 2939 MTL3175; +8.5%), and that was all."
    rows = "\n".join(f"({i}, 45.3, USD)" for i in range(40))
    texts = [prose, rows, f"{prose}\n\n{rows}", "(1) fee\n(2) bar"]
    got = [x for x in text_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [x["is_prose"] for x in got] == [True, False, False, False]
    assert [x["word_count"] for x in got] == [15, 40, 55, 2]
    assert abs(got[0]["symbol_share"] - 1 / 15) < 1e-9
    assert got[1]["mean_word_length"] == 3 and got[1]["unprose_share"] == 1 and "few_words" in got[1]["reasons"]
    solid = len(prose.replace(" ", "")), len("".join(rows.split()))
    assert abs(got[2]["unprose_share"] - solid[1] / sum(solid)) < 1e-9
    assert got[3]["bullet_line_share"] == 1


@pytest.mark.parametrize(
    "text",
    [
        "Der Kurs ist in dieser Woche nicht mehr gefallen, und die Kunden warten auf den Bericht von der Bank, die mit einer kleinen Gebühr rechnet.",
        "Bu hafta kur çok düşmedi ve bankanın raporu için bekleyen müşteriler daha küçük bir ücret ödemek istediklerini söylediler.",
        "El cambio no se ha movido esta semana, y los clientes que esperan el informe del banco dicen que la comisión es más pequeña.",
        "Le cours n'a pas bougé cette semaine, et les clients qui attendent le rapport de la banque disent que les frais sont plus petits.",
        "Kurs w tym tygodniu nie spadł, ale klienci czekają na raport banku i mówią, że opłata jest mniejsza niż przed rokiem.",
        "Курс цього тижня не впав, але клієнти чекають на звіт банку і кажуть, що комісія є меншою.",
        "لم يتغير السعر في هذا الأسبوع ولكن العملاء ينتظرون تقرير البنك من أجل معرفة الرسوم التي يدفعونها",
    ],
)
def test_sentences_of_other_languages_are_prose(text):
    x = judge(line_statistics(pa.array([text, "\n".join(text.split())])))
    assert x["fails"].any(0).tolist() == [False, True]


def test_each_rule_fails_alone():
    base = "we saw that the price of it was low and the fee was not"
    cases = {
        "few_words": "the price was low", "word_length": "a b c d e f g h the i j k l m n", "symbols": base + " $ # @ ", "lettered_words": "the price was low 1 2 3 4 5 6 on it", "common_words": "price fell again yesterday without warning",
        "bullets": "- the price of it was low", "word_shape": "the prIce oF it wAs low and noT so hIgh", "capitals": "The Price Of It Fell Again Share Menu Home Rates Load More", "commas": "the fee, a rate, the bar, it fell, low",
    }
    fails = judge(line_statistics(pa.array(list(cases.values()) + [base])))["fails"]
    for i, k in enumerate(cases):
        if k != "bullets":  # a dash may open speech
            assert fails[REASONS.index(k), i], k
    assert not fails[:, -1].any()
