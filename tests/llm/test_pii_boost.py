import hashlib
import random
import re

import numpy as np

from quadlens.llm import pii_boost as pb

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    spans = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]:
                spans.append((m.start(), k, kind, m.end()))
    return sorted(spans)


def trained(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        number = f"{rng.randrange(10 ** 7, 10 ** 9)}"
        rows.append((i, f"words tel {phone} more words, part {number} end 10.{i % 255}.3.4"))
    return pb.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_base_spans_and_added_ones(spark):
    models = trained(spark)
    rng = random.Random(3)
    parts = ["1", "2", "45", "255", "256", ".", ".", "-", " ", "+", "@", "a", "b.c", "x_", "(", ")", "4", "0000", "é", "😀", "4111111111111111", "a@b.co",
             "1.2.3.4", "+1 (523) 555-1055", "\n", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(800)]
    texts += [None, "", "a@" + "b." * 5000 + "c", "1" * 20_000, "a" * 50_000 + "@x.y", "1.1.1.1." * 2000, "call (523) 555-1055 now", "me[at]mail.example.com"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "x@y.z", "z")], "doc_id long, text string, spans string")
    rows = pb.report(df, models).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        spans = base((texts[r["doc_id"]] if r["doc_id"] is not None else "x@y.z") or "")
        listed = [f"{kind}:{a}:{b}" for a, _, kind, b in spans]
        assert [r[f"n_{k}"] for k in pb.KINDS] == [sum(kind == k for _, _, kind, _ in spans) for k in pb.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}
    assert pb.report(df.limit(0), models).count() == 0


def test_kinds_with_few_spans_in_a_large_table_still_get_a_threshold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(24_000):
        phone = f"call tel +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} now" if i % 120 == 0 else "no number"
        rows.append((i, f"{phone}, part {rng.randrange(10 ** 7, 10 ** 9)} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = pb.fit(docs)
    assert models["phone"].threshold is not None
    one = spark.createDataFrame([(1, "call tel (523) 555-1055 now"), (2, "part 123456789 end")], "doc_id long, text string")
    assert [r["spans"] for r in pb.report(one, models).orderBy("doc_id").collect()] == ["phone:9:23", ""]


def test_trees_and_thresholds_are_those_of_all_candidates(spark):
    rng = random.Random(7)
    rows = []
    for i in range(12_000):
        number = f"{rng.randrange(10 ** 7, 10 ** rng.randrange(8, 12))}"
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}" if i % 4 == 0 else f"{rng.randrange(100, 999)}-{rng.randrange(10, 9999)}-{i}"
        rows.append((i, f"{rng.choice(['call', 'tel', 'part', 'see'])} {phone} or {rng.choice(['card', 'no', 'phone'])} {number} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pb.fit(docs)["phone"]
    found = pb.labelled(docs).select(*(f"c.{f}" for f in pb.FEATURES), "is_phone", "fit").collect()
    x, y, fit = np.array([r[:-2] for r in found], float), np.array([r["is_phone"] for r in found], float), np.array([r["fit"] for r in found])
    assert len(found) > 20_000 and y.sum() >= 3_000
    want = pb.boost(x, y, fit=fit, pull=fit.sum() / pb.PULL)
    assert model.start == want.start and model.threshold is not None
    assert np.isclose(model.threshold, want.threshold)
    assert np.allclose(sum(pb._value(t, x) for t in model.trees), sum(pb._value(t, x) for t in want.trees))


def test_samples_count_as_much_as_they_stand_for():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, len(pb.FEATURES)))
    y = (np.arange(500) < 250).astype(float)
    x[:, 0] = np.where(y > 0, 1.0, 0.0)
    x[260, 0] = x[265, 0] = 1.0  # among the calibration fifth: 2 for 50 hits, more than the precision allows
    assert pb.boost(x, y, np.where(y > 0, 1.0, 5.0)).threshold is None
    assert pb.boost(x, y, np.where(y > 0, 100.0, 1.0)).threshold is not None


def test_trees_in_sql_give_what_they_give_in_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(pb.FEATURES))).round(2)
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    model = pb.boost(x, y)
    assert model.trees and model.threshold is not None
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in pb.FEATURES))
    got = [r[0] for r in df.selectExpr("struct(*) as c").selectExpr(model.score("c")).collect()]
    assert np.allclose(got, model.start + sum(pb._value(t, x) for t in model.trees))
    assert pb.boost(x, np.zeros(400)).threshold is None


def test_redaction_keeps_columns_and_clean_texts(spark):
    models = {k: pb.Boosted(0.0, [], None) for k in pb.KINDS}
    rows = [(1, "é mail a@b.co, ip 1.2.3.4.", "p", 1), (2, "nothing", "q", 2), (3, None, "r", 3), (None, "+1 (523) 555-1055", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _spans int")
    got = pb.redacted(df, models)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == [(1, "é mail [EMAIL], ip [IP].", "p", 1), (2, "nothing", "q", 2),
                                                                   (3, None, "r", 3), (None, "[PHONE]", "s", 4)]
