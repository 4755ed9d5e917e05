import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from rateframe.llm import pii
from tests.llm.helpers import prose, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TEXTS = [
    None, "", "nothing here", "a@b.c_d@e.f", "a@b.c@d.e x..y@z..w a@b..c", "é🎉 joe.x@mail.co.uk, 1.2.3.45.6.7.8 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 +1 (456) 555-2186 and +44-20-7946-0958.", "4111-1111-1111-1112 4111111111111111x 1 2 3 4 5 6 7 8 9 0 1 2",
    "1.2.3.4.5@x.y.z %+-a@-.-", "+1+2+3 +1 2 3 4 5 6 7 8 9", "999.1.1.1 0001.002.3.255", "a.b.c.d@e.f.g.h.  x@yz", "a@b.c  1.2.3.4",
    "1." * 3000 + "1", "a@" + "b." * 5000 + "c", "1 " * 20_000, "9" * 50_000, "+1" + " " * 30_000 + "2", "+" * 5000, "a" * 100_000 + "@",
    "4242424242424242 " + prose(4, 20_000) + " x@y.zz",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_equal_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start int, kind string")
    found = pii.personal_data(docs)
    own = pii.listed(F.filter("spans", lambda s: s["base"]))
    for row in found.select("doc_id", own.alias("b"), F.sha2(own, 256).alias("h"), "start", "kind").collect():
        expected = base(TEXTS[row.doc_id] or "")
        assert row.b == expected, row.doc_id
        assert row.h == hashlib.sha256(expected.encode()).hexdigest() and (row.start, row.kind) == (5, "x")


def test_looser_forms_need_support(spark):
    rows = [(i, f"write to someone{i}@mail.com or +1 (456) 555-{i:04d}") for i in range(1000, 1060)]
    rows += [(1, "please call 456-555-2186 now"), (2, "order 456-555-2186 shipped"), (3, "contact joe [at] mail [dot] com today"),
             (4, "card 4111-1111-1111-1112 is no card"), (5, "at 999.1.1.1 nothing lives")]
    found = {r.doc_id: r.s for r in pii.personal_data(table(spark, rows)).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert found[1] == "phone:12:24" and found[3].startswith("email:8:")
    assert found[2] == found[4] == found[5] == ""


def test_expectation_maximisation_finds_the_unreliable_labeler():
    import numpy as np

    draw = np.random.default_rng(5)
    truth = draw.random(4000) < 0.5
    right = np.array([0.95, 0.9, 0.58, 0.9, 0.9])
    votes = np.where(draw.random((4000, 5)) < right, truth[:, None], ~truth[:, None]) * 2.0 - 1
    found, accuracy = pii.expected_labels(votes, np.zeros(4000, dtype=int), np.ones(4000))
    assert np.abs(accuracy - right).max() < 0.04 and ((found > 0.5) == truth).mean() > 0.95


def test_pieces_cut_no_span(spark, monkeypatch):
    draw = random.Random(7)
    bits = ["a@b.cc", "1.2.3.4", "+1 (456) 555-2186", "4111 1111 1111 1111", "joe [at] mail [dot] com", "456-555-2186", "call", "é", ",", "\n", " ", "x", "7", "+", ".", "-"]
    texts = ["".join(draw.choice(bits) + draw.choice(["", "", " "]) for _ in range(60)) for _ in range(150)]
    docs = table(spark, list(enumerate(texts)))
    model = pii.train(docs)
    text = F.col("text")

    def seen(size):
        monkeypatch.setattr(pii, "PIECE", size)
        found = pii.personal_data(docs, model=model)
        rows = found.select("doc_id", F.to_json("spans"), pii.listed(F.filter("spans", lambda s: s["base"])), pii.masked_text(text, model), pii.masked(text, F.col("spans")))
        return {tuple(r) for r in rows.collect()}, docs.select(F.sum(F.size(pii._pieces(text)))).first()[0]

    (whole, one), (cut, many) = seen(10_000), seen(5)
    assert whole == cut and one == len(texts) and many > 10 * len(texts)
    for doc_id, _, spans, masked, by_spans in cut:
        assert spans == base(texts[doc_id]) and masked == by_spans


def test_time_grows_with_the_number_of_spans(spark):
    def seconds(n):
        text = " ".join(f"user{i}@mail{i}.com" for i in range(n))
        docs, begin = table(spark, [(1, text)]), time.time()
        row = pii.personal_data(docs).select(F.size("spans").alias("n"), F.length(pii.masked_text(F.col("text"), pii.train(docs))).alias("m")).first()
        assert (row.n, row.m) == (n, 8 * n - 1)
        return time.time() - begin

    seconds(10)
    assert seconds(40_000) < 60


def test_masking(spark):
    rows = [(1, "é a@b.cc, +1 (456) 555-2186!"), (2, None), (3, "plain"), (4, "1.2.3.4.5@x.yy end")]
    found = pii.personal_data(table(spark, rows))
    masked = {r.doc_id: r.m for r in found.select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert masked == {1: "é [EMAIL], [PHONE]!", 2: None, 3: "plain", 4: "[EMAIL] end"}


def test_repeated_rows_empty_tables_and_taken_names(spark):
    rows = [(None, "a@b.cc"), (None, "a@b.cc"), (1, "a@b.cc"), (1, "a@b.cc")]
    assert [len(r.spans) for r in pii.personal_data(table(spark, rows)).collect()] == [1, 1, 1, 1]
    assert pii.personal_data(table(spark, [])).count() == 0
    odd = table(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("spans", "candidates", "pii_text", "at", "own", "a.b")])
    found = pii.personal_data(odd)
    assert found.columns == [*table(spark, rows).columns, "own_spans", "candidates", "pii_text", "at", "own", "a.b", "spans"]
    assert all(len(r.spans) == 1 and r.own_spans == 1 for r in found.collect())


def test_no_python_in_the_plan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
