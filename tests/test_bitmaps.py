import random

import pytest

from rateframe.operators import bitmaps, content
from rateframe.operators.facts import pair_facts, single_facts

SCHEMA = "g string, a bigint, b int, x double"
IDS, SUMS = ("a", "b"), ("x",)


def rows(seed, n):
    draw = random.Random(seed)
    pick = lambda *v: draw.choice(v)
    return [(pick("p", "q", "", None), pick(None, 0, 7, 32767, 32768, 10**12, -1, -32768, draw.randrange(200000)), pick(None, 1, draw.randrange(50)), pick(None, 0.5, 4.0)) for _ in range(n)]


def expected(given):
    out = {}
    for g, a, b, x in given:
        seen = out.setdefault(g, (set(), set(), [0.0]))
        seen[0].update([a] if a is not None else [])
        seen[1].update([b] if b is not None else [])
        seen[2][0] += x or 0.0
    return {g: (len(a), len(b), x[0]) for g, (a, b, x) in out.items()}


def counted(state):
    return {r.part: (r.a, r.b, r.x) for r in bitmaps.counts_of(state, IDS, SUMS).collect()}


@pytest.mark.parametrize("held", [8192, 3])
def test_distinct_counts_and_sums(spark, monkeypatch, held):
    monkeypatch.setattr(bitmaps, "HELD_BITMAPS", held)
    given = rows(1, 3000)
    frame = spark.createDataFrame(given, SCHEMA).repartition(5)
    assert counted(bitmaps.distinct_state(frame, "g", IDS, SUMS)) == expected(given)


def test_states_of_two_batches_merge(spark, tmp_path):
    batches = [rows(2, 900), rows(3, 700)]
    for i, batch in enumerate(batches):
        bitmaps.distinct_state(spark.createDataFrame(batch, SCHEMA), "g", IDS, SUMS).write.parquet(str(tmp_path / str(i)))
    stored = [spark.read.parquet(str(tmp_path / str(i))) for i in range(2)]
    assert counted(bitmaps.merge_states(*stored, sums=SUMS)) == expected(batches[0] + batches[1])


def test_nothing(spark):
    assert counted(bitmaps.distinct_state(spark.createDataFrame([], SCHEMA), "g", IDS, SUMS)) == {}


def test_genres_of_two_batches_merge_to_those_of_all(spark):
    draw = random.Random(4)
    given = [(draw.randrange(1, 90), draw.randrange(1, 40), draw.randrange(1, 11) / 2, i) for i in range(2000)]
    schema = "userId int, movieId int, ratingActual double, timestampEpochSeconds bigint"
    movies = spark.createDataFrame([(m, f"t{m}", "|".join(["A", "B", "C"][: m % 4])) for m in range(1, 35)], "movieId int, title string, genres string")
    part = lambda some: content.genre_state(single_facts(spark.createDataFrame(some, schema)), movies)
    merged = bitmaps.merge_states(part(given[:600]), part(given[600:]), sums=content.GENRE_SUMS)
    whole = content.genre_stats(pair_facts(spark.createDataFrame(given, schema)), movies)
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(content.genre_stats_of(merged)) == rounded(whole) and whole.count() == 3
