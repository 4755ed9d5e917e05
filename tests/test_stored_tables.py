"""Base tables of a stored job: each report reads a fold that is there already, with the numbers it had from the rows."""

import re

import pytest

from rateframe.operators import content, quality, tags as tag_ops
from rateframe.plans import collectors
from rateframe.plans.collectors import Inputs

DAY = 86400


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark):
    rated = [(u, m, (1 + (u * m) % 9) / 2, 1_000_000_000 + u * 7 * DAY + m) for u in range(1, 13) for m in range(1, 9) if (u + m) % 3]
    rated += [rated[0], rated[5], (None, 2, 4.0, 1_000_000_000), (99, 8, None, None)]
    movies = [(m, f"m{m}", "A|B|A" if m % 2 else "B") for m in range(1, 8)] + [(3, "again", "C"), (8, "nobody", "D"), (None, "none", "A")]
    tagged = [(u, m, f"t{(u + m) % 3}", 5) for u in range(1, 13) for m in range(1, 8) for _ in range(u % 2 + 1)]
    tagged += [(None, 2, "t1", 5), (4, None, "t1", 5), (1, 1, None, 5), (77, 1, "t2", 5)]
    return Inputs(
        spark.createDataFrame(rated, "userId int, movieId int, ratingActual double, timestampEpochSeconds bigint"),
        spark.createDataFrame(movies, "movieId int, title string, genres string"),
        spark.createDataFrame(tagged, "userId int, movieId int, tag string, timestamp bigint"),
        1_100_000_000,
    ).store()


def test_prepare_keeps_every_table(stored):
    stored.prepare()
    names = ["seen", "histogram", "pairs", "profile", "users_seen", "segments", "movie_facts", "movies_seen", "recent", "cube",
             "top", "genres", "tag_counts", "tagged"]
    assert set(names) <= set(vars(stored))


def test_reports_do_not_bring_tags_and_ratings_together_again(stored):
    for collect in (collectors.data_quality, collectors.tag_analytics):
        shown = collect(stored)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(movieId#\d+, userId#\d+", shown)


def test_no_python_for_times_that_are_known(stored):
    shown = quality.recency_after(stored.ratings, stored.seen)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in shown
    assert rows_of(quality.recency_after(stored.ratings, stored.seen)) == rows_of(quality.recency(stored.ratings))
    none = stored.ratings.limit(0)
    assert rows_of(quality.recency_after(none, quality.overview(none, 0))) == rows_of(quality.recency(none))


def test_same_numbers_as_from_the_rows(stored):
    assert rows_of(quality.orphan_tags_of(stored.tagged)) == rows_of(quality.dq_orphan_tags(stored.tags, stored.pairs))
    from_rows = tag_ops.tag_rating_affinity(stored.tags, stored.pairs)
    assert rows_of(tag_ops.affinity_of(stored.tagged.filter("rated"))) == rows_of(from_rows) and from_rows.count() == 2
    genres = content.genre_stats(stored.pairs, stored.movies)
    assert rows_of(stored.genres) == rows_of(genres) and genres.count() == 4
    assert stored.genres.dtypes == genres.dtypes
