import re
import random

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, t string, id long, score double, n long, block int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text_words, size=5):
    if not text_words:
        return []
    return [tuple(text_words[i : i + size]) for i in range(max(1, len(text_words) - size + 1))]


def prose(seed, n, vocabulary=4000):
    """n words drawn by a seed."""
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows, extra=False):
    """Documents from (id, text) rows; with ``extra``, columns whose names the operators use inside."""
    if extra:
        return spark.createDataFrame([(i, t, "en", "s", 0, "own", -1, 0.5, 9, 3) for i, t in rows], CLASHING)
    return spark.createDataFrame(list(rows), "doc_id long, text string")
