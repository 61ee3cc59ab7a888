import random
import re

from pyspark.sql import functions as F

from skein.functions import text as T

QUERY = "the lock is held"


def slow_excerpt(text, query, limit, snap):
    if len(text) <= limit:
        return text
    low, at = text.lower(), text.lower().find(query.lower())
    if at >= 0:
        start = at + len(query) // 2 - limit // 2
    else:
        tokens = list(dict.fromkeys(re.findall(r"[\w./:-]{3,}", query.lower())))
        starts = [max(0, low.find(t) - limit // 3) for t in tokens if t in low] or [0]
        start = max(starts, key=lambda s: (sum(low[s : s + limit].count(t) for t in tokens), -s))
    start = max(0, min(start, len(text) - limit))
    near = text[start : start + snap].find(" ")
    if start > 0 and near >= 0:
        start += near + 1
    return ("..." if start > 0 else "") + text[start : start + limit].strip(" ") + ("..." if start + limit < len(text) else "")


def test_token_path(spark):
    r = random.Random(3)
    texts = ["x" * 2000 + " Held by a LOCK " + "y" * 900, "the " + "z " * 600 + "lock held lock", "no such words " * 60, "é" * 500 + "lock"]
    texts += [" ".join(r.choice(["the", "lock", "held", "is", "lockheld", "a", "bbbb", "cc", "Thé", "lolock"] + ["filler"] * r.randrange(1, 40)) for _ in range(r.randrange(20, 400))) for _ in range(200)]
    got = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.excerpt(F.col("t"), QUERY)).collect()]
    assert "Held by a LOCK" in got[0] and got[1].endswith("lock held lock") and not got[2].startswith("...")
    assert got == [slow_excerpt(t, QUERY, 400, 40) for t in texts]
