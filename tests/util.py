import datetime
import math


def plain(v):
    if hasattr(v, "item") and not isinstance(v, (list, str)):
        v = v.item() if getattr(v, "size", 1) == 1 else v.tolist()
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(df, *columns):
    return sorted((tuple(plain(r[c]) for c in columns or df.columns) for r in df.collect()), key=repr)


def same_as_sql(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    want = sorted((tuple(plain(v) for v in r) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert rows(df, *columns) == want
