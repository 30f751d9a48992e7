"""The JSON key equals Python's json.dumps and md5; codes and get-or-create on odd rows."""

import hashlib
import json

from pyspark.sql import functions as F

from ledgerlens.functions import fingerprint as P
from ledgerlens.operators import state as T


def test_equals_python(spark):
    texts = [None, "", "plain", 'q"uote\\back/', "line\nend\r\t\b\f", "\x00\x01\x1f\x7f", "é ü ﬀ  ", "😀 𝔘", "a" * 3000 + "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.fp for r in df.select("i", P.fingerprint_json({"evidence_text": F.col("t"), "as_of_date": F.lit("2024-12-31").cast("date"), "company_id": F.col("i")}).alias("fp")).collect()}
    for i, t in enumerate(texts):
        stable = json.dumps({"evidence_text": t or "", "as_of_date": "2024-12-31", "company_id": str(i)}, sort_keys=True, separators=(",", ":"))
        assert got[i] == hashlib.md5(stable.encode()).hexdigest(), t


def test_set_codes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "d")], "id int, code string")
    codes = spark.createDataFrame([(1, "a"), (2, "z"), (2, "y"), (3, None), (9, "q"), (None, "n")], "id int, code string")
    assert sorted(map(str, map(tuple, T.set_codes(rows, codes, "id", "code").collect()))) == ["(1, 'a', False)", "(2, 'y', True)", "(3, None, True)", "(None, 'd', False)"]


def test_get_or_create(spark):
    old = spark.createDataFrame([("x", 1), (None, 2)], "h string, id int")
    new = spark.createDataFrame([("x", 5), ("y", 7), ("y", 6), (None, 8)], "h string, id int")
    stored, answers = T.get_or_create(old, new, ["h"], [F.asc("id")])
    assert sorted(map(str, map(tuple, stored.collect()))) == ["('x', 1)", "('y', 6)", "(None, 2)"]
    assert sorted(map(str, map(tuple, answers.collect()))) == ["('x', 1, False)", "('y', 6, True)", "(None, 2, False)"]
