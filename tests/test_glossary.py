import hashlib
import json

from pyspark.sql import functions as F

from loomdoc.functions import terms as K
from loomdoc.sources.tables import read_glossary

TERMS = ["conductor", "copper conductor", "sheath", "lay-up", "assembly", "box"]
CASES = {
    "The conductors shall comply with IEC 60228.": ["conductor"],
    "The copper conductor and its sheath were tested.": ["copper conductor", "sheath"],
    "Cable lay up and lay-up and layup are the same.": ["lay-up"],
    "ASSEMBLIES in boxes": ["assembly", "box"],
    "No relevant terms here.": [],
    "semiconductor sheath도": ["sheath"],
    "": [],
}


def test_matches(spark):
    glossary = spark.createDataFrame([(t, t.upper(), "", k) for k, t in enumerate(TERMS)], "en string, ko string, note string, pos int")
    df = spark.createDataFrame([(t,) for t in CASES], "t string").withColumn("m", K.match_terms(F.col("t"), glossary))
    for row in df.collect():
        assert [m["en"] for m in row["m"]] == CASES[row["t"]], row["t"]


def test_large_glossary_without_places(spark):
    glossary = spark.createDataFrame([(f'item{k} "q\\x', f"품목{k}", None if k % 2 else "n") for k in range(10_500)], "en string, ko string, note string")
    df = spark.createDataFrame([('an item10499 "q\\x and ITEM6 "q\\x.',), (None,)], "t string").withColumn("m", K.match_terms(F.col("t"), glossary))
    found = [[tuple(m) for m in r["m"]] for r in df.collect()]
    assert found == [[('item10499 "q\\x', "품목10499", None), ('item6 "q\\x', "품목6", "n")], []]


def test_hash_is_the_hash_of_canonical_json(spark):
    terms = [{"en": "b", "ko": "도체 \"x\"", "note": ""}, {"en": "a", "ko": "시스", "note": "외피"}]
    want = hashlib.sha256(json.dumps(sorted(terms, key=lambda t: t["en"]), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    rows = spark.createDataFrame([([tuple(t.values()) for t in terms],), ([tuple(t.values()) for t in reversed(terms)],)], f"t array<{K.TERM}>")
    assert {r[0] for r in rows.select(K.terms_hash(F.col("t"))).collect()} == {want}
    key = hashlib.sha256(f"{want}|v6|m|ko".encode()).hexdigest()[:16]
    assert rows.select(K.cache_key(F.col("t"), F.lit("m"))).first()[0] == key


def test_csv(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("en,ko,note\n conductor ,도체,\nsheath,,x\n,시스,\nXLPE,가교,약어 유지\n", encoding="utf-8")
    read = lambda: sorted(tuple(r) for r in read_glossary(spark, str(path)).collect())
    assert read() == [("XLPE", "가교", "약어 유지"), ("conductor", "도체", "")]
    path.write_text("en,ko,note\nsheath,시스,\n", encoding="utf-8")
    assert read() == [("sheath", "시스", "")]
