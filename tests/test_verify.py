import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.functions import pages as P
from loomdoc.functions import text as T
from loomdoc.functions import verify as V

LONG = "Dies ist ein langer deutscher Satz ohne jede Zahl, der vierzig Zeichen hat."
CASES = [
    ("The conductor shall be 2.5 mm² per IEC 60502-2.", "도체는 IEC 60502-2에 따라 2.5 mm²여야 한다.", "ok", None),
    ("Rated current is 3,200 A.", "정격 전류이다.", "warn", "3200"),
    (LONG, "이것은 შესაბამის 숫자가 없는 긴 문장이며 마흔 글자보다 깁니다.", "warn", C.NOTE_FOREIGN),
    (LONG, "짧은 번역이다", "warn", C.NOTE_TRUNCATED),
    ("Wert beträgt 71,36 mm.", "값은 71,36 mm이다.", "skipped", None),
    ("Published in February 2026.", "2026년 2월 발행.", "ok", None),
    ("• one\n• two\n• three", "• 하나\n• 둘\n• 셋", "ok", None),
    ("• one\n• two\n• three", "• 하나 • 둘 • 셋", "warn", C.NOTE_LINES),
    ("in 2026, the", "in 2026, the", "skipped", None),
    ("short text", None, "ok", None),
    ("", "anything 5", "ok", None),
    (None, None, "ok", None),
    ("one 5", "one 5 and 6", "ok", None),
    ("5 and 5", "5", "warn", "5"),
]


def test_text_cases(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(CASES)], "i int, a string, b string")
    for compose in (V.nfkc, V.nfkc_table):
        rows = V.with_text_check(df, F.col("a"), F.col("b"), "v", compose).orderBy("i").collect()
        for row, (source, _, status, missing) in zip(rows, CASES, strict=True):
            assert row["v"]["status"] == status, source
            assert missing is None or any(missing in m for m in row["v"]["missing"])


def test_normalise_and_tokens(spark):
    texts = ["Range: 30–50 ℃, load ½ of 1 234 N", "30-50 °C", "1½", "ASTM B8", "P/N: AB-123 and EN 50267"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(V.normalise(F.col("t")).alias("n"), V.tokens(F.col("t")).alias("k"))
    a, b, c, d, e = df.collect()
    assert "1234" in a["n"] and "0.5" in a["n"] and "30-50" in a["n"]
    assert b["k"]["unit_numbers"] == ["-50 °C"] and b["k"]["bare_numbers"] == ["30"]
    assert c["n"] == "10.5"
    assert d["k"]["spec_numbers"] == []
    assert e["k"]["part_numbers"] == ["P/N: AB-123"] and e["k"]["spec_numbers"] == ["EN 50267"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_nfkc(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(V.nfkc(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]


def test_table_cases(spark):
    grids = [
        ([["a", "1.5"], ["b", "2"]], [["가", "1.5"], ["나", "2"]], "ok"),
        ([["a", "1.5"], ["b", "2"]], [["가", "1.5", "x"]], "warn"),
        ([["a", "1.5"]], [["가", "1.6"]], "warn"),
        ([["a", "71,36"]], [["가", "9"]], "ok"),
        ([["a", None]], [["가", "9"]], "ok"),
        ([["a"]], None, "warn"),
        (None, None, "ok"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(grids)], "i int, a array<array<string>>, b array<array<string>>")
    rows = df.select("i", V.check_table(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()
    assert [r["v"]["status"] for r in rows] == [s for _, _, s in grids]
    assert rows[2]["v"]["missing"] == ["[0,1] '1.5' -> '1.6'"]
    assert rows[5]["v"]["missing"] == [C.NOTE_NO_TABLE]


def test_table_blocks_have_full_nfkc(spark):
    """A changed number passed in every cell that only NFKC makes a number."""
    cells = ["⁵", "①", "𝟏𝟐", "12\u202f000", "５", "½", "\u00a07 ", "x⁵", "1\x1e2", "71,36"]
    grids = [([cells, ["a"], [], [None, "⁸"]], [["0"] * 10, ["b"], [], ["1", "9"]]), ([["⁵"]], [["⁵"]]), ([], [["1"]]), (None, None), ([["1"]], None)]
    rows = [(i, "table", None, None, (a, b), None) for i, (a, b) in enumerate(grids)] + [(9, "paragraph", "5 A", "6 A", None, None)]
    verify = "struct<status:string,missing:array<string>,reason:string>"
    df = spark.createDataFrame(rows, f"i int, type string, source string, ko string, table struct<cells_src:array<array<string>>,cells_ko:array<array<string>>>, verify {verify}")
    for compose in (V.nfkc, V.nfkc_table):
        got = V.with_block_check(df, compose).orderBy("i").collect()
        assert [r["verify"]["status"] for r in got] == ["warn", "ok", "ok", "ok", "warn", "warn"]
        if compose is V.nfkc:
            assert got[0]["verify"]["missing"] == [*(f"[0,{k}] '{cells[k]}' -> '0'" for k in range(7)), "[3,1] '⁸' -> '9'"]


def test_formulas_and_cleaning(spark):
    yes = ["x 4 8 f y s ; x 2 10 7 k (2.2) s 192 0,8 x 4 s R s s DC", " 0,2857W/mK c2300Ws/kgK  930kg/m 3 PE, , ,", "k =0,35 , k =0,2 s p", "Ra =Pr·Gr . (2.12)"]
    no = ["The conductor shall comply with IEC 60228 Class 2.", "Der Wert ist sehr wichtig für die Berechnung.", "für eine um 10 cm", "Abb. 3: Aufbau des Kabels ................. 12", ""]
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, want boolean")
    assert df.filter(T.looks_like_formula(F.col("t")) != F.col("want")).count() == 0
    one = spark.createDataFrame([(" = 0,40W/mK ", " , a ,, , b  c;", "12 mm2 x")], "a string, b string, c string")
    row = one.select(T.repair_symbols(F.col("a")), T.clean(F.col("b")), T.clean_cells(F.array(F.array("c", F.lit(None), F.lit("")))), T.is_stray(F.lit("²"))).first()
    assert row[0] == "λ = 0,40W/mK " and row[1] == "a, , b c" and row[2] == [["12 mm² x", None, ""]] and row[3] is False
    lines = spark.range(1).select(T.join_lines(F.array(F.lit("con-"), F.lit("ductor and"), F.lit("• item"), F.lit("more"))).alias("j"))
    assert lines.first()[0] == "conductor and\n• item more"


def test_ranges(spark):
    ask = lambda t, lenient=False: spark.range(1).select(P.parse_range(F.lit(t), lenient)).first()[0]
    assert ask("12-18, 25, 40-47") == [*range(12, 19), 25, *range(40, 48)]
    assert ask("18-12") == [] and ask(" , ") == [] and ask("3, 1-2, 2") == [1, 2, 3]
    assert ask("x, 4", lenient=True) == [4]
    row = spark.range(1).select(P.eta_text(F.lit(15)), P.eta_text(F.lit(120)), P.eta_text(F.lit(75)), P.page_of_name(F.lit("a/pages/p012__ab.json")), P.toggled(F.array(F.lit(1), F.lit(3)), F.lit(3))).first()
    assert list(row) == ["15초", "2분", "1분 15초", 12, [1]]
