import json

from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc import model as M
from loomdoc.operators import export, results, routing, translate
from loomdoc.sources import pdf, tables
from loomdoc.streaming import jobs


def block(id, kind, source=None, grid=None, ko=None):
    table = (len(grid), len(grid[0]), grid, None) if grid else None
    return (id, kind, [0.0, 0.0, 10.0, 10.0], source, table, ko, ("ok", [], None))


def pages(spark, rows):
    return spark.createDataFrame([("d", n, has, blocks) for n, has, blocks in rows], f"doc_sha string, page_no int, has_text_layer boolean, blocks array<{M.BLOCK}>")


LONG = "This paragraph is long enough to be read as clean text by the rules, with many words in it."


def test_routing(spark):
    bad = " ".join("abcdefghijklmnopqrstuvwxyzabcd") + "" * 6 + " " * 20
    df = pages(spark, [(1, False, []), (2, True, [block("a", "paragraph", LONG), block("b", "table", grid=[["1"]])]), (3, True, [block("a", "paragraph", LONG)]), (4, True, [block("a", "paragraph", bad)]), (5, True, [])])
    rows = df.select(routing.choose_model(F.col("has_text_layer"), F.col("blocks")), routing.quality_score(F.col("blocks")), routing.token_budget(F.col("blocks"))).collect()
    assert [r[0] for r in rows] == [C.MODEL_SCANNED, C.MODEL_IMAGE, C.MODEL_TEXT, C.MODEL_IMAGE, C.MODEL_IMAGE]
    assert rows[4][1] == 0.0 and rows[2][1] == 1.0 and rows[0][2] == 3000


def clumsy(request):
    """Loses digits at first, forgets page 2's second block for good, fails on page 3."""
    ids = request["ids"]
    if "p003-b00" in ids:
        raise ValueError("no answer")
    out = translate.offline(request)
    if request["temperature"] is None:
        out = [b | {"ko": "".join(c for c in b["ko"] if not c.isdigit())} if b["ko"] else b for b in out]
        out = [b for b in out if b["id"] != "p002-b01"]
    return out


def test_translation(spark):
    df = pages(spark, [(1, True, [block("p001-b00", "paragraph", "Rated current is 3,200 A."), block("p001-b01", "figure")]), (2, True, [block("p002-b00", "paragraph", "plain"), block("p002-b01", "paragraph", "needs 5")]), (3, True, [block("p003-b00", "paragraph", "needs 7")])])
    rows = df.select("doc_sha", "page_no", F.explode("blocks").alias("b")).select("doc_sha", "page_no", "b.*")
    done = {r["id"]: r for r in translate.translate_and_verify(df, rows, clumsy).collect()}
    assert done["p001-b00"]["verify"]["status"] == "ok" and done["p001-b00"]["ko"] == "Rated current is 3,200 A."
    assert done["p001-b01"]["ko"] is None
    assert done["p002-b01"]["ko"] == "needs 5"
    assert done["p003-b00"]["verify"]["status"] == "warn"
    errors = translate.ask(translate.requests(df), clumsy).filter("error IS NOT NULL").collect()
    assert [(r["page_no"], r["error"]) for r in errors] == [(3, "no answer")]


def test_retry_only_on_rate_limits():
    calls, waits = [], []

    def limited():
        calls.append(1)
        if len(calls) < 3:
            raise translate.RateLimited
        return []

    assert translate.with_retry(limited, sleep=waits.append) == [] and len(waits) == 2


def test_id_join_takes_the_last_answer(spark):
    rows = pages(spark, [(1, True, [block("a", "paragraph", "x"), block("b", "table", grid=[["1"]]), block("c", "paragraph", "y")])])
    rows = rows.select("doc_sha", "page_no", F.explode("blocks").alias("b")).select("doc_sha", "page_no", "b.*")
    answers = spark.createDataFrame([("d", 1, 0, "a", "first", None, None), ("d", 1, 1, "a", "last", None, None), ("d", 1, 2, "b", None, [["1"]], None), ("d", 1, 3, "z", "?", None, None)], translate.RESPONSE)
    done = {r["id"]: r for r in translate.apply_responses(rows, answers).collect()}
    assert done["a"]["ko"] == "last" and done["b"]["table"]["cells_ko"] == [["1"]] and done["c"]["ko"] is None
    wrong = translate.id_mismatch(rows, answers).first()
    assert wrong["missing"] == ["c"] and wrong["unknown"] == ["z"]
    nulled = {r["id"]: r for r in translate.null_missing(translate.apply_responses(rows, answers), translate.id_mismatch(rows, answers)).collect()}
    assert nulled["c"]["verify"]["missing"] == [C.NOTE_NO_BLOCK]


def test_stored_versions(spark, tmp_path):
    folder = tmp_path / "abc" / "pages"
    folder.mkdir(parents=True)
    for name, text in (("p001__k1.json", '{"page_no": 1}'), ("p001__k2.json", "{broken"), ("p002__k1.json", '{"page_no": 2}'), ("other.json", "{}")):
        (folder / name).write_text(text)
    import os

    os.utime(folder / "p001__k1.json", (1, 1))
    stored = tables.read_results(spark, str(tmp_path))
    assert results.translated_pages(stored).first()["translated_page_count"] == 2
    assert [r["page_no"] for r in results.stored_pages(stored, "page_no int").collect()] == [2]
    asked = results.requested(F.array(F.lit(2), F.lit(1)), stored.select("page_no").distinct()).collect()
    assert [r[0] for r in asked] == [2, 1]
    file = tmp_path / "up" / "x.pdf"
    file.parent.mkdir()
    file.write_bytes(b"abc")
    assert tables.read_uploads(spark, str(file)).first()["sha256"].startswith("ba7816bf")


def test_outline_and_scan(spark):
    rows = spark.createDataFrame([("d", 0, 1, 1), ("d", 1, 2, 3), ("d", 2, 2, 5), ("d", 3, 1, 9)], "doc string, i int, level int, page int")
    ends = results.section_ends(rows, "doc", "i", "level", "page", F.lit(20)).orderBy("i").collect()
    assert [r["end_page"] for r in ends] == [8, 4, 8, 20]
    dims = spark.createDataFrame([("d", 1, 600.0, 800.0), ("d", 2, 300.0, 400.0)], M.PAGE_DIM)
    words = spark.createDataFrame([("d", 2, "x", 0.0, 0.0, 1.0, 1.0, 1.0)], M.WORD)
    cand = spark.createDataFrame([("d", 2, 0.0, 0.0, 1.0, 1.0, [["a", ""]]), ("d", 1, 0.0, 0.0, 1.0, 1.0, [["", None, "", ""]])], M.TABLE_CANDIDATE)
    meta = tables.scan_documents(dims, words, cand).first()
    assert (meta["page_count"], meta["page_width"], meta["has_text_layer"], meta["table_pages"]) == (2, 600.0, True, [2])


def test_event_log_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("j", 0, 5, None, True, 1, 0), ("j", 1, 6, "boom", None, 9, 9), ("j", 2, 7, None, False, 0, 2)], "job_id string, order int, page int, error string, cached boolean, warn_count int, skipped_count int")
    log = jobs.page_events(rows)
    seen = [(r["seq"], r["type"], r["page"], r["done"]) for r in log.orderBy("seq").collect()]
    assert seen == [(0, "page_done", 5, None), (1, "progress", None, 1), (2, "page_error", 6, None), (3, "page_done", 7, None), (4, "progress", None, 2), (5, "job_done", None, None)]
    end = log.filter("type = 'job_done'").first()
    assert (end["warn_count"], end["skipped_count"]) == (1, 2)
    line = jobs.sse_lines(log.filter("seq = 1")).first()["line"]
    assert line.startswith("id: 1\ndata: ") and json.loads(line.split("data: ")[1]) == {"type": "progress", "done": 1, "total": 3}
    folder, check, got = str(tmp_path / "log"), str(tmp_path / "check"), []
    log.filter("seq < 3").coalesce(1).write.mode("append").parquet(folder)
    sink = lambda batch, _: got.extend(r["seq"] for r in batch.collect())
    jobs.deliver(jobs.event_stream(spark, folder), sink, check).awaitTermination()
    log.filter("seq >= 3").coalesce(1).write.mode("append").parquet(folder)
    jobs.deliver(jobs.event_stream(spark, folder), sink, check).awaitTermination()
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    jobs.progress_table(jobs.event_stream(spark, folder), "progress_rows", str(tmp_path / "c2")).awaitTermination()
    row = spark.table("progress_rows").first()
    assert (row["done"], row["failed"], row["ended"], row["warn_count"]) == (2, 1, 1, 1)
    gone = jobs.unknown_job(spark.createDataFrame([("j",), ("k",)], "job_id string"), log).collect()
    assert [(r["job_id"], r["seq"]) for r in gone] == [("k", -1)]


def test_html(spark):
    blocks = [block("a", "heading", "T", ko="<T>"), block("b", "header_footer", "x", ko="x"), block("c", "table", grid=[["1", None]]), block("d", "figure"), block("e", "paragraph", "p", ko="it's")]
    df = pages(spark, [(3, True, blocks)])
    one = df.withColumn("blocks", F.transform("blocks", lambda b: F.when(b["type"] == "table", b.withField("table", b["table"].withField("cells_ko", b["table"]["cells_src"]))).otherwise(b)))
    html = export.document_html(one, F.lit("A & B")).first()["html"]
    assert "<title>A &amp; B</title>" in html and "<h2>&lt;T&gt;</h2>" in html and "<tr><td>1</td><td></td></tr>" in html and "<p>it&#x27;s</p>" in html and 'id="page-3"' in html and "<figure>" not in html
    cropped = export.document_html(one, F.lit("A"), crop=lambda b: F.when(b["id"] == "d", F.lit(b"png"))).first()["html"]
    assert '<figure><img alt="" src="data:image/png;base64,cG5n"></figure>' in cropped


def test_pdf_source_registers(spark):
    pdf.register(spark)
    assert spark.read.format("pdf_words").option("paths", "").load().columns[:2] == ["doc_sha", "page_no"]


def test_results_and_records_are_stored_whole(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 3, "k", '{"page_no": 3}'), ("s1", 12, "k", '{"page_no": 12}'), ("s2", 1, None, "{}")], "doc_sha string, page_no int, cache_key string, page_json string")
    assert tables.write_results(rows, str(tmp_path / "docs")) == 2
    newer = spark.createDataFrame([("s1", 3, "k", '{"page_no": 3, "v": "새"}')], rows.schema)
    assert tables.write_results(newer, str(tmp_path / "docs")) == 1
    found = sorted(tuple(r) for r in tables.read_results(spark, str(tmp_path / "docs")).select("doc_sha", "page_no", "cache_key", "page_json").collect())
    assert found == [("s1", 3, "k", '{"page_no": 3, "v": "새"}'), ("s1", 12, "k", '{"page_no": 12}')]
    assert not [f for f in (tmp_path / "docs").rglob("*.tmp")] and tables.write_results(rows.limit(0), str(tmp_path / "none")) == 0
    docs = spark.createDataFrame([("s1", "a.pdf", 3, [(1, "T", 2)])], "sha256 string, filename string, page_count int, outline array<struct<level:int,title:string,page:int>>")
    assert tables.write_meta(docs, str(tmp_path / "meta")) == 1
    back = tables.read_meta(spark, str(tmp_path / "meta" / "*" / "meta.json")).first()
    assert (back["sha256"], back["page_count"], back["outline"][0]["title"], back["broken"]) == ("s1", 3, "T", False)


def test_page_done_carries_the_page(spark):
    rows = spark.createDataFrame([("j", 0, 5, None, True, 1, 0, 595.0, 842.0)], "job_id string, order int, page int, error string, cached boolean, warn_count int, skipped_count int, page_width double, page_height double")
    page = F.array(F.struct(F.lit("p005-b00").alias("id"), F.lit("heading").alias("type"), F.array().cast("array<double>").alias("bbox"), F.lit("x").alias("source"), F.lit(None).cast(M.TABLE).alias("table"), F.lit("y").alias("ko"), F.lit(None).cast(M.VERIFY).alias("verify")))
    log = {r["type"]: r for r in jobs.page_events(rows.withColumn("blocks", page)).collect()}
    done = log["page_done"]
    assert (done["page_width"], done["page_height"], done["blocks"][0]["ko"]) == (595.0, 842.0, "y") and log["progress"]["blocks"] is None


def test_second_requests_keep_title_terms_and_budget(spark):
    df = pages(spark, [(1, True, [block("b0", "paragraph", "needs 5 " * 200)])]).withColumn("terms", F.expr("array(named_struct('en', 'needs', 'ko', '필요', 'note', ''))"))
    rows = df.select("doc_sha", "page_no", F.explode("blocks").alias("b")).select("doc_sha", "page_no", "b.*").withColumn("verify", F.expr("named_struct('status', 'warn', 'missing', array('5'), 'reason', null)"))
    row = translate.retry_requests(rows, df, F.lit("T")).first()
    asked = json.loads(row["request"])
    assert asked["payload"]["doc_title"] == "T" and asked["payload"]["terms"][0]["en"] == "needs" and asked["budget"] == 6400 and "5" in row["note"]
    cut = translate.ask(translate.requests(df), lambda r: {"blocks": [], "finish": "length"}).first()
    assert "cut off" in cut["error"]


def test_sections_of_many_entries_take_time_in_proportion(spark):
    import time

    def seconds(n):
        rows = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("i"), (F.col("id") % 4).cast("int").alias("level"), (F.col("id") * 2).alias("page"))
        start = time.perf_counter()
        got = results.section_ends(rows, "doc", "i", "level", "page", F.lit(-1)).agg(F.sum("end_page"), F.count("*")).first()
        assert got[1] == n
        return time.perf_counter() - start

    seconds(1000)
    small, large = seconds(20_000), seconds(400_000)
    assert large < 20 * 2 * small + 5
