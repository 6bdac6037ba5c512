"""Schemas of the data model (Spark DDL)."""

from __future__ import annotations

BBOX = "x0 double, top double, x1 double, bottom double"
PAGE_KEY = "doc_sha string, page_no int"
GRID = "array<array<string>>"
VERIFY = "struct<status:string,missing:array<string>,reason:string>"
TABLE = f"struct<rows:int,cols:int,cells_src:{GRID},cells_ko:{GRID}>"
BLOCK = f"struct<id:string,type:string,bbox:array<double>,source:string,table:{TABLE},ko:string,verify:{VERIFY}>"

DOC = (
    "sha256 string, filename string, created_at timestamp, page_count int, has_text_layer boolean, page_width double, page_height double, "
    "outline array<struct<level:int,title:string,page:int>>, table_pages array<int>"
)
WORD = f"{PAGE_KEY}, text string, {BBOX}, size double"
PRIMITIVE = f"{PAGE_KEY}, {BBOX}, is_image boolean"
TABLE_CANDIDATE = f"{PAGE_KEY}, {BBOX}, cells {GRID}"
PAGE_DIM = f"{PAGE_KEY}, page_width double, page_height double"
LINE = f"{PAGE_KEY}, line_no int, text string, {BBOX}, size double"
GLOSSARY = "en string, ko string, note string"
BLOCK_ROW = f"{PAGE_KEY}, id string, type string, bbox array<double>, source string, table {TABLE}, ko string, verify {VERIFY}"
PAGE = f"page_no int, page_width double, page_height double, render_scale double, has_text_layer boolean, blocks array<{BLOCK}>"
PAGE_RESULT = f"{PAGE_KEY}, cache_key string, written_at timestamp, page_json string"
RESPONSE = f"{PAGE_KEY}, pos int, id string, ko string, cells_ko {GRID}"
JOB_EVENT = (
    "job_id string, seq bigint, type string, page int, done int, total int, reason string, cached boolean, warn_count int, skipped_count int, "
    f"page_width double, page_height double, blocks array<{BLOCK}>"
)
BLOCK_TYPES = ("heading", "paragraph", "list", "table", "figure", "caption", "header_footer")
UNTRANSLATED = ("header_footer", "figure")
