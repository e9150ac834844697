"""Schemas of the tables."""

PARAGRAPH = "struct<box:array<int>,contents:string,role:string,direction:string,order:int>"
WORD = "struct<points:array<array<int>>,content:string>"
ANALYSIS_JSON = f"paragraphs array<{PARAGRAPH}>, words array<{WORD}>"
PAGE_ANALYSIS = f"book_id string, page_index int, raw_markdown string, figure_paths array<string>, paragraphs array<{PARAGRAPH}>, words array<{WORD}>"
DETECTIONS = "book_id string, page_index int, det_idx int, box struct<x1:int,y1:int,x2:int,y2:int>, type string, latex string, score double"
PAGES_MD = "book_id string, page_index int, markdown string, raw_markdown string, assets array<string>"
PDF_TOC = "book_id string, pos int, title string, page_no int"
CHAPTERS = "book_id string, ord int, kind string, chapter_number int, title string, start_page int, end_page int, source string"
