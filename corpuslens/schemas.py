"""Schemas of the records that flow through the library, as DDL (readers, casts and from_json take it)."""

from __future__ import annotations

PAGE = "page_num INT, text STRING"
OUTLINE = "pos INT, level INT, title STRING, page INT"
CHAPTER = "book_num INT, chapter_num INT, chapter_title STRING, text STRING, page_start INT, page_end INT"
BOOKS = "books ARRAY<STRUCT<book_num: INT, title: STRING, chapters: ARRAY<STRUCT<chapter_num: INT, chapter_title: STRING, page_start: INT, page_end: INT, text: STRING>>>>"
CHUNK = "id STRING, book_num INT, chapter_num INT, chapter_title STRING, text STRING, chunk_type STRING, characters ARRAY<STRING>, page_start INT"
CANDIDATE = "id STRING, score DOUBLE, source STRING, text STRING, book_num INT, chapter_num INT, chapter_title STRING, page_start INT, characters ARRAY<STRING>"
ALIASES = "MAP<STRING, STRUCT<label: STRING, aliases: ARRAY<STRING>>>"
OVERRIDES = "drop ARRAY<STRING>, force_merge ARRAY<ARRAY<STRING>>"
FINDING = "STRUCT<answer: STRING, source_ids: ARRAY<STRING>, conviction: INT, gaps: ARRAY<STRING>>"
TURN = f"thread_id STRING, turn_no LONG, query STRING, rewritten_query STRING, finding {FINDING}, candidates ARRAY<STRUCT<{CANDIDATE.replace(' ', ': ').replace(',: ', ', ')}>>"
