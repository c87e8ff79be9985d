"""Explicit schemas of every table the library reads or writes, and the check for required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

COORDINATES = "Unicode string, Image string, X double, Y double, Width double, Height double"
#: By position, as written by the annotation tool; two columns between Y and Width are unused.
COORDINATES_BY_POSITION = "_0 string, _1 string, _2 string, _3 string, _4 string, _5 string, _6 string, _7 string"
PAGE_TEXT = "book_id string, page string, text string, size bigint"
DETECTIONS = "page string, tile_idx int, x1 double, y1 double, x2 double, y2 double, obj double, cls_conf double, cls int"
TILES = "page string, tile_idx int, x0 int, y0 int, w int, h int"
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
BOXES_JSON = "array<struct<x1:int,y1:int,x2:int,y2:int,score:double>>"
BOXES_JSON_LISTS = "array<array<double>>"
#: On disk a candidate is a list of a character and a probability, so both arrive as strings.
RECOGNITION_JSON = "array<struct<x1:int,y1:int,x2:int,y2:int,char:string,prob:double,top5:array<array<string>>>>"
CROPS = "char_id string, x int, y int, width int, height int, score double, unicode string, confidence double, source_page string"
ITEMS = f"page string, pos int, uni_true string, bbox {BOX}, topk array<struct<class_id:int,logp:double>>"
CLASSES = "class_id int, unicode string"
DECODED = "page string, pos int, gt string, greedy string, lm string, final string, topk_chars array<string>"
PIXELS = "image string, y int, x int, c int, v int"
PAGE_FOLDERS = "page string, input_path string, black_mask_path string, red_mask_path string"
SPLITS = "split string, document_id string"
CHAR_SAMPLES = "book_id string, cls string, path string"
NGRAMS = "n int, ctx array<string>, token string, log10_p double, log10_backoff double"


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself, or ValueError with the columns that it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
