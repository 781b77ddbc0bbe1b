"""Schemas of the engine's tables."""

from __future__ import annotations

ITEM = "struct<name:string,quantity:double,unit_price:double,line_total:double>"
RECEIPT = f"struct<store_name:string,items:array<{ITEM}>,subtotal:double,discount:double,tax:double,service_charge:double,total:double,currency:string>"
RULE = "struct<name:string,status:string,detail:string>"
BOX = "struct<quad:array<array<double>>,text:string,score:double>"
PAIR = "struct<i:int,j:int,sim:double>"

#: Money fields; all but the discount are scored.
MONEY_FIELDS = ("subtotal", "discount", "tax", "service_charge", "total")
SCORED_FIELDS = ("total", "subtotal", "tax", "service_charge")

OCR = f"id string, boxes array<{BOX}>, lines array<string>, t_ocr double"
TRACE = (
    "id long, ts double, source string, receipt string, mode string, model string, prompt_version string, t_ocr double, t_llm double, t_validate double, "
    "t_total double, prompt_tokens int, completion_tokens int, n_boxes int, input string, output string, confidence double, decision string, rules string, error string"
)
REVIEW_EVENT = (
    "review_id string, seq long, ts double, kind string, receipt string, image_path string, model string, confidence double, reasons string, "
    "predicted string, corrected string, status string"
)
