"""Schemas of the nested page files, repair payloads and session files."""

from __future__ import annotations

BOX = "struct<left:double,top:double,width:double,height:double>"

_BLOCK_META = (
    "segmenter:string,segmentation_mode:string,page_area_px:bigint,block_area_ratio:double,large_block:boolean,"
    "column_index:int,question_band_index:int,source_band_index:int,split_from_band:boolean,"
    "band_split_index:int,band_split_count:int,fill_ratio:double,mean_intensity:double,stddev:double,"
    "aspect_ratio:double,area_ratio:double,fallback_reason:string,ocr_backend:string,ocr_cache_hit:boolean,"
    "ocr_cache_miss:boolean,ocr_empty_text:boolean,ocr_latency_ms:int,ocr_line_count:int,ocr_text_length:int,"
    "display_title:string,force_problem_start:boolean,ai_grouping_role:string,grouping_source:string,"
    "grouping_reason:array<string>,block_type_source:string"
)
LINE = f"struct<text:string,confidence:double,bbox:{BOX}>"
STYLE = "struct<font_size:double,weight:string,italic:boolean,color:string,align:string,math_like:boolean>"
ASSET = (
    f"struct<asset_id:string,asset_type:string,source_path:string,crop_box:{BOX},"
    "width_px:int,height_px:int,mime_type:string>"
)
BLOCK = (
    f"struct<block_id:string,block_type:string,bbox:{BOX},reading_order:int,text:string,style:{STYLE},"
    f"confidence:double,asset:{ASSET},ocr_lines:array<{LINE}>,labels:array<string>,children:array<string>,"
    f"metadata:struct<{_BLOCK_META}>>"
)
PROBLEM = (
    "struct<unit_id:string,subject:string,title:string,stem_block_ids:array<string>,choice_block_ids:array<string>,"
    "explanation_block_ids:array<string>,figure_block_ids:array<string>,metadata:struct<problem_number:int,"
    "problem_number_source:string,fallback_grouping:boolean,grouping_index:int,grouping_mode:string,"
    "grouping_source:string,question_band_index:int,column_index:int,problem_marker:boolean,choice_marker:boolean,"
    "marker_conflict:boolean,marker_counts:map<string,int>>>"
)
_PAGE_META = (
    "source_type:string,ocr_mode:string,segmenter:string,segmentation_mode:string,block_count:int,"
    "text_block_count:int,image_block_count:int,large_block_count:int,large_block_ratio:double,"
    "max_block_area_ratio:double,mean_block_area_ratio:double,fallback_reasons:array<string>,column_count:int,"
    f"content_box:{BOX},content_box_area_ratio:double,board_region:{BOX},board_region_area_ratio:double,"
    "candidate_count:int,expanded_candidate_count:int,merged_candidate_count:int,document_split_applied:boolean,"
    "document_split_block_count:int,batch_source_index:int,batch_total_sources:int,original_page_index:int,"
    "ai_fallback:struct<enabled:boolean,attempted:boolean,applied:boolean,cache_hit:boolean,status:string,"
    "route:string,route_tier:string,trigger_reasons:array<string>>,"
    "route_decision:struct<route:string,should_use_ai:boolean,next_best_action:string,"
    "trigger_reasons:array<string>,profile:struct<tier:string,overall_risk:double>>"
)
# block_offset is the library's own: the place of the first block where a page is written in several rows.
PAGE_DDL = (
    "page_id string, width_px int, height_px int, subject string, source_path string, "
    f"blocks array<{BLOCK}>, problems array<{PROBLEM}>, metadata struct<{_PAGE_META}>, block_offset int"
)
BLOCK_META = {n: t for n, t in (field.split(":", 1) for field in _BLOCK_META.split(","))}

REPAIR_DDL = (
    "problem_start_block_ids array<string>, choice_block_ids array<string>, figure_block_ids array<string>, "
    "display_titles array<struct<block_id:string,title:string>>, notes array<string>"
)
