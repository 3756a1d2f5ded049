"""Explicit schemas of the engine's inputs and outputs."""

from __future__ import annotations

CAPTION_SRC = "image_id string, spatial_caption string, coca_caption string, original_caption string"
DETECTION = "instance_id string, category string, original_label string, location array<double>, score double"
EXPANDED = (
    "image_id string, coca_caption string, spatial_caption string, expanded_caption string, optimize_caption string, "
    "intermediate_descriptions struct<direction:string,distance:string,contact:string,confidence:string>"
)
SENTENCE = "scene string, objects array<string>, direction string, fuzzy_distance string, sentence string"
FUZZY_MAP = "mapping map<string,string>, meta_info struct<definitions:map<string,string>>"
HARD_IMAGE = "struct<scores:struct<quantity:double,category:double,direction:double,distance:double,scene:double,detections:array<struct<box:array<double>>>>>"
HARD_EVAL = f"map<string,array<struct<sentence:string,images:array<{HARD_IMAGE}>>>>"
SOFT_IMAGE = "struct<image_idx:int,image_filename:string,clip_score:double,weighted_average:double,dimension_scores:map<string,double>,reasoning:string,error:string>"
SOFT_EVAL = f"map<string,array<struct<sentence_idx:int,sentence:string,scene:string,objects:array<string>,fuzzy_distance:string,images:array<{SOFT_IMAGE}>>>>"
SPLIT_MANIFEST = "file string, split string, size bigint"
TRAIN_ITEM = "image string, coca_caption string, spatial_caption string, original_caption string, second_optimize_caption string, image_id string, _preferred_caption string"
