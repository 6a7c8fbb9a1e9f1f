"""Schemas of the tables that the operators read. External effects (extraction from files, rendering,
model replies) enter as such tables."""

from __future__ import annotations

PAGES = "doc_id long, page_no int, native string, md string"
IMAGES = "doc_id long, page_no int, xref long, x0 double, y0 double, x1 double, y1 double, kind string"
SPANS = "page long, y double, x0 double, x1 double, text string, bold boolean"
OUTLINE = "doc_id long, ord int, level int, title string, start int, text_above boolean"
REPLIES = "key string, attempt int, cap int, text string, finish_reason string, prompt_tokens long, completion_tokens long, total_tokens long"
EVENTS = "event string, run long, page int, done int, selected int, todo int, cost double, at double"
SYSTEM = "os string, cpu string, cores int, ram_gb double, disk_free_gb double, gpus array<struct<name:string,vendor:string,dedicated_gb:double,shared_gb:double,integrated:boolean,unified:boolean,driver:string,source:string>>"
DOCUMENT = "id string, name string, filename string, kind string, size long, added string, folder string, pages int, edited array<int>, checks map<string,array<string>>"
PULLS = "seq long, digest string, total long, completed long, status string"
