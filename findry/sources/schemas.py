"""Explicit schemas of every file the toolkit reads."""

from __future__ import annotations

PASSAGE = (
    "_id string, id string, title string, text string, summary string, "
    # any field that a record has, also one that no operator knows
    "metadata map<string,string>"
)
PASSAGE_TSV = "id string, text string, title string"
QUERY = "_id string, text string"
QREL = "qid string, pid string, score int"
#: A context with all its fields: title, text, and perhaps id, score, ce_score ...
CTX = "map<string,string>"
EXAMPLE = (
    f"question string, answers array<string>, positive_ctxs array<{CTX}>, negative_ctxs array<{CTX}>, "
    f"hard_negative_ctxs array<{CTX}>"
)
GENERATION = (
    "doc_id string, input string, generated_text struct<role:string,content:string>, "
    "metadata struct<input_type:string,model:string,response:string>"
)
RESULT = f"qid string, question string, answers array<string>, ctxs array<{CTX}>"
EMBEDDING = "pid string, embedding array<float>"
TOKENS = "ord long, tokens array<int>"
