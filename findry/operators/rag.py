"""Prompt rows for retrieval-augmented generation, and packed result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findry.operators.indexing import index_within
from findry.functions.text import content_key, truncate

# The context template and the system prompt, in the source language.
CONTEXT_TEMPLATE = "제목: {title}, 요약문: {text}"
SYSTEM_PROMPT = (
    "마지막 질문에 답하기 위해서 다음 문맥을 사용하세요.\n"
    "답을 모르면 모른다고 말하고 답을 만들어내려고 하지 마세요.\n"
    "답변은 최대한 간결하게 유지하세요.\n"
)
QUERY_LINE = "# 검색 질의: {query}.\n"
CONTEXT_LINE = "# 검색 결과: {context}\n"


def _fill(template: str, **values: Column) -> Column:
    """A ``{name}`` template as a column expression."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def llm_requests(df: DataFrame, prompt: str, id_col: str = "pid", text_col: str = "text") -> DataFrame:
    """One request per document: ``(doc_id, input, messages)``."""
    messages = F.array(_message("system", F.lit(prompt)), _message("user", F.col(text_col)))
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("input"), messages.alias("messages")
    )


def rag_context(
    results: DataFrame,
    n: int = 5,
    per_doc: int = 500,
    total: int = 2000,
    template: str = CONTEXT_TEMPLATE,
) -> DataFrame:
    """``(qid, context, full_lengths)`` of the best ``n`` hits of each query.

    ``results(qid, rank, title, text)``. Each document fills the template,
    cut to ``per_doc`` characters; the joined context is cut to ``total``.
    ``full_lengths`` are the lengths before cutting.
    """
    full = _fill(template, title=F.coalesce("title", F.lit("")), text=F.coalesce("text", F.lit("")))
    top = results.where(F.col("rank") <= n).select(
        "qid", "rank", truncate(full, per_doc).alias("doc"), F.length(full).alias("len")
    )
    # the rank filter bounds the group to n short texts
    packed = top.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("rank", "doc", "len"))).alias("_d")
    )
    return packed.select(
        "qid",
        truncate(F.array_join("_d.doc", " \n"), total).alias("context"),
        F.col("_d.len").alias("full_lengths"),
    )


def chat_history(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, role, content)``: all messages of a conversation in turn order.

    System turns are left out. One row per message, numbered from 0, so a
    conversation of any length is gathered nowhere. Turns that tie go by role,
    by the first 64 code points of their text, then by its key.
    """
    turns = conversations.where(F.col("role").isin("user", "assistant"))
    turns = turns.select("conv_id", "turn", "role", F.col("text").alias("content"))
    turns = turns.withColumns(
        {"_head": F.substring("content", 1, 64), "_key": content_key(F.col("content"))}
    )
    placed = index_within(turns, "conv_id", ["turn", "role", "_head", "_key"], "place")
    return placed.select("conv_id", "place", "role", "content")


def rag_messages(
    context: DataFrame,
    history: DataFrame | None = None,
    prompt: str = SYSTEM_PROMPT,
) -> DataFrame:
    """``(qid, place, role, content)``: system prompt with query and context, history, new message.

    ``context(qid, query, context, message)``; ``history(qid, place, role,
    content)`` holds the earlier messages and may lack a query. One row per
    message; all of the history is in, in order.
    """
    system = F.concat(
        F.lit(prompt),
        _fill(QUERY_LINE, query=F.coalesce("query", F.lit(""))),
        _fill(CONTEXT_LINE, context=F.coalesce("context", F.lit(""))),
    )
    first = F.lit(0).cast("long").alias("place")
    out = context.select("qid", first, F.lit("system").alias("role"), system.alias("content"))
    said = context.select("qid", F.col("message").alias("content"))
    last = F.lit(1).cast("long")
    if history is not None:
        past = history.join(context.select("qid"), "qid", "left_semi")
        out = out.unionByName(
            past.select("qid", (F.col("place") + 1).alias("place"), "role", "content")
        )
        sizes = history.groupBy("qid").agg(F.count("*").alias("n"))
        said = said.join(sizes, "qid", "left")
        last = F.coalesce("n", F.lit(0)) + 1
    return out.unionByName(
        said.select("qid", last.alias("place"), F.lit("user").alias("role"), "content")
    )


def pack_results(
    ranked: DataFrame, kind: str = "retrieved", index: str = "", k: int = 10
) -> DataFrame:
    """Nested result per query: ``(qid, type, topk, index, results)``.

    ``ranked(qid, rank, score, pid, title, text)``; each result is
    ``{rank, score, doc_info}``. A group holds at most k hits.
    """
    doc = F.struct(F.col("pid").alias("_id"), "title", "text").alias("doc_info")
    hit = F.struct("rank", "score", doc)
    return (
        ranked.where(F.col("rank") <= k)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(hit)).alias("results"))
        .select(
            "qid",
            F.lit(kind).alias("type"),
            F.lit(k).alias("topk"),
            F.lit(index).alias("index"),
            "results",
        )
    )


def pack_ctxs(ranked: DataFrame) -> DataFrame:
    """``(qid, ctxs)`` with contexts ``{id, title, text, score}``, the score as text.

    A group holds the ranked hits of one query.
    """
    ctx = F.struct(
        F.col("pid").cast("string").alias("id"),
        "title",
        "text",
        F.col("score").cast("string").alias("score"),
    ).alias("ctx")
    packed = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", ctx))).alias("_r"))
    return packed.select("qid", F.col("_r.ctx").alias("ctxs"))


def context_lengths(contexts: DataFrame) -> DataFrame:
    """Length statistics of assembled contexts."""
    n = F.length("context")
    return contexts.agg(
        F.count("*").alias("n"),
        F.min(n).alias("shortest"),
        F.max(n).alias("longest"),
        F.round(F.avg(n), 6).alias("mean"),
    )
