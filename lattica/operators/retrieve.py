"""Retrieval: search, gate, merge and pack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import Evidence

MAX_LIMIT, MAX_PAGE = 100, 200
#: Tokens that a chat template may add.
ALLOWANCE = 32


def checked_limit(limit: int, most: int = MAX_LIMIT) -> int:
    """A caller's limit: an error if not positive, at most ``most``."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return min(limit, most)


def first(evidence: Evidence, limit: int) -> Evidence:
    """The first ``limit`` rows of each query, in rank order."""
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = evidence.rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return Evidence(evidence.kind, rows)


def interleave(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """(query_id, pos, kind, id) from two ranked lists (query_id, rank, id): a first, in turns.

    When one list ends, the rest of the other follows.
    """
    order = Window.partitionBy("query_id").orderBy("rank", "id")
    place = lambda df, side, kind: df.select("query_id", "id", F.lit(kind).alias("kind"), (2 * (F.row_number().over(order) - 1) + side).alias("p"))
    both = place(a, 0, "chunk").unionByName(place(b, 1, "relationship"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("p"))
    return both.withColumn("pos", pos).where(F.col("pos") <= limit).select("query_id", "pos", "kind", "id")


#: What a request may ask for.
INTENTS = ("fact", "bridge", "automatic")


def by_intent(requests: DataFrame, chunks: DataFrame, relationships: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(outcomes, evidence) of requests (query_id, intent, has_edges, states).

    ``fact`` takes chunks (query_id, rank, id), ``bridge`` relationships
    (query_id, rank, id, review_state) in one of the request's ``states``, and
    ``automatic`` both in turns. Where there is no edge store (``has_edges``),
    bridge is ``unavailable`` and automatic gets chunks alone. A request that
    would read relationships and allows no state is ``invalid_input``, as is an
    unknown intent; neither has evidence. A limit below one is an error.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    intent, edges = F.col("intent"), F.coalesce("has_edges", F.lit(False))
    reads_edges = (intent == "bridge") | ((intent == "automatic") & edges)
    outcome = F.when(~F.coalesce(intent.isin(*INTENTS), F.lit(False)), "invalid_input").when((intent == "bridge") & ~edges, "unavailable").when(reads_edges & (F.coalesce(F.size("states"), F.lit(0)) <= 0), "invalid_input").otherwise("ok")
    outcomes = requests.withColumn("outcome", outcome)
    asked = outcomes.where("outcome = 'ok'")
    facts = chunks.join(asked.where("intent <> 'bridge'").select("query_id"), "query_id", "left_semi")
    some = relationships.join(asked.where(reads_edges).select("query_id", "states"), "query_id").where(F.array_contains("states", F.col("review_state")))
    return outcomes, interleave(facts.select("query_id", "rank", "id"), some.select("query_id", "rank", "id"), limit)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be from 1 to 200, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def escaped(c: Column) -> Column:
    """Text that can't be taken for markup."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


PACKED = "query_id long, included array<string>, sources array<long>, n_bytes long, prompt string"


def pack(evidence: DataFrame, budget_bytes: int = 65_536, max_items: int = 20, budget_tokens: int = 8192 - 2048) -> DataFrame:
    """Fill one prompt for each query, greedily, in ``pos`` order.

    ``evidence``: (query_id, pos, kind, key, chunks: array<struct<id, text>>).
    An item that doesn't fit is left out and later ones may still fit. A chunk
    that is in already is cited by its number and not repeated; a relationship
    adds its missing chunks and itself, all or nothing. Tokens are bounded from
    above: as many as bytes, and ``ALLOWANCE``. A prompt holds at most
    ``max_items`` items, so only about that many candidates of a query should
    come here.
    """
    most = min(budget_bytes, budget_tokens - ALLOWANCE)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number: dict[int, int] = {}
        blocks, included, used = [], [], 0
        for r in rows.sort_values("pos").itertuples():
            if len(included) >= max_items:
                break
            fresh = [c for c in r.chunks if c["id"] not in number]
            if r.kind == "chunk" and not fresh:
                continue
            label = {c["id"]: len(number) + k + 1 for k, c in enumerate(fresh)}
            texts = [f'<source n="{label[c["id"]]}">{c["text"]}</source>' for c in fresh]
            if r.kind != "chunk":
                ends = [label.get(c["id"], number.get(c["id"])) for c in r.chunks]
                texts.append(f'<relation of="{ends[0]}" to="{ends[1]}"/>')
            size = sum(len(t.encode()) + 1 for t in texts)
            if used + size > most:
                continue
            used += size
            number |= label
            blocks += texts
            included.append(f"{r.kind}:{r.key}")
        return pd.DataFrame([{"query_id": key[0], "included": included, "sources": list(number), "n_bytes": used, "prompt": "\n".join(blocks)}])

    return evidence.groupBy("query_id").applyInPandas(one, PACKED)


def tokens_at_most(system: Column, user: Column) -> Column:
    """No tokenizer makes more tokens than there are bytes."""
    return F.octet_length(system) + F.octet_length(user) + ALLOWANCE


def as_json(evidence: DataFrame) -> DataFrame:
    """(query_id, pos, json) with the kind and explicit nulls."""
    body = F.to_json(F.struct("kind", F.when(F.col("kind") == "chunk", F.col("id")).alias("chunk_id"), F.when(F.col("kind") == "relationship", F.col("id")).alias("edge_id")), {"ignoreNullFields": "false"})
    return evidence.select("query_id", "pos", body.alias("json"))
