"""The twenty retrievers: ten base ones, each plain or reranked, over shared ranked lists.

Dense and lexical lists are computed once for all queries, to the depth that the deepest
retriever needs, and written when a retriever first reads them; every retriever is a cheap plan over them.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import fusion
from corpusmill.operators.models import Embedder, HashingEmbedder, coverage, embed
from corpusmill.operators.rerank import OFFSETS, Scorer, relevant, rerank, with_neighbours
from corpusmill.operators.search import LexicalIndex, fetched, mmr, nearest
from corpusmill.sources.shared import materialize

RERANKED = "_ce_r50"
BASES = (
    "dense_sim_k10", "dense_mmr_k10", "bm25_k10", "hyb_rrf_k60", "hyb_rrf_k30", "hyb_rrf_fetch40",
    "hyb_weighted_norm", "hyb_weighted_dense_70", "hyb_interleave", "hyb_fill_dense_then_bm25",
)
RETRIEVERS = BASES + tuple(b + RERANKED for b in BASES)
POOL, DEPTH, PAD = 50, 100, 80


def base_of(retriever: str) -> str:
    return retriever.removesuffix(RERANKED)


def is_reranked(retriever: str) -> bool:
    return retriever.endswith(RERANKED)


def dense_only(retriever: str) -> bool:
    """Whether a retriever needs no lexical list."""
    return base_of(retriever).startswith("dense_")


def checked(retrievers: list[str]) -> list[str]:
    unknown = [r for r in retrievers if r not in RETRIEVERS]
    if unknown:
        raise ValueError(f"unknown retrievers: {', '.join(unknown)}")
    return list(retrievers)


def parse_pairs(text: str) -> list[tuple[str, str]]:
    """``chunking:retriever`` pairs, comma-separated."""
    pairs = [tuple(p.strip().split(":", 1)) for p in text.split(",") if p.strip()]
    if bad := [p for p in pairs if len(p) != 2]:
        raise ValueError(f"not chunking:retriever: {bad}")
    checked([r for _, r in pairs])
    return pairs


class Corpus:
    """Chunks (doc_id, pos, text) with their vectors and lexical index, each made when it is first read, and once."""

    def __init__(self, chunks: DataFrame, embedder: type[Embedder] = HashingEmbedder) -> None:
        self.chunks, self.embedder = materialize(chunks.select("doc_id", "pos", "text"), "chunks"), embedder

    @cached_property
    def vectors(self) -> DataFrame:
        return materialize(embed(self.chunks, "text", self.embedder).drop("text"), "vectors")

    @cached_property
    def index(self) -> LexicalIndex:
        return LexicalIndex(self.chunks)


class Lists:
    """What all retrievers of one corpus and batch of queries (query_id, question) read; a list that no retriever reads isn't made."""

    def __init__(self, queries: DataFrame, corpus: Corpus, depth: int = DEPTH) -> None:
        self.queries, self.corpus, self.depth = queries, corpus, depth

    @classmethod
    def of(cls, queries: DataFrame, chunks: DataFrame, depth: int = DEPTH, embedder: type[Embedder] = HashingEmbedder) -> Lists:
        return cls(queries, Corpus(chunks, embedder), depth)

    def asked(self, queries: DataFrame, depth: int | None = None) -> Lists:
        """Other queries over the same corpus, whose vectors and index stay."""
        return Lists(queries, self.corpus, depth or self.depth)

    @property
    def chunks(self) -> DataFrame:
        return self.corpus.chunks

    @property
    def vectors(self) -> DataFrame:
        return self.corpus.vectors

    @cached_property
    def query_vectors(self) -> DataFrame:
        return materialize(embed(self.queries.select("query_id", "question"), "question", self.corpus.embedder, kind="query"), "queries")

    @cached_property
    def dense(self) -> DataFrame:
        return materialize(nearest(self.vectors, self.query_vectors, self.depth), "dense")

    @cached_property
    def lexical(self) -> DataFrame:
        return materialize(self.corpus.index.top(self.queries, self.depth), "lexical")

    def base(self, retriever: str, k: int) -> DataFrame:
        """A base retriever's k rows: query_id, doc_id, pos, rank, score."""
        match base_of(retriever):
            case "dense_sim_k10":
                return fusion.head(self.dense, k).select(*fusion.KEY, "rank", "score")
            case "dense_mmr_k10":
                pool = fusion.head(self.dense, max(2 * k, 40)).join(self.vectors, ["doc_id", "pos"])
                return mmr(pool, self.query_vectors, k).select(*fusion.KEY, "rank", "score")
            case "bm25_k10":
                return fusion.head(self.lexical, k).select(*fusion.KEY, "rank", "score")
            case "hyb_rrf_k60":
                return fusion.reciprocal_rank(self.dense, self.lexical, k, 60, 20)
            case "hyb_rrf_k30":
                return fusion.reciprocal_rank(self.dense, self.lexical, k, 30, 20)
            case "hyb_rrf_fetch40":
                return fusion.reciprocal_rank(self.dense, self.lexical, k, 60, 40)
            case "hyb_weighted_norm":
                return fusion.weighted(self.dense, self.lexical, k, 0.5)
            case "hyb_weighted_dense_70":
                return fusion.weighted(self.dense, self.lexical, k, 0.7)
            case "hyb_interleave":
                return fusion.interleaved(self.dense, self.lexical, k)
            case "hyb_fill_dense_then_bm25":
                return fusion.filled(self.dense, self.lexical, k)
        raise ValueError(f"unknown retriever: {retriever}")

    def run(self, retriever: str, k: int = 10, pool: int | None = None, scorer: Scorer = coverage) -> DataFrame:
        """A retriever's k rows, padded from the dense and then the lexical list."""
        if is_reranked(retriever):
            rows = rerank(self.base(retriever, pool or max(POOL, 5 * k)), self.queries, self.chunks, k, scorer)
        else:
            rows = self.base(retriever, k)
        return fusion.padded(rows, [fusion.head(x, PAD) for x in self.pads([retriever])], k)

    def pads(self, retrievers: list[str]) -> list[DataFrame]:
        """Lists that fill up short results. The dense one has every chunk until it is full, so retrievers that need no lexical list don't make one."""
        return [self.dense] if all(dense_only(r) for r in retrievers) else [self.dense, self.lexical]

    def candidates(self, retriever: str, k: int = DEPTH) -> DataFrame:
        """A base retriever's pool, to be stored and finalised later."""
        return self.base(retriever, k)

    def finalize(self, candidates: DataFrame, k: int = 20, reranked: bool = True, scorer: Scorer = coverage) -> DataFrame:
        """Rank stored candidates; padding comes from their own pool."""
        rows = rerank(candidates, self.queries, self.chunks, k, scorer) if reranked else fusion.head(candidates, k)
        return fusion.padded(rows, [candidates], k)

    def with_neighbours(self, retriever: str, k: int = 20, pool: int = DEPTH, offsets: tuple[int, ...] = OFFSETS, scorer: Scorer = coverage) -> DataFrame:
        """Pool, chunks around it, rerank, pad from the lists."""
        near = materialize(with_neighbours(self.base(retriever, pool), self.chunks, offsets), "near")
        return fusion.padded(rerank(near, self.queries, self.chunks, k, scorer), [fusion.head(self.dense, PAD), fusion.head(self.lexical, PAD)], k)

    def chat(self, retriever: str = "hyb_rrf_k60", k: int = 20, pool: int = DEPTH, least: float = 0.3, scorer: Scorer = coverage) -> DataFrame:
        """Pool, all of it reranked, relevance threshold, at most k, no padding."""
        return relevant(rerank(self.base(retriever, pool), self.queries, self.chunks, None, scorer), least, k)


def multi_query(variants: DataFrame, lists: Lists, retriever: str, k: int = 20, each: int = 80, scorer: Scorer = coverage) -> DataFrame:
    """Union of a question's and its variants' pools, reranked by the question itself, padded from the union.

    variants: query_id, variants (array of texts). lists: of the questions; only their corpus and queries are read.
    """
    queries = lists.queries
    every = queries.join(variants, "query_id", "left").select("query_id", F.posexplode(F.concat(F.array("question"), F.coalesce("variants", F.array().cast("array<string>")))).alias("variant", "question"))
    asked = every.select(F.concat_ws("#", F.col("query_id").cast("string"), "variant").alias("query_id"), "question")
    several = lists.asked(asked, each)
    parts = F.split("query_id", "#")
    kind = dict(queries.dtypes)["query_id"]
    pool = several.base(retriever, each).select(
        F.element_at(parts, 1).cast(kind).alias("query_id"), "doc_id", "pos", (F.element_at(parts, 2).cast("long") * F.lit(1 << 32) + F.col("rank")).alias("rank")
    )
    pool = materialize(fusion.concatenated([pool]), "pool")
    return fusion.padded(rerank(pool, queries, lists.chunks, k, scorer), [pool], k)


def rewritten(questions: DataFrame, lists: Lists, retriever: str, k: int = 20, scorer: Scorer = coverage) -> DataFrame:
    """A retriever over rewritten questions (query_id, question), which also rerank and pad; the corpus is that of lists."""
    return lists.asked(questions).run(retriever, k, scorer=scorer)


def stored_or_live(queries: DataFrame, stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored rows of the queries that have any, live rows of the others."""
    have = stored.select("query_id").distinct()
    kept = stored.join(queries.select("query_id"), "query_id", "left_semi").select(*fusion.KEY, "rank", "score")
    missing = queries.select("query_id").join(have, "query_id", "left_anti")
    return kept.unionByName(live.join(missing, "query_id", "left_semi").select(*fusion.KEY, "rank", "score"))


def grid(lists: dict[str, Lists], retrievers: list[str], k: int = 10, pool: int | None = None, scorer: Scorer = coverage, strict: bool = False) -> DataFrame:
    """strategy, retriever, query_id, doc_id, pos, rank, score: all cells in one relation.

    The result is that of ``Lists.run`` for each cell. All strategies are one relation, so the number of plans is that of the
    retrievers; a candidate is scored once for all reranked retrievers, and all cells are ranked and padded by
    one window. strict: fewer than k rows for a query are an error.
    """
    return cells({strategy: (own, list(retrievers)) for strategy, own in lists.items()}, k, pool, scorer, strict)


def cells(wanted: dict[str, tuple[Lists, list[str]]], k: int = 10, pool: int | None = None, scorer: Scorer = coverage, strict: bool = False) -> DataFrame:
    """grid() with retrievers of its own for each strategy."""
    by_retriever: dict[str, list[str]] = {}
    for strategy, (_, names) in wanted.items():
        for r in checked(names):
            by_retriever.setdefault(r, []).append(strategy)
    rows = _cells_of(Several({s: own for s, (own, _) in wanted.items()}), by_retriever, k, pool or max(POOL, 5 * k), scorer)
    rows = rows.select("query_id.strategy", "retriever", "query_id.query_id", "doc_id.doc_id", "pos", "rank", "score")
    if strict:
        rows = materialize(rows, "cells")
        found = rows.groupBy("strategy", "retriever", "query_id").agg(F.count("*").alias("n")).where(F.col("n") == k).groupBy("strategy", "retriever").count().collect()
        complete = {(r.strategy, r.retriever): r["count"] for r in found}
        for strategy, (own, names) in wanted.items():
            n = own.queries.count()
            if short := [r for r in names if complete.get((strategy, r), 0) < n]:
                raise ValueError(f"{strategy}: fewer than {k} results of {', '.join(short)}")
    return rows


class Several(Lists):
    """Lists of several strategies as one: query_id and doc_id are structs with the strategy, so nothing of one meets anything of another."""

    def __init__(self, lists: dict[str, Lists], only: tuple[str, ...] | None = None) -> None:
        self.lists, self.only = lists, only or tuple(lists)

    def _joined(self, name: str, stored: bool = False) -> DataFrame:
        def tagged(strategy: str) -> DataFrame:
            rows, tag = getattr(self.lists[strategy], name), F.lit(strategy).alias("strategy")
            return rows.withColumns({c: F.struct(tag, c) for c in ("query_id", "doc_id") if c in rows.columns})

        rows = reduce(DataFrame.unionByName, (tagged(s) for s in self.only))
        return materialize(rows, name) if stored and len(self.only) > 1 else rows

    @cached_property
    def queries(self) -> DataFrame:
        return self._joined("queries").select("query_id", "question")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._joined("chunks")

    @cached_property
    def vectors(self) -> DataFrame:
        return self._joined("vectors")

    @cached_property
    def query_vectors(self) -> DataFrame:
        return self._joined("query_vectors")

    @cached_property
    def dense(self) -> DataFrame:
        return self._joined("dense", stored=True)

    @cached_property
    def lexical(self) -> DataFrame:
        return self._joined("lexical", stored=True)

    def part(self, strategies: list[str]) -> Lists:
        """A view of some strategies, with the same stored lists."""
        if set(strategies) == set(self.only):
            return self
        return _View(self, strategies)


class _View(Lists):
    """Some strategies of Several."""

    def __init__(self, whole: Several, strategies: list[str]) -> None:
        self.whole, self.strategies = whole, strategies

    def _some(self, rows: DataFrame, key: str = "query_id") -> DataFrame:
        return rows.where(F.col(f"{key}.strategy").isin(self.strategies))

    @property
    def dense(self) -> DataFrame:
        return self._some(self.whole.dense)

    @property
    def lexical(self) -> DataFrame:
        return self._some(self.whole.lexical)

    @property
    def vectors(self) -> DataFrame:
        return self._some(self.whole.vectors, "doc_id")

    @property
    def query_vectors(self) -> DataFrame:
        return self._some(self.whole.query_vectors)


def _cells_of(own: Several, by_retriever: dict[str, list[str]], k: int, pool: int, scorer: Scorer) -> DataFrame:
    key = ("retriever", *fusion.KEY)
    named = lambda r, n: own.part(by_retriever[r]).base(r, n).select(F.lit(r).alias("retriever"), *fusion.KEY, "rank")
    parts = [named(r, k) for r in by_retriever if not is_reranked(r)]
    if again := [r for r in by_retriever if is_reranked(r)]:
        candidates = materialize(reduce(DataFrame.unionAll, (named(r, pool) for r in again)), "candidates")
        texts = candidates.select(*fusion.KEY).distinct().join(fetched(candidates, own.chunks), ["doc_id", "pos"]).join(own.queries, "query_id")
        scores = texts.select(*fusion.KEY, F.round(scorer("question", "text"), 8).alias("score"))
        rank = F.row_number().over(Window.partitionBy("retriever", "query_id").orderBy(F.col("score").desc(), "former", "doc_id", "pos"))
        ranked = candidates.withColumnRenamed("rank", "former").join(scores, list(fusion.KEY)).withColumn("rank", rank).where(F.col("rank") <= k)
        parts.append(ranked.select(*key, "rank"))
    rows = reduce(DataFrame.unionAll, parts)
    cells_ = [(s, r) for r, strategies in by_retriever.items() for s in strategies]
    names = rows.sparkSession.createDataFrame(cells_, "strategy string, retriever string")  # the cells of the grid, a few hundred

    def pad(x: DataFrame, i: int) -> DataFrame:
        return fusion.head(x, PAD).join(F.broadcast(names), F.col("query_id.strategy") == F.col("strategy")).select(*key, F.col("rank").cast("long") + F.lit((i + 1) << 32))

    every = reduce(DataFrame.unionAll, [rows.select(*key, F.col("rank").cast("long").alias("seen")), *(pad(x, i) for i, x in enumerate(own.pads(list(by_retriever))))])
    firsts = every.groupBy(*key).agg(F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("retriever", "query_id").orderBy("seen", "doc_id", "pos"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= k).select(*key, "rank", (-F.col("seen")).cast("double").alias("score"))


def unfinished(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Requested cells (strategy, retriever) without results; done: results so far."""
    return cells.join(done.select("strategy", "retriever").distinct(), ["strategy", "retriever"], "left_anti")
