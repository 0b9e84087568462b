"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from corvid.functions.text import Cleaning
from corvid.operators.batch import Retry
from corvid.operators.chunking import Chunking
from corvid.operators.prompting import METADATA_TEMPLATE, PROMPT, GenerationOptions


@dataclass(frozen=True)
class Indexing:
    strategy: str = "paragraph"
    chunking: Chunking = Chunking()
    preprocess: bool = True
    #: paragraphs are kept, since the chunker needs them
    cleaning: Cleaning = Cleaning(preserve_newlines=True)


@dataclass(frozen=True)
class Retrieval:
    limit: int = 5
    min_score: float | None = None
    metric: str = "cosine"
    reranking: bool = False
    strategy: str = "mmr"
    #: candidates a reranker chooses from, for each document it returns
    over_fetch: int = 4


@dataclass(frozen=True)
class Generation:
    prompt: str = PROMPT
    metadata_template: str | None = METADATA_TEMPLATE
    options: GenerationOptions = GenerationOptions()


@dataclass(frozen=True)
class Settings:
    indexing: Indexing = Indexing()
    retrieval: Retrieval = Retrieval()
    generation: Generation = Generation()
    cache: bool = True
    retry: Retry = field(default_factory=Retry)

    def with_indexing(self, **values: Any) -> Settings:
        return replace(self, indexing=replace(self.indexing, **values))

    def with_retrieval(self, **values: Any) -> Settings:
        return replace(self, retrieval=replace(self.retrieval, **values))

    def with_generation(self, **values: Any) -> Settings:
        return replace(self, generation=replace(self.generation, **values))


@dataclass(frozen=True)
class QueryOptions:
    """Of one call; None leaves the engine's setting."""

    where: Any = None
    limit: int | None = None
    metadata: bool = True
    rerank: bool | None = None
    strategy: str | None = None
    weight: float = 0.7
    generation: GenerationOptions | None = None

    def using(self, **values: Any) -> QueryOptions:
        return replace(self, **values)
