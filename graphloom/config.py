"""Pipeline settings."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Service:
    """Where answers come from: ``kind`` is ``rule``, ``replay``, ``http`` or ``http-async``.

    The key of an HTTP service is in the environment variable ``key_variable`` of the workers, if it needs one.
    """

    kind: str = "rule"
    url: str = "http://localhost:11434/v1/chat/completions"
    model: str = ""
    key_variable: str = "MODEL_API_KEY"
    temperature: float = 0.0
    max_tokens: int = 2048
    timeout_s: float = 120.0
    width: int = 8


@dataclass(frozen=True)
class Config:
    """Limits and thresholds of graph construction; one instance per run.

    Token counts are white-space tokens. ``*_batch`` are the number of names a
    model is asked about in one prompt.
    """

    max_tokens: int = 550
    min_tokens: int = 50
    entity_threshold: float = 0.8
    entity_top_k: int = 5
    relation_threshold: float = 0.8
    relation_top_k: int = 5
    context_triples: int = 3
    definition_batch: int = 10
    concept_batch: int = 8
    singleton_batch: int = 8
    model_attempts: int = 3
    model_delay_s: float = 5.0
    sample_min_chars: int = 2000
    sample_articles: int = 5
    service: Service = Service()
