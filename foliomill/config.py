"""Settings of a pipeline; every bound is a row of one table."""

from __future__ import annotations

from dataclasses import dataclass, fields


class ConfigError(ValueError):
    pass


# Name, kinds, least, most.
BOUNDS = [
    ("max_file_size_bytes", (int,), 1, 524_288_000),
    ("max_filename_length", (int,), 255, 255),
    ("parse_timeout_seconds", (int,), 1, None),
    ("ocr_confidence_threshold", (int, float), 0.0, 1.0),
    ("ocr_page_timeout_seconds", (int,), 1, None),
    ("max_chunk_tokens", (int,), 128, 2048),
    ("chunk_overlap_tokens", (int,), 0, None),
    ("embedding_dimension", (int,), 64, 4096),
    ("embedding_timeout_seconds", (int,), 1, None),
    ("embedding_max_retries", (int,), 3, 3),
    ("default_top_k", (int,), 1, 100),
    ("max_query_chars", (int,), 4000, 4000),
    ("stage_retry_limit", (int,), 0, 10),
]
ENGINES, STORES = ("docling", "llamaparse"), ("pgvector", "qdrant")


@dataclass(frozen=True)
class PipelineConfig:
    max_file_size_bytes: int = 524_288_000
    max_filename_length: int = 255
    parsing_engine: str = "docling"
    parse_timeout_seconds: int = 300
    ocr_confidence_threshold: float = 0.70
    ocr_page_timeout_seconds: int = 60
    max_chunk_tokens: int = 512
    chunk_overlap_tokens: int = 64
    embedding_model: str | None = None
    embedding_dimension: int = 1536
    embedding_timeout_seconds: int = 10
    embedding_max_retries: int = 3
    vector_store_backend: str = "pgvector"
    default_top_k: int = 5
    max_query_chars: int = 4000
    stage_retry_limit: int = 3

    def __post_init__(self) -> None:
        for name, kinds, least, most in BOUNDS:
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, kinds):
                raise ConfigError(f"{name}: {value!r} is no {' or '.join(k.__name__ for k in kinds)}")
            if value < least or most is not None and value > most:
                raise ConfigError(f"{name}: {value!r} is outside [{least}, {most}]")
        if self.chunk_overlap_tokens >= self.max_chunk_tokens:
            raise ConfigError(f"chunk_overlap_tokens: {self.chunk_overlap_tokens} is not below max_chunk_tokens")
        for name, allowed in (("parsing_engine", ENGINES), ("vector_store_backend", STORES)):
            if getattr(self, name) not in allowed:
                raise ConfigError(f"{name}: {getattr(self, name)!r} is none of {', '.join(allowed)}")
        if self.embedding_model is not None and (not isinstance(self.embedding_model, str) or not self.embedding_model.strip()):
            raise ConfigError("embedding_model: a blank name")

    @classmethod
    def field_names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))
