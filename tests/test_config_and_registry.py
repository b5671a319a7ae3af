import pytest

from foliomill.config import BOUNDS, ConfigError, PipelineConfig
from foliomill.sources.registry import NotRegistered, Registry
from foliomill.sources.store import safe_name


def test_defaults_are_valid():
    assert PipelineConfig().max_chunk_tokens == 512
    assert "default_top_k" in PipelineConfig.field_names()


@pytest.mark.parametrize("name,kinds,least,most", BOUNDS)
def test_bounds(name, kinds, least, most):
    lap = {"chunk_overlap_tokens": 0} if name == "max_chunk_tokens" else {}
    if most is not None:
        PipelineConfig(**{name: most} | lap)
        with pytest.raises(ConfigError):
            PipelineConfig(**{name: most + 1} | lap)
    with pytest.raises(ConfigError):
        PipelineConfig(**{name: least - 1} | lap)
    with pytest.raises(ConfigError):
        PipelineConfig(**{name: True} | lap)
    with pytest.raises(ConfigError):
        PipelineConfig(**{name: "7"} | lap)


@pytest.mark.parametrize("bad", [{"chunk_overlap_tokens": 512}, {"parsing_engine": "x"}, {"vector_store_backend": "x"}, {"embedding_model": " "}])
def test_other_errors(bad):
    with pytest.raises(ConfigError):
        PipelineConfig(**bad)


def test_registry():
    r = Registry("thing")
    r.register("a", lambda: 1)
    assert r.create("a") == 1 and r.is_registered("a")
    with pytest.raises(ValueError):
        r.register("a", lambda: 2)
    r.register("a", lambda: 2, replace=True)
    assert r.create("a") == 2
    for key in ("b", None):
        with pytest.raises(NotRegistered):
            r.create(key)


def test_names():
    assert safe_name("records_1") == "records_1"
    with pytest.raises(ValueError):
        safe_name("a; drop")
