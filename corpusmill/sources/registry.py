"""The model registry: a small fixed table of open models; other rows are given by the caller."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, family string, params_b double, active_b double, context_length long, is_moe boolean, lora_rank int, recommended_lr double, license string, modalities array<string>, tags array<string>"

_APACHE, _LLAMA1, _LLAMA2, _LLAMA3 = "Apache-2.0", "Llama-3.1-Community", "Llama-3.2-Community", "Llama-3.3-Community"
#: Name, family, parameters and active parameters in billions, context, mixture of experts, LoRA rank, learning rate, licence, modalities, tags.
MODELS: list[tuple] = [
    ("thinkingmachines/Inkling", "inkling", 975.0, 41.0, 1_000_000, True, 64, 3e-5, _APACHE, ["text", "image", "audio"], ["moe", "flagship", "multimodal"]),
    ("thinkingmachines/Inkling-NVFP4", "inkling", 975.0, 41.0, 1_000_000, True, 64, 3e-5, _APACHE, ["text", "image", "audio"], ["moe", "quantized", "multimodal"]),
    ("thinkingmachines/Inkling-Small", "inkling", 100.0, 12.0, 1_000_000, True, 32, 5e-5, _APACHE, ["text", "image", "audio"], ["moe", "small", "preview", "multimodal"]),
    ("Qwen/Qwen3-0.6B", "qwen3", 0.6, 0.6, 32768, False, 16, 2e-4, _APACHE, ["text"], ["dense", "small"]),
    ("Qwen/Qwen3-1.7B", "qwen3", 1.7, 1.7, 32768, False, 16, 2e-4, _APACHE, ["text"], ["dense", "small"]),
    ("Qwen/Qwen3-4B", "qwen3", 4.0, 4.0, 32768, False, 32, 1e-4, _APACHE, ["text"], ["dense"]),
    ("Qwen/Qwen3-8B", "qwen3", 8.0, 8.0, 32768, False, 32, 1e-4, _APACHE, ["text"], ["dense", "default"]),
    ("Qwen/Qwen3-14B", "qwen3", 14.0, 14.0, 32768, False, 32, 8e-5, _APACHE, ["text"], ["dense"]),
    ("Qwen/Qwen3-32B", "qwen3", 32.0, 32.0, 32768, False, 64, 5e-5, _APACHE, ["text"], ["dense", "large"]),
    ("Qwen/Qwen3-30B-A3B", "qwen3", 30.0, 3.0, 32768, True, 32, 1e-4, _APACHE, ["text"], ["moe"]),
    ("Qwen/Qwen3-235B-A22B", "qwen3", 235.0, 22.0, 32768, True, 64, 4e-5, _APACHE, ["text"], ["moe", "flagship"]),
    ("meta-llama/Llama-3.1-8B-Instruct", "llama3", 8.0, 8.0, 131072, False, 32, 1e-4, _LLAMA1, ["text"], ["dense"]),
    ("meta-llama/Llama-3.1-70B-Instruct", "llama3", 70.0, 70.0, 131072, False, 64, 5e-5, _LLAMA1, ["text"], ["dense", "large"]),
    ("meta-llama/Llama-3.2-1B-Instruct", "llama3", 1.0, 1.0, 131072, False, 16, 2e-4, _LLAMA2, ["text"], ["dense", "small"]),
    ("meta-llama/Llama-3.2-3B-Instruct", "llama3", 3.0, 3.0, 131072, False, 32, 1e-4, _LLAMA2, ["text"], ["dense"]),
    ("meta-llama/Llama-3.3-70B-Instruct", "llama3", 70.0, 70.0, 131072, False, 64, 5e-5, _LLAMA3, ["text"], ["dense", "large"]),
]
DEFAULT_MODEL = "Qwen/Qwen3-8B"


def model_registry(spark: SparkSession, extra: Iterable[tuple] = ()) -> DataFrame:
    """All rows by name, with is_dense and is_multimodal. extra: rows of SCHEMA that the caller adds."""
    rows = spark.createDataFrame([*MODELS, *extra], SCHEMA)
    return rows.withColumns({"is_dense": ~F.col("is_moe"), "is_multimodal": F.concat_ws(",", "modalities") != "text"}).orderBy("name")


def list_models(registry: DataFrame, family: str | None = None) -> DataFrame:
    """The models of a family; the argument's case does not matter."""
    return registry.where(F.col("family") == family.lower()) if family else registry


def get_model(registry: DataFrame, name: str) -> dict:
    """The row of a name, or KeyError that lists the names there are."""
    rows = registry.where(F.col("name") == name).collect()
    if not rows:
        raise KeyError(f"unknown model {name!r}; available: {', '.join(r.name for r in registry.select('name').collect())}")
    return rows[0].asDict()


def is_supported(registry: DataFrame, name: str) -> bool:
    return not registry.where(F.col("name") == name).isEmpty()
