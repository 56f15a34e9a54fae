"""What a search does with its scores, fixed before it runs."""

from __future__ import annotations

from dataclasses import dataclass

from tessel.operators.ranking import LEXICAL, LEXICAL_WEIGHT, RRF_K, SEMANTIC, SEMANTIC_WEIGHT, TEMPERATURE, Fusion, Linear, MinMax, Norm, ReciprocalRank, Softmax

TOP_K, POOL_FACTOR = 10, 4


@dataclass(frozen=True)
class RetrievalPlan:
    """Normalization (none for rank fusion) and fusion."""

    norm: Norm | None
    fusion: Fusion


def build_plan(
    fusion: str = "linear",
    norm: str = "softmax",
    semantic_weight: float = SEMANTIC_WEIGHT,
    lexical_weight: float = LEXICAL_WEIGHT,
    temperature: float = TEMPERATURE,
    rrf_k: int = RRF_K,
) -> RetrievalPlan:
    """A plan from settings; ValueError for unknown names."""
    if fusion == "rrf":
        return RetrievalPlan(None, ReciprocalRank(rrf_k))
    if fusion != "linear":
        raise ValueError(f"unknown fusion {fusion!r}")
    norms = {"softmax": lambda: Softmax(temperature), "minmax": MinMax}
    if norm not in norms:
        raise ValueError(f"unknown norm {norm!r}")
    return RetrievalPlan(norms[norm](), Linear(((SEMANTIC, semantic_weight), (LEXICAL, lexical_weight))))
