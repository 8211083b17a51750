"""Settings of index and attention, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class IndexConfig:
    num_lists: int = 256
    nprobe: int = 8
    num_subspaces: int = 16
    num_bits: int = 8
    residual: bool = True
    coarse_max_iter: int = 30
    pq_max_iter: int = 25
    pack_codes: bool = True
    rotation: str = "none"
    direction_normalize: bool = False
    online_codebook_lr: float = 0.05
    seed: int = 0
    eps: float = 1e-12

    def __post_init__(self) -> None:
        _need(self.num_lists > 0 and self.nprobe > 0, "num_lists and nprobe must be positive")
        _need(1 <= self.num_bits <= 8, "num_bits must be from 1 to 8")
        _need(self.rotation in ("none", "random_orthogonal"), "rotation must be none or random_orthogonal")
        _need(0 < self.online_codebook_lr <= 1, "online_codebook_lr must be in (0, 1]")

    def check(self, dim: int, rows: int) -> None:
        _need(dim % self.num_subspaces == 0, "the dimension must be a multiple of num_subspaces")
        _need(rows > 0, "an index needs rows")

    @property
    def words(self) -> int:
        return 1 << self.num_bits

    @property
    def packed(self) -> bool:
        return self.pack_codes and self.num_bits == 4


@dataclass(frozen=True)
class AttentionConfig:
    sink: int = 0
    local: int = 0
    retrieval_topk: int = 100
    top_fraction: float | None = None
    top_p: float | None = None
    top_p_scope: str = "retrieval"
    nprobe: int | None = None
    candidate_budget: int | None = None
    exact_rerank: bool = True
    scale: float | None = None
    mode: str = "sparse"
    value_mode: str = "denominator"
    topk_source: str = "all_pq"
    denominator_source: str = "all_pq"
    update_interval: int = 1
    strategy: str = "incremental"
    codebook_refresh_interval: int | None = None

    def __post_init__(self) -> None:
        _need(self.sink >= 0 and self.local >= 0, "sink and local must not be negative")
        _need(self.update_interval > 0, "update_interval must be positive")
        _need(self.retrieval_topk >= 0, "retrieval_topk must not be negative")
        _need(self.top_fraction is None or 0 < self.top_fraction <= 1, "top_fraction must be in (0, 1]")
        _need(self.top_p is None or 0 < self.top_p <= 1, "top_p must be in (0, 1]")
        _need(self.top_fraction is None or self.top_p is None, "top_fraction and top_p exclude each other")
        _need(self.top_p_scope in ("retrieval", "denominator"), "top_p_scope must be retrieval or denominator")
        _need(self.mode in ("sparse", "hybrid"), "mode must be sparse or hybrid")
        _need(self.value_mode in ("denominator", "full", "centroid"), "value_mode must be denominator, full or centroid")
        _need(self.topk_source in ("all_pq", "ivf_candidates") and self.denominator_source in ("all_pq", "ivf_candidates"), "a source must be all_pq or ivf_candidates")
        _need(self.denominator_source == "all_pq" or self.topk_source == "ivf_candidates", "a candidate denominator needs candidate top-k")
        _need(self.denominator_source == "all_pq" or self.top_p is None, "a candidate denominator excludes top_p")
        _need(self.top_p_scope == "retrieval" or self.mode == "hybrid", "top_p_scope denominator needs hybrid mode")
        _need(self.strategy in ("incremental", "online", "rebuild", "deferred"), "strategy must be incremental, online, rebuild or deferred")

    def scaled(self, dim: int) -> float:
        return self.scale if self.scale is not None else dim**-0.5


#: The production preset: index and attention.
PAPER = (
    IndexConfig(num_lists=512, nprobe=64, num_subspaces=8, num_bits=4, coarse_max_iter=1, pq_max_iter=2, direction_normalize=True),
    AttentionConfig(sink=4, local=128, top_fraction=0.01, mode="hybrid", value_mode="centroid", candidate_budget=4096, update_interval=256, strategy="deferred"),
)
