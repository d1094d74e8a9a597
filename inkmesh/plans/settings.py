"""Settings, each with the range it is held to."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

#: Tasks and the most tokens a reply of each may have.
TOKEN_CAPS = {"inventory": 2000, "seed-selection": 500, "page-generation": 3000, "synthesis": 4000, "vision": 1500}
#: Whole-number settings with least and greatest.
RANGES = {"compile_concurrency": (1, 16), "max_retries": (0, 10), "mode_min_nodes": (0, 1_000_000), "seeds_cap": (1, 100), "keywords_cap": (1, 100), "assembly_cap": (1, 100), "ppr_max_iterations": (1, 1000)}


@dataclass(frozen=True)
class Settings:
    provider: str = "scripted"
    models: dict = field(default_factory=lambda: dict.fromkeys(TOKEN_CAPS, "scripted"))
    context_budget_tokens: int = 40_000
    assembly_cap: int = 12
    mode_min_nodes: int = 20
    mode_min_link_ratio: float = 1.5
    follow_up_enabled: bool = True
    ppr_alpha: float = 0.85
    ppr_max_iterations: int = 100
    seeds_cap: int = 8
    keywords_cap: int = 12
    request_timeout_ms: int = 120_000
    max_retries: int = 2
    compile_concurrency: int = 2

    def normalized(self) -> Settings:
        """Unusable values become the default; whole numbers are rounded down and held in range."""
        default = {f.name: getattr(Settings(), f.name) for f in fields(self)}

        def usable(name: str, test) -> object:  # noqa: ANN001
            v = getattr(self, name)
            number = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
            return v if number and test(v) else default[name]

        out = {n: min(max(math.floor(usable(n, lambda v: True)), lo), hi) for n, (lo, hi) in RANGES.items()}
        out |= {n: usable(n, lambda v: v > 0) for n in ("context_budget_tokens", "request_timeout_ms")}
        out["mode_min_link_ratio"] = usable("mode_min_link_ratio", lambda v: v >= 0)
        out["ppr_alpha"] = usable("ppr_alpha", lambda v: 0 < v < 1)
        out["follow_up_enabled"] = self.follow_up_enabled if isinstance(self.follow_up_enabled, bool) else True
        return replace(self, **out)
