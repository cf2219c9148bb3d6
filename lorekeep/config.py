"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    k: int = 24
    rrf_k: int = 60
    weight_lexical: float = 1.0
    weight_tag: float = 1.0
    weight_vector: float = 2.0
    half_life_days: float = 7.0
    reserve: int = 3
    candidate_limit: int = 200
    match_band: float = 1000.0
    lexical_any: bool = True
    event_reserve: bool = True
    two_section: bool = True
    strict_split: bool = False
    atomic_facts: bool = False
    team_cap: int = 8
    similarity: float = 0.85
    never_merge: tuple[str, ...] = ("confidential", "pinned")
    prompt_budget: int = 12_000
    #: Bytes of a question batch, or of the words that match its terms, that are broadcast at once; larger ones are joined without.
    max_broadcast_bytes: int = 32 << 20

    def but(self, **changes) -> Config:
        return replace(self, **changes)


#: Profiles for the benchmark families.
ORGANISATION = Config(weight_vector=4.0, candidate_limit=50, lexical_any=False, k=50)
LONG_CONVERSATION = Config(k=50)
LONG_MEMORY = Config(weight_vector=4.0, candidate_limit=50, lexical_any=False, k=50)
