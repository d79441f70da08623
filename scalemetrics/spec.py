"""Declared layout of a questionnaire: domains, items, keying, answer range.

Every operator takes a ``ScaleSpec``; its size (domains x items) is the bound
for everything that is broadcast, collected or expanded per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property


@dataclass(frozen=True)
class ScaleSpec:
    domains: tuple[str, ...]
    items_per_domain: int
    reverse_keyed: dict[str, tuple[int, ...]]
    short_form: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lo: int = 1
    hi: int = 5

    @cached_property
    def items(self) -> tuple[str, ...]:
        return tuple(i for d in self.domains for i in self.domain_items(d))

    def domain_items(self, domain: str) -> tuple[str, ...]:
        if domain not in self.domains:
            raise ValueError(f"unknown domain {domain!r}")
        return tuple(f"{domain}{n}" for n in range(1, self.items_per_domain + 1))

    @cached_property
    def domain_of(self) -> dict[str, str]:
        return {i: d for d in self.domains for i in self.domain_items(d)}

    @cached_property
    def item_no(self) -> dict[str, int]:
        """1-based position of an item in layout order, the last tie-breaker everywhere."""
        return {item: n for n, item in enumerate(self.items, start=1)}

    @cached_property
    def domain_no(self) -> dict[str, int]:
        return {d: n for n, d in enumerate(self.domains, start=1)}

    @cached_property
    def reversed_items(self) -> tuple[str, ...]:
        return tuple(f"{d}{n}" for d in self.domains for n in self.reverse_keyed.get(d, ()))

    @cached_property
    def short_items(self) -> tuple[str, ...]:
        return tuple(i for d in self.domains for i in self.short_form.get(d, ()))

    @property
    def n_items(self) -> int:
        return len(self.items)

    @property
    def scores(self) -> tuple[str, ...]:
        return tuple(f"{d}_score" for d in self.domains)

    @property
    def percentiles(self) -> tuple[str, ...]:
        return tuple(f"{d}_percentile" for d in self.domains)


# The public-domain 50-item five-domain inventory, its reverse-keyed
# item numbers and its published 20-item short form.
FIVE_DOMAIN = ScaleSpec(
    domains=("ext", "agr", "csn", "est", "opn"),
    items_per_domain=10,
    reverse_keyed={
        "ext": (2, 4, 6, 8, 10),
        "agr": (1, 3, 5, 7),
        "csn": (2, 4, 6, 8),
        "est": (1, 3, 5, 6, 7, 8, 9, 10),
        "opn": (2, 4, 6),
    },
    short_form={
        "ext": ("ext1", "ext7", "ext2", "ext4"),
        "agr": ("agr4", "agr9", "agr7", "agr5"),
        "csn": ("csn5", "csn7", "csn6", "csn4"),
        "est": ("est8", "est6", "est2", "est4"),
        "opn": ("opn3", "opn2", "opn4", "opn6"),
    },
)
