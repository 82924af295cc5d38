"""Indicator parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CloudParams:
    """The five lengths of the indicator, in rows of a series."""

    conversion_len: int = 9
    base_len: int = 26
    lagging_len: int = 26
    leading_span_b_len: int = 52
    cloud_shift: int = 26

    def __post_init__(self) -> None:
        for name in ("conversion_len", "base_len", "leading_span_b_len"):
            require_window(getattr(self, name), name)
        for name in ("lagging_len", "cloud_shift"):
            require_shift(getattr(self, name), name)

    @property
    def rows_before(self) -> int:
        """How many earlier rows a row's values can depend on."""
        longest = max(self.conversion_len, self.base_len, self.leading_span_b_len)
        return longest - 1 + self.cloud_shift

    @property
    def rows_after(self) -> int:
        """How many later rows a row's values can depend on."""
        return self.lagging_len


def require_window(n: int, name: str = "window") -> None:
    if n < 1:
        raise ValueError(f"{name} must be at least 1, got {n}")


def require_shift(n: int, name: str = "shift") -> None:
    if n < 0:
        raise ValueError(f"{name} must not be negative, got {n}")
