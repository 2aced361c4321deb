"""Settings of a run, by the part of the engine that they are for. Each part checks itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.operators.cleaning import CleaningRules
from tessera.operators.crosssection import MODES
from tessera.operators.factors import FUNDAMENTAL_FACTORS, PRICE_FACTORS, REGISTRY, Lookbacks
from tessera.operators.ridge import RidgeSettings


def _hold(**conditions: bool) -> None:
    """ValueError that names the settings whose condition fails."""
    if failed := [name for name, holds in conditions.items() if not holds]:
        raise ValueError(f"settings out of range: {', '.join(failed)}")


@dataclass(frozen=True)
class Reading:
    """What is read: market rows from `first` to `last` (None: open), and how many business days after their publication statements are known."""

    first: str | None = "2008-01-01"
    last: str | None = None
    days_to_known: int = 1

    def __post_init__(self) -> None:
        _hold(days_to_known=self.days_to_known >= 0)


@dataclass(frozen=True)
class Quality:
    """The quality mask: how many rows it looks back on, the hard events it bears there, the share of prices it wants."""

    rows: int = 252
    hard_events: int = 3
    coverage: float = 0.95

    def __post_init__(self) -> None:
        _hold(rows=self.rows > 0, hard_events=self.hard_events >= 0, coverage=0 <= self.coverage <= 1)


@dataclass(frozen=True)
class Cleaning:
    """Rules for single prices, the quality mask, and how many assets a date needs (None: any)."""

    rules: CleaningRules = field(default_factory=CleaningRules)
    quality: Quality = field(default_factory=Quality)
    assets_per_date: int | None = 100

    def __post_init__(self) -> None:
        _hold(
            assets_per_date=self.assets_per_date is None or self.assets_per_date > 0,
            rules_hard_above_candidate=self.rules.hard_max_return > self.rules.classify_min_return,
        )


@dataclass(frozen=True)
class Universe:
    """Who may be held: the most liquid assets (None: all), by the mean volume of so many rows, above a price floor (None: any price)."""

    assets: int | None = None
    volume_rows: int = 63
    price_floor: float | None = 1.0

    def __post_init__(self) -> None:
        _hold(assets=self.assets is None or self.assets > 0, volume_rows=self.volume_rows > 0, price_floor=self.price_floor is None or self.price_floor > 0)


@dataclass(frozen=True)
class Neutral:
    """What scores are neutralized by; for the market: the asset that stands for it, the rows of a beta and how many of them must be there."""

    mode: str = "none"
    market_asset_id: int | None = None
    beta_rows: int = 252
    beta_least: int = 63

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"scores can't be neutralized by {self.mode!r}; there are {MODES}")
        _hold(beta_rows_and_least=0 < self.beta_least <= self.beta_rows)
        if self.mode == "market" and self.market_asset_id is None:
            raise ValueError("neutralization by the market needs the asset that stands for it (market_asset_id)")


@dataclass(frozen=True)
class Model:
    """Which factors there are and what is made of them: `output` is a factor, composite, or ridge with its penalty and windows."""

    price_factors: tuple[str, ...] = PRICE_FACTORS
    fundamental_factors: tuple[str, ...] = FUNDAMENTAL_FACTORS
    lookbacks: Lookbacks = field(default_factory=Lookbacks)
    output: str = "composite"
    penalty: float = 10.0
    ridge: RidgeSettings = field(default_factory=RidgeSettings)

    def __post_init__(self) -> None:
        for kind, chosen, known in (("price", self.price_factors, PRICE_FACTORS), ("fundamental", self.fundamental_factors, REGISTRY)):
            if not chosen:
                raise ValueError(f"a model needs a {kind} factor")
            if absent := [n for n in chosen if n not in known]:
                raise ValueError(f"{absent} are no {kind} factors; there are {sorted(known)}")
        if self.output == "ridge":
            self.ridge.oldest(1)

    @property
    def factors(self) -> tuple[str, ...]:
        return (*self.price_factors, *self.fundamental_factors)


@dataclass(frozen=True)
class Trading:
    """How often positions change, what that and borrowing cost (shares of value; borrowing by year), and how many assets a date's IC needs."""

    rebalance: str = "ME"
    turnover_cost: float = 0.001
    borrow_cost: float = 0.0
    assets_for_ic: int = 50

    def __post_init__(self) -> None:
        _hold(turnover_cost=self.turnover_cost >= 0, borrow_cost=self.borrow_cost >= 0, assets_for_ic=self.assets_for_ic > 0)


@dataclass(frozen=True)
class Settings:
    reading: Reading = field(default_factory=Reading)
    cleaning: Cleaning = field(default_factory=Cleaning)
    universe: Universe = field(default_factory=Universe)
    neutral: Neutral = field(default_factory=Neutral)
    model: Model = field(default_factory=Model)
    trading: Trading = field(default_factory=Trading)
