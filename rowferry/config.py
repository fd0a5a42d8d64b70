"""Configuration values of a bridge, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# Limits and defaults of the delivery and trigger settings.
MAX_BATCH_SIZE = 1000
MAX_ATTEMPTS = 10
MAX_BACKOFF_MS = 60_000
MAX_BACKOFF_CAP_MS = 300_000
DEFAULT_PER_POLL = 500
MIN_TRACKED = 100
MAX_PREVIEW_ROWS = 10
PAGE_CAPS = {"sql": 5000, "document": 1000, "keyspace": 500}
DEFAULT_FIND_LIMIT = 100
DEFAULT_QUERY_ROWS = 5000
LEDGER_PAGE = 500
RUN_LIST_LIMIT = 50
LOGGED_BODY_CHARS = 16_384
OPERATIONS = ("insert", "update", "delete")
ACTIVE_RUN_STATUSES = ("queued", "running", "canceling")
TERMINAL_RUN_STATUSES = ("completed", "failed", "canceled", "paused", "interrupted")
RESUMABLE_RUN_STATUSES = ("failed", "canceled", "paused", "interrupted")
SETTLED_DELIVERY_STATUSES = ("success", "skipped")


def _in_range(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Sort:
    column: str
    direction: str = "asc"

    def __post_init__(self) -> None:
        if self.direction not in ("asc", "desc"):
            raise ValueError(f"unknown sort direction {self.direction!r}")


@dataclass(frozen=True)
class ColumnMapping:
    source: str
    target: str


@dataclass(frozen=True)
class Target:
    """One table that a bridge writes into."""

    table: str
    schema: str | None = None
    connection: str = ""
    engine: str = "sqlite"
    write_mode: str = "upsert"
    key_columns: tuple[str, ...] = ()
    mapping: tuple[ColumnMapping, ...] = ()
    create_missing: bool = True

    def __post_init__(self) -> None:
        if self.write_mode not in ("upsert", "insert"):
            raise ValueError(f"unknown write mode {self.write_mode!r}")

    @property
    def label(self) -> str:
        return f"{self.schema}.{self.table}" if self.schema else self.table

    def matched_by(self) -> tuple[str, ...]:
        """The key columns, which a target that replaces rows has to have."""
        if self.write_mode == "upsert" and not self.key_columns:
            raise ValueError(f"{self.label} replaces rows by key and names no key column")
        return self.key_columns


@dataclass(frozen=True)
class Payload:
    """How a row becomes a request body."""

    template: str = "{{$row}}"
    fields: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    wrap_key: str | None = None


@dataclass(frozen=True)
class Delivery:
    batch_size: int = 1
    max_attempts: int = 3
    backoff_ms: int = 500
    backoff_max_ms: int = 30_000
    on_error: str = "continue"

    def __post_init__(self) -> None:
        _in_range("batch_size", self.batch_size, 1, MAX_BATCH_SIZE)
        _in_range("max_attempts", self.max_attempts, 1, MAX_ATTEMPTS)
        _in_range("backoff_ms", self.backoff_ms, 0, MAX_BACKOFF_MS)
        _in_range("backoff_max_ms", self.backoff_max_ms, 0, MAX_BACKOFF_CAP_MS)
        if self.on_error not in ("continue", "abort"):
            raise ValueError(f"unknown on_error {self.on_error!r}")


@dataclass(frozen=True)
class WatchStrategy:
    kind: str
    column: str | None = None
    max_tracked: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("increment", "timestamp", "snapshot"):
            raise ValueError(f"unknown watch strategy {self.kind!r}")
        if self.kind != "snapshot" and not self.column:
            raise ValueError(f"the {self.kind} strategy needs a column")
        if self.kind == "snapshot":
            if self.max_tracked is not None and self.max_tracked < MIN_TRACKED:
                raise ValueError(f"max_tracked must be at least {MIN_TRACKED}, not {self.max_tracked}")


@dataclass(frozen=True)
class Bridge:
    """A source table or query, where its rows go, and what starts it."""

    bridge_id: str
    source: str
    primary_key: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()
    targets: tuple[Target, ...] = ()
    payload: Payload | None = None
    delivery: Delivery = field(default_factory=Delivery)
    trigger: str = "replay"
    strategy: WatchStrategy | None = None
    operations: tuple[str, ...] = OPERATIONS
    per_poll: int = DEFAULT_PER_POLL
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.trigger not in ("replay", "watch", "cdc"):
            raise ValueError(f"unknown trigger {self.trigger!r}")
        if bool(self.targets) == (self.payload is not None):
            raise ValueError("a bridge writes either to tables or to a payload outbox")
        if self.trigger == "watch" and self.strategy is None:
            raise ValueError("a watch needs a strategy")
        if self.per_poll < 1:
            raise ValueError(f"per_poll must be at least 1, not {self.per_poll}")
