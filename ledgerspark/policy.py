"""Business policy and table specifications: every judgment call is a field here, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Policy:
    drop_exact_duplicates: bool = True
    keep_unknown_customers: bool = True  # in totals, under `unknown_segment`; never in the ranking
    unknown_segment: str = "Unknown"
    revenue_statuses: tuple[str, ...] = ("completed",)
    known_statuses: tuple[str, ...] = ("completed", "refunded", "cancelled")
    cap_discounts: bool = True
    unknown_id_block: int = 199_000  # ids from here on are another scheme's
    on_bad_value: str = "drop"  # or "fail"
    top_customers: int = 5
    # Texts that stand for null.
    null_tokens: tuple[str, ...] = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A")
    lookback_days: int = 0

    def __post_init__(self):
        if self.on_bad_value not in ("drop", "fail"):
            raise ValueError(f"on_bad_value must be drop or fail, not {self.on_bad_value}")


@dataclass(frozen=True)
class TableSpec:
    """A declared table: its key, foreign keys (column -> table, column) and column types (money, date, string)."""

    name: str
    key: str
    columns: dict[str, str]
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)


CUSTOMERS = TableSpec("customers", "customer_id", {"customer_id": "string", "customer_name": "string", "segment": "string", "region": "string"})
ORDERS = TableSpec(
    "orders", "order_id", {"order_id": "string", "customer_id": "string", "order_date": "date", "amount": "money", "status": "string"}, {"customer_id": ("customers", "customer_id")}
)
PROMOTIONS = TableSpec(
    "promotions", "promotion_id", {"promotion_id": "string", "order_id": "string", "promo_code": "string", "discount_amount": "money"}, {"order_id": ("orders", "order_id")}
)


class Registry:
    """Declared tables and those inferred on the way: who owns which key."""

    def __init__(self, specs: tuple[TableSpec, ...] = (CUSTOMERS, ORDERS, PROMOTIONS)):
        self.specs = {s.name: s for s in specs}
        self.inferred_keys: dict[str, str] = {}

    def declared(self, table: str) -> bool:
        return table in self.specs

    def add_inferred(self, table: str, key: str | None) -> None:
        if key and not self.declared(table):
            self.inferred_keys[table] = key

    def owners(self, column: str) -> list[str]:
        """Tables whose key has this name, declared or inferred."""
        return sorted([n for n, s in self.specs.items() if s.key == column] + [n for n, k in self.inferred_keys.items() if k == column])
