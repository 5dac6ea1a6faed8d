"""Column roles: which column plays which part in a sales-like table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Names of the columns an operator works on.

    Every operator takes a ``Roles`` value, so the same code runs on any narrow fact table with an
    entity group, an entity, two measures and a category.
    """

    dim: str = "brand"
    item: str = "model"
    qty: str = "sales_volume"
    price: str = "sales_price"
    cat: str = "energy_type"
    ts: str = "sale_date"

    @property
    def required(self) -> list[str]:
        return [self.dim, self.item, self.qty, self.price, self.cat]

    @property
    def numeric(self) -> list[str]:
        return [self.qty, self.price]

    @property
    def text(self) -> list[str]:
        return [self.dim, self.item, self.cat]


SALES = Roles()
