"""What a payload domain contributes: key, matchers and simple features."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import values
from riskweave.operators import features, matching


@dataclass(frozen=True)
class Domain:
    """Matchers are named values of the payload column: strings or lists."""

    matchers: Mapping[str, Callable[[Column], Column]]
    simple_features: Callable[..., DataFrame]
    feature_names: tuple[str, ...]
    config: Mapping[str, tuple[int, int]] = field(default_factory=dict)

    def matching_fields(self, transactions: DataFrame, drop_blank: bool = False) -> DataFrame:
        payload = F.col("payload")
        return matching.matching_fields(
            transactions, "payload_number",
            [(name, value(payload)) for name, value in self.matchers.items()],
            drop_blank=drop_blank)


ORDERS = Domain(
    matchers={
        "customer.email": lambda p: p["billingIdentity"]["emailAddress"]["email"],
        "customer.name": lambda p: values.full_name(p["billingIdentity"]),
        "deviceIdent.token": lambda p: p["deviceData"]["exactId"],
    },
    simple_features=features.payload_features,
    feature_names=("item_count", "amount", "amounts", "categories", "created_at", "order_time",
                   "is_new_customer", "is_high_value"),
)
