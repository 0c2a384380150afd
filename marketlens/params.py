"""Analysis parameters.

The original analysis hard-codes a home state, a home city, three payment
years and the two status values it filters on. They are inputs of the
analysis, not of the data, so they live here with those values as defaults.

``grain`` says what the customer reports count as one transaction: ``"row"``
(the original: a summary row, so an order of two items is two transactions)
or ``"order"`` (each order once; rows without an order id are one unknown
order). It sets repeat customers, orders per customer, transactions per user
with their mode and the gaps between transactions; items per order and
ratings keep counting rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the original analysis (literals it compares with).
DEFAULT_HOME_STATE = "SP"
DEFAULT_HOME_CITY = "sao paulo"
DEFAULT_PAYMENT_YEARS = (2016, 2017, 2018)
DELIVERED = "delivered"
CANCELED = "canceled"
EXCLUDED_PAYMENT_TYPE = "not_defined"
OTHERS_LABEL = "others"


@dataclass(frozen=True)
class ReportParams:
    home_state: str = DEFAULT_HOME_STATE
    home_city: str = DEFAULT_HOME_CITY
    payment_years: tuple[int, ...] = field(default=DEFAULT_PAYMENT_YEARS)
    delivered: str = DELIVERED
    canceled: str = CANCELED
    excluded_payment_type: str = EXCLUDED_PAYMENT_TYPE
    top_n: int = 5
    others_label: str = OTHERS_LABEL
    grain: str = "row"

    def __post_init__(self):
        if self.grain not in ("row", "order"):
            raise ValueError("grain must be 'row' or 'order'")
