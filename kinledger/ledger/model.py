"""Tables, states, errors and amounts of the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIVE, RESERVED, BURNED = "alive", "reserved", "burned"

#: id, asset and owner are keys of any type that compares; amounts are in the smallest unit.
ASSETS = "id string, code string, unit long, decimals int"
VALUE_OBJECTS = "id string, asset string, owner string, amount long, state string, reserved_for string, created_at timestamp_ntz"
TRANSACTIONS = "id string, asset string, sender string, receiver string, burned_amount long, minted_amount long, metadata string, created_at timestamp_ntz"
IDEMPOTENCY = "key string, transaction_id string, created_at timestamp_ntz"

MOST_FRAGMENTS = 1000
LARGEST = 2**63 - 1


class LedgerError(ValueError):
    """What a ledger operation refuses."""


class InsufficientFunds(LedgerError):
    pass


class AssetNotFound(LedgerError):
    pass


class InvalidAmount(LedgerError):
    pass


class UnconsumedSlice(LedgerError):
    pass


class TransactionNotFound(LedgerError):
    pass


class DuplicateIdempotencyKey(LedgerError):
    pass


@dataclass(frozen=True)
class Asset:
    id: str
    code: str
    unit: int
    decimals: int = 0

    def to_internal(self, display: float) -> int:
        """Truncates, as money that isn't there can't be rounded up."""
        return int(display * 10**self.decimals)

    def to_display(self, internal: int) -> float:
        return internal / 10**self.decimals


def to_internal(display: Column, decimals: Column) -> Column:
    return (display * F.pow(F.lit(10.0), decimals)).cast("long")


def to_display(internal: Column, decimals: Column) -> Column:
    return internal / F.pow(F.lit(10.0), decimals)


def may_become(old: Column, new: Column) -> Column:
    """Alive may be reserved or burned, reserved be freed or burned; burned is final."""
    return ((old == ALIVE) & new.isin(RESERVED, BURNED)) | ((old == RESERVED) & new.isin(ALIVE, BURNED))


def checked(amount: int) -> int:
    if not 0 < amount <= LARGEST:
        raise InvalidAmount(f"{amount}")
    return amount


def idempotency_hash(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)
