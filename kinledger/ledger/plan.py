"""Planning a change of the ledger: money is sliced, slices become operations.

A plan is a short list made by one caller. Running it is Spark's work (``execute``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from .model import InsufficientFunds, InvalidAmount, LedgerError, UnconsumedSlice, checked


@dataclass(frozen=True)
class Operation:
    """mint, burn, transfer, reserve or settle of an amount; owner gives, to gets."""

    kind: str
    asset: str
    amount: int
    owner: str | None = None
    to: str | None = None
    metadata: str = ""
    key: str | None = None


@dataclass
class Slice:
    """A part of some money. What isn't transferred, burned or sliced away must not remain."""

    money: Money
    amount: int
    done: bool = False

    def slice(self, amount: int) -> Slice:
        if self.done or not 0 < amount <= self.amount:
            raise InvalidAmount(f"{amount} of {self.amount}")
        self.amount -= amount
        part = Slice(self.money, amount)
        self.money.slices.append(part)
        return part

    def _consume(self, kind: str, to: str | None, metadata: str, key: str | None = None) -> None:
        if self.done or self.amount == 0:
            raise InvalidAmount("the slice is used up")
        self.done = True
        self.money.plan.operations.append(Operation(kind, self.money.asset, self.amount, self.money.owner, to, metadata, key))

    def transfer_to(self, to: str, metadata: str = "") -> None:
        self._consume("transfer", to, metadata)

    def burn(self, metadata: str = "", key: str | None = None) -> None:
        self._consume("burn", None, metadata, key)


@dataclass
class Money:
    """An amount that an owner has, to be sliced."""

    plan: Plan
    asset: str
    owner: str
    amount: int
    slices: list[Slice] = field(default_factory=list)
    sliced: int = 0

    def slice(self, amount: int) -> Slice:
        if not 0 < amount <= self.amount - self.sliced:
            raise InvalidAmount(f"{amount} of {self.amount - self.sliced}")
        self.sliced += amount
        part = Slice(self, amount)
        self.slices.append(part)
        return part


@dataclass
class Plan:
    """``available`` and ``reserved`` tell what an owner has of an asset, as the plan is made."""

    available: Callable[[str, str], int]
    reserved: Callable[[str, str], int] = lambda asset, owner: 0
    operations: list[Operation] = field(default_factory=list)
    taken: list[Money] = field(default_factory=list)

    def money(self, asset: str, owner: str, amount: int) -> Money:
        if self.available(asset, owner) < checked(amount):
            raise InsufficientFunds(f"{owner} has less than {amount}")
        self.taken.append(Money(self, asset, owner, amount))
        return self.taken[-1]

    def mint(self, asset: str, to: str, amount: int, metadata: str = "", key: str | None = None) -> None:
        self.operations.append(Operation("mint", asset, checked(amount), None, to, metadata, key))

    def burn(self, asset: str, owner: str, amount: int, metadata: str = "", key: str | None = None) -> None:
        self.operations.append(Operation("burn", asset, checked(amount), owner, None, metadata, key))

    def reserve(self, asset: str, owner: str, authority: str, amount: int, metadata: str = "") -> None:
        self.operations.append(Operation("reserve", asset, checked(amount), owner, authority, metadata))

    def settle(self, asset: str, authority: str, receiver: str, amount: int, metadata: str = "") -> None:
        if self.reserved(asset, authority) < checked(amount):
            raise InsufficientFunds(f"{authority} has reserved less than {amount}")
        self.operations.append(Operation("settle", asset, amount, authority, receiver, metadata))

    def validate(self) -> None:
        for money in self.taken:
            if not money.slices:
                raise LedgerError("money was taken and never sliced")
            if any(s.amount and not s.done for s in money.slices):
                raise UnconsumedSlice("a slice was neither transferred nor burned")

    def locks(self) -> dict[tuple[str, str], int]:
        """What must be alive for each (asset, owner)."""
        out: dict[tuple[str, str], int] = defaultdict(int)
        for op in self.operations:
            if op.kind in ("burn", "transfer", "reserve"):
                out[op.asset, op.owner] += op.amount
        return dict(out)
